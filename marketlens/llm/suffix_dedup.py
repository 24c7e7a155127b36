"""Repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

A string of `size` bytes holds an anchor: the position with the smallest hash of
the `GRAM` bytes after it, among the positions where they lie within the string.
Equal strings have their anchors at the same offset, so it is enough to sort the
suffixes that begin at anchors, and only those whose first `GRAM` bytes occur twice.
Each group of documents sorts its suffixes (the bytes after an anchor, and in a
second run the bytes before it, backwards), front-codes both runs (a common
prefix with the suffix before, and the rest), and sends a judge its range of
first-bytes hashes. A judge combines the runs of all groups with a loser tree whose
nodes keep the common prefix with the last winner, so known prefixes are never
compared again; what comes out is a sparse suffix array with its common-prefix
lengths, in both directions. A string at offset d before its anchor repeats if
another suffix shares d bytes on the left and size - d on the right.

Defined cases: null and empty texts have no bytes; texts shorter than `size` lose
none, and matches never cross texts; strings may overlap their own copies; rows
that repeat a doc_id, or have none, are documents of their own; what is left may be cut within a
character and so is binary; other columns are ignored. A group holds at
least one whole document, so a worker's memory grows with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import exchange
from marketlens.llm.textops import BASE, IMAGE, Texts, covered, mix, pack_numbers, pack_sorted, powers, span_hashes, unpack_numbers, windows

SIZE, GRAM = 200, 64
PROBE_SHIFT = np.uint64(18)
RUNS = "judge int, p int, n int, right binary, left binary, order binary, twice binary"
RESULT = "doc_id long, n_bytes long, n_removed long, kept binary, removed array<long>"


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Of the `gram` bytes from each position that has as many behind it."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(IMAGE[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours: of minima up to and from the edges of blocks."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Group:
    """Blocks of a group: runs of strings of `size` bytes with one anchor, from first to last."""

    def __init__(self, group: pa.Table, size: int, gram: int):
        self.size, self.gram = size, gram
        self.ids = exchange.doc_ids(group)
        self.texts = Texts.of(exchange.column(group, "text"))

    def blocks(self) -> None:
        t, width = self.texts, self.size - self.gram + 1
        where = windows(t.at, self.size)
        h = gram_hashes(t.data, self.gram)
        bits = np.uint64(max(24, int(len(h)).bit_length()))
        ranked = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        least = sliding_min(ranked, width)[where] if len(where) else ranked[:0]
        anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (where[1:] != where[:-1] + 1)])) if len(where) else np.zeros(0, np.int64)
        self.first, self.anchor = where[new], anchor[new]
        self.last = where[np.concatenate([new[1:], [len(where)]]) - 1] if len(new) else new
        # an anchor has the smallest hash of many, so another one deals the anchors evenly to judges
        self.hash = mix(h[self.anchor]) >> PROBE_SHIFT << PROBE_SHIFT
        self.probes, self.probe_of, count = np.unique(self.hash, return_inverse=True, return_counts=True)
        self.repeated = count > 1

    def suffixes(self, repeated: np.ndarray) -> None:
        """Distinct blocks whose anchor's bytes repeat, sorted by hash, bytes after and bytes before the anchor."""
        live = np.flatnonzero(repeated[self.probe_of])
        whole = span_hashes(IMAGE[self.texts.data], self.first[live], self.last[live] + self.size)
        key = mix(whole + (self.anchor - self.first)[live].astype(np.uint64))
        _, first, which, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        data, heads = self.texts.data.tobytes(), self.hash[live[first]].astype(">u8").tobytes()
        keys = []
        for k, b in enumerate(live[first]):
            a, head = self.anchor[b], heads[8 * k : 8 * k + 8]
            keys.append((head + data[a : self.last[b] + self.size], head + data[self.first[b] : a][::-1], k))
        keys.sort()
        self.keys = keys
        rank = np.empty(len(keys), np.int64)
        rank[[k for *_, k in keys]] = np.arange(len(keys))
        self.live, self.block_of = live, rank[which] if len(keys) else which
        self.twice = np.zeros(len(keys), bool)
        self.twice[rank] = count > 1
        self.key_hash = self.hash[live[first]][[k for *_, k in keys]] if keys else np.zeros(0, np.uint64)


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8 if x else n


def front_code(keys: list[bytes]) -> bytes:
    """Sorted strings as the length shared with the one before, and the rest."""
    shared, size, rest, last = [], [], [], b""
    for k in keys:
        n = common(last, k, 0)
        shared.append(n)
        size.append(len(k) - n)
        rest.append(k[n:])
        last = k
    return zstandard.ZstdCompressor(level=3).compress(np.array([shared, size], "<u4").tobytes() + b"".join(rest))


def front_decode(blob: bytes, n: int) -> Iterator[tuple[int, bytes]]:
    """(length shared with the string before, string)."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    shared, size = np.frombuffer(raw, "<u4", 2 * n).reshape(2, n).tolist()
    at, last = 8 * n, b""
    for s, k in zip(shared, size):
        last = last[:s] + raw[at : at + k]
        at += k
        yield s, last


def merge(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(run, length shared with the string before, string) in order, equal strings by run: a loser tree.

    A node keeps the run that lost there and the length that its string shares with
    the winner which passed; the longer a run shares with the last winner, the
    smaller its string, and only equal lengths need bytes compared, from there on.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    heads: list[bytes | None] = [None] * k
    shares = [0] * k
    nexts = [r.__next__ for r in runs]

    def advance(i: int) -> None:
        try:
            shares[i], heads[i] = nexts[i]()
        except StopIteration:
            shares[i], heads[i] = -1, None

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's share becomes that with the winner."""
        sa, sb = shares[a], shares[b]
        if sa > sb:
            return a, b
        if sb > sa:
            return b, a
        if sa < 0:
            return (a, b) if a < b else (b, a)
        x, y = heads[a], heads[b]
        n = common(x, y, sa)
        if n == len(x) == len(y):
            first = a < b
        else:
            first = n == len(x) or (n < len(y) and x[n] < y[n])
        if first:
            shares[b] = n
            return a, b
        shares[a] = n
        return b, a

    for i in range(k):
        if i < len(runs):
            advance(i)
        else:
            shares[i] = -1
    losers, winners = [0] * k, [0] * (2 * k)
    winners[k:] = range(k)
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    while heads[top] is not None:
        yield top, shares[top], heads[top]
        advance(top)
        node = (top + k) >> 1
        while node:
            top, losers[node] = play(top, losers[node])
            node >>= 1


def _send_probes(size: int, gram: int, judges: int):
    def step(group: pa.Table, _: dict) -> Iterator[pa.RecordBatch]:
        g = Group(group, size, gram)
        g.blocks()
        p, cuts = group.column("p")[0].as_py(), exchange.judge_cuts(g.probes, judges)
        rows = [(j, p, pack_sorted(g.probes[a:b] >> PROBE_SHIFT), np.packbits(g.repeated[a:b]).tobytes()) for j, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        yield exchange.batch(rows, exchange.HASHES)

    return step


def _sorted_suffixes(group: pa.Table, replies: dict, size: int, gram: int, judges: int) -> Group:
    g = Group(group, size, gram)
    g.blocks()
    g.suffixes(*exchange.all_flags(replies, 0, exchange.judge_cuts(g.probes, judges)))
    return g


def _send_runs(size: int, gram: int, judges: int):
    def step(group: pa.Table, replies: dict) -> Iterator[pa.RecordBatch]:
        if replies:
            g = _sorted_suffixes(group, replies, size, gram, judges)
            p, cuts, rows = group.column("p")[0].as_py(), exchange.judge_cuts(g.key_hash, judges), []
            for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    part = g.keys[a:b]
                    order = sorted(range(b - a), key=lambda i: part[i][1])
                    rows.append((j, p, int(b - a), front_code([x[0] for x in part]), front_code([part[i][1] for i in order]), pack_numbers(np.array(order)), np.packbits(g.twice[a:b]).tobytes()))
            yield exchange.batch(rows, RUNS)

    return step


def _suffix_array(blobs: list[bytes], sizes: list[int], orders: list[np.ndarray] | None, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, shared with the one before, length) of all runs' strings in order."""
    total = int(sum(sizes))
    item, shared, length = (np.zeros(total, np.int64) for _ in range(3))
    taken = [0] * len(sizes)
    starts = base.tolist()
    places = [o.tolist() for o in orders] if orders else None
    items, shares, lengths = [], [], []
    for run, s, text in merge([front_decode(b, n) for b, n in zip(blobs, sizes)]):
        i = taken[run]
        taken[run] = i + 1
        items.append(starts[run] + (places[run][i] if places else i))
        shares.append(s)
        lengths.append(len(text))
    item[:], shared[:], length[:] = items, shares, lengths
    return item, shared, length


def _judge_runs(size: int, gram: int):
    head = 8  # bytes of the hash before each string

    def judge(key: tuple, got: pa.Table) -> pa.Table:
        p, sizes = got.column("p").to_pylist(), got.column("n").to_pylist()
        base = np.concatenate([[0], np.cumsum(sizes)])
        n = int(base[-1])
        item, share, length = _suffix_array(got.column("right").to_pylist(), sizes, None, base)
        l_item, l_share, l_length = _suffix_array(got.column("left").to_pylist(), sizes, [unpack_numbers(x) for x in got.column("order").to_pylist()], base)
        twice = np.concatenate([exchange.flags(b, k) for b, k in zip(got.column("twice").to_pylist(), sizes)])
        # equal strings next to each other in either order
        def spread(order: np.ndarray, values: np.ndarray) -> np.ndarray:
            out = np.empty(n, np.int64)
            out[order] = values
            return out

        same = lambda s, le: np.cumsum(np.concatenate([[True], (s[1:] != le[1:]) | (le[1:] != le[:-1])]))
        right_id, left_id = spread(item, same(share, length)), spread(l_item, same(l_share, l_length))
        right_len, left_len = spread(item, length) - head, spread(l_item, l_length) - head
        _, first, variant, count = np.unique(right_id * (n + 1) + left_id, return_index=True, return_inverse=True, return_counts=True)
        many = (count > 1) | (np.bincount(variant, twice, len(count)) > 0)
        family = spread(item, np.cumsum(share < head + gram))[first]
        mixed = np.flatnonzero(np.bincount(family, minlength=int(family.max()) + 1)[family] > 1)
        nearest, farthest = size - right_len[first], left_len[first]  # offsets of a block's strings before the anchor
        hit = np.zeros((len(first), size - gram + 1), bool)
        hit[many] = True
        if len(mixed):
            low, high, of = nearest[mixed], farthest[mixed], first[mixed]
            order, l_order = spread(item, np.arange(n))[of], spread(l_item, np.arange(n))[of]
            for d in range(size - gram + 1):
                use = np.flatnonzero((low <= d) & (d <= high))
                if len(use) > 1:
                    right = np.cumsum(share < head + size - d)[order[use]]
                    left = np.cumsum(l_share < head + d)[l_order[use]]
                    _, w, c = np.unique(right * (n + 1) + left, return_inverse=True, return_counts=True)
                    hit[mixed[use[c[w] > 1]], d] = True
        d = np.arange(size - gram + 1)
        inside = (d >= nearest[:, None]) & (d <= farthest[:, None])
        hit &= inside
        full, some = (hit == inside).all(1), hit.any(1)
        out: tuple[list, list, list] = ([], [], [])
        for q, a, b in zip(p, base, base[1:]):
            mine = variant[a:b]
            if full[mine].any():
                for row, x in zip(out, (q, 2, np.packbits(full[mine]).tobytes())):
                    row.append(x)
            part = np.flatnonzero(some[mine] & ~full[mine])
            if len(part):
                edge = np.diff(np.pad(hit[mine[part]].astype(np.int8), ((0, 0), (1, 1))), axis=1)
                (r, begin), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
                for row, x in zip(out, (q, 3, pack_numbers(np.concatenate([part[r], begin, end - 1])))):
                    row.append(x)
        k = len(out[0])
        return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array([key[0].as_py()] * k, pa.int32()), pa.array(out[2], pa.binary())], schema=exchange.ANSWER_SCHEMA)

    return judge


def _finish(size: int, gram: int, judges: int):
    def step(group: pa.Table, replies: dict) -> Iterator[pa.RecordBatch]:
        if any(kind > 0 for kind, _ in replies):
            g = _sorted_suffixes(group, replies, size, gram, judges)
            cuts = exchange.judge_cuts(g.key_hash, judges)
            first, last, anchor = (x[g.live] for x in (g.first, g.last, g.anchor))
            full = exchange.all_flags(replies, 2, cuts)[0, g.block_of]
            marks = [(first[full], last[full])]
            for j in range(judges):
                if blob := replies.get((3, j)):
                    k, low, high = unpack_numbers(blob).astype(np.int64).reshape(3, -1)
                    of = np.argsort(g.block_of, kind="stable")
                    begin, end = (np.searchsorted(g.block_of[of], k + cuts[j], side) for side in ("left", "right"))
                    rows = of[np.concatenate([np.arange(a, b) for a, b in zip(begin, end)])]
                    each = end - begin
                    marks.append((anchor[rows] - np.repeat(high, each), anchor[rows] - np.repeat(low, each)))
            start, end = (np.concatenate([m[i] for m in marks]) for i in (0, 1))
            gone = covered(len(g.texts.data), start, end - start + size)
        else:
            g = Group(group, size, gram)
            gone = np.zeros(len(g.texts.data), bool)
        t, kept, spans, n_gone = g.texts, [], [], []
        for a, b in zip(t.at, t.at[1:]):
            mine = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
            kept.append(t.data[a:b][~mine].tobytes() if len(edges) else t.data[a:b].tobytes())
            spans.append(edges.tolist())
            n_gone.append(int(mine.sum()))
        yield pa.RecordBatch.from_arrays([exchange.column(group, "doc_id"), pa.array(np.diff(t.at), pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.int64()))], schema=exchange._arrow(RESULT))

    return step


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, kept (the bytes left), removed (start and end of each maximal removed run, in turn)."""
    if not 8 <= gram < size:
        raise ValueError("an anchor's bytes are fewer than a string's, and eight at least")
    groups, judges = exchange.grouped_documents(docs)
    probes = exchange.visit(groups, _send_probes(size, gram, judges), exchange.HASHES)
    live = probes.groupBy("judge").applyInArrow(exchange.judge_repeats, exchange.ANSWERS)
    runs = exchange.visit(groups, _send_runs(size, gram, judges), RUNS, live)
    repeats = runs.groupBy("judge").applyInArrow(_judge_runs(size, gram), exchange.ANSWERS)
    return exchange.visit(groups, _finish(size, gram, judges), RESULT, live.unionByName(repeats))


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.expr("cast(size(removed) div 2 as bigint)").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
