"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has POSITIONS symbols of eight bits. It is split into chunks of
CHUNK symbols; of two signatures that differ in at most THRESHOLD =
chunks * (ERRORS + 1) - 1 positions, some chunk differs in at most ERRORS (one)
positions. All chunks with one position left out are enumerated as keys, so every
such pair shares a key. At a Jaccard similarity of 0.85 a position differs with
probability 0.15, so about 14.4 of 96 do; more than THRESHOLD = 31 in about one of
10^5 such pairs and fewer for closer ones. Candidates under the threshold are
confirmed on their full shingle sets. Below 0.85, LOW_POSITIONS in chunks of LOW_CHUNK
are used: of a pair at 0.8 about 20 of 100 positions differ, and more than 39 in fewer than
one of 10^5 such pairs.

Documents of equal shingle sets are one class, and classes without a key in common
with another are done. Of the rest, the shingles that no other of them has are
counted: a pair shares at most the smaller number of remaining shingles. In a bucket,
the member with the smallest share of such shingles is the hub, and members are compared
with it first; links make components, and only pairs of different components remain. Of
these a bucket names those that its members' rarest shingles allow: with the shingles of
all sets in one order, rarest first, two sets that share enough have their first common
shingle so early in both that enough of either is left behind it. Copies that were edited apart
share only shingles of the original, which come behind those of their edits and so too late,
so that a group of any size names about as many pairs as its members share edits, and no
link is left out that joins components. While these are still many, other hubs come first. Sets
move only with a hub, once for each group of documents that holds a partner.

Defined cases: null, empty and word-less texts have an empty set and link to nothing;
a text of fewer words than a shingle is one shingle; rows that repeat a doc_id are
judged each by its text and share the id; rows without a doc_id link to nothing, have no
component_id and are kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm import exchange, shared
from marketlens.llm.components import components
from marketlens.llm.textops import BASE, IMAGE, LOWER, WORD_BASE, Texts, chunks, mix, pack_numbers, pack_sorted, span_hashes, unpack_numbers, unpack_sorted, windows

WORDS, PERCENT = 5, 85
POSITIONS, CHUNK, ERRORS = 96, 6, 1
THRESHOLD = POSITIONS // CHUNK * (ERRORS + 1) - 1
#: For similarities under PERCENT, where more positions differ.
LOW_POSITIONS, LOW_CHUNK = 100, 5
BATCH_BYTES = 1 << 20
#: Remaining pairs, for each member and once for each key and rare shingle that they share, up to which all are compared rather than hubs once more.
MANY = 200
#: A judge gets two to this power of keys, or more where there are fewer judges.
KEYS_A_JUDGE = 18
#: Rare shingles of members that a judge sorts at once.
RARE_ROWS = 1 << 21
_U = np.uint64
SHIFT = _U(18)


def layout(percent: int) -> tuple[int, int, int]:
    """(positions, chunk, threshold) of signatures for a similarity."""
    positions, chunk = (POSITIONS, CHUNK) if percent >= PERCENT else (LOW_POSITIONS, LOW_CHUNK)
    return positions, chunk, positions // chunk * (ERRORS + 1) - 1


def shingle_sets(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes text by text and sorted, where each text's begin, and the end)."""
    start, end, at = texts.words()
    h = span_hashes(IMAGE[LOWER[texts.data]], start, end, BASE)
    where = windows(at, words)
    n = np.diff(at)
    short = np.flatnonzero((n > 0) & (n < words))
    begin = np.concatenate([where, at[:-1][short]])
    stop = np.concatenate([where + words, at[1:][short]])
    text = np.concatenate([np.searchsorted(at, where, "right") - 1, short])
    value = span_hashes(h, begin, stop, WORD_BASE)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])]) if len(text) else np.zeros(0, bool)
    return value[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def set_names(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, whatever its order; 0 of an empty one."""
    total = np.concatenate([[_U(0)], np.cumsum(mix(values * _U(3)), dtype=np.uint64)])
    size = np.diff(at)
    return np.where(size > 0, mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64)), _U(0))


def signatures(values: np.ndarray, at: np.ndarray, positions: int = POSITIONS) -> np.ndarray:
    """A row of `positions` symbols for each set; zeros for an empty one."""
    out = np.zeros((len(at) - 1, positions), np.uint8)
    factors = mix(np.arange(1000, 1000 + positions, dtype=np.uint64)) | _U(1)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        buffer, starts = np.empty_like(values), at[:-1][full]
        for j in range(positions):
            np.multiply(values, factors[j], out=buffer)
            out[full, j] = (np.minimum.reduceat(buffer, starts) * factors[-1 - j]) >> _U(56)
    return out


def _sign(words: int, positions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(Texts.of(batch.column("text")).at)
            for a, b in chunks(sizes, BATCH_BYTES):
                part = batch.slice(a, b - a)
                values, at = shingle_sets(Texts.of(part.column("text")), words)
                sig = signatures(values, at, positions)
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(np.diff(at), pa.int64()), pa.array(set_names(values, at).view(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary())],
                    names=["doc_id", "text_hash", "n", "node", "sig"],
                )

    return run


def _keys(sig: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """All chunks of each signature with one position left out, as hashes; a row a signature."""
    wide = sig.astype(np.uint64)
    out = []
    for c in range(0, sig.shape[1], chunk):
        for skip in range(chunk):
            key = np.full(len(sig), c * chunk + skip, np.uint64)
            for j in range(chunk):
                if j != skip:
                    key = key << _U(8) | wide[:, c + j]
            out.append(mix(key))
    return np.stack(out, 1) if len(sig) else np.zeros((0, sig.shape[1]), np.uint64)


def _planes(x: np.ndarray) -> bytes:
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<i8").ravel()


KEYS = "judge int, keys binary, places binary, nodes binary, groups binary, sizes binary, known binary, rare binary, rare_sizes binary"


def _send_keys(judges: int, positions: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(-1, positions)
                keys = _keys(sig, chunk)
                key, which = keys.ravel(), np.repeat(np.arange(len(sig)), keys.shape[1])
                order = np.argsort(key, kind="stable")
                key, which = key[order], which[order]
                about = [part.column(c).to_numpy() for c in ("node", "component", "n", "known")]
                rare = part.column("rare").to_pylist() if "rare" in part.schema.names else [b""] * len(sig)
                cuts = exchange.judge_cuts(key, judges)
                # members as places in a list that goes along: a judge gets only some keys of each
                rows = []
                for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if b > a:
                        used, place = np.unique(which[a:b], return_inverse=True)
                        lists = [rare[i] for i in used]
                        rows.append((j, pack_sorted(key[a:b]), place.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes(), *(_planes(x[used]) for x in about), b"".join(lists), _planes(np.array([len(x) // 4 for x in lists]))))
                yield exchange.batch(rows, KEYS)

    return run


class Buckets:
    """A judge's keys with the members of each, hubs first; members alone with their key are left out."""

    def __init__(self, got: pa.Table, seed: int):
        parts: tuple[list, ...] = ([], [], [], [], [], [], [], [])
        members = 0
        for k, places, *about, rare, rare_sizes in zip(*(got.column(c).to_pylist() for c in ("keys", "places", "nodes", "groups", "sizes", "known", "rare", "rare_sizes"))):
            place = np.ascontiguousarray(np.frombuffer(places, np.uint8).reshape(2, -1).T).view("<u2").ravel().astype(np.int64)
            lists = _unplanes(rare_sizes)
            for to, x in zip(parts, [unpack_sorted(k), place + members, *map(_unplanes, about), np.frombuffer(rare, "<u4"), lists]):
                to.append(x)
            members += len(lists)
        keys, member, nodes, groups, sizes, known, self.rare, lists = map(np.concatenate, parts)
        self.rare_at = np.concatenate([[0], np.cumsum(lists)]).astype(np.int64)
        _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        pick = np.flatnonzero(count[which] > 1)
        # what is known of members is spread over keys only after those of one member are gone
        keys, member = keys[pick], member[pick]
        nodes, groups, sizes, known = (x[member] for x in (nodes, groups, sizes, known))
        # the first is the member that shares most with others, or by a hash that a seed changes
        own = (sizes - known) * 1000 // np.maximum(sizes, 1) if not seed else np.zeros(len(nodes), np.int64)
        order = np.lexsort((mix(nodes.view(np.uint64) + _U(seed) * keys), own, keys))
        self.keys, self.nodes, self.groups, self.sizes, self.known, self.member = (x[order] for x in (keys, nodes, groups, sizes, known, member))
        self.first = np.flatnonzero(np.concatenate([[True], self.keys[1:] != self.keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.bucket = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(self.keys))))

    def possible(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Pairs that may be similar enough, by their sizes and the shingles that they can share."""
        most = np.minimum(self.known[a], self.known[b])
        return (100 + percent) * most >= percent * (self.sizes[a] + self.sizes[b])

    def mixed(self, percent: int) -> np.ndarray:
        """Members that have shingles enough in common with others, of buckets where these are of several components; by bucket."""
        alive = np.flatnonzero(100 * self.known >= percent * self.sizes)
        return alive[_of_several(self.bucket[alive], self.groups[alive])]

    def rare_groups(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(members, what each has left from there on) for each bucket and rare shingle that members of several components share early enough."""
        rows = self.mixed(percent)
        least = np.full(len(self.first), np.iinfo(np.int64).max)
        np.minimum.at(least, self.bucket[rows], self.sizes[rows])
        counts = np.diff(self.rare_at)[self.member[rows]]
        ends = np.searchsorted(self.bucket[rows], np.arange(len(self.first)), "right")
        for a, b in chunks(np.diff(np.concatenate([[0], np.cumsum(counts)[ends - 1] * (ends > 0)])) if len(rows) else [], RARE_ROWS):
            lo, hi = (ends[a - 1] if a else 0), ends[b - 1]
            mine, n = rows[lo:hi], counts[lo:hi]
            who = np.repeat(mine, n)
            at = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            shingle = self.rare[np.repeat(self.rare_at[self.member[mine]], n) + at]
            left = self.known[who] - at  # the shingles before are its own, or rarer
            pick = np.flatnonzero((100 + percent) * left >= percent * (self.sizes[who] + least[self.bucket[who]]))
            who, left, shingle = who[pick], left[pick], shingle[pick]
            order = np.lexsort((shingle, self.bucket[who]))
            who, left, shingle = who[order], left[order], shingle[order]
            group = np.cumsum(np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (self.bucket[who][1:] != self.bucket[who][:-1])])) if len(who) else np.zeros(0, np.int64)
            several = _of_several(group, self.groups[who])
            who, left, group = who[several], left[several], group[several]
            begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(who) else []
            for lo, hi in zip(begin, [*begin[1:], len(who)]):
                yield who[lo:hi], left[lo:hi]


def _of_several(group: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Places of sorted groups that hold several components."""
    if not len(group):
        return np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    several = np.minimum.reduceat(component, begin) != np.maximum.reduceat(component, begin)
    return np.flatnonzero(np.repeat(several, np.diff(np.append(begin, len(group)))))


def _members(key: tuple, got: pa.Table) -> pa.Table:
    return pa.table([pa.array(np.unique(Buckets(got, 0).nodes), pa.int64())], names=["node"])


def _open(percent: int):
    """Of one judge's buckets, the members that may be linked to other components."""

    def judge(key: tuple, got: pa.Table) -> pa.Table:
        x = Buckets(got, 0)
        return pa.table([pa.array(np.unique(x.nodes[x.mixed(percent)]), pa.int64())], names=["node"])

    return judge


def _pairs(mode: str, seed: int, percent: int):
    """Of one judge's buckets, "hub": pairs of a hub and members of other components; "rare": the pairs of different components that their rarest shingles allow; "count": how many these are, counted for each bucket and shingle."""

    def judge(key: tuple, got: pa.Table) -> pa.Table:
        x = Buckets(got, seed)
        found = [np.zeros((0, 2), np.int64)]
        total = 0
        if mode == "hub":
            hub = x.first[x.bucket]
            at = np.flatnonzero(x.groups != x.groups[hub])
            at = at[x.possible(hub[at], at, percent)]
            found.append(np.stack([x.nodes[hub[at]], x.nodes[at]], 1))
        else:
            for mine, left in x.rare_groups(percent):
                # those of the most frequent component are partners only
                names, which, count = np.unique(x.groups[mine], return_inverse=True, return_counts=True)
                for i in np.flatnonzero(which != np.argmax(count)):
                    good = (which != which[i]) & ((100 + percent) * np.minimum(left, left[i]) >= percent * (x.sizes[mine] + x.sizes[mine[i]]))
                    mates = mine[good]
                    total += len(mates)
                    if mode == "rare" and len(mates):
                        found.append(np.stack([np.full(len(mates), x.nodes[mine[i]]), x.nodes[mates]], 1))
            if mode == "count":
                return pa.table([pa.array([total], pa.int64()), pa.array([0], pa.int64())], names=["a", "b"])
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return pa.table([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

    return judge


COUNTED = "judge int, p int, hashes binary, counts binary"


def _rank_shingles(key: tuple, got: pa.Table) -> pa.Table:
    """How frequent each group's shingles are, as a byte that grows with the logarithm of the number of classes: 0 for one."""
    p = got.column("p").to_pylist()
    parts = [unpack_sorted(x) for x in got.column("hashes").to_pylist()]
    every, which = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(which, np.concatenate([unpack_numbers(x) for x in got.column("counts").to_pylist()]), len(every))
    rank = np.minimum(255, np.ceil(16 * np.log2(np.maximum(total, 1)))).astype(np.uint8)[which]
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    found = [(q, rank[a:b].tobytes()) for q, a, b in zip(p, at, at[1:]) if rank[a:b].any()]
    return exchange.answer_table([q for q, _ in found], 0, key[0].as_py(), [b for _, b in found])


def known_shingles(docs: DataFrame, n: int, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, known, rare) of each class (node, doc): how many of its shingles another of these classes has too, and the rarest of these, by which alone it can meet another one."""
    groups, judges = exchange.grouped_documents(docs, n)
    asked = classes.groupBy(exchange.group_of("doc", n).alias("p")).agg(F.collect_list("doc").alias("docs"))
    asked = asked.select("p", F.lit(9).alias("kind"), F.lit(0).alias("judge"), F.lit(None).cast("binary").alias("bits"), "docs")

    def prepared(group: pa.Table, wanted: list[int]) -> tuple:
        sets = sorted(_wanted(group, set(wanted), words).items())
        values = np.concatenate([x for _, x in sets]) if sets else np.zeros(0, np.uint64)
        hashes, which, count = np.unique(values >> SHIFT << SHIFT, return_inverse=True, return_counts=True)
        return sets, hashes, which, count

    def send(key: tuple, group: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        if group.num_rows and told.num_rows:
            _, hashes, _, count = prepared(group, told.column("docs")[0].as_py())
            cuts = exchange.judge_cuts(hashes, judges)
            rows = [(j, key[0].as_py(), pack_sorted(hashes[a:b] >> SHIFT), pack_numbers(count[a:b])) for j, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return pa.Table.from_batches([exchange.batch(rows, COUNTED)])

    def count(key: tuple, group: pa.Table, told: pa.Table) -> pa.Table:
        names, known, rare = [], [], []
        docs = [x for x in told.column("docs").to_pylist() if x]
        if group.num_rows and docs:
            sets, hashes, which, _ = prepared(group, docs[0])
            cuts = exchange.judge_cuts(hashes, judges)
            rank = np.zeros(len(hashes), np.uint8)
            for k, j, b in zip(*(told.column(c).to_pylist() for c in ("kind", "judge", "bits"))):
                if k == 0:
                    rank[cuts[j] : cuts[j + 1]] = np.frombuffer(b, np.uint8)
            at = 0
            for name, x in sets:
                mine = which[at : at + len(x)]
                at += len(x)
                order = mine[np.lexsort((mine, rank[mine]))]  # rarest first, then by hash: the same order in all sets
                own = int((rank[mine] == 0).sum())
                names.append(name)
                known.append(len(x) - own)
                rare.append((hashes[order[own : len(x) + 1 + -percent * len(x) // 100]] >> _U(32)).astype("<u4").tobytes())
        return pa.table([pa.array(names, pa.int64()), pa.array(known, pa.int64()), pa.array(rare, pa.binary())], names=["node", "known", "rare"])

    by_group = groups.groupBy("p")
    sent = by_group.cogroup(asked.groupBy("p")).applyInArrow(send, COUNTED)
    answers = sent.groupBy("judge").applyInArrow(_rank_shingles, exchange.ANSWERS).withColumn("docs", F.lit(None).cast("array<long>"))
    return by_group.cogroup(asked.unionByName(answers).groupBy("p")).applyInArrow(count, "node long, known long, rare binary")


def _near(percent: int):
    positions, _, threshold = layout(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, positions) for c in ("a_sig", "b_sig"))
                n, m = (batch.column(c).to_numpy() for c in ("a_n", "b_n"))
                good = ((a != b).sum(1) <= threshold) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                yield batch.select(["a", "b", "a_doc", "b_doc"]).filter(pa.array(good))

    return run


def _wanted(group: pa.Table, wanted: set[int], words: int) -> dict[int, np.ndarray]:
    """Sets by name, of those documents of a group that are wanted."""
    mask = [x in wanted for x in group.column("doc_id").to_pylist()]
    rows = group.filter(pa.array(mask)).combine_chunks()
    values, at = shingle_sets(Texts.of(exchange.column(rows, "text")), words)
    return {int(name): values[a:b] for name, a, b in zip(set_names(values, at).view(np.int64), at, at[1:])}


HUBS = "p int, a long, hub binary, nodes array<long>, docs array<long>"


def _send_hubs(words: int):
    def run(key: tuple, group: pa.Table, asked: pa.Table) -> pa.Table:
        schema, rows = exchange._arrow(HUBS), []
        if asked.num_rows and group.num_rows:
            sets = _wanted(group, set(asked.column("a_doc").to_pylist()), words)
            for q, a, nodes, docs in zip(*(asked.column(c).to_pylist() for c in ("to", "a", "nodes", "docs"))):
                rows.append((q, a, sets[a].tobytes(), nodes, docs))
        return pa.Table.from_batches([exchange.batch(rows, HUBS)], schema)

    return run


def _confirm(words: int, percent: int):
    def run(key: tuple, group: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list] = ([], [])
        if asked.num_rows and group.num_rows:
            sets = _wanted(group, {d for docs in asked.column("docs").to_pylist() for d in docs}, words)
            for a, hub, nodes in zip(*(asked.column(c).to_pylist() for c in ("a", "hub", "nodes"))):
                left = np.frombuffer(hub, np.uint64)
                for b in nodes:
                    right = sets[b]
                    at = np.searchsorted(left, right)
                    at[at == len(left)] = 0
                    both = int((left[at] == right).sum())
                    if 100 * both >= percent * (len(left) + len(right) - both):
                        out[0].append(a)
                        out[1].append(b)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    return run


def confirmed(docs: DataFrame, n: int, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those (a, b) of (a, b, a_doc, b_doc) whose full sets are similar enough."""
    groups, _ = exchange.grouped_documents(docs, n)
    place = lambda c: exchange.group_of(c, n)
    asked = pairs.groupBy(place("a_doc").alias("p"), place("b_doc").alias("to"), "a", "a_doc").agg(F.collect_list(F.struct("b", "b_doc")).alias("mates"))
    asked = asked.select("p", "to", "a", "a_doc", F.col("mates.b").alias("nodes"), F.col("mates.b_doc").alias("docs"))
    hubs = groups.groupBy("p").cogroup(asked.groupBy("p")).applyInArrow(_send_hubs(words), HUBS)
    return groups.groupBy("p").cogroup(hubs.groupBy("p")).applyInArrow(_confirm(words, percent), "a long, b long")


def judged(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash (of the text as given), n_shingles, component_id, kept of every row."""
    if not 80 <= percent <= 100:
        raise ValueError("the signatures are laid out for similarities of 0.8 and more")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), text_hash("text").alias("text_hash"))
    positions, chunk, _ = layout(percent)
    signed = shared.staged(rows.mapInArrow(_sign(words, positions), "doc_id long, text_hash long, n long, node long, sig binary"), "signatures")
    rows = rows.drop("text_hash")
    classes = shared.staged(signed.filter("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    judges, n_groups = shared.partitions(docs.sparkSession), exchange.number_of_groups(rows)

    def bucketed(named: DataFrame, n: int, judge, schema: str) -> DataFrame:
        # as many judges as the keys need: a member is named by each judge that has one of its buckets
        need = n * positions >> KEYS_A_JUDGE
        few = max(min(judges, max(8, need)), need // 16)
        return named.mapInArrow(_send_keys(few, positions, chunk), KEYS).groupBy("judge").applyInArrow(judge, schema)

    def compared(pairs: DataFrame) -> DataFrame:
        one = classes.select(F.col("node").alias("a"), F.col("doc").alias("a_doc"), F.col("n").alias("a_n"), F.col("sig").alias("a_sig"))
        near = pairs.join(one, "a").join(one.toDF("b", "b_doc", "b_n", "b_sig"), "b").select("a", "b", "a_doc", "b_doc", "a_n", "b_n", "a_sig", "b_sig")
        near = near.mapInArrow(_near(percent), "a long, b long, a_doc long, b_doc long")
        near = shared.staged(near, "near")
        return shared.staged(confirmed(rows, n_groups, near, words, percent) if not near.isEmpty() else near.select("a", "b"), "links")

    pair, about = "a long, b long", ["node", "doc", "n", "sig", "known", "component"]
    members = bucketed(classes.withColumn("component", F.col("node")).withColumn("known", F.col("n")), classes.count(), _members, "node long").distinct()
    live = shared.staged(classes.join(members, "node"), "members")
    n_live = live.count()
    if n_live:
        live = shared.staged(live.join(known_shingles(rows, n_groups, live, words, percent), "node"), "members")
    slim = live.withColumn("component", F.col("node")).select(*about) if n_live else live
    tested = shared.staged(bucketed(slim, n_live, _pairs("hub", 0, percent), pair).distinct(), "tested") if n_live else live.select(F.col("node").alias("a"), F.col("node").alias("b"))
    links = compared(tested) if n_live else tested
    fruitful = True  # hubs are worth a round while they link
    for seed in range(1, 9) if n_live else ():
        named = live.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
        # who may be linked to another component; only these send their rare shingles
        still = bucketed(named.select(*about), n_live, _open(percent), "node long").distinct()
        named = shared.staged(named.join(still, "node"), "named")
        n_open = named.count()
        if not n_open:
            break
        left = bucketed(named, n_open, _pairs("count", 0, percent), pair).agg(F.sum("a")).first()[0] or 0
        if not left:
            break
        every = left <= MANY * max(n_live, 10_000) or not fruitful or seed == 8
        asked = bucketed(named, n_open, _pairs("rare", 0, percent), pair) if every else bucketed(named.select(*about), n_open, _pairs("hub", seed, percent), pair)
        new = shared.staged(asked.distinct().join(tested, ["a", "b"], "left_anti"), "tested")
        if new.isEmpty() and every:
            break
        found = compared(new)
        fruitful = 50 * found.count() >= new.count()
        links, tested = links.unionByName(found), tested.unionByName(new)
        if every:
            break
    found = classes.join(components(links), "node", "left").select("node", "doc", F.coalesce("component", "node").alias("component"))
    least = found.groupBy("component").agg(F.min("doc").alias("component_id"))
    names = shared.staged(found.join(least, "component").select("node", "component_id"), "names")
    out = signed.join(names, "node", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def text_hash(column: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return judged(docs, words, percent).select("doc_id", "n_shingles", "component_id", "kept")
