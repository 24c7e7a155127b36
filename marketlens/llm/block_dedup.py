"""Exact repeats of long word sequences, found by fixed-block anchors.

A window of `size` words always holds one of its document's non-overlapping
blocks of size // 2 words, so where it occurs again, a rolling window of that many words
equals that block. The blocks are indexed by hash; every rolling window
probes the index, and hits if a block of another place has its words. A hit is extended over the words around it:
each window of `size` words that holds a hit is compared by a 96-bit hash of all its words with those of
all documents, and windows without one occur once and go no further. Overlapping repeats merge to maximal
ones, and the earliest place of each window keeps it. Blocks and probes meet as sorted hashes (see `exchange`).

Defined cases: null and empty texts have no words, and texts shorter than a window
lose none; a text of one repeated word loses all but the first window's words; rows that
repeat a doc_id count as documents of their own, in the order of their texts; rows
without a doc_id come first; other columns are ignored. A group holds at least one whole document, so a worker's
memory grows with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import exchange
from marketlens.llm.textops import BASE, IMAGE, WORD_BASE, Texts, covered, pack_numbers, pack_sorted, span_hashes, unpack_numbers, unpack_sorted, windows

SIZE = 20
SECOND_BASE = np.uint64(0xA0761D6478BD642F)
#: Bits of a probe that travel; the rest are decided by the windows' own hashes.
PROBE_SHIFT = np.uint64(18)
PROBES = "judge int, p int, hashes binary, blocks binary, twice binary"
WINDOWS = "judge int, p int, hashes binary, checks binary, docs binary"
RESULT = "doc_id long, n_words long, n_removed long, kept string, removed array<int>"


class Group:
    """A group's words, rolling windows and hashes, the same whenever it is read."""

    def __init__(self, group: pa.Table, size: int):
        self.size, self.block = size, size // 2
        self.ids = exchange.doc_ids(group)
        self.texts = Texts.of(exchange.column(group, "text"))
        self.start, self.end, self.at = self.texts.words()

    def probe(self) -> None:
        self.hash = span_hashes(IMAGE[self.texts.data], self.start, self.end, BASE)
        self.where = windows(self.at, self.block)
        rolling = span_hashes(self.hash, self.where, self.where + self.block, WORD_BASE) >> PROBE_SHIFT << PROBE_SHIFT
        self.probes, self.which = np.unique(rolling, return_inverse=True)
        first = np.repeat(self.at[:-1], np.diff(self.at))
        self.own_block = (self.where - first[self.where]) % self.block == 0
        #: how many of the group's blocks have a probe's words
        self.blocks = np.bincount(self.which[self.own_block], minlength=len(self.probes))

    def extend(self, indexed: np.ndarray, twice: np.ndarray) -> None:
        """Windows of `size` words around hits, by hash; first: the earliest of each in the group. indexed, twice: probes that some block, and more than one, has."""
        n, span = int(self.at[-1]), self.size - self.block + 1
        hits = np.zeros(n + 1, np.int32)
        hits[1:][self.where] = np.where(self.own_block, twice[self.which], indexed[self.which])  # a block doesn't hit itself
        sums = np.cumsum(hits)
        where = windows(self.at, self.size)
        self.found = where[sums[where + span] > sums[where]]
        h = span_hashes(self.hash, self.found, self.found + self.size, SECOND_BASE)
        self.keys, self.first, self.key_of = np.unique(h, return_index=True, return_inverse=True)
        at = self.found[self.first]
        self.checks = (span_hashes(self.hash, at, at + self.size, BASE) >> np.uint64(32)).astype(np.uint32)
        self.key_doc = self.ids[np.searchsorted(self.at, at, "right") - 1]


def _send_probes(size: int, judges: int):
    def step(group: pa.Table, _: dict) -> Iterator[pa.RecordBatch]:
        g = Group(group, size)
        g.probe()
        p, cuts = group.column("p")[0].as_py(), exchange.judge_cuts(g.probes, judges)
        rows = [(j, p, pack_sorted(g.probes[a:b] >> PROBE_SHIFT), np.packbits(g.blocks[a:b] > 0).tobytes(), np.packbits(g.blocks[a:b] > 1).tobytes()) for j, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        yield exchange.batch(rows, PROBES)

    return step


def _judge_probes(key: tuple, got: pa.Table) -> pa.Table:
    p = got.column("p").to_pylist()
    parts = [unpack_sorted(x) for x in got.column("hashes").to_pylist()]
    sizes = [len(x) for x in parts]
    every, which = np.unique(np.concatenate(parts), return_inverse=True)
    spread = lambda name: np.concatenate([exchange.flags(b, n) for b, n in zip(got.column(name).to_pylist(), sizes)])
    blocks = np.bincount(which, spread("blocks") + spread("twice").astype(int), len(every))  # the index
    at, asked, bits = 0, [], []
    for q, n in zip(p, sizes):
        found = blocks[which[at : at + n]]
        at += n
        if found.any():
            asked.append(q)
            bits.append(np.packbits(np.concatenate([found > 0, found > 1])).tobytes())
    return exchange.answer_table(asked, 0, key[0].as_py(), bits)


def _extended(group: pa.Table, replies: dict, size: int, judges: int) -> Group:
    g = Group(group, size)
    g.probe()
    cuts = exchange.judge_cuts(g.probes, judges)
    g.extend(*exchange.all_flags(replies, 0, cuts, 2))
    return g


def _send_windows(size: int, judges: int):
    def step(group: pa.Table, replies: dict) -> Iterator[pa.RecordBatch]:
        if replies:
            g = _extended(group, replies, size, judges)
            p, cuts = group.column("p")[0].as_py(), exchange.judge_cuts(g.keys, judges)
            docs = (g.key_doc.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(np.uint64)
            rows = [
                (j, p, pack_sorted(g.keys[a:b]), pack_numbers(g.checks[a:b]), pack_numbers(docs[a:b] >> np.uint64(32)) + pack_numbers(docs[a:b] & np.uint64(0xFFFFFFFF)))
                for j, (a, b) in enumerate(zip(cuts, cuts[1:]))
                if b > a
            ]
            yield exchange.batch(rows, WINDOWS)

    return step


def _judge_windows(key: tuple, got: pa.Table) -> pa.Table:
    """Bit set: the group holds the window's earliest document."""
    p = got.column("p").to_pylist()
    parts = [unpack_sorted(x) for x in got.column("hashes").to_pylist()]
    checks = np.concatenate([unpack_numbers(x) for x in got.column("checks").to_pylist()])
    docs = np.concatenate([unpack_numbers(x[: len(x) // 2]).astype(np.uint64) << np.uint64(32) | unpack_numbers(x[len(x) // 2 :]) for x in got.column("docs").to_pylist()])
    sizes, hashes = [len(x) for x in parts], np.concatenate(parts)
    order = np.lexsort((docs, checks, hashes))
    h, c = hashes[order], checks[order]
    earliest = np.zeros(len(h), bool)
    earliest[order] = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else []
    at, bits = 0, []
    for n in sizes:
        bits.append(np.packbits(earliest[at : at + n]).tobytes())
        at += n
    return exchange.answer_table(p, 1, key[0].as_py(), bits)


def _finish(size: int, judges: int):
    def step(group: pa.Table, replies: dict) -> Iterator[pa.RecordBatch]:
        if replies:
            g = _extended(group, replies, size, judges)
            (kept,) = exchange.all_flags(replies, 1, exchange.judge_cuts(g.keys, judges))
            earlier = np.ones(len(g.found), bool)
            earlier[g.first[kept]] = False
            gone = covered(int(g.at[-1]), g.found[earlier], size)
        else:
            g = Group(group, size)
            gone = np.zeros(int(g.at[-1]), bool)
        sums = np.concatenate([[0], np.cumsum(gone)])
        n_words, n_gone = np.diff(g.at), sums[g.at[1:]] - sums[g.at[:-1]]
        texts, spans = [], []
        for i, text in enumerate(exchange.column(group, "text").to_pylist()):
            words, a, b = text.encode().split(), g.at[i], g.at[i + 1]
            if n_gone[i]:
                mine = gone[a:b]
                words = list(compress(words, ~mine))
                spans.append(np.flatnonzero(np.diff(np.concatenate([[0], mine, [0]]).astype(np.int8))).tolist())
            else:
                spans.append([])
            texts.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([exchange.column(group, "doc_id"), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.int32()))], schema=exchange._arrow(RESULT))

    return step


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space), removed (start and end of each removed run of words, in turn)."""
    if size < 2:
        raise ValueError("a window has two words at least")
    groups, judges = exchange.grouped_documents(docs)
    probes = exchange.visit(groups, _send_probes(size, judges), PROBES)
    hits = probes.groupBy("judge").applyInArrow(_judge_probes, exchange.ANSWERS)
    found = exchange.visit(groups, _send_windows(size, judges), WINDOWS, hits)
    earliest = found.groupBy("judge").applyInArrow(_judge_windows, exchange.ANSWERS)
    return exchange.visit(groups, _finish(size, judges), RESULT, hits.unionByName(earliest))


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
