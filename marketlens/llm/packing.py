"""Packing by cutting-stock column generation.

Documents become token ids (a tokenizer file, then an end id). Every full
`capacity` run of a document is a sequence of its own; the remainders are the
items of a cutting-stock problem. Their lengths, rounded down to units of
`grain` tokens, form a histogram of capacity / grain entries, which is all that
the driver sees. A linear program over patterns is solved by a revised simplex
whose columns are priced by an unbounded-knapsack dynamic program; its solution
is rounded down, and the documents of each length class, ranked without a
global sort, take the places of the patterns. Rounding down overfills a
sequence by less than a grain an item: what overflows, and what rounding left
over, is laid end to end and cut at every `capacity`, so no sequence is padded;
the last run of that is cut into powers of two.

Defined cases: a null or empty text has the end id only; rows that repeat a
doc_id, or have none, are packed as documents of their own; an empty table gives no pieces;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm import shared

CAPACITY, GRAIN, END_ID = 4096, 32, 2
#: Words of each of the two halves of a worker's token cache, and bytes of these and their ids; a half starts anew beyond either.
CACHE_WORDS, CACHE_BYTES = 300_000, 16 << 20
#: Punctuation that a word-level tokenizer of this family cuts off the end of a word, as one run. Apostrophes and what special tokens are made of are not among it.
STOPS = b".,;:!?$#%&*+=/^~@()[]{}-_"

_state: dict = {}


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class Words(dict):
    """Ids by word; a word that is missing is learned."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, raw: bytes) -> bytes:
        ids = self[raw] = self.learn(raw)
        return ids


class WordEncoder:
    """Ids of words by one tokenizer; each distinct word, with its stem and its stops as words of their own, is encoded once, and again if it was long unseen."""

    def __init__(self, path: str, width: str):
        from tokenizers import Tokenizer

        self.tok, self.code = Tokenizer.from_file(path), {2: "H", 4: "I"}[np.dtype(width).itemsize]
        self.letters = _byte_letters()
        self.words, self.older = Words(self.learn), {}
        self.weight = 0

    def letters_of(self, stem: str) -> str | None:
        """What the model reads of letters that the tokenizer keeps together, if these are Latin; None of others, which it may not keep apart from what follows."""
        if stem.isalpha() and max(stem) < "\u0250" and (low := self.tok.normalizer.normalize_str(stem)).isalpha():
            return "".join([self.letters[b] for b in low.encode()])
        return None

    def learn(self, raw: bytes) -> bytes:
        ids = self.older.get(raw)
        if ids is None:
            base = raw.rstrip(STOPS)
            if base.isalpha():  # of ASCII
                low, key = base.decode().lower(), base.lower()
            else:
                low, key = self.letters_of(base.decode()), base
            if low is None:
                ids = array(self.code, self.tok.encode(raw.decode(), add_special_tokens=False).ids).tobytes()
            elif key == raw:
                ids = array(self.code, [t.id for t in self.tok.model.tokenize(low)]).tobytes()
            else:  # its letters and its stops are words too
                ids = self.words[key]
                if len(base) < len(raw):
                    ids += self.words[raw[len(base) :]]
        self.weight += len(raw) + len(ids)
        return ids

    def encode(self, texts: list[str | None], end: bytes) -> list[bytes]:
        if len(self.words) > CACHE_WORDS or self.weight > CACHE_BYTES:  # what comes again soon is taken over from the older words
            self.words, self.older, self.weight = Words(self.learn), self.words, 0
        get = self.words.__getitem__
        return [b"".join(map(get, (t or "").encode().split())) + end for t in texts]


def encode(texts: list[str | None], path: str, end_id: int = END_ID, width: str = "<u2") -> list[bytes]:
    """Ids of each text and the end id, as little-endian unsigned integers. White space never lies inside a token of a word-level tokenizer, so words are encoded apart."""
    if _state.get("key") != (path, width):
        _state.update(key=(path, width), encoder=WordEncoder(path, width))
    return _state["encoder"].encode(texts, np.array([end_id], width).tobytes())


def _tokenize(path: str, end_id: int, width: str):
    size = np.dtype(width).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = encode(part.column("text").to_pylist(), path, end_id, width)
                yield pa.record_batch(
                    [part.column("part"), pa.array(range(row, row + len(ids)), pa.int64()), part.column("doc_id"), pa.array([len(x) // size for x in ids], pa.int64()), pa.array(ids, pa.large_binary() if sum(map(len, ids)) >= 2**31 else pa.binary())],
                    names=["part", "row", "doc_id", "n", "ids"],
                )
                row += len(ids)

    return run


def price(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of lengths 1..len(duals) within capacity that has the highest sum of duals."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        k = min(c, len(duals))
        gain = best[c - k : c][::-1] + duals[:k]
        j = int(np.argmax(gain))
        best[c], took[c] = (gain[j], j + 1) if gain[j] > best[c - 1] else (best[c - 1], 0)
    pattern, c = np.zeros(len(duals), int), capacity
    while c > 0:
        if took[c]:
            pattern[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def _inverse(basis: np.ndarray) -> np.ndarray:
    """By Gauss and Jordan with row pivots: small, and without a threaded BLAS in the driver."""
    n = len(basis)
    work = np.hstack([basis, np.eye(n)])
    for k in range(n):
        pivot = k + int(np.argmax(np.abs(work[k:, k])))
        work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        other = work[:, k].copy()
        other[k] = 0
        work -= np.outer(other, work[k])
    return work[:, n:]


def cutting_stock(demand: np.ndarray, capacity: int, rounds: int = 2000, gap: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, for the linear relaxation: fewest stocks of `capacity` that hold demand[i] items of length i + 1. It ends within `gap` of the optimum, or half a stock."""
    live = np.flatnonzero(demand)
    if not len(live):
        return []
    need, lengths = demand[live].astype(float), live + 1
    basis = np.diag((capacity // lengths).astype(float))
    inverse = _inverse(basis)
    for step in range(rounds):
        duals = inverse.sum(axis=0)
        wide = np.full(len(demand), -1.0)
        wide[live] = duals
        value, pattern = price(wide, capacity)
        if value <= 1 + 1e-9 or (level := (duals * need).sum()) - level / value < max(0.5, gap * level):  # level / value is a lower bound
            break
        column = pattern[live].astype(float)
        direction, level = (inverse * column).sum(1), (inverse * need).sum(1)
        ratio = np.where(direction > 1e-9, np.maximum(level, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        if step % 200 == 199:
            inverse = _inverse(basis)
        else:
            row = inverse[out] / direction[out]
            inverse -= np.outer(direction, row)
            inverse[out] = row
    level = (_inverse(basis) * need).sum(1)
    found = []
    for k in range(len(live)):
        pattern = np.zeros(len(demand), int)
        pattern[live] = basis[:, k].round().astype(int)
        if level[k] > 1e-9:
            found.append((pattern, float(level[k])))
    return found


def places(demand: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(unit, first rank, end rank, first sequence, items of the unit in a sequence) of all full patterns, and the number of their sequences."""
    found, used, sequences = [], np.zeros(len(demand), int), 0
    for pattern, level in sorted(cutting_stock(demand, capacity), key=lambda x: -x[1]):
        units = np.flatnonzero(pattern)
        times = min(int(level + 1e-6), *(int((demand[u] - used[u]) // pattern[u]) for u in units))
        if times <= 0 or (pattern * np.arange(1, len(pattern) + 1)).sum() != capacity:
            continue
        for u in units:
            end = used[u] + times * pattern[u]
            found.append((int(u) + 1, int(used[u]), int(end), sequences, int(pattern[u])))
            used[u] = end
        sequences += times
    return found, sequences


def _place(table: list[tuple[int, int, int, int, int]]):
    by: dict[int, np.ndarray] = {}
    for unit in {x[0] for x in table}:
        by[unit] = np.array(sorted(x[1:] for x in table if x[0] == unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, rank = (batch.column(c).to_numpy() for c in ("unit", "rank"))
            seq = np.full(len(unit), -1)
            for u in np.unique(unit):
                if u in by:
                    t, mine = by[u], np.flatnonzero(unit == u)
                    k = np.searchsorted(t[:, 0], rank[mine], "right") - 1
                    at = rank[mine]
                    seq[mine] = np.where((k >= 0) & (at < t[k, 1]), t[k, 2] + (at - t[k, 0]) // t[k, 3], -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq, pa.int64())], names=[*batch.schema.names, "seq"])

    return run


def running(df: DataFrame, value: str, order: list[str], out: str, within: list[str] | None = None) -> DataFrame:
    """df with the sum of `value` over the rows before each, by part and order: sums by part first, so that no task holds all rows."""
    keys = within or []
    local = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "part").agg(F.sum(value).alias("_sum")).withColumn("_block", F.expr("part div 1024"))
    blocks = sums.groupBy(*keys, "_block").agg(F.sum("_sum").alias("_total"))
    before = lambda *by: Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ahead = (Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_ahead", F.coalesce(F.sum("_total").over(before(*keys).orderBy("_block").rowsBetween(*ahead)), F.lit(0))).drop("_total")
    sums = sums.withColumn("_in", F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys, "_block").orderBy("part").rowsBetween(*ahead)), F.lit(0)))
    start = sums.join(blocks, [*keys, "_block"]).select(*keys, "part", (F.col("_in") + F.col("_ahead")).alias("_start"))
    return df.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0))).join(start, [*keys, "part"]).withColumn(out, F.col("_local") + F.col("_start")).drop("_local", "_start")


def _finish(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            ids, pieces = batch.column("ids"), batch.column("pieces").to_pylist()
            for k, (doc, n) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist())):
                own = np.frombuffer(ids[k].as_buffer(), width).astype("<u4")
                for x in pieces[k] or ():
                    row = (doc, x["start"], x["length"], zlib.crc32(own[x["start"] : x["start"] + x["length"]].tobytes()), n, x["sequence_id"], x["offset"])
                    for name, v in zip(out, row):
                        out[name].append(v)
            yield pa.record_batch([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if capacity & (capacity - 1) or capacity % grain:
        raise ValueError("capacity must be a power of two that grain divides")
    import json
    from pathlib import Path

    spec = json.loads(Path(tokenizer).read_text())
    top = max([end_id, *spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])
    width = "<u2" if top < 2**16 else "<u4"
    spark = docs.sparkSession
    tokens = shared.staged(
        docs.select(F.spark_partition_id().cast("long").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_tokenize(tokenizer, end_id, width), "part long, row long, doc_id long, n long, ids binary"),
        "tokens",
    )
    plan = shared.staged(_plan(tokens.select("part", "row", "n"), capacity, grain), "pieces")
    pieces = plan.groupBy("part", "row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    n = max(shared.partitions(spark), 1)
    return (
        tokens.repartition(n, "part", "row").join(pieces.repartition(n, "part", "row").hint("shuffle_hash"), ["part", "row"])
        .select("doc_id", "n", "ids", "pieces")
        .mapInArrow(_finish(width), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    )


def _plan(lengths: DataFrame, capacity: int, grain: int) -> DataFrame:
    """(part, row, start, length, sequence_id, offset) of all pieces, from the documents' lengths alone."""
    units = capacity // grain
    items = lengths.select("part", "row", "n", F.expr(f"n div {capacity}").alias("whole"), F.expr(f"n - n % {capacity}").alias("start"), F.expr(f"n % {capacity}").alias("rest")).withColumn("unit", F.expr(f"rest div {grain}"))
    spark = lengths.sparkSession

    full = running(items.filter("whole > 0"), "whole", ["row"], "base")
    n_full = items.agg(F.sum("whole")).first()[0] or 0
    full = full.select("part", "row", F.col("base"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("k")).select(
        "part", "row", (F.col("k") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), (F.col("base") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )

    demand = np.zeros(units, int)
    for unit, count in items.filter("rest > 0 and unit > 0").groupBy("unit").count().collect():  # capacity / grain rows at most
        demand[unit - 1] = count
    table, n_patterns = places(demand, units)

    ranked = running(items.filter("rest > 0").withColumn("one", F.lit(1)), "one", ["row"], "rank", ["unit"]).select("part", "row", "start", F.col("rest").alias("length"), F.col("unit").cast("long").alias("unit"), F.col("rank").cast("long").alias("rank"))
    placed = ranked.mapInArrow(_place(table), "part long, row long, start long, length long, unit long, rank long, seq long")
    order = Window.partitionBy("seq").orderBy(F.desc("unit"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = shared.staged(placed, "placed")
    inside = placed.filter("seq >= 0").withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))).withColumn("fits", F.greatest(F.lit(0), F.least("length", F.lit(capacity) - F.col("offset"))))
    inside = shared.staged(inside, "filled")
    packed = inside.filter("fits > 0").select("part", "row", "start", F.col("fits").alias("length"), (F.col("seq") + n_full).alias("sequence_id"), "offset")

    rest = placed.filter("seq < 0").select("part", "row", "start", "length").unionByName(inside.filter("fits < length").select("part", "row", (F.col("start") + F.col("fits")).alias("start"), (F.col("length") - F.col("fits")).alias("length")))
    total = rest.agg(F.sum("length")).first()[0] or 0
    base, whole = n_full + n_patterns, total // capacity * capacity
    tail, at = [], whole  # the last run as powers of two
    for k, bit in enumerate(b for b in reversed(range(capacity.bit_length())) if (total - whole) >> b & 1):
        tail.append((at, at + (1 << bit), base + whole // capacity + k))
        at += 1 << bit
    laid = running(rest, "length", ["row", "start"], "g").withColumn("end", F.col("g") + F.col("length"))
    cuts = laid.withColumn("cut", F.explode(F.expr(f"sequence(g div {capacity}, (end - 1) div {capacity})"))).filter(F.col("cut") < whole // capacity).select(
        "part", "row", "start", "g", "end", (F.col("cut") * capacity).alias("lo"), ((F.col("cut") + 1) * capacity).alias("hi"), (F.col("cut") + base).alias("sequence_id")
    )
    if tail:
        ends = F.array(*[F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"), F.lit(s).cast("long").alias("sequence_id")) for lo, hi, s in tail])
        last = laid.filter(F.col("end") > whole).select("part", "row", "start", "g", "end", F.inline(ends)).filter("lo < end and g < hi")
        cuts = cuts.unionByName(last)
    laid = cuts.select("part", "row", (F.col("start") + F.greatest("lo", "g") - F.col("g")).alias("start"), (F.least("hi", "end") - F.greatest("lo", "g")).alias("length"), "sequence_id", (F.greatest("lo", "g") - F.col("lo")).alias("offset"))
    return full.unionByName(packed).unionByName(laid)
