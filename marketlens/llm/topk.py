"""Exact top-k inner-product search by pivot-table elimination.

With every vector x lifted to (x, sqrt(M - |x|^2)) and a query q to (q, 0), where
M is the largest squared norm, |x' - q'|^2 = M + |q|^2 - 2 q.x: the highest
inner products are the nearest neighbours. A table, computed once and written beside the
vectors, holds each candidate's distances to some pivots. By the triangle inequality the
largest difference between a candidate's and a query's distances to a pivot bounds their own
distance from below. Candidates are evaluated in the order of that bound, and a
query is done with a block once the bound exceeds its k-th best distance. How much
that saves depends on the data: of vectors in clusters most pairs go; of the random directions of
the test tables all distances are nearly equal, no bound reaches the tenth best and nearly every pair is evaluated.

Candidates stay where they are, in blocks. Queries go to them, in passes of at most
QUERY_BYTES, which a pass broadcasts; a task keeps the best k of its candidates for each query,
and these are merged. The number of tasks in a pass is bounded, as each returns k rows a query.

Defined cases: a vector that is null, has no vec_id, or has a null or non-finite component,
takes no part; missing components of a shorter vector count as 0; components and scores beyond the
range of a long are held at its ends; equal scores rank by vec_id; a candidate with the query's own vec_id is left out, so rows that
repeat a vec_id are one query (with the smallest of their vectors, component by component) and, to others, candidates of their own; a table
without vectors gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm import shared

CANDIDATE_BLOCK, PIVOTS = 4096, 16
#: Queries of one pass, in bytes of their vectors: what is broadcast.
QUERY_BYTES = 16 << 20
#: Relative slack of a bound, far above the rounding error of its distances.
SLACK = 1e-9
_FOUND = "query_id long, vec_id long, score long"


def integer_vectors(table: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * component) of the vectors that take part."""
    good = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return table.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"transform(embedding, x -> floor({scale}D * cast(x as double)))").alias("v"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(ends) and (ends == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(ends), width), np.int64)
    rows = np.repeat(np.arange(len(ends)), ends)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


class Space:
    """Widths, the largest squared norm, and the lifted pivots; what tasks need to know of all vectors."""

    def __init__(self, width: int, top: float, largest: int, pivots: np.ndarray):
        self.width, self.top = width, top
        self.kind = "<i4" if largest < 2**31 else "<i8"
        #: Sums of products that a double holds exactly need no whole numbers.
        self.exact = top < 2**53
        self.pivots = pivots.astype(float)
        self.pivot_extra = self.extra(self.pivots)

    def extra(self, vecs: np.ndarray) -> np.ndarray:
        v = vecs.astype(float)
        return np.sqrt(np.maximum(0, self.top - (v * v).sum(1)))

    def distances(self, vecs: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Of lifted vectors to the lifted pivots, a row a pivot."""
        v, out = vecs.astype(float), np.empty((len(self.pivots), len(vecs)))
        for j, p in enumerate(self.pivots):
            d = v - p
            out[j] = np.sqrt((d * d).sum(1) + (extra - self.pivot_extra[j]) ** 2)
        return out


def _index(space: Space):
    """Rows of a partition as blocks of ids, vectors and distances to the pivots, in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATE_BLOCK):
                part = batch.slice(at, CANDIDATE_BLOCK)
                ids, vecs = part.column("vec_id").to_numpy().astype(np.int64), matrix(part.column("v"), space.width)
                cells = (ids, vecs.astype(space.kind), space.distances(vecs, space.extra(vecs)))
                yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in cells], names=["ids", "vecs", "distances"])

    return run


class Search:
    """The best k of the candidates seen so far, for some queries."""

    def __init__(self, space: Space, ids: np.ndarray, vecs: np.ndarray, k: int):
        self.space, self.ids, self.k = space, ids, k
        self.vecs = vecs.astype(float if space.exact else np.int64)
        self.norms = (vecs.astype(float) ** 2).sum(1)
        self.distances = space.distances(vecs, np.zeros(len(vecs)))
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)
        self.evaluated = 0

    def scores(self, vecs: np.ndarray, i: int) -> np.ndarray:
        if self.space.exact:
            return (vecs @ self.vecs[i]).astype(np.int64)
        about = vecs.astype(float) @ self.vecs[i].astype(float)
        with np.errstate(over="ignore"):  # sums that wrap are right again at the end, if that fits
            whole = vecs @ self.vecs[i]
        return np.where(about >= 2.0**63, np.iinfo(np.int64).max, np.where(about < -(2.0**63), np.iinfo(np.int64).min, whole))

    def add(self, ids: np.ndarray, vecs: np.ndarray, distances: np.ndarray) -> None:
        """A block of candidates; distances: a row a pivot."""
        vecs = vecs.astype(float if self.space.exact else np.int64)
        for i in range(len(self.ids)):
            bound = np.zeros(len(ids))
            for row, mine in zip(distances, self.distances[:, i]):
                np.maximum(bound, np.abs(row - mine), out=bound)
            todo = np.flatnonzero(ids != self.ids[i])
            step = max(4 * self.k, 64)
            while len(todo):
                scores, found = self.best[i]
                if len(scores) == self.k:
                    reach = np.sqrt(max(0.0, self.space.top + self.norms[i] - 2 * float(scores[-1])))
                    todo = todo[bound[todo] <= reach * (1 + SLACK) + SLACK * np.sqrt(self.space.top + 1.0)]
                if len(todo) > step:  # the nearest by their bounds come first
                    order = np.argpartition(bound[todo], step)
                    part, todo = todo[order[:step]], todo[order[step:]]
                else:
                    part, todo = todo, todo[:0]
                step *= 8
                self.evaluated += len(part)
                new = self.scores(vecs[part] if len(part) < len(vecs) else vecs, i)
                if len(scores) == self.k:
                    good = new >= scores[-1]
                    new, part = new[good], part[good]
                    if not len(part):
                        continue
                scores, found = np.concatenate([scores, new]), np.concatenate([found, ids[part]])
                keep = np.lexsort((found, ~scores))[: self.k]
                self.best[i] = scores[keep], found[keep]


def _search(space: Space, queries, k: int):
    """queries: a broadcast of (ids, vectors) of a pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for batch in batches:
            for ids, vecs, distances in zip(*(batch.column(c).to_pylist() for c in ("ids", "vecs", "distances"))):
                if search is None:
                    q_ids, q_vecs = queries.value
                    search = Search(space, np.frombuffer(q_ids, np.int64), np.frombuffer(q_vecs, space.kind).reshape(-1, space.width), k)
                own = np.frombuffer(ids, np.int64)
                search.add(own, np.frombuffer(vecs, space.kind).reshape(-1, space.width), np.frombuffer(distances).reshape(-1, len(own)))
        if search is not None and len(search.ids):
            n = [len(x[0]) for x in search.best]
            yield pa.record_batch([pa.array(np.repeat(search.ids, n)), pa.array(np.concatenate([x[1] for x in search.best])), pa.array(np.concatenate([x[0] for x in search.best]))], names=["query_id", "vec_id", "score"])

    return run


def _passes(blocks: DataFrame, space: Space) -> Iterator[tuple[bytes, bytes]]:
    """Queries of QUERY_BYTES at a time; the driver holds one pass."""
    each = np.dtype(space.kind).itemsize * space.width
    most = max(1, QUERY_BYTES // (each + 8))
    ids, vecs = b"", b""
    for row in blocks.toLocalIterator():
        ids, vecs = ids + bytes(row.ids), vecs + bytes(row.vecs)
        while len(ids) > 8 * most:
            yield ids[: 8 * most], vecs[: each * most]
            ids, vecs = ids[8 * most :], vecs[each * most :]
    if ids:
        yield ids, vecs


def top_k(table: DataFrame, every: int = 100, k: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by `every`."""
    spark = table.sparkSession
    vectors = integer_vectors(table)
    norm = F.expr("aggregate(v, 0D, (a, x) -> a + cast(x as double) * x)")
    largest = F.expr("greatest(abs(array_max(v) + 0D), abs(array_min(v) + 0D))")
    width, top, most = vectors.agg(F.max(F.size("v")), F.max(norm), F.max(largest)).first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "v").limit(pivots).collect()  # a fixed number of rows
    pivot = np.zeros((len(chosen), max(width, 1)))
    for row, x in zip(pivot, chosen):
        row[: len(x.v)] = x.v
    space = Space(max(width, 1), float(top), int(most or 0), pivot)
    index = shared.staged(vectors.mapInArrow(_index(space), "ids binary, vecs binary, distances binary"), "index")
    # of rows that repeat an id the smallest vector asks
    queries = vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = shared.staged(queries.mapInArrow(_index(space), "ids binary, vecs binary, distances binary").drop("distances"), "queries")
    index = index.coalesce(max(shared.partitions(spark), 1))
    done, last = [], None
    for ids, vecs in _passes(blocks, space):
        if last is not None:  # more than one pass: each is written before the next, so one broadcast is held
            done.append(shared.staged(last, "found"))
        last = _best(index.mapInArrow(_search(space, spark.sparkContext.broadcast((ids, vecs)), k), _FOUND), k)
    done.append(last if last is not None else _best(spark.createDataFrame([], _FOUND), k))
    return reduce(DataFrame.unionByName, done).select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
