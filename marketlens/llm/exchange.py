"""Documents in groups that several steps visit, and hashes that travel from groups to judges and back.

Documents are dealt once, by a hash of doc_id, into small groups. A step reads a
group, sends each judge (a range of hashes) the group's distinct hashes of that
range as one sorted, difference-coded blob, and a judge answers each blob with
bits in its order; the group, read again, sorts its hashes the same way and so
finds the answers. A hash that all documents share travels once a group, so
no judge gets more than a row of it from each group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm import shared
from marketlens.llm.textops import unpack_sorted

GROUP_BYTES = 2 << 20
#: Text whose hashes one judge gets: a judge holds its share in memory, so their number grows with the data.
JUDGE_BYTES = 64 << 20


def number_of_groups(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> int:
    return max(2 * shared.partitions(docs.sparkSession), math.ceil(shared.text_bytes(docs) / group_bytes))


def number_of_judges(partitions: int, groups: int, group_bytes: int = GROUP_BYTES) -> int:
    return max(partitions, groups * group_bytes // JUDGE_BYTES)


def group_of(doc_id: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), F.col(doc_id)), F.lit(groups)).cast("int")


def grouped_documents(docs: DataFrame, groups: int | None = None) -> tuple[DataFrame, int]:
    """(doc_id, text, p), partitioned by the group p, and the number of judges; null texts are empty. groups: their number, if it is known."""
    n = shared.partitions(docs.sparkSession)
    groups = groups or number_of_groups(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("p", group_of("doc_id", groups)).repartition(n, "p"), number_of_judges(n, groups)


def in_order(group: pa.Table) -> pa.Table:
    """A group's rows by doc_id, those without one first; rows that repeat an id by their text."""
    order = pc.sort_indices(group, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
    return group.take(order).combine_chunks()


def doc_ids(group: pa.Table) -> np.ndarray:
    """Ids as numbers that sort as in_order does."""
    return column(group, "doc_id").fill_null(-(1 << 63)).to_numpy()


def column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def judge_cuts(sorted_hashes: np.ndarray, judges: int) -> np.ndarray:
    """Where each judge's range begins and ends in sorted 64-bit hashes."""
    edges = np.array([(k << 64) // judges for k in range(1, judges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def visit(docs: DataFrame, step: Callable[[pa.Table, dict], Iterator[pa.RecordBatch]], schema: str, answers: DataFrame | None = None) -> DataFrame:
    """step(group in order, {(kind, judge): answer}) for each group; answers: (p int, kind int, judge int, bits binary)."""
    if answers is None:

        def alone(key: tuple, group: pa.Table) -> pa.Table:
            return _table(step(in_order(group), {}), schema_of)

        schema_of = _arrow(schema)
        return docs.groupBy("p").applyInArrow(alone, schema)

    def both(key: tuple, group: pa.Table, got: pa.Table) -> pa.Table:
        replies = {(k, j): b for k, j, b in zip(*(got.column(c).to_pylist() for c in ("kind", "judge", "bits")))}
        if not group.num_rows:
            return schema_of.empty_table()
        return _table(step(in_order(group), replies), schema_of)

    schema_of = _arrow(schema)
    return docs.groupBy("p").cogroup(answers.groupBy("p")).applyInArrow(both, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(x.split(" ", 1)[0], kinds[x.split(" ", 1)[1]]) for x in schema.split(", ")])


def _table(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([b.cast(schema) if b.schema != schema else b for b in batches], schema)


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = _arrow(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(len(kinds))], schema=kinds)


ANSWERS = "p int, kind int, judge int, bits binary"
ANSWER_SCHEMA = _arrow(ANSWERS)


def answer_table(p: list[int], kind: int, judge: int, bits: list[bytes]) -> pa.Table:
    n = len(p)
    return pa.table([pa.array(p, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([judge] * n, pa.int32()), pa.array(bits, pa.binary())], schema=ANSWER_SCHEMA)


#: Distinct hashes of a group, and which of them it has more than once.
HASHES = "judge int, p int, hashes binary, repeated binary"


def judge_repeats(key: tuple, got: pa.Table) -> pa.Table:
    """Which of each group's hashes occur twice, in the group or in others; no answer where none does."""
    p = got.column("p").to_pylist()
    parts = [unpack_sorted(x) for x in got.column("hashes").to_pylist()]
    every, which = np.unique(np.concatenate(parts), return_inverse=True)
    twice = np.concatenate([flags(b, len(x)) for b, x in zip(got.column("repeated").to_pylist(), parts)])
    repeated = (np.bincount(which, 1 + twice, len(every)) > 1)[which]
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    found = [(q, np.packbits(repeated[a:b]).tobytes()) for q, a, b in zip(p, at, at[1:]) if repeated[a:b].any()]
    return answer_table([q for q, _ in found], 0, key[0].as_py(), [b for _, b in found])


def flags(bits: bytes | None, n: int) -> np.ndarray:
    """n flags of an answer; no answer means none set."""
    if not bits:
        return np.zeros(n, bool)
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def all_flags(replies: dict, kind: int, cuts: np.ndarray, rows: int = 1) -> np.ndarray:
    """Answers of one kind for a group's sorted hashes: `rows` flags of each, a judge's one after another."""
    sizes = np.diff(cuts)
    parts = [flags(replies.get((kind, j)), rows * int(n)).reshape(rows, -1) for j, n in enumerate(sizes) if n]
    return np.concatenate(parts, axis=1) if parts else np.zeros((rows, 0), bool)
