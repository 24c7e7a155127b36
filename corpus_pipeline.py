"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next stage's docs. All but the last return the columns of
documents; n_chars is that of the text as it is then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import decontam, line_dedup, minhash, packing, queries, shared, toxicity

#: SQL can express neither the trained scores nor the packing; the tests hold each stage against a brute-force version.
ORACLE_SQL = None
#: Percent of shingles that near-duplicates share here; op8_minhash alone has its own.
SIMILAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under one half; the model learns from the labelled rows of docs.

    All stay if it learned of no word (no labels, or of one class only). A null or empty text has the score of the
    bias alone and stays unless that says toxic; long texts are read whole; each row is judged by its own text, so
    rows that repeat an id, or have none, may part; an empty table gives none; columns of any other name come along.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model[0].any():
        return docs
    return toxicity.score(docs, model).filter("predicted = 0").select(*[f"`{c}`" for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that come earlier; those that lose all their lines go. n_chars follows the text.

    Null texts, texts without words and rows without an id stay as they are; of tied lines the first by id and place
    stays; rows that repeat an id and differ in text are documents of their own, and of rows that repeat both each keeps
    the lines that the first keeps; an empty table gives none; columns of any other name come along.
    """
    mark = max((len(c) for c in docs.columns), default=0) * "_"  # longer than any name of docs
    lines, gone = f"{mark}lines", f"{mark}gone"
    out = line_dedup.remove_lines(docs, counts=(lines, gone)).filter(f"{gone} = 0 or {gone} < {lines}")
    return out.withColumn("n_chars", F.when(F.col(gone) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (a similarity of SIMILAR percent or more): the one with the smallest id.

    Null texts, texts without words and rows without an id are in no group and stay; each row is judged by its own
    text, so of rows that repeat an id one may go and another stay; of rows that repeat id and text one stays; an empty table
    gives none; columns of any other name come along.
    """
    seen = minhash.judged(docs, percent=SIMILAR)
    gone = seen.filter("not kept").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    left = docs.join(gone, (docs["doc_id"].cast("long") == gone["_gone"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == gone["_hash"]), "left_anti")
    again = seen.filter("doc_id is not null and n_shingles > 0").groupBy("doc_id", "text_hash").count().filter("count > 1")
    if again.isEmpty():
        return left
    again = again.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = (left["doc_id"].cast("long") == again["_id"]) & (F.xxhash64(F.coalesce(left["text"].cast("string"), F.lit(""))) == again["_hash"])
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item.

    Null and empty texts overlap nothing; long texts are read whole; each row is judged by its own text, whatever its
    id, and rows without one too; items without an id or of under five words count for nothing; an empty table or benchmark takes
    nothing away; columns of any other name come along.
    """
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as op9_packing returns them: every row is packed, a null or empty text as its end id, rows that repeat an id or have none each for itself; an empty table gives no pieces."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
