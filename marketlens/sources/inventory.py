"""What a dataset holds: its tables, their rows, and the quality of columns."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.sources.tables import TABLES, read_table

ENTRY = "schema string, name string, row_count bigint"


def table_inventory(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES, schema: str = "public") -> DataFrame:
    """schema, name, row_count of each table; counts come from the files' footers."""
    counted = (read_table(spark, folder, n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(schema).alias("schema"), F.lit(n).alias("name"), "row_count") for n in names)
    return reduce(DataFrame.unionByName, counted)


def inspection_report(tables: DataFrame, database: str, connection_url: str) -> DataFrame:
    """One row: database, connection_url, table_count, tables. An `ord` column keeps the entries in order, else they are sorted."""
    entry = [F.col(c) for c in ("schema", "name", "row_count")]
    if "ord" in tables.columns:
        entry.insert(0, F.col("ord"))
    listed = F.array_sort(F.collect_list(F.struct(*entry)))
    bare = F.transform(listed, lambda x: F.struct(*[x[c].alias(c) for c in ("schema", "name", "row_count")]))
    report = tables.agg(F.count(F.lit(1)).alias("table_count"), bare.alias("tables"))
    return report.select(F.lit(database).alias("database"), F.lit(connection_url).alias("connection_url"), "table_count", "tables")


def build_inspection_report(database: str, table_rows: list[tuple[str, str, int]], connection_url: str) -> dict[str, Any]:
    """The same report of rows in memory: every entry counts, in the order given."""
    tables = [dict(zip(("schema", "name", "row_count"), row, strict=True)) for row in table_rows]
    return dict(database=database, connection_url=connection_url, table_count=len(tables), tables=tables)


def column_quality(df: DataFrame, name: str) -> DataFrame:
    """name, column, n_null, n_distinct, min_number, max_number (of numbers, and times in microseconds), min_text, max_text of every column, in one pass over the table."""
    wanted, entries = [], []
    for i, field in enumerate(df.schema):
        c, kind = F.col(f"`{field.name}`"), field.dataType
        # of texts, hashes are counted: the texts themselves needn't travel
        key = F.when(c.isNotNull(), F.struct(F.xxhash64(c), F.hash(c), F.octet_length(c))) if isinstance(kind, T.StringType) else c
        number = c.cast("double") if isinstance(kind, T.NumericType) else F.unix_micros(c.cast("timestamp")).cast("double") if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.lit(None).cast("double")
        text = c if isinstance(kind, T.StringType) else F.lit(None).cast("string")
        wanted += [F.sum(c.isNull().cast("bigint")).alias(f"n_{i}"), F.countDistinct(key).alias(f"d_{i}")]
        wanted += [f(x).alias(f"{f.__name__}_{kind}_{i}") for kind, x in (("number", number), ("text", text)) for f in (F.min, F.max)]
        cell = [F.lit(field.name).alias("column"), F.coalesce(F.col(f"n_{i}"), F.lit(0).cast("bigint")).alias("n_null"), F.col(f"d_{i}").alias("n_distinct")]
        entries.append(F.struct(*cell, *[F.col(f"{f}_{kind}_{i}").alias(f"{f}_{kind}") for kind in ("number", "text") for f in ("min", "max")]))
    return df.agg(*wanted).select(F.lit(name).alias("name"), F.inline(F.array(*entries)))


def quality(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> DataFrame:
    """The columns of all tables."""
    return reduce(DataFrame.unionByName, (column_quality(read_table(spark, folder, n), n) for n in names))
