"""Tables in folders of Parquet, and in databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jdbc(spark: SparkSession, table: str, options: dict[str, str], split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A database table. split: (numeric column, lowest, highest, parts) reads it in parallel, a range each."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if split:
        column, low, high, parts = split
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """An export artifact, in a folder for each value of `by`."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def table_exists(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether a table's file or folder is there, in any file system of Spark's."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def load_tables(spark: SparkSession, folder: str, target: str, names: tuple[str, ...] = TABLES) -> str:
    """Copies the tables of a folder to another, which then reads like the first; all must be there."""
    require_tables(spark, folder, names)
    for name in names:
        write_parquet(read_table(spark, folder, name), f"{target}/{name}.parquet")
    return f"Tables loaded: {target}"


def require_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> str:
    """A line that says the tables are there; FileNotFoundError names the first that is not."""
    for name in names:
        if not table_exists(spark, folder, name):
            raise FileNotFoundError(f"Expected table at {folder}/{name}.parquet")
    return f"Tables ready: {folder}"
