"""python -m marketlens inspect FOLDER | restore FOLDER [TARGET] | profiles FOLDER OUT | features FOLDER OUT"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from marketlens import config
from marketlens.plans import catalog
from marketlens.sources import inventory, tables


def inspect(spark: SparkSession, folder: str) -> list[str]:
    """Facts of a dataset, of the tables that it has; the password is not printed."""
    database, url = config.settings()["POSTGRES_DB"], config.get_connection_url()
    there = tuple(n for n in tables.TABLES if tables.table_exists(spark, folder, n))
    found = inventory.table_inventory(spark, folder, there) if there else spark.createDataFrame([], inventory.ENTRY)
    report = inventory.inspection_report(found, database, config.redacted(url)).first()
    rows = [f"  {t.schema}.{t.name}: {t.row_count} rows" for t in report.tables]
    facts = ["Dataset inspection", f"Database: {report.database}", f"Connection URL: {report.connection_url}", f"Folder: {folder}", f"Table count: {report.table_count}"]
    missing = [n for n in tables.TABLES if n not in there]
    return [*facts, f"Expected tables exist: {not missing}", *([f"Missing: {', '.join(missing)}"] if missing else []), *rows]


def main(args: list[str]) -> None:
    command, *rest = args or [""]
    if (command, len(rest)) not in {("inspect", 1), ("restore", 1), ("restore", 2), ("profiles", 2), ("features", 2)}:
        sys.exit(__doc__)
    spark = SparkSession.builder.getOrCreate()
    if command == "inspect":
        print("\n".join(inspect(spark, *rest)))
    elif command == "restore":
        print(tables.load_tables(spark, *rest) if len(rest) == 2 else tables.require_tables(spark, *rest))
    else:
        print("\n".join(catalog.build(spark, *rest, command)))


if __name__ == "__main__":
    main(sys.argv[1:])
