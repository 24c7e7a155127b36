"""Column expressions that several stages use."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def cents(price: str) -> Column:
    """A price in whole cents: rounded first, as a cast alone truncates."""
    return F.round(F.col(price) * 100).cast("bigint")


def price_bin(price: str, size: float = 5.0) -> Column:
    return F.floor(F.col(price) / size)


def by_symbol() -> WindowSpec:
    """Sessions of a symbol in order."""
    return Window.partitionBy("symbol").orderBy("session")
