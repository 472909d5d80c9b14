"""Rows and columns turned, dropped, sorted and drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def without_empty_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows in which some of the columns (all, unless told) is not null."""
    return df.na.drop("all", subset=columns)


def without_empty_columns(df: DataFrame) -> DataFrame:
    """``df`` without columns that are null in all rows: one aggregate of counts."""
    some = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if some[c]])


def wide(df: DataFrame, key: str, name: str, value: str, names: list[str] | None = None) -> DataFrame:
    """A column for each value of ``name``; a cell that several rows give has the least of them. The names are looked up unless given."""
    return df.groupBy(key).pivot(name, names).agg(F.min(value))


def long(df: DataFrame, key: str, columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """A row for each cell that is not null, as text."""
    return df.select(key, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(key, columns, name, value).where(F.col(value).isNotNull())


def transposed(df: DataFrame, key: str, columns: list[str], keys: list[str]) -> DataFrame:
    """(name, one column for each of ``keys``): rows and columns of a small table of numbers changed over."""
    numbers = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide(numbers.unpivot(key, columns, "name", "value"), "name", key, "value", keys)


def drawn(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows drawn by a seeded hash of their key: the same ones every time, without sorting all rows."""
    order = F.xxhash64(F.lit(seed), F.col(key))
    return df.orderBy(order, F.col(key)).limit(n)


def ordered(df: DataFrame, *columns: str) -> DataFrame:
    """Sorted by columns, nulls last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def numbered(df: DataFrame, *columns: str, name: str = "place", within: list[str] | None = None) -> DataFrame:
    """``df`` with the place of a row by columns, nulls last, within groups."""
    window = Window.partitionBy(*(within or [F.lit(1)])).orderBy(*[F.col(c).asc_nulls_last() for c in columns])
    return df.withColumn(name, F.row_number().over(window).cast("long"))


def split_counts(df: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    """Counts of rows by ``row`` and ``column``, with a total of each row and a row of totals called Total."""
    counts = df.rollup(row).agg(*[F.count(F.when(F.col(column) == x, 1)).alias(x) for x in columns], F.count("*").alias("total"), F.grouping_id().alias("_g"))
    return counts.withColumn(row, F.when(F.col("_g") == 1, "Total").otherwise(F.col(row))).drop("_g")
