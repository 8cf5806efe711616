"""Checks. Each gives the rows that fail, or raises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_same_count(a: DataFrame, b: DataFrame) -> None:
    x, y = a.count(), b.count()
    if x != y:
        raise ValueError(f"{x} rows and {y} rows")


def require_none(df: DataFrame, what: str) -> None:
    """Raises if df has a row."""
    row = df.limit(1).collect()
    if row:
        raise ValueError(f"{what}: {row[0]}")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def conflicting(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n): keys with several values (nulls don't count)."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def without_answer(df: DataFrame, column: str) -> DataFrame:
    """The rows without a box in a text."""
    from tokenledger.functions.text import boxed_first

    return df.where(boxed_first(F.col(column)).isNull())


def summary_of_columns(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns), one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
