"""Set checks of a final state: each returns the rows that violate it, so an empty result means that it holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columns, n) of values that more than one row has; nulls are never equal. Sums before it shuffles."""
    filled = df.where(" and ".join(f"`{c}` is not null" for c in columns))
    return filled.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose value no parent row has; null refers to nothing."""
    keys = parent.select(F.col(key).alias("__parent"))
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__parent"), "left_anti")


def referenced(parent: DataFrame, key: str, child: DataFrame, column: str) -> DataFrame:
    """Parent rows that a child row refers to: what `restrict` keeps from being deleted."""
    values = child.select(F.col(column).alias("__child"))
    return parent.join(values, F.col(key) == F.col("__child"), "left_semi")


def bounded_count(df: DataFrame, most: int) -> int:
    """The rows of df, counted no further than most + 1."""
    return df.limit(most + 1).count()
