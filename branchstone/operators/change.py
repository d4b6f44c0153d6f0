"""Differences between versions, and the sinks that make one version of another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .merge import aligned


def feature_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, change, old, new) for each row that was added, removed or changed."""
    rows = aligned({"old": old, "new": new}, key, fields).where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return rows.select(key, change.alias("change"), "old", "new")


def changed_rows(current: DataFrame, target: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows of target that current lacks or has otherwise: what a sink must write."""
    then = current.select(key, F.struct(*fields).alias("__then"))
    rows = target.join(then, key, "left")
    return rows.where(~F.struct(*fields).eqNullSafe(F.col("__then"))).select(key, *fields)


def removed_rows(current: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows of current whose key target lacks: what a sink must delete."""
    return current.join(target.select(key), key, "left_anti")


def upsert(current: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """current with the batch's rows in place of its own of the same key, and the batch's new rows."""
    return delete(current, batch, key).unionByName(batch)


def delete(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return current.join(keys.select(key), key, "left_anti")


def replace(current: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The batch alone; columns come in current's order."""
    return batch.select(*current.columns)


def latest(deltas: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the one with the largest order."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    return deltas.withColumn("__last", F.row_number().over(last)).where("__last = 1").drop("__last")
