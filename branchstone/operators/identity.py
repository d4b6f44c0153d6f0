"""Stable integer identities of features: looked up first, allocated in input order, never used again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LARGEST = (1 << 63) - 1
RUN = 4096


def lookup(batch: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """batch with object_id, null where the registry (key, object_id) has none."""
    return batch.join(registry.select(key, "object_id"), key, "left")


def allocate(batch: DataFrame, registry: DataFrame, key: str, position: str, after: int) -> DataFrame:
    """(key, object_id) of the batch's keys that the registry lacks: after + 1 and on, by position, a whole number.

    Positions are numbered in runs of RUN, the runs' counts added up in runs of runs, and only theirs in one place: a
    batch of n rows spread over its positions passes n / RUN**2 rows through one task."""
    new = batch.join(registry.select(key), key, "left_anti").select(key, position)
    rows = new.withColumn("__run", F.floor(F.col(position) / RUN))
    counts = rows.groupBy("__run").agg(F.count("*").alias("__n")).withColumn("__outer", F.floor(F.col("__run") / RUN))
    running = lambda window: F.coalesce(F.sum("__n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outer = counts.groupBy("__outer").agg(F.sum("__n").alias("__n")).select("__outer", running(Window.orderBy("__outer")).alias("__base"))
    counts = counts.withColumn("__inner", running(Window.partitionBy("__outer").orderBy("__run"))).join(outer, "__outer")
    within = F.row_number().over(Window.partitionBy("__run").orderBy(position))
    rows = rows.withColumn("__within", within).join(counts.select("__run", (F.col("__inner") + F.col("__base")).alias("__before")), "__run")
    return rows.select(key, (F.lit(after) + F.col("__before") + F.col("__within")).alias("object_id"))


def as_text(column: str) -> Column:
    """Identities as other systems get them: decimal texts."""
    return F.col(column).cast("string")


def as_int32(column: str) -> Column:
    """Identities that fit into 32 bits, null for others; never a cut-off one."""
    return F.when(F.col(column).between(1, (1 << 31) - 1), F.col(column).cast("int"))


def object_id_int32(value: int) -> int:
    """The identity for consumers of 32 bits; never a cut-off one."""
    if type(value) is not int or not 0 < value < 1 << 31:
        raise ValueError("OBJECT_ID_COMPATIBILITY_OVERFLOW")
    return value
