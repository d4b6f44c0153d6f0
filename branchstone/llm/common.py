"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

HOT_ROWS = 1 << 10  # a group of more rows is not joined in one task
RUN_ROWS = 1 << 12  # rows that are put in order in one task at a time
MOST_HOT = 1 << 20  # hot groups that are broadcast at most: beyond that the bounds above rise
MOST_RUNS = 1 << 14  # likewise


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; the first branch is the fast way for texts of ASCII alone."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a session on one machine (local mode, as in tests)
    gets a temporary one; on a cluster no folder of one machine would do, so it is an error."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder: intermediate tables need one that all executors share")
    made = tempfile.mkdtemp(prefix="branchstone-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_scopes: list[list[str]] = []


def _path(spark: SparkSession, name: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that were written inside when it ends: for callers that have stored their result by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for name in _scopes.pop():
            at, fs = _path(spark, name)
            fs.delete(at, True)


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it survives lost executors and cuts the lineage.

    The folder is removed when the scratch() around it ends, or else, as with `stays`, with the driver's JVM."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at, fs = _path(spark, path)
    fs.deleteOnExit(at)
    if _scopes and not stays:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_limit(total: int) -> int:
    return max(HOT_ROWS, total // MOST_HOT)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups (one row a key, `size` = rows of that key) without a hot task.

    Groups of more than HOT_ROWS rows are few, MOST_HOT at most whatever the total, so they are broadcast and their rows
    stay where they are; all others meet in a shuffle join, where no key has more than HOT_ROWS rows."""
    limit = hot_limit(total)
    if total <= limit:
        return rows.join(groups, key, how)
    hot = groups.where(F.col(size) > limit)
    others = groups.where(F.col(size) <= limit)
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("__hot"))), key, "left")
    at_hot = rows.join(F.broadcast(hot), key)
    rest = marked.where("__hot is null").drop("__hot").join(others, key, how)
    return at_hot.unionByName(rest)


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, into: str, most: int | None = None) -> DataFrame:
    """rows (a written table) with `into`: the sum of `amount` over the rows of the same keys before each, in order of `order`.

    No key has a null. Keys of up to `most` rows (default: RUN_ROWS) are windows of their own. Rows of larger ones are
    sorted as a whole and cut into runs of about `most`, MOST_RUNS in all; a run's sum is carried to those after it, so no
    task has all rows of a key. `order` must tell rows apart, or runs of equal rows stay together."""
    most = most or max(RUN_ROWS, rows.count() // MOST_HOT)
    before = Window.unboundedPreceding
    sized = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    hot = [r["__n"] for r in sized.select("__n").limit(1).collect()]
    plain = Window.partitionBy(*keys).orderBy(*order).rowsBetween(before, -1)
    if not hot:
        return rows.withColumn(into, F.coalesce(F.sum(amount).over(plain), F.lit(0)))
    large = written(sized, "large-keys")
    count = large.agg(F.sum("__n")).first()[0]
    large = large.drop("__n")
    runs = rows.join(F.broadcast(large), list(keys)).repartitionByRange(min(-(-count // most), MOST_RUNS), *keys, *order).withColumn("__run", F.spark_partition_id())
    runs = written(runs, "runs")
    # one row for each run and key; keys that share a run make few more rows than there are runs
    sums = runs.groupBy(*keys, "__run").agg(F.sum(amount).alias("__sum"))
    offsets = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__run").rowsBetween(before, -1)), F.lit(0)))
    inner = Window.partitionBy(*keys, "__run").orderBy(*order).rowsBetween(before, -1)
    runs = runs.withColumn(into, F.coalesce(F.sum(amount).over(inner), F.lit(0))).join(F.broadcast(offsets.drop("__sum")), [*keys, "__run"])
    runs = runs.withColumn(into, F.col(into) + F.col("__before")).drop("__run", "__before")
    rest = rows.join(F.broadcast(large), list(keys), "left_anti")
    return runs.unionByName(rest.withColumn(into, F.coalesce(F.sum(amount).over(plain), F.lit(0))))


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df without columns of these names in any case: an operator's own columns replace them."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])
