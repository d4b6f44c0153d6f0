"""The corpus pipeline: STAGES, run and ORACLE_SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchstone.llm.bpe import bpe_encode
from branchstone.llm.common import scratch, written
from branchstone.llm.exact_dedup import drop_ids, exact_dedup
from branchstone.llm.mixing import mix, word_count
from branchstone.llm.quality_rules import quality_rules
from branchstone.llm.queries import vocabulary_path
from branchstone.llm.simhash import simhash_components


def _like(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[f"`{c}`" for c in docs.columns])


def _all(wanted: str, verdicts: DataFrame) -> DataFrame:
    """The ids of which no row is as wanted."""
    return verdicts.groupBy("doc_id").agg(F.max(F.expr(wanted)).alias("ok")).where("not ok").select("doc_id")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    An id goes only if all rows with it are rejected: where ids repeat, rejected texts stay beside one that passes. All
    null ids are one."""
    return drop_ids(docs, "doc_id", _all("kept", quality_rules(docs).select("doc_id", "kept")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts that with the largest id stays. Columns with the operator's names stay the documents'."""
    rows = docs.select("doc_id", "text", F.struct(*[f"`{c}`" for c in docs.columns]).alias("__row"))
    return exact_dedup(rows, carry=["__row"]).where("kept").select("__row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates that with the smallest id stays.

    An id goes only if no row with it is the smallest of its component: where ids repeat, near copies can stay. All null
    ids are one."""
    return drop_ids(docs, "doc_id", _all("component_id <=> doc_id", simhash_components(docs)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole time: 0 to 3.

    The mix takes a source's words in one order, so at most one document of a source is taken in part. Rows that share
    an id, or have none, are told apart by source and number of words; those equal in these each come as often as they
    are taken on average."""
    sums = mix(docs).groupBy("doc_id", "source", "size").agg(F.rint(F.sum("taken") / F.greatest(F.first("size") * F.count("*"), F.lit(1))).cast("int").alias("__times"))
    times = sums.where("__times > 0").toDF("__id", "__source", "__size", "__times")
    same = docs["doc_id"].eqNullSafe(times["__id"]) & docs["source"].cast("string").eqNullSafe(times["__source"])
    taken = docs.join(times, same & (word_count(docs["text"]) == times["__size"]))
    return _like(taken.withColumn("__time", F.explode(F.array_repeat(F.lit(0), F.col("__times")))), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, as counts and digests."""
    return bpe_encode(docs, vocabulary_path("byte_bpe_50k.json"), carry=["doc_id"], digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mixed),
    ("bpe encoding", encoded),
]

#: Fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES one after the other over documents; each result but the last is written and read again, and what a stage
    has written on its way to it is removed then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), stays=True)
    return STAGES[-1][1](spark, docs, sf_dir)
