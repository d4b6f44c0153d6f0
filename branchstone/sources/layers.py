"""Versions of a dataset as layers: base segments of Parquet folders, and changes on top of them that are merged when read.

A batch of changes costs what it holds, not what the table holds, and so does a bulk load: it becomes a segment of its
own, and the keys of older segments that it replaces become changes. Changes are bounded by compaction, so the keys that
they hide in the base can be broadcast. A change hides a key in the segments that are older than it."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.change import latest
from .log import Store

KEPT = 32  # layers that are kept apart at most
MOST_CHANGED = 320_000  # keys in the layers over a base: a broadcast of 36 bytes each


def empty() -> dict:
    return {"base": [], "layers": [], "changed": 0}


def delta_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("__seq", T.LongType()), T.StructField("__gone", T.BooleanType()), *schema.fields])


def based(store: Store, manifest: dict, schema: T.StructType) -> list[tuple[int, DataFrame]]:
    """The base by age: (sequence, rows)."""
    ages = sorted({b["seq"] for b in manifest["base"]})
    return [(s, store.read([b["path"] for b in manifest["base"] if b["seq"] == s], schema)) for s in ages]


def read(store: Store, manifest: dict, schema: T.StructType) -> DataFrame:
    if not manifest["layers"]:
        return store.read([b["path"] for b in manifest["base"]], schema)
    deltas = latest(store.read(manifest["layers"], delta_schema(schema)), "fid", "__seq")
    segments = based(store, manifest, schema) or [(0, store.read([], schema))]
    if len(segments) == 1:  # every change is younger
        kept = segments[0][1].join(F.broadcast(deltas.select("fid")), "fid", "left_anti")
    else:
        base = reduce(DataFrame.unionByName, [rows.withColumn("__age", F.lit(s).cast("long")) for s, rows in segments])
        hidden = deltas.select(F.col("fid").alias("__fid"), "__seq")
        kept = base.join(F.broadcast(hidden), (F.col("fid") == F.col("__fid")) & (F.col("__seq") > F.col("__age")), "left_anti")
    return kept.select(*schema.names).unionByName(deltas.where("not __gone").select(*schema.names))


def layer_table(schema: T.StructType, rows: pa.Table, gone: list[str], seq: int) -> pa.Table:
    """Rows and keys that are gone as one layer."""
    kind = to_arrow_schema(delta_schema(schema))
    both = pa.concat_tables([rows.select(schema.names), pa.table({"fid": pa.array(gone, pa.string())})], promote_options="default")
    count = len(both)
    columns = {"__seq": pa.array([seq] * count, pa.int64()), "__gone": pa.array([False] * len(rows) + [True] * len(gone), pa.bool_())}
    return pa.table([columns[f.name] if f.name in columns else both[f.name].cast(f.type) for f in kind], schema=kind)


def with_changes(store: Store, manifest: dict, schema: T.StructType, rows: pa.Table, gone: list[str], seq: int) -> dict:
    """manifest with a layer of rows (full rows, in hand) and of keys that are gone; compacted when there are many.

    Layers are merged among themselves when more than KEPT; the base is written anew when they have changed so many of
    its keys that they can no longer be broadcast."""
    if not manifest["base"] and not manifest["layers"]:
        return segment(manifest, store.write_few(rows.select(schema.names).sort_by("fid")), seq) if len(rows) else manifest
    layers = [*manifest["layers"], store.write_few(layer_table(schema, rows, gone, seq))]
    out = {"base": manifest["base"], "layers": layers, "changed": manifest["changed"] + len(rows) + len(gone)}
    return compacted(store, out, schema, seq)


def compacted(store: Store, manifest: dict, schema: T.StructType, seq: int) -> dict:
    if manifest["changed"] > MOST_CHANGED:
        return whole(store, read(store, manifest, schema), seq)
    if len(manifest["layers"]) <= KEPT:
        return manifest
    merged = latest(store.read(manifest["layers"], delta_schema(schema)), "fid", "__seq")
    return manifest | {"layers": [store.write(merged.coalesce(1))]}


def segment(manifest: dict, path: str, seq: int) -> dict:
    return manifest | {"base": [*manifest["base"], {"path": path, "seq": seq}]}


def with_rows(store: Store, manifest: dict, schema: T.StructType, rows: DataFrame, replaced: DataFrame, count: int, seq: int) -> dict:
    """manifest with rows of any number as a segment of its own; `replaced` (fid) are the `count` keys of them that it
    has already. What is there stays where it is, unless more keys are replaced than can be broadcast."""
    if manifest["changed"] + count > MOST_CHANGED:
        old = read(store, manifest, schema).join(replaced.select("fid"), "fid", "left_anti")
        return whole(store, old.unionByName(rows.select(*schema.names)), seq)
    out = segment(manifest, ordered(store, rows.select(*schema.names)), seq)
    if count:
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != "fid"]
        keys = replaced.select(F.lit(seq).cast("long").alias("__seq"), F.lit(True).alias("__gone"), "fid", *nothing)
        out |= {"layers": [*out["layers"], store.write(keys)], "changed": out["changed"] + count}
        out = compacted(store, out, schema, seq)
    return out


def ordered(store: Store, rows: DataFrame) -> str:
    """Rows in ranges of the key: a lookup of a few keys reads the row groups whose statistics let them in, not the table."""
    return store.write(rows.repartitionByRange("fid").sortWithinPartitions("fid"))


def whole(store: Store, rows: DataFrame, seq: int) -> dict:
    """A manifest of rows as a base of their own."""
    return segment(empty(), ordered(store, rows), seq)
