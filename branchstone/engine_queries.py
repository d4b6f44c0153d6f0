"""The engine as queries: histories of batches, branches, plans and posts over the driver's tables, and the SQL of what they leave.

A history is made once a session and folder; its queries read what it has left at different points, through the
engine's own scans, so that they show the manifests, layers, identities and plans that the calls made."""

from __future__ import annotations

import itertools
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geometry import dump_points, in_box, ordinate
from .plans.branches import QUOTA, TRANSITIONS
from .plans.definition import fingerprint
from .plans.engine import MOST_ROWS
from .plans.reconcile import Workspace
from .sources.batch import read_batch
from .sources.log import EngineError
from .streaming.outbox import outbox

OWNER = str(uuid.UUID(int=1))
CUSTOMERS = {
    "schema_version": 1,
    "fields": [
        {"name": "name", "type": "string", "nullable": False, "max_length": 60},
        {"name": "value", "type": "decimal", "nullable": False, "precision": 14, "scale": 3},
        {"name": "seg", "type": "string", "nullable": True, "max_length": 20},
    ],
    "geometry": {"type": "Point", "srid": 4326, "dimensions": "XY", "nullable": False, "allow_empty": False, "require_valid": True},
}
PARTS = {
    "schema_version": 2,
    "fields": [
        {"name": "kind", "type": "string", "nullable": False, "max_length": 1, "default": "A"},
        {"name": "name", "type": "string", "nullable": False, "max_length": 80},
        {"name": "size", "type": "int32", "nullable": True, "default": 7, "domain": {"kind": "range", "min": 0, "max": 100}},
        {"name": "price", "type": "decimal", "nullable": True, "precision": 12, "scale": 2, "default": None},
    ],
    "geometry": None,
    "subtypes": {"field": "kind", "variants": [{"code": "A", "defaults": {"size": 10}, "domains": {}}, {"code": "B", "defaults": {}, "domains": {"size": {"kind": "range", "min": 0, "max": 60}}}, {"code": "C", "defaults": {"size": None, "price": "1.50"}, "domains": {}}]},
    "relationships": [],
    "rules": [{"name": "named", "kind": "required", "field": "name"}],
}


def scratch_root(spark: SparkSession) -> str:
    """A folder that executors share, of this history alone: under spark.checkpoint.dir, or, on one machine, a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        return tempfile.mkdtemp(prefix="branchstone-")
    root = f"{base.rstrip('/')}/workspace-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root


def fid_of(layer: str, key: Column) -> Column:
    digest = F.md5(F.concat(F.lit(layer), key.cast("string")))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def id_of(*parts: Any) -> str:
    return str(uuid.uuid5(uuid.UUID(int=0), "/".join(map(str, parts))))


def code_of(call: Callable, *args: Any, **named: Any) -> str:
    try:
        call(*args, **named)
        return "done"
    except EngineError as e:
        return e.code


HISTORIES: dict[tuple[str, str, str], Any] = {}


def history(kind: Callable, spark: SparkSession, sf_dir: str) -> Any:
    key = (kind.__name__, spark.sparkContext.applicationId, sf_dir)
    if key not in HISTORIES:
        HISTORIES[key] = kind(spark, sf_dir)
    return HISTORIES[key]


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema).coalesce(1)


# --- customers: a branch and DEFAULT go apart and come together again --------------------------------------------------

LAST = 80  # the branch changes customers up to this key, one by one
DROPPED = (4, 10, 46)  # customers that DEFAULT deletes and the branch leaves as they are


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    text = F.concat(F.lit("SRID=4326;POINT("), (k % 30000 / 1000).cast("string"), F.lit(" "), (k % 10000 / 1000).cast("string"), F.lit(")"))
    return c.select(k.alias("key"), fid_of("customer", k).alias("fid"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("decimal(14,3)").alias("value"), F.col("c_mktsegment").alias("seg"), text.alias("geometry"))


class Customers:
    """Loaded at once; a branch updates, deletes and inserts one by one while DEFAULT is loaded anew; then prepared,
    resolved, accepted and posted."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.engine = e = Workspace(spark, scratch_root(spark))
        d = e.create_dataset("customers", "item", "policy", CUSTOMERS, natural_key=["name"])
        self.did, self.group, self.default = d["dataset_id"], d["version_group_id"], d["default_version_id"]
        every, key = customers(spark, sf_dir), F.col("key")
        head = lambda v=self.default: e.store.state(self.group)["versions"][v]["head"]
        e.load(self.did, self.default, head(), every.where(key % 11 != 5).drop("key"))
        e.configure_branch_quotas(self.group, {k: high for k, (_, high) in QUOTA.items()})
        self.branch = id_of("branch")
        self.created = e.create_branch(self.group, self.branch, "work", OWNER, "private", [], id_of("operation"))
        self.base = self.created["base_snapshot_id"]
        self.usage = dict(e.store.state(self.group)["quota"])
        self.measured = e.store.state(self.group)["snapshots"][self.base]["datasets"][self.did]

        h = head(self.branch)
        for r in every.where(key <= LAST).orderBy(key).collect():
            row = {"values": {"name": r.name, "value": str(r.value), "seg": r.seg}, "geometry": r.geometry}
            if r.key % 11 == 5:
                if r.key % 2 == 0:
                    h = e.edit(self.branch, h, self.did, "insert", r.fid, row, OWNER)
            elif r.key % 13 == 0:
                h = e.edit(self.branch, h, self.did, "delete", r.fid, None, OWNER)
            elif r.key % 7 == 0:
                row["values"] |= {"name": f"{r.name}-o", "value": str(r.value + (r.key % 14 == 0))}
                h = e.edit(self.branch, h, self.did, "update", r.fid, row, OWNER)
        self.edited = e.capture(self.group, self.branch)
        name = F.when(key % 11 == 5, F.concat("name", F.lit("-t"))).when(key % 42 == 0, F.concat("name", F.lit("-d"))).otherwise(F.col("name"))
        moved = every.where("key % 3 = 0 or key % 22 = 5").select("fid", name.alias("name"), (F.col("value") + 2).cast("decimal(14,3)").alias("value"), F.when(key % 9 == 0, "X").otherwise(F.col("seg")).alias("seg"), "geometry")
        e.load(self.did, self.default, head(), moved)
        for r in every.where(key.isin(*DROPPED)).orderBy(key).collect():
            e.edit(self.default, head(), self.did, "delete", r.fid, None, OWNER)
        self.moved = e.capture(self.group, self.default)

        self.plan = e.prepare_reconcile(self.branch, OWNER)
        self.conflicts = e.plan_conflicts(self.group, self.plan, self.did)
        self.codes = {"accept with open conflicts": code_of(e.accept_reconcile, self.group, self.plan)}
        found = sorted((r.fid, r.outcome) for r in self.conflicts.select("fid", "outcome").collect())
        self.codes["resolve without a side"] = code_of(e.resolve_conflict, self.group, self.plan, self.did, found[0][0], None)
        for fid, outcome in found:  # as many as the branch has changes, at most
            sealed = e.resolve_conflict(self.group, self.plan, self.did, fid, "ours" if outcome == "field" else "theirs", OWNER)
        self.codes["sealed by the last"] = str(sealed)
        gone, written = e.changes_to_apply(self.group, self.plan, self.did)
        self.gone, self.written = gone.select("fid"), written.select("fid", "name", "value", "seg")
        p = e.plan(self.group, self.plan)
        self.codes["post before acceptance"] = code_of(e.post, self.group, self.plan, p["source_head"], p["target_head"], id_of("early"), OWNER)
        accepted = e.accept_reconcile(self.group, self.plan, OWNER)
        self.codes["accept again"] = code_of(e.accept_reconcile, self.group, self.plan)
        self.accepted = e.capture(self.group, self.branch)
        self.codes["post with another head"] = code_of(e.post, self.group, self.plan, p["source_head"], p["target_head"], id_of("late"), OWNER)
        posted = e.post(self.group, self.plan, accepted, p["target_head"], id_of("post"), OWNER)
        self.codes["post again"] = "the same head" if e.post(self.group, self.plan, accepted, p["target_head"], id_of("post"), OWNER) == posted else "another head"
        self.codes["post by another"] = code_of(e.post, self.group, self.plan, accepted, p["target_head"], id_of("post"), "somebody")
        self.codes["post what is posted"] = code_of(e.post, self.group, self.plan, accepted, p["target_head"], id_of("more"), OWNER)
        self.codes["accept what is posted"] = code_of(e.accept_reconcile, self.group, self.plan)
        self.codes["edit with an old head"] = code_of(e.edit, self.branch, self.created["head_revision"], self.did, "delete", id_of("x"))
        self.codes["edit of no kind"] = code_of(e.edit, self.branch, head(self.branch), self.did, None, id_of("x"))
        self.codes["delete what is not there"] = code_of(e.edit, self.branch, head(self.branch), self.did, "delete", id_of("x"))
        self.codes["prepare DEFAULT"] = code_of(e.prepare_reconcile, self.default)
        self.codes["capture an unknown version"] = code_of(e.capture, self.group, id_of("x"))
        self.codes["revise under a branch"] = code_of(e.revise_schema, e.export_schema(self.did), CUSTOMERS | {"schema_version": 2, "subtypes": None, "relationships": [], "rules": []})

    def plain(self, rows: DataFrame) -> DataFrame:
        return rows.select("fid", "name", "value", "seg", ordinate(F.col("geom"), "x").alias("x"), ordinate(F.col("geom"), "y").alias("y"))

    def snapshot(self, name: str) -> DataFrame:
        return self.plain(self.engine.read_snapshot(self.did, getattr(self, name)))


CUSTOMERS_SQL = f"""
    every as (
        select c_custkey as key, md5('customer' || c_custkey) as h, c_name as name, c_acctbal::decimal(14,3) as value, c_mktsegment as seg,
               c_custkey % 30000 / 1000 as x, c_custkey % 10000 / 1000 as y from customer),
    named as (select key, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) as fid, name, value, seg, x, y from every),
    base as (select * from named where key % 11 <> 5),
    touched as (select *, key <= {LAST} and (key % 11 = 5 or key % 13 = 0 or key % 7 = 0) as mine from named),
    ours as (
        select key, fid, case when mine and key % 11 <> 5 then name || '-o' else name end as name, case when mine and key % 11 <> 5 and key % 14 = 0 then (value + 1)::decimal(14,3) else value end as value, seg, x, y
        from touched where case when key % 11 = 5 then mine and key % 2 = 0 else not (mine and key % 13 = 0) end),
    theirs as (
        select key, fid, case when key % 11 = 5 then name || '-t' when key % 42 = 0 then name || '-d' else name end as name, (value + 2)::decimal(14,3) as value,
               case when key % 9 = 0 then 'X' else seg end as seg, x, y
        from named where key % 3 = 0 or key % 22 = 5
        union all select * from base where not (key % 3 = 0 or key % 22 = 5) and key not in {DROPPED}),
    sides as (
        select n.key, n.fid, n.x, n.y, b.key is not null as hb, o.key is not null as ho, t.key is not null as ht,
               (b.name, b.value, b.seg) as b, (o.name, o.value, o.seg) as o, (t.name, t.value, t.seg) as t,
               b.name as bn, b.value as bv, b.seg as bs, o.name as n1, o.value as v1, o.seg as s1, t.name as n2, t.value as v2, t.seg as s2
        from named n left join base b on b.key = n.key left join ours o on o.key = n.key left join theirs t on t.key = n.key),
    same as (
        select *, ho = hb and (not ho or o is not distinct from b) as ob, ht = hb and (not ht or t is not distinct from b) as tb, ho = ht and (not ho or o is not distinct from t) as ot,
               concat_ws(',', case when n1 is distinct from bn and n2 is distinct from bn and n1 is distinct from n2 then 'name' end,
                         case when v1 is distinct from bv and v2 is distinct from bv and v1 is distinct from v2 then 'value' end,
                         case when s1 is distinct from bs and s2 is distinct from bs and s1 is distinct from s2 then 'seg' end) as open
        from sides where hb or ho or ht),
    settled as (
        select *, case when ob then 'theirs' when tb or ot then 'ours' when not (hb and ho and ht) then 'existence' when open <> '' then 'field' else 'merge' end as outcome from same),
    final as (
        select key, fid, x, y, outcome,
               case when outcome in ('theirs', 'existence') then ht when outcome in ('ours', 'field') then ho else true end as there,
               case when outcome in ('theirs', 'existence') then n2 when outcome in ('ours', 'field') then n1 when n1 is not distinct from bn then n2 else n1 end as name,
               case when outcome in ('theirs', 'existence') then v2 when outcome in ('ours', 'field') then v1 when v1 is not distinct from bv then v2 else v1 end as value,
               case when outcome in ('theirs', 'existence') then s2 when outcome in ('ours', 'field') then s1 when s1 is not distinct from bs then s2 else s1 end as seg
        from settled)"""

FINAL = "select fid, name, value, seg, x, y from final where there"


def version_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEFAULT after the post: a base segment and the layers of the resolutions."""
    h = history(Customers, spark, sf_dir)
    return h.plain(h.engine.read(h.did, h.default))


def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branch's base, long after both sides have moved on."""
    return history(Customers, spark, sf_dir).snapshot("base")


def engine_branch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branch after its edits: layers of single rows and keys that are gone."""
    return history(Customers, spark, sf_dir).snapshot("edited")


def engine_default_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEFAULT after a second load that replaced rows and brought new ones: two segments."""
    return history(Customers, spark, sf_dir).snapshot("moved")


def engine_accepted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(Customers, spark, sf_dir).snapshot("accepted")


def engine_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history(Customers, spark, sf_dir).conflicts
    return found.select("fid", "outcome", F.array_join("conflict_fields", ",").alias("fields"), *[F.col(f"{s}.value").alias(f"{s}_value") for s in ("base", "ours", "theirs")])


def engine_changes_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(Customers, spark, sf_dir).written


def engine_changes_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(Customers, spark, sf_dir).gone


def engine_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the branch's first base to the branch as it is after the post."""
    h = history(Customers, spark, sf_dir)
    return h.engine.diff(h.did, h.branch, h.base).select("fid", "change", F.col("old.name").alias("old_name"), F.col("new.name").alias("new_name"))


def engine_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a version by equality and by a list: filters that reach the row groups of its segments."""
    h = history(Customers, spark, sf_dir)
    keys = [r[0] for r in spark.range(1, 40).select(fid_of("customer", F.col("id"))).collect()]
    rows = h.engine.read(h.did, h.default)
    return rows.where(F.col("fid") == keys[0]).unionByName(rows.where(F.col("fid").isin(keys[1:]))).select("fid", "name")


def engine_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(Customers, spark, sf_dir)
    return h.engine.read(h.did, h.default).where(in_box("geom", 0.25, 0.1, 1.25, 10)).select("fid")


def engine_point_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(Customers, spark, sf_dir)
    return dump_points(h.engine.read_snapshot(h.did, h.base), "geom", ["fid"]).select("fid", "path", "x", "y")


def engine_geometry_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate has said of the geometries that it let in."""
    h = history(Customers, spark, sf_dir)
    g = F.col("geom")
    rows = h.engine.read_snapshot(h.did, h.base).groupBy(g["srid"].alias("srid"), g["gtype"].alias("gtype"), g["zm"].alias("zm"), g["is_empty"].alias("is_empty"), g["finite"].alias("finite"), g["valid"].alias("valid"))
    return rows.agg(F.count("*").alias("n"), F.min(F.octet_length("geom.ewkb")).cast("int").alias("ewkb_bytes"))


def engine_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key that ever was has one number, from 1 without gaps, and keeps it."""
    h = history(Customers, spark, sf_dir)
    ids = h.engine.identities(h.did)
    rows = h.engine.read(h.did, h.default).select("fid", F.col("object_id").alias("number"))
    joined = ids.join(rows, "fid", "left")
    return joined.agg(F.count("*").alias("n"), F.count_distinct("fid").alias("fids"), F.count_distinct("object_id").alias("numbers"), F.min("object_id").alias("low"), F.max("object_id").alias("high"), F.count_if(F.col("number") != F.col("object_id")).alias("changed"))


def engine_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose revision is another than in the branch's base, by whether their values are: new revisions are drawn for
    every row that is written, even of equal values."""
    h = history(Customers, spark, sf_dir)
    old = h.engine.read_snapshot(h.did, h.base).select("fid", F.col("feature_revision").alias("was"))
    now = h.engine.read_snapshot(h.did, h.moved).select("fid", "feature_revision")
    return now.join(old, "fid").groupBy((F.col("was") != F.col("feature_revision")).alias("drawn")).agg(F.count("*").alias("n"))


def quota_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the branch counts against its group's quotas: rows and canonical bytes of its copy and its snapshot."""
    u = history(Customers, spark, sf_dir).usage
    return rows_of(spark, [(u["current_rows"], u["snapshot_rows"], u["current_bytes"], u["snapshot_bytes"], u["history_rows"])], "current_rows long, snapshot_rows long, current_bytes long, snapshot_bytes long, history_rows long")


def engine_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = history(Customers, spark, sf_dir).measured
    return rows_of(spark, [(m["row_count"], m["row_bytes"], len(m["rows_sha256"]), m["schema_sha256"])], "row_count long, row_bytes long, digest_length int, schema_sha256 string")


def engine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(Customers, spark, sf_dir)
    pages, after = [], 0
    while page := h.engine.events(h.group, after, 5):  # some commits at a time
        pages += page
        after = page[-1]["sequence"]
    return rows_of(spark, [(e["event_id"], e["kind"], e["version_id"] == h.default, e["payload"].get("operation"), e["payload"].get("fid"), e["delivered"]) for e in pages], "event_id long, kind string, of_default boolean, operation string, fid string, delivered boolean")


def engine_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as a stream that is read until it has no more."""
    h = history(Customers, spark, sf_dir)
    root = scratch_root(spark)
    q = outbox(h.engine.store, h.group, 7).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


def engine_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, sorted(history(Customers, spark, sf_dir).codes.items()), "request string, answer string")


def engine_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors of the datasets of both histories, their fingerprints among them."""
    a, b = history(Customers, spark, sf_dir), history(Parts, spark, sf_dir)
    found = [h.engine.export_schema(d) for h, d in ((a, a.did), (b, b.did), (b, b.child))]
    found = [(d["managed_name"], d["schema_sha256"], d["group_schema_generation"], len(d["definition"]["fields"]), d["identity"]["object_id_json_encoding"], d["current"]["version_id"] == d["default_version_id"]) for d in found if d["managed_name"] != "offers"]
    return rows_of(spark, found, "managed_name string, schema_sha256 string, generation int, fields int, object_ids string, at_default boolean")


# --- parts: batches with defaults, variants, a relationship, replacement -------------------------------------------------


def batches(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """Batches of as many rows as one may have, from JSON text."""
    while batch := list(itertools.islice(rows, MOST_ROWS)):
        yield read_batch(json.dumps(batch))


class Parts:
    """Parts in batches that leave fields to their defaults, offers that refer to them, an upsert, and a replacement."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.engine = e = Workspace(spark, scratch_root(spark))
        d = e.create_dataset("parts", "item", "policy", PARTS)
        self.did, self.default, self.group = d["dataset_id"], d["default_version_id"], d["version_group_id"]
        relation = {"name": "of", "field": "part", "target_dataset": self.did, "cardinality": "many-to-one", "on_delete": "restrict"}
        offers = {"schema_version": 2, "fields": [{"name": "part", "type": "uuid", "nullable": True}], "geometry": None, "subtypes": None, "relationships": [relation], "rules": []}
        self.child = e.create_dataset("offers", "item", "policy", offers, version_group_id=self.group)["dataset_id"]
        head = lambda: e.store.state(self.group)["versions"][self.default]["head"]
        p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
        p = p.select(k.alias("key"), fid_of("part", k).alias("fid"), fid_of("offer", k).alias("offer"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").cast("decimal(12,2)").alias("price")).orderBy("key")

        def part(r) -> dict:
            values: dict[str, Any] = {"kind": "ABC"[r.key % 3], "name": r.name, "size": r.size, "price": str(r.price)}
            for field, left in (("kind", r.key % 3 == 0 and r.key % 4 == 0), ("size", r.key % 5 == 0), ("price", r.key % 7 == 0)):
                if left:
                    del values[field]
            return {"fid": r.fid, "values": values}

        offer = lambda r: {"fid": r.offer, "values": {"part": r.fid if r.key % 3 else None}}
        edit = lambda dataset, rows, replace=False: {"dataset_id": dataset, "rows": rows, "replace": replace}
        for batch in batches(part(r) for r in p.toLocalIterator()):
            e.apply_group(self.default, head(), [edit(self.child, []), edit(self.did, batch)])
        for batch in batches(offer(r) for r in p.where("key % 4 = 0").toLocalIterator()):
            e.apply_rows(self.child, self.default, head(), batch)
        self.identified = e.read(self.did).select("fid", "object_id")
        first = p.where("key % 3 > 0 and key % 5 > 0 and key % 7 > 0").first()
        self.codes = {
            "drop a part that has offers": code_of(e.apply_rows, self.did, self.default, head(), [part(first)], True),
            "an offer of no part": code_of(e.apply_rows, self.child, self.default, head(), [{"fid": id_of("o"), "values": {"part": id_of("nothing")}}]),
            "an update that leaves out a field": code_of(e.apply_rows, self.did, self.default, head(), [{"fid": first.fid, "values": {"kind": "A", "name": "x"}}]),
            "a part of no kind": code_of(e.apply_rows, self.did, self.default, head(), [{"fid": id_of("p"), "values": {"kind": "Z", "name": "x"}}]),
            "a size outside the variant's domain": code_of(e.apply_rows, self.did, self.default, head(), [{"fid": id_of("p"), "values": {"kind": "B", "name": "x", "size": 61}}]),
            "a size as text": code_of(e.apply_rows, self.did, self.default, head(), [{"fid": id_of("p"), "values": {"kind": "B", "name": "x", "size": "6"}}]),
            "a part twice": code_of(e.apply_rows, self.did, self.default, head(), [{"fid": id_of("p"), "values": {"kind": "B", "name": "x"}}] * 2),
            "an old head": code_of(e.apply_rows, self.did, self.default, id_of("h"), []),
            "another version": code_of(e.apply_rows, self.did, id_of("v"), head(), []),
            "no edits": code_of(e.apply_group, self.default, head(), []),
            "a dataset twice": code_of(e.apply_group, self.default, head(), [edit(self.did, [])] * 2),
            "an empty edit": code_of(e.apply_group, self.default, head(), [edit(self.did, [])]),
            "a revision that rows violate": code_of(e.revise_schema, e.export_schema(self.did), self.narrow(30)),
            "a revision of the stored form": code_of(e.revise_schema, e.export_schema(self.did), PARTS | {"fields": [*PARTS["fields"][:1], PARTS["fields"][1] | {"max_length": 90}, *PARTS["fields"][2:]]}),
            "a revision of nothing": code_of(e.revise_schema, e.export_schema(self.did), PARTS),
            "an old descriptor": code_of(e.revise_schema, d, self.narrow(90)),
            "a revision that rows satisfy": code_of(e.revise_schema, e.export_schema(self.did), self.narrow(90)),
        }
        upper = p.where("key % 10 = 3").withColumn("name", F.upper("name")).withColumn("size", F.lit(3))
        for batch in batches({"fid": r.fid, "values": {"kind": "C", "name": r.name, "size": r.size, "price": None}} for r in upper.toLocalIterator()):
            e.apply_rows(self.did, self.default, head(), batch)
        kept = [offer(r) for r in p.where("key % 8 = 0").limit(MOST_ROWS).collect()]  # a replacement is one batch
        e.apply_rows(self.child, self.default, head(), kept, True)

    @staticmethod
    def narrow(most: int) -> dict:
        out = json.loads(json.dumps(PARTS))
        out["fields"][2]["domain"]["max"] = most
        return out


PARTS_HISTORY_SQL = """
    keyed as (select p_partkey as key, p_name as name, p_size as size, p_retailprice::decimal(12,2) as price, md5('part' || p_partkey) as h, md5('offer' || p_partkey) as g from part),
    ids as (
        select *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) as fid,
               substr(g, 1, 8) || '-' || substr(g, 9, 4) || '-' || substr(g, 13, 4) || '-' || substr(g, 17, 4) || '-' || substr(g, 21) as offer,
               (['A', 'B', 'C'])[(key % 3 + 1)::integer] as kind, row_number() over (order by key) as object_id from keyed),
    filled as (
        select key, fid, offer, object_id, kind, name, case when key % 5 <> 0 then size when kind = 'A' then 10 when kind = 'B' then 7 end::integer as size,
               case when key % 7 <> 0 then price when kind = 'C' then 1.50 end::decimal(12,2) as price from ids)"""


def engine_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(Parts, spark, sf_dir)
    return h.engine.read(h.did).select("fid", "object_id", "kind", "name", "size", "price")


def engine_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a replacement: rows that are gone keep their identities."""
    h = history(Parts, spark, sf_dir)
    return h.engine.identities(h.child).join(h.engine.read(h.child).select("fid", "part", F.lit(True).alias("there")), "fid", "left").select("fid", "part", F.coalesce("there", F.lit(False)).alias("there"), F.col("object_id").cast("string").alias("object_id"))


def engine_batch_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, sorted(history(Parts, spark, sf_dir).codes.items()), "request string, answer string")


def engine_dynamic_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a scan come from the definition that is in force."""
    h = history(Parts, spark, sf_dir)
    return rows_of(spark, [(k, f.name, f.dataType.simpleString()) for k, f in enumerate(h.engine.read(h.did).schema.fields)], "place int, name string, type string")


# --- branches: every change of state that is tried --------------------------------------------------------------------------


class Lives:
    """A branch in every state is asked into every other; which changes are done, and what the group shows at the end."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.engine = e = Workspace(spark, scratch_root(spark))
        d = e.create_dataset("nothing", "item", "policy", CUSTOMERS | {"geometry": None})
        g = self.group = d["version_group_id"]
        quota = {k: high for k, (_, high) in QUOTA.items()}
        self.codes = {"reserve without quotas": code_of(e.reserve_branch, g, id_of(0), "early", OWNER, "private", [], id_of("o0"))}
        self.codes["quotas of another shape"] = code_of(e.configure_branch_quotas, g, quota | {"more": 1})
        self.codes["quotas above their bounds"] = code_of(e.configure_branch_quotas, g, quota | {"max_branches": 101})
        e.configure_branch_quotas(g, quota)
        number = itertools.count(1)
        paths = {"creating": [], "active": ["active"], "archived": ["active", "archived"], "deletion_pending": ["active", "deletion_pending"], "deleted": ["active", "deletion_pending", "deleted"], "creation_failed": ["creation_failed"]}

        def made(state: str) -> dict:
            n = next(number)
            b = e.reserve_branch(g, id_of("branch", n), f"b{n}", OWNER, "private", [], id_of("operation", n))
            for step in paths[state]:
                if step == "active":
                    e.populate_branch(b["branch_id"], b["revision"], verify=False)
                elif step == "creation_failed":
                    e.cancel_branch(b["branch_id"], b["revision"])
                else:
                    e.transition_branch(b["branch_id"], b["revision"], step)
                b = e.branch(b["branch_id"], True)
            return b

        self.legal, b = [], None
        for state in paths:
            b = made(state)
            for to in ("creating", "active", "archived", "deletion_pending", "deleted", "creation_failed"):
                if code_of(e.transition_branch, b["branch_id"], b["revision"], to) == "done":
                    self.legal.append((state, to))
                    b = made(state)
        ask = lambda visibility, editors, name="shown", n=900, op=900: code_of(e.reserve_branch, g, id_of("branch", n), name, OWNER, visibility, editors, id_of("operation", op))
        some = [str(uuid.UUID(int=k)) for k in (9, 7, 9)]
        self.codes |= {
            "private with editors": ask("private", some), "shared without": ask("shared", []), "of no visibility": ask(None, []), "a name of no kind": ask("private", [], "Shown"), "65 editors": ask("shared", [str(uuid.UUID(int=k)) for k in range(65)]),
            "a name that is taken": ask("private", [], "b1", 902, 902), "shared with editors": ask("shared", some), "the same again": ask("shared", some[1:]), "the same with another name": ask("shared", some, "other"), "another with the same name": ask("private", [], "shown", 901, 901),
        }
        b = e.branch(id_of("branch", 900), True)
        self.codes["fill with an old revision"] = code_of(e.populate_branch, b["branch_id"], id_of("r"))
        e.populate_branch(b["branch_id"], b["revision"])
        b = e.branch(b["branch_id"])
        self.codes["fill again"] = code_of(e.populate_branch, b["branch_id"], b["revision"])
        b = e.update_branch(b["branch_id"], b["revision"], "renamed", "organization", some)
        self.codes["cancel what is active"] = code_of(e.cancel_branch, b["branch_id"], b["revision"])
        e.pin_snapshot(g, b["base_snapshot_id"], "publication", id_of("p"))
        self.codes["delete what is pinned"] = code_of(e.transition_branch, b["branch_id"], b["revision"], "deletion_pending")
        self.codes["quotas below what is in use"] = code_of(e.configure_branch_quotas, g, quota | {"max_branches": 1})
        self.codes["an unknown branch"] = code_of(e.branch, id_of("nobody"))
        e.check_invariants(g)
        self.shown = [b for b in e.branches(g) if b["name"] in ("renamed",)]


def lifecycle_legal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, history(Lives, spark, sf_dir).legal, "from_state string, to_state string")


def engine_branch_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, sorted(history(Lives, spark, sf_dir).codes.items()), "request string, answer string")


def branch_list_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the group shows of a branch, as one JSON text."""
    shown = [{k: b[k] for k in ("name", "state", "visibility", "editors")} for b in history(Lives, spark, sf_dir).shown]
    return rows_of(spark, [(json.dumps(shown, separators=(",", ":")),)], "branches string")


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{a.replace(chr(39), chr(39) * 2)}', '{b}')" for a, b in rows)


def _sql(ctes: str, body: str) -> str:
    return f"with {ctes.strip()} {body}"


PLAIN = "fid, name, value, seg, x, y"
# what a row's canonical text has besides its values: six names, the texts of two ids, and a point of 25 bytes in hexadecimal
ROW_BYTES = "(octet_length(encode('{\"feature_revision\":\"\",\"fid\":\"\",\"geom\":\"\",\"name\":\"\",\"object_id\":\"\",\"seg\":,\"value\":\"\"}')) + 36 + 36 + 50)"
BASE_BYTES = f"select count(*) as n, (sum({ROW_BYTES} + octet_length(encode(name)) + coalesce(octet_length(encode(seg)) + 2, 4) + length(value::varchar) + length(number::varchar)))::bigint as bytes from (select *, row_number() over () as number from base)"
ANSWERS = [
    ("accept with open conflicts", "UNRESOLVED_CONFLICT"), ("resolve without a side", "INVALID_RESOLUTION"), ("sealed by the last", "True"), ("post before acceptance", "STALE_RECONCILE"), ("accept again", "INVALID_PLAN_STATE"), ("post with another head", "STALE_RECONCILE"),
    ("post again", "the same head"), ("post by another", "IDEMPOTENCY_CONFLICT"), ("post what is posted", "STALE_RECONCILE"), ("accept what is posted", "STALE_RECONCILE"), ("edit with an old head", "STALE_BRANCH_HEAD"), ("edit of no kind", "INVALID_OPERATION"), ("delete what is not there", "UNKNOWN_FEATURE"),
    ("prepare DEFAULT", "DEFAULT_IS_NOT_BRANCH"), ("capture an unknown version", "UNKNOWN_VERSION"), ("revise under a branch", "ACTIVE_BRANCH_SCHEMA_CHANGE_UNSUPPORTED"),
]
BATCH_ANSWERS = [
    ("drop a part that has offers", "RELATIONSHIP_VIOLATION"), ("an offer of no part", "RELATIONSHIP_VIOLATION"), ("an update that leaves out a field", "FIELD_SET_MISMATCH"), ("a part of no kind", "INVALID_SUBTYPE"), ("a size outside the variant's domain", "CONSTRAINT_VIOLATION"), ("a size as text", "INVALID_TYPED_VALUE"),
    ("a part twice", "DUPLICATE_FEATURE_UUID"), ("an old head", "STALE_HEAD"), ("another version", "DATASET_VERSION_MISMATCH"), ("no edits", "INVALID_MANAGED_GROUP"), ("a dataset twice", "DUPLICATE_DATASET_EDIT"), ("an empty edit", "done"), ("a revision that rows violate", "CONSTRAINT_VIOLATION"),
    ("a revision of the stored form", "PHYSICAL_SCHEMA_CHANGE_REQUIRES_MIGRATION"), ("a revision of nothing", "done"), ("an old descriptor", "STALE_SCHEMA"), ("a revision that rows satisfy", "done"),
]
BRANCH_ANSWERS = [
    ("reserve without quotas", "BRANCH_QUOTAS_REQUIRED"), ("quotas of another shape", "INVALID_BRANCH_QUOTAS"), ("quotas above their bounds", "INVALID_BRANCH_QUOTAS"), ("private with editors", "INVALID_BRANCH_VISIBILITY"), ("shared without", "INVALID_BRANCH_VISIBILITY"), ("of no visibility", "INVALID_BRANCH_REQUEST"),
    ("a name of no kind", "INVALID_BRANCH_REQUEST"), ("65 editors", "INVALID_BRANCH_REQUEST"), ("a name that is taken", "DUPLICATE_BRANCH_NAME"), ("shared with editors", "done"), ("the same again", "done"), ("the same with another name", "BRANCH_OPERATION_CONFLICT"),
    ("another with the same name", "DUPLICATE_BRANCH_NAME"), ("fill with an old revision", "STALE_BRANCH_METADATA"), ("fill again", "BRANCH_NOT_CREATING"), ("cancel what is active", "BRANCH_NOT_CREATING"), ("delete what is pinned", "RETAINED_SNAPSHOT_REFERENCE"), ("quotas below what is in use", "QUOTA_BELOW_RETAINED_USAGE"),
    ("an unknown branch", "UNKNOWN_BRANCH"),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        version_scan, snapshot_scan, engine_branch_rows, engine_default_rows, engine_accepted_rows, engine_conflicts, engine_changes_written, engine_changes_gone, engine_diff, engine_key_lookup, engine_box, engine_point_dump, engine_geometry_flags,
        engine_identities, engine_revisions, quota_usage, engine_manifest, engine_events, engine_outbox, engine_codes, engine_catalog, engine_parts, engine_offers, engine_batch_codes, engine_dynamic_schema, lifecycle_legal_transitions, engine_branch_codes, branch_list_json,
    )
}

EVENTS_SQL = f"""
    edits as (
        select key, fid, case when key % 11 = 5 then 'insert' when key % 13 = 0 then 'delete' else 'update' end as operation
        from named where key <= {LAST} and case when key % 11 = 5 then key % 2 = 0 else key % 13 = 0 or key % 7 = 0 end),
    steps as (
        select 1 as step, 0 as key, 'create' as kind, false as of_default, null as operation, null as fid
        union all select 2, key, 'edit', false, operation, fid from edits
        union all select 2, {LAST} + key, 'edit', true, 'delete', fid from named where key in {DROPPED}
        union all select 3, 0, 'prepare', false, null, null
        union all select 4, 0, 'resolve', false, null, fid from settled where outcome in ('existence', 'field')
        union all select 5, 0, 'accept', false, null, null
        union all select 6, 0, 'post', true, null, null
        union all select 7, 0, 'checkpoint', false, null, null),
    numbered as (select *, row_number() over (order by step, key, fid) as event_id from steps)"""

ORACLE_SQL: dict[str, str] = {
    "version_scan": _sql(CUSTOMERS_SQL, FINAL),
    "snapshot_scan": _sql(CUSTOMERS_SQL, f"select {PLAIN} from base"),
    "engine_branch_rows": _sql(CUSTOMERS_SQL, f"select {PLAIN} from ours"),
    "engine_default_rows": _sql(CUSTOMERS_SQL, f"select {PLAIN} from theirs"),
    "engine_accepted_rows": _sql(CUSTOMERS_SQL, FINAL),
    "engine_conflicts": _sql(CUSTOMERS_SQL, "select fid, outcome, case outcome when 'field' then open else 'existence' end as fields, bv as base_value, v1 as ours_value, v2 as theirs_value from settled where outcome in ('existence', 'field')"),
    "engine_changes_written": _sql(CUSTOMERS_SQL, "select f.fid, f.name, f.value, f.seg from final f left join ours o on o.key = f.key where there and (o.key is null or (o.name, o.value, o.seg) is distinct from (f.name, f.value, f.seg))"),
    "engine_changes_gone": _sql(CUSTOMERS_SQL, "select o.fid from ours o join final f on f.key = o.key where not there"),
    "engine_diff": _sql(CUSTOMERS_SQL, """
        , last as (select * from final where there)
        select coalesce(b.fid, l.fid) as fid, case when b.fid is null then 'added' when l.fid is null then 'removed' else 'changed' end as change, b.name as old_name, l.name as new_name
        from base b full join last l on b.fid = l.fid where b.fid is null or l.fid is null or (b.name, b.value, b.seg) is distinct from (l.name, l.value, l.seg)"""),
    "engine_key_lookup": _sql(CUSTOMERS_SQL, "select fid, name from final where there and key between 1 and 39"),
    "engine_box": _sql(CUSTOMERS_SQL, "select fid from final where there and x between 0.25 and 1.25 and y between 0.1 and 10"),
    "engine_point_dump": _sql(CUSTOMERS_SQL, "select fid, 1 as path, x, y from base"),
    "engine_geometry_flags": _sql(CUSTOMERS_SQL, "select 4326 as srid, 'Point' as gtype, 0 as zm, false as is_empty, true as finite, true as valid, count(*) as n, 25 as ewkb_bytes from base"),
    "engine_identities": _sql(CUSTOMERS_SQL, "select count(*) as n, count(distinct key) as fids, count(distinct key) as numbers, 1::bigint as low, count(*) as high, 0::bigint as changed from sides where hb or ho or ht"),
    "engine_revisions": _sql(CUSTOMERS_SQL, f"select key % 3 = 0 or key % 22 = 5 as drawn, count(*) as n from base where key not in {DROPPED} group by 1"),
    "quota_usage": _sql(CUSTOMERS_SQL, f"select n as current_rows, n as snapshot_rows, bytes as current_bytes, bytes as snapshot_bytes, 1::bigint as history_rows from ({BASE_BYTES})"),
    "engine_manifest": _sql(CUSTOMERS_SQL, f"select n as row_count, bytes as row_bytes, 64 as digest_length, sha256('{json.dumps(CUSTOMERS, sort_keys=True, separators=(',', ':'))}') as schema_sha256 from ({BASE_BYTES})"),
    "engine_events": _sql(CUSTOMERS_SQL, f", {EVENTS_SQL.strip()} select event_id, kind, of_default, operation, fid, false as delivered from numbered"),
    "engine_outbox": _sql(CUSTOMERS_SQL, f", {EVENTS_SQL.strip()} select kind, count(*) as n, count(*) as ids from numbered group by kind"),
    "engine_codes": f"select * from (values {_values(ANSWERS)}) t(request, answer)",
    "engine_catalog": f"""
        select * from (values ('customers', sha256('{json.dumps(CUSTOMERS, sort_keys=True, separators=(',', ':'))}'), 1, 3, 'positive-decimal-string', true),
                              ('parts', sha256('{json.dumps(Parts.narrow(90), sort_keys=True, separators=(',', ':'))}'), 3, 4, 'positive-decimal-string', true))
        t(managed_name, schema_sha256, generation, fields, object_ids, at_default)""",
    "engine_parts": _sql(PARTS_HISTORY_SQL, """
        select fid, object_id, case when key % 10 = 3 then 'C' else kind end as kind, case when key % 10 = 3 then upper(name) else name end as name,
               case when key % 10 = 3 then 3 else size end as size, case when key % 10 <> 3 then price end as price from filled"""),
    "engine_offers": _sql(PARTS_HISTORY_SQL, f"""
        , offers as (select *, row_number() over (order by key) as number, row_number() over (partition by key % 8 = 0 order by key) as place from filled where key % 4 = 0)
        select offer as fid, case when key % 8 = 0 and place <= {MOST_ROWS} and key % 3 <> 0 then fid end as part, key % 8 = 0 and place <= {MOST_ROWS} as there, number::varchar as object_id from offers"""),
    "engine_batch_codes": f"select * from (values {_values(BATCH_ANSWERS)}) t(request, answer)",
    "engine_dynamic_schema": "select * from (values (0, 'fid', 'string'), (1, 'object_id', 'bigint'), (2, 'feature_revision', 'string'), (3, 'kind', 'string'), (4, 'name', 'string'), (5, 'size', 'int'), (6, 'price', 'decimal(12,2)')) t(place, name, type)",
    "lifecycle_legal_transitions": f"select * from (values {_values(sorted(TRANSITIONS))}) t(from_state, to_state)",
    "engine_branch_codes": f"select * from (values {_values(BRANCH_ANSWERS)}) t(request, answer)",
    "branch_list_json": f"""select '[{{"name":"renamed","state":"active","visibility":"organization","editors":["{uuid.UUID(int=7)}","{uuid.UUID(int=9)}"]}}]' as branches""",
}

assert fingerprint(CUSTOMERS)  # the definitions above are definitions
