"""The operators as queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import engine_queries as engine
from .functions import predicates as p
from .functions.geometry import ordinate, point
from .functions.typed import gate
from .operators import change, checks, identity, measure, merge
from .plans.branches import editors_of
from .plans.definition import Field, read_domain
from .plans.engine import default_columns

FIELDS = ["name", "value", "seg"]
MONEY = "decimal(14,3)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- one feature table in three versions, made of customer ------------------------------------------------------------


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("fid"), F.col("c_name").alias("name"), F.col("c_acctbal").cast(MONEY).alias("value"), F.col("c_mktsegment").alias("seg"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, fid = features(spark, sf_dir), F.col("fid")
    more = lambda n: (F.col("value") + n).cast(MONEY)
    base = rows.where(fid % 11 != 5)
    ours = base.where(fid % 13 != 0).select("fid", F.when(fid % 7 == 0, F.concat("name", F.lit("-o"))).otherwise(F.col("name")).alias("name"), F.when(fid % 5 == 0, more(1)).otherwise(F.col("value")).alias("value"), "seg")
    ours = ours.unionByName(rows.where((fid % 11 == 5) & (fid % 2 == 0)))
    theirs = base.where(fid % 17 != 0).select("fid", "name", F.when(fid % 3 == 0, more(2)).otherwise(F.col("value")).alias("value"), F.when(fid % 9 == 0, "X").otherwise(F.col("seg")).alias("seg"))
    return base, ours, theirs.unionByName(rows.where((fid % 11 == 5) & (fid % 3 == 0)).withColumn("name", F.concat("name", F.lit("-t"))))


SIDES_SQL = """
    features as (select c_custkey as fid, c_name as name, c_acctbal::decimal(14,3) as value, c_mktsegment as seg from customer),
    base as (select * from features where fid % 11 <> 5),
    ours as (
        select fid, case when fid % 7 = 0 then name || '-o' else name end as name, case when fid % 5 = 0 then (value + 1)::decimal(14,3) else value end as value, seg
        from base where fid % 13 <> 0 union all select * from features where fid % 11 = 5 and fid % 2 = 0),
    theirs as (
        select fid, name, case when fid % 3 = 0 then (value + 2)::decimal(14,3) else value end as value, case when fid % 9 = 0 then 'X' else seg end as seg
        from base where fid % 17 <> 0 union all select fid, name || '-t', value, seg from features where fid % 11 = 5 and fid % 3 = 0),
    joined as (
        select coalesce(b.fid, o.fid, t.fid) as fid, b.fid is not null as hb, o.fid is not null as ho, t.fid is not null as ht,
               b.name as bn, b.value as bv, b.seg as bs, o.name as n1, o.value as v1, o.seg as s1, t.name as n2, t.value as v2, t.seg as s2
        from base b full join ours o on b.fid = o.fid full join theirs t on t.fid = coalesce(b.fid, o.fid)),
    same as (
        select *, (ho, n1, v1, s1) is not distinct from (hb, bn, bv, bs) as ob, (ht, n2, v2, s2) is not distinct from (hb, bn, bv, bs) as tb,
               (ho, n1, v1, s1) is not distinct from (ht, n2, v2, s2) as ot,
               list_filter([case when n1 is distinct from bn and n2 is distinct from bn and n1 is distinct from n2 then 'name' end,
                            case when v1 is distinct from bv and v2 is distinct from bv and v1 is distinct from v2 then 'value' end,
                            case when s1 is distinct from bs and s2 is distinct from bs and s1 is distinct from s2 then 'seg' end], lambda x: x is not null) as open
        from joined),
    merged as (
        select *, case when ob then 'take_theirs' when tb or ot then 'take_ours' when not (hb and ho and ht) then 'existence'
                       when len(open) > 0 then 'field' else 'merge' end as outcome,
               case when n1 is not distinct from bn then n2 else n1 end as nm, case when v1 is not distinct from bv then v2 else v1 end as vm,
               case when s1 is not distinct from bs then s2 else s1 end as sm
        from same)"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.three_way_merge(*sides(spark, sf_dir), "fid", FIELDS)


def merge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("rows"), F.sum("fid").alias("fids"))


def merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merged(spark, sf_dir)
    return m.select("fid", "outcome", F.array_join("conflict_fields", ",").alias("conflict_fields"), F.col("merged.name").alias("name"), F.col("merged.value").alias("value"), F.col("merged.seg").alias("seg"))


def merge_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.candidate(merged(spark, sf_dir), "fid")


def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merge.conflicts(merged(spark, sf_dir), "fid")
    return m.select("fid", "outcome", *[F.col(f"{s}.value").alias(f"{s}_value") for s in merge.SIDES])


def merge_conflict_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).where("outcome = 'field'").select("fid", F.explode("conflict_fields").alias("field"))


def resolved(choice: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: merge.resolve(merge.conflicts(merged(spark, sf_dir), "fid"), "fid", choice)


def feature_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, ours, _ = sides(spark, sf_dir)
    d = change.feature_diff(base, ours, "fid", FIELDS)
    return d.select("fid", "change", F.col("old.value").alias("old_value"), F.col("new.value").alias("new_value"), F.col("new.name").alias("new_name"))


def apply_snapshot_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, ours, _ = sides(spark, sf_dir)
    return change.changed_rows(base, ours, "fid", FIELDS)


def apply_snapshot_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, ours, _ = sides(spark, sf_dir)
    return change.removed_rows(base, ours, "fid")


def accepted_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branch after every conflict has been decided for it and the plan accepted."""
    m = merged(spark, sf_dir)
    return merge.candidate(m, "fid").unionByName(merge.resolve(merge.conflicts(m, "fid"), "fid", "ours"))


# --- sinks over part -----------------------------------------------------------------------------------------------------


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fid"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))


def part_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fid = parts(spark, sf_dir), F.col("fid")
    return rows.where(fid % 10 == 3).select((fid + F.when(fid % 20 == 3, 1_000_000).otherwise(0)).alias("fid"), F.upper("name").alias("name"), (F.col("size") + 1).alias("size"))


PARTS_SQL = """
    parts as (select p_partkey as fid, p_name as name, p_size as size from part),
    batch as (select fid + case when fid % 20 = 3 then 1000000 else 0 end as fid, upper(name) as name, (size + 1)::integer as size from parts where fid % 10 = 3)"""


def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.upsert(parts(spark, sf_dir), part_batch(spark, sf_dir), "fid")


def replace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.replace(parts(spark, sf_dir), part_batch(spark, sf_dir), "fid")


def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.delete(parts(spark, sf_dir), part_batch(spark, sf_dir), "fid")


# --- set checks ------------------------------------------------------------------------------------------------------------


def natural_key_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def one_to_one_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicates(table(spark, sf_dir, "orders"), ["o_custkey"])


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 7 <> 2").select("c_custkey", "c_name")


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when(F.col("o_orderkey") % 19 != 0, F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", parent.alias("parent"))


def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.orphans(children(spark, sf_dir), "parent", parents(spark, sf_dir), "c_custkey")


def fk_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.referenced(parents(spark, sf_dir), "c_custkey", children(spark, sf_dir), "parent")


def restrict_delete_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = parents(spark, sf_dir).where("c_custkey % 5 = 1")
    return checks.referenced(gone, "c_custkey", children(spark, sf_dir), "parent").select("c_custkey")


KIN_SQL = """
    parents as (select c_custkey, c_name from customer where c_custkey % 7 <> 2),
    children as (select o_orderkey, case when o_orderkey % 19 <> 0 then o_custkey end as parent from orders)"""

# --- row checks --------------------------------------------------------------------------------------------------------------

PART_DEFINITION = {
    "schema_version": 2,
    "fields": [
        {"name": "kind", "type": "string", "nullable": False, "max_length": 40},
        {"name": "size", "type": "int32", "nullable": True, "default": 7, "domain": {"kind": "range", "min": 5, "max": 45}},
        {"name": "price", "type": "decimal", "nullable": True, "precision": 12, "scale": 2, "domain": {"kind": "range", "min": "920.00", "max": "980.00"}},
        {"name": "floor", "type": "decimal", "nullable": True, "precision": 12, "scale": 2},
    ],
    "geometry": None,
    "subtypes": {
        "field": "kind",
        "variants": [
            {"code": "A", "defaults": {"size": 10}, "domains": {"size": {"kind": "range", "min": 10, "max": 20}}},
            {"code": "B", "defaults": {}, "domains": {"size": {"kind": "coded", "values": [1, 2, 3, 4, 5, 7, 40]}}},
            {"code": "C", "defaults": {"price": None}, "domains": {}},
        ],
    },
    "relationships": [],
    "rules": [
        {"name": "has_price", "kind": "required", "field": "price"},
        {"name": "above_floor", "kind": "compare", "field": "price", "operator": "ge", "operand": {"field": "floor"}},
        {"name": "not_seven", "kind": "compare", "field": "size", "operator": "ne", "operand": {"literal": 7}},
    ],
}


def typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit("D")), (key % 4 + 1).cast("int")).alias("kind"),
        F.when(key % 6 != 0, F.col("p_size")).alias("size"),
        F.when(key % 8 != 0, F.col("p_retailprice").cast("decimal(12,2)")).alias("price"),
        F.when(key % 9 != 0, (F.col("p_size") * 40).cast("decimal(12,2)")).alias("floor"),
    )


TYPED_SQL = """
    rows as (
        select p_partkey, (['A', 'B', 'C', 'D'])[(p_partkey % 4 + 1)::integer] as kind, case when p_partkey % 6 <> 0 then p_size end as size,
               case when p_partkey % 8 <> 0 then p_retailprice::decimal(12,2) end as price, case when p_partkey % 9 <> 0 then (p_size * 40)::decimal(12,2) end as floor
        from part)"""


def violating(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """Rows that fail any check of that name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = [ok for n, ok in p.checks(PART_DEFINITION) if n == name]
        bad = ~found[0]
        for ok in found[1:]:
            bad = bad | ~ok
        return typed_parts(spark, sf_dir).where(bad).select("p_partkey")

    return run


def row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed_parts(spark, sf_dir).withColumn("bad", F.array_distinct(p.violations(PART_DEFINITION)))
    return rows.where("size(bad) > 0").select("p_partkey", F.array_join("bad", ",").alias("violations"))


def coded_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = Field.of({"name": "o_orderstatus", "type": "string", "nullable": True, "max_length": 1})
    ok = p.passes(p.in_domain(field, read_domain(field, {"kind": "coded", "values": ["F", "O"]})))
    return table(spark, sf_dir, "orders").where(~ok).select("o_orderkey", "o_orderstatus")


def null_check_vs_istrue(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("size") < 25
    return typed_parts(spark, sf_dir).select("p_partkey", p.passes(size).alias("check_passes"), p.holds(size).alias("rule_holds"))


def compare_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = {"name": "r", "kind": "compare", "field": "discount", "operator": "le", "operand": {"field": "tax"}}
    field = lambda n: Field.of({"name": n, "type": "decimal", "nullable": True, "precision": 6, "scale": 2})
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("decimal(6,2)").alias("discount"), F.col("l_tax").cast("decimal(6,2)").alias("tax"))
    return lines.where(~p.rule_predicate(rule, {n: field(n) for n in ("discount", "tax")})).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum("discount").cast("decimal(18,2)").alias("discounts"))


def insert_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows of every variant without a field that has defaults, as a bulk load fills it in."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit("D")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("kind"), F.lit(None).cast("decimal(12,2)").alias("price"), F.lit(None).cast("decimal(12,2)").alias("floor"))
    columns, known = default_columns(PART_DEFINITION, {"size"})
    return rows.select("p_partkey", *columns[:2], known.alias("known"))


# --- typed gates ---------------------------------------------------------------------------------------------------------------

SAMPLES = {
    "int32": ["0", "-1", "2147483647", "2147483648", "-2147483648", "007", "1.0", "true", " 1", "1\n", "", None],
    "int64": ["9223372036854775807", "9223372036854775808", "-9223372036854775808", "1e3", "12", None],
    "decimal": ["1.125", "1.12", "1.1200", "-0", "9999999999.99", "10000000000", "NaN", ".5", "5.", "1.2300", None],
    "date": ["2024-02-29", "2023-02-29", "0001-01-01", "0000-01-01", "2024-1-1", "2024-01-01\n", None],
    "timestamp": ["2024-01-01T01:30:00.123456+01:30", "2024-01-01T01:30:00Z", "2024-01-01t01:30:00z", "2024-01-01T01:30:00", "2024-01-01T24:00:00Z", "2024-01-01T00:00:00.1234567Z", "2024-02-30T00:00:00Z", None],
    "uuid": ["10000000-0000-0000-0000-00000000000A", "10000000-0000-0000-0000-00000000000g", "1000000000000000000000000000000a", None],
}


def sample_table(spark: SparkSession, kind: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).cast("string").alias("text")) for k, t in enumerate(SAMPLES[kind])])
    return spark.range(1).select(F.inline(rows))


def typed_gate(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        field = {"name": "x", "type": kind, "nullable": True, "precision": 12, "scale": 2}
        g = gate(F.col("text"), field)
        value: Column = g["value"]
        value = F.substring(F.replace(measure.instant_text(value), F.lit("T"), F.lit(" ")), 1, 26) if kind == "timestamp" else value.cast("string")
        return sample_table(spark, kind).select("k", g["ok"].alias("ok"), value.alias("value"))

    return run


def gate_sql(kind: str) -> str:
    quoted = lambda t: "null" if t is None else "'" + t.replace("'", "''") + "'" if "\n" not in t else "'" + t.replace("\n", "") + "' || chr(10)"
    rows = ", ".join(f"({k}, {quoted(t)})" for k, t in enumerate(SAMPLES[kind]))
    whole = "^(-?(0|[1-9][0-9]*))$"
    good = {
        "int32": f"regexp_full_match(text, '{whole[1:-1]}') and try_cast(text as integer) is not null",
        "int64": f"regexp_full_match(text, '{whole[1:-1]}') and try_cast(text as bigint) is not null",
        "decimal": "regexp_full_match(text, '-?(0|[1-9][0-9]*)([.][0-9]+)?') and regexp_full_match(text, '-?[0-9]{1,10}([.][0-9]{1,2}0*)?')",
        "date": "regexp_full_match(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(text as date) between date '0001-01-01' and date '9999-12-31'",
        "timestamp": "regexp_full_match(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.][0-9]{1,6})?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])') and try_cast(left(text, 10) as date) is not null",
        "uuid": "regexp_full_match(text, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}')",
    }[kind]
    value = {
        "int32": "text::integer::varchar", "int64": "text::bigint::varchar", "decimal": "text::decimal(12,2)::varchar", "date": "text::date::varchar", "uuid": "lower(text)",
        "timestamp": "strftime(make_timestamp(epoch_us(try_cast(upper(text) as timestamptz))), '%Y-%m-%d %H:%M:%S.%f')",
    }[kind]
    return f"with t(k, text) as (values {rows}), g as (select k, text, text is null or coalesce({good}, false) as ok from t) select k, ok, case when ok and text is not null then {value} end as value from g"


# --- identities, measures and the rest ---------------------------------------------------------------------------------------------


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of some of the suppliers, so that others have none."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0")
    return s.select(F.col("s_suppkey").alias("fid"), (F.col("s_suppkey") * 10).alias("object_id"))


def identity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.lookup(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fid"), "s_name"), registry(spark, sf_dir), "fid")


def identity_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fid"), (100_000_000 - F.col("c_custkey")).alias("position"))
    known = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("fid"), F.col("c_custkey").alias("object_id"))
    return identity.allocate(batch, known, "fid", "position", 5000)


def object_id_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identities of all suppliers, allocated in order, as text and, where they fit, in 32 bits."""
    batch = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fid"), F.col("s_suppkey").alias("position"))
    made = identity.allocate(batch, registry(spark, sf_dir).limit(0), "fid", "position", identity.LARGEST // 2**32 - 50)
    return made.select("fid", identity.as_text("object_id").alias("object_id"), identity.as_int32("object_id").alias("small"))


def snapshot_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("|", F.col("fid").cast("string"), F.col("name"), F.col("value").cast("string"), F.col("seg"))
    rows = features(spark, sf_dir).withColumn("key", F.lpad(F.col("fid").cast("string"), 12, "0"))
    return measure.measure(rows, "key", "hash", row=line)


def snapshot_measure_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.measure_tree(features(spark, sf_dir), "fid", "hash", digits=2)


def snapshot_verify_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy that lacks some rows: both measures, digests among them, and whether they agree."""
    rows = features(spark, sf_dir).withColumn("key", F.lpad(F.col("fid").cast("string"), 12, "0"))
    whole = measure.measure(rows, "key", "hash")
    return measure.same(whole, measure.measure(rows.where("fid % 100 <> 1"), "key", "hash"))


def empty_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.measure(features(spark, sf_dir).where("fid < 0"), "fid", "hash")


def bounded_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = checks.bounded_count(table(spark, sf_dir, "events"), 100)
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(n > 100).alias("above"))


def source_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.count("*").alias("row_count"), F.coalesce(F.sum(F.octet_length("props")), F.lit(0)).cast("long").alias("row_bytes"))


def editor_set_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The editors of some branches, given in any case and more than once, as a reservation keeps them; there are as many
    as there are types of events."""
    name = F.md5("event_type")
    fid = F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    given = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("branch")).agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, fid).otherwise(F.upper(fid))).alias("editors"))
    found = [(r.branch, ",".join(editors_of("shared", list(r.editors)))) for r in given.collect()]
    return spark.createDataFrame(found, "branch long, editors string")


def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select("c_custkey", (k % 30000 / 1000).alias("x"), (k % 10000 / 1000).alias("y"))
    box = F.struct(F.col("x").alias("xmin"), F.col("x").alias("xmax"), F.col("y").alias("ymin"), F.col("y").alias("ymax"))
    from .functions.geometry import in_box

    return points.withColumn("geom", box).where(in_box("geom", 0.25, 0.1, 1.25, 10)).select("c_custkey")


def bbox_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbox_filter(spark, sf_dir).limit(1000).agg(F.count("*").alias("n"))


def outbox_undelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.outbox import undelivered

    events = table(spark, sf_dir, "events")
    return undelivered(events.select("event_id", "event_type"), events.where("event_type in ('view', 'click')"))


def json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values of a group brought into one JSON object, keys in order."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("r_name", "r_regionkey"))))
    return table(spark, sf_dir, "region").agg(F.to_json(pairs).alias("regions"))


def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"))


def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile, as the workload's figures have them."""
    q = F.percentile(F.col("l_quantity").cast("int"), F.lit([0.5, 0.95]))
    return table(spark, sf_dir, "lineitem").agg(q[0].alias("median"), q[1].alias("p95"), F.count("*").alias("n"))


def point_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points made of ordinates, read back from their bytes."""
    k = F.col("c_custkey")
    made = table(spark, sf_dir, "customer").select("c_custkey", point(k % 360 - 180, k % 90, 4326, k / 8, measured=True).alias("geom"))
    g = F.col("geom")
    return made.select("c_custkey", *[ordinate(g, c).alias(c) for c in "xyzm"], g["zm"].alias("zm"), g["valid"].alias("valid"))


def session_zone_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants in canonical texts, which no session's zone changes."""
    rows = table(spark, sf_dir, "events").select("event_id", measure.instant_text(F.col("ts").cast("timestamp")).alias("at"))
    return rows.agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))


def fixture_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated features that the workload benchmark loads. The formulas of the published workload,
    without which its figures could not be compared."""
    n = F.col("id")
    digest = F.md5(F.concat(F.lit("assets"), n.cast("string")))
    fid = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return spark.range(1, 2001).select(fid.alias("fid"), F.lpad(n.cast("string"), 30, "x").alias("name"), ((n % 1000) / F.lit(10)).cast(MONEY).alias("value"))


def _sql(ctes: str, body: str) -> str:
    return f"with {ctes.strip()} {body}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        merge_outcomes, merge_rows, merge_candidate, merge_conflicts, merge_conflict_fields, accepted_branch, feature_diff, apply_snapshot_delete, apply_snapshot_changed,
        upsert_rows, replace_rows, delete_rows, natural_key_duplicates, one_to_one_duplicates, fk_orphans, fk_semi, restrict_delete_violations, row_violations, coded_domain, null_check_vs_istrue,
        compare_lines, insert_defaults, identity_lookup, identity_allocate, object_id_text, snapshot_measure, snapshot_measure_tree, snapshot_verify_copy, empty_measure, bounded_count, source_bytes, editor_set_normalize,
        bbox_filter, bbox_limit, outbox_undelivered, json_object, json_keys, price_percentiles, point_accessors, session_zone_digest, fixture_points,
    )
} | {
    **{f"resolve_{s}": resolved(s) for s in merge.SIDES},
    "range_domain": violating("domain:price"),
    "subtype_domain": violating("domain:size"),
    "subtype_code": violating("subtype"),
    "required_rule": violating("rule:has_price"),
    "compare_field_rule": violating("rule:above_floor"),
    "compare_literal_rule": violating("rule:not_seven"),
    **{f"typed_gate_{k}": typed_gate(k) for k in SAMPLES},
} | engine.QUERIES

BAD = {
    "range_domain": "(kind in ('A', 'B', 'C') and not coalesce(price between 920 and 980, true))",
    "subtype_domain": "not coalesce(kind <> 'A' or size between 10 and 20, true) or not coalesce(kind <> 'B' or size in (1, 2, 3, 4, 5, 7, 40), true) or not coalesce(kind <> 'C' or size between 5 and 45, true)",
    "subtype_code": "not coalesce(kind in ('A', 'B', 'C'), true)",
    "required_rule": "price is null",
    "compare_field_rule": "not coalesce(price >= floor, false)",
    "compare_literal_rule": "not coalesce(size <> 7, false)",
}
WINNER = "case outcome when 'take_theirs' then {t} when 'take_ours' then {o} when 'merge' then {m} end"
PRESENT = "case outcome when 'take_theirs' then ht when 'take_ours' then ho else outcome = 'merge' end"
PICKED = ", ".join(f"{WINNER.format(t=t, o=o, m=m)} as {n}" for n, t, o, m in (("name", "n2", "n1", "nm"), ("value", "v2", "v1", "vm"), ("seg", "s2", "s1", "sm")))

ORACLE_SQL: dict[str, str] = {
    "merge_outcomes": _sql(SIDES_SQL, "select outcome, count(*)::bigint as rows, sum(fid)::bigint as fids from merged group by outcome"),
    "merge_rows": _sql(SIDES_SQL, f"select fid, outcome, case outcome when 'field' then array_to_string(open, ',') when 'existence' then 'existence' end as conflict_fields, {PICKED} from merged"),
    "merge_candidate": _sql(SIDES_SQL, f"select fid, {PICKED} from merged where {PRESENT}"),
    "merge_conflicts": _sql(SIDES_SQL, "select fid, outcome, bv as base_value, v1 as ours_value, v2 as theirs_value from merged where outcome in ('existence', 'field')"),
    "merge_conflict_fields": _sql(SIDES_SQL, "select fid, unnest(open) as field from merged where outcome = 'field'"),
    "accepted_branch": _sql(SIDES_SQL, f"select fid, {PICKED} from merged where {PRESENT} union all select fid, n1, v1, s1 from merged where outcome in ('existence', 'field') and ho"),
    "resolve_base": _sql(SIDES_SQL, "select fid, bn as name, bv as value, bs as seg from merged where outcome in ('existence', 'field') and hb"),
    "resolve_ours": _sql(SIDES_SQL, "select fid, n1 as name, v1 as value, s1 as seg from merged where outcome in ('existence', 'field') and ho"),
    "resolve_theirs": _sql(SIDES_SQL, "select fid, n2 as name, v2 as value, s2 as seg from merged where outcome in ('existence', 'field') and ht"),
    "feature_diff": _sql(SIDES_SQL, """
        select coalesce(b.fid, o.fid) as fid, case when b.fid is null then 'added' when o.fid is null then 'removed' else 'changed' end as change,
               b.value as old_value, o.value as new_value, o.name as new_name
        from base b full join ours o on b.fid = o.fid where b.fid is null or o.fid is null or (b.name, b.value, b.seg) is distinct from (o.name, o.value, o.seg)"""),
    "apply_snapshot_delete": _sql(SIDES_SQL, "select * from base b where not exists (select 1 from ours o where o.fid = b.fid)"),
    "apply_snapshot_changed": _sql(SIDES_SQL, "select o.* from ours o left join base b on b.fid = o.fid where b.fid is null or (b.name, b.value, b.seg) is distinct from (o.name, o.value, o.seg)"),
    "upsert_rows": _sql(PARTS_SQL, "select * from parts where fid not in (select fid from batch) union all select * from batch"),
    "replace_rows": _sql(PARTS_SQL, "select * from batch"),
    "delete_rows": _sql(PARTS_SQL, "select * from parts where fid not in (select fid from batch)"),
    "natural_key_duplicates": "select l_orderkey, l_linenumber, count(*) as n from lineitem where l_orderkey is not null and l_linenumber is not null group by all having count(*) > 1",
    "one_to_one_duplicates": "select o_custkey, count(*) as n from orders where o_custkey is not null group by all having count(*) > 1",
    "fk_orphans": _sql(KIN_SQL, "select * from children c where parent is not null and not exists (select 1 from parents p where p.c_custkey = c.parent)"),
    "fk_semi": _sql(KIN_SQL, "select * from parents p where exists (select 1 from children c where c.parent = p.c_custkey)"),
    "restrict_delete_violations": _sql(KIN_SQL, "select c_custkey from parents p where c_custkey % 5 = 1 and exists (select 1 from children c where c.parent = p.c_custkey)"),
    "row_violations": _sql(TYPED_SQL, f"""
        , named as (select p_partkey, concat_ws(',', case when {BAD['subtype_code']} then 'subtype' end, case when {BAD['subtype_domain']} then 'domain:size' end, case when {BAD['range_domain']} then 'domain:price' end,
                           case when {BAD['required_rule']} then 'rule:has_price' end, case when {BAD['compare_field_rule']} then 'rule:above_floor' end, case when {BAD['compare_literal_rule']} then 'rule:not_seven' end) as violations from rows)
        select p_partkey, violations
        from named where violations <> ''"""),
    "coded_domain": "select o_orderkey, o_orderstatus from orders where not coalesce(o_orderstatus in ('F', 'O'), true)",
    "null_check_vs_istrue": _sql(TYPED_SQL, "select p_partkey, coalesce(size < 25, true) as check_passes, coalesce(size < 25, false) as rule_holds from rows"),
    "compare_lines": """
        with lines as (select l_linenumber, l_discount::decimal(6,2) as discount, l_tax::decimal(6,2) as tax from lineitem)
        select l_linenumber, count(*) as n, sum(discount)::decimal(18,2) as discounts from lines where not coalesce(discount <= tax, false) group by l_linenumber""",
    "insert_defaults": "select p_partkey, (['A', 'B', 'C', 'D'])[(p_partkey % 4 + 1)::integer] as kind, case p_partkey % 4 when 0 then 10 when 1 then 7 when 2 then 7 end::integer as size, p_partkey % 4 <> 3 as known from part",
    "identity_lookup": "select s_suppkey as fid, s_name, case when s_suppkey % 3 = 0 then s_suppkey * 10 end as object_id from supplier",
    "identity_allocate": "select c_custkey as fid, 5000 + row_number() over (order by c_custkey desc) as object_id from customer where c_custkey % 4 <> 0",
    "object_id_text": """
        with made as (select s_suppkey as fid, 2147483647 - 50 + row_number() over (order by s_suppkey) as n from supplier)
        select fid, n::varchar as object_id, case when n < 2147483648 then n end::integer as small from made""",
    "snapshot_measure": _sql(SIDES_SQL, """
        , lines as (select fid, concat_ws('|', fid::varchar, name, value::varchar, seg) as line from features)
        select count(*) as row_count, sum(octet_length(encode(line)))::bigint as row_bytes, sha256('hash:' || string_agg(sha256(line), '' order by fid)) as rows_sha256 from lines"""),
    "snapshot_measure_tree": _sql(SIDES_SQL, """
        , lines as (select fid::varchar as k, '{"fid":"' || fid || '","name":"' || name || '","seg":"' || seg || '","value":"' || value || '"}' as line from features),
        buckets as (select substr(md5(k), 1, 2) as b, count(*) as c, sum(octet_length(encode(line))) as n, sha256(string_agg(sha256(line), '' order by k)) as h from lines group by 1)
        select sum(c)::bigint as row_count, sum(n)::bigint as row_bytes, sha256('hash:tree:' || string_agg(h, '' order by b)) as rows_sha256 from buckets"""),
    "snapshot_verify_copy": _sql(SIDES_SQL, """
        , lines as (
            select fid, lpad(fid::varchar, 12, '0') as k, '{"fid":"' || fid || '","key":"' || lpad(fid::varchar, 12, '0') || '","name":"' || name || '","seg":"' || seg || '","value":"' || value || '"}' as line from features),
        before as (select count(*) as n, sum(octet_length(encode(line)))::bigint as b, sha256('hash:' || string_agg(sha256(line), '' order by k)) as h from lines),
        after as (select count(*) as n, sum(octet_length(encode(line)))::bigint as b, sha256('hash:' || string_agg(sha256(line), '' order by k)) as h from lines where fid % 100 <> 1)
        select x.n as before_row_count, x.b as before_row_bytes, x.h as before_rows_sha256, y.n as after_row_count, y.b as after_row_bytes, y.h as after_rows_sha256, x.h = y.h as intact from before x, after y"""),
    "editor_set_normalize": """
        with e as (select distinct user_id % 50 as branch, md5(event_type) as h from events),
        ids as (select branch, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) as fid from e)
        select branch, string_agg(fid, ',' order by fid) as editors from ids group by branch""",
    "price_percentiles": "select quantile_cont(l_quantity::integer, 0.5)::double as median, quantile_cont(l_quantity::integer, 0.95)::double as p95, count(*) as n from lineitem",
    "point_accessors": "select c_custkey, (c_custkey % 360 - 180)::double as x, (c_custkey % 90)::double as y, null::double as z, c_custkey / 8 as m, 1 as zm, true as valid from customer",
    "session_zone_digest": "with t as (select strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as a from events) select count(*) as n, min(a) as low, max(a) as high from t",
    "empty_measure": "select 0::bigint as row_count, 0::bigint as row_bytes, sha256('hash:') as rows_sha256",
    "bounded_count": "select count(*) as n, count(*) > 100 as above from (select 1 from events limit 101)",
    "source_bytes": "select count(*) as row_count, coalesce(sum(octet_length(encode(props))), 0)::bigint as row_bytes from events",
    "bbox_filter": "select c_custkey from customer where c_custkey % 30000 / 1000 between 0.25 and 1.25 and c_custkey % 10000 / 1000 between 0.1 and 10",
    "bbox_limit": "select count(*) as n from (select c_custkey from customer where c_custkey % 30000 / 1000 between 0.25 and 1.25 and c_custkey % 10000 / 1000 between 0.1 and 10 limit 1000)",
    "outbox_undelivered": "select event_id, event_type from events where event_type not in ('view', 'click')",
    "json_object": "select '{' || string_agg('\"' || r_name || '\":' || r_regionkey, ',' order by r_name) || '}' as regions from region",
    "json_keys": "select unnest(json_keys(props)) as key, count(*) as n from events group by 1",
    "fixture_points": """
        select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) as fid, lpad(id::varchar, 30, 'x') as name, ((id % 1000) / 10)::decimal(14,3) as value
        from (select id, md5('assets' || id) as h from range(1, 2001) t(id))""",
    **{name: _sql(TYPED_SQL, f"select p_partkey from rows where {bad}") for name, bad in BAD.items()},
    **{f"typed_gate_{k}": gate_sql(k) for k in SAMPLES},
} | engine.ORACLE_SQL
