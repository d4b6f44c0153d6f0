"""Headline queries and the branch workload, timed. Prints one line of JSON.

BENCH_SF_DIR: the tables; BENCH_CPUS: threads; BENCH_ROWS: features of the branch workload, in two layers; BENCH_MORE_ROWS:
those of a second, larger one (0: none). Medians and 95th percentiles are over the published numbers of samples."""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from branchstone import queries as core  # noqa: E402
from branchstone.functions.geometry import in_box  # noqa: E402
from branchstone.plans.branches import QUOTA as LIMITS  # noqa: E402
from branchstone.plans.reconcile import Workspace  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
ROWS = int(os.environ.get("BENCH_ROWS", "100000"))
MORE_ROWS = int(os.environ.get("BENCH_MORE_ROWS", "1000000"))
SHARED = tempfile.mkdtemp(prefix="bench-")
QUOTA = {k: high for k, (_, high) in LIMITS.items()}
LAYER = {
    "schema_version": 1,
    "fields": [{"name": "name", "type": "string", "nullable": False, "max_length": 200}, {"name": "value", "type": "decimal", "nullable": False, "precision": 14, "scale": 3}],
    "geometry": {"type": "Point", "srid": 4326, "dimensions": "XYZ", "nullable": False, "allow_empty": False, "require_valid": True},
}
HEADLINE = [
    "merge_outcomes", "merge_candidate", "merge_conflicts", "feature_diff", "apply_snapshot_changed", "apply_snapshot_delete", "upsert_rows", "fk_orphans", "natural_key_duplicates", "row_violations",
    "compare_lines", "identity_allocate", "snapshot_measure", "bbox_filter", "quota_usage", "editor_set_normalize",
]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{SHARED}/checkpoint")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(run: Callable) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def best(run: Callable, times: int = 3) -> float:
    """The least of a few runs, after one that compiles."""
    run()
    return min(timed(run) for _ in range(times))


def features(spark: SparkSession, layer: str, count: int):
    """The generated features of the published workload: name of 30 characters, three decimals, a point with height."""
    n = F.col("id")
    fid = F.regexp_replace(F.md5(F.concat(F.lit(layer), n.cast("string"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    point = F.concat(F.lit("SRID=4326;POINT Z("), (n % 30000 / 1000).cast("string"), F.lit(" "), (n % 10000 / 1000).cast("string"), F.lit(" "), (n % 100).cast("string"), F.lit(")"))
    return spark.range(1, count + 1).select(fid.alias("fid"), F.lpad(n.cast("string"), 30, "x").alias("name"), ((n % 1000) / 10).cast("decimal(14,3)").alias("value"), point.alias("geometry"))


def p95(samples: list[float]) -> float:
    return statistics.quantiles(samples, n=20, method="inclusive")[-1]


def workload(spark: SparkSession, rows: int, prefix: str, branches: int) -> dict[str, float]:
    """Load, branches, box queries, edits, and one changed feature brought back: seconds, medians where there are several.

    Quotas count a branch's rows as if they were copied, so that there are as many branches as they admit."""
    engine, out, new = Workspace(spark, f"{SHARED}/root-{rows}"), {}, lambda: str(uuid.uuid4())
    layers = [engine.create_dataset("assets", "item", "policy", LAYER)]
    group, default = layers[0]["version_group_id"], layers[0]["default_version_id"]
    layers.append(engine.create_dataset("observations", "item", "policy", LAYER, version_group_id=group))
    head = lambda version: engine.store.state(group)["versions"][version]["head"]

    def load() -> None:
        for d in layers:
            engine.load(d["dataset_id"], default, head(default), features(spark, d["managed_name"], rows // 2))

    out["load"] = timed(load)
    engine.configure_branch_quotas(group, QUOTA)
    names = [new() for _ in range(branches)]
    created = [timed(lambda b=b, k=k: engine.create_branch(group, b, f"b{k}", new(), "private", [], new())) for k, b in enumerate(names)]
    out["branch_create_median"], out["branch_create_first"] = statistics.median(created), created[0]
    version, did = (names[0] if names else default), layers[0]["dataset_id"]
    box = lambda: engine.read(did, version).where(in_box("geom", 0, 0, 10, 10)).select("fid").limit(1000).collect()
    box()
    boxes = [timed(box) for _ in range(30)]
    out["bbox_median"], out["bbox_p95"] = statistics.median(boxes), p95(boxes)
    keys = [r.fid for r in engine.read(did, version).select("fid").limit(24).collect()]
    row = {"values": {"name": "edited", "value": "1.5"}, "geometry": "SRID=4326;POINT Z(1 2 3)"}
    edit = lambda v, k: engine.edit(v, head(v), did, "update", k, row)
    edit(version, keys[23])
    edits = [timed(lambda k=k: edit(version, k)) for k in keys[:20]]
    out["edit_median"], out["edit_p95"] = statistics.median(edits), p95(edits)
    if len(names) > 1:
        edit(names[1], keys[20])
        plans: list[str] = []
        out["reconcile_prepare"] = timed(lambda: plans.append(engine.prepare_reconcile(names[1])))
        out["reconcile_accept"] = timed(lambda: engine.accept_reconcile(group, plans[0]))
        plan = engine.plan(group, plans[0])
        out["reconcile_post"] = timed(lambda: engine.post(group, plans[0], plan["accepted_head"], plan["target_head"], new(), "me"))
    if len(names) > 2:
        # the same when DEFAULT has moved too: every row of one layer is merged
        edit(names[2], keys[21])
        edit(default, keys[22])
        out["reconcile_prepare_both_moved"] = timed(lambda: plans.append(engine.prepare_reconcile(names[2])))
        out["reconcile_accept_both_moved"] = timed(lambda: engine.accept_reconcile(group, plans[1]))
    return {f"{prefix}_{k}": round(v, 4) for k, v in out.items()}


def main() -> None:
    spark = session()
    try:
        found = {name: round(best(lambda q=core.QUERIES[name]: q(spark, SF_DIR).write.format("noop").mode("overwrite").save()), 4) for name in HEADLINE}
        workload(spark, 20_000, "warm", 3)  # the published figures are warm ones
        found |= workload(spark, ROWS, "workload", 10)
        more = workload(spark, MORE_ROWS, "workload_1m", 1) if MORE_ROWS else {}
        try:
            from branchstone.llm import queries as llm
        except ImportError:
            llm = None
        if llm is not None:
            found |= {name: round(timed(lambda q=q: q(spark, SF_DIR).write.format("noop").mode("overwrite").save()), 4) for name, q in llm.QUERIES.items()}
        print(json.dumps({"metric": "total_seconds", "value": round(sum(v for k, v in found.items() if not k.endswith(("_p95", "_first"))), 4), "unit": "sec", "queries": found | more, "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf") or 0), "workload_rows": ROWS, "cpus": CPUS}))
    finally:
        spark.stop()
        shutil.rmtree(SHARED, ignore_errors=True)


if __name__ == "__main__":
    main()
