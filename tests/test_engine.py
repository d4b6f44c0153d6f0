"""The engine end to end on a root folder of its own: exact states, exact error codes, nothing left of what failed."""

import json
import shutil
import threading
import uuid
from datetime import date, datetime, timezone
from decimal import Decimal

import pytest

from branchstone.operators.identity import object_id_int32
from branchstone.plans.branches import QUOTA as LIMITS
from branchstone.plans.reconcile import Workspace
from branchstone.queries import PART_DEFINITION
from branchstone.sources.batch import read_batch
from branchstone.sources.log import EngineError, Log, migrate
from branchstone.streaming.outbox import outbox
from tests.fixtures import WELLS, changed


def fid(n):
    return str(uuid.UUID(int=n))


def row(n, tag="x", depth="1.5", geometry="SRID=3857;POINT Z(1 2 3)"):
    return {"fid": fid(n), "values": {"tag": tag, "depth": depth}, "geometry": geometry}


@pytest.fixture
def engine(spark, tmp_path):
    return Workspace(spark, str(tmp_path / "root"))


@pytest.fixture
def ds(engine):
    return engine.create_dataset("assets", "item", "policy", WELLS)


def code(call, *args, **named):
    with pytest.raises(EngineError) as e:
        call(*args, **named)
    return e.value.code


def head(engine, d):
    return engine.export_schema(d["dataset_id"])["head_revision"]


def put(engine, d, rows, replace=False):
    return engine.apply_rows(d["dataset_id"], d["default_version_id"], head(engine, d), rows, replace)


def state(engine, d, *columns):
    return {r.fid: tuple(r)[1:] for r in engine.read(d["dataset_id"]).select("fid", *(columns or ("tag", "depth"))).collect()}


def test_write_read_and_identities(engine, ds):
    put(engine, ds, [row(1, "a"), row(2, None, "-0.25")])
    assert state(engine, ds) == {fid(1): ("a", Decimal("1.50")), fid(2): (None, Decimal("-0.25"))}
    before = state(engine, ds, "object_id", "feature_revision")
    put(engine, ds, [row(2, "b"), row(3), row(1, "a")])
    after = state(engine, ds, "object_id", "feature_revision")
    assert [after[fid(n)][0] for n in (1, 2, 3)] == [1, 2, 3]
    assert after[fid(1)][1] != before[fid(1)][1]  # a new revision even of equal values
    put(engine, ds, [], replace=True)
    assert state(engine, ds) == {} and engine.identities(ds["dataset_id"]).count() == 3
    put(engine, ds, [row(3), row(4)])
    assert state(engine, ds, "object_id") == {fid(3): (3,), fid(4): (4,)}
    assert engine.export_identity(ds["dataset_id"], fid(4).upper()) == {"fid": fid(4), "object_id": "4"}
    assert object_id_int32(4) == 4
    with pytest.raises(ValueError):
        object_id_int32(2**31)


def test_layers_compact(engine, ds, monkeypatch):
    monkeypatch.setattr("branchstone.sources.layers.KEPT", 2)
    for k in range(6):
        put(engine, ds, [row(1, str(k)), row(10 + k)])
    assert state(engine, ds, "tag")[fid(1)] == ("5",) and len(state(engine, ds)) == 7


BAD_ROWS = [
    ({**row(1), "more": 1}, "INVALID_FEATURE_ROW"), ({"fid": fid(1), "values": {}}, "INVALID_FEATURE_ROW"), (row(1) | {"fid": "x"}, "INVALID_FEATURE_ROW"), (row(1) | {"values": []}, "INVALID_FEATURE_ROW"),
    (row(1) | {"values": {"tag": "x"}}, "FIELD_SET_MISMATCH"), (row(1) | {"values": {"tag": "x", "depth": "1", "z": 1}}, "FIELD_SET_MISMATCH"), (row(1, depth=None), "NULL_NOT_ALLOWED"), (row(1, tag=5), "INVALID_TYPED_VALUE"),
    (row(1, depth=1.5), "INVALID_TYPED_VALUE"), (row(1, depth="1.111"), "INVALID_TYPED_VALUE"), (row(1, tag="1234567"), "CONSTRAINT_VIOLATION"), (row(1, geometry="POINT Z(1 2 3)"), "INVALID_GEOMETRY_INPUT"), (row(1, geometry=5), "INVALID_GEOMETRY_INPUT"),
    (row(1, geometry="SRID=3857;POINT Z(a b c)"), "INVALID_GEOMETRY_INPUT"), (row(1, geometry=None), "CONSTRAINT_VIOLATION"), (row(1, geometry="SRID=0;POINT Z(1 2 3)"), "CONSTRAINT_VIOLATION"), (row(1, geometry="SRID=3857;POINT(1 2)"), "CONSTRAINT_VIOLATION"),
    (row(1, geometry="SRID=3857;POINT Z EMPTY"), "CONSTRAINT_VIOLATION"), (row(1, geometry="SRID=3857;POINT Z(NaN 1 2)"), "CONSTRAINT_VIOLATION"), (row(1, geometry="SRID=3857;LINESTRING Z(0 0 0,1 1 1)"), "CONSTRAINT_VIOLATION"),
]


def test_refused_rows_leave_nothing(engine, ds):
    put(engine, ds, [row(7, "😀😀😀😀😀😀")])
    before, h = state(engine, ds), head(engine, ds)
    for bad, why in BAD_ROWS:
        assert code(put, engine, ds, [row(8), bad]) == why, bad
    assert code(put, engine, ds, [row(1), row(1)]) == "DUPLICATE_FEATURE_UUID"
    assert code(put, engine, ds, [row(1, tag="1234567"), row(2, depth=1)]) == "CONSTRAINT_VIOLATION"  # the first wrong row counts
    assert code(put, engine, ds, [row(k) for k in range(10_001)]) == "MANAGED_BATCH_LIMIT"
    assert (state(engine, ds), head(engine, ds)) == (before, h)
    assert engine.identities(ds["dataset_id"]).count() == 1


def test_heads_and_versions(engine, ds):
    old = head(engine, ds)
    put(engine, ds, [row(1)])
    other = engine.create_dataset("other", "item", "policy", WELLS)
    assert code(engine.apply_rows, ds["dataset_id"], ds["default_version_id"], old, [row(2)]) == "STALE_HEAD"
    assert code(engine.apply_rows, ds["dataset_id"], other["default_version_id"], old, [row(2)]) == "DATASET_VERSION_MISMATCH"
    assert code(engine.apply_rows, ds["dataset_id"], ds["default_version_id"], None, []) == "INVALID_MANAGED_REQUEST"
    for edits, why in (([], "INVALID_MANAGED_GROUP"), ([{}], "INVALID_MANAGED_GROUP_EDIT"), ([{"dataset_id": ds["dataset_id"], "rows": [], "replace": False}] * 2, "DUPLICATE_DATASET_EDIT"), ([{"dataset_id": other["dataset_id"], "rows": [], "replace": False}], "DATASET_VERSION_MISMATCH")):
        assert code(engine.apply_group, ds["default_version_id"], head(engine, ds), edits) == why
    h = head(engine, ds)
    assert engine.apply_group(ds["default_version_id"], h, [{"dataset_id": ds["dataset_id"], "rows": [], "replace": False}]) != h  # legal, and moves the head
    added = engine.create_dataset("second", "item", "policy", WELLS, version_group_id=ds["version_group_id"])
    assert added["head_revision"] == head(engine, ds) and added["schema_generation"] == added["group_schema_generation"] == 2


def test_racing_writers(engine, ds, spark, tmp_path):
    h, results = head(engine, ds), []

    def write(n):
        try:
            results.append(Workspace(spark, str(tmp_path / "root")).apply_rows(ds["dataset_id"], ds["default_version_id"], h, [row(n)]))
        except EngineError as e:
            results.append(e.code)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r == "STALE_HEAD" for r in results) == [False, True, True, True]
    assert len(state(engine, ds)) == 1


def test_every_type_keeps_its_values(engine):
    """One field a type, at the ends of their ranges, and one literal of each that is refused."""
    kinds = {"string": ("𝄞 tab\t", "𝄞 tab\t", 5), "int32": (2**31 - 1, 2**31 - 1, "1"), "int64": (str(-(2**63)), -(2**63), -1), "decimal": ("-99.5000", Decimal("-99.500"), "100"), "boolean": (False, False, 0), "uuid": (str(uuid.UUID(int=2**127)).upper(), str(uuid.UUID(int=2**127)), "{}"), "date": ("9999-12-31", date(9999, 12, 31), "9999-12-32"), "timestamp": ("1969-12-31T23:59:59.999999Z", datetime(1969, 12, 31, 23, 59, 59, 999999, timezone.utc), "1969-12-31T23:59:59")}
    traits = {"string": {"max_length": 9}, "decimal": {"precision": 5, "scale": 3}}
    definition = {"schema_version": 1, "geometry": None, "fields": [{"name": f"a_{k}", "type": k, "nullable": k == "uuid", **traits.get(k, {})} for k in kinds]}
    d = engine.create_dataset("every", "item", "policy", definition)
    good = {f"a_{k}": v[0] for k, v in kinds.items()}
    put(engine, d, [{"fid": fid(1), "values": good}, {"fid": fid(2), "values": good | {"a_uuid": None}}])
    rows = {r.fid: r for r in engine.read(d["dataset_id"]).selectExpr("*", "unix_micros(a_timestamp) as micros").collect()}
    for k, (_, worth, _) in kinds.items():
        assert k == "timestamp" or rows[fid(1)][f"a_{k}"] == worth, k
    assert rows[fid(1)].micros == -1 and rows[fid(2)].a_uuid is None
    for k, (_, _, bad) in kinds.items():
        assert code(put, engine, d, [{"fid": fid(3), "values": good | {f"a_{k}": bad}}]) == "INVALID_TYPED_VALUE", k


def test_defaults_subtypes_and_rules(engine):
    definition = changed(PART_DEFINITION, ["rules"], [PART_DEFINITION["rules"][1]])
    d = engine.create_dataset("parts", "item", "policy", definition)
    put(engine, d, [{"fid": fid(1), "values": {"kind": "A", "price": "950.00", "floor": "1"}}, {"fid": fid(2), "values": {"kind": "B", "price": "950", "floor": "950"} | {"size": None}}])
    assert state(engine, d, "kind", "size") == {fid(1): ("A", 10), fid(2): ("B", None)}
    assert code(put, engine, d, [{"fid": fid(1), "values": {"kind": "A", "price": "950", "floor": "1"}}]) == "FIELD_SET_MISMATCH"
    for values, why in (({"kind": "Z"}, "INVALID_SUBTYPE"), ({}, "INVALID_SUBTYPE"), ({"kind": "A", "size": 21, "price": "950", "floor": "1"}, "CONSTRAINT_VIOLATION"), ({"kind": "A", "price": "950", "floor": None}, "CONSTRAINT_VIOLATION"), ({"kind": "A", "price": "919.99", "floor": "1"}, "CONSTRAINT_VIOLATION")):
        assert code(put, engine, d, [{"fid": fid(3), "values": values}]) == why, values
    assert len(state(engine, d, "kind")) == 2


def test_update_needs_all_fields(engine):
    d = engine.create_dataset("parts", "item", "policy", PART_DEFINITION)
    whole = {"kind": "A", "price": "950", "floor": "1"}
    put(engine, d, [{"fid": fid(1), "values": whole}])
    assert code(put, engine, d, [{"fid": fid(1), "values": whole}]) == "FIELD_SET_MISMATCH"


def kin(engine):
    v2 = {"schema_version": 2, "geometry": None, "subtypes": None, "relationships": [], "rules": []}
    parent = engine.create_dataset("parent", "item", "policy", v2 | {"fields": [{"name": "name", "type": "string", "nullable": False, "max_length": 9}]}, natural_key=["name"])
    relation = {"name": "of", "field": "parent", "target_dataset": parent["dataset_id"], "cardinality": "one-to-one", "on_delete": "restrict"}
    child = engine.create_dataset("child", "item", "policy", v2 | {"fields": [{"name": "parent", "type": "uuid", "nullable": True}], "relationships": [relation]}, version_group_id=parent["version_group_id"])
    return parent, child


def group(engine, parent, child, parents, children, replace=False):
    edits = [{"dataset_id": child["dataset_id"], "rows": [{"fid": fid(f), "values": {"parent": p and fid(p)}} for f, p in children], "replace": replace}, {"dataset_id": parent["dataset_id"], "rows": [{"fid": fid(f), "values": {"name": n}} for f, n in parents], "replace": replace}]
    return engine.apply_group(parent["default_version_id"], head(engine, parent), edits)


def test_relationships_are_checked_at_the_end(engine):
    parent, child = kin(engine)
    group(engine, parent, child, [(1, "a"), (2, "b")], [(11, 1), (12, None), (13, None)])  # children come first
    assert code(group, engine, parent, child, [], [(12, 9)]) == "RELATIONSHIP_VIOLATION"
    assert code(group, engine, parent, child, [], [(12, 1)]) == "RELATIONSHIP_VIOLATION"  # one to one
    assert code(put, engine, parent, [{"fid": fid(2), "values": {"name": "b"}}], replace=True) == "RELATIONSHIP_VIOLATION"  # restrict
    assert code(put, engine, parent, [{"fid": fid(3), "values": {"name": "b"}}]) == "NATURAL_KEY_VIOLATION"
    group(engine, parent, child, [(1, "b"), (2, "a")], [])  # names swapped within one batch
    group(engine, parent, child, [(2, "a")], [(11, 2)], replace=True)  # parent and child go together
    assert state(engine, parent, "name") == {fid(2): ("a",)} and state(engine, child, "parent") == {fid(11): (fid(2),)}


def test_schema_revision(engine):
    d = engine.create_dataset("parts", "item", "policy", PART_DEFINITION)
    put(engine, d, [{"fid": fid(1), "values": {"kind": "A", "price": "950", "floor": "1"}}])
    d = engine.export_schema(d["dataset_id"])
    same = engine.revise_schema(d, PART_DEFINITION)
    assert same["schema_sha256"] == d["schema_sha256"]
    d = same
    assert code(engine.revise_schema, d, changed(PART_DEFINITION, ["fields", 0, "max_length"], 50)) == "PHYSICAL_SCHEMA_CHANGE_REQUIRES_MIGRATION"
    assert code(engine.revise_schema, d, changed(PART_DEFINITION, ["fields", 2, "domain", "min"], "960.00")) == "CONSTRAINT_VIOLATION"
    revised = engine.revise_schema(d, changed(PART_DEFINITION, ["fields", 2, "domain", "min"], "940.00"))
    assert revised["schema_generation"] == d["schema_generation"] + 1
    assert code(engine.revise_schema, d, PART_DEFINITION) == "STALE_SCHEMA"
    assert code(engine.create_dataset, "Bad", "item", "policy", WELLS) == "INVALID_DEFINITION"


BYTES = 50_000
QUOTA = {name: BYTES if name.endswith("_bytes") else 60 for name in LIMITS} | {"max_branches": 2, "max_attachment_bytes": 0, "max_idle_seconds": 3600}


def branch_of(engine, d, n=100, name="work", **more):
    args = {"visibility": "private", "editors": [], "operation": fid(n + 1000)} | more
    return engine.create_branch(d["version_group_id"], fid(n), name, fid(5), args["visibility"], args["editors"], args["operation"])


def test_branch_life_cycle(engine, ds):
    g = ds["version_group_id"]
    put(engine, ds, [row(1), row(2)])
    assert code(branch_of, engine, ds) == "BRANCH_QUOTAS_REQUIRED"
    for bad in (QUOTA | {"max_branches": 101}, QUOTA | {"max_attachment_bytes": 1}, {"max_branches": 1}, QUOTA | {"max_source_rows": True}):
        assert code(engine.configure_branch_quotas, g, bad) == "INVALID_BRANCH_QUOTAS"
    engine.configure_branch_quotas(g, QUOTA)
    assert code(branch_of, engine, ds, name="Bad") == "INVALID_BRANCH_REQUEST"
    assert code(branch_of, engine, ds, visibility="shared") == "INVALID_BRANCH_VISIBILITY"
    b = branch_of(engine, ds)
    assert b["state"] == "active" and branch_of(engine, ds)["revision"] == b["revision"]  # the same operation again
    assert code(branch_of, engine, ds, name="other") == "BRANCH_OPERATION_CONFLICT"
    snapshot = engine.store.state(g)["snapshots"][b["base_snapshot_id"]]["datasets"][ds["dataset_id"]]
    assert snapshot["row_count"] == 2 and snapshot["row_bytes"] > 0 and len(snapshot["rows_sha256"]) == 64
    second = branch_of(engine, ds, 101, "second", visibility="shared", editors=[fid(8).upper(), fid(7), fid(8)])
    assert second["editors"] == [fid(7), fid(8)]
    assert code(branch_of, engine, ds, 102, "third") == "BRANCH_COUNT_QUOTA"
    assert [x["name"] for x in engine.branches(g)] == ["work", "second"]
    assert code(engine.configure_branch_quotas, g, QUOTA | {"max_current_rows": 3}) == "QUOTA_BELOW_RETAINED_USAGE"
    assert code(engine.revise_schema, engine.export_schema(ds["dataset_id"]), changed(WELLS, ["fields", 0, "nullable"], False)) == "ACTIVE_BRANCH_SCHEMA_CHANGE_UNSUPPORTED"
    assert code(engine.update_branch, fid(100), fid(1), "renamed", "private", []) == "STALE_BRANCH_METADATA"
    b = engine.update_branch(fid(100), b["revision"], "renamed", "organization", [])
    assert code(engine.transition_branch, fid(100), b["revision"], "deleted") == "INVALID_BRANCH_TRANSITION"
    b = engine.transition_branch(fid(100), b["revision"], "archived")
    assert code(engine.update_branch, fid(100), b["revision"], "x", "private", []) == "BRANCH_NOT_ACTIVE"
    engine.pin_snapshot(g, b["base_snapshot_id"], "publication", fid(77))
    assert code(engine.transition_branch, fid(100), b["revision"], "deletion_pending") == "RETAINED_SNAPSHOT_REFERENCE"
    s = engine.transition_branch(fid(101), second["revision"], "deletion_pending")
    s = engine.transition_branch(fid(101), s["revision"], "deleted")
    assert s["name"] == "second" and engine.store.state(g)["versions"][fid(101)]["name"].startswith("_deleted_")
    assert engine.branch(fid(101)) is None and engine.branch(fid(101), True)["state"] == "deleted"
    assert engine.store.state(g)["quota"]["current_rows"] == 4  # deleting frees no quota
    assert branch_of(engine, ds, 103, "second")["state"] == "active"  # but the name
    engine.check_invariants(g)


def test_branch_bounds_and_failures(engine, ds):
    g = ds["version_group_id"]
    put(engine, ds, [row(k) for k in range(5)])
    for limits, why in (({"max_source_rows": 4}, "BRANCH_SOURCE_BOUND"), ({"max_source_bytes": 10}, "BRANCH_SOURCE_BOUND"), ({"max_current_rows": 4}, "BRANCH_STORAGE_QUOTA")):
        engine.configure_branch_quotas(g, QUOTA | limits)
        n = 200 + len(engine.store.state(g)["branches"])
        assert code(branch_of, engine, ds, n, f"b{n}") == why
        failed = engine.branch(fid(n), True)
        assert failed["state"] == "creation_failed" and failed["failure_code"] == "copy_failed"
    engine.configure_branch_quotas(g, QUOTA)
    b = engine.reserve_branch(g, fid(300), "slow", fid(5), "private", [], fid(301))
    assert engine.cancel_branch(fid(300), b["revision"])["failure_code"] == "cancelled"
    assert code(engine.populate_branch, fid(300), engine.branch(fid(300), True)["revision"]) == "BRANCH_NOT_CREATING"
    engine.check_invariants(g)


def value(name):
    return {"values": {"tag": name, "depth": "1"}, "geometry": "SRID=3857;POINT Z(1 2 3)"}


def names(engine, d, version=None):
    return {int(uuid.UUID(r.fid)): r.tag for r in engine.read(d["dataset_id"], version).collect()}


def test_reconcile_resolve_accept_post(engine, ds):
    g, did, default = ds["version_group_id"], ds["dataset_id"], ds["default_version_id"]
    engine.configure_branch_quotas(g, QUOTA)
    put(engine, ds, [row(k, f"n{k}") for k in range(1, 6)])
    b = branch_of(engine, ds)
    bid, h = fid(100), b["head_revision"]
    for op, n, v in (("update", 1, "ours"), ("update", 2, "ours"), ("delete", 3, None), ("insert", 9, "new"), ("delete", 4, None)):
        h = engine.edit(bid, h, did, op, fid(n), v and value(v))
    assert code(engine.edit, bid, b["head_revision"], did, "delete", fid(1)) == "STALE_BRANCH_HEAD"
    assert code(engine.edit, bid, h, did, "delete", fid(77)) == "UNKNOWN_FEATURE"
    assert code(engine.edit, bid, h, did, None, fid(1), value("x")) == "INVALID_OPERATION"
    put(engine, ds, [row(1, "theirs"), row(3, "theirs"), row(5, "theirs")])
    assert code(engine.prepare_reconcile, default) == "DEFAULT_IS_NOT_BRANCH"
    plan = engine.prepare_reconcile(bid)
    found = {int(uuid.UUID(r.fid)): (r.outcome, r.conflict_fields) for r in engine.plan_conflicts(g, plan, did).collect()}
    assert found == {1: ("field", ["tag"]), 3: ("existence", ["existence"])}
    assert code(engine.accept_reconcile, g, plan) == "UNRESOLVED_CONFLICT"
    assert code(engine.resolve_conflict, g, plan, did, fid(1), None) == "INVALID_RESOLUTION"
    assert code(engine.resolve_conflict, g, plan, did, fid(2), "ours") == "UNKNOWN_CONFLICT"
    assert engine.resolve_conflict(g, plan, did, fid(1), "base") is False
    assert code(engine.resolve_conflict, g, plan, did, fid(1), "base") == "UNKNOWN_CONFLICT"
    assert engine.resolve_conflict(g, plan, did, fid(3), "ours") is True  # absent
    gone, written = engine.changes_to_apply(g, plan, did)
    assert gone.count() == 0 and {int(uuid.UUID(r.fid)) for r in written.collect()} == {1, 5}
    accepted = engine.accept_reconcile(g, plan)
    want = {1: "n1", 2: "ours", 5: "theirs", 9: "new"}
    assert names(engine, ds, bid) == want and names(engine, ds)[1] == "theirs"
    assert code(engine.accept_reconcile, g, plan) == "INVALID_PLAN_STATE"  # accepted, and nothing has moved
    target = engine.plan(g, plan)["target_head"]
    assert code(engine.post, g, plan, fid(1), target, fid(50), "me") == "STALE_RECONCILE"
    posted = engine.post(g, plan, accepted, target, fid(50), "me")
    assert names(engine, ds) == want and head(engine, ds) == posted
    assert engine.post(g, plan, accepted, target, fid(50), "me") == posted  # replayed
    assert code(engine.accept_reconcile, g, plan) == code(engine.post, g, plan, accepted, target, fid(51), "me") == "STALE_RECONCILE"  # staleness comes before status
    assert code(engine.post, g, plan, accepted, target, fid(50), "you") == "IDEMPOTENCY_CONFLICT"
    assert state(engine, ds, "object_id")[fid(1)] == (1,)
    events = engine.events(g)
    assert [e["kind"] for e in events] == ["create", *["edit"] * 5, "prepare", "resolve", "resolve", "accept", "post", "checkpoint"]
    assert [e["event_id"] for e in events] == list(range(1, 13)) and not any(e["delivered"] for e in events)
    assert engine.diff(did, bid, engine.branch(bid)["base_snapshot_id"]).count() == 0
    engine.check_invariants(g)


def test_plans_go_stale(engine, ds):
    g, did = ds["version_group_id"], ds["dataset_id"]
    engine.configure_branch_quotas(g, QUOTA)
    put(engine, ds, [row(1)])
    h = branch_of(engine, ds)["head_revision"]
    plan = engine.prepare_reconcile(fid(100))
    put(engine, ds, [row(2)])
    assert code(engine.accept_reconcile, g, plan) == "STALE_RECONCILE"
    plan = engine.prepare_reconcile(fid(100))
    engine.edit(fid(100), h, did, "update", fid(1), value("moved"))
    assert code(engine.accept_reconcile, g, plan) == "STALE_RECONCILE"
    assert code(engine.plan, g, fid(1)) == "UNKNOWN_PLAN"


def test_natural_keys_of_the_merge(engine):
    definition = {"schema_version": 1, "geometry": None, "fields": [{"name": "name", "type": "string", "nullable": False, "max_length": 9}]}
    d = engine.create_dataset("named", "item", "policy", definition, natural_key=["name"])
    engine.configure_branch_quotas(d["version_group_id"], QUOTA)
    h = branch_of(engine, d)["head_revision"]
    engine.edit(fid(100), h, d["dataset_id"], "insert", fid(1), {"values": {"name": "same"}})
    put(engine, d, [{"fid": fid(2), "values": {"name": "same"}}])
    assert code(engine.prepare_reconcile, fid(100)) == "NATURAL_KEY_VIOLATION"
    assert engine.store.state(d["version_group_id"])["plans"] == {}


def test_snapshot_is_immutable_and_reads_are_pinned(engine, ds):
    engine.configure_branch_quotas(ds["version_group_id"], QUOTA)
    put(engine, ds, [row(1, "old")])
    b, pinned = branch_of(engine, ds), engine.read(ds["dataset_id"])
    put(engine, ds, [row(1, "new"), row(2)])
    assert [r.tag for r in pinned.collect()] == ["old"]
    assert [r.tag for r in engine.read_snapshot(ds["dataset_id"], b["base_snapshot_id"]).collect()] == ["old"]


def test_outbox_streams_every_event_once(engine, ds, spark, tmp_path):
    engine.configure_branch_quotas(ds["version_group_id"], QUOTA)
    h = branch_of(engine, ds)["head_revision"]

    def drain():
        q = outbox(engine.store).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(json.loads(line)["event_id"] for p in (tmp_path / "out").glob("*.json") for line in p.read_text().splitlines())

    assert drain() == [1]
    engine.edit(fid(100), h, ds["dataset_id"], "insert", fid(1), value("x"))
    assert drain() == [1, 2]
    assert drain() == [1, 2]


def test_unknown_names(engine, ds):
    assert code(engine.export_schema, fid(1)) == "UNKNOWN_DATASET"
    assert code(engine.read, ds["dataset_id"], fid(1)) == "UNKNOWN_VERSION"
    assert code(engine.branch, fid(1)) == "UNKNOWN_BRANCH"
    assert code(engine.store.state, fid(1)) == "UNKNOWN_VERSION_GROUP"


def test_bulk_load(engine, ds, spark):
    def frame(low, high, name="n"):
        return spark.range(low, high).selectExpr("lpad(hex(id), 8, '0') || '-0000-0000-0000-000000000000' as fid", f"'{name}' || id as tag", "cast(id as decimal(9,2)) as depth", "'SRID=3857;POINT Z(' || id || ' 1 2)' as geometry").repartition(3)

    did, v = ds["dataset_id"], ds["default_version_id"]
    engine.load(did, v, head(engine, ds), frame(0, 30))
    before = state(engine, ds, "object_id")
    assert sorted(x[0] for x in before.values()) == list(range(1, 31))
    engine.load(did, v, head(engine, ds), frame(20, 40, "m"))
    after = state(engine, ds, "object_id", "tag")
    assert len(after) == 40 and all(after[k][0] == n for k, (n,) in before.items()) and sorted(x[0] for x in after.values()) == list(range(1, 41))
    assert sum(x[1].startswith("m") for x in after.values()) == 20
    put(engine, ds, [row(1)])
    assert len(state(engine, ds)) == 41
    old = state(engine, ds)
    assert code(engine.load, did, v, head(engine, ds), frame(0, 5).unionAll(frame(0, 5))) == "DUPLICATE_FEATURE_UUID"
    assert code(engine.load, did, v, head(engine, ds), frame(0, 5).drop("tag")) == "FIELD_SET_MISMATCH"
    assert code(engine.load, did, v, head(engine, ds), frame(0, 5, "much too long")) == "CONSTRAINT_VIOLATION"
    assert code(engine.load, did, v, head(engine, ds), frame(0, 5).selectExpr("'x' as fid", "tag", "depth", "geometry")) == "INVALID_FEATURE_ROW"
    assert state(engine, ds) == old
    engine.load(did, v, head(engine, ds), frame(0, 2), replace=True)
    assert len(state(engine, ds)) == 2


def test_capture_and_backup(engine, ds, spark, tmp_path):
    put(engine, ds, [row(1, "old")])
    snapshot = engine.capture(ds["version_group_id"], ds["default_version_id"])
    put(engine, ds, [row(1, "new")])
    assert [r.tag for r in engine.read_snapshot(ds["dataset_id"], snapshot).collect()] == ["old"]
    assert code(engine.capture, ds["version_group_id"], fid(1)) == "UNKNOWN_VERSION"
    shutil.copytree(tmp_path / "root", tmp_path / "copy")  # names within a root are relative
    restored = Workspace(spark, f"file://{tmp_path}/copy")
    assert restored.export_schema(ds["dataset_id"]) == engine.export_schema(ds["dataset_id"])
    put(restored, ds, [row(2)])
    assert len(state(restored, ds)) == 2 and len(state(engine, ds)) == 1


def test_format_history(spark, tmp_path):
    log = Log(spark, str(tmp_path / "root"))
    assert (migrate(log, ["a"]), migrate(log, ["a"]), migrate(log, ["a", "b"])) == (1, 0, 1)
    for steps in (["a"], ["b", "a"], ["a", "c"]):
        assert code(migrate, log, steps) == "MIGRATION_IDENTITY_MISMATCH"
    other = Log(spark, str(tmp_path / "other"))
    other.create("groups/g/log/1.json", {})
    assert code(migrate, other, ["a"]) == "UNMARKED_SCHEMA_ADOPTION_UNSUPPORTED"


def test_json_batches(engine, ds):
    text = json.dumps([row(1, "é")])
    put(engine, ds, read_batch(text))
    assert state(engine, ds, "tag") == {fid(1): ("é",)}
    for bad in ("{}", "[1", "[NaN]"):
        assert code(read_batch, bad) == "INVALID_MANAGED_REQUEST"
    assert code(read_batch, "[" + " " * 99 + "]", 50) == "MANAGED_BATCH_LIMIT"


def test_log_through_hadoop(spark, tmp_path):
    log = Log(spark, str(tmp_path / "root"))
    log.local = None  # as for a root that only Hadoop's file systems reach
    assert log.names("a/b") == []
    assert log.create("a/b/1.json", {"x": "é"}) and log.create("a/b/2.json", [1])
    assert log.names("a/b") == ["1.json", "2.json"]
    assert log.read("a/b/1.json") == {"x": "é"} and log.read("a/b/2.json") == [1]


def test_sets_are_checked_by_what_a_batch_touches(engine):
    parent, child = kin(engine)
    engine.configure_branch_quotas(parent["version_group_id"], QUOTA | {k: 1000 for k in QUOTA if k.endswith("_rows")})
    group(engine, parent, child, [(k, f"p{k}") for k in range(1, 160)], [(1000 + k, k) for k in range(1, 140)])
    assert code(group, engine, parent, child, [], [(2000, 5)]) == "RELATIONSHIP_VIOLATION"  # taken by another row
    assert code(group, engine, parent, child, [], [(2000 + k, 5000 + k) for k in range(120)]) == "RELATIONSHIP_VIOLATION"
    assert code(group, engine, parent, child, [(900, "p7")], []) == "NATURAL_KEY_VIOLATION"
    h = branch_of(engine, parent)["head_revision"]
    assert code(engine.edit, fid(100), h, parent["dataset_id"], "delete", fid(3)) == "RELATIONSHIP_VIOLATION"
    h = engine.edit(fid(100), h, parent["dataset_id"], "delete", fid(150))
    h = engine.edit(fid(100), h, child["dataset_id"], "update", fid(1003), {"values": {"parent": None}})
    h = engine.edit(fid(100), h, parent["dataset_id"], "delete", fid(3))
    assert code(engine.edit, fid(100), h, child["dataset_id"], "update", fid(1003), {"values": {"parent": fid(3)}}) == "RELATIONSHIP_VIOLATION"
    engine.edit(fid(100), h, child["dataset_id"], "update", fid(1003), {"values": {"parent": fid(151)}})


def test_lookups_prune_row_groups(engine, ds, spark):
    put(engine, ds, [row(k) for k in range(500)])
    plan = engine._among(engine.read(ds["dataset_id"]), {fid(7)})._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(fid), EqualTo(fid" in plan


def test_ids_are_unique_over_all_groups(engine, ds):
    """An id that another group has is refused, and leaves nothing in the group that asked."""
    other = engine.create_dataset("elsewhere", "item", "policy", WELLS)
    for d in (ds, other):
        engine.configure_branch_quotas(d["version_group_id"], QUOTA)
    branch_of(engine, ds)
    before = engine.store.state(other["version_group_id"])
    assert code(branch_of, engine, other, 100, operation=fid(555)) == "DUPLICATE_VERSION"
    assert engine.store.state(other["version_group_id"]) == before
    assert branch_of(engine, other, 101)["state"] == "active"
    assert code(engine.create_dataset, "again", "item", "policy", WELLS, dataset_id=ds["dataset_id"]) == "DUPLICATE_DATASET"
    assert code(engine.reserve_branch, ds["version_group_id"], fid(102), "work", fid(5), "private", [], fid(9)) == "DUPLICATE_BRANCH_NAME"
    assert code(engine.branch, fid(102)) == "UNKNOWN_BRANCH"  # what was refused has no id
    assert engine.reserve_branch(other["version_group_id"], fid(102), "late", fid(5), "private", [], fid(9))["state"] == "creating"


def test_a_crash_between_claim_and_commit_blocks_nobody(engine, ds, monkeypatch):
    lost = fid(42)
    engine.store.claim("dataset", lost, fid(43))  # its group was never committed
    assert code(engine.export_schema, lost) == "UNKNOWN_DATASET"
    assert code(engine.create_dataset, "mine", "item", "policy", WELLS, dataset_id=lost) == "DUPLICATE_DATASET"
    monkeypatch.setattr("branchstone.sources.log.STALE_CLAIM", -1)
    assert engine.create_dataset("mine", "item", "policy", WELLS, dataset_id=lost)["dataset_id"] == lost
    assert code(engine.create_dataset, "yours", "item", "policy", WELLS, dataset_id=lost) == "DUPLICATE_DATASET"


def test_known_reference_systems(spark, engine, tmp_path):
    for srid in (998_998, 1, 999):
        assert code(engine.create_dataset, "far", "item", "policy", changed(WELLS, ["geometry", "srid"], srid)) == "UNKNOWN_SRID"
    for srid in (4326, 2230, 32633):
        engine.create_dataset("near", "item", "policy", changed(WELLS, ["geometry", "srid"], srid))
    own = Workspace(spark, str(tmp_path / "own"), srids={998_998})
    assert own.create_dataset("far", "item", "policy", changed(WELLS, ["geometry", "srid"], 998_998))
    assert code(own.create_dataset, "near", "item", "policy", WELLS) == "UNKNOWN_SRID"


def test_descriptor(engine, ds):
    d = engine.export_schema(ds["dataset_id"])
    assert d["current"] == {"version_id": ds["default_version_id"], "head_revision": d["head_revision"]}
    assert d["identity"]["never_recycled"] is True and d["identity"]["object_id_json_encoding"] == "positive-decimal-string" and d["schema_version"] == 1 and d["contract"] and d["canonical_encoding"]


def test_measures_do_not_depend_on_the_zone(spark, engine):
    definition = {"schema_version": 1, "geometry": None, "fields": [{"name": "at", "type": "timestamp", "nullable": False}]}
    d = engine.create_dataset("moments", "item", "policy", definition)
    put(engine, d, [{"fid": fid(k), "values": {"at": t}} for k, t in enumerate(["2023-10-29T00:30:00Z", "2023-10-29T01:30:00.000001Z", "0001-01-01T00:00:00Z", "9999-12-31T23:59:59.999999Z", "1969-12-31T23:59:59.5Z"], 1)])
    from branchstone.operators.measure import instant_text, measure

    zone, found, texts = spark.conf.get("spark.sql.session.timeZone"), set(), set()
    try:
        for name in ("UTC", "Europe/Berlin", "America/St_Johns"):
            spark.conf.set("spark.sql.session.timeZone", name)
            rows = engine.read(d["dataset_id"])
            found.add(tuple(measure(rows.drop("feature_revision"), "fid", "x").first()))
            texts.add(tuple(r[0] for r in rows.orderBy("fid").select(instant_text(rows["at"])).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(found) == 1
    assert texts == {("2023-10-29T00:30:00.000000+00:00", "2023-10-29T01:30:00.000001+00:00", "0001-01-01T00:00:00.000000+00:00", "9999-12-31T23:59:59.999999+00:00", "1969-12-31T23:59:59.500000+00:00")}


def test_vacuum_removes_what_no_state_names(engine, ds):
    put(engine, ds, [row(1)])
    edits = [{"dataset_id": ds["dataset_id"], "rows": [row(2)], "replace": False}]
    before = set(engine.store.log.names("data"))
    assert code(engine.apply_group, ds["default_version_id"], head(engine, ds), [*edits, {"dataset_id": fid(9), "rows": [], "replace": False}]) == "DATASET_VERSION_MISMATCH"
    left = set(engine.store.log.names("data")) - before
    assert left and engine.store.vacuum() == []
    assert set(engine.store.vacuum(older_than=-1)) >= left
    assert len(state(engine, ds)) == 1 and engine.identities(ds["dataset_id"]).count() == 1


def test_the_log_is_read_from_its_checkpoints(engine, ds, spark, tmp_path):
    for k in range(40):
        put(engine, ds, [row(k)])
    g = ds["version_group_id"]
    fresh = Workspace(spark, str(tmp_path / "root"))
    reads = []
    read = fresh.store.log.read
    fresh.store.log.read = lambda name: reads.append(name) or read(name)
    assert fresh.store.state(g) == engine.store.state(g)
    assert len(reads) <= 18
    reads.clear()
    put(engine, ds, [row(99)])
    assert fresh.store.state(g)["sequence"] == 42 and len(reads) == 1
    sizes = [(tmp_path / "root" / engine.store.path_of(g, n)).stat().st_size for n in (40, 41)]
    assert sizes[0] < 3000 and len(state(fresh, ds)) == 41


def test_registries_and_segments(engine, ds, spark, monkeypatch):
    """Identities in few folders whatever the number of batches; a load rewrites nothing of what is there."""
    did, v = ds["dataset_id"], ds["default_version_id"]
    for k in range(25):
        put(engine, ds, [row(k)])
    entry = engine.store.state(ds["version_group_id"])["datasets"][did]
    assert len(entry["identity"]) <= 16 and {r.object_id for r in engine.identities(did).collect()} == set(range(1, 26))
    more = spark.range(20, 60).selectExpr("lpad('', 8, '0') || '-0000-0000-0000-' || lpad(lower(hex(id)), 12, '0') as fid", "'l' || id as tag", "cast(id as decimal(9,2)) as depth", "'SRID=3857;POINT Z(0 1 2)' as geometry")
    base = engine.store.state(ds["version_group_id"])["versions"][v]["datasets"][did]["base"]
    engine.load(did, v, head(engine, ds), more)
    manifest = engine.store.state(ds["version_group_id"])["versions"][v]["datasets"][did]
    assert manifest["base"][: len(base)] == base and len(manifest["base"]) == len(base) + 1
    got = state(engine, ds, "tag", "object_id")
    assert len(got) == 60 and got[fid(22)] == ("l22", 23) and got[fid(3)] == ("x", 4) and sorted(x[1] for x in got.values()) == list(range(1, 61))
    put(engine, ds, [row(22, "again"), row(70)])
    engine.edit(v, head(engine, ds), did, "delete", fid(50))
    engine.load(did, v, head(engine, ds), more.limit(5))
    got = state(engine, ds, "tag", "object_id")
    assert got[fid(22)] == ("l22", 23) and got[fid(70)] == ("x", 61) and fid(50) not in got and len(got) == 60
    monkeypatch.setattr("branchstone.sources.layers.MOST_CHANGED", 3)
    engine.load(did, v, head(engine, ds), more)
    assert len(state(engine, ds)) == 61 and state(engine, ds, "object_id")[fid(50)] == (51,)


def test_loads_fill_in_defaults(engine, spark):
    d = engine.create_dataset("parts", "item", "policy", changed(PART_DEFINITION, ["rules"], []))
    did, v = d["dataset_id"], d["default_version_id"]
    rows = spark.createDataFrame([(fid(1), "A", "950.00"), (fid(2), "B", "950.00"), (fid(3), "C", "950.00")], "fid string, kind string, price string").selectExpr("fid", "kind", "cast(price as decimal(12,2)) as price", "cast(1 as decimal(12,2)) as floor")
    assert code(engine.load, did, v, head(engine, d), rows.drop("floor")) == "FIELD_SET_MISMATCH"  # it has no default
    engine.load(did, v, head(engine, d), rows)
    assert state(engine, d, "kind", "size") == {fid(1): ("A", 10), fid(2): ("B", 7), fid(3): ("C", 7)}
    assert code(engine.load, did, v, head(engine, d), rows) == "FIELD_SET_MISMATCH"  # updates name all fields
    assert code(engine.load, did, v, head(engine, d), rows.selectExpr("replace(fid, '00000', '11111') as fid", "'Z' as kind", "price", "floor")) == "INVALID_SUBTYPE"


def test_batches_in_hand_are_checked_as_plans_are(spark):
    """The checks of rows in hand against the columns that say the same."""
    import itertools

    from branchstone.functions.predicates import checker, violations

    kinds, sizes, prices, floors = ["A", "B", "C", "Z", None], [None, 4, 5, 7, 10, 20, 21, 40, 45, 46], [None, "919.99", "920", "950", "980.01"], [None, "950", "1000"]
    rows = [dict(zip(("kind", "size", "price", "floor"), (k, s, p and Decimal(p), f and Decimal(f)), strict=True)) for k, s, p, f in itertools.product(kinds, sizes, prices, floors)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "kind string, size int, price decimal(12,2), floor decimal(12,2)")
    check = checker(PART_DEFINITION)
    for r in df.withColumn("bad", violations(PART_DEFINITION)).collect():
        mine = check({k: r[k] for k in ("kind", "size", "price", "floor")})
        assert mine == (r.bad[0] if r.bad else None), r
