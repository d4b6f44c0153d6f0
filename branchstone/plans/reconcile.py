"""Editing branches and bringing them back: prepare, resolve, accept, post. Any dataset's fields merge by one rule."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators import merge as m
from ..operators.change import changed_rows, feature_diff, removed_rows
from ..sources import layers
from ..sources.log import require
from .branches import Branches
from .engine import ALL, Touched, is_uuid, new_id, now, rows_schema

OPERATIONS = ("insert", "update", "delete")
CARRIED = ("object_id", "feature_revision")


class Workspace(Branches):
    """The engine with everything: datasets, branches and reconciliation."""

    def edit(self, version: str, expected_head: str, dataset: str, operation: str, fid: str, row: dict | None = None, actor: str | None = None) -> str:
        """One feature of any version, DEFAULT or an active branch; returns the new head. row: {values[, geometry]}, whole."""
        require(isinstance(operation, str) and operation in OPERATIONS and is_uuid(fid) and (row is not None or operation == "delete"), "INVALID_OPERATION")
        group = self._group_of("version", version, "UNKNOWN_VERSION")

        def change(state: dict) -> str:
            target = state["versions"][version]
            require(target["head"] == expected_head, "STALE_BRANCH_HEAD")
            require(version == state["default_version_id"] or state["branches"][version]["state"] == "active", "BRANCH_NOT_ACTIVE")
            require(dataset in target["datasets"], "DATASET_VERSION_MISMATCH")
            manifest, key, definition = target["datasets"][dataset], fid.lower(), self._definition(state, dataset)
            present, ever = self._known(manifest, state["datasets"][dataset], {key}, definition, operation == "insert")  # rows name their identity
            require((key in present) if operation != "insert" else key not in present, "UNKNOWN_FEATURE" if operation != "insert" else "DUPLICATE_FEATURE_UUID")
            if operation == "delete":
                schema = rows_schema(definition)
                nothing = pa.table({f.name: pa.array([], to_arrow_type(f.dataType)) for f in schema.fields})
                target["datasets"][dataset] = layers.with_changes(self.store, manifest, schema, nothing, [key], state["sequence"] + 1)
            else:
                self._apply(state, target, dataset, [{"fid": fid, **row}], False, (present, ever))
            one = frozenset({key})
            self._check_sets(state, target["datasets"], {dataset: Touched(frozenset(), one) if operation == "delete" else Touched(one, frozenset())})
            target["head"] = new_id()
            self._event(state, "edit", version, actor, dataset_id=dataset, operation=operation, fid=key)
            return target["head"]

        return self._transact(group, change)

    def capture(self, group: str, version: str) -> str:
        """A sealed snapshot of any version as it is now."""

        def change(state: dict) -> str:
            require(version in state["versions"], "UNKNOWN_VERSION")
            return self._capture(state, version, version=version)

        return self._transact(group, change)

    def _fields(self, state: dict, dataset: str) -> list[str]:
        return [n for n in rows_schema(self._definition(state, dataset)).names if n not in ("fid", *CARRIED)]

    def diff(self, dataset: str, version: str, snapshot: str) -> DataFrame:
        """(fid, change, old, new) from a snapshot to a version."""
        state = self.store.state(self._group_of("dataset", dataset, "UNKNOWN_DATASET"))
        return feature_diff(self.read_snapshot(dataset, snapshot), self.read(dataset, version), "fid", self._fields(state, dataset))

    def prepare_reconcile(self, branch: str, actor: str | None = None) -> str:
        """A plan that merges DEFAULT, as it is now, into a branch: a candidate for each dataset, and its conflicts.

        Each dataset is one merge, written once with all outcomes; candidate and conflicts are read from it."""
        group = self._group_of("version", branch, "UNKNOWN_BRANCH")

        def change(state: dict) -> str:
            require(branch != state["default_version_id"], "DEFAULT_IS_NOT_BRANCH")
            require(branch in state["branches"] and state["branches"][branch]["state"] == "active", "UNKNOWN_BRANCH")
            version, default = state["versions"][branch], state["versions"][state["default_version_id"]]
            plan, target = new_id(), self._capture(state, branch)
            base, parts = state["snapshots"][version["base_snapshot_id"]]["datasets"], {}
            for dataset in sorted(version["datasets"]):
                manifests = (base[dataset]["manifest"], version["datasets"][dataset], default["datasets"][dataset])
                parts[dataset] = self._merged(state, dataset, *manifests)
            # what stands in the candidate must hold together, before anyone decides on the rest
            self._check_sets(state, {d: p["candidate"] for d, p in parts.items()}, dict.fromkeys(parts, ALL))
            state["plans"][plan] = {
                "branch_id": branch, "status": "prepared", "source_head": version["head"], "accepted_head": None, "target_head": default["head"], "target_snapshot_id": target,
                "schema_generation": state["schema_generation"], "datasets": parts, "sealed": not any(p["open"] for p in parts.values()), "created_at": now(),
            }
            self._event(state, "prepare", branch, actor, plan_id=plan)
            return plan

        return self._transact(group, change)

    def _merged(self, state: dict, dataset: str, base: dict, ours: dict, theirs: dict) -> dict:
        """A dataset's part of a plan. Where one side names the base's own folders nothing needs reading: the merge of
        any row with an unchanged side is the other side's."""
        if ours == base or theirs in (base, ours):
            return {"candidate": theirs if ours == base else ours, "merge": None, "open": 0, "resolved": {}}
        schema = rows_schema(self._definition(state, dataset))
        sides = [self._rows(state, x, dataset) for x in (base, ours, theirs)]
        done = m.three_way_merge(*sides, "fid", self._fields(state, dataset), CARRIED)
        kept = self.store.write(done.withColumn("merged", self._revised(done)))
        whole = self.spark.read.parquet(f"{self.store.log.root}/{kept}")
        candidate = layers.whole(self.store, m.candidate(whole, "fid").select(*schema.names), state["sequence"] + 1)
        return {"candidate": candidate, "merge": kept, "open": m.conflicts(whole, "fid").count(), "resolved": {}}

    @staticmethod
    def _revised(done: DataFrame):
        """Rows that are merged of both sides get a revision of their own, made of theirs so that it never changes."""
        both = F.md5(F.concat(F.col("ours.feature_revision"), F.col("theirs.feature_revision")))
        fresh = F.regexp_replace(both, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
        return F.when(F.col("outcome") == m.MERGE, F.col("merged").withField("feature_revision", fresh)).otherwise(F.col("merged"))

    def _plan(self, state: dict, plan: str) -> dict:
        require(plan in state["plans"], "UNKNOWN_PLAN")
        return state["plans"][plan]

    def plan(self, group: str, plan: str) -> dict:
        return self._plan(self.store.state(group), plan)

    def plan_conflicts(self, group: str, plan: str, dataset: str) -> DataFrame:
        """The conflicts of a plan that nobody has decided."""
        state = self.store.state(group)
        part = self._plan(state, plan)["datasets"][dataset]
        if part["merge"] is None:
            rows = self.store.read([], rows_schema(self._definition(state, dataset)))
            return m.conflicts(m.three_way_merge(rows, rows, rows, "fid", self._fields(state, dataset), CARRIED), "fid")
        found = m.conflicts(self.spark.read.parquet(f"{self.store.log.root}/{part['merge']}"), "fid")
        return found.where(~F.col("fid").isin(list(part["resolved"]))) if part["resolved"] else found

    def resolve_conflict(self, group: str, plan: str, dataset: str, fid: str, choice: str, actor: str | None = None) -> bool:
        """Takes one side's whole feature, or its absence; returns whether the plan is sealed now."""
        require(isinstance(choice, str) and choice in m.SIDES, "INVALID_RESOLUTION")

        def change(state: dict) -> bool:
            p = self._plan(state, plan)
            require(p["status"] == "prepared" and not p["sealed"], "INVALID_PLAN")
            require(dataset in p["datasets"] and p["datasets"][dataset]["merge"] is not None, "UNKNOWN_CONFLICT")
            part, key = p["datasets"][dataset], fid.lower()
            found = m.conflicts(self.spark.read.parquet(f"{self.store.log.root}/{part['merge']}"), "fid").where(F.col("fid") == key)
            require(key not in part["resolved"] and not found.isEmpty(), "UNKNOWN_CONFLICT")
            schema = rows_schema(self._definition(state, dataset))
            chosen = m.resolve(found, "fid", choice).select(*schema.names).toArrow()
            if len(chosen):
                part["candidate"] = layers.with_changes(self.store, part["candidate"], schema, chosen, [], state["sequence"] + 1)
            part["resolved"][key] = choice
            part["open"] -= 1
            p["sealed"] = not any(x["open"] for x in p["datasets"].values())
            if p["sealed"]:
                self._check_sets(state, {d: x["candidate"] for d, x in p["datasets"].items()}, dict.fromkeys(p["datasets"], ALL))
            self._event(state, "resolve", p["branch_id"], actor, plan_id=plan, dataset_id=dataset, fid=key, choice=choice)
            return p["sealed"]

        return self._transact(group, change)

    def _current(self, state: dict, p: dict) -> None:
        """Refuses a plan that either side or the schemas have left behind, or that has open conflicts."""
        source = p["source_head"] if p["status"] == "prepared" else p["accepted_head"]
        fresh = state["versions"][p["branch_id"]]["head"] == source and state["versions"][state["default_version_id"]]["head"] == p["target_head"]
        require(fresh and state["schema_generation"] == p["schema_generation"], "STALE_RECONCILE")
        require(p["sealed"], "UNRESOLVED_CONFLICT")

    def accept_reconcile(self, group: str, plan: str, actor: str | None = None) -> str:
        """The branch becomes the candidate, on DEFAULT as the plan met it; DEFAULT stays. Returns the branch's new head."""

        def change(state: dict) -> str:
            p = self._plan(state, plan)
            self._current(state, p)  # what has been left behind is stale, whatever its status
            require(p["status"] == "prepared", "INVALID_PLAN_STATE")
            branch = state["versions"][p["branch_id"]]
            branch |= {"datasets": {d: x["candidate"] for d, x in p["datasets"].items()}, "base_snapshot_id": p["target_snapshot_id"], "head": new_id()}
            state["branches"][p["branch_id"]]["base_snapshot_id"] = p["target_snapshot_id"]
            p |= {"status": "accepted", "accepted_head": branch["head"]}
            self._event(state, "accept", p["branch_id"], actor, plan_id=plan)
            return branch["head"]

        return self._transact(group, change)

    def post(self, group: str, plan: str, source_head: str, target_head: str, request: str, actor: str) -> str:
        """DEFAULT becomes the accepted candidate; returns its new head. The same request again returns the same head."""
        payload = hashlib.sha256(json.dumps([plan, source_head, target_head, actor]).encode()).hexdigest()
        known = self.store.state(group)["requests"].get(request)
        if known is not None:
            require(known["payload"] == payload, "IDEMPOTENCY_CONFLICT")
            return known["head"]

        def change(state: dict) -> str:
            if (done := state["requests"].get(request)) is not None:
                require(done["payload"] == payload, "IDEMPOTENCY_CONFLICT")
                return done["head"]
            p = self._plan(state, plan)
            self._current(state, p)
            require(p["status"] == "accepted" and source_head == p["accepted_head"] and target_head == p["target_head"], "STALE_RECONCILE")
            default, branch = state["versions"][state["default_version_id"]], state["versions"][p["branch_id"]]
            default |= {"datasets": {d: x["candidate"] for d, x in p["datasets"].items()}, "head": new_id()}
            after = self._capture(state, p["branch_id"])
            branch |= {"base_snapshot_id": after, "head": new_id()}
            state["branches"][p["branch_id"]]["base_snapshot_id"] = after
            p["status"] = "posted"
            self._event(state, "post", state["default_version_id"], actor, plan_id=plan)
            self._event(state, "checkpoint", p["branch_id"], actor, plan_id=plan)
            state["requests"][request] = {"payload": payload, "head": default["head"], "actor": actor}
            return default["head"]

        return self._transact(group, change)

    def changes_to_apply(self, group: str, plan: str, dataset: str) -> tuple[DataFrame, DataFrame]:
        """What accepting would delete from the branch and write to it: for consumers that keep a copy."""
        state = self.store.state(group)
        p = self._plan(state, plan)
        now_, then = self._rows(state, state["versions"][p["branch_id"]]["datasets"][dataset], dataset), self._rows(state, p["datasets"][dataset]["candidate"], dataset)
        return removed_rows(now_, then, "fid"), changed_rows(now_, then, "fid", self._fields(state, dataset))

    def events(self, group: str, after: int = 0, most: int = 1000) -> list[dict[str, Any]]:
        """The events of a group in order, of whole commits from number `after` + 1 on until there are `most` or more;
        each has its commit's `sequence`, from which the next page goes on."""
        found: list[dict[str, Any]] = []
        last = self.store.state(group)["sequence"]
        while after < last and len(found) < most:
            after += 1
            found += [e | {"sequence": after} for e in self.store.log.read(self.store.path_of(group, after))["events"]]
        return found
