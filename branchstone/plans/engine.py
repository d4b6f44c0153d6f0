"""Datasets with typed definitions in version groups: creation, atomic batches, schema revisions, identities."""

from __future__ import annotations

import itertools
import json
import re
import uuid
from collections.abc import Collection, Iterable
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.geometry import TYPE as GEOMETRY
from ..functions.geometry import described, from_ewkt, geometry_checks, geometry_faults
from ..functions.predicates import checker, checks, spark_type, typed
from ..operators.checks import duplicates, orphans
from ..operators.identity import allocate
from ..sources import layers
from ..sources.log import EngineError, Store, require
from .definition import UUID, DefinitionError, Field, Model, canonical, fingerprint, identifier, normalized, physical

# Limits of a batch.
MOST_ROWS, MOST_EDITS = 10_000, 128
# Ranges that have the codes of the common registry of spatial reference systems.
KNOWN_SRIDS = (range(2000, 6000), range(6100, 9000), range(20_000, 33_000), range(900_913, 900_914))
# What a descriptor says of identities.
IDENTITY_BLOCK = {
    "feature_uuid_field": "fid", "object_id_field": "object_id", "object_id_type": "int64", "object_id_json_encoding": "positive-decimal-string",
    "never_recycled": True, "feature_revision_field": "feature_revision", "feature_revision_type": "uuid", "version_field": "version_id",
}
CONTRACT, ENCODING = "branchstone-dataset-v1", "branchstone-definition-json-v1"
FEW = 100  # keys that are looked up by a pushed-down filter
REGISTRIES = 16  # folders of identities that are kept apart
IDENTITY = T.StructType([T.StructField("fid", T.StringType()), T.StructField("object_id", T.LongType())])
SYSTEM = [T.StructField("fid", T.StringType()), T.StructField("object_id", T.LongType()), T.StructField("feature_revision", T.StringType())]


@dataclass(frozen=True)
class Touched:
    """The keys that a batch wrote and those that it removed; None for any number of them."""

    written: frozenset[str] | None = None
    removed: frozenset[str] | None = None


ALL = Touched()


def new_id() -> str:
    return str(uuid.uuid4())


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def is_uuid(x: Any) -> bool:
    return isinstance(x, str) and re.fullmatch(UUID, x) is not None


def fields_schema(definition: dict) -> list[T.StructField]:
    found = [T.StructField(f["name"], spark_type(f)) for f in definition["fields"]]
    if definition["geometry"] is not None:
        found.append(T.StructField("geom", T._parse_datatype_string(GEOMETRY)))
    return found


def rows_schema(definition: dict) -> T.StructType:
    return T.StructType([*SYSTEM, *fields_schema(definition)])


def all_checks(definition: dict) -> list:
    return checks(definition) + (geometry_checks(definition["geometry"]) if definition["geometry"] else [])


class Engine:
    """The catalog of one root folder. Every public call either commits whole or has no effect; Parquet folders of a call
    that was refused stay unnamed until store.vacuum().

    srids: the spatial reference systems that datasets may use, a container (default: KNOWN_SRIDS)."""

    def __init__(self, spark: SparkSession, root: str, srids: Collection[int] | None = None):
        self.spark, self.store, self.srids = spark, Store(spark, root), srids

    # --- catalog ---------------------------------------------------------------------------------------------------

    def _group_of(self, kind: str, name: Any, code: str) -> str:
        group = self.store.group_of(kind, name) if is_uuid(name) else None
        require(group is not None and self.store.holds(kind, name, group), code)
        return group

    def _knows_srid(self, srid: int) -> bool:
        return srid in self.srids if self.srids is not None else any(srid in r for r in KNOWN_SRIDS)

    def _invariants(self, state: dict) -> None:
        """What must hold of a state before it is committed."""

    def _definition(self, state: dict, dataset: str) -> dict:
        return state["revisions"][state["datasets"][dataset]["active_schema_revision"]]["definition"]

    def _event(self, state: dict, kind: str, version: str, actor: str | None, **payload: Any) -> None:
        state["event_id"] += 1
        state["events"].append({"event_id": state["event_id"], "kind": kind, "version_id": version, "actor": actor, "at": now(), "delivered": False, "payload": payload})

    def _transact(self, group: str, change, tries: int = 3):
        def clean(state: dict):
            state["events"] = []  # a log entry has the events of its own commit
            result = change(state)
            self._invariants(state)
            return result

        return self.store.transact(group, clean, tries)

    def create_dataset(self, managed_name: str, catalog_item_id: str, policy_ref: str, definition: dict, dataset_id: str | None = None, version_group_id: str | None = None, natural_key: list[str] | None = None) -> dict:
        """A dataset in a new group, with its DEFAULT version, or in one that exists and has no branch or snapshot.

        natural_key: fields whose values together are unique in each version, checked when a batch is complete."""
        try:
            identifier(managed_name)
            definition = normalized(definition)
        except DefinitionError as e:
            raise EngineError("INVALID_DEFINITION", str(e)) from None
        if definition["geometry"] is not None:
            require(self._knows_srid(definition["geometry"]["srid"]), "UNKNOWN_SRID", str(definition["geometry"]["srid"]))
        dataset, group = (dataset_id or new_id()).lower(), version_group_id or new_id()
        require(is_uuid(dataset) and is_uuid(group) and bool(catalog_item_id) and bool(policy_ref), "INVALID_MANAGED_REQUEST")
        require(set(natural_key or ()) <= {f["name"] for f in definition["fields"]}, "INVALID_DEFINITION", "natural key")

        def change(state: dict) -> None:
            require(dataset not in state["datasets"], "DUPLICATE_DATASET")
            self._require_unpinned(state)
            for r in definition.get("relationships", []):
                require(r["target_dataset"] in {*state["datasets"], dataset}, "RELATIONSHIP_TARGET_OUTSIDE_GROUP")
            revision = new_id()
            state["revisions"][revision] = {"dataset_id": dataset, "definition": definition, "canonical": canonical(definition), "sha256": fingerprint(definition)}
            state["datasets"][dataset] = {"managed_name": managed_name, "catalog_item_id": catalog_item_id, "policy_ref": policy_ref, "active_schema_revision": revision, "next_object_id": 1, "identity": [], "natural_key": natural_key or []}
            state["schema_generation"] += 1
            version = state["versions"][state["default_version_id"]]
            version["head"], version["datasets"][dataset] = new_id(), layers.empty()

        # the ids are this group's before it has them, so that no other group can come between
        require(self.store.claim("dataset", dataset, group), "DUPLICATE_DATASET")
        default = new_id()
        try:
            if version_group_id is None:
                require(self.store.claim("version", default, group), "DUPLICATE_VERSION")
                state = {"group_id": group, "sequence": 0, "schema_generation": 0, "default_version_id": default, "versions": {default: {"name": "DEFAULT", "head": new_id(), "datasets": {}, "base_snapshot_id": None}}}
                state |= {k: {} for k in ("datasets", "revisions", "snapshots", "branches", "plans", "requests", "measures")} | {"commits": [], "references": [], "events": [], "event_id": 0, "quota": None}
                change(state)
                self.store.commit(state)
            else:
                self._transact(group, change)
        except Exception:
            self.store.release("dataset", dataset, group)
            self.store.release("version", default, group)
            raise
        return self.export_schema(dataset)

    def export_schema(self, dataset: str) -> dict:
        """The dataset's descriptor; its definition is held against its fingerprint again."""
        group = self._group_of("dataset", dataset, "UNKNOWN_DATASET")
        state = self.store.state(group)
        d = state["datasets"][dataset]
        revision = state["revisions"][d["active_schema_revision"]]
        require(revision["sha256"] == fingerprint(revision["definition"]) and revision["canonical"] == canonical(revision["definition"]), "SCHEMA_FINGERPRINT_MISMATCH")
        default = state["default_version_id"]
        head = state["versions"][default]["head"]
        return {
            "schema_version": 1, "contract": CONTRACT, "dataset_id": dataset, "managed_name": d["managed_name"], "catalog_item_id": d["catalog_item_id"], "policy_ref": d["policy_ref"],
            "version_group_id": group, "default_version_id": default, "schema_revision_id": d["active_schema_revision"], "schema_sha256": revision["sha256"], "canonical_encoding": ENCODING,
            "definition": revision["definition"], "group_schema_generation": state["schema_generation"], "identity": dict(IDENTITY_BLOCK), "current": {"version_id": default, "head_revision": head},
            "head_revision": head, "schema_generation": state["schema_generation"],
        }

    def _require_unpinned(self, state: dict) -> None:
        pinned = state["snapshots"] or any(b["state"] in ("active", "archived", "deletion_pending", "deleted") for b in state["branches"].values())
        require(not pinned, "ACTIVE_BRANCH_SCHEMA_CHANGE_UNSUPPORTED")

    def revise_schema(self, descriptor: dict, definition: dict) -> dict:
        """Another definition with the same stored form; rows that are there must satisfy it. The same one changes nothing."""
        dataset = descriptor["dataset_id"]
        group = self._group_of("dataset", dataset, "UNKNOWN_DATASET")
        try:
            definition = normalized(definition)
        except DefinitionError as e:
            raise EngineError("INVALID_DEFINITION", str(e)) from None

        def change(state: dict) -> None:
            d = state["datasets"][dataset]
            version = state["versions"][state["default_version_id"]]
            require(d["active_schema_revision"] == descriptor["schema_revision_id"] and version["head"] == descriptor["head_revision"], "STALE_SCHEMA")
            old = state["revisions"][d["active_schema_revision"]]
            if old["sha256"] == fingerprint(definition):
                return
            self._require_unpinned(state)
            require(physical(old["definition"]) == physical(definition), "PHYSICAL_SCHEMA_CHANGE_REQUIRES_MIGRATION")
            for r in definition.get("relationships", []):
                require(r["target_dataset"] in state["datasets"], "RELATIONSHIP_TARGET_OUTSIDE_GROUP")
            revision = new_id()
            state["revisions"][revision] = {"dataset_id": dataset, "definition": definition, "canonical": canonical(definition), "sha256": fingerprint(definition)}
            d["active_schema_revision"] = revision
            state["schema_generation"] += 1
            version["head"] = new_id()
            self._check_rows(self._rows(state, version["datasets"][dataset], dataset), definition)
            self._check_sets(state, version["datasets"], {dataset: ALL})

        self._transact(group, change)
        return self.export_schema(dataset)

    # --- reading ---------------------------------------------------------------------------------------------------

    def _rows(self, state: dict, manifest: dict, dataset: str) -> DataFrame:
        return layers.read(self.store, manifest, rows_schema(self._definition(state, dataset)))

    def read(self, dataset: str, version: str | None = None) -> DataFrame:
        """The rows of a version, DEFAULT if none is named, as its manifest is now: later commits do not touch them."""
        state = self.store.state(self._group_of("dataset", dataset, "UNKNOWN_DATASET"))
        version = version or state["default_version_id"]
        require(version in state["versions"], "UNKNOWN_VERSION")
        manifests = state["versions"][version]["datasets"]
        require(dataset in manifests, "DATASET_VERSION_MISMATCH")
        return self._rows(state, manifests[dataset], dataset)

    def read_snapshot(self, dataset: str, snapshot: str) -> DataFrame:
        state = self.store.state(self._group_of("dataset", dataset, "UNKNOWN_DATASET"))
        require(snapshot in state["snapshots"], "UNKNOWN_SNAPSHOT")
        return self._rows(state, state["snapshots"][snapshot]["datasets"][dataset]["manifest"], dataset)

    def identities(self, dataset: str) -> DataFrame:
        """(fid, object_id) of every feature that the dataset ever had."""
        state = self.store.state(self._group_of("dataset", dataset, "UNKNOWN_DATASET"))
        return self._registry(state["datasets"][dataset])

    def export_identity(self, dataset: str, fid: str) -> dict:
        row = self.identities(dataset).where(F.col("fid") == fid.lower()).first()
        require(row is not None, "UNKNOWN_FEATURE")
        return {"fid": row["fid"], "object_id": str(row["object_id"])}

    # --- writing ---------------------------------------------------------------------------------------------------

    def apply_rows(self, dataset: str, version: str, expected_head: str, rows: list[dict], replace: bool = False) -> str:
        """One dataset's batch; returns the new head."""
        require(is_uuid(version) and is_uuid(expected_head) and isinstance(rows, list) and type(replace) is bool, "INVALID_MANAGED_REQUEST")
        require(len(rows) <= MOST_ROWS, "MANAGED_BATCH_LIMIT")
        group = self._group_of("dataset", dataset, "DATASET_VERSION_MISMATCH")
        require(self.store.state(group)["default_version_id"] == version, "DATASET_VERSION_MISMATCH")
        return self.apply_group(version, expected_head, [{"dataset_id": dataset, "rows": rows, "replace": replace}])

    def apply_group(self, version: str, expected_head: str, edits: list[dict]) -> str:
        """Batches of several datasets of a group at once: full rows that replace those with the same fid or are new.

        All checks hold for the state as it is after the whole batch, or nothing of it is kept."""
        require(is_uuid(version) and is_uuid(expected_head) and isinstance(edits, list) and 1 <= len(edits) <= MOST_EDITS, "INVALID_MANAGED_GROUP")
        group = self._group_of("version", version, "DATASET_VERSION_MISMATCH")
        edits = json.loads(json.dumps(edits, allow_nan=False))

        def change(state: dict) -> str:
            target = state["versions"][version]
            require(target["head"] == expected_head, "STALE_HEAD")
            total, seen = 0, {}
            for edit in edits:
                ok = isinstance(edit, dict) and set(edit) == {"dataset_id", "rows", "replace"} and isinstance(edit["dataset_id"], str)
                require(ok and isinstance(edit["rows"], list) and type(edit["replace"]) is bool, "INVALID_MANAGED_GROUP_EDIT")
                dataset = edit["dataset_id"].lower()
                require(dataset not in seen, "DUPLICATE_DATASET_EDIT")
                seen[dataset] = ALL if edit["replace"] else None
                total += len(edit["rows"])
                require(total <= MOST_ROWS, "MANAGED_BATCH_LIMIT")
                require(dataset in target["datasets"] and version == state["default_version_id"], "DATASET_VERSION_MISMATCH")
                fids = self._apply(state, target, dataset, edit["rows"], edit["replace"])
                seen[dataset] = seen[dataset] or Touched(frozenset(fids), frozenset())
            self._check_sets(state, target["datasets"], seen)
            target["head"] = new_id()
            return target["head"]

        return self._transact(group, change)

    def load(self, dataset: str, version: str, expected_head: str, rows: DataFrame, replace: bool = False) -> str:
        """A batch of any size as a DataFrame: fid, the fields in their exact types and, with a geometry, its EWKT as
        `geometry`. Fields that have a default may be missing if all rows are new. The same checks as for apply_rows, all
        of them as distributed plans; returns the new head.

        The rows are written once before anything is decided. They become a segment beside those that are there, so a
        load costs what it holds, whatever the table holds; identities are allocated in the order they were written in."""
        group = self._group_of("dataset", dataset, "DATASET_VERSION_MISMATCH")

        def change(state: dict) -> str:
            target, entry = state["versions"].get(version), state["datasets"][dataset]
            require(version == state["default_version_id"], "DATASET_VERSION_MISMATCH")
            require(target["head"] == expected_head, "STALE_HEAD")
            definition, manifest = self._definition(state, dataset), target["datasets"][dataset]
            schema, wanted = rows_schema(definition), {f["name"]: spark_type(f) for f in definition["fields"]}
            given = {f.name: f.dataType for f in rows.schema.fields}
            geometry = {"geometry"} if definition["geometry"] is not None else set()
            missing = set(wanted) - set(given)
            require(set(given) | missing == {"fid", *wanted} | geometry and all(given.get(n, t) == t for n, t in wanted.items()), "FIELD_SET_MISMATCH")
            columns, known = default_columns(definition, missing)
            shape = [from_ewkt(F.col("geometry")).alias("geom"), F.col("geometry").isNotNull().alias("__text")] if geometry else []
            staged = rows.select(F.lower("fid").alias("fid"), *columns, *shape, known.alias("__known"), F.monotonically_increasing_id().alias("__position"))
            staged = self.spark.read.schema(staged.schema).parquet(f"{self.store.log.root}/{self.store.write(staged)}")
            named = F.coalesce(F.col("fid").rlike(rf"\A(?:{UUID})\z"), F.lit(False))
            unread = F.col("__text") & F.col("geom.ewkb").isNull() if geometry else F.lit(False)
            plain = staged.withColumn("geom", F.when(F.col("__text"), F.col("geom"))) if geometry else staged
            bad = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in all_checks(definition)], F.lit(None).cast("string")), lambda x: x.isNotNull())
            found = plain.select("__position", "__known", (~named).alias("nameless"), unread.alias("unread"), F.when(F.size(bad) > 0, F.struct("__position", bad[0].alias("name"))).alias("bad"))
            # one row for each partition that has written: their sizes number the rows of a first load
            parts = found.groupBy(F.shiftright("__position", 33).alias("part")).agg(F.count("*").alias("n"), F.count_if("nameless").alias("nameless"), F.count_if("unread").alias("unread"), F.count_if(~F.col("__known")).alias("unknown"), F.min("bad").alias("bad")).collect()
            count, first = sum(p.n for p in parts), min((tuple(p.bad) for p in parts if p.bad is not None), default=None)
            require(not any(p.nameless for p in parts), "INVALID_FEATURE_ROW")
            require(not any(p.unread for p in parts), "INVALID_GEOMETRY_INPUT")
            require(not any(p.unknown for p in parts), "INVALID_SUBTYPE")
            require(duplicates(staged, ["fid"]).isEmpty(), "DUPLICATE_FEATURE_UUID")
            there = [] if replace and not missing else manifest["base"] + manifest["layers"]
            old = self._rows(state, manifest, dataset).select("fid").join(staged.select("fid"), "fid", "left_semi") if there else None
            replaced = old.count() if old is not None else 0
            require(not (missing and replaced), "FIELD_SET_MISMATCH")
            require(first is None, "CONSTRAINT_VIOLATION", first[1] if first else "")

            if entry["identity"]:
                registry = self._registry(entry)
                fresh = self.store.write(allocate(plain, registry, "fid", "__position", entry["next_object_id"] - 1))
                made = self.store.read([fresh], IDENTITY)
                allocated = made.count()
                identified = plain.join(registry.unionByName(made), "fid")
            else:
                fresh, allocated = None, count
                identified = numbered(plain, {p.part: p.n for p in parts}, entry["next_object_id"] - 1)
            require(entry["next_object_id"] + allocated <= 1 << 63, "OBJECT_ID_OVERFLOW")
            full = identified.withColumn("feature_revision", F.expr("uuid()")).select(*schema.names)
            if replace or not manifest["base"] + manifest["layers"]:
                target["datasets"][dataset] = layers.whole(self.store, full, state["sequence"] + 1)
            else:
                if manifest["changed"] + replaced > layers.MOST_CHANGED:
                    full = self.store.read([self.store.write(full)], schema)  # revisions are drawn once
                target["datasets"][dataset] = layers.with_rows(self.store, manifest, schema, full, old, replaced, state["sequence"] + 1)
            if allocated:  # the rows themselves name the identities of a first load
                self._register(entry, fresh or target["datasets"][dataset]["base"][-1]["path"], allocated)
            self._check_sets(state, target["datasets"], {dataset: ALL})
            target["head"] = new_id()
            return target["head"]

        return self._transact(group, change)

    def _registry(self, entry: dict) -> DataFrame:
        """(fid, object_id) of every feature that a dataset ever had."""
        return self.store.read([r["path"] for r in entry["identity"]], IDENTITY)

    def _register(self, entry: dict, path: str, count: int) -> None:
        """One more folder of identities; small ones are brought together when there are many."""
        entry["next_object_id"] += count
        entry["identity"] = sorted([*entry["identity"], {"path": path, "rows": count}], key=lambda r: -r["rows"])
        if len(entry["identity"]) > REGISTRIES:
            kept, small = entry["identity"][: REGISTRIES // 4], entry["identity"][REGISTRIES // 4 :]
            merged = self.store.read([r["path"] for r in small], IDENTITY)
            entry["identity"] = [*kept, {"path": layers.ordered(self.store, merged), "rows": sum(r["rows"] for r in small)}]

    def _apply(self, state: dict, target: dict, dataset: str, rows: list, replace: bool, known: tuple[dict[str, int], dict[str, int]] | None = None) -> list[str]:
        """Gates a batch and puts it into the version's manifest. Its first wrong row, by position, names the error.
        Returns the keys. known: what _known says of them, where it has been asked.

        A batch is bounded, so it is checked and written in hand; what is there of its keys takes one job."""
        definition, manifest = self._definition(state, dataset), target["datasets"][dataset]
        for row in rows:
            require(isinstance(row, dict) and isinstance(row.get("fid"), str) and isinstance(row.get("values"), dict), "INVALID_FEATURE_ROW")
        entry, keys = state["datasets"][dataset], {r["fid"].lower() for r in rows}
        present, ids = self._known(manifest, entry, keys, definition) if known is None else known
        if definition["schema_version"] == 2:
            rows = [r if r["fid"].lower() in present else r | {"values": with_defaults(definition, r["values"])} for r in rows]
        typed_rows, error = gated(definition, rows)
        names, check = [f["name"] for f in definition["fields"]], checker(definition)
        for k, r in enumerate(typed_rows):
            shape = described(r[-1]) if definition["geometry"] is not None else None
            if r[-1] is not None and shape is None:
                typed_rows, error = typed_rows[:k], (k, "INVALID_GEOMETRY_INPUT", "")
                break
            typed_rows[k] = (*r[:-1], shape)
            bad = check(dict(zip(names, r[1:-1], strict=True))) or next(geometry_faults(definition["geometry"], shape), None)
            require(bad is None, "CONSTRAINT_VIOLATION", bad or "")
        if error is not None:
            raise EngineError(error[1], error[2])

        fids = [r[0] for r in typed_rows]
        fresh = [f for f in fids if f not in ids]
        require(entry["next_object_id"] + len(fresh) <= 1 << 63, "OBJECT_ID_OVERFLOW")
        if fresh:
            made = {f: entry["next_object_id"] + k for k, f in enumerate(fresh)}
            ids |= made
            self._register(entry, self.store.write_few(pa.table({"fid": pa.array(sorted(made), pa.string()), "object_id": pa.array([made[f] for f in sorted(made)], pa.int64())})), len(fresh))
        schema = rows_schema(definition)
        full = [(r[0], ids[r[0]], new_id(), *(r[1:] if definition["geometry"] is not None else r[1:-1])) for r in typed_rows]
        columns = list(zip(*full, strict=True)) or [()] * len(schema)
        table = pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields, strict=True)], names=schema.names)
        if replace:
            target["datasets"][dataset] = layers.with_changes(self.store, layers.empty(), schema, table, [], state["sequence"] + 1)
        elif fids:
            target["datasets"][dataset] = layers.with_changes(self.store, manifest, schema, table, [], state["sequence"] + 1)
        return fids

    def _local(self, rows: list[tuple], schema: T.StructType) -> DataFrame:
        """A bounded number of rows as a relation of the plan itself."""
        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        table = pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields, strict=True)], names=schema.names)
        return self.spark.createDataFrame(table, schema).coalesce(1)

    def _among(self, df: DataFrame, values: Collection[str], column: str = "fid") -> DataFrame:
        """The rows with these values: a pushed-down filter for a few, else a join with a batch's worth of them."""
        if len(values) <= FEW:
            return df.where(F.col(column).isin(sorted(values)))
        wanted = self._local([(v,) for v in sorted(values)], T.StructType([T.StructField(column, T.StringType())]))
        return df.join(F.broadcast(wanted), column, "left_semi")

    def _known(self, manifest: dict, entry: dict, fids: Collection[str], definition: dict, ever_had: bool = True) -> tuple[dict[str, int], dict[str, int]]:
        """Of some keys: those that the version has and, with ever_had, those that the dataset ever had, with their
        identities. One job: what layers and segments say of a key is few rows, of which the youngest counts."""
        schema, found = rows_schema(definition), []
        if fids and manifest["layers"]:
            found.append(self.store.read(manifest["layers"], layers.delta_schema(schema)).select("fid", "object_id", "__seq", F.col("__gone").alias("gone")))
        if fids:
            found += [rows.select("fid", "object_id", F.lit(seq).cast("long").alias("__seq"), F.lit(False).alias("gone")) for seq, rows in layers.based(self.store, manifest, schema)]
        if fids and entry["identity"] and ever_had:
            found.append(self._registry(entry).select("fid", "object_id", F.lit(-1).cast("long").alias("__seq"), F.lit(True).alias("gone")))
        rows = [tuple(r) for r in self._among(reduce(DataFrame.unionByName, found), fids).collect()] if found else []
        last: dict[str, tuple] = {}
        for fid, _, seq, gone in rows:
            last[fid] = max(last.get(fid, (-2, True)), (seq, not gone))
        ever = {fid: number for fid, number, _, _ in rows if number is not None}
        return {fid: ever[fid] for fid, (_, there) in last.items() if there and fid in ever}, ever

    def _check_rows(self, rows: DataFrame, definition: dict, order: str = "fid") -> None:
        found = [F.when(~ok, F.lit(name)) for name, ok in all_checks(definition)]
        if found:
            bad = rows.select(order, F.filter(F.array(*found), lambda x: x.isNotNull()).alias("bad")).where("size(bad) > 0").orderBy(order).first()
            require(bad is None, "CONSTRAINT_VIOLATION", bad["bad"][0] if bad else "")

    def _check_sets(self, state: dict, manifests: dict, touched: dict[str, Touched]) -> None:
        """Relationships and uniqueness of the final state. What a batch has not touched held before, so only the values
        of its rows are looked up, and the references to what it removed; after a replacement all rows are compared."""
        for dataset in sorted(set(state["datasets"]) & set(manifests)):
            definition, mine = self._definition(state, dataset), touched.get(dataset)
            if not state["datasets"][dataset]["natural_key"] and not definition.get("relationships"):
                continue
            rows = self._rows(state, manifests[dataset], dataset)
            if mine and (key := state["datasets"][dataset]["natural_key"]):
                require(self._unique(rows, key, mine), "NATURAL_KEY_VIOLATION", ",".join(key))
            for r in definition.get("relationships", []):
                target = r["target_dataset"]
                theirs = touched.get(target)
                parent = self._rows(state, manifests[target], target)
                if (mine and mine.written is None) or (theirs and theirs.removed is None):
                    ok = orphans(rows, r["field"], parent, "fid").isEmpty()
                else:
                    ok = not (mine and mine.written) or self._referred(rows, r["field"], parent, mine.written)
                    ok = ok and not (theirs and theirs.removed and not self._among(rows, theirs.removed, r["field"]).isEmpty())
                ok = ok and (r["cardinality"] != "one-to-one" or not mine or self._unique(rows, [r["field"]], mine))
                require(ok, "RELATIONSHIP_VIOLATION", r["name"])

    def _referred(self, rows: DataFrame, field: str, parent: DataFrame, fids: Collection[str]) -> bool:
        """Whether all that these rows refer to is there."""
        wanted = {r[0] for r in self._among(rows, fids).where(F.col(field).isNotNull()).select(field).distinct().collect()}
        return not wanted or self._among(parent.select("fid"), wanted).count() == len(wanted)

    def _unique(self, rows: DataFrame, key: list[str], mine: Touched) -> bool:
        if mine.written is None:
            return duplicates(rows, key).isEmpty()
        if not mine.written:
            return True
        values = self._among(rows, mine.written).select(*key).distinct()  # as many as the batch has rows, at most
        return duplicates(rows.join(F.broadcast(values), key, "left_semi"), key).isEmpty()


def with_defaults(definition: dict, values: dict) -> dict:
    """The values of a new row with defaults for fields that are not named; an explicit null stays."""
    model, found = Model(definition), dict(values)
    variant = model.variants[0]
    if model.selector:
        own = next((f for f in definition["fields"] if f["name"] == model.selector.name))
        code = found.get(model.selector.name, own.get("default"))
        variant = model.variant(code)
        require(variant is not None, "INVALID_SUBTYPE")
    return {name: cell.defaults[0] for name, cell in variant.cells.items() if cell.defaults} | found


def default_columns(definition: dict, missing: Collection[str]) -> tuple[list[Column], Column]:
    """The fields of new rows in order, missing ones by their defaults, and whether a row's variant is known.

    A missing field needs a default in every variant, or FIELD_SET_MISMATCH."""
    model = Model(definition)
    known, selector = F.lit(True), None
    value = lambda field, cell: typed(field, field.value(cell.defaults[0]))
    if model.selector:
        name = model.selector.name
        require(name not in missing or bool(model.variants[0].cells[name].defaults), "FIELD_SET_MISMATCH", name)
        selector = value(model.selector, model.variants[0].cells[name]) if name in missing else F.col(name)
        known = F.coalesce(selector.isin([typed(model.selector, model.selector.value(v.code)) for v in model.variants]), F.lit(False)) if missing else known
    columns = []
    for name, field in model.fields.items():
        if name not in missing:
            columns.append(F.col(name))
            continue
        require(all(v.cells[name].defaults for v in model.variants), "FIELD_SET_MISMATCH", name)
        if selector is None or name == model.selector.name:
            column = value(field, model.variants[0].cells[name])
        else:
            column = F.coalesce(*[F.when(selector == typed(model.selector, model.selector.value(v.code)), value(field, v.cells[name])) for v in model.variants])
        columns.append(column.alias(name))
    return columns, known


def numbered(staged: DataFrame, sizes: dict[int, int], after: int) -> DataFrame:
    """staged with object_id for rows that are all new: after + 1 and on by __position, whose upper half is the partition
    that wrote the row and whose lower half counts from 0. sizes: the partitions' rows."""
    offsets = list(zip(sorted(sizes), itertools.accumulate((sizes[p] for p in sorted(sizes)), initial=after), strict=False))
    part, within = F.shiftright("__position", 33), F.col("__position").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    if len(offsets) > FEW:
        spread = staged.sparkSession.createDataFrame(offsets, "__part long, __before long")
        return staged.withColumn("__part", part).join(F.broadcast(spread), "__part").withColumn("object_id", F.col("__before") + within)
    before = F.element_at(F.create_map(*[F.lit(x).cast("long") for o in offsets for x in o]), part) if offsets else F.lit(after)
    return staged.withColumn("object_id", before + within)


def gated(definition: dict, rows: Iterable[dict]) -> tuple[list[tuple], tuple[int, str, str] | None]:
    """Typed rows (fid, values, text of the geometry) up to the first that is refused, and where and why that is."""
    keys = {"fid", "values"} | ({"geometry"} if definition["geometry"] is not None else set())
    fields, out, seen = [Field.of(f) for f in definition["fields"]], [], set()
    names = {f.name for f in fields}
    for at, row in enumerate(rows):
        if set(row) != keys or not is_uuid(row["fid"]):
            return out, (at, "INVALID_FEATURE_ROW", "")
        fid, values = row["fid"].lower(), row["values"]
        if fid in seen:
            return out, (at, "DUPLICATE_FEATURE_UUID", fid)
        seen.add(fid)
        if set(values) != names:
            return out, (at, "FIELD_SET_MISMATCH", "")
        found = []
        for f in fields:
            if values[f.name] is None and not f.nullable:
                return out, (at, "NULL_NOT_ALLOWED", f.name)
            try:
                found.append(f.value(values[f.name], whole=False))
            except DefinitionError:
                return out, (at, "INVALID_TYPED_VALUE", f.name)
        text = row.get("geometry")
        if text is not None and not (isinstance(text, str) and re.match(r"SRID=[0-9]+;", text)):
            return out, (at, "INVALID_GEOMETRY_INPUT", "")
        out.append((fid, *found, text))
    return out, None
