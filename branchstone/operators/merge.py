"""Three-way merge of feature tables at row and field grain, conflicts and their resolution."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("base", "ours", "theirs")
TAKE_THEIRS, TAKE_OURS, EXISTENCE, FIELD, MERGE = "take_theirs", "take_ours", "existence", "field", "merge"


def aligned(sides: dict[str, DataFrame], key: str, fields: Sequence[str]) -> DataFrame:
    """One row for each key with a struct of the fields for each side, null where the side lacks the key.

    Keys are unique within a side. One exchange on the key for any number of sides, where chained outer joins would
    shuffle again for each of them."""
    tagged = [
        df.select(key, *[(F.struct(*fields) if name == side else F.lit(None)).alias(name) for name in sides])
        for side, df in sides.items()
    ]
    rows = reduce(DataFrame.unionByName, tagged)
    return rows.groupBy(key).agg(*[F.first(name, ignorenulls=True).alias(name) for name in sides])


def _settled(base: Column, ours: Column, theirs: Column) -> tuple[Column, Column]:
    """(theirs is to be taken, else ours is to be taken): the rule for whole rows and for single fields alike."""
    return ours.eqNullSafe(base), theirs.eqNullSafe(base) | ours.eqNullSafe(theirs)


def _only(side: Column, fields: Sequence[str]) -> Column:
    return F.when(side.isNotNull(), F.struct(*[side[f].alias(f) for f in fields]))


def three_way_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, fields: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """(key, outcome, conflict_fields, merged, base, ours, theirs) for every key of any side.

    A side that did not change gives way to the other; equal changes coalesce; a row missing on one side and changed on
    the other is an `existence` conflict, as are different rows without a base; otherwise fields are merged by the same
    rule, and a row with any conflicting field merges none of them and lists them all in field order. merged is null
    where the row is gone or in conflict. Columns in `carry` go along without being compared, in a merged row ours."""
    sides = aligned({"base": base, "ours": ours, "theirs": theirs}, key, [*fields, *carry])
    b, o, t = (F.col(s) for s in SIDES)
    take_theirs, take_ours = _settled(*((_only(x, fields) for x in (b, o, t)) if carry else (b, o, t)))
    parts = {f: _settled(b[f], o[f], t[f]) for f in fields}
    open_fields = F.filter(F.array(*[F.when(~(first | second), f) for f, (first, second) in parts.items()]), lambda x: x.isNotNull())
    sides = sides.withColumn("__open", open_fields)
    outcome = (
        F.when(take_theirs, TAKE_THEIRS)
        .when(take_ours, TAKE_OURS)
        .when(b.isNull() | o.isNull() | t.isNull(), EXISTENCE)
        .when(F.size("__open") > 0, FIELD)
        .otherwise(MERGE)
    )
    sides = sides.withColumn("outcome", outcome)
    mixed = F.struct(*[F.when(first, t[f]).otherwise(o[f]).alias(f) for f, (first, _) in parts.items()], *[o[c].alias(c) for c in carry])
    merged = F.when(F.col("outcome") == TAKE_THEIRS, t).when(F.col("outcome") == TAKE_OURS, o).when(F.col("outcome") == MERGE, mixed)
    conflicts = F.when(F.col("outcome") == FIELD, F.col("__open")).when(F.col("outcome") == EXISTENCE, F.array(F.lit(EXISTENCE)))
    return sides.select(key, "outcome", conflicts.alias("conflict_fields"), merged.alias("merged"), *SIDES)


def candidate(merged: DataFrame, key: str) -> DataFrame:
    """Rows of the merge that are settled and present."""
    return merged.where("merged is not null").select(key, "merged.*")


def conflicts(merged: DataFrame, key: str) -> DataFrame:
    return merged.where(F.col("outcome").isin(EXISTENCE, FIELD)).select(key, "outcome", "conflict_fields", *SIDES)


def resolve(found: DataFrame, key: str, choice: str) -> DataFrame:
    """The chosen side's rows of conflicts; an absent side leaves the row out."""
    if choice not in SIDES:
        raise ValueError("INVALID_RESOLUTION")
    return found.where(F.col(choice).isNotNull()).select(key, f"{choice}.*")
