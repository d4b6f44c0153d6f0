"""Definitions compiled to Column predicates, and the same checks on a row in hand. Values become typed literals; nothing
becomes SQL text."""

from __future__ import annotations

import operator
from collections.abc import Callable
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.definition import Coded, Field, Model, Range

COMPARE = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}
# The first and the last microsecond of the years 1 to 9999 in UTC, counted from 1970.
FIRST_MICRO, LAST_MICRO = -62_135_596_800_000_000, 253_402_300_799_999_999


def spark_type(spec: dict) -> T.DataType:
    if spec["type"] == "decimal":
        return T.DecimalType(spec["precision"], spec["scale"])
    simple = {"string": T.StringType(), "uuid": T.StringType(), "int32": T.IntegerType(), "int64": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType()}
    return simple[spec["type"]]


def typed(field: Field, value: Any) -> Column:
    """An exact value as a literal of the field's type."""
    return F.lit(value).cast(spark_type({"type": field.kind, **field.traits}))


def passes(condition: Column) -> Column:
    """As in a CHECK: an unknown outcome passes."""
    return F.coalesce(condition, F.lit(True))


def holds(condition: Column) -> Column:
    """As in an explicit rule: an unknown outcome fails."""
    return F.coalesce(condition, F.lit(False))


def in_domain(field: Field, domain: Coded | Range) -> Column:
    c = F.col(field.name)
    if isinstance(domain, Coded):
        return c.isin([typed(field, v) for v in domain.values])
    return c.between(typed(field, domain.low), typed(field, domain.high))


def rule_predicate(rule: dict, fields: dict[str, Field]) -> Column:
    c = F.col(rule["field"])
    if rule["kind"] == "required":
        return c.isNotNull()
    field, operand = fields[rule["field"]], rule["operand"]
    other = F.col(operand["field"]) if "field" in operand else typed(field, field.value(operand["literal"]))
    return holds(COMPARE[rule["operator"]](c, other))


def year_fits(field: Field) -> Column:
    """Years 1 to 9999, of instants in UTC whatever the session's zone."""
    c = F.col(field.name)
    return F.unix_micros(c).between(FIRST_MICRO, LAST_MICRO) if field.kind == "timestamp" else F.year(c).between(1, 9999)


def checks(definition: dict) -> list[tuple[str, Column]]:
    """(name, predicate) of every check of a normalized definition on single rows: each is true or false, never null."""
    m, found = Model(definition), []
    for name, field in m.fields.items():
        if not field.nullable:
            found.append((f"not_null:{name}", F.col(name).isNotNull()))
        if field.kind == "string":
            found.append((f"length:{name}", passes(F.char_length(name) <= field.traits["max_length"])))
        if field.kind in ("date", "timestamp"):
            found.append((f"year:{name}", passes(year_fits(field))))
    if m.selector:
        codes = [typed(m.selector, m.selector.value(v.code)) for v in m.variants]
        found.append(("subtype", passes(F.col(m.selector.name).isin(codes))))
    for variant in m.variants:
        for name, cell in variant.cells.items():
            if cell.domain:
                inside = in_domain(m.fields[name], cell.domain)
                if m.selector:
                    inside = (F.col(m.selector.name) != typed(m.selector, m.selector.value(variant.code))) | inside
                found.append((f"domain:{name}", passes(inside)))
    return found + [(f"rule:{r['name']}", rule_predicate(r, m.fields)) for r in m.rules]


def violations(definition: dict) -> Column:
    """The names of the checks that a row fails, in their order."""
    found = [F.when(~ok, F.lit(name)) for name, ok in checks(definition)]
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")


def checker(definition: dict) -> Callable[[dict[str, Any]], str | None]:
    """The same checks on rows in hand, for batches that are small enough to be: the first that a row fails, or None."""
    m, steps = Model(definition), []

    def step(name: str, ok: Callable[[dict[str, Any]], bool | None], strict: bool = False) -> None:
        steps.append((name, (lambda r: ok(r) is True) if strict else (lambda r: ok(r) is not False)))

    for name, field in m.fields.items():
        if not field.nullable:
            step(f"not_null:{name}", lambda r, n=name: r[n] is not None)
        if field.kind == "string":
            step(f"length:{name}", lambda r, n=name, most=field.traits["max_length"]: r[n] is None or len(r[n]) <= most)
        if field.kind in ("date", "timestamp"):
            step(f"year:{name}", lambda r, n=name: r[n] is None or isinstance(r[n], date | datetime))  # Python has no other years
    if m.selector:
        step("subtype", lambda r: None if r[m.selector.name] is None else m.variant(r[m.selector.name]) is not None)
    for variant in m.variants:
        for name, cell in variant.cells.items():
            if cell.domain:
                step(f"domain:{name}", lambda r, n=name, d=cell.domain, v=variant: r[n] is None or (m.selector is not None and r[m.selector.name] != v.code) or d.admits(r[n]))
    for rule in m.rules:
        if rule["kind"] == "required":
            step(f"rule:{rule['name']}", lambda r, n=rule["field"]: r[n] is not None, True)
            continue
        field, operand = m.fields[rule["field"]], rule["operand"]
        literal = field.value(operand["literal"]) if "literal" in operand else None

        def compared(r: dict[str, Any], rule=rule, other=operand.get("field"), literal=literal) -> bool:
            a, b = r[rule["field"]], r[other] if other else literal
            return a is not None and b is not None and COMPARE[rule["operator"]](a, b)

        step(f"rule:{rule['name']}", compared, True)
    return lambda row: next((name for name, ok in steps if not ok(row)), None)
