"""Typed gates: text to exact values in the JVM, refusing what a cast would round, cut or guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.definition import DATE, DECIMAL, INTEGER, TIMESTAMP, UUID
from .predicates import spark_type

PATTERNS = {"int32": INTEGER, "int64": INTEGER, "decimal": DECIMAL, "uuid": UUID, "date": DATE, "timestamp": TIMESTAMP, "boolean": "true|false"}


def spelled(text: Column, pattern: str) -> Column:
    r"""The whole text: $ would let a final line feed pass, \z does not."""
    return text.rlike(rf"\A(?:{pattern})\z")


def gate(text: Column, field: dict) -> Column:
    """A struct (ok, value) for the text of a value of a field: null text is a null value and ok if the field may be null."""
    kind = field["type"]
    if kind == "string":
        good = F.char_length(text) <= field["max_length"]
        value = text
    else:
        shape = spelled(text, PATTERNS[kind])
        source = F.when(shape, text)
        good = shape
        if kind == "decimal":
            whole, places = F.regexp_extract(source, r"\A-?0*([0-9]*)", 1), F.rtrim(F.regexp_extract(source, r"\.([0-9]+)\z", 1), F.lit("0"))
            good = shape & (F.length(whole) <= field["precision"] - field["scale"]) & (F.length(places) <= field["scale"])
            source = F.when(good, source)
        if kind == "uuid":
            value = F.lower(source)
        elif kind == "timestamp":
            value = F.try_to_timestamp(F.upper(source))
        else:
            value = source.try_cast(spark_type(field))
        good = good & value.isNotNull()
        if kind in ("date", "timestamp"):
            good = good & F.year(value).between(1, 9999)
    ok = F.when(text.isNull(), F.lit(field["nullable"])).otherwise(F.coalesce(good, F.lit(False)))
    return F.struct(ok.alias("ok"), F.when(ok, value).alias("value"))


def gate_rows(df, definition: dict):
    """df with a text column for each field, as typed columns and `errors`, the fields whose text is refused.

    Every check is a Column expression, so a load of any size is gated as it is read."""
    gated = df.withColumns({f"__{f['name']}": gate(F.col(f["name"]), f) for f in definition["fields"]})
    errors = F.array(*[F.when(~F.col(f"__{f['name']}.ok"), f["name"]) for f in definition["fields"]])
    others = [c for c in df.columns if c not in {f["name"] for f in definition["fields"]}]
    return gated.select(*others, *[F.col(f"__{f['name']}.value").alias(f["name"]) for f in definition["fields"]], F.filter(errors, lambda x: x.isNotNull()).alias("errors"))
