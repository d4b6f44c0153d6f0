"""Chat formatting, native: tool calls and results linked by identifier, in topological order, validated and serialised."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, running_sum, written

# The kinds of variants that make up each type of a schema; a double is an integer if it is a whole number.
TYPES = {"string": "STRING", "integer": "BIGINT|DECIMAL\\(\\d+,0\\)|DOUBLE", "number": "BIGINT|DECIMAL\\(.*|DOUBLE", "boolean": "BOOLEAN", "null": "VOID", "array": "ARRAY<.*", "object": "OBJECT<.*"}
KNOWN = {"type", "properties", "required", "additionalProperties"}, {"type", "enum", "minimum", "maximum", "minLength", "maxLength"}
WHOLE, PART = "decimal(38,0)", "decimal(38,38)"


def _is_number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def _parts(x: int | float) -> tuple[bool, Decimal, Decimal]:
    """Whether a bound is negative, and its whole and broken part; ValueError beyond 38 digits of either."""
    sign, digits, exponent = Decimal(str(x)).as_tuple()
    if not isinstance(exponent, int):
        raise ValueError(f"not a number: {x}")
    text = "".join(map(str, digits)) + "0" * max(exponent, 0)
    whole, part = (text, "") if exponent >= 0 else (text.rjust(1 - exponent, "0")[:exponent], text.rjust(1 - exponent, "0")[exponent:])
    if len(whole.lstrip("0")) > 38 or len(part) > 38:
        raise ValueError(f"too many digits: {x}")
    return bool(sign and x), Decimal(whole), Decimal(f"0.{part or 0}")


def check(schema: dict) -> None:
    """Refuses what `errors_of` would not hold: it covers objects of plain properties."""
    if schema.get("type") != "object" or set(schema) - KNOWN[0]:
        raise ValueError(f"unsupported schema: {sorted(schema)}")
    for name, rule in schema.get("properties", {}).items():
        if set(rule) - KNOWN[1] or rule.get("type") not in TYPES or '"' in name or "\\" in name:
            raise ValueError(f"unsupported property {name}: {rule}")
        for x in [rule[k] for k in ("minimum", "maximum") if k in rule] + [x for x in rule.get("enum", ()) if _is_number(x)]:
            _parts(x)
        if not all(x is None or isinstance(x, str | bool | int | float) for x in rule.get("enum", ())):
            raise ValueError(f"unsupported enum of {name}")


class Found:
    """A property's value: its kind and what it is compared by."""

    def __init__(self, value: Column, name: str):
        self.value = F.try_variant_get(value, f'$["{name}"]', "variant")
        self.kind = F.schema_of_variant(self.value)
        self.text = F.try_variant_get(self.value, "$", "string")
        self.double = F.try_variant_get(self.value, "$", "double")

    def is_a(self, kind: str) -> Column:
        right = self.kind.rlike(f"^(?:{TYPES[kind]})$")
        return right & ((self.kind != "DOUBLE") | (F.rint(self.double) == self.double)) if kind == "integer" else right

    def finite(self) -> Column:
        return (self.kind != "DOUBLE") | (F.abs(self.double) < float("inf"))

    def against(self, bound: int | float) -> Column:
        """-1, 0 or 1: exact for whole and decimal numbers of up to 38 digits, whose text is plain; doubles as doubles."""
        negative, whole, part = _parts(bound)
        digits = F.struct(F.regexp_extract(self.text, r"^-?(\d+)", 1).try_cast(WHOLE).alias("w"), F.concat(F.lit("0."), F.regexp_extract(self.text, r"\.(\d+)$", 1), F.lit("0")).try_cast(PART).alias("p"))
        other = F.struct(F.lit(whole).cast(WHOLE).alias("w"), F.lit(part).cast(PART).alias("p"))
        size = F.when(digits < other, -1).when(digits > other, 1).otherwise(0)
        below = F.startswith(self.text, F.lit("-"))
        exact = F.when(below, -size).otherwise(1) if negative else F.when(below, -1).otherwise(size)
        near = F.when(self.double < float(bound), -1).when(self.double > float(bound), 1).otherwise(0)
        return F.when(self.kind == "DOUBLE", near).otherwise(exact)

    def equals(self, x: Any) -> Column:
        if _is_number(x):
            return self.is_a("number") & (self.against(x) == 0)
        if isinstance(x, bool):
            return (self.kind == "BOOLEAN") & (self.text == str(x).lower())
        return self.kind == "VOID" if x is None else (self.kind == "STRING") & (self.text == x)


def errors_of(value: Column, raw: Column, schema: dict) -> Column:
    """What is wrong with arguments (a variant and its text) under a schema: an array of short strings, in a fixed order."""
    properties, found = schema.get("properties", {}), []
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    for name in schema.get("required", []):
        found.append(F.when(~F.array_contains(keys, name), F.lit(f"missing {name}")))
    for name, rule in properties.items():
        at, there = Found(value, name), F.array_contains(keys, name)
        right = F.coalesce(at.is_a(rule["type"]), F.lit(False))
        found.append(F.when(there & ~right, F.lit(f"type {name}")))
        limits = {k: f(rule[k]) for k, f in {"minimum": lambda x: at.against(x) >= 0, "maximum": lambda x: at.against(x) <= 0, "minLength": lambda x: F.length(at.text) >= x, "maxLength": lambda x: F.length(at.text) <= x}.items() if k in rule}
        for k, ok in limits.items():  # length bounds are for texts and the others for numbers: what cannot be compared is wrong
            met = at.is_a("string") if k.endswith("Length") else at.is_a("number")
            found.append(F.when(there & right & met & ~F.coalesce(ok, F.lit(False)), F.lit(f"{k} {name}")))
        if "enum" in rule:
            allowed = reduce(lambda a, b: a | b, map(at.equals, rule["enum"]), F.lit(False))
            found.append(F.when(there & right & ~F.coalesce(allowed, F.lit(False)), F.lit(f"enum {name}")))
    if schema.get("additionalProperties") is False:
        more = F.array_sort(F.array_except(keys, F.array(*map(F.lit, properties)).cast("array<string>")))
        found.append(F.when(F.size(more) > 0, F.concat(F.lit("additional "), F.array_join(more, ","))))
    return F.filter(F.array(*found) if found else F.array().cast("array<string>"), lambda e: e.isNotNull())


def outside(text: Column) -> Column:
    """A JSON text without its strings and escapes."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), '"[^"]*"', '""')


def too_large(raw: Column) -> Column:
    """Whether a JSON text has a number that no double reaches."""
    numbers = F.regexp_extract_all(outside(raw), F.lit(r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"), F.lit(1))
    beyond = F.exists(numbers, lambda x: ~(F.abs(x.try_cast("double")) < float("inf")))
    return F.when(raw.rlike(r"[0-9][eE]\+?[0-9]{3}|[0-9]{309}"), beyond).otherwise(F.lit(False))


def canonical_numbers(line: Column, raw: Column) -> Column:
    """The line with doubles in their shortest form: 1000, 1e300 and 1.5e-7 for 1000.0, 1.0E300 and 1.5E-7.

    Quotation marks that end no string are put aside first, so that every second part between quotation marks is none."""
    marked = F.replace(F.replace(line, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    shorter = lambda p: F.translate(F.regexp_replace(p, r"(?<=[0-9])\.0(?=E|[,\]}]|$)", ""), "E", "e")
    parts = F.transform(F.split(marked, '"', -1), lambda p, k: F.when(k % 2 == 0, shorter(p)).otherwise(p))
    whole = F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return F.when(raw.rlike(r"[0-9][eE][+-]?[0-9]|[0-9.]{39}"), whole).otherwise(line)


def validated(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls with `arguments` as a variant and `errors`."""
    calls = calls.withColumn("value", F.try_parse_json("arguments"))
    calls = calls.withColumn("beyond", F.coalesce(too_large(F.col("arguments")), F.lit(False)))
    out = F.array(F.lit("unknown tool"))
    for name, schema in schemas.items():
        check(schema)
        out = F.when(F.col("name") == name, errors_of(F.col("value"), F.col("arguments"), schema)).otherwise(out)
    plain = F.coalesce(F.schema_of_variant("value").startswith("OBJECT<"), F.lit(False))
    return calls.withColumn("errors", F.when(~plain, F.array(F.lit("not an object"))).when(F.col("beyond"), F.array(F.lit("number out of range"))).otherwise(out))


def depths(nodes: DataFrame) -> DataFrame:
    """nodes (key, after, ...) with depth: how many nodes lead to each, by doubling pointers; -1 in or behind a cycle.

    after: the key of the node before, null for none. Each round halves what is left of the longest chain and writes
    only nodes that have not met their chain's end; a cycle has no end, so what has found none after as many rounds as
    the number of nodes has bits is in or behind one."""
    more = [c for c in nodes.columns if c not in ("key", "after")]
    done = [nodes.where("after is null").select("key", *more, F.lit(0).cast("long").alias("depth"))]
    active = written(nodes.where("after is not null").select("key", F.col("after").alias("up"), *more, F.lit(1).cast("long").alias("depth")), "pointers")
    left = active.count()
    most, rounds = left.bit_length() + 1, 0
    while left and rounds < most:
        ended = reduce(DataFrame.unionByName, [d.select("key", F.lit(None).cast(nodes.schema["key"].dataType).alias("up"), "depth") for d in done])
        step = ended.unionByName(active.select("key", "up", "depth")).toDF("up", "next", "more")
        moved = active.join(step, "up").select("key", F.col("next").alias("up"), *more, (F.col("depth") + F.col("more")).alias("depth"))
        moved = written(moved, "pointers")
        done.append(moved.where("up is null").drop("up"))
        active, rounds = moved.where("up is not null"), rounds + 1
        left = active.count()
    if left:
        done.append(active.select("key", *more, F.lit(-1).cast("long").alias("depth")))
    return reduce(DataFrame.unionByName, done)


def _digest(*parts: Column) -> Column:
    """16 bytes for a few texts: what is linked and ordered is this, not they."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row for each call: conv_id, call_id, depth, position, n_results, duplicate, after_missing, valid, errors, json.

    calls: conv_id, call_id, turn (>= 0), name, arguments (JSON text), after (the call_id it waits for, or null).
    results: conv_id, call_id, turn, content. schemas: JSON Schemas of plain objects by tool name, in the driver's hands.

    Calls and results are joined by a hash of (conv_id, call_id). An identifier belongs to the first call by turn, then
    by a digest of name and arguments; later calls with it are duplicates: they get no result and wait for nothing. Of
    several results the first by turn, then content, is taken and all are counted; results without a call go. A call's
    `after` that no call of the conversation has is reported and counts as none. depth: how many calls lead to a call; -1
    in or behind a cycle. position: the place among the conversation's calls by depth, turn, call_id, so that each comes
    after what it waits for, those without end last; calls equal in all of these and in the digest share the place of the
    first of them. json: {"after","arguments","id","name","result"}, keys sorted at every level, no white space, whole and
    decimal numbers in their shortest plain form, others as 1.5e-7. valid: no error against the tool's schema.

    Numbers of up to 38 digits without an exponent are exact and are compared exactly; others are the nearest double and
    compared as such. Arguments with a number beyond all doubles have the error "number out of range" alone; like
    arguments that are no JSON they are null in json. Null conv_ids are a conversation of their own; null call_ids are an
    identifier like any other; null turns count as 0, null names as no tool, null arguments as no JSON. Equal rows give
    equal rows. Other columns are ignored. Empty calls give an empty result. No conversation and no identifier is
    gathered, whatever its share of the rows and however its turns repeat: linking and ordering work on summed rows of
    keys and digests, sorted in runs; texts move when linked to their place and to their result."""
    nothing = F.lit("\x00")
    conv = F.coalesce(F.col("conv_id").cast("string"), nothing)
    key = _digest(conv, F.coalesce("call_id", nothing))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(0))
    calls = calls.select("conv_id", F.col("call_id").cast("string").alias("call_id"), turn.alias("turn"), *[F.col(c).cast("string").alias(c) for c in ("name", "arguments", "after")])
    calls = calls.withColumn("key", key).withColumn("digest", _digest(*[F.coalesce(c, nothing) for c in ("name", "arguments")]))
    calls = calls.withColumn("call", F.unhex(F.md5(F.concat("key", F.col("turn").cast("string").cast("binary"), "digest"))))
    results = results.select("conv_id", F.col("call_id").cast("string").alias("call_id"), turn.alias("turn"), F.col("content").cast("string").alias("content"))
    answers = results.select(key.alias("key"), F.struct("turn", "content").alias("r")).groupBy("key").agg(F.min("r").alias("r"), F.count("*").alias("n_results"))

    distinct = calls.groupBy("call", "key", conv.alias("conv"), "call_id", "turn", "digest").agg(F.count("*").alias("n"), F.min(F.struct("after")).alias("own"))
    distinct = written(distinct, "distinct-calls")
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    names = distinct.groupBy("key", "conv").agg(F.min(F.struct("turn", "digest", "own.after", "call")).alias("first"))
    names = names.select("key", "first.call", F.col("first.after").alias("after_id"), F.when(F.col("first.after").isNotNull(), _digest(F.col("conv"), F.col("first.after"))).alias("wanted"))
    names = written(names, "names")
    waiting = names.where("wanted is not null").join(names.select(F.col("key").alias("wanted"), F.lit(True).alias("there")), "wanted", "left")
    waiting = waiting.select("key", "call", "after_id", F.when(F.col("there"), F.col("wanted")).alias("after"), F.col("there").isNull().alias("after_missing"))
    free = names.where("wanted is null").select("key", "call", "after_id", F.lit(None).cast("binary").alias("after"), F.lit(False).alias("after_missing"))
    firsts = depths(written(waiting.unionByName(free), "waits")).drop("key")
    places = distinct.join(firsts, "call", "left").withColumn("duplicate", F.col("depth").isNull())
    places = places.withColumn("depth", F.coalesce("depth", F.lit(0).cast("long"))).withColumn("rank", F.when(F.col("depth") < 0, F.lit((1 << 62))).otherwise(F.col("depth")))
    places = written(places.select("call", "conv", F.coalesce("call_id", F.lit("")).alias("name_"), F.col("call_id").isNotNull().alias("named"), "turn", "digest", "n", "duplicate", "depth", "rank", "after_id", F.coalesce("after_missing", F.lit(False)).alias("after_missing")), "places")
    places = running_sum(places, ["conv"], ["rank", "turn", "named", "name_", "digest"], "n", "before")
    places = written(places.select("call", "n", "duplicate", "depth", "after_id", "after_missing", (F.col("before") + 1).alias("position")), "positions")

    linked = join_groups(calls.select("conv_id", "call_id", "name", "arguments", "key", "call"), places, "call", "n", total)
    # duplicates get no result: keys of their own keep them apart
    linked = linked.withColumn("key", F.when(F.col("duplicate"), F.concat(F.lit(b"-"), "call")).otherwise(F.col("key")))
    linked = linked.join(answers.hint("shuffle_hash"), "key", "left")
    linked = validated(linked, schemas)
    line = F.to_json(F.struct(F.col("after_id").alias("after"), F.when(~F.col("beyond"), F.col("value")).alias("arguments"), F.col("call_id").alias("id"), "name", F.col("r.content").alias("result")), {"ignoreNullFields": "false"})
    line = canonical_numbers(line, F.col("arguments"))
    return linked.select("conv_id", "call_id", "depth", "position", F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"), "duplicate", "after_missing", (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), F.coalesce(line, F.lit("")).alias("json"))
