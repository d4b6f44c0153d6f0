import hashlib
import json
import math
import random
from bisect import bisect_left
from collections import Counter, defaultdict
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from branchstone.llm.queries import SCHEMAS
from branchstone.llm import common
from branchstone.llm.tool_calls import check, depths, link_tool_calls, validated

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after string"
RESULTS = "conv_id long, call_id string, turn long, content string"


getcontext().prec = 80


class Beyond(Exception):
    pass


def double(text):
    if math.isinf(x := float(text)):
        raise Beyond
    return x


def exact(text):
    """A number without an exponent and of up to 38 digits is exact, any other the nearest double."""
    if set(text) & set("eE") or len(text.strip("-").replace(".", "")) > 38:
        return double(text)
    x = Decimal(text)
    return int(x) if x == x.to_integral_value() else x


def dumps(x):
    if isinstance(x, dict):
        return "{" + ",".join(f"{dumps(k)}:{dumps(x[k])}" for k in sorted(x)) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(dumps, x)) + "]"
    if isinstance(x, Decimal):
        return format(x.normalize(), "f")
    if isinstance(x, float):
        _, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
        high, digits = len(digits) + exponent - 1, "".join(map(str, digits))
        if -3 <= high < 7 or not x:
            return format(Decimal(repr(x)).normalize(), "f")
        return f"{'-' * (x < 0)}{digits[0]}{'.' * (len(digits) > 1)}{digits[1:]}e{high}"
    return json.dumps(x, ensure_ascii=False)


def schema_errors(name, raw):
    def pairs(found):
        if len({k for k, _ in found}) < len(found):
            raise ValueError
        return dict(found)

    beyond = False
    try:
        value = json.loads(raw, object_pairs_hook=pairs, parse_int=exact, parse_float=exact)
    except Beyond:
        value, beyond = json.loads(raw), True
    except (TypeError, ValueError):
        value = None
    if not isinstance(value, dict):
        return "not an object", None if beyond else value
    if beyond:
        return "number out of range", None
    if name not in SCHEMAS:
        return "unknown tool", value
    schema, out = SCHEMAS[name], []
    out += [f"missing {k}" for k in schema["required"] if k not in value]
    for k, rule in schema["properties"].items():
        if k not in value:
            continue
        v = value[k]
        if rule["type"] == "string" and not isinstance(v, str) or rule["type"] == "integer" and (isinstance(v, bool) or not isinstance(v, int | float | Decimal) or v != int(v)):
            out.append(f"type {k}")
            continue
        out += [f"{w} {k}" for w, bad in (("minimum", lambda: v < rule["minimum"]), ("maximum", lambda: v > rule["maximum"]), ("minLength", lambda: len(v) < rule["minLength"]), ("maxLength", lambda: len(v) > rule["maxLength"])) if w in rule and bad()]
        if "enum" in rule and v not in rule["enum"]:
            out.append(f"enum {k}")
    if more := sorted(set(value) - set(schema["properties"])):
        out.append("additional " + ",".join(more))
    return "; ".join(out), value


def low_of(c):
    text = "\x1f".join("\x00" if x is None else x for x in c[3:5])
    return c[2] or 0, hashlib.md5(text.encode()).hexdigest()


def brute(calls, results):
    first, answers = {}, defaultdict(list)
    for c in calls:
        first[c[:2]] = min(first.get(c[:2], (low_of(c), c)), (low_of(c), c), key=lambda x: (x[0], x[1][5] is not None, x[1][5] or ""))
    for conv, call, turn, content in results:
        answers[conv, call].append((turn or 0, content is not None, content or ""))

    def depth(key):
        seen, n = set(), 0
        while True:
            if key in seen:
                return -1
            seen.add(key)
            after = first[key][1][5]
            if after is None or (key[0], after) not in first:
                return n
            key, n = (key[0], after), n + 1

    rows = defaultdict(list)
    for c in calls:
        key, duplicate = c[:2], low_of(c) != first[c[:2]][0]
        wanted = None if duplicate else first[key][1][5]
        found = [] if duplicate else answers[key]
        errors, value = schema_errors(c[3], c[4])
        content = min(found)[2] if found and min(found)[1] else None
        line = dumps({"after": wanted, "arguments": value, "id": c[1], "name": c[3], "result": content})
        d = 0 if duplicate else depth(key)
        place = (d if d >= 0 else 10**12, c[2] or 0, c[1] is not None, c[1] or "", low_of(c)[1])
        rows[c[0]].append((place, c[1], d, (len(found), duplicate, wanted is not None and (c[0], wanted) not in first, errors == "", errors, line)))
    out = []
    for conv, x in rows.items():
        places = sorted(r[0] for r in x)
        out += [(conv, r[1], r[2], bisect_left(places, r[0]) + 1, *r[3]) for r in x]
    return Counter(out)


ARGUMENTS = ['{"query":"é\\n\\"","limit":3}', '{"limit":11,"query":""}', '{"limit":"3","query":"x"}', '{"query":"x"}', '{"limit":3,"query":"x","z":[1,{"b":2,"a":null}],"a":true}', "[1]", "nope", None, "", '{"text":"hallo","target":"de"}', '{"target":"it","text":"x"}', '{"text":null,"target":5}', '{"limit":1,"limit":2}', "{}", " { } ", '"x"', "null"]


NUMBERS = ["1" + "0" * 36, "-1" + "0" * 36, "1e300", "-1e300", "1e400", "-1e400", "1" + "0" * 60, "1" + "0" * 400, "3.0", "3.50", "10.0000001", "0.9999999", "1e0", "1E1", "25e-1", "1.0000001", "-0.0000001", "0", "-0", "-0.0", "1.25E-7", "1e22", "0.5e1", "10." + "0" * 30 + "1", "100000000000000000000.5"]
ARGUMENTS += [f'{{"query":"x","limit":{n}}}' for n in NUMBERS]
ARGUMENTS += ['{"query":"say \\"1.0E300\\": 1.0, 1e400 \\\\","limit":1e0,"z":[1.0E300,{"a":-2.50e-9}]}', '{"query":"x 1e400","limit":2}', '{"query":"x","limit":2,"z":[[1e999]]}', "1e400"]


def data(seed):
    draw, calls, results = random.Random(seed), [], []
    for conv in [1, 2, 3, None, 5]:
        ids = [f"c{k}" for k in range(12)] + [None]
        for k in range(draw.randint(10, 25)):
            calls.append((conv, draw.choice(ids), draw.choice([k, k, None]), draw.choice(["search", "translate", "other", None]), draw.choice(ARGUMENTS), draw.choice(ids + ["nowhere"])))
        for _ in range(20):
            results.append((conv, draw.choice(ids + ["nobody"]), draw.choice([1, 2, None]), draw.choice(["r", "r\té", None])))
    calls += [calls[0]] * 2
    calls += [(7, f"h{k}", k, "search", ARGUMENTS[0], f"h{k - 1}" if k else None) for k in range(40)]  # one long chain
    calls += [(8, "hot", k, "search", ARGUMENTS[0], None) for k in range(2500)]  # one identifier
    calls += [(9, f"s{k}", draw.choice([5, None]), "search", ARGUMENTS[0], None) for k in range(2000)]  # one conversation of equal turns
    results += [(8, "hot", k, "hot") for k in range(2500)]
    return calls, results


@pytest.mark.parametrize("seed", [2])
def test_matches_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 500)  # so that the large conversations are sorted in runs
    monkeypatch.setattr(common.running_sum, "__defaults__", (500,))
    calls, results = data(seed)
    left = spark.createDataFrame(calls, CALLS).selectExpr("*", "1 as key", "2 as depth", "3 as first", "4 as conv", "5 as run").repartition(3)
    right = spark.createDataFrame(results, RESULTS).selectExpr("*", "1 as key", "2 as name")
    got = Counter(map(tuple, link_tool_calls(left, right, SCHEMAS).collect()))
    want = brute(calls, results)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    assert {r[2] for r in got} >= {-1, 0, 39}
    python = [n for n in ("Python", "Pandas", "Arrow") if n in link_tool_calls(left, right, SCHEMAS)._jdf.queryExecution().executedPlan().toString()]
    assert not python


def test_depths_double(spark):
    rows = [(str(k), str(k - 1) if k else None) for k in range(300)] + [("a", "b"), ("b", "a"), ("c", "a"), ("d", "d")]
    got = dict(tuple(r) for r in depths(spark.createDataFrame(rows, "key string, after string")).collect())
    assert got == {str(k): k for k in range(300)} | dict.fromkeys("abcd", -1)


def test_empty_and_refusals(spark):
    calls, results = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    assert link_tool_calls(calls, results, SCHEMAS).collect() == []
    one = spark.createDataFrame([(1, "x", 0, "search", ARGUMENTS[0], None)], CALLS)
    assert link_tool_calls(one, results, SCHEMAS).select(F.col("valid"), "n_results").collect() == [(True, 0)]
    with pytest.raises(ValueError):
        link_tool_calls(one, results, {"search": {"type": "object", "oneOf": []}})


NUMERIC = {"type": "object", "properties": {"n": {"type": "number", "minimum": 0, "maximum": 1}}, "required": ["n"]}


def test_numbers_are_compared_exactly(spark):
    """What a narrower decimal would round or lose."""
    bounds = [0, 1, -0.5, 0.1, 10**37, -(10**20), 1e-30]
    calls = spark.createDataFrame([(1, f"c{k}", k, "t", f'{{"n":{n}}}', None) for k, n in enumerate(NUMBERS)], CALLS)
    for low, high in [(a, b) for a in bounds for b in bounds if a <= b][::6]:
        schema = {"type": "object", "properties": {"n": {"type": "number", "minimum": low, "maximum": high, "enum": [1, 3, 0.5, 10**36, "x", None, True]}}}
        got = {int(r.call_id[1:]): r.errors for r in validated(calls, {"t": schema}).selectExpr("call_id", "array_join(errors, '; ') as errors").collect()}
        for k, n in enumerate(NUMBERS):
            try:
                v = exact(n)
            except Beyond:
                assert got[k] == "number out of range", n
                continue
            low_, high_ = ((float(b) if isinstance(v, float) else Decimal(str(b))) for b in (low, high))
            enum = [1, 3, 0.5, 10**36]
            listed = any(v == (float(x) if isinstance(v, float) else Decimal(str(x))) for x in enum)
            want = ["minimum n"] * (v < low_) + ["maximum n"] * (v > high_) + ["enum n"] * (not listed)
            assert got[k] == "; ".join(want), (n, low, high)


def test_refused_bounds():
    for bound in (10**38, 1e-45, float("inf")):
        with pytest.raises(ValueError):
            check({"type": "object", "properties": {"n": {"type": "number", "maximum": bound}}})


def test_running_sum_in_runs(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "a", "a", "b", "c"]), k, draw.randint(0, 9)) for k in range(3000)]
    df = common.written(spark.createDataFrame(rows, "k string, at long, n long"), "rows")
    sums, want = defaultdict(int), {}
    for k, at, n in sorted(rows):
        want[k, at] = sums[k]
        sums[k] += n
    for most in (100, 10_000):
        assert {(r.k, r.at): r.before for r in common.running_sum(df, ["k"], ["at"], "n", "before", most).collect()} == want
