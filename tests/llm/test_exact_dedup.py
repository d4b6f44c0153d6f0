import hashlib

import pytest

from branchstone.llm.exact_dedup import exact_dedup, filter_bits


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        group = groups[lower(t)]
        keep = max((x for x in group if x is not None), default=None)
        out.append((i, keep, len(group), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [15, 28])
def test_matches_brute_force(spark, bits):
    rows = [(i, f"Text {i % 40} É") for i in range(0, 300, 3)] + [(1000 + i, "HOT" if i % 2 else "hot") for i in range(2500)]
    rows += [(5000, None), (5001, ""), (5002, "é"), (5003, "É"), (5004, "x" * 300_000), (5005, "X" * 300_000), (None, "lone"), (None, "pair"), (5006, "PAIR"), (5007, "same"), (5007, "same"), (5008, "ß"), (5009, "SS")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as Kept", "'y' as cell", "1 as n", "2 as bucket")
    out = exact_dedup(df, most_filter_bits=bits)
    assert out.columns == ["doc_id", "text", "cell", "n", "bucket", "keep_id", "group_size", "kept", "text_sha256"]
    got = sorted((tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)
    assert got == brute(rows)


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_filter_is_bounded():
    assert filter_bits(0) == 15
    assert filter_bits(10**12) == 28
