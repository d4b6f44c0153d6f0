import hashlib
import random
import re

import pytest

from branchstone.llm import common
from branchstone.llm.substring_dedup import substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [(i, WORDS.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = ["é", "the", "the.", "\x85", "a\xa0b", "漢字", "😀"] + [f"w{k}" for k in range(60)]
    some = lambda n: draw.choices(vocabulary, k=n)
    shared = [some(draw.choice([49, 50, 51, 60, 120, 900])) for _ in range(12)] + [["same"] * 130]
    line, rows = some(8), []
    for k in range(150):
        text = []
        for _ in range(draw.randint(1, 5)):
            text += draw.choice([line, some(draw.randint(0, 90))])
            if draw.random() < 0.4:
                p = draw.choice(shared)
                a = draw.randint(0, max(0, len(p) - 55)) if draw.random() < 0.5 else 0
                text += p[a : a + draw.choice([50, 70, 2000])]
        rows.append((draw.randrange(100_000), "".join(w + draw.choice([" ", " ", "\n", "\t ", "\r\n"]) for w in text)))
    rows += [(draw.randrange(100_000), rows[k][1]) for k in (3, 3, 3, 8, 9)]
    rows += [(200_000, None), (200_001, ""), (200_002, " ".join(some(49))), (None, rows[3][1]), (None, " ".join(shared[5])), (rows[8][0], rows[8][1]), (rows[9][0], rows[10][1]), (-5, " ".join(shared[0] + shared[4]))]
    rows += [(300_000 + k, "hot " * 55 + " ".join(shared[3])) for k in range(40)]
    return rows


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"shard_bytes": 3000, "segment_words": 60, "most_filter_bits": 15}), (3, {"window": 50, "phrase": 50, "segment_words": 50})])
def test_matches_brute_force(spark, seed, options):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as id", "3 as shard", "4 as hash").repartition(3)
    got = substring_dedup(df, **options).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == brute(rows, 50)
    assert sum(r.n_removed for r in got) > 5000
    for r in got:
        assert r.kept_text is None or hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_empty(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert substring_dedup(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()[0][:3] == (1, 2, 0)


def test_long_texts(spark):
    """Texts that are taken in parts: passages over the parts' borders, in short texts, and around a word longer than a part."""
    draw = random.Random(9)
    word = lambda k: f"{k:x}é" * 30
    some = lambda n: [word(draw.randrange(1 << 40)) for _ in range(n)]
    passage, giant = some(400), "g" * (1 << 20) + "é"
    around = some(30) + [giant] + some(30)
    rows = [
        (1, some(60) + passage[:80] + some(3000) + around + some(2000)),
        (2, some(20) + passage[70:300] + some(10)),
        (3, some(2500) + passage + some(2500) + passage[100:160] + some(900)),
        (4, around[5:] + some(5)),
        (5, passage[60:120]),
        (6, some(5200)),
        (None, passage + some(4000)),
    ]
    rows += [(7, rows[2][1]), (8, rows[5][1][2000:2049])]
    data = [(i, draw.choice([" ", "\n"]).join(w)) for i, w in rows]
    assert sum(len(t.encode()) > 1 << 20 for _, t in data) >= 5
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    for shard_bytes in (1 << 20, 100_000):
        got = substring_dedup(df, shard_bytes=shard_bytes).collect()
        assert sorted((tuple(r)[:4] for r in got), key=repr) == brute(data, 50)
    for r in got:
        assert r.kept_text is None or hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_hot_windows_and_no_ids(spark, monkeypatch):
    """One window in a third of all documents, and documents without ids, which go nowhere."""
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    draw = random.Random(3)
    hot = " ".join(f"h{k}" for k in range(55))
    rows = [(k, f"a{k} b{k} " + (hot if k % 3 == 0 else " ".join(f"x{draw.randrange(50)}" for _ in range(70)))) for k in range(300)]
    rows += [(None, hot)] * 50
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shard_bytes=2000).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == brute(rows, 50)
    nameless = spark.createDataFrame([(None, t) for _, t in rows], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup(nameless).collect()} == {0}
