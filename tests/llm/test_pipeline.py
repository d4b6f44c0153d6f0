import hashlib
import random
import struct
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from branchstone.llm.common import shared_dir
from tests.llm.test_exact_dedup import brute as brute_exact
from tests.llm.test_exact_dedup import lower
from tests.llm.test_mixing import brute_taken
from tests.llm.test_quality_rules import brute as brute_quality
from tests.llm.test_quality_rules import corpus
from tests.llm.test_simhash import brute as brute_near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"


def documents():
    draw, rows = random.Random(9), []
    base = [(t, lang) for i, t, lang in corpus() if i is not None and i < 500]
    for text, lang in base:
        rows.append((text, lang))
        if draw.random() < 0.3:
            rows += [(text.upper() if draw.random() < 0.3 else text, lang)] * draw.randint(1, 3)
        if draw.random() < 0.3:
            words = text.split(" ")
            words[draw.randrange(len(words))] = "changed"
            rows.append((" ".join(words), lang))
    rows += [(None, None), ("", "en"), ("short text", "fr"), ("a<|endoftext|>b " * 3 + base[1][0], "en")]
    draw.shuffle(rows)
    return [(k * 3, t, lang, draw.choice(["a", "a", "b", "c", None]), None, None) for k, (t, lang) in enumerate(rows)]


def brute(rows):
    """What each stage keeps, as lists of rows, and the encoded result."""
    kept = {i: k for i, *_, k in brute_quality([(r[0], r[1], r[2]) for r in rows])}
    out = [[r for r in rows if kept[r[0]]]]
    kept = {i: k for i, _, _, k, _ in brute_exact([r[:2] for r in out[-1]])}
    out.append([r for r in out[-1] if kept[r[0]]])
    low = {i: c for i, _, c in brute_near([r[:2] for r in out[-1]])}
    out.append([r for r in out[-1] if low[r[0]] == r[0]])
    times = {i: round(t / max(n, 1)) for i, _, n, t in brute_taken([(r[0], r[1], r[3]) for r in out[-1]])}
    out.append([r for r in out[-1] for _ in range(times[r[0]])])
    library, last = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for r in out[-1]:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        last.append((r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return [*out, last]


@pytest.fixture(scope="module")
def run_of_stages(spark, tmp_path_factory):
    top, rows = tmp_path_factory.mktemp("sf"), documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{top}/documents.parquet")
    docs, got = spark.read.parquet(f"{top}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(top)).write.parquet(f"{top}/stage{k}")
        docs = spark.read.parquet(f"{top}/stage{k}")
        got.append(docs)
    return top, rows, got


def test_stages_match_brute_force(run_of_stages):
    _, rows, got = run_of_stages
    want = brute(rows)
    for k, df in enumerate(got):
        assert Counter(map(tuple, df.collect())) == Counter(want[k]), k
        if k < 4:
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
    sizes = [len(rows), *map(len, want)]
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 40


def test_run_is_the_stages(spark, run_of_stages):
    top, _, got = run_of_stages
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(top)).collect())) == Counter(map(tuple, got[-1].collect()))


def test_ids_that_repeat(spark):
    """Where ids repeat or are null, quality and near dedup decide by id, and exact dedup and mixing by row."""
    rows = documents()[:60]
    rows += [(rows[0][0], *rows[1][1:]), (None, *rows[2][1:]), (None, *rows[7][1:]), (rows[5][0], *rows[5][1:]), (rows[9][0], "too short", *rows[9][2:])]
    docs = spark.createDataFrame(rows, SCHEMA)

    def any_of(good):
        ids = {i for i, ok in good if ok}
        return Counter(r for r in rows if r[0] in ids)

    got = [Counter(map(tuple, stage(spark, docs, "").collect())) for _, stage in corpus_pipeline.STAGES[:4]]
    assert got[0] == any_of([(x[0], x[-1]) for x in brute_quality([r[:3] for r in rows])])
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r)
    last = {t: max((r[0] for r in g if r[0] is not None), default=None) for t, g in groups.items()}
    assert got[1] == Counter(r for t, g in groups.items() for r in g if r[0] == last[t])
    assert got[2] == any_of([(i, c == i) for i, _, c in brute_near([r[:2] for r in rows])])
    sums = defaultdict(lambda: [0, 0])
    for i, s, n, t in brute_taken([(r[0], r[1], r[3]) for r in rows]):
        sums[i, s, n][0] += t
        sums[i, s, n][1] += n
    times = {k: round(t / max(n, 1)) for k, (t, n) in sums.items()}
    assert got[3] == Counter(r for r in rows for _ in range(times[r[0], r[3], len((r[1] or "").split())]))


def test_intermediate_tables_go_with_their_stage(spark, run_of_stages):
    import os

    top, _, _ = run_of_stages
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, str(top)).collect()
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert left == {name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES[:-1]}


def test_rows_without_id_are_mixed(spark):
    rows = [(k, "five words in this text", "en", draw, None, None) for k, draw in enumerate("abc" * 40)]
    rows += [(None, " ".join(["word"] * (10 + k)), "en", "abc"[k % 3], None, None) for k in range(30)]
    times = {(i, s, n): round(t / n) for i, s, n, t in brute_taken([(r[0], r[1], r[3]) for r in rows])}
    want = Counter(r for r in rows for _ in range(times[r[0], r[3], len(r[1].split())]))
    assert {want[r] for r in rows if r[0] is None} > {0, 1}
    assert Counter(map(tuple, corpus_pipeline.mixed(spark, spark.createDataFrame(rows, SCHEMA), "").collect())) == want


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").collect() == []
