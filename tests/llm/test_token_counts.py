import random

import public_tokenizers
import regex

from branchstone.llm import token_counts as module
from branchstone.llm.pretokens import PATTERN, pretokens, split
from branchstone.llm.token_counts import Trie, read_costs, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(raw, costs, known):
    if not raw:
        return 0, 0
    if raw not in known:
        ends = [(k, costs.get(raw[k:], 30_000_000 if k == len(raw) - 1 else None)) for k in range(len(raw))]
        known[raw] = min((c + d[0], 1 + d[1]) for k, c in ends if c is not None for d in [brute(raw[:k], costs, known)])
    return known[raw]


def texts():
    draw = random.Random(4)
    return ["", " ", "I'm we're  don't", "x" * 500, "é漢字😀 ١ \u0085 \x1c"] + ["".join(draw.choices("abcdeth 'sERé\n.,19漢", k=draw.randint(1, 80))) for _ in range(400)]


def test_counts_match_brute_force(spark, monkeypatch):
    costs = read_costs(PATH)
    rows = [(k, t) for k, t in enumerate(texts())] + [(9000, None), (9001, "twice"), (9001, "twice"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_Tokens", "'x' as other")
    got = token_counts(df, PATH).collect()
    assert got[0].__fields__ == ["doc_id", "other", "n_pretokens", "n_tokens"]
    known, want = {}, []
    for k, t in rows:
        words = regex.findall(PATTERN, t or "")
        want.append((k, "x", len(words), sum(brute(w.encode(), costs, known)[1] for w in words)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_unknown_bytes_and_ties():
    trie = Trie({b"a": 5, b"b": 5, b"ab": 10, b"bc": 30_000_005})
    assert trie.counts(["ab", "abc", "z"]) == 1 + 2 + 1  # ties go to fewer tokens


def test_forgetting_changes_nothing(monkeypatch):
    costs, lists = read_costs(PATH), [split(t) for t in texts()]
    want = list(map(Trie(costs).counts, lists))
    monkeypatch.setattr(module, "MOST_NODES", 10)
    trie = Trie(costs)
    assert list(map(trie.counts, lists)) == want


def test_prefixes_are_shared():
    trie = Trie(read_costs(PATH))
    trie.counts(["nation", "national", "nationals"])
    assert len(trie.best) == 1 + len("nationals")


def test_empty(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_long_texts_are_cut_between_pretokens():
    for text in [*texts(), "a  b \n c 's " * 50, "don't '  \n\n x", "漢字。かな、" * 20]:
        for most in (1, 2, 3, 10, 1000):
            assert [w for run in pretokens(text, most) for w in run] == regex.findall(PATTERN, text)


def test_long_words_need_no_nodes():
    draw, costs = random.Random(8), read_costs(PATH)
    trie, known = Trie(costs), {}
    for word in ["".join(draw.choices("abcdeth", k=n)) for n in (257, 700)] + ["é" * 400, "ab" * 300, "\x00\x01" * 300]:
        raw = word.encode()
        for k in range(0, len(raw), 200):  # the brute force recurs
            brute(raw[:k], costs, known)
        assert trie.counts([word, word]) == 2 * brute(raw, costs, known)[1]
        assert trie.rolling(raw) == Trie(costs).insert(raw)
    assert len(trie.best) == 1


def test_memory_of_a_long_word():
    """10 MB without a space, in a process of its own."""
    import subprocess
    import sys

    code = """
import resource, sys
from branchstone.llm.pretokens import pretokens
from branchstone.llm.token_counts import Trie, read_costs
trie, text = Trie(read_costs(sys.argv[1])), "x7Qz" * 2_500_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
print(sum(trie.counts(w) for w in pretokens(text)))
print(sum(trie.counts(w) for w in pretokens("a" * 3_000_000)))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    said = subprocess.run([sys.executable, "-c", code, PATH], capture_output=True, text=True, check=True)
    assert int(said.stdout.split()[-1]) < 150
