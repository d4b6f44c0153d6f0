import math
import random
import re
from collections import Counter

import numpy as np

from branchstone.llm.quality_rules import ASCII_CLASSES, CLASSES, COMMON_WORDS, FIRST_BYTES, distances, quality_rules, vocabulary

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def brute_histograms(text):
    classes, words = Counter(), Counter()
    for c in text or "":
        name = next((n for n, chars in ASCII_CLASSES.items() if c in chars), None)
        if name is None:
            first = c.encode()[0]
            name = next((n for n, r in FIRST_BYTES.items() if first in r), "control")
        classes[name] += 1
    known = set(vocabulary(COMMON_WORDS))
    for w in WORDS.findall(text or ""):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
        w = w[:-1] if w[-1] in ".,;:!?" else w
        words[w if w in known else None] += 1
    return [classes[n] for n in CLASSES], [words[n] for n in [*vocabulary(COMMON_WORDS), None]]


def brute_distance(p, q):
    p, q = [[x / (sum(y) or 1) for x in y] for y in (p, q)]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    d = sum(sum(a * math.log2(a / b) for a, b in zip(x, m) if a) for x in (p, q)) / 2
    return math.sqrt(max(d, 0))


def brute(rows, rounds=3):
    docs = []
    for i, text, lang in rows:
        base = brute_base(text)
        docs.append((i, lang if lang in COMMON_WORDS else "other", base, base[0] < 50 or 100 * base[4] > 50 * base[0], brute_histograms(text)))
    kept = {k for k, (_, _, base, failed, _) in enumerate(docs) if not failed and base[1] >= 200}
    first, verdict = set(kept), {}
    for turn in range(rounds):
        refs, n = {}, Counter()
        for k in kept if turn else first:
            for lang in {docs[k][1], "other"}:
                for kind in (0, 1):
                    h = docs[k][4][kind]
                    refs[lang, kind] = [a + round(1e6 * b / (sum(h) or 1)) for a, b in zip(refs.get((lang, kind), [0] * len(h)), h)]
                n[lang] += 1
        for k, (_, lang, base, failed, both) in enumerate(docs):
            ok = not failed
            for kind, size, least, (a, b) in ((0, base[1], 200, (0.08, 2.0)), (1, base[0], 50, (0.3, 2.2))):
                if n[lang] >= 5 and size >= least:
                    ok &= brute_distance(both[kind], refs[lang, kind]) <= a + b / math.sqrt(size)
            verdict[k] = ok
        kept = {k for k in first if verdict[k]}
    return [(d[0], *d[2], d[3], verdict[k]) for k, d in enumerate(docs)]


def corpus():
    draw, rows = random.Random(5), []
    for k in range(120):
        lang = draw.choice(["en", "de", "fr", "es", None, "pt"])
        common = COMMON_WORDS.get(lang, COMMON_WORDS["en"])
        made = ["".join(draw.choices("abcdefghiéü", k=draw.randint(2, 9))) for _ in range(80)]
        words = [draw.choice(common) if draw.random() < 0.4 else draw.choice(made) for _ in range(draw.choice([20, 60, 200, 800]))]
        words = [w.capitalize() + draw.choice(["", ",", "."]) if draw.random() < 0.1 else w for w in words]
        if k % 10 == 0:
            words = [x for w in words for x in (w, "|")]
        if k % 11 == 0:
            words = words[:12] * 20
        rows.append((k, "".join(w + draw.choice(["  ", " ", " ", " ", "\n", "\t", "\r\n"]) for w in words), lang))
    line = "the same line again and again, é\n"
    rows += [(500, None, "en"), (501, "", None), (502, line * 30, "en"), (503, "\n \n" + line + line[:-1], "en"), (504, "\x85\xa0  x 漢字 😀 \x00", "en"), (504, "twice", "fr"), (504, "twice", "fr"), (None, "no id", "de")]
    rows += [(505, rows[1][1] * 300, rows[1][2]), (506, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}%%%###" for k in range(600)), "en")]
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as kept", "2 as n_words", "3 as classes", "4 as id")
    out = quality_rules(df)
    got = [tuple(r) for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()]
    want = brute(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(not w[-2] and not w[-1] for w in want) and any(w[-1] for w in want)


def test_empty(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_distance():
    assert distances(np.array([[1, 0], [1, 1], [0, 5]]), np.array([7, 0])).round(6).tolist() == [0, round(brute_distance([1, 1], [1, 0]), 6), 1]


def test_long_texts(spark):
    """Texts that are scanned part by part, with words, lines and windows that recur in other parts, and items longer than a part."""
    draw = random.Random(4)
    words = [f"w{k}" * 9 for k in range(3000)] + ["the", "The,", "é%", "漢字|"]
    line = " ".join(draw.choices(words, k=40)) + "\n"
    text = "".join(draw.choice([line, " ".join(draw.choices(words, k=draw.randint(0, 50))) + draw.choice(["\n", " \t", "\n \n"])]) for _ in range(1300))
    giant = "é#" * 350_000
    rows = [(1, text, "en"), (2, text + giant + " a b c\n" + giant + " a b c\n" + giant, "en"), (3, "x" * (1 << 20), "de"), (4, giant, None), (5, " " * (3 << 20) + "\n", "fr"), (6, (line[:-1] + " ") * 400 + "\n" + (line[:-1] + " ") * 400, "en"), (7, "a b\n" * 400_000, "en")]
    assert all(len(r[1].encode()) >= 1 << 20 for r in rows)
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_memory_of_a_long_text():
    """10 MB, with and without spaces, in a process of its own."""
    import subprocess
    import sys

    code = """
import resource, sys
from branchstone.llm.quality_rules import COMMON_WORDS, long_features, vocabulary
words = vocabulary(COMMON_WORDS)
text = b"some words " * 1_000_000 if sys.argv[1] == "words" else b"x" * 10_000_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
long_features(text, words)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    for kind in ("words", "none"):
        said = subprocess.run([sys.executable, "-c", code, kind], capture_output=True, text=True, check=True)
        assert int(said.stdout.split()[-1]) < 300
