import random
import textwrap

import pytest

from branchstone.llm.license_scan import AS_IS, TEMPLATES, bigrams_of, license_scan, license_sql, words_of


def brute(rows, threshold):
    out = {}
    for i, text in rows:
        if text is None:
            continue
        for line, unit in enumerate([text, *text.split("\n")]):
            own = bigrams_of(unit)
            for name, texts in TEMPLATES.items():
                for t in texts:
                    other = bigrams_of(t)
                    both = len(own & other)
                    if own and 2 * both >= threshold * (len(own) + len(other)) - 1e-9:
                        lines, best = out.setdefault((i, name), (set(), [(0, 0, 0)]))
                        lines.update([line] if line else [])
                        best[0] = max(best[0], (2 * both / (len(own) + len(other)), both, len(own) + len(other)))
    return sorted(((i, n, len(lines), best[0][1], best[0][2]) for (i, n), (lines, best) in out.items()), key=repr)


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_matches_brute_force(spark, threshold):
    draw, rows = random.Random(1), []
    parts = [t for x in TEMPLATES.values() for t in x]
    for k in range(200):
        lines = []
        for _ in range(draw.randint(1, 6)):
            words = draw.choice(parts).split() if draw.random() < 0.5 else draw.choices(["the", "Été", "licensed", "under", "mit", "ß"], k=20)
            for _ in range(draw.randint(0, 5)):
                words[draw.randrange(len(words))] = draw.choice(["the", "CC", "!!", "—x—"])
            lines.append(draw.choice([" ", "  ", "\t"]).join(words))
        rows.append((k, "\n".join(lines)))
    rows += [(k, parts[k - 300].upper()) for k in range(300, 300 + len(parts))]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "one"), (504, "Released under\nthe MIT License."), (505, parts[0]), (505, parts[0]), (None, parts[0]), (506, "filler " * 50000 + "\n" + parts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as line", "2 as unit", "3 as bigram", "'x' as license")
    got = sorted((tuple(r) for r in license_scan(df, threshold=threshold, windows=False).collect()), key=repr)
    want = brute(list(dict.fromkeys(rows)), threshold)
    assert got == want
    assert len(want) > 60


def best_window(text, template, threshold):
    words, other = words_of(text), bigrams_of(template)
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    most, found = int(len(other) * (2 - threshold) / threshold + 1e-9), [(0, 0, 0)]
    for a in range(len(grams)):
        own, both = set(), 0
        for g in grams[a : a + most]:
            both += g in other and g not in own
            own.add(g)
            found.append((2 * both / (len(own) + len(other)), both, len(own) + len(other)))
    return max(found)


def test_windows(spark):
    draw = random.Random(3)
    wrap = lambda t, n=78: textwrap.fill(t, n)
    mit, gpl, bsd = TEMPLATES["MIT"][1], TEMPLATES["GPL-3.0"][1], TEMPLATES["BSD"][0]
    rows = [
        (0, "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + wrap(mit) + "\n\n" + wrap("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.") + "\n\n" + wrap(AS_IS)),
        (1, "Copyright 2020 Jane Doe. Released under the MIT License. All rights reserved."),
        (2, "# a header\n" + "\n".join("# " + x for x in wrap(gpl).split("\n")) + "\n" + "".join(f"x{k} = {k}\n" for k in range(300))),
        (3, wrap("Redistribution of nothing. " + bsd + " And more words after it, many of them.", 40)),
        (4, "the mit license is a licence, as the software is free of charge and any person is permitted " * 20),
    ]
    for k in range(5, 25):
        words = ("filler words and more " * 4 + draw.choice([mit, gpl, bsd, *TEMPLATES["CC-BY-4.0"]]) + " of the software under the terms " * 3).split()
        for _ in range(draw.randint(0, 8)):
            words[draw.randrange(len(words))] = draw.choice(["the", "of", "x"])
        rows.append((k, wrap(" ".join(words), 50)))
    wrapped = "\n".join("// " + x for x in textwrap.wrap(TEMPLATES["Apache-2.0"][2], 60))
    rows += [(40, "".join(f"int x{k};\n" for k in range(200)) + wrapped + "\n" + "".join(f"int y{k};\n" for k in range(200))), (41, wrap(f"{TEMPLATES['BSD'][2]} and more of it"))]
    rows += [(42 + k, f"Copyright 2001 Nobody\n\n{wrap(TEMPLATES[n][-1], 66)}\n") for k, n in enumerate(["ISC", "0BSD", "Zlib", "Unlicense"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.overlap, r.sizes) for r in license_scan(df).collect()}
    want = {}
    for i, text in rows:
        for name, texts in TEMPLATES.items():
            best = max(best_window(text, t, 0.8) for t in texts)
            if best[0] >= 0.8 - 1e-9:
                want[i, name] = best[1:]
    assert got == want
    assert not {r.doc_id for r in license_scan(df, windows=False).collect()} & {1, 2, 3}  # neither lines nor whole texts have them
    assert {(40, "Apache-2.0"), (41, "BSD"), (42, "ISC"), (43, "0BSD"), (44, "Zlib"), (45, "Unlicense")} <= set(got)
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(*r,) for r in [*rows, (90, None), (91, "")]])
    said = {(r[0], r[1]): (r[3], r[4]) for r in con.execute(f"select doc_id, license, n_lines, overlap, sizes from ({license_sql()})").fetchall()}
    assert {k: v for k, v in said.items()} == {(r.doc_id, r.license): (r.overlap, r.sizes) for r in license_scan(df).collect()}
    assert {(0, "MIT"), (1, "MIT"), (2, "GPL-3.0"), (3, "BSD")} <= set(got) and not any(i == 4 for i, _ in got)


def test_empty(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
