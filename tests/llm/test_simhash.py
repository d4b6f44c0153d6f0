import random

import numpy as np
import pytest
import xxhash

from branchstone.llm.simhash import blocks_for, fingerprint, group_links, pair_links, pivot_fingerprints, pivot_table, simhash_components


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(prints):
        if key is not None:
            low[find(i)] = min(low.get(find(i), key), key)
    return sorted(((k, f"{p:016x}", low.get(find(i))) for i, (k, p) in enumerate(prints)), key=repr)


@pytest.mark.parametrize("options", [{}, {"hot": 2, "blocks": 4}])
def test_components_match_brute_force(spark, options):
    draw = random.Random(3)
    vocabulary = [f"w{i}É" for i in range(300)]
    rows = []
    for k in range(60):
        words = draw.choices(vocabulary, k=draw.choice([1, 2, 3, 40, 200]))
        for _ in range(draw.randint(1, 4)):
            copy = list(words)
            if len(copy) > 30 and draw.random() < 0.7:
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            rows.append((len(rows) * 7 % 1000, draw.choice([" ", "\n", "\t "]).join(copy)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "x"), (5003, "x"), (None, "x"), (5005, "\x85\xa0"), (5006, "A a " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fingerprint", "2 as component_id", "3 as fp", "4 as key")
    got = sorted((tuple(r) for r in simhash_components(df, **options).collect()), key=repr)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(rows) - 30


def test_empty(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_large_groups_link_all(seed):
    draw = random.Random(seed)
    centres = [draw.getrandbits(64) for _ in range(4)]
    prints = list({c ^ sum(1 << b for b in draw.sample(range(12), draw.randint(0, 4))) for c in centres for _ in range(40)})
    pivots = pivot_fingerprints(16)
    prints.sort(key=lambda p: (p ^ int(pivots[0])).bit_count())
    array = np.array(prints, np.uint64)
    links = group_links(array, pivot_table(array, pivots), 3)
    parent = list(range(len(prints)))

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    want = list(parent)
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                want[find(want, i)] = find(want, j)
    for a, b in links:
        parent[find(parent, a)] = find(parent, b)
    group = lambda p: {frozenset(j for j in range(len(prints)) if find(p, j) == find(p, i)) for i in range(len(prints))}
    assert group(parent) == group(want)
    assert len(links) < len(prints)


def test_whole_text_counts():
    assert fingerprint(b"a b c " * 70000 + b"d e f " * 90000) == brute_print("a b c " * 70000 + "d e f " * 90000)


def test_pairs_are_discarded_by_the_pivots():
    """All linked pairs and no others; pairs apart in the first coordinate are not formed, most of the others end at the table."""
    draw = random.Random(2)
    centres = [draw.getrandbits(64) for _ in range(300)]
    prints = np.array([c ^ sum(1 << b for b in draw.sample(range(64), k)) for c in centres for k in (0, 2, 3, 6)], np.uint64)
    pivots = pivot_fingerprints(16)
    table = pivot_table(prints, pivots)
    key = np.array([draw.randrange(20) for _ in prints])
    order = np.lexsort((table[:, 0], key))
    key, prints, table = key[order], prints[order], table[order]
    counts = {}
    i, j = pair_links(key, prints, table, 3, counts)
    every = [(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if key[a] == key[b]]
    assert {(a, b) for a, b in every if (int(prints[a]) ^ int(prints[b])).bit_count() <= 3} == set(zip(i.tolist(), j.tolist()))
    assert counts["verified"] == len(i) <= counts["survived"] < 0.1 * counts["formed"] < counts["formed"] < 0.7 * len(every)


def test_blocks_grow_with_the_fingerprints():
    assert [blocks_for(n, 3) for n in (0, 10**9, 10**10, 10**12)] == [5, 5, 6, 7]
