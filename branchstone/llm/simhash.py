"""SimHash near-dedup: block keys bring fingerprints together, pivot distance tables decide which pairs are formed, survivors are verified.

Distances to `pivots` reference fingerprints are computed once for each distinct fingerprint and go along as a column of
bytes. Two fingerprints within the distance differ by no more than it in each coordinate. Where fingerprints meet they
are in order of the first coordinate, so that pairs further apart in it are never formed; the others are discarded by
the largest difference of the remaining coordinates, and what survives is verified bit by bit."""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, written
from .graph import components

BITS = 64
DENSE = 64  # groups of more fingerprints are searched from node to node instead of pair by pair
HOT = 4096  # groups of more fingerprints are taken apart by further blocks


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z lower-cased; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    hashed, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        hashes = [hashed(joined, seed)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        hashes = [hashed(joined[a:b], seed) for a, b in zip((ends - lengths)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], np.uint64).view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def pivot_fingerprints(count: int, seed: int = 7) -> np.ndarray:
    """The reference fingerprints: `count` random ones."""
    draw = random.Random(seed)
    return np.array([draw.getrandbits(BITS) for _ in range(count)], np.uint64)


def pivot_table(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to every pivot, one row a fingerprint."""
    return np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)


def survivors(table: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) whose coordinates differ by `distance` at most: a few coordinates at a time."""
    for k in range(0, table.shape[1], 4):
        keep = (np.abs(table[i, k : k + 4] - table[j, k : k + 4]) <= distance).all(axis=1)
        i, j = i[keep], j[keep]
    return i, j


def verified(prints: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.bitwise_count(prints[i] ^ prints[j]) <= distance
    return i[keep], j[keep]


def group_links(prints: np.ndarray, table: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(root, member) links that join what is linked among the fingerprints of one large group, in order of the first
    coordinate: a node is compared with those within the distance in it.

    Whatever is reached leaves the unvisited set, so a dense group takes few passes and emits one row a member."""
    links, left, first = [], np.arange(len(prints)), table[:, 0]
    while len(left):
        root, left = int(left[0]), left[1:]
        queue = [root]
        while queue and len(left):
            x = queue.pop()
            low, high = np.searchsorted(first[left], [first[x] - distance, first[x] + distance + 1])
            near = left[low:high]
            i, j = survivors(table, np.full(len(near), x), near, distance)
            _, hit = verified(prints, i, j, distance)
            if len(hit):
                links += [(root, y) for y in hit.tolist()]
                queue += hit.tolist()
                left = left[~np.isin(left, hit, assume_unique=True)]
    return links


def pair_links(key: np.ndarray, prints: np.ndarray, table: np.ndarray, distance: int, counts: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of many small groups, whose rows are in order of key and first coordinate. Each row is paired
    with those after it as long as they are in its group and within the distance in that coordinate.

    counts: takes how many pairs were formed, survived the table and were verified."""
    first, active, step = table[:, 0], np.arange(len(key) - 1), 1
    out = []
    while len(active):
        j = active + step
        active, j = active[j < len(key)], j[j < len(key)]
        near = (key[active] == key[j]) & (first[j] - first[active] <= distance)
        active, j = active[near], j[near]
        i, k = survivors(table, active, j, distance)
        out.append(verified(prints, i, k, distance))
        if counts is not None:
            for name, n in (("formed", len(j)), ("survived", len(i)), ("verified", len(out[-1][0]))):
                counts[name] = counts.get(name, 0) + n
        step += 1
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (zip(*out, strict=True) if out else ([], [])))


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return run


def _tabled(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pivot_table(batch.column(0).to_numpy().view(np.uint64), pivots)
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(pivots)), len(table), [None, pa.py_buffer(np.ascontiguousarray(table).tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, rows.cast(pa.binary())], names=[*batch.schema.names, "pivots"])

    return run


LINKS = "key long, a long, b long, pivots binary"  # a link, or with a key what is left for a finer one
LINK_SCHEMA = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("pivots", pa.binary())])


def _links(distance: int, width: int, most: int | None):
    """Links of groups (key, fp, pivots), which come in order of key and first coordinate. A group of more than `most`
    fingerprints is passed on as it is; no more than those are held of it."""

    def of(key: np.ndarray, prints: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        small = np.repeat(size, size) <= DENSE
        i, j = pair_links(key[small], prints[small], table[small], distance)
        out = [(prints[small][i], prints[small][j])]
        for at, n in zip(start[size > DENSE].tolist(), size[size > DENSE].tolist(), strict=True):
            p = prints[at : at + n]
            if links := np.array(group_links(p, table[at : at + n], distance), np.int64).reshape(-1, 2).T.tolist():
                out.append((p[links[0]], p[links[1]]))
        a, b = (pa.array(np.concatenate(x).view(np.int64)) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), a, b, pa.nulls(len(a), pa.binary())], schema=LINK_SCHEMA)

    def left(key: np.ndarray, prints: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
        rows = [r.tobytes() for r in table]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints.view(np.int64)), pa.nulls(len(key), pa.int64()), pa.array(rows, pa.binary())], schema=LINK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # rows of a group that may go on
        passing = None  # the key of a group that is passed on
        for batch in batches:
            key, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            values = batch.column(2)  # all of `width` bytes, one after the other
            begin = int(np.frombuffer(values.buffers()[1], np.int32)[values.offset])
            raw = np.frombuffer(values.buffers()[2], np.int8, len(key) * width, begin)
            rows = key, prints, raw.reshape(-1, width)
            if passing is not None:
                cut = int(np.searchsorted(key, passing, "right"))
                if cut:
                    yield left(*(x[:cut] for x in rows))
                    rows = tuple(x[cut:] for x in rows)
                if not len(rows[0]):
                    continue
                passing = None
            if held and held[0][0][0] != rows[0][0]:
                yield of(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group may go on
            if cut:
                held.append(tuple(x[:cut] for x in rows))
                whole = tuple(map(np.concatenate, zip(*held, strict=True)))
                start = np.flatnonzero(np.r_[True, whole[0][1:] != whole[0][:-1]])
                size = np.diff(np.r_[start, len(whole[0])])
                large = np.repeat(size, size) > (most or len(whole[0]))
                if large.any():
                    yield left(*(x[large] for x in whole))
                yield of(*(x[~large] for x in whole))
                held = []
            held.append(tuple(x[cut:] for x in rows))
            if most is not None and sum(len(x[0]) for x in held) > most:
                passing = held[0][0][0]
                yield left(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if held:
            yield of(*map(np.concatenate, zip(*held, strict=True)))

    return run


KEY_BITS = 56  # below the number of the blocks that a key is made of


def block_keys(fp: str, blocks: int, distance: int) -> list:
    """Keys of which two fingerprints within the distance share one at least: of `blocks` blocks, `distance` differ at
    most. A key has the number of its choice of blocks above KEY_BITS and a hash of theirs below."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(1 << b for k in chosen for b in range(edges[k], edges[k + 1]))
        part = F.xxhash64(F.col(fp).bitwiseAND(F.lit(mask - (mask >> 63 << 64))))
        keys.append(part.bitwiseAND(F.lit((1 << KEY_BITS) - 1)).bitwiseOR(F.lit(t << KEY_BITS)))
    return keys


def finer_keys(key: str, fp: str, blocks: int, distance: int, parts: int) -> list:
    """Keys for the fingerprints of one block key, of which two within the distance share one at least: they differ only
    outside the key's blocks, and of `parts` parts of what is outside one is equal."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    found = []
    for chosen in combinations(range(blocks), blocks - distance):
        free = [b for k in range(blocks) if k not in chosen for b in range(edges[k], edges[k + 1])]
        cuts = [len(free) * k // parts for k in range(parts + 1)]
        masks = [sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
        found.append(F.array(*[F.xxhash64(F.col(key), F.lit(k), F.col(fp).bitwiseAND(F.lit(m - (m >> 63 << 64)))) for k, m in enumerate(masks)]))
    which = F.shiftrightunsigned(F.col(key), KEY_BITS)
    return F.element_at(F.array(*found), (which + 1).cast("int"))


def blocks_for(count: int, distance: int) -> int:
    """So many blocks that a key has about 64 fingerprints at most where they are spread evenly."""
    blocks = distance + 2
    while count >> (BITS * (blocks - distance) // blocks) > 64 and blocks < 2 * distance + 4:
        blocks += 1
    return blocks


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, distance: int = 3, blocks: int | None = None, pivots: int = 16, hot: int = HOT) -> DataFrame:
    """(id, fingerprint, component_id) for every row of df; component_id is the smallest id that is reachable.

    Fingerprints link at `distance` or fewer differing bits; equal ones are one node, so copies cost nothing more.
    Null and empty texts have fingerprint 0, which links like any other. A null id is no component's smallest unless it
    has no other. Repeated rows each get their row; other columns are ignored; an empty table gives an empty result.
    blocks - distance of the blocks make a key: more blocks make more and longer keys, for more fingerprints (default:
    blocks_for). Groups of more than `hot` fingerprints are never held: they are taken apart by further blocks. None of
    these changes a result."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = written(rows.mapInArrow(_fingerprints(shingle, seed), f"id {dict(rows.dtypes)['id']}, fp long"), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    kind = dict(prints.dtypes)["first_id"]
    prints = written(prints.mapInArrow(_tabled(pivot_fingerprints(pivots)), f"fp long, first_id {kind}, n long, pivots binary"), "distinct-fingerprints")
    blocks = blocks or blocks_for(prints.count(), distance)
    first = F.substring("pivots", 1, 1)
    keyed = prints.select(F.explode(F.array(*block_keys("fp", blocks, distance))).alias("key"), "fp", "pivots")
    keyed = keyed.repartition("key").sortWithinPartitions("key", first)
    links = written(keyed.mapInArrow(_links(distance, pivots, hot), LINKS), "links")
    edges = links.where("key is null").select("a", "b")
    large = links.where("key is not null")
    if not large.isEmpty():
        finer = large.select(F.explode(finer_keys("key", "a", blocks, distance, distance + 1)).alias("key"), F.col("a").alias("fp"), "pivots")
        finer = finer.repartition("key").sortWithinPartitions("key", first)
        edges = edges.unionByName(finer.mapInArrow(_links(distance, pivots, None), LINKS).select("a", "b"))
    found = components(edges)
    linked = found.join(prints, found.node == prints.fp).select("root", "fp", "first_id")
    low = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(low, "root").select("fp", "component_id")
    groups = prints.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), "n")
    out = join_groups(rows, written(groups, "components"), "fp", "n", rows.count())
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
