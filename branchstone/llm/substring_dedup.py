"""Substring dedup: recurring passages are confirmed, compiled into sharded Aho-Corasick automata and located in every document.

A document with the words of another one of a smaller id loses all, whatever else recurs; the rest is about documents
that differ. A passage recurs if a window of `window` words occurs in two of them. Each window has an anchor, the phrase of `phrase`
of its words with the least hash: equal windows have equal anchors, and neighbours mostly share theirs. So
1. anchors of two differing documents are counted, and a Bloom filter of them, of bounded size, is broadcast;
2. windows with such an anchor are counted by their hash: those of two documents or more are confirmed, with the smallest
   id that has them, their owner; the owners' runs of confirmed windows are the passages, cut into overlapping segments;
3. documents with such windows, long ones in overlapping parts, go to shards of about shard_bytes, each with one segment for
   every confirmed window that its documents have. A shard's automaton finds every occurrence of the segments' anchors in
   its documents; each is extended word by word to the whole common passage, so what is removed has been compared in full."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, written
from .exact_dedup import BUCKET_BITS, broadcast_bits, filter_bits
from .textscan import BASE, PART, SPACES, Scan, digest_hash, mixed, parts, pieces, powers

STEP = 1 << 17  # words of a long text whose windows are made at a time


def spans(words: np.ndarray, count: int) -> np.ndarray:
    """Hashes of every `count` consecutive word hashes."""
    if len(words) < count:
        return np.empty(0, np.uint64)
    up, down = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mixed((sums[count:] - sums[:-count]) * down[: len(words) - count + 1] + np.uint64(count))


def least(values: np.ndarray, count: int) -> np.ndarray:
    """The least of every `count` consecutive values, by doubling."""
    have, width = values, 1
    while 2 * width <= count:
        have, width = np.minimum(have[:-width], have[width:]), 2 * width
    return have if width == count else np.minimum(have[: len(values) - count + 1], have[count - width :])


class Windows:
    """All windows of all texts of a scan: the text each is in, its anchor's hash and its own."""

    def __init__(self, scan: Scan, window: int, phrase: int):
        self.scan, h = scan, scan.hashes(scan.word_start, scan.word_end)
        if len(h) < window:
            self.start = np.empty(0, np.int64)
            self.anchor = self.hash = np.empty(0, np.uint64)
        else:
            self.start = np.flatnonzero(scan.word_doc[window - 1 :] == scan.word_doc[: len(h) - window + 1])
            self.anchor = least(spans(h, phrase), window - phrase + 1)[self.start]
            self.hash = spans(h, window)[self.start]
        self.doc = scan.word_doc[self.start]

    def sequences(self) -> np.ndarray:
        """A hash of all words of each text."""
        h = self.scan.hashes(self.scan.word_start, self.scan.word_end)
        up, down = powers(len(h) + 1)
        sums, ends = np.r_[np.uint64(0), np.cumsum(h * up[:-1])], np.r_[0, np.cumsum(self.scan.n_words)]
        return mixed((sums[ends[1:]] - sums[ends[:-1]]) * down[ends[:-1]] + self.scan.n_words.astype(np.uint64))


class LongText:
    """The words of one text of PART bytes or more: where each begins and ends, and its hash. Windows come in steps."""

    def __init__(self, text: bytes):
        starts, ends, hashes = [], [], []
        view = memoryview(text)
        for a, b, whole in parts(text, SPACES):
            if whole:
                found = np.array([a]), np.array([b]), np.array([digest_hash(view[a:b])], np.uint64)
            else:
                scan = Scan([text[a:b]])
                found = scan.word_start + a, scan.word_end + a, scan.hashes(scan.word_start, scan.word_end)
            for x, y in zip((starts, ends, hashes), found, strict=True):
                x.append(y)
        self.text, self.start, self.end, self.hash = text, *map(np.concatenate, (starts, ends, hashes))

    def windows(self, window: int, phrase: int, step: int = STEP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first word, anchors, hashes) of the windows that begin at it and after."""
        for at in range(0, max(len(self.hash) - window + 1, 0), step):
            h = self.hash[at : at + step + window - 1]
            yield at, least(spans(h, phrase), window - phrase + 1), spans(h, window)

    def sequence(self) -> np.uint64:
        """As Windows.sequences has it."""
        total = 0
        for at in range(0, len(self.hash), STEP):
            h = self.hash[at : at + STEP]
            total += int((h * powers(len(h))[0]).sum(dtype=np.uint64)) * pow(BASE, at, 1 << 64)
        return mixed(np.array([(total + len(self.hash)) & ((1 << 64) - 1)], np.uint64))[0]

    def words(self, first: int, last: int) -> bytes:
        """The words from first up to last, joined by one space."""
        return b" ".join(self.text[self.start[first] : self.end[last - 1]].split()) if last > first else b""

    def cuts(self, most: int) -> list[int]:
        """Words at which parts of about `most` bytes begin."""
        at = np.searchsorted(self.start, np.arange(0, int(self.end[-1]), most)) if len(self.start) else np.zeros(1, np.int64)
        return np.unique(np.minimum(at, max(len(self.start) - 1, 0))).tolist()

    def digest(self) -> str:
        state = hashlib.sha256()
        for at in range(0, len(self.start), STEP):
            state.update(b" " * (at > 0) + self.words(at, min(at + STEP, len(self.start))))
        return state.hexdigest()


def cells_of(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def bloom(hashes: DataFrame, column: str, bits: int) -> bytes:
    """The Bloom filter of a column, 2**bits bits: its size bounds what comes to the driver."""
    mask = F.lit((1 << bits) - 1).cast("long")
    cells = hashes.select(F.explode(F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(column, 32).bitwiseAND(mask))).alias("cell"))
    cells = cells.select(F.shiftright("cell", BUCKET_BITS).alias("bucket"), F.col("cell").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).alias("at"))
    out = bytearray(1 << (bits - 3))
    for r in cells.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")).toLocalIterator():
        out[r["bucket"] << (BUCKET_BITS - 3) : (r["bucket"] + 1) << (BUCKET_BITS - 3)] = r["bits"]
    return bytes(out)


def in_bloom(table: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for cell in cells_of(hashes, bits):
        found &= (table[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return found


def _anchors(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in pieces(batch, 0):
                if len(texts[0]) >= PART:  # alone in its run
                    long = LongText(texts[0])
                    words = long.sequence()
                    for _, anchor, _ in long.windows(window, phrase):
                        anchor = anchor[np.r_[True, anchor[1:] != anchor[:-1]]]
                        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (anchor, np.full(len(anchor), words))], names=["anchor", "words"])
                    continue
                w = Windows(Scan(texts), window, phrase)
                new = np.r_[True, (w.anchor[1:] != w.anchor[:-1]) | (w.doc[1:] != w.doc[:-1])][: len(w.doc)]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (w.anchor[new], w.sequences()[w.doc[new]])], names=["anchor", "words"])

    return run


def kept_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


CANDIDATE = "id long, row long, part int, n_parts int, fresh int, n_words long, digest string, words binary, hashes array<long>"
CANDIDATE_NAMES = [c.split()[0] for c in CANDIDATE.split(", ")]


def _long_rows(own, row: int, text: bytes, window: int, phrase: int, table: np.ndarray, bits: int, most: int) -> list[tuple]:
    """A long text's parts, which overlap by window - 1 words, if any window of it may recur."""
    long = LongText(text)
    cuts, n, digest = long.cuts(most), len(long.start), long.digest()
    hits: list[list[np.ndarray]] = [[] for _ in cuts]
    for first, anchor, hashes in long.windows(window, phrase) if own is not None else ():
        at = np.flatnonzero(in_bloom(table, bits, anchor))
        of = np.searchsorted(cuts, at + first, "right") - 1
        for k in np.unique(of).tolist():
            hits[k].append(hashes[at[of == k]])
    if not any(hits):
        return [(own, row, 0, 1, n, n, digest, None, None)]
    ends = [*cuts[1:], n]
    return [
        (own, row, k, len(cuts), b - a, n, digest, long.words(a, min(n, b + window - 1) if k + 1 < len(cuts) else n), np.unique(np.concatenate(hits[k] or [np.empty(0, np.uint64)])).view(np.int64))
        for k, (a, b) in enumerate(zip(cuts, ends, strict=True))
    ]


def _candidates(window: int, phrase: int, filter_, bits: int, most: int):
    """One row a document: the digest of all its words and, if it has windows that may recur, its words and their hashes;
    for long ones a row for each part. Documents without an id lose and give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(filter_.value, np.uint8)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())]
        for batch in batches:
            for a, b, texts in pieces(batch, 2):
                if len(texts[0]) >= PART:  # alone in its run
                    for r in _long_rows(batch.column(0)[a].as_py(), batch.column(1)[a].as_py(), texts[0], window, phrase, table, bits, most):
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(r, kinds, strict=True)], names=CANDIDATE_NAMES)
                    continue
                w = Windows(Scan(texts), window, phrase)
                hit = in_bloom(table, bits, w.anchor)
                doc, hashes = w.doc[hit], w.hash[hit].view(np.int64)
                ends = np.searchsorted(doc, np.arange(len(texts) + 1))
                lists = [x.split() for x in texts]
                ids, n = batch.column(0).slice(a, b - a), w.scan.n_words
                named = ids.is_valid().to_numpy(zero_copy_only=False)
                found = [np.unique(hashes[x:y]) if y > x and ok else None for x, y, ok in zip(ends, ends[1:], named, strict=False)]
                one = np.ones(len(texts), np.int32)
                columns = [
                    ids, batch.column(1).slice(a, b - a), pa.array(one - 1), pa.array(one), pa.array(n.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(map(kept_digest, lists), pa.string()),
                    pa.array((None if f is None else b" ".join(x) for f, x in zip(found, lists, strict=True)), pa.binary()), pa.array(found, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=CANDIDATE_NAMES)

    return run


def window_hashes(text: bytes, window: int, phrase: int) -> np.ndarray:
    """The hashes of a text's windows, in order."""
    if len(text) >= PART:
        return np.concatenate([np.empty(0, np.uint64), *[h for _, _, h in LongText(text).windows(window, phrase)]])
    return Windows(Scan([text]), window, phrase).hash


def _segments(window: int, phrase: int, most: int):
    """An owner's passages: runs of windows that are confirmed as its own, cut into segments of `most` words at most
    which overlap by window - 1 words, so that every window lies in one; with the hashes of each segment's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in pieces(batch, 1):
                for k, text in enumerate(texts):
                    own = window_hashes(text, window, phrase).view(np.int64)
                    mine = np.isin(own, batch.column(2)[a + k].values.to_numpy())
                    edge = np.flatnonzero(np.diff(mine, prepend=False, append=False))
                    words, rows, hashes = text.split(), [], []
                    for first, last in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        for at in range(first, last, most - window + 1):
                            end = min(last, at + most - window + 1)
                            rows.append(b" ".join(words[at : end + window - 1]))
                            hashes.append(own[at:end])
                    ids = pa.array([batch.column(0)[a + k].as_py()] * len(rows), batch.schema.types[0])
                    yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], names=["owner", "segment", "hashes"])

    return run


def brief(words: list[bytes], most: int = 256) -> list[bytes]:
    """The words with very long ones as their digests: an automaton is as deep as its longest pattern. What it finds is
    compared word by word, so that an equal digest or a word that reads like one is no match."""
    return [w if len(w) <= most else hashlib.blake2b(w, digest_size=16).hexdigest().encode() for w in words]


class Automaton:
    """The anchors of a shard's segments, and where each stands in which segment."""

    def __init__(self, segments: list[tuple[int, bytes]], window: int, phrase: int):
        self.window, self.numbers = window, {}
        self.owner = [o for o, _ in segments]
        self.words = [self.encode(s.split()) for _, s in segments]
        places: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, segment) in enumerate(segments):
            scan = Scan([segment])
            phrases = spans(scan.hashes(scan.word_start, scan.word_end), phrase)
            words = brief(segment.split())
            views = np.lib.stride_tricks.sliding_window_view(phrases, window - phrase + 1)
            for at in np.unique(views.argmin(axis=1) + np.arange(len(views))).tolist():
                places.setdefault(b" ".join(words[at : at + phrase]), []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for key, where in places.items():
            pattern = f" {key.decode('utf-8', 'surrogateescape')} "
            self.automaton.add_word(pattern, (len(pattern), where))
        if places:
            self.automaton.make_automaton()

    def encode(self, words: list[bytes]) -> np.ndarray:
        numbers = self.numbers
        return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))

    def covered(self, own, text: bytes) -> np.ndarray:
        """Which words of a document lie in a window that a document with a smaller id has."""
        words = text.split()
        numbers, gone = self.encode(words), np.zeros(len(words), bool)
        if own is None or not len(self.automaton):
            return gone
        short = brief(words)
        line = f" {b' '.join(short).decode('utf-8', 'surrogateescape')} "
        starts, at = {}, 0  # place in the line of the space before a word -> its number
        for k, w in enumerate(short):
            starts[at] = k
            at += len(w.decode("utf-8", "surrogateescape")) + 1
        done: dict[tuple[int, int], int] = {}  # (segment, shift) -> word up to which it has been compared
        for end, (length, where) in self.automaton.iter(line):
            first = starts[end - length + 1]
            for segment, at in where:
                if self.owner[segment] >= own:
                    continue
                shift = first - at
                if done.get((segment, shift), -1) >= first:
                    continue
                other = self.words[segment]
                low, high = max(0, -shift), min(len(other), len(numbers) - shift)
                differ = np.flatnonzero(other[low:high] != numbers[low + shift : high + shift]) + low
                cut = np.searchsorted(differ, at)
                begin = differ[cut - 1] + 1 if cut else low
                stop = differ[cut] if cut < len(differ) else high
                done[segment, shift] = stop + shift - 1
                if stop - begin >= self.window:
                    gone[begin + shift : stop + shift] = True
        return gone


OUT = "id long, n_words long, n_removed long, kept_sha256 string, kept_text string, digest string"
LOCATED = f"{OUT}, row long, part int, n_parts int, fresh int, words binary, gone binary"
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
LOCATED_SCHEMA = pa.schema([(c.split()[0], ARROW[c.split()[1]]) for c in LOCATED.split(", ")])
OUT_SCHEMA = pa.schema(list(LOCATED_SCHEMA)[:6])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _located(window: int, phrase: int, texts: bool):
    def run(docs: pa.Table, segments: pa.Table) -> pa.Table:
        automaton = Automaton(list(zip(segments["owner"].to_pylist(), segments["segment"].to_pylist(), strict=True)), window, phrase)
        rows = []
        for own, row, part, n_parts, fresh, n, digest, text in zip(*(docs[c].to_pylist() for c in CANDIDATE_NAMES[:8]), strict=True):
            gone = automaton.covered(own, text)
            if n_parts > 1:  # put together when all parts are
                rows.append((own, n, None, None, None, digest, row, part, n_parts, fresh, text, np.packbits(gone).tobytes()))
                continue
            kept = b" ".join(w for w, g in zip(text.split(), gone.tolist(), strict=True) if not g)
            rows.append((own, n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if texts else None, digest, row, part, 1, fresh, None, None))
        return _table(rows, LOCATED_SCHEMA)

    return run


def _joined(texts: bool):
    """Long documents from their parts, which come in order: a word is gone if it is in either part that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = np.empty(0, bool)
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] == 0:
                    state, removed, any_, kept, carried = hashlib.sha256(), 0, False, [], np.empty(0, bool)
                words = r["words"].split()
                gone = np.unpackbits(np.frombuffer(r["gone"], np.uint8), count=len(words)).astype(bool)
                gone[: len(carried)] |= carried
                last = r["part"] == r["n_parts"] - 1
                fresh = len(words) if last else r["fresh"]
                line = b" ".join(w for w, g in zip(words[:fresh], gone[:fresh].tolist(), strict=True) if not g)
                removed += int(gone[:fresh].sum())
                carried = gone[fresh:]
                if not gone[:fresh].all():
                    state.update(b" " * any_ + line)
                    any_ = True
                    if texts:
                        kept.append(line)
                if last:
                    text = b" ".join(kept).decode("utf-8", "replace") if texts else None
                    yield _table([(r["id"], r["n_words"], removed, state.hexdigest(), text, r["digest"])], OUT_SCHEMA).to_batches()[0]

    return run


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, phrase: int = 16, shard_bytes: int = 1 << 20, segment_words: int = 256, most_filter_bits: int | None = None, texts: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept_text) for every row of df.

    Removed is each word covered by a window of `window` words that also starts in a row with a smaller id, in the input
    as it is. kept_text: the words that stay joined by one space, null where none is removed or could be, and in all
    rows without `texts`; kept_sha256 its digest in any case. ids are integers. Null and empty texts have no words. Rows with a null id lose nothing and take
    nothing from others; rows that share an id are never smaller than one another. Other columns are ignored; an empty
    table gives an empty result. Windows are told apart by 64-bit hashes before they are compared in full: a collision
    could hide a passage, never remove one. A text of any length is taken whole, long ones in parts of about shard_bytes;
    no window, document or id is gathered, however many rows have it: a shard gets one segment a window."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    anchors = docs.select("text").mapInArrow(_anchors(window, phrase), "anchor long, words long")
    recurring = written(anchors.groupBy("anchor").agg(F.min("words").alias("low"), F.max("words").alias("high")).where("low < high").select("anchor"), "recurring-anchors")
    bits = filter_bits(recurring.count(), most=most_filter_bits or broadcast_bits(spark))
    filter_ = spark.sparkContext.broadcast(bloom(recurring, "anchor", bits))
    numbered = docs.select("id", F.monotonically_increasing_id().alias("row"), "text")
    rows = written(numbered.mapInArrow(_candidates(window, phrase, filter_, bits, shard_bytes), CANDIDATE), "candidates")
    some = rows.where("words is not null")
    total, count = some.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)), F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()
    some = some.withColumn("shard", F.pmod(F.xxhash64("row", "part"), F.lit(max(1, total // shard_bytes))).cast("int"))

    windows = some.select(F.explode("hashes").alias("hash"), "id", "row", "part", "n_parts", "shard")
    owned = windows.groupBy("hash").agg(F.min(F.struct("id", "n_parts")).alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low.id < high")
    owned = written(owned.select("hash", F.col("low.id").alias("owner"), F.col("low.n_parts").alias("n_parts"), "n"), "confirmed")
    # an owner's own windows: at most a document's, or for long ones a part's
    lists = owned.where("n_parts = 1").groupBy("owner").agg(F.collect_list("hash").alias("hashes"))
    owners = some.where("n_parts = 1").select(F.col("id").alias("owner"), "words").join(lists, "owner").select("owner", "words", "hashes")
    long = windows.where("n_parts > 1").join(owned.where("n_parts > 1").select("hash", F.col("owner").alias("id")), ["hash", "id"]).groupBy("row", "part").agg(F.collect_list("hash").alias("mine"))
    long = some.where("n_parts > 1").select("row", "part", F.col("id").alias("owner"), "words").join(long, ["row", "part"]).select("owner", "words", F.col("mine").alias("hashes"))
    segments = owners.unionByName(long).mapInArrow(_segments(window, phrase, segment_words), "owner long, segment binary, hashes array<long>")
    segments = written(segments.withColumn("seg", F.monotonically_increasing_id()), "segments")

    # a shard gets one segment for each confirmed window that its documents have
    chosen = segments.select(F.explode("hashes").alias("hash"), "seg").groupBy("hash").agg(F.min("seg").alias("seg"))
    chosen = written(chosen.join(owned.select("hash", "n"), "hash"), "chosen")
    named = join_groups(windows.select("hash", "shard").distinct(), chosen, "hash", "n", count)
    named = named.select("seg", F.col("shard").alias("to")).distinct()
    sized = chosen.groupBy("seg").agg(F.max("n").alias("wide")).join(segments.select("seg", "owner", "segment"), "seg")
    dealt = join_groups(named, sized, "seg", "wide", count).select("to", "owner", "segment")
    found = some.select("shard", *CANDIDATE_NAMES[:8]).groupBy("shard").cogroup(dealt.groupBy("to")).applyInArrow(_located(window, phrase, texts), LOCATED)
    found = written(found, "parts-located")
    out = [c.split()[0] for c in OUT.split(", ")]
    stitched = found.where("n_parts > 1").repartition("row").sortWithinPartitions("row", "part").mapInArrow(_joined(texts), OUT)
    rest = rows.where("words is null").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"), "digest")
    found = written(found.where("n_parts = 1").select(*out).unionByName(stitched).unionByName(rest), "located")

    copies = found.groupBy("digest").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1")
    out = join_groups(found, copies, "digest", "n", docs.count(), "left")
    gone = (F.col("low") < F.col("id")) & (F.col("n_words") >= window)
    final = {"n_removed": F.col("n_words"), "kept_sha256": F.lit(kept_digest([])), "kept_text": F.lit("" if texts else None).cast("string")}
    return out.select(F.col("id").alias(id_col), "n_words", *[F.when(gone, v).otherwise(F.col(k)).alias(k) for k, v in final.items()])
