"""Quality rules: base counts, and Jensen-Shannon distances of character classes and common words to language references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .textscan import PART, SPACES, Scan, digest_hash, mixed, parts, pieces

# Frequent words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his are at this which or from had but have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so dass".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le".split(),
}
# Character classes by ASCII character; what is beyond ASCII goes by the first byte of its UTF-8 form.
ASCII_CLASSES = {
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "blank": " ",
    "line": "\t\n\v\f\r",
    "stop": ".,;:",
    "mark": "!?",
    "quote": "'\"()-",
    "symbol": "#*$%&|<>@^~`+=/\\_{}[]",
}
FIRST_BYTES = {"latin": range(0xC2, 0xC9), "letters": range(0xC9, 0xE0), "wide": range(0xE0, 0xF0), "plane": range(0xF0, 0xF8)}
CLASSES = [*ASCII_CLASSES, *FIRST_BYTES, "control"]
SYMBOLS = b"#*$%&|<>"
TRIMMED = b".,;:!?"
OTHER = "other"
PER = 1_000_000  # histograms are added up as whole millionths, so that the order of the rows does not matter


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.int64)  # continuation bytes count nowhere
    table[:128] = CLASSES.index("control")
    for k, name in enumerate(CLASSES):
        table[[ord(c) for c in ASCII_CLASSES.get(name, "")] + list(FIRST_BYTES.get(name, ()))] = k
    return table


def _flags(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def vocabulary(common: dict[str, list[str]]) -> list[str]:
    return sorted({w for words in common.values() for w in words})


def twice(windows: np.ndarray) -> np.ndarray:
    """The places of values that come twice or more."""
    order = np.argsort(windows)
    equal = windows[order][1:] == windows[order][:-1]
    return order[np.r_[equal, False] | np.r_[False, equal]] if len(order) else order


def lines_of(scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines that have a word."""
    ends = np.flatnonzero(scan.raw == 10)
    starts = np.r_[0, ends[:-1] + 1]
    filled = np.r_[0, np.cumsum(~scan.space)]
    some = filled[ends] > filled[starts]
    return starts[some], ends[some]


def base_counts(scan: Scan) -> dict[str, np.ndarray]:
    """The base counts of each text of a scan."""
    character = (scan.raw & 0xC0) != 0x80
    h, doc = scan.hashes(scan.word_start, scan.word_end), scan.word_doc
    repeat = np.zeros(len(h), bool)
    if len(h) > 2:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        found = at[twice(mixed(mixed(mixed(h[at] + doc[at].astype(np.uint64)) + h[at + 1]) + h[at + 2]))]
        for k in range(3):
            repeat[found + k] = True
    starts, ends = lines_of(scan)
    line_doc = np.searchsorted(scan.starts, starts, "right") - 1
    line = mixed(scan.hashes(starts, ends) + line_doc.astype(np.uint64))
    order = np.argsort(line, kind="stable")
    again = order[1:][line[order][1:] == line[order][:-1]]
    return {
        "n_words": scan.n_words,
        "word_chars": scan.by_doc(character & ~scan.space),
        "n_symbols": scan.by_doc(_flags(SYMBOLS)[scan.raw]),
        "n_dup_lines": np.bincount(line_doc[again], minlength=scan.count),
        "n_repeat_words": np.bincount(doc[repeat], minlength=scan.count),
    }


def repeated_words(h: np.ndarray, most: int = 1 << 21) -> int:
    """How many words of one text, given by their hashes, are in windows of three that come twice; windows are sorted by
    ranges of their hashes, about `most` at a time."""
    if len(h) < 3:
        return 0
    windows, repeat = np.empty(len(h) - 2, np.uint64), np.zeros(len(h), bool)
    for k in range(0, len(windows), most):
        a, b, c = (h[k + j : min(k + most, len(windows)) + j] for j in range(3))
        windows[k : k + most] = mixed(mixed(mixed(a) + b) + c)
    bits = max(0, (len(windows) // most).bit_length())
    for p in range(1 << bits):
        at = np.flatnonzero(windows >> np.uint64(64 - bits) == p) if bits else np.arange(len(windows))
        found = at[twice(windows[at])]
        for k in range(3):
            repeat[found + k] = True
    return int(repeat.sum())


def long_features(text: bytes, words: list[str]) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Base counts and histograms of one text of PART bytes or more, part by part: of the whole text only 8 bytes a word
    and a line are held."""
    sums = dict.fromkeys(("n_words", "word_chars", "n_symbols"), 0)
    classes, common = np.zeros((1, len(CLASSES)), np.int64), np.zeros((1, len(words) + 1), np.int64)
    hashes, view = [], memoryview(text)
    for a, b, whole in parts(text, SPACES):
        if whole:  # one word
            hashes.append(np.array([digest_hash(view[a:b])], np.uint64))
            for k in range(a, b, PART):
                raw = np.frombuffer(view[k : min(k + PART, b)], np.uint8)
                sums["word_chars"] += int(((raw & 0xC0) != 0x80).sum())
                sums["n_symbols"] += int(_flags(SYMBOLS)[raw].sum())
                classes += np.bincount(_class_table()[raw], minlength=len(CLASSES) + 1)[:-1]
            sums["n_words"] += 1
            common[0, -1] += 1
            continue
        scan = Scan([text[a:b]])
        hashes.append(scan.hashes(scan.word_start, scan.word_end))
        sums["n_words"] += int(scan.n_words[0])
        sums["word_chars"] += int((((scan.raw & 0xC0) != 0x80) & ~scan.space).sum())
        sums["n_symbols"] += int(_flags(SYMBOLS)[scan.raw].sum())
        both = histograms(scan, Scan([text[a:b]], lower=True), words)
        classes, common = classes + both[0], common + both[1]
    h = np.concatenate(hashes)
    del hashes
    sums["n_repeat_words"] = repeated_words(h)
    del h
    lines, breaks = [], _flags(b"\n")
    for a, b, whole in parts(text, breaks):
        if whole:
            if any(not SPACES[np.frombuffer(view[k : min(k + PART, b)], np.uint8)].all() for k in range(a, b, PART)):
                lines.append(np.array([digest_hash(view[a:b])], np.uint64))
        else:
            scan = Scan([text[a:b]])
            lines.append(scan.hashes(*lines_of(scan)))
    every = np.concatenate(lines) if lines else np.empty(0, np.uint64)
    sums["n_dup_lines"] = len(every) - len(np.unique(every))
    base = {k: np.array([sums[k]]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    return base, (classes, common)


def histograms(scan: Scan, low: Scan, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes and of common words (the last column: all other words), a row for each text."""
    n = len(CLASSES) + 1
    of_byte = np.repeat(np.arange(scan.count), np.diff(scan.starts))
    classes = np.bincount(of_byte * n + _class_table()[scan.raw], minlength=scan.count * n).reshape(-1, n)[:, :-1]
    classes[:, CLASSES.index("line")] -= 1  # the line feed that ends each text in the buffer
    end = low.word_end - _flags(TRIMMED)[low.bytes[low.word_end - 1]]
    h = low.hashes(low.word_start, end)
    known = Scan([w.encode() for w in words], lower=True)
    table = known.hashes(known.word_start, known.word_end)
    order = np.argsort(table)
    place = np.minimum(np.searchsorted(table[order], h), len(words) - 1)
    which = np.where(table[order][place] == h, order[place], len(words))
    m = len(words) + 1
    return classes, np.bincount(low.word_doc * m + which, minlength=low.count * m).reshape(-1, m)


def _features(common: dict[str, list[str]]):
    words = vocabulary(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch, 2):
                if len(texts[0]) >= PART:  # alone in its run
                    base, both = long_features(texts[0], words)
                else:
                    scan = Scan(texts)
                    base, both = base_counts(scan), histograms(scan, Scan(texts, lower=True), words)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().astype(np.int32)), x.shape[1]).cast(pa.list_(pa.int32())) for x in both]
                lang = pa.array([x if x in common else OTHER for x in batch.column(1).slice(a, b - a).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lang, *(pa.array(v.astype(np.int64)) for v in base.values()), *lists], names=["id", "lang", *base, "classes", "common"])

    return run


def shares(counts: np.ndarray) -> np.ndarray:
    """Whole millionths of each row's sum."""
    return np.rint(PER * counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, from 0 to 1) of each row to the reference; both are scaled to a sum of 1."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    q = np.broadcast_to(reference / max(reference.sum(), 1), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        half = [np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1) for x in (p, q)]
    return np.sqrt(np.clip((half[0] + half[1]) / 2, 0, 1))


def _judge(batch: pa.RecordBatch, references: dict[tuple[str, str], np.ndarray], guards: dict[str, int], limits: dict[str, tuple[float, float]]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which rows of a batch of features are near enough to their references, and their distances."""
    langs, near, found = np.array(batch.column("lang").to_pylist(), object), np.ones(batch.num_rows, bool), {}
    for kind, size in (("classes", "word_chars"), ("common", "n_words")):
        found[kind] = np.full(batch.num_rows, np.nan)
        for lang in set(langs):
            mine = (langs == lang) & (batch.column(size).to_numpy() >= guards[kind])
            if (lang, kind) in references and mine.any():
                found[kind][mine] = distances(_matrix(batch.column(kind))[mine], references[lang, kind])
        least, slack = limits[kind]
        near &= ~(found[kind] > least + slack / np.sqrt(np.maximum(batch.column(size).to_numpy(), 1)))
    return near, found


def _sums(references: dict[tuple[str, str], np.ndarray], guards: dict[str, int], limits: dict[str, tuple[float, float]]):
    """(lang, kind, bin, total): one task's sums of the shares of its texts that are near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, (near, _) = np.array(batch.column("lang").to_pylist(), object), _judge(batch, references, guards, limits)
            for kind in ("classes", "common"):
                part = shares(_matrix(batch.column(kind)))
                for lang in set(langs):
                    total[lang, kind] = total.get((lang, kind), 0) + part[near & (langs == lang)].sum(axis=0)
        rows = [(lang, kind, k, int(v)) for (lang, kind), x in total.items() for k, v in enumerate(x)]
        columns = zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["lang", "kind", "bin", "total"])

    return run


def _references(sums: DataFrame, bins: dict[str, int], least: int) -> dict[tuple[str, str], np.ndarray]:
    """Histograms by (language, kind), OTHER being all languages together, of at least `least` texts each."""
    totals: dict[tuple[str, str], np.ndarray] = {}
    for r in sums.groupBy("lang", "kind", "bin").agg(F.sum("total").alias("total")).collect():
        for lang in {r["lang"], OTHER}:
            totals.setdefault((lang, r["kind"]), np.zeros(bins[r["kind"]], np.int64))[r["bin"]] += r["total"]
    return {k: v for k, v in totals.items() if v.sum() >= least * PER * 0.99}


def _verdicts(references: dict[tuple[str, str], np.ndarray], guards: dict[str, int], limits: dict[str, tuple[float, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = {n: batch.column(n).to_numpy() for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            near, found = _judge(batch, references, guards, limits)
            found = [pa.array(found[kind], from_pandas=True) for kind in ("classes", "common")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(v) for v in base.values()), pa.array(failed), pa.array(near & ~failed), *found], names=["id", *base, "base_failed", "kept", "class_distance", "word_distance"])

    return run


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common: dict[str, list[str]] = COMMON_WORDS, least_chars: int = 200, least_words: int = 50, class_limit: tuple[float, float] = (0.08, 2.0), word_limit: tuple[float, float] = (0.3, 2.2), least_reference: int = 5, rounds: int = 3) -> DataFrame:
    """(id, base counts, base_failed, kept, class_distance, word_distance) for every row of df.

    A language's reference is the mean histogram of all texts of that language that pass the base rules and both length
    guards; it is taken `rounds` times, from the second on over the texts that the one before keeps. A language outside
    `common`, or none, is measured against the mean of all texts. A text is kept if it passes the base rules and neither
    distance is above its limit (a, b): a + b / sqrt(n) for n characters or words, as short texts stray by chance. A distance is null, and no
    ground for rejection, for a text below its guard and where the reference has fewer than least_reference texts.
    Null and empty texts have no words and fail the base rules. Long texts are scanned part by part. Repeated rows each get their row; other columns are
    ignored; an empty table gives an empty result. What is collected is two histograms for each entry of `common`."""
    rows = df.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["id"]
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    rows = written(rows.mapInArrow(_features(common), f"id {kind}, lang string, {counts}, classes array<int>, common array<int>"), "features")
    good = rows.where((F.col("n_words") >= max(50, least_words)) & (F.col("word_chars") >= least_chars) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words")))
    guards, limits = {"classes": least_chars, "common": least_words}, {"classes": class_limit, "common": word_limit}
    totals: dict[tuple[str, str], np.ndarray] = {}
    for _ in range(rounds):
        sums = good.mapInArrow(_sums(totals, guards, limits), "lang string, kind string, bin int, total long")
        totals = _references(sums, {"classes": len(CLASSES), "common": len(vocabulary(common)) + 1}, least_reference)
    run = _verdicts(totals, guards, limits)
    out = rows.mapInArrow(run, f"id {kind}, {counts}, base_failed boolean, kept boolean, class_distance double, word_distance double")
    return out.withColumnRenamed("id", id_col)
