"""Exact dedup: two-pass Bloom filtering, native."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, join_groups, without, written

BUCKET_BITS = 15  # of Spark's bitmap functions: 32768 bits, 4 KB
OWN = ("keep_id", "group_size", "kept", "text_sha256")


def broadcast_bits(spark: SparkSession, share: int = 64, least: int = 28, most: int = 34) -> int:
    """log2 of the bits that a broadcast filter may have: a share-th of an executor's heap as it is configured, 32 MB at
    least and 2 GB at most. So the filter grows with the executors, never with the data beyond them."""
    size = re.fullmatch(r"(\d+)([kmgt]?)b?", (spark.sparkContext.getConf().get("spark.executor.memory", "1g") or "1g").lower())
    heap = int(size[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[size[2]] if size else 1 << 30
    return min(most, max(least, (8 * heap // share).bit_length() - 1))


def filter_bits(rows: int, bits_per_row: int = 16, most: int = 28) -> int:
    """log2 of the filter's bits: bits_per_row for each row, 2**most at most (32 MB for 28)."""
    return max(BUCKET_BITS, min(most, (max(rows, 1) * bits_per_row - 1).bit_length()))


def _places(h: Column, bits: int) -> list[Column]:
    mask = F.lit((1 << bits) - 1).cast("long")
    return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)]


def repeated_filter(hashes: DataFrame, h: str, bits: int) -> DataFrame:
    """First pass: bitmaps (bucket, bits) of the cells that two rows or more hit.

    Only 8-byte cells move, summed before the shuffle, so that a hash of a third of all rows is one row a task."""
    cells = hashes.select(F.explode(F.array(*_places(F.col(h), bits))).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    return _bitmaps(cells.where("n > 1"))


def hit_filter(hashes: DataFrame, h: str, bits: int) -> DataFrame:
    """A Bloom filter: bitmaps (bucket, bits) of the cells that any row hits."""
    return _bitmaps(hashes.select(F.explode(F.array(*_places(F.col(h), bits))).alias("cell")))


def _bitmaps(cells: DataFrame) -> DataFrame:
    cells = cells.select(F.shiftright("cell", BUCKET_BITS).alias("bucket"), F.col("cell").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).alias("at"))
    return cells.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def _has(bitmap: Column, cell: Column) -> Column:
    byte = F.shiftright(cell.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)), 3).cast("int")
    value = F.conv(F.hex(F.substring(bitmap, byte + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (cell.bitwiseAND(F.lit(7)) + 1).cast("int"))
    return F.coalesce(value.bitwiseAND(bit) != 0, F.lit(False))


def flag_repeats(rows: DataFrame, h: str, found: DataFrame, bits: int, flag: str) -> DataFrame:
    """Second pass: `flag` is true for rows whose cells are all in the filter, so for every repeated hash.

    The filter is broadcast: filter_bits bounds it."""
    for i, place in enumerate(_places(F.col(h), bits)):
        probe = found.select(F.col("bucket").alias(f"__b{i}"), F.col("bits").alias(f"__m{i}"))
        rows = rows.join(F.broadcast(probe), F.shiftright(place, BUCKET_BITS) == F.col(f"__b{i}"), "left")
        rows = rows.withColumn(f"__f{i}", _has(F.col(f"__m{i}"), place)).drop(f"__b{i}", f"__m{i}")
    return rows.withColumn(flag, F.col("__f0") & F.col("__f1")).drop("__f0", "__f1")


def drop_ids(df: DataFrame, id_col: str, dropped: DataFrame, most_filter_bits: int | None = None) -> DataFrame:
    """df without the rows whose id is in `dropped` (one column, id_col).

    A Bloom filter of the dropped ids is broadcast, of bounded size; only rows that it names are shuffled and compared,
    the others never move. A null id can be dropped like any other. Rows travel as one struct, so that no name of theirs
    clashes."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit("\x00"))
    dropped = written(dropped.select(named(F.col(id_col)).alias("key")).distinct(), "dropped")
    bits = filter_bits(dropped.count(), most=most_filter_bits or broadcast_bits(df.sparkSession))
    found = written(hit_filter(dropped.select(F.xxhash64("key").alias("h")), "h", bits), "dropped-cells")
    rows = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("row"), named(F.col(f"`{id_col}`")).alias("key"))
    flagged = flag_repeats(rows.withColumn("h", F.xxhash64("key")), "h", found, bits, "hit")
    rest = flagged.where("hit").join(dropped, "key", "left_anti")
    return flagged.where("not hit").select("row.*").unionByName(rest.select("row.*"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None, most_filter_bits: int | None = None) -> DataFrame:
    """Every row of df with keep_id, group_size, kept and text_sha256 (of the text with A-Z lower-cased).

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id stays. carry: the
    columns to return besides (default: all). Null texts count as empty and so do they among themselves. Rows that share
    both id and text are all kept if their id is the largest. A null id is smaller than any other; a group of null ids
    alone has a null keep_id and all its rows are kept. Columns of df with the names of the new ones are replaced.
    An empty table gives an empty result. Ends with a shuffle of possibly repeated rows only: the others never move. The
    filter has 16 bits a row up to most_filter_bits (default: broadcast_bits); with more rows it names more that are alone,
    which are shuffled with the others and change nothing."""
    carry = [c for c in df.columns if c.lower() not in OWN] if carry is None else list(carry)
    df = without(df, OWN)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.count()
    bits = filter_bits(rows, most=most_filter_bits or broadcast_bits(df.sparkSession))
    # texts that are equal after lower-casing A-Z are equal after lower-casing all: the cheaper function never parts them
    found = written(repeated_filter(df.select(F.xxhash64(F.lower(text)).alias("__h")), "__h", bits), "repeated-cells")
    probed = df.withColumn("__h", F.xxhash64(F.lower(text))).withColumn("text_sha256", F.sha2(ascii_lower(text).cast("binary"), 256))
    probed = flag_repeats(probed, "__h", found, bits, "__again").select(*[f"`{c}`" for c in carry], F.col(id_col).alias("__id"), "text_sha256", "__again")
    probed = written(probed, "probed")  # the texts are hashed once for both branches
    once = probed.where("not __again").select("*", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    again = probed.where("__again")
    groups = again.groupBy("text_sha256").agg(F.max("__id").alias("keep_id"), F.count("*").alias("group_size"))
    again = join_groups(again, groups, "text_sha256", "group_size", rows)
    out = once.unionByName(again).withColumn("kept", F.col("__id").eqNullSafe(F.col("keep_id")))
    return out.select(*[f"`{c}`" for c in carry], *OWN)
