"""Content measures of tables: rows, canonical bytes and digests that do not depend on order or storage."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def instant_text(c: Column) -> Column:
    """An instant in UTC, as 2024-02-29T01:02:03.000004+00:00, whatever the session's zone: dates have none."""
    day, micros = 86_400_000_000, F.unix_micros(c)
    rest = F.pmod(micros, F.lit(day))
    part = lambda size, modulo: F.lpad(F.pmod(F.floor(rest / F.lit(size)), F.lit(modulo)).cast("string"), len(str(modulo - 1)), "0")
    date = F.date_from_unix_date(((micros - rest) / F.lit(day)).cast("int")).cast("string")
    return F.concat(date, F.lit("T"), part(3_600_000_000, 24), F.lit(":"), part(60_000_000, 60), F.lit(":"), part(1_000_000, 60), F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("+00:00"))


def _text(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        return instant_text(c)
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, T.StructType) and "ewkb" in kind.names:  # a geometry
        return F.lower(F.hex(c["ewkb"]))
    return c.cast("string")


def canonical_row(df: DataFrame) -> Column:
    """One JSON text for a row: keys sorted, values as text, nulls kept, so that equal rows have equal bytes."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.to_json(F.struct(*[_text(f.name, f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})


def measure(df: DataFrame, key: str, schema_hash: str, leave_out: Sequence[str] = (), row: Column | None = None) -> DataFrame:
    """One row (row_count, row_bytes, rows_sha256) of a table.

    rows_sha256 is the SHA-256 of the schema hash, a colon and the hexadecimal SHA-256 of each row in order of the key.
    The list of digests, 64 bytes a row, is put together in one task: for snapshots within quota. measure_tree has no
    such limit."""
    df = df.drop(*leave_out)
    lines = df.select(F.col(key).cast("string").alias("k"), (canonical_row(df) if row is None else row).alias("line"))
    lines = lines.select("k", F.octet_length("line").alias("n"), F.sha2("line", 256).alias("h"))
    joined = F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ""), F.lit(""))
    return lines.agg(F.count("*").alias("row_count"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("row_bytes"), F.sha2(F.concat(F.lit(f"{schema_hash}:"), joined), 256).alias("rows_sha256"))


def byte_count(df: DataFrame, leave_out: Sequence[str] = ()) -> int:
    """The canonical bytes of a table, without any digest."""
    df = df.drop(*leave_out)
    return df.agg(F.coalesce(F.sum(F.octet_length(canonical_row(df))), F.lit(0)).cast("long")).first()[0]


def measure_tree(df: DataFrame, key: str, schema_hash: str, leave_out: Sequence[str] = (), digits: int = 3, row: Column | None = None) -> DataFrame:
    """The same counts with a digest of digests: rows by the first hexadecimal digits of their key's MD5, then these
    buckets in order.

    No task has more than a bucket's rows, so take more digits as the table grows. It is another format than measure's."""
    df = df.drop(*leave_out)
    lines = df.select(F.col(key).cast("string").alias("k"), (canonical_row(df) if row is None else row).alias("line"))
    lines = lines.select(F.substring(F.md5("k"), 1, digits).alias("b"), "k", F.octet_length("line").alias("n"), F.sha2("line", 256).alias("h"))
    joined = lambda of: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(of, "h"))), lambda x: x["h"]), "")
    each = lines.groupBy("b").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.sha2(joined("k"), 256).alias("h"))
    return each.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("row_bytes"), F.sha2(F.concat(F.lit(f"{schema_hash}:tree:"), F.coalesce(joined("b"), F.lit(""))), 256).alias("rows_sha256"))


def empty_digest(schema_hash: str) -> str:
    return hashlib.sha256(f"{schema_hash}:".encode()).hexdigest()


def same(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: both measures' counts and digests, and whether they agree."""
    a = before.select(*[F.col(c).alias(f"before_{c}") for c in before.columns], F.lit(1).alias("one"))
    b = after.select(*[F.col(c).alias(f"after_{c}") for c in after.columns], F.lit(1).alias("one"))
    agree = [F.col(f"before_{c}") == F.col(f"after_{c}") for c in before.columns]
    return a.join(b, "one").drop("one").withColumn("intact", agree[0] & agree[1] & agree[2])
