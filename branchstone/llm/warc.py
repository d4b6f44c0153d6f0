"""WARC archives as a table of chunks: oversized payloads are rows by record and chunk number, with running digests."""

from __future__ import annotations

import gzip
import hashlib
import io
from base64 import b32encode
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, written
from .exact_dedup import broadcast_bits, filter_bits, flag_repeats, hit_filter, repeated_filter

# The format's version line and the profile of revisit records.
VERSION = b"WARC/1.1\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
RECORD = "urn:x-page:"
CHUNKS = "archive int, record_no long, record_id string, chunk_no int, n_chunks int, running_digest string, data binary"
FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string"


def digest_of(state) -> str:
    """Bare upper-case base32 SHA-1."""
    return b32encode(state.digest()).decode()


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    """The identifier of a record. A record that others may refer to is the only one of its page and payload; every other
    has its place in the archives added, so that no two records share one."""
    return f"<{RECORD}{'' if page_id is None else page_id}:{digest}{place and ':' + place}>"


def page_of(identifier: bytes) -> int | None:
    number = identifier.decode().removeprefix(f"<{RECORD}").split(":", 1)[0]
    return int(number) if number else None


def safe_uri(uri: str | None, page_id: int | None) -> bytes:
    """The URI with control characters and spaces as %XX, so that it is one header value; the record's own if there is none."""
    raw = (uri or f"{RECORD}{'' if page_id is None else page_id}").encode()
    return b"".join(b"%%%02X" % b if b <= 0x20 or b == 0x7F else bytes((b,)) for b in raw)


def record_head(identifier: str, page_id: int | None, uri: str | None, size: int, digest: str, refers_to: str | None, date: str) -> bytes:
    """All of a record before its payload: WARC header and HTTP head. A revisit, which refers to a record, ends here."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    lines = [
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + identifier.encode(),
        b"WARC-Date: " + date.encode(),
        b"WARC-Target-URI: " + safe_uri(uri, page_id),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % (len(http) + (0 if revisit else size)),
    ]
    if refers_to is not None:
        lines += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + refers_to.encode()]
    return VERSION + b"\r\n".join(lines) + b"\r\n\r\n" + http


class Reader:
    """Parses one record from its chunks as they come; holds the head and the digest's state, never the payload."""

    def __init__(self):
        self.head, self.state, self.size, self.fields = b"", hashlib.sha1(), 0, None

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            if (cut := self.head.find(END)) < 0:
                return
            lines = self.head[:cut].split(b"\r\n")
            if lines[0] + b"\r\n" != VERSION:
                raise ValueError("not a WARC record")
            self.fields = dict(line.split(b": ", 1) for line in lines[1:])
            self.left, self.http, data, self.head = int(self.fields[b"Content-Length"]), b"", self.head[cut + 4 :], b""
        if self.http is not None:
            self.http += data
            if (cut := self.http.find(END)) < 0:
                return
            self.length = int(self.http[:cut].split(b"Content-Length: ", 1)[1].split(b"\r\n", 1)[0])
            self.left -= cut + 4
            data, self.http = self.http[cut + 4 :], None
        part = memoryview(data)[: max(0, self.left - self.size)]
        self.size += len(part)
        self.state.update(part)

    def result(self) -> tuple:
        """A row of FOUND; what was read is held against the header's length and digest."""
        kind = self.fields[b"WARC-Type"].decode()
        digest = self.fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
        if self.size != self.left or kind == "response" and (self.size != self.length or digest_of(self.state) != digest):
            raise ValueError(f"{self.fields[b'WARC-Record-ID'].decode()}: payload and header differ")
        refers = self.fields.get(b"WARC-Refers-To")
        return page_of(self.fields[b"WARC-Record-ID"]), self.length, digest, kind, refers and page_of(refers), self.fields[b"WARC-Target-URI"].decode()


def parse(stream: BinaryIO, chunk_bytes: int = 1 << 16) -> Iterator[tuple]:
    """Rows of FOUND from a WARC file, read chunk by chunk."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        reader = Reader()
        reader.feed(line)
        while reader.fields is None:
            reader.feed(stream.readline())
        left = reader.left
        while left > 0:
            part = stream.read(min(chunk_bytes, left))
            if not part:
                raise ValueError("the file ends within a record")
            left -= len(part)
            reader.feed(part)
        yield reader.result()


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


CHUNK_SCHEMA = pa.schema([("archive", pa.int32()), ("record_no", pa.int64()), ("record_id", pa.string()), ("chunk_no", pa.int32()), ("n_chunks", pa.int32()), ("running_digest", pa.string()), ("data", pa.binary())])
FOUND_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string())])


def _writer(date: str, batch_bytes: int = 8 << 20):
    """Chunks of records from rows of payload pieces, which come in order; no more than a piece is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, number, rows, held = TaskContext.get().partitionId(), -1, [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                page, uri, size, sha1, refers, revisit, own, k, count = (batch.column(c)[r].as_py() for c in range(9))
                data = batch.column(9)[r].as_buffer() or b""
                if k == 0:
                    number, state = number + 1, hashlib.sha1()
                    digest = b32encode(bytes.fromhex(sha1)).decode()
                    name = record_id(page, digest, "" if own else f"{archive}-{number}")
                    head = record_head(name, page, uri, size, digest, record_id(refers, digest) if revisit else None, date)
                    if count == 1:
                        rows.append((archive, number, name, 0, 1, digest, b"".join((head, data, END))))
                    else:
                        rows.append((archive, number, name, 0, count + 1, digest_of(state), head))
                if count > 1:
                    state.update(data)
                    rows.append((archive, number, name, k + 1, count + 1, digest_of(state), b"".join((data, END if k == count - 1 else b""))))
                    if k == count - 1 and digest_of(state) != digest:
                        raise ValueError(f"{name}: the pieces are not the payload")
                held += len(rows[-1][-1])
                if held >= batch_bytes:
                    yield _table(rows, CHUNK_SCHEMA)
                    rows, held = [], 0
        yield _table(rows, CHUNK_SCHEMA)

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of one record after the other, in order."""
    reader = None
    for batch in batches:
        rows = []
        for number, count, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if number == 0:
                reader = Reader()
            reader.feed(data.as_buffer())
            if number == count - 1:
                rows.append(reader.result())
        yield _table(rows, FOUND_SCHEMA)


def write_archives(df: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0, chunk_bytes: int = 1 << 16, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The chunk table (CHUNKS) of one WARC record for each row of df, an archive for each partition.

    The rows of an archive by record_no and chunk_no are the bytes of a WARC file; export_files writes them. Of records
    with equal payloads of at least least_bytes bytes that with the smallest id is the response and the others revisit
    it. Null payloads count as empty, null URIs as the record's own identifier. A null id is smaller than none: it is
    referred to only where all ids of a payload are null. Rows that share the smallest id are all responses, and the
    revisits refer to one of them. No two records share an identifier. Other columns are ignored; an empty table gives no
    chunks. Equal payloads are found by the Bloom filter of exact dedup, and who revisits whom is settled by digests: the
    only payloads that are shuffled are those of responses that are referred to. Digests are made, and payloads cut into
    chunks, before they reach the writer, which never holds a whole one."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).cast("long").alias("page"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    count, most = df.count(), broadcast_bits(df.sparkSession)
    bits = filter_bits(count, most=most)
    sized = rows.withColumn("h", F.when(F.octet_length("payload") >= least_bytes, F.xxhash64("payload")))
    found = written(repeated_filter(sized.where("h is not null").select("h"), "h", bits), "repeated-cells")
    probed = flag_repeats(sized, "h", found, bits, "again").withColumn("again", F.coalesce("again", F.lit(False)))
    size, sha1 = F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1")
    nobody, no, yes = F.lit(None).cast("long").alias("refers"), F.lit(False), F.lit(True)
    once = probed.where("not again").select("page", "uri", size, sha1, nobody, no.alias("revisit"), F.col("h").isNotNull().alias("own"), "payload")

    again = probed.where("again").withColumn("sha", F.sha2("payload", 256))
    light = written(again.select("page", "uri", size, sha1, "sha"), "repeated")
    groups = written(light.groupBy("sha").agg(F.min("page").alias("first"), F.count("*").alias("n")), "groups")
    settled = join_groups(light, groups, "sha", "n", count).withColumn("revisit", ~F.col("page").eqNullSafe(F.col("first")))
    revisits = settled.where("revisit").select("page", "uri", "size", "sha1", F.col("first").alias("refers"), "revisit", no.alias("own"), F.lit(None).cast("binary").alias("payload"))

    pair = F.xxhash64("sha", "page")
    bits = filter_bits(groups.count(), most=most)
    firsts = written(hit_filter(groups.select(F.xxhash64("sha", F.col("first")).alias("h")), "h", bits), "response-cells")
    chosen = flag_repeats(again.drop("h").withColumn("h", pair), "h", firsts, bits, "hit").where("hit")
    named = groups.select("sha", F.col("first").alias("page"))
    chosen = chosen.join(named, (chosen["sha"] == named["sha"]) & chosen["page"].eqNullSafe(named["page"]), "left_semi")
    if light.groupBy("sha", "page").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        chosen = chosen.withColumn("own", yes)
    else:  # of rows that share id and payload one is referred to
        chosen = written(chosen.withColumn("row", F.monotonically_increasing_id()), "responses")
        lows = written(chosen.groupBy("sha").agg(F.min("row").alias("low"), F.count("*").alias("n")), "lows")
        chosen = join_groups(chosen, lows, "sha", "n", count).withColumn("own", F.col("row") == F.col("low"))
    responses = chosen.select("page", "uri", size, sha1, nobody, no.alias("revisit"), "own", "payload")

    every = once.unionByName(responses).unionByName(revisits)
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size - 1) div {chunk_bytes} as int)")), lambda k: F.substring("payload", k * chunk_bytes + 1, F.lit(chunk_bytes)))
    pieces = F.when(F.col("revisit") | (F.col("size") <= chunk_bytes), F.array("payload")).otherwise(cut)
    heads = every.select("page", "uri", "size", "sha1", "refers", "revisit", "own", pieces.alias("pieces"))
    heads = heads.select("page", "uri", "size", "sha1", "refers", "revisit", "own", F.size("pieces").alias("count"), F.posexplode("pieces").alias("k", "data"))
    return heads.select("page", "uri", "size", "sha1", "refers", "revisit", "own", "k", "count", "data").mapInArrow(_writer(date), CHUNKS)


def read_archives(chunks: DataFrame) -> DataFrame:
    """A row (FOUND) for each record of a chunk table, with length and digest of the full payload.

    Records of one chunk are read where they lie; only the chunks of larger ones are brought together and put in order.
    Payloads are held against the header's digest."""
    chunks = chunks.select("archive", "record_no", "chunk_no", "n_chunks", "data")
    whole = chunks.where("n_chunks = 1").select("chunk_no", "n_chunks", "data")
    parts = chunks.where("n_chunks > 1").repartition("archive", "record_no").sortWithinPartitions("archive", "record_no", "chunk_no")
    return whole.mapInArrow(_reader, FOUND).unionByName(parts.select("chunk_no", "n_chunks", "data").mapInArrow(_reader, FOUND))


def _exporter(uri: str, compressed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        out, now, files = None, None, []
        suffix = f".{TaskContext.get().taskAttemptId()}.tmp"

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(f"{root}/{files[-1]}{suffix}", f"{root}/{files[-1]}")

        for batch in batches:
            for archive, number, last, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if archive != now:
                    close()
                    now = archive
                    files.append(f"part-{archive:06d}.warc" + ".gz" * compressed)
                    out = fs.open_output_stream(f"{root}/{files[-1]}{suffix}", compression=None)
                if compressed:
                    if number == 0:
                        held = io.BytesIO()
                        member = gzip.GzipFile(fileobj=held, mode="wb", mtime=0)
                    member.write(data.as_buffer())
                    if number == last - 1:
                        member.close()
                    out.write(held.getvalue())
                    held.seek(0)
                    held.truncate()
                else:
                    out.write(data.as_buffer())
        close()
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], names=["file"])

    return run


def export_files(chunks: DataFrame, uri: str, compressed: bool = True) -> DataFrame:
    """Writes the archives as WARC files, a gzip member for each record, under a URI that all executors can write to.

    Files get their names when they are complete, so a task that is run again leaves none half written."""
    ordered = chunks.repartition("archive").sortWithinPartitions("archive", "record_no", "chunk_no")
    return ordered.select("archive", "chunk_no", "n_chunks", "data").mapInArrow(_exporter(uri, compressed), "file string")
