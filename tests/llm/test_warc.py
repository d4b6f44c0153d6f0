import base64
import gzip
import hashlib
import io
from collections import Counter

import pytest
from pyspark.sql import functions as F

from branchstone.llm.warc import Reader, export_files, parse, read_archives, write_archives

ROWS = [(k, f"http://x/{k}", f"<p>{k % 5}</p>" + "\r\n\r\nWARC/1.1\r\n" * (k % 5)) for k in range(40)]
ROWS += [(100, None, None), (101, "a b\r\nX: y\x7fé", ""), (102, "u", "é漢😀" * 50000), (99, "u", "é漢😀" * 50000), (103, "u", "x" * 65536), (104, "u", "x" * 65537), (105, "same", "twice"), (105, "same", "twice"), (None, "no id", "lone"), (None, "no id", "twice"), (106, "u", "\r\n\r\n"), (107, "u", "\r\n")]
ROWS += [(1000 + k, "hot", "hot") for k in range(3000)]


def brute(least=0):
    first = {}
    for i, _, t in ROWS:
        ids = first.setdefault(t or "", [])
        if i is not None:
            ids.append(i)
    out = []
    for i, _, t in ROWS:
        raw = (t or "").encode()
        low = min(first[t or ""], default=None) if len(raw) >= least else i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == low else "revisit", None if i == low else low))
    return Counter(out)


def frame(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as first", "2 as n", "3 as payload", "4 as archive").repartition(3)


def test_round_trip(spark, tmp_path):
    for least in (0, 6):
        chunks = write_archives(frame(spark), least_bytes=least).cache()
        got = read_archives(chunks).drop("uri").collect()
        assert Counter(map(tuple, got)) == brute(least)
    assert chunks.where("n_chunks > 1").count() > 10
    for compressed in (True, False):
        at = tmp_path / f"files{compressed}"
        names = [r.file for r in export_files(chunks, f"file://{at}", compressed).collect()]
        assert sorted(names) == sorted(p.name for p in at.iterdir())
        read = Counter()
        for p in at.iterdir():
            with (gzip.open if compressed else open)(p, "rb") as f:
                read.update(r[:5] for r in parse(f))
        assert read == brute(6)


def test_no_two_records_share_an_identifier(spark):
    rows = [*ROWS, (5, "x", "other"), (5, "y", "other"), (5, "z", None), (7, "x", "other"), (None, None, None)] + [(None, "u", f"n{k % 3}") for k in range(30)]
    chunks = write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).cache()
    records = chunks.where("chunk_no = 0").select("record_id", F.col("data").cast("string").alias("head")).collect()
    names = {r.record_id for r in records}
    assert len(names) == len(records) == len(rows)
    refers = [r.head.split("WARC-Refers-To: ", 1)[1].split("\r\n", 1)[0] for r in records if "WARC-Type: revisit" in r.head]
    assert refers and set(refers) <= names
    assert {r.record_id for r in records if "WARC-Type: response" in r.head} >= set(refers)


@pytest.fixture(scope="module")
def chunks(spark):
    payload = bytearray(bytes(range(256)) * 1000)
    df = spark.createDataFrame([(7, "u", payload), (8, "u", bytearray(b"payload"))], "page_id long, url string, html binary").coalesce(1)
    return write_archives(df, chunk_bytes=1000).orderBy("record_no", "chunk_no").collect()


def test_chunks_of_one_record(chunks):
    payload, chunks = bytes(range(256)) * 1000, [c for c in chunks if c.n_chunks > 1]
    assert [c.chunk_no for c in chunks] == list(range(257)) and {c.n_chunks for c in chunks} == {257}
    for c in chunks:
        assert c.running_digest == base64.b32encode(hashlib.sha1(payload[: c.chunk_no * 1000]).digest()).decode()
    raw = b"".join(bytes(c.data) for c in chunks)
    assert raw.endswith(payload + b"\r\n\r\n")
    assert next(parse(io.BytesIO(raw), 999))[:4] == (7, 256000, chunks[-1].running_digest, "response")
    for step in (1, 7, 100_000):  # however the bytes are cut
        reader = Reader()
        for k in range(0, len(raw), step):
            reader.feed(raw[k : k + step])
        assert reader.result()[1] == 256000


def test_damage_is_found(chunks):
    raw = next(bytes(c.data) for c in chunks if c.n_chunks == 1)
    assert len(list(parse(io.BytesIO(raw)))) == 1
    for bad in (raw.replace(b"payload", b"PAYLOAD"), raw[:-8]):
        with pytest.raises(ValueError):
            list(parse(io.BytesIO(bad)))


def test_payloads_of_revisits_are_not_shuffled(spark):
    """Whole payloads pass an exchange only on the way to the response that others refer to."""
    plan = write_archives(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan or "PythonMapInArrow" in plan
    settled = [line for line in plan.splitlines() if "Exchange" in line and "payload" in line]
    assert len(settled) <= 1


def test_empty(spark):
    assert read_archives(write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).collect() == []
