"""WARC archives: exact round trips, broken segments and border cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from spatialframe.functions.durable import Scratch
from spatialframe.llm import warc

PAGE = "page_id long, url string, html string, digest string, n string, `first` string"
EVIL = "<p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n\r\n0\r\n\r\n" * 3


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], PAGE)


def wanted(rows, least=100):
    first = {}
    for i, _, h in rows:
        key = h or ""
        first[key] = min(first.get(key, (True, 0)), (i is None, i or 0))
    used, out = set(), []
    for i, _, h in rows:
        data = (h or "").encode()
        f = first[h or ""]
        again = len(data) >= least and ((i is None, i or 0) != f or (h in used))
        if (i is None, i or 0) == f:
            used.add(h)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", (None if f[0] else f[1]) if again else None, "ok"))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def rows():
    long, twin = "".join(f"é{i}" for i in range(30_000)), "<html>twin</html>" * 20
    some = [(1, "http://a.b/c?d=ü #x", EVIL), (2, None, None), (3, "WARC/1.1\r\n", ""), (4, "u", "tiny"), (5, "u", "tiny"), (None, "u", twin), (9, "v", twin), (7, "w", twin), (7, "w", twin), (7, "x", twin),
            (11, "u", long), (10, "u", long), (12, "u", EVIL + long), (13, "u", "a" * 99), (14, "u", "a" * 99), (15, "u", "b" * 100), (16, "u", "b" * 100), (None, None, "q" * 200), (None, None, "q" * 200)]
    return some + [(100 + i, "hot", "hot page " * 30) for i in range(300)] + [(20, "same", "same row " * 30)] * 250


@pytest.mark.parametrize("segment,chunk", [(warc.SEGMENT, warc.CHUNK), (700, 64)])
def test_round_trip(spark, rows, segment, chunk):
    got = warc.round_trip(frame(spark, rows), segment, chunk).collect()
    assert sorted(str(tuple(r)) for r in got) == wanted(rows)


def test_payloads_are_the_bytes_written(spark, rows):
    scratch = Scratch(spark)
    path = f"{scratch.root}/archives"
    scratch.paths["archives"] = path
    warc.write_archives(frame(spark, rows), path, 500, 50)
    records = warc.read_records(spark, path)
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.payloads(records).where("page_id is not null").collect()}
    assert got["1"] == EVIL.encode() and got["10"] == rows[10][2].encode() and got["2"] == b""
    kinds = {r["type"]: r["count"] for r in records.groupBy("type").count().collect()}
    assert kinds["continuation"] > 500 and kinds["response"] + kinds["revisit"] == len(rows)
    scratch.close()


def test_broken_segments_are_named(spark):
    scratch = Scratch(spark)
    text = [(i, "u", f"page {i} " * 400) for i in range(8)]
    path = f"{scratch.root}/archives"
    scratch.paths["archives"] = path
    warc.write_archives(frame(spark, text + [(9, "u", text[7][2])]), path, 1000, 100)
    records = scratch.keep(warc.read_records(spark, path), "records")
    name = {r["page_id"]: r["record_id"] for r in records.where("type = 'response'").collect()}
    of = lambda i: F.coalesce("origin", "record_id") == name[str(i)]
    bad = records.where(~(of(0) & (F.col("number") == 2)))                                       # a segment is missing
    bad = bad.where(~(of(1) & F.col("total").isNotNull()))                                       # the last one is missing
    bad = bad.unionByName(records.where(of(2) & (F.col("number") == 2)))                         # one comes twice
    bad = bad.withColumn("total", F.when(of(3), F.col("total") + 1).otherwise(F.col("total")))   # another length
    bad = bad.where(~(of(4) & (F.col("type") == "response")))                                    # no first record
    cut = F.when(of(5) & (F.col("number") == 2), F.concat(F.lit(b"zz"), F.expr("substring(block, 3)"))).otherwise(F.col("block"))
    bad = bad.withColumn("block", cut)                                                           # other bytes
    bad = bad.where(~(of(7)))                                                                    # a revisit without its page
    got = {(r["page_id"], r["record_type"]): r["status"] for r in warc.read_pages(bad, scratch).collect()}
    scratch.close()
    assert got.pop((5, "response")) in ("framing", "digest")
    assert got == {(0, "response"): "gap", (1, "response"): "gap", (2, "response"): "gap", (3, "response"): "length", (None, "response"): "origin", (6, "response"): "ok", (9, "revisit"): "origin"}


def test_framing():
    for data in (b"", b"x", b"0\r\n\r\n" * 50, bytes(range(256)) * 40):
        for size in (1, 7, 4096):
            assert warc.unchunked(warc.chunked(data, size)) == data
    assert warc.unchunked(b"3;name=v\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\nabc", b"-1\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        assert warc.unchunked(broken) is None
    assert warc.payload_of(b"HTTP/1.0 200 OK\r\nContent-Length: 2\r\n\r\nab") == b"ab" and warc.payload_of(b"no head") is None


def test_empty_table_and_cut_archive(spark, tmp_path):
    assert warc.round_trip(frame(spark, [])).count() == 0
    spark.createDataFrame([("WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nabc",)], "value string").write.option("compression", "gzip").text(str(tmp_path / "cut"))
    with pytest.raises(Exception, match="cut off"):
        warc.read_records(spark, str(tmp_path / "cut")).collect()
