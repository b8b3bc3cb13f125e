"""WARC archives: pages written as records, and archives read back by reassembling segments.

*Writing.* Every page is an HTTP response in chunked transfer framing. A block longer than ``segment`` bytes is cut: the first record carries segment
number 1, the rest are ``continuation`` records that name its id as their origin, and the last one states the total length. Of pages whose payloads are
equal and have at least ``least`` bytes the one with the smallest page_id keeps its payload (equal by SHA-256); the others become
``revisit`` records that name it. Archives are gzip files, written by Spark.

*Reading.* A gzip file is read by one task from front to back, a bounded piece at a time: the text reader cuts at ``WARC/1.``, and a record goes on
over as many pieces as its Content-Length wants, so the mark may well stand inside a payload. Segments are grouped by origin id, put in
order of their numbers, checked for gaps and for the total length, and the chunked framing is decoded. Revisits take digest and
length from the record they name. ``status`` says what is wrong with a payload: ``gap`` (a segment is missing or comes twice, or none is the last),
``length`` (the segments don't add up to the total length), ``framing`` (bad chunks), ``digest`` (not the payload that was written), ``origin``
(continuations without a first record, or a revisit of a record that isn't there); else it is ``ok``. Only pages longer than a segment are shuffled.

A null html is an empty payload, a null url is left out of the record. A null page_id counts as larger than any other and comes back as null.
Equal rows are records of their own: one response, the others revisit it. Columns other than page_id, url and html are not read. An empty
table gives archives without records and no row. An archive that is cut off within a record or has other bytes between records stops the job.
"""

from __future__ import annotations

import hashlib
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from spatialframe.functions.durable import Scratch

from .words import map_arrow

MARK, BREAK = "WARC/1.", "\r\n\r\n"
SEGMENT, CHUNK, LEAST = 1 << 15, 1 << 12, 100
NO_ID = (1 << 63) - 1
COPIES = 100_000                # equal rows made by one row
FLUSH = 1 << 23                 # bytes of a batch
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD = ("type string, record_id string, page_id string, refers_to string, digest string, payload_bytes long, origin string, number int, total long, block binary")
FIELDS = [f.split()[0] for f in RECORD.split(", ")]
KINDS = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i:i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, null where the framing is broken. Chunk extensions and trailer lines are allowed."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out) if body[at:at + 2] == b"\r\n" or body.endswith(b"\r\n\r\n") else None
        if body[at + size:at + size + 2] != b"\r\n":
            return None
        out.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response: decoded where the transfer is chunked, as it is otherwise."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return None
    fields = dict((k.strip().lower(), v.strip().lower()) for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:]))
    return unchunked(body) if fields.get(b"transfer-encoding", b"").endswith(b"chunked") else body


def _named(key: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(key.encode()).hexdigest())}>"


def _record(kind: str, record_id: str, page, url, block: bytes, **more) -> bytes:
    """Everything of a record but the empty lines that end it."""
    lines = [f"{MARK}1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=chr(35) + '%/:?&=+@!$,;~[]')}")
    if page is not None:
        lines.append(f"Page-ID: {page}")
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in more.items()]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block


def _records(page, url, html, digest, n_bytes, first, copy, at: str, segment: int, chunk: int):
    """The records of one page: a response in as many segments as it needs, or a revisit of page ``first``."""
    told = {"WARC_Payload_Digest": f"sha256:{digest}", "Payload_Length": n_bytes}
    if copy is not None:
        yield _record("revisit", _named(f"revisit {at}"), page, url, b"", WARC_Refers_To=_named(f"first {digest}"), WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", **told)
        return
    name, block = _named(f"first {digest}" if first is not None else f"page {at}"), HTTP + chunked(html or b"", chunk)
    if len(block) <= segment:
        yield _record("response", name, page, url, block, **told)
        return
    for k, a in enumerate(range(0, len(block), segment), 1):
        last = {"WARC_Segment_Total_Length": len(block)} if a + segment >= len(block) else {}
        if k == 1:
            yield _record("response", name, page, url, block[:segment], WARC_Segment_Number=1, **told)
        else:
            yield _record("continuation", _named(f"{name} {k}"), None, url, block[a:a + segment], WARC_Segment_Origin_ID=name, WARC_Segment_Number=k, **last)


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, chunk: int = CHUNK, least: int = LEAST) -> None:
    """Write the pages as WARC files below ``path``."""
    scratch = Scratch(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page"), "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("n"))
    # one row per payload that occurs more than once: counted before the shuffle, without the texts
    again = base.where(F.col("n") >= least).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    again = scratch.keep(again.select("digest", "first"), "again")
    rows = base.join(again, "digest", "left")
    none = F.lit(None).cast("long")
    single = rows.where("first is null or page <> first").select("page", "url", F.when(F.col("first").isNull(), F.col("html")).alias("html"), "digest", "n", "first", F.when(F.col("first").isNotNull(), F.lit(0)).cast("long").alias("copy"))
    # the first page of a payload, once with its text; rows that repeat it revisit it
    firsts = scratch.keep(rows.where("page = first").groupBy("digest").agg(F.min("page").alias("page"), F.min("url").alias("url"), F.first("html").alias("html"), F.first("n").alias("n"), F.count(F.lit(1)).alias("times")), "firsts")
    one = firsts.select("page", "url", "html", "digest", "n", F.col("page").alias("first"), none.alias("copy"))
    blocks = firsts.where("times > 1").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 2) / COPIES))).alias("block"))
    more = blocks.select("*", F.explode(F.sequence(F.col("block") * COPIES, F.least(F.col("times") - 2, (F.col("block") + 1) * COPIES - 1))).alias("copy"))
    more = more.select("page", "url", F.lit(None).cast("string").alias("html"), "digest", "n", F.col("page").alias("first"), (F.col("copy") + 1).alias("copy"))

    def run(batches):
        seen = 0
        for b in batches:
            out, size = [], 0
            for row in zip(*(b.column(c) for c in range(b.num_columns))):
                page, url, text, digest, n, first, copy, part = (x.as_py() for x in row)
                seen += 1
                for r in _records(None if page == NO_ID else page, url, text, digest, n, first, copy, f"{part} {seen}", segment, chunk):
                    out.append(r)
                    size += len(r)
                if size >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
    every = single.unionByName(one).unionByName(more).select("page", "url", F.col("html").cast("binary").alias("html"), "digest", "n", "first", "copy", F.spark_partition_id().alias("part"))
    every.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", BREAK).option("compression", "gzip").text(path)
    scratch.close()


def _parsed(data: bytes, where: str):
    """Header fields of a record and the place where its block begins; null while the header is not complete."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8").split("\r\n")
    if lines[0] not in ("0", "1"):
        raise ValueError(f"no record begins after the end of another one in {where}: {lines[0][:60]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, end + 4


def _cells(fields: dict[str, str], block: bytes) -> list:
    number = lambda k: int(fields[k]) if k in fields else None
    return [fields.get("warc-type"), fields.get("warc-record-id"), fields.get("page-id"), fields.get("warc-refers-to"), fields.get("warc-payload-digest", "").removeprefix("sha256:") or None,
            number("payload-length"), fields.get("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length"), block]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the gzip archives below ``path``."""
    def run(batches):
        file, held, need, fields = None, b"", None, None       # the record that is being read
        out, size = [], 0

        def closed():
            if file is not None and (need is not None or held.strip()):
                raise ValueError(f"a record is cut off at the end of {file}")
        for b in batches:
            for name, piece in zip(b.column(0), b.column(1)):
                name, piece = name.as_py(), piece.as_py()
                if name != file:
                    if not name.endswith(".gz"):
                        raise ValueError(f"{name} is no gzip file: a file that can be split is not read in order")
                    closed()
                    file, held, need, fields = name, b"", None, None
                    if piece.strip():
                        raise ValueError(f"{name} doesn't begin with a record")
                    continue
                held = held + MARK.encode() + piece if need is not None or held else piece
                if need is None:
                    parsed = _parsed(held, file)
                    if parsed is None:
                        continue
                    fields, start = parsed
                    need = start + int(fields["content-length"])
                if len(held) < need:
                    continue
                if held[need:].strip(b"\r\n"):
                    raise ValueError(f"bytes between records in {file}")
                out.append(_cells(fields, held[need - int(fields["content-length"]):need]))
                size += len(held)
                held, need, fields = b"", None, None
                if size >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), KINDS)], FIELDS)
                    out, size = [], 0
        closed()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), KINDS)], FIELDS)
    lines = spark.read.option("lineSep", MARK).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(run, RECORD)


def _decode(whole: DataFrame) -> DataFrame:
    """Payloads of whole blocks: (record_id, page_id, payload_bytes, payload_digest, status, payload)."""
    def run(b):
        out = []
        for rid, page, digest, status, blocks in zip(*(b.column(c) for c in range(5))):
            rid, page, digest, status = rid.as_py(), page.as_py(), digest.as_py(), status.as_py()
            payload = payload_of(b"".join(blocks.as_py())) if status == "ok" else None
            if status == "ok" and payload is None:
                status = "framing"
            found = None if payload is None else hashlib.sha256(payload).hexdigest()
            if status == "ok" and digest is not None and found != digest:
                status = "digest"
            out.append((rid, page, None if payload is None else len(payload), found, status, payload))
        cells = zip(*out) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()])],
                                         ["record_id", "page_id", "payload_bytes", "payload_digest", "status", "payload"])
    return map_arrow(whole.select("record_id", "page_id", "digest", "status", "blocks"), run, "record_id string, page_id string, payload_bytes long, payload_digest string, status string, payload binary")


def payloads(records: DataFrame) -> DataFrame:
    """The responses of ``records`` with their payloads: (record_id, page_id, payload_bytes, payload_digest, status, payload)."""
    whole = records.where("type = 'response' and number is null").select("record_id", "page_id", "digest", F.lit("ok").alias("status"), F.array("block").alias("blocks"))
    parts = records.where("number is not null and type in ('response', 'continuation')")
    one = F.struct("number", "total", "block")
    first = lambda c: F.max(F.when(F.col("type") == "response", F.col(c))).alias(c)
    grouped = parts.groupBy(F.coalesce("origin", "record_id").alias("record_id")).agg(F.sort_array(F.collect_list(one)).alias("parts"), first("page_id"), first("digest"), F.max(F.col("type") == "response").alias("has_first"))
    numbers = F.transform("parts", lambda p: p["number"])
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    total = F.element_at("parts", -1)["total"]
    status = (F.when(~F.col("has_first"), "origin").when((numbers != F.sequence(F.lit(1), F.size("parts"))) | total.isNull(), "gap")
              .when(length != total, "length").otherwise("ok"))
    blocks = F.transform("parts", lambda p: p["block"])
    return _decode(whole.unionByName(grouped.select("record_id", "page_id", "digest", status.alias("status"), blocks.alias("blocks"))))


def read_pages(records: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, status) of every response and revisit."""
    whole = scratch.keep(payloads(records).drop("payload"), "responses")
    told = records.where("type = 'revisit'").select("page_id", "refers_to", "digest")
    by = whole.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first"), "payload_bytes", "payload_digest", F.col("status").alias("found"))
    named = told.join(by, "refers_to", "left")
    status = F.when(F.col("found").isNull(), "origin").when((F.col("found") == "ok") & (F.col("digest") != F.col("payload_digest")), "digest").otherwise(F.col("found"))
    revisits = named.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("first").alias("refers_to"), status.alias("status"))
    responses = whole.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), "status")
    return responses.unionByName(revisits).withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def round_trip(pages: DataFrame, segment: int = SEGMENT, chunk: int = CHUNK, least: int = LEAST) -> DataFrame:
    """Write the pages, read the archives back, and delete them: one row per page."""
    scratch = Scratch(pages.sparkSession)
    path = f"{scratch.root}/archives"
    scratch.paths["archives"] = path
    write_archives(pages, path, segment, chunk, least)
    found = scratch.keep(read_pages(read_records(pages.sparkSession, path), scratch), "found")
    scratch.close("found")
    return found


ORACLE_SQL = f"""with p as (select page_id, coalesce(html, '') h, row_number() over () rid from pages),
d as (select page_id, h, rid, strlen(h)::bigint n, sha256(h) s, row_number() over (partition by h order by page_id nulls last, rid) k, first(page_id) over (partition by h order by page_id nulls last, rid) f from p)
select page_id, n payload_bytes, s payload_digest, case when n >= {LEAST} and k > 1 then 'revisit' else 'response' end record_type, case when n >= {LEAST} and k > 1 then f end refers_to, 'ok' status from d"""
