"""WARC archives: writing pages as segmented records, and reassembling segments on the way back.

Payloads travel in chunked transfer framing inside an HTTP response, and a record larger than a segment is
split: the first keeps its type and ``WARC-Segment-Number: 1``, the others are ``continuation`` records with
``WARC-Segment-Origin-ID``, and the last says the total length. A reader groups segments by their origin,
orders them by number, verifies the total and takes the framing off.

Records end in two CR LF, which Spark's text writer puts after each row; so archives are written and
committed by Spark on any file system it knows, gzipped by its codec.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.shared import apart, drop, materialize, scratch_path, ship

#: Bytes of a record's block in one segment, of a transfer chunk, of a row of records, and the most rows of a file: a file is below 84 MB.
SEGMENT, CHUNK, ROW, ROWS = 1 << 18, 1 << 14, 1 << 20, 64
#: What stands behind each record.
END = b"\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def framed(payload: bytes) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for k in range(0, len(payload), CHUNK):
        piece = payload[k : k + CHUNK]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframed(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        if len(parts[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def record_id(run: str, number: int, segment: int) -> str:
    """A name of its own for each record of any archive: from a random name of the run that writes it, row number and segment."""
    raw = hashlib.md5(f"{run}/{number}/{segment}".encode()).hexdigest()
    return f"<urn:uuid:{raw[:8]}-{raw[8:12]}-{raw[12:16]}-{raw[16:20]}-{raw[20:]}>"


def record_segments(number: int, page_id: int | None, url: str | None, payload: bytes, refers: tuple[int, int] | None, *, run: str = "", segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of a page, without the two line ends that close each."""
    digest = base32(hashlib.sha1(payload).digest())
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = http if refers else http + framed(payload)
    count = max(1, -(-len(block) // segment))
    for k in range(count):
        part = block[k * segment : (k + 1) * segment]
        head = [("WARC-Type", "revisit" if refers else "response")] if k == 0 else [("WARC-Type", "continuation"), ("WARC-Segment-Origin-ID", record_id(run, number, 1))]
        head += [("WARC-Record-ID", record_id(run, number, k + 1)), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(part))]
        if k == 0:
            head += [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", "" if page_id is None else page_id)]
            if refers:
                head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(run, refers[0], 1)), ("X-Refers-To-Page-ID", "" if refers[1] is None else refers[1])]
        if count > 1:
            head.append(("WARC-Segment-Number", k + 1))
            if k == count - 1:
                head.append(("WARC-Segment-Total-Length", len(block)))
        yield b"WARC/1.1\r\n" + "".join(f"{a}: {b}\r\n" for a, b in head).encode() + b"\r\n" + part


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive file, gzipped (in one or many members) or plain."""
    data = _inflated(content) if content[:2] == b"\x1f\x8b" else content
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = {}
        for line in data[at:end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        start, size = end + 4, int(fields["content-length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, data[start : start + size]
        at = start + size + 4


def _inflated(content: bytes) -> bytes:
    parts = []
    while content:
        member = zlib.decompressobj(31)
        parts += [member.decompress(content), member.flush()]
        content = member.unused_data
    return b"".join(parts)


def write_archives(pages: DataFrame, path: str, *, least_bytes: int = 0) -> None:
    """Write pages (page_id, url, html) as WARC under path.

    Of pages with equal payloads of least_bytes or more the one with the largest page_id (null last; of equal
    ones any) is a response and the others revisit it.
    """
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("number", F.monotonically_increasing_id())
    # Stored, so that both uses below see one number for a row, whatever the order in which pages come.
    keyed = materialize(rows.withColumn("digest", F.sha1("payload")), "numbered")
    large = keyed.select("page_id", "number", "digest", F.octet_length("payload").alias("size")).where(F.col("size") >= least_bytes)
    last = large.groupBy("digest").agg(F.max(F.struct("page_id", "number")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "kept")
    run = uuid.uuid4().hex
    marked = keyed.join(apart(last), "digest", "left").withColumn("refers", F.when(F.col("kept.number") != F.col("number"), F.col("kept")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, size = [], 0
        for batch in batches:
            for number, page, url, payload, refers in zip(*(batch.column(c) for c in ("number", "page_id", "url", "payload", "refers")), strict=True):
                to = refers.as_py()
                for record in record_segments(number.as_py(), page.as_py(), url.as_py(), payload.as_py(), (to["number"], to["page_id"]) if to else None, run=run):
                    held.append(record)
                    size += len(record)
                    if size >= ROW:
                        yield (END.join(held),)
                        held, size = [], 0
        if held:
            yield (END.join(held),)

    def write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(write(batches), {"value": pa.binary()})

    out = marked.select("number", "page_id", "url", "payload", "refers").mapInArrow(write_batches, "value binary").select(F.col("value").cast("string"))
    out.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", ROWS).text(path)
    drop(keyed)


FIELDS = {"origin": pa.string(), "type": pa.string(), "page_id": pa.int64(), "url": pa.string(), "digest": pa.string(), "refers_to": pa.string(), "refers_page": pa.int64()}
SCHEMA = "origin string, type string, page_id long, url string, digest string, refers_to string, refers_page long"


def _fields(f: dict[str, str]) -> tuple:
    number = lambda x: int(x) if x else None
    return (f.get("warc-segment-origin-id", f["warc-record-id"]), f["warc-type"], number(f.get("x-page-id")), f.get("warc-target-uri"), f.get("warc-payload-digest"), f.get("warc-refers-to"), number(f.get("x-refers-to-page-id")))


def payload_of(kind: str, digest: str | None, block: bytes) -> bytes | None:
    """A response's payload, without transfer framing and checked; None for other records."""
    if kind != "response":
        return None
    head, _, body = block.partition(b"\r\n\r\n")
    payload = unframed(body) if b"transfer-encoding: chunked" in head.lower() else body
    if f"sha1:{base32(hashlib.sha1(payload).digest())}" != digest:
        raise ValueError("a payload does not have its digest")
    return payload


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")


def _batches(rows: Iterator[tuple], kinds: dict[str, pa.DataType], most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Rows, whose last value is bytes, in batches of about `most` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"") + 200
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))


PARSED = f"{SCHEMA}, segment int, total long, size long, data binary"


def parsed(spark: SparkSession, path: str, *, keep: bool = True) -> DataFrame:
    """Every record under path, from one reading: (…, segment, total, size, data).

    Of a segment of a larger record data is its block; of a record in one piece it is the payload, checked, whose size is
    told without `keep` as well.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for content in batch.column("content"):
                    for f, block in records(content.as_buffer().to_pybytes()):
                        fields = _fields(f)
                        if "warc-segment-number" in f:
                            total = f.get("warc-segment-total-length")
                            yield *fields, int(f["warc-segment-number"]), int(total) if total else None, None, block
                        else:
                            payload = payload_of(fields[1], fields[4], block)
                            yield *fields, None, None, None if payload is None else len(payload), payload if keep else None

        yield from _batches(rows(), FIELDS | {"segment": pa.int32(), "total": pa.int64(), "size": pa.int64(), "data": pa.binary()})

    return _files(spark, path).mapInArrow(read, PARSED)


def segments(found: DataFrame) -> DataFrame:
    """(…, segment, total, block) of those parsed records that are segments of a larger one."""
    return found.where("segment IS NOT NULL").select(*FIELDS, "segment", "total", F.col("data").alias("block"))


def reassembled(parts: DataFrame) -> DataFrame:
    """(…, payload) of segments, joined by origin in the order of their numbers.

    Numbers must run from 1 without gaps and lengths add up to the total; else the job fails.
    """
    first = [F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in list(FIELDS)[1:]]
    # A record's segments are no more than its payload, which has to be in one row anyway.
    joined = parts.groupBy("origin").agg(*first, F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for *fields, total, pieces in zip(*(batch.column(c) for c in (*FIELDS, "total", "parts")), strict=True):
                    listed = pieces.as_py()
                    block = b"".join(p["block"] for p in listed)
                    if [p["segment"] for p in listed] != list(range(1, len(listed) + 1)) or total.as_py() != len(block):
                        raise ValueError("a segment is missing or stands twice")
                    found = [x.as_py() for x in fields]
                    yield *found, payload_of(found[1], found[4], block)

        yield from _batches(rows(), FIELDS | {"payload": pa.binary()})

    return joined.mapInArrow(join, f"{SCHEMA}, payload binary")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(origin, type, page_id, url, digest, refers_to, refers_page, payload) of every record under path. Records in one piece are not shuffled."""
    ship(spark)
    found = materialize(parsed(spark, path), "parsed")
    return found.where("segment IS NULL").select(*FIELDS, F.col("data").alias("payload")).unionByName(reassembled(segments(found)))


def round_trip(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and return page_id, payload_bytes, payload_digest, record_type, refers_to from them.

    A null html is an empty payload, a null url an empty target; a null page_id counts as the least. Repeated
    rows have records of their own, one of which is the response. Empty table: empty result. Other columns are
    not read.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, least_bytes=least_bytes)
    # Payloads in one piece are checked where they are read; only segments are stored for reassembly.
    read = materialize(parsed(spark, path, keep=False), "parsed")
    columns = ["origin", "type", "page_id", "digest", "refers_to", "refers_page"]
    joined = reassembled(segments(read)).select(*columns, F.octet_length("payload").cast("long").alias("size"))
    found = read.where("segment IS NULL").select(*columns, "size").unionByName(materialize(joined, "reassembled"))
    sizes = found.where("type = 'response'").select(F.col("origin").alias("of"), F.col("size").alias("of_size"))
    out = found.join(sizes, F.col("refers_to") == F.col("of"), "left")
    return out.select("page_id", F.coalesce("size", "of_size").alias("payload_bytes"), F.substring_index("digest", ":", -1).alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_page").alias("refers_to"))
