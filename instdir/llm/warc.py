"""WARC archives: writing, reading, and assembling transactions.

A page becomes three records: its request, its response (or a revisit of an earlier capture with the same payload) and
metadata; request and metadata name the capture in WARC-Concurrent-To. Each record is a gzip member of its own. A task
joins members into archives of bounded size, and Spark's text writer puts one to a file, closed by an empty member, so
archives go to any file system that Spark writes to. They are read as binary files and inflated as a stream, one record at
a time. Assembly brings a capture's records together by their concurrent-to identifiers and gives one nested row per capture.

Which capture of a payload comes first is known from (digest, smallest id) of repeated digests alone, so the pages
themselves are shuffled only if that table is too large to broadcast; a frequent digest is then dealt out.

Defined cases: null html is an empty payload; very long html is one record, which alone may pass an archive's bound; line
ends in a url are percent-encoded; a record is named by page_id, payload and url, so repeated rows write equal records of
one name and give as many rows of the assembly; a capture without page_id revisits the smallest page_id with that payload,
if there is one; null urls give records without a target; records without a capture (their response isn't in the archives)
are left out of the assembly; a record without a length, or cut short, is an error that says so; no pages give no archive
and an empty assembly; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lookup, map_arrow, prepare

#: The digits of base 32 as Spark's conv() writes them, and as RFC 4648 does.
_CONV, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
#: Bytes of gzip members after which an archive ends.
ARCHIVE_BYTES = 8 << 20
_LEVEL = 5
RECORD = "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, headers map<string,string>, payload binary, payload_bytes long, payload_digest string"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: five hex digits are four of base 32."""
    five = [F.lpad(F.conv(F.substring(F.sha1(data), i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*five), _CONV, _BASE32)


def _lines(*pairs: tuple[str, Column | str]) -> Column:
    """Header lines, without those whose value is null, and the empty line after them."""
    told = [F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n")) for name, value in pairs]
    return F.concat(F.concat_ws("", *told), F.lit("\r\n"))


def _record(kind: str, pairs: list, block: Column) -> Column:
    head = [("WARC-Type", kind), *pairs, ("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat(F.lit("WARC/1.1\r\n"), _lines(*head), block)


def _one_line(url: Column) -> Column:
    """A url that stays within its header line."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _name(page_id: Column, digest: Column, url: Column) -> Column:
    """What a page's records are named by: its id and a hash of the rest."""
    rest = F.concat_ws(" ", digest, url)
    return F.coalesce(F.concat(page_id.cast("string"), F.lit("-"), F.hex(F.xxhash64(rest))), F.concat(F.lit("none-"), F.sha1(rest)))


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, name, and first (the name of the smallest page_id's capture with that payload, where it is another's)."""
    got = pages.select(F.col("page_id").cast("long").alias("page_id"), _one_line(F.col("url").cast("string")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    got = got.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")
    repeated = got.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1 and first.page_id is not null")
    scratch = Scratch(pages.sparkSession, "captures")
    repeated = scratch.save(repeated.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), "n"), "repeated")
    weight = 64 + F.coalesce(F.octet_length("first_url"), F.lit(0))
    out = lookup(got, repeated.drop("n"), "digest", scratch, "heavy", by=["page_id", "url"], how="left", weight=weight, counts=repeated, sift=True)
    out = out.withColumn("name", _name(F.col("page_id"), F.col("digest"), F.col("url")))
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return out.withColumn("first", F.when(revisit, _name(F.col("first_id"), F.col("digest"), F.col("first_url")))).drop("first_id", "first_url")


def records_of(pages: DataFrame) -> DataFrame:
    """request, main (response or revisit) and metadata of each page, as the records' texts."""

    def uid(kind: str, name: str) -> Column:
        return F.concat(F.lit(f"<urn:capture:{kind}:"), F.col(name), F.lit(">"))

    date, target = ("WARC-Date", _DATE), ("WARC-Target-URI", F.col("url"))
    http = _lines(("HTTP/1.1 200 OK\r\nContent-Type", "text/html; charset=utf-8"), ("Content-Length", F.octet_length("payload").cast("string")))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    body = ("Content-Type", "application/http; msgtype=response")
    response = _record("response", [("WARC-Record-ID", uid("page", "name")), date, target, digest, body], F.concat(http, F.col("payload")))
    revisit = _record("revisit", [("WARC-Record-ID", uid("page", "name")), date, target, digest, ("WARC-Refers-To", uid("page", "first")), ("WARC-Profile", _PROFILE), body], http)
    asked = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n"))
    request = _record("request", [("WARC-Record-ID", uid("request", "name")), date, target, ("WARC-Concurrent-To", uid("page", "name")), ("Content-Type", "application/http; msgtype=request")], asked)
    fields = _lines(("page_id", F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))
    metadata = _record("metadata", [("WARC-Record-ID", uid("metadata", "name")), date, target, ("WARC-Concurrent-To", uid("page", "name")), ("Content-Type", "application/warc-fields")], fields)
    return captures(pages).select(request.alias("request"), F.when(F.col("first").isNull(), response).otherwise(revisit).alias("main"), metadata.alias("metadata"))


def _member(record: bytes) -> bytes:
    """A record with the line ends that close it, as a gzip member."""
    gzip = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return gzip.compress(record) + gzip.compress(b"\r\n\r\n") + gzip.flush()


def write_warc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write request, response or revisit, and metadata of every page as archives under path."""
    prepare(pages.sparkSession)

    def archives(batches):
        parts, size = [], 0
        for batch in batches:
            for record in zip(*batch.columns, strict=True):
                for text in record:
                    parts.append(_member(text.as_buffer()))
                    size += len(parts[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])

    out = records_of(pages).mapInArrow(archives, "archive binary").select(F.col("archive").cast("string").alias("value"))
    # the writer's line end, by bytes, is an empty member: an archive's last
    end = zlib.compressobj(1, zlib.DEFLATED, 31).flush().decode("latin-1")
    out.write.mode("overwrite").option("lineSep", end).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def _inflated(data: memoryview, step: int = 1 << 14):
    """The bytes of gzip members one after another, in portions; other bytes as they are."""
    at = 0
    if bytes(data[:2]) != b"\x1f\x8b":
        step = 1 << 20
        yield from (bytes(data[i : i + step]) for i in range(0, len(data), step))
        return
    while at < len(data) and bytes(data[at : at + 2]) == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                raise ValueError("WARC: a gzip member is cut short")
            portion = data[at : at + step]
            out = member.decompress(portion)
            at += len(portion) - len(member.unused_data)
            if out:
                yield out


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines.split(b"\r\n"))
    return {name.decode().strip().lower(): value.decode("utf-8", "replace").strip() for name, colon, value in pairs if colon}


def _length(head: dict[str, str], name: str) -> int:
    """A header that has to be a whole number."""
    value = head.get("content-length", "")
    if not value.isdecimal():
        raise ValueError(f"WARC: {name} {head.get('warc-record-id', '')} has no Content-Length that is a number")
    return int(value)


def parse_archive(data: bytes):
    """The records of one archive: WARC headers, HTTP headers (none for other blocks) and the block's payload.

    One record at a time is held, whatever the archive's size.
    """
    held, head, begin, size = bytearray(), None, 0, 0
    for portion in _inflated(memoryview(data)):
        held += portion
        while True:
            if head is None:
                at = held.find(b"WARC/")
                begin = held.find(b"\r\n\r\n", at) + 4 if at >= 0 else 3
                if begin == 3:
                    break
                head = _headers(bytes(held[at:begin]))
                size = _length(head, f"a record of type {head.get('warc-type')}")
            if len(held) < begin + size:
                break
            block, http = bytes(held[begin : begin + size]), {}
            del held[: begin + size]
            if head.get("content-type", "").startswith("application/http"):
                first, _, block = block.partition(b"\r\n\r\n")
                http = _headers(first.partition(b"\r\n")[2])
            yield head, http, block
            head = None
    if held.strip():
        raise ValueError("WARC: the last record is cut short")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives under path; without ``payloads`` that column is null, lengths and digests are there.

    A revisit has no payload; its length is that of its HTTP header, its digest the noted one.
    """

    def fn(batch):
        for content in batch.column("content"):
            rows, held = [], 0
            for head, http, block in parse_archive(content.as_buffer()):
                kind = head["warc-type"]
                revisit = kind == "revisit"
                noted = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                made = None if revisit else base64.b32encode(hashlib.sha1(block).digest()).decode()
                size = _length(http, "the HTTP header of a revisit") if revisit else len(block)
                rows.append((kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), list(http.items()), block if payloads and not revisit else None, size, noted if revisit else made))
                held += len(block) if payloads else 0
                if len(rows) >= 2000 or held > 1 << 20:
                    yield _table(rows)
                    rows, held = [], 0
            yield _table(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return map_arrow(files, fn, RECORD)


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string()] * 5 + [pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string()]
    names = [x.split(" ", 1)[0] for x in RECORD.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture (its record), requests and metadata (the different records that name it as concurrent).

    Only the fields that are asked for travel. Equal captures of one name give a row each.
    """
    own = F.col("warc_type").isin("response", "revisit")
    fields = ["warc_type", "record_id", "refers_to", "target_uri", "headers", "payload", "payload_bytes", "payload_digest"]

    def of(kind: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("warc_type") == kind, F.struct("record_id", "target_uri", "payload")))).alias(kind)

    name = F.when(own, F.col("record_id")).when(F.col("warc_type").isin("request", "metadata"), F.col("concurrent_to"))
    named = records.withColumn("__capture", name).filter("__capture is not null")
    found = named.groupBy("__capture").agg(F.count_if(own).alias("__n"), *[F.first(F.when(own, F.col(f)), ignorenulls=True).alias(f) for f in fields], of("request"), of("metadata"))
    each = found.filter("__n > 0").withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    return each.select(F.col("__capture").alias("record_id"), F.struct(*fields).alias("capture"), F.col("request").alias("requests"), "metadata")


def page_of(record_id: Column) -> Column:
    """The page_id in a record's identifier; null for pages without one."""
    return F.try_to_number(F.regexp_extract(record_id, r":(-?\d+)-[0-9A-F]+>$", 1), F.lit("S9999999999999999999")).cast("long")
