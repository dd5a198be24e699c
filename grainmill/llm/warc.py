"""WARC: writing captures as archives, reading archives, and assembling transactions.

Writing: each row becomes a request, a response (or a revisit of an earlier equal payload) and a metadata record that
name each other through WARC-Concurrent-To. The records are SQL expressions and leave by Spark's text writer, whose
line separator is the end of a record, so archives are committed as any table is, to any file system.

Reading: archives are inflated as they are read, member by member, and framed by Content-Length; a broken header skips
to the next record. Assembly: records that are no captures find theirs through all their concurrent-to identifiers
(also through one another, over chains of any length, and where the capture names them), then one nested row is made
for each capture; a record that leads to several captures stands in each of their rows.

Defined results: null payloads are empty ones; control characters and spaces in URLs are percent-encoded, a null URL is
left out; rows that repeat id and payload are captures of their own, only the first of them is referred to; records
whose identifiers lead to no capture form rows with a null capture, by the least identifier they name, else their own,
else each its own; records without a type are no captures, and stand among `others`. No archive and an archive without
records give no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

END = "\r\n\r\n"
CAPTURES = ("response", "revisit", "resource", "conversion")
RECORD = "record_id string, record_type string, concurrent_to array<string>, refers_to string, target_uri string, date string, profile string, header_digest string, status int, payload_bytes long, payload_sha256 string, fields map<string,string>, archive string, position long, payload binary"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: str | Column, record_id: Column, concurrent: Column | None, date: str, url: Column, media: str, block: Column, *more: Column) -> Column:
    """more: further header lines, each null or with its line end."""
    lines = [F.lit("WARC/1.1\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit("\r\nWARC-Record-ID: "), record_id, F.lit(f"\r\nWARC-Date: {date}\r\n")]
    if concurrent is not None:
        lines += [F.lit("WARC-Concurrent-To: "), concurrent, F.lit("\r\n")]
    lines += [F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")), *[F.coalesce(m, F.lit("")) for m in more]]
    lines += [F.lit(f"Content-Type: {media}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block]
    return F.concat(*lines)


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip", records_per_file: int = 20_000) -> None:
    """Archives of all rows at `path`. Of rows with equal payloads of at least `least` bytes, that with the smallest id is the response, the others revisit it."""
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("sha", F.sha2(F.col("body").cast("binary"), 256))
    # by id and payload, not by payload: one that a third of all rows share does not meet in one task
    rows = rows.withColumn("key", F.concat_ws("|", "id", "sha"))
    same = rows.where(F.octet_length("body") >= least).select("id", "sha").groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = rows.select("key", "sha").join(same, "sha").groupBy(F.col("key").alias("key2")).agg(F.first("first").alias("first"))
    # repeated rows are numbered once the join has brought them together: bodies are shuffled once
    rows = rows.join(stage(again), F.col("key") == F.col("key2"), "left").withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    escaped = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    capture = lambda i, n: _uuid(F.lit("capture"), i, F.col("sha"), n)
    own = capture(F.col("id"), F.col("nth"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("sha"), F.lit("\r\n"))
    host, target = F.regexp_extract(escaped, "^[a-zA-Z][^:]*://([^/?#]*)", 1), F.regexp_extract(escaped, "^[a-zA-Z][^:]*://[^/?#]*([^#]*)", 1)
    request = F.concat(F.lit("GET "), F.when(F.coalesce(target, F.lit("")) == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(END))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit(END), F.when(revisit, "").otherwise(F.col("body")))
    refers = F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), capture(F.col("first"), F.lit(1)), F.lit("\r\n")))
    fields = F.concat(F.lit("page_id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n"))
    records = [
        _record("request", _uuid(F.lit("request"), F.col("id"), F.col("sha"), F.col("nth")), own, date, escaped, "application/http; msgtype=request", request),
        _record(F.when(revisit, "revisit").otherwise("response"), own, None, date, escaped, "application/http; msgtype=response", answer, digest, refers),
        _record("metadata", _uuid(F.lit("metadata"), F.col("id"), F.col("sha"), F.col("nth")), own, date, escaped, "application/warc-fields", fields),
    ]
    rows.select(F.concat_ws(END, *records).alias("value")).write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


def inflated(data: bytes, step: int = 1 << 20):
    """The content in pieces: of all gzip members, a cut last one as far as it goes; data that is not compressed as it is."""
    view, at = memoryview(data), 0
    if data[:2] != GZIP:
        yield data
        return
    while data[at : at + 2] == GZIP:
        one = zlib.decompressobj(31)
        while at < len(data) and not one.eof:
            try:
                piece = one.decompress(view[at : at + step])
            except zlib.error:
                return
            at += len(view[at : at + step]) - len(one.unused_data)
            if piece:
                yield piece


GZIP = b"\x1f\x8b"
_STATUS = re.compile(rb"HTTP/\S+ (\d{3})")
_PLAIN = ("warc-refers-to", "warc-target-uri", "warc-date", "warc-profile", "warc-payload-digest")
_HEADER = re.compile(rb"\s*WARC/\d+\.\d+\r?\n(.*?)\r?\n\r?\n", re.S)


def _named(block: bytes) -> list[tuple[str, str]]:
    """Header lines as (lower-case name, value); folded lines are joined."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", block).decode("utf-8", "replace").splitlines()
    return [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines if ":" in x)]


_NEXT = re.compile(rb"\nWARC/\d")


def parse(pieces, most_header: int = 1 << 20):
    """(position, header lines, block) of each record in this content, given in pieces; holds little more than a record."""
    data, at, gone, pieces = b"", 0, 0, iter(pieces)

    def more(n: int) -> bool:
        """Whether n bytes follow the place, once as many pieces are read."""
        nonlocal data, at, gone
        if len(data) - at < n:
            parts, size = [data[at:]], len(data) - at
            while size < n and (piece := next(pieces, None)) is not None:
                parts.append(piece)
                size += len(piece)
            gone, at, data = gone + at, 0, b"".join(parts)
        return len(data) - at >= n

    def header():
        for n in (1 << 12, most_header):
            whole = more(n)
            if (m := _HEADER.match(data, at)) or not whole:
                return m
        return None

    m = header()
    while True:
        if m:
            named = _named(m[1])
            size = next((v for k, v in named if k == "content-length"), "")
            length, start = m.end() - at, gone + at
            if size.isdigit() and more(length + int(size)):
                yield start, named, data[at + length : at + length + int(size)]
                at += length + int(size)
            else:
                at += length
            if m := header():
                continue
        while not (found := _NEXT.search(data, at)):  # broken: on to what looks like the next record
            at = max(at, len(data) - 8)
            if not more(len(data) - at + 1):
                return
        at = found.start() + 1
        m = header()


def records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row for each record of the archives; payload: whether its bytes are returned besides their number and digest."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 5, pa.int32(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.binary()]

    def given(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size = [], 0
                for position, named, block in parse(inflated(content.as_py())):
                    one = dict(reversed(named))
                    body, status, media = block, None, one.get("content-type", "")
                    if "application/http" in media:
                        head, _, body = block.partition(b"\r\n\r\n")
                        m = _STATUS.match(head)
                        status = int(m[1]) if m else None
                    fields = list(dict(_named(body)).items()) if media.startswith("application/warc-fields") else []
                    held.append((one.get("warc-record-id"), one.get("warc-type"), [v for k, v in named if k == "warc-concurrent-to"], *(one.get(k) for k in _PLAIN), status, len(body), hashlib.sha256(body).hexdigest(), fields, name, position, body if payload else None))
                    size += len(body)
                    if size > 4 << 20 or len(held) >= 4096:
                        yield given(held)
                        held, size = [], 0
                if held:
                    yield given(held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)


def reached(found: DataFrame) -> DataFrame:
    """rid, capture: every capture that each other record leads to. found: rid, record_type, concurrent_to."""
    own = is_capture()
    ids = found.select("rid", F.explode("concurrent_to").alias("to"), own.alias("own"))
    captures = found.where(own).select(F.col("rid").alias("c"), F.lit(True).alias("there")).distinct()
    links = ids.where("not own").select("rid", "to").unionByName(ids.where("own").select(F.col("to").alias("rid"), F.col("rid").alias("to"))).distinct()
    links = stage(links.join(captures, F.col("to") == F.col("c"), "left").select("rid", "to", F.col("there").isNotNull().alias("there")))
    known, inner = links.where("there").select("rid", F.col("to").alias("capture")), links.where("not there").select("rid", "to")
    new = known
    while not inner.isEmpty():  # a link further each time, until nothing new is found
        ahead = inner.join(new.select(F.col("rid").alias("via"), "capture"), F.col("to") == F.col("via")).select("rid", "capture").distinct()
        new = stage(ahead.join(known, ["rid", "capture"], "left_anti"))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


def is_capture() -> Column:
    return F.coalesce(F.col("record_type").isin(*CAPTURES), F.lit(False))


def assemble(found: DataFrame) -> DataFrame:
    """capture_id, capture, requests, metadata, others: a nested row for each capture; metadata holds the fields of the first metadata record. found is read more than once."""
    names = [c for c in found.columns if c != "record_id"]
    brief = F.struct("record_id", *[n for n in names if n != "fields"])
    kind = F.coalesce("record_type", F.lit(""))
    found = found.withColumn("rid", F.coalesce("record_id", F.concat_ws("|", "archive", "position")))
    to = reached(found).withColumnRenamed("rid", "from")
    rest = found.where(~is_capture()).join(to, F.col("rid") == F.col("from"), "left")
    rest = rest.withColumn("key", F.coalesce("capture", F.array_min("concurrent_to"), "rid")).withColumn("lost", F.col("capture").isNull())
    some = lambda when: F.sort_array(F.collect_list(F.when(when, brief)))
    order = F.struct("rid", "archive", "position")
    with_each = rest.groupBy("key", "lost").agg(some(kind == "request").alias("requests"), F.min_by("fields", F.when(kind == "metadata", order)).alias("metadata"), some(kind != "request").alias("others"))
    own = found.where(is_capture()).select("rid", F.col("record_id").alias("capture_id"), F.struct("record_id", *names).alias("capture"))
    nothing = F.array().cast(with_each.schema["others"].dataType)
    out = own.join(with_each.where("not lost"), F.col("rid") == F.col("key"), "left").select("capture_id", "capture", F.coalesce("requests", nothing).alias("requests"), "metadata", F.coalesce("others", nothing).alias("others"))
    lost = with_each.where("lost").select(F.col("key").alias("capture_id"), F.lit(None).cast(own.schema["capture"].dataType).alias("capture"), "requests", "metadata", "others")
    return out.unionByName(lost)


def captures(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The archives' nested captures; a revisit's payload_bytes and payload_sha256 are those of the response it refers to."""
    rows = stage(assemble(stage(records(spark, path, payload))))
    known = rows.where(F.col("capture.record_type") == "response").select(F.col("capture_id").alias("r_id"), F.struct("capture.payload_bytes", "capture.payload_sha256", "metadata").alias("original"))
    return rows.join(known, F.col("capture.refers_to") == F.col("r_id"), "left").drop("r_id")
