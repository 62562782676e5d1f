"""Web archives: captures written as WARC records, read back, and assembled into transactions.

Archives are files of Spark's text writer: a record ends with two line breaks, which is the
writer's line separator, so writing is committed per task and needs no file access of its own.
They are gzip files, which Spark reads one after the other in a single task each, record by
record; records of any length and payloads that hold text like a record's start come back whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carecohort.operators.skew import join_lookup
from carecohort.storage import written

#: Fixed values of the format.
RECORD_END = "\r\n\r\n"
VERSION = "WARC/1.1"
VERSION_START = "WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads under so many bytes are always stored again.
MIN_REVISIT_BYTES = 100

_RECORDS = (
    "record_id string, type string, date string, target_uri string, concurrent_to array<string>, "
    "refers_to string, content_type string, digest_field string, http string, payload binary"
)


def _one_line(value: Column) -> Column:
    """A header value without line breaks, which would end the header."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _field(name: str, value: Column | str) -> Column:
    """A header line; null, and so left out, if the value is null."""
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value)


def _record(kind: str, record_id: Column, fields: list[Column], content_type: str, block: Column) -> Column:
    lines = [
        F.lit(VERSION), _field("WARC-Type", kind), _field("WARC-Record-ID", record_id), *fields,
        _field("Content-Type", content_type), _field("Content-Length", F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(RECORD_END), block)


def _record_id(*parts: Column) -> Column:
    return F.concat(
        F.lit("<urn:uuid:"),
        F.regexp_replace(F.md5(F.concat_ws("|", *parts)), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"),
        F.lit(">"),
    )


def write_archives(captures: DataFrame, folder: str, id_col: str, uri_col: str, payload_col: str,
                   min_revisit_bytes: int = MIN_REVISIT_BYTES, captured_at: Column | None = None) -> None:
    """Write a request, a response or revisit, and a metadata record per row to gzip files in ``folder``.

    Of the rows with one payload of at least ``min_revisit_bytes`` bytes, that with the smallest
    id (nulls last; among repeated rows one of them) is the response and the others revisit it.
    A null payload is empty.  The metadata record holds the id, unless it is null.  A row without a URI has no
    request.  Line breaks in a URI or id are written as %0D and %0A.  Payloads are strings or
    binary and are stored byte by byte.  Other columns are not read.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = captures.select(
        F.monotonically_increasing_id().alias("place"), F.col(id_col).alias("id"),
        _one_line(F.col(uri_col).cast("string")).alias("uri"), payload.alias("payload"),
        F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("bigint").alias("bytes"),
    )
    rows = written(rows, "captures", compression="zstd")  # gives every row a place that stays
    large = rows.where(F.col("bytes") >= min_revisit_bytes)
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("place")))["place"]
    shared = (
        large.groupBy("digest").agg(first.alias("first_place"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1).drop("n")
    )
    rows = join_lookup(rows, shared, ["digest"], "left")

    run = F.lit(uuid.uuid4().hex)
    identity = lambda kind, place: _record_id(run, F.lit(kind), place.cast("string"))
    place, uri, digest = F.col("place"), F.col("uri"), F.col("digest")
    at = F.date_format(captured_at if captured_at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    common = [_field("WARC-Date", at), _field("WARC-Target-URI", uri)]
    main, beside = identity("response", place), _field("WARC-Concurrent-To", identity("response", place))
    sha = _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"), F.lit(RECORD_END),
    )
    response = _record("response", main, [*common, sha], "application/http; msgtype=response", F.concat(http, "payload"))
    back = [
        _field("WARC-Profile", REVISIT_PROFILE), _field("WARC-Refers-To", identity("response", F.col("first_place"))),
    ]
    revisit = _record("revisit", main, [*common, sha, *back], "application/http; msgtype=response", http)
    host = F.regexp_extract(uri, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(uri, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    request = F.when(uri.isNotNull(), _record(
        "request", identity("request", place), [*common, beside], "application/http; msgtype=request",
        F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(RECORD_END)),
    ))
    described = F.coalesce(F.concat(F.lit(f"{id_col}: "), _one_line(F.col("id").cast("string")), F.lit("\r\n")), F.lit(""))
    metadata = _record("metadata", identity("metadata", place), [*common, beside], "application/warc-fields", described)
    again = F.col("first_place").isNotNull() & (F.col("first_place") != place)
    records = F.array_compact(F.array(request, F.when(again, revisit).otherwise(response), metadata))
    (
        rows.select(F.explode(records).alias("value"))
        .write.mode("errorifexists").option("lineSep", RECORD_END).option("compression", "gzip").text(folder)
    )


def _parse(head: bytes, block: bytes) -> tuple:
    fields: dict[str, list[str]] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), []).append(value.strip())
    one = lambda name: fields.get(name, [None])[0]
    http, content_type = None, one("content-type")
    if (content_type or "").lower().startswith("application/http"):
        start, end, rest = block.partition(b"\r\n\r\n")
        if end:
            http, block = start.decode("utf-8", "replace"), rest
    return (
        one("warc-record-id"), one("warc-type"), one("warc-date"), one("warc-target-uri"),
        fields.get("warc-concurrent-to", []), one("warc-refers-to"), content_type, one("warc-payload-digest"), http, block,
    )


class _Stream:
    """Records of one file, from its pieces in order."""

    def __init__(self, name: str):
        self.name, self.data, self.needed, self.pieces = name, bytearray(), 0, 0

    def add(self, piece: bytes, at_start: bool) -> Iterator[tuple]:
        joint = b"" if at_start and not self.pieces else VERSION_START.encode()
        if self.data:
            joint = RECORD_END.encode() + joint
        self.pieces += 1
        self.data += joint + piece
        while len(self.data) >= self.needed and self.data:
            if not self.data.startswith(VERSION_START.encode()):
                raise ValueError(f"{self.name}: no record where one should start")
            head, found, _ = bytes(self.data[:65536]).partition(b"\r\n\r\n")
            if not found:
                head, found, _ = bytes(self.data).partition(b"\r\n\r\n")
            length = next((x for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:")), None)
            if not found or length is None:
                raise ValueError(f"{self.name}: a record without a length")
            end = len(head) + 4 + int(length.split(b":")[1])
            if len(self.data) < end:
                self.needed = end
                return
            yield _parse(head, bytes(self.data[len(head) + 4 : end]))
            # what is left is the record's end or, if a reader joined two records, the next one
            self.data, self.needed = bytearray(bytes(self.data[end:]).lstrip(b"\r\n")), 0

    def close(self) -> None:
        if self.data:
            raise ValueError(f"{self.name} ends within a record")


def read_records(spark: SparkSession, path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """All records of WARC 1.x archives under ``path``, one row each, in any order.

    ``payload`` is the block, without the HTTP head (``http``) if there is one.  Gzip files of any
    size are read as streams; uncompressed ones are split by Spark, and there a payload that holds a
    record's start across a split raises an error, as does an archive that ends within a record.
    """
    names = [f.split()[0] for f in _RECORDS.split(", ")]
    types = [pa.string()] * 4 + [pa.list_(pa.string())] + [pa.string()] * 4 + [pa.binary()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, held, size = None, [], 0
        batch_of = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names
        )
        for batch in batches:
            for value, file, start in zip(*batch.columns, strict=True):
                name = (file.as_py(), start.as_py())
                if stream is None or stream.name != name:
                    if stream:
                        stream.close()
                    stream = _Stream(name)
                for record in stream.add(value.as_py(), name[1] == 0):
                    held.append(record)
                    size += len(record[-1]) + 500
                    if size > batch_bytes:
                        yield batch_of(held)
                        held, size = [], 0
        if stream:
            stream.close()
        if held:
            yield batch_of(held)

    pieces = spark.read.option("lineSep", RECORD_END + VERSION_START).text(path).select(
        F.col("value").cast("binary"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    )
    return pieces.mapInArrow(parse, _RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, target_uri, request, response, metadata.

    A request or metadata record belongs to the responses (or revisits, or resources) that it names as
    concurrent, or that name it.  ``response`` has the payload with its length and SHA-256; of several
    requests the earliest stays in ``request`` and the others follow in ``more_requests``; ``metadata`` is ordered
    by date and id.  Requests and metadata of responses that are not there give rows without a
    response, one per record id that they name, or one each if they name none.  A response record that is
    there twice gives two captures.  Records of other types are left out.
    """
    records = written(records, "records", compression="zstd")
    kind = F.col("type")
    responses = records.where(kind.isin("response", "revisit", "resource"))
    beside = records.where(kind.isin("request", "metadata")).select(
        "record_id", "concurrent_to", "target_uri",
        F.struct("date", "record_id", "type", "target_uri", "http", F.col("payload").cast("string").alias("text")).alias("part"),
    )
    named = responses.where(F.size("concurrent_to") > 0).select(
        F.explode(F.array_distinct("concurrent_to")).alias("record_id"), F.col("record_id").alias("capture_id")
    )
    forward = beside.where(F.size("concurrent_to") > 0).select(
        F.explode(F.array_distinct("concurrent_to")).alias("capture_id"), "part", "target_uri"
    )
    # both sides of a link may name the other: it counts once
    links = forward.union(
        beside.join(named.distinct(), "record_id").select("capture_id", "part", "target_uri")
    )
    alone = beside.where(F.size("concurrent_to") == 0).join(named.select("record_id").distinct(), "record_id", "left_anti")
    of = lambda t: F.array_sort(F.collect_set(F.when(F.col("part")["type"] == t, F.col("part"))))
    nested = lambda rows, *keys: rows.groupBy(*keys).agg(
        of("request").alias("requests"), of("metadata").alias("metadata"), F.min("target_uri").alias("uri")
    )
    parts = nested(links, "capture_id")
    main = responses.select(
        F.col("record_id").alias("capture_id"), "target_uri", "date", "type", "refers_to", "digest_field", "http", "payload",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
    )
    fields = ["type", "date", "refers_to", "digest_field", "http", "payload", "payload_bytes", "payload_digest"]
    whole = main.join(parts, "capture_id", "left").withColumn("target_uri", F.coalesce("target_uri", "uri"))
    whole = whole.withColumn("response", F.struct(*fields))
    lost = parts.join(responses.select(F.col("record_id").alias("capture_id")), "capture_id", "left_anti")
    single = nested(alone, "record_id").drop("record_id").withColumn("capture_id", F.lit(None).cast("string"))
    empty = F.lit(None).cast(whole.schema["response"].dataType)
    found = whole
    for rest in (lost, single):
        found = found.unionByName(rest.withColumn("target_uri", F.col("uri")).withColumn("response", empty), allowMissingColumns=True)
    none = F.array().cast(parts.schema["requests"].dataType)
    requests = F.coalesce("requests", none)
    return found.select(
        "capture_id", "target_uri", F.get(requests, F.lit(0)).alias("request"), "response",
        F.coalesce("metadata", none).alias("metadata"),
        F.slice(requests, F.lit(2), F.greatest(F.size(requests) - 1, F.lit(0))).alias("more_requests"),
    )


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Add ``original``: capture_id, metadata, payload_bytes and payload_digest of what a revisit refers to, else null.

    A capture that half of all revisits refer to is repeated per split of its revisits.
    """
    originals = captures.where(F.col("response")["type"] != "revisit").groupBy("capture_id").agg(
        F.min(F.struct("metadata", F.col("response")["payload_bytes"].alias("payload_bytes"),
                       F.col("response")["payload_digest"].alias("payload_digest"))).alias("original")
    ).withColumnRenamed("capture_id", "_refers_to")
    rows = captures.withColumn("_refers_to", F.when(F.col("response")["type"] == "revisit", F.col("response")["refers_to"]))
    return join_lookup(rows, originals, ["_refers_to"], "left").withColumn(
        "original", F.when(F.col("original").isNotNull(), F.struct(F.col("_refers_to").alias("capture_id"), "original.*"))
    ).drop("_refers_to")


def _stated(metadata: Column, name: str) -> Column:
    """Value of a field that the first metadata record holding it states."""
    lines = F.flatten(F.transform(metadata, lambda m: F.split(m["text"], "\r\n")))
    return F.substring_index(F.get(F.filter(lines, lambda x: x.startswith(f"{name}: ")), F.lit(0)), f"{name}: ", -1)


def archived_pages(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url",
                   payload_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives in ``folder``, read and assemble them: id, payload_bytes, payload_digest, record_type, refers_to.

    The length and digest of a revisit are those of the response that it refers to.  An empty
    table gives no rows.  Nulls, ties and repeated rows: see ``write_archives``.
    """
    write_archives(pages, folder, id_col, uri_col, payload_col)
    spark, id_type = pages.sparkSession, pages.schema[id_col].dataType
    captures = assemble(read_records(spark, folder)).withColumn(
        "response", F.col("response").dropFields("payload", "http")
    )
    resolved = resolve_revisits(written(captures.select("capture_id", "response", "metadata"), "assembled"))
    of = lambda name: F.coalesce(F.col("original")[name], F.col("response")[name]).alias(name)
    return resolved.select(
        _stated(F.col("metadata"), id_col).cast(id_type).alias(id_col), of("payload_bytes"), of("payload_digest"),
        F.col("response")["type"].alias("record_type"),
        _stated(F.col("original")["metadata"], id_col).cast(id_type).alias("refers_to"),
    )


SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), r AS (
  SELECT *, payload_bytes >= {MIN_REVISIT_BYTES} AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) > 1 AS again,
    first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id) AS first_id
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first_id END AS refers_to
FROM r
"""
