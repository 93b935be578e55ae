"""WARC archives: writing captures, and assembling transactions read back.

A capture is a request, a response (or revisit) and a metadata record that
name each other by WARC-Concurrent-To. Reading gives one row a record; the
assembly joins records to one nested row a capture.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weightscope.llm.common import join_salted, new_path, stored

CRLF = "\r\n"
#: Captures in one archive file at most: what a reader has in memory is one such file as stored.
CAPTURES = 10_000
#: Payloads of so many bytes at least are stored once.
SHARED_BYTES = 1000
#: The date of all records of the query: captures of a table have none.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_roles(pages: DataFrame, shared: int = SHARED_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with seq, digest, payload_bytes and refers_to.

    Of rows with equal payloads of ``shared`` bytes at least, those of the
    largest page_id are responses; refers_to of the others is that page_id.
    Only digests are grouped; of them, only those that repeat are joined back,
    and a payload that very many pages share is dealt out.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
        F.monotonically_increasing_id().alias("seq"),
    ).withColumns({"digest": F.sha1("html"), "payload_bytes": F.octet_length("html").cast("long")})
    groups = rows.where(F.col("payload_bytes") >= shared).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    repeated = stored(groups.where("n > 1 and last is not null"), "repeated")
    marked = join_salted(rows, repeated, "digest", "n", "seq")
    return marked.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))).drop("last")


def _urn(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"<urn:weightscope:{kind}"), *[F.concat(F.lit(":"), F.coalesce(p.cast("string"), F.lit(""))) for p in parts], F.lit(">"))


def _record(fields: list[tuple[str, Column | None]], block: Column) -> Column:
    """A record without the two line ends that follow it; null fields are left out."""
    lines = [F.lit("WARC/1.1" + CRLF)]
    for name, value in [*fields, ("Content-Length", F.octet_length(block).cast("string"))]:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*lines, F.lit(CRLF), block)


def write_archives(pages: DataFrame, path: str | None = None, shared: int = SHARED_BYTES, captures: int = CAPTURES) -> str:
    """Write a capture of three records for every row of ``pages``; returns the folder.

    Null html is an empty payload; a null url is left out; rows that repeat are
    captures of their own. All is made and written by the executors, through
    Spark's committer, as gzipped files of ``captures`` captures at most.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    rows = with_roles(pages, shared)
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    revisit = F.col("refers_to").isNotNull()
    response_id = F.when(revisit, _urn("revisit", F.col("page_id"), F.col("seq"))).otherwise(_urn("response", F.col("page_id"), F.col("seq")))
    request_id = _urn("request", F.col("page_id"), F.col("seq"))
    date = F.lit(DATE)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    response = _record(
        [
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", response_id),
            ("WARC-Date", date),
            ("WARC-Target-URI", uri),
            ("WARC-Concurrent-To", request_id),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
            ("WARC-Refers-To", F.when(revisit, _urn("page", F.col("refers_to"), F.col("digest")))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html"))),
    )
    host = F.coalesce(F.regexp_extract("url", "^[a-z]+://([^/\\s]*)", 1), F.lit(""))
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", request_id), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", response_id), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET / HTTP/1.1" + CRLF + "Host: "), host, F.lit(CRLF * 2)),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn("metadata", F.col("page_id"), F.col("seq"))), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", request_id), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF), F.lit("payload-key: "), _urn("page", F.col("page_id"), F.col("digest")), F.lit(CRLF)),
    )
    end = F.lit(CRLF * 2)
    rows.select(F.concat(request, end, response, end, metadata).alias("value")).write.option("maxRecordsPerFile", captures).option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
    return path


RECORD = pa.schema(
    [
        ("record_id", pa.string()),
        ("type", pa.string()),
        ("concurrent_to", pa.list_(pa.string())),
        *((k, pa.string()) for k in ("refers_to", "uri", "date", "declared_digest")),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("fields", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()),
        ("error", pa.string()),
    ]
)
_RECORD_SQL = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, uri string, date string, declared_digest string,"
    " payload_bytes long, payload_digest string, fields map<string,string>, payload binary, error string"
)
#: Bytes that a record's head may have: without an empty line before, what follows is no record.
MOST_HEAD = 1 << 20
_PIECE = 1 << 20


def inflate(data: bytes) -> bytes:
    """Gzip members one after the other, or bytes that aren't gzipped as they are."""
    return b"".join(_pieces(data))


def _pieces(data: bytes) -> Iterator[bytes]:
    """What ``inflate`` gives, in pieces of bounded size. Raises ``zlib.error`` where a member is broken, once what stands before is out."""
    if data[:2] != b"\x1f\x8b":
        view = memoryview(data)
        yield from (bytes(view[i : i + _PIECE]) for i in range(0, len(data), _PIECE))
        return
    view = memoryview(data)
    while len(view) > 1 and bytes(view[:2]) == b"\x1f\x8b":
        z, at = zlib.decompressobj(31), 0
        while not z.eof and (at < len(view) or z.unconsumed_tail):
            more = z.unconsumed_tail or view[at : (at := at + (_PIECE >> 2))]
            if out := z.decompress(more, _PIECE):
                yield out
        if not z.eof:
            raise zlib.error("the last member is cut off")
        view = view[min(at, len(view)) - len(z.unused_data) :]


def _fields(block: bytes) -> dict[str, list[str]]:
    """Named fields; one that is repeated has several values."""
    out: dict[str, list[str]] = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.decode("utf-8", "replace").strip().lower(), []).append(value.decode("utf-8", "replace").strip())
    return out


class _Stream:
    """An archive's bytes as far as they are needed: what has been read is let go."""

    def __init__(self, data: bytes):
        self.pieces, self.held, self.at, self.error = _pieces(data), bytearray(), 0, None

    def more(self) -> bool:
        """Hold another piece; False at the end or where a member is broken."""
        try:
            piece = next(self.pieces, None)
        except zlib.error as e:
            self.error, piece = str(e), None
        if piece is None:
            self.pieces = iter(())
            return False
        if self.at > len(self.held) // 2:
            del self.held[: self.at]
            self.at = 0
        self.held += piece
        return True

    def head(self) -> bytes | None:
        """What stands before the next empty line; None if there is none within ``MOST_HEAD`` bytes."""
        seen = 0
        while (end := self.held.find(b"\r\n\r\n", self.at + seen)) < 0:
            seen = max(0, len(self.held) - self.at - 3)
            if seen > MOST_HEAD or not self.more():
                return None
        out = bytes(self.held[self.at : end])
        self.at = end + 4
        return out

    def take(self, n: int) -> bytes | None:
        """The next ``n`` bytes; None if they aren't all there."""
        while len(self.held) - self.at < n:
            if not self.more():
                return None
        self.at += n
        return bytes(self.held[self.at - n : self.at])

    def skip_line_ends(self) -> bool:
        """Go past line ends; False if nothing follows."""
        while True:
            while self.held[self.at : self.at + 2] == b"\r\n":
                self.at += 2
            if len(self.held) - self.at >= 2 or not self.more():
                return self.at < len(self.held)


def records(data: bytes, payloads: bool = False, errors: bool = False) -> Iterator[dict]:
    """The records of one archive's bytes; by Content-Length, so a payload may hold anything.

    An archive ends at a record that is cut off, has no usable length or no
    head, or where a gzip member is broken; with ``errors`` a row of type
    ``error`` then says why. Records before that are whole.
    """
    stream, problem = _Stream(data), None
    while problem is None and stream.skip_line_ends():
        head = stream.head()
        if head is None:
            problem = "a record's head has no end"
            break
        fields = _fields(head.partition(b"\r\n")[2])
        first = lambda k: (fields.get(k) or [None])[0]  # noqa: B023, E731
        length = first("content-length") or ""
        block = stream.take(int(length)) if length.isascii() and length.isdigit() and len(length) < 19 else None
        if block is None:
            problem = f"a record is cut off, or its Content-Length {length[:40]!r} is none"
            break
        kind, payload = first("warc-type"), block
        if "application/http" in (first("content-type") or ""):
            payload = block.partition(b"\r\n\r\n")[2]
        yield {
            "record_id": first("warc-record-id"),
            "type": kind,
            "concurrent_to": fields.get("warc-concurrent-to", []),
            "refers_to": first("warc-refers-to"),
            "uri": first("warc-target-uri"),
            "date": first("warc-date"),
            "declared_digest": first("warc-payload-digest"),
            "payload_bytes": len(payload),
            "payload_digest": hashlib.sha1(payload).hexdigest() if kind in ("response", "resource") else None,
            "fields": [(k, v[0]) for k, v in _fields(block).items()] if kind == "metadata" else None,
            "payload": payload if payloads else None,
            "error": None,
        }
    problem = stream.error or problem
    if errors and problem:
        yield dict.fromkeys(RECORD.names) | {"type": "error", "concurrent_to": [], "error": problem}


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row a record of all archives (plain or gzipped) in a folder, and one of type ``error`` for each that is damaged.

    An archive is one row of Spark's ``binaryFile`` source, so its stored bytes
    (2 GB at most) are in memory, but it is inflated piece by piece, and no
    more than one record is held. Empty files have no records.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for row in records(batch.column("content")[i].as_py(), payloads, errors=True):
                    rows.append(row)
                    size += 200 + (row["payload_bytes"] or 0 if payloads else 0)
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORD)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("content")
    return files.mapInArrow(run, _RECORD_SQL)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row a capture: record_id, response, requests and metadata.

    A response, revisit or resource makes a capture. Requests and metadata
    belong to it if one of their WARC-Concurrent-To (the field may be repeated)
    names it, or names a record that belongs to it, or if one of its own names
    them. Records that lead to no capture, or have no id, are left out; the
    lists are empty where there are none.
    """
    main = F.col("type").isin("response", "revisit", "resource")
    captures = found.where(main & F.col("record_id").isNotNull())
    others = found.where(~main & F.col("record_id").isNotNull() & F.col("type").isin("request", "metadata"))
    names = captures.groupBy(F.col("record_id").alias("root")).agg(F.flatten(F.collect_list("concurrent_to")).alias("concurrent_to"))
    said = others.select("record_id", F.explode("concurrent_to").alias("to"))
    direct = said.select("record_id", F.col("to").alias("root")).join(names.select("root"), "root", "left_semi").select("record_id", "root")
    reverse = names.select(F.explode("concurrent_to").alias("record_id"), "root")
    known = direct.union(reverse).groupBy("record_id").agg(F.min("root").alias("root"))
    through = said.select("record_id", F.col("to").alias("via")).join(known.select(F.col("record_id").alias("via"), "root"), "via").select("record_id", "root")
    roots = known.select("record_id", "root", F.lit(0).alias("far")).union(through.select("record_id", "root", F.lit(1)))
    roots = roots.groupBy("record_id").agg(F.min(F.struct("far", "root")).alias("r")).select("record_id", "r.root")
    body = F.struct("record_id", "type", "uri", "date", "payload_bytes", "fields")
    lists = (
        others.join(roots, "record_id")
        .groupBy("root")
        .agg(F.collect_list(F.when(F.col("type") == "request", body)).alias("requests"), F.collect_list(F.when(F.col("type") == "metadata", body)).alias("metadata"))
    )
    response = F.struct(*[c for c in found.columns if c not in ("fields", "concurrent_to", "error")]).alias("response")
    none = F.array().cast("array<struct<record_id: string, type: string, uri: string, date: string, payload_bytes: bigint, fields: map<string, string>>>")
    return (
        captures.select(F.col("record_id").alias("root"), response)
        .join(lists, "root", "left")
        .select(F.col("root").alias("record_id"), "response", F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"))
    )


def resolve(captures: DataFrame) -> DataFrame:
    """Per capture: page_id, payload_bytes, payload_digest, record_type and refers_to.

    A revisit's payload is that of the response whose payload key, in its
    metadata, the revisit's WARC-Refers-To names.
    """
    flat = captures.select(
        F.col("metadata")[0]["fields"].alias("m"), "response.type", "response.refers_to", "response.payload_bytes", "response.payload_digest"
    ).select(F.expr("try_cast(m['page-id'] as bigint)").alias("page_id"), F.col("m")["payload-key"].alias("key"), "type", "refers_to", "payload_bytes", "payload_digest")
    targets = flat.where("type = 'response'").groupBy(F.col("key").alias("refers_to")).agg(F.max("page_id").alias("target"), F.max("payload_bytes").alias("b"), F.max("payload_digest").alias("d"))
    own, other = flat.where("type != 'revisit'"), flat.where("type = 'revisit'").join(targets, "refers_to", "left")
    return own.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).union(
        other.select("page_id", F.col("b"), F.col("d"), "type", F.col("target"))
    )


def round_trip(pages: DataFrame, shared: int = SHARED_BYTES) -> DataFrame:
    """Write archives of ``pages``, read them back, assemble and resolve.

    A row per row of ``pages``: page_id, payload_bytes, payload_digest (of the
    full payload), record_type (response or revisit) and refers_to. Rows with
    the same largest page_id are all responses; where all page_ids of a group
    are null, all are responses. An empty table gives an empty one.
    """
    spark = pages.sparkSession
    path = write_archives(pages, shared=shared)
    return resolve(assemble(stored(read_archives(spark, path), "records")))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= {SHARED_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= {SHARED_BYTES}
"""
