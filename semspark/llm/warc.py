"""WARC archives written and read as a chunked record table, so that no record is ever held whole by a reader.

A record is rows of (record_id, chunk, offset, size): the writer cuts a payload into segments of bounded size, each one
WARC record of its own (continuation records after the first, as the standard has it), and the reader walks an archive
through a decompressing stream, giving a row for each chunk with the SHA-1 of the payload up to its end.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.llm.scratch import OPENED, cut, opened, shared_folder

SEGMENT, CHUNK = 1 << 20, 1 << 18
#: Tables of revisits with at most so many rows are broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 50_000
#: Payloads shorter than this are stored whenever they occur.
REVISIT_FROM = 1000
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def revisits(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """(digest, size, response): for payloads that several ids hold, the largest id. pages has id, payload (binary)."""
    p = pages.select("id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")).where(F.col("size") >= least)
    groups = p.groupBy("digest", "size").agg(F.max("id").alias("response"), F.min("id").alias("first"), F.count("*").alias("n"), F.count("id").alias("named"))
    return groups.where("response IS NOT NULL AND (first <> response OR named < n)").select("digest", "size", "response")


def _crlf(*lines: Column) -> Column:
    return F.concat(*(F.concat(x, F.lit("\r\n")) for x in lines))


def _urn(i: Column) -> Column:
    return F.concat(F.lit("<urn:page"), F.coalesce(F.concat(F.lit(":"), i.cast("string")), F.lit("")), F.lit(">"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment: int = SEGMENT) -> None:
    """Write a record per row to gzip WARC files below folder, one for each partition.

    Of rows with equal payloads of at least REVISIT_FROM bytes, those with the largest id are responses and the others
    revisit it. A null payload is empty, a null id the smallest, a null url empty; repeated rows are written each. An empty
    table gives an archive without records; other columns, whatever their names, are not read.
    """
    p = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    same = cut(revisits(p))
    p = p.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    if same.count() <= BROADCAST_ROWS:
        p = p.join(F.broadcast(same), ["digest", "size"], "left")
    else:  # digests meet without payloads first; these then move by id, since one payload may be that of many rows
        pairs = cut(p.select("id", "digest", "size").distinct().join(same, ["digest", "size"]))
        p = p.alias("p").join(pairs.alias("q"), F.expr("p.id <=> q.id AND p.digest = q.digest AND p.size = q.size"), "left").select("p.*", "q.response")
    again = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    p = p.withColumns({"again": again, "chunks": F.when(again, 1).otherwise(F.greatest(F.ceil(F.col("size") / segment), F.lit(1))).cast("int")})
    p = p.withColumn("chunk", F.explode(F.sequence(F.lit(1), F.col("chunks"))))
    part = F.when(F.col("again"), F.lit(b"")).otherwise(F.substring("payload", (F.col("chunk") - 1) * segment + 1, F.lit(segment)))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    first = F.col("chunk") == 1
    body = F.concat(F.when(first & ~F.col("again"), F.lit(HTTP_HEAD.encode())).otherwise(F.lit(b"")), part)
    urn = _urn(F.col("id"))
    several = F.col("chunks") > 1
    number = F.when(several, _crlf(F.concat(F.lit("WARC-Segment-Number: "), F.col("chunk").cast("string")))).otherwise(F.lit(""))
    more = _crlf(
        F.concat(F.lit("WARC-Segment-Origin-ID: "), urn),
    )
    total = F.when(F.col("chunk") == F.col("chunks"), _crlf(F.concat(F.lit("WARC-Segment-Total-Length: "), (F.col("size") + len(HTTP_HEAD)).cast("string")))).otherwise(F.lit(""))
    refers = F.when(F.col("again"), _crlf(F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("response"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string")))).otherwise(F.lit(""))
    head = F.concat(
        _crlf(
            F.lit("WARC/1.1"),
            F.concat(F.lit("WARC-Type: "), F.when(F.col("again"), "revisit").when(first, "response").otherwise("continuation")),
            F.concat(F.lit("WARC-Record-ID: "), F.when(first, urn).otherwise(F.concat(F.rtrim(urn, F.lit(">")), F.lit("#"), F.col("chunk").cast("string"), F.lit(">")))),
            F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
            F.concat(F.lit("WARC-Target-URI: "), url),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
            F.concat(F.lit("Content-Type: "), F.when(first, "application/http; msgtype=response").otherwise("application/octet-stream")),
            F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
        ),
        number,
        F.when(first, F.lit("")).otherwise(F.concat(more, total)),
        refers,
        F.lit("\r\n"),
    )
    # the text writer puts the bytes of a string as they are, then the two line ends that close a record
    p.select(F.concat(head.cast("binary"), body).cast("string").alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(folder)


class _Payload:
    """What is known of a record's payload so far: it outlives the record's segments."""

    def __init__(self, head: dict[str, str]):
        self.head, self.sha, self.offset, self.chunk = head, hashlib.sha1(usedforsecurity=False), 0, 0


FIELDS = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("declared_digest", pa.string()), ("declared_size", pa.int64()), ("chunk", pa.int32()), ("offset", pa.int64()), ("size", pa.int32()), ("sha1", pa.string()), ("last", pa.bool_()), ("data", pa.binary())])


def records(stream: io.BufferedIOBase, chunk: int = CHUNK, data: bool = True) -> Iterator[dict]:
    """Rows of the chunked record table, in the order of the archive."""
    open_: dict[str, _Payload] = {}
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        left, kind = int(head.get("content-length", 0)), head.get("warc-type", "")
        if kind == "continuation":
            p = open_.pop(head.get("warc-segment-origin-id", ""), None) or _Payload(head)
            last = "warc-segment-total-length" in head
        else:
            p, last = _Payload(head), "warc-segment-number" not in head
            if kind in ("response", "request") and head.get("content-type", "").startswith("application/http"):
                while left:
                    line = stream.readline(left)
                    left -= len(line)
                    if not line.strip():
                        break
        while True:
            piece = stream.read(min(left, chunk))
            left -= len(piece)
            p.sha.update(piece)
            done = left <= 0 or not piece
            h = p.head
            yield {
                "record_id": h.get("warc-record-id"), "type": h.get("warc-type"), "url": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to"),
                "declared_digest": h.get("warc-payload-digest"), "declared_size": int(h["x-payload-length"]) if "x-payload-length" in h else None,
                "chunk": p.chunk, "offset": p.offset, "size": len(piece), "sha1": p.sha.hexdigest(), "last": done and last, "data": piece if data else None,
            }
            p.chunk, p.offset = p.chunk + 1, p.offset + len(piece)
            if done:
                break
        if not last:
            open_[p.head.get("warc-record-id", "")] = p


def read(spark: SparkSession, folder: str, data: bool = True) -> DataFrame:
    """The chunked record table of all archives (.warc or .gz) in a folder. A row's sha1 covers its payload so far.

    Tasks get paths and stream the archives from the folder, a chunk at a time, however large archives and records are.
    """

    scheme = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getScheme() or ""
    streamed = scheme in OPENED  # elsewhere Spark has to read each archive whole, which its binaryFile allows up to 2 GiB

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                with opened(archive.as_py()) if streamed else pa.BufferReader(archive.as_buffer()) as raw:
                    zipped = raw.read(2) == b"\x1f\x8b"
                    raw.seek(0)
                    rows, held = [], 0
                    for row in records(io.BufferedReader(gzip.GzipFile(fileobj=raw), CHUNK) if zipped else io.BufferedReader(raw, CHUNK), data=data):
                        rows.append(row)
                        held += row["size"] * data + 500
                        if held > 16 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, FIELDS)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, FIELDS)

    kinds = "record_id string, type string, url string, refers_to string, declared_digest string, declared_size long, chunk int, offset long, size int, sha1 string, last boolean, data binary"
    return spark.read.format("binaryFile").load(folder).select("path" if streamed else "content").mapInArrow(walk, kinds)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the pages to archives in the shared folder and return what is read back, a row per record."""
    folder = shared_folder(pages.sparkSession)
    write(pages, folder, id_col, url_col, payload_col)
    r = read(pages.sparkSession, folder, data=False).where("last")
    page = lambda c: F.when(c.startswith("<urn:page:"), F.regexp_extract(c, "^<urn:page:(.*)>$", 1)).try_cast(pages.schema[id_col].dataType)
    again = F.col("type") == "revisit"
    return r.select(
        page(F.col("record_id")).alias(id_col),
        F.when(again, F.col("declared_size")).otherwise(F.col("offset") + F.col("size")).alias("payload_bytes"),
        F.when(again, F.regexp_replace("declared_digest", "^sha1:", "")).otherwise(F.col("sha1")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(again, page(F.col("refers_to"))).alias("refers_to"),
    )
