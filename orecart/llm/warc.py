"""WARC archives with revisit records: writing, deduplication by payload digest, reading.

Headers (id, digest, length) are shuffled by payload digest to find the original of each group of equal payloads; payloads move once,
to the archive they are written to. There are as many archives as the sum of payload bytes asks for (at least the partitions of a shuffle), and a
large archive goes on in another file after so many records, so one archive fits a reading task whatever the table. Archives are written by Spark's text
source, one record a row with the record separator as line end, so any file system that Spark writes to will do. Reading
decompresses each archive step by step through a parser that follows Content-Length and gives out records in bounded batches.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF, GAP = "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to_record string"
#: Payload bytes for each archive, before compression; records in a batch that reading gives out.
ARCHIVE_BYTES, BATCH = 128_000_000, 10_000


def find_revisits(headers: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(page_id, payload_digest, refers_to) of records whose payload another record holds.

    `headers` has page_id, payload_digest and payload_bytes. Among equal payloads of at least `min_bytes` the largest page_id is the
    original. Repeated rows of that page_id are all originals; a null page_id is never one and refers to the original. Where all
    page_ids of a payload are null there are no revisits.
    """
    big = headers.filter(F.col("payload_bytes") >= min_bytes)
    first = big.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    found = big.join(first, ["payload_digest", "payload_bytes"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.select("page_id", "payload_digest", "refers_to").distinct()


def _record_id(page_id, digest, place=None):
    """A name-based id; rows that repeat a page and payload differ by their place."""
    h = F.sha1(F.concat_ws("/", F.lit("record"), page_id.cast("string"), digest, *([place.cast("string")] if place is not None else [])))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def write_warc(pages: DataFrame, path: str, min_bytes: int = 1000, compression: str = "gzip", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record for each row of (page_id, url, html) under `path`.

    null html is an empty payload; a null or empty url or page_id has no header line; line breaks in a url become spaces. Repeated rows
    are records of their own, with ids of their own. An empty table writes no record. Other columns are ignored, whatever their names.
    """
    held = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("place"))
    held = held.withColumns({"payload_digest": F.sha1(F.col("html").cast("binary")), "payload_bytes": F.octet_length("html").cast("long"), "name": F.coalesce(F.col("page_id").cast("string"), F.lit(""))})
    headers = held.select("page_id", "payload_digest", "payload_bytes")
    total = headers.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("bytes")).first()
    # with fewer partitions than Spark has for shuffles, it would deal the payloads once more
    archives = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total["bytes"] // archive_bytes))
    repeated = held.groupBy("name", "payload_digest").agg(F.min("place").alias("first_place"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = find_revisits(headers, min_bytes).select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("name"), "payload_digest", "refers_to")
    notes = revisits.join(repeated, ["name", "payload_digest"], "full_outer")
    # both sides are dealt alike by the archive that a record goes to; notes of an archive are far smaller than its records
    keys = ["name", "payload_digest"]
    both = held.repartition(archives, *keys).join(notes.repartition(archives, *keys).hint("shuffle_hash"), keys, "left")
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(GAP))
    block = F.when(again, http).otherwise(F.concat(http, "html"))

    def line(name, value, when=None):
        text = F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
        return text if when is None else F.when(when, text).otherwise("")

    uri = F.trim(F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " "))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.when(F.col("place") > F.col("first_place"), _record_id(F.col("page_id"), F.col("payload_digest"), F.col("place"))).otherwise(_record_id(F.col("page_id"), F.col("payload_digest")))),
        line("WARC-Date", F.lit(datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))),
        line("WARC-Target-URI", uri, uri != ""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("payload_digest")), again),
        line("WARC-Profile", F.lit(PROFILE), again),
        line("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("page_id").isNotNull()),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )
    # archives of some very long records would otherwise hold many times their share
    records_a_file = max(1, 2 * -(-total["n"] // archives))
    both.select(record.alias("value")).write.option("lineSep", GAP).option("compression", compression).option("maxRecordsPerFile", records_a_file).text(path)


class Feed:
    """A window over an archive that may be gzip-compressed, holding no more than the record in hand."""

    def __init__(self, data: bytes | memoryview, step: int = 1 << 20) -> None:
        self.data, self.at, self.step, self.held = memoryview(data), 0, step, bytearray()
        self.zipped = bytes(data[:2]) == b"\x1f\x8b"
        self.unzip = zlib.decompressobj(31) if self.zipped else None

    def more(self) -> bool:
        if self.at >= len(self.data):
            return False
        piece = bytes(self.data[self.at : self.at + self.step])
        self.at += len(piece)
        if not self.zipped:
            self.held += piece
            return True
        while piece:
            self.held += self.unzip.decompress(piece)
            piece = self.unzip.unused_data
            if self.unzip.eof:
                self.unzip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
        out = bytes(self.held[: i + len(mark)])
        del self.held[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records(data: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    feed = Feed(data)
    while (head := feed.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = feed.take(int(named["content-length"]))
        feed.take(4)
        yield named, block


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in READ.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for named, block in records(memoryview(content.as_buffer())):
                head, _, payload = block.partition(b"\r\n\r\n")
                kind = named["warc-type"]
                if kind == "response":
                    digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
                    if named.get("warc-payload-digest") != f"sha1:{digest}":
                        raise ValueError("a payload does not have its digest")
                else:
                    digest, n = named["warc-payload-digest"].removeprefix("sha1:"), None
                page = named.get("x-page-id")
                rows.append((int(page) if page else None, named["warc-record-id"], kind, named.get("warc-target-uri"), n, digest, named.get("warc-refers-to")))
                if len(rows) >= BATCH:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and record_id of each record under `path`.

    Digests and lengths of responses are taken from the payload read. A revisit gets both by joining the response it refers to; one
    whose response is missing has null payload_bytes and refers_to. Repeated records are rows of their own; archives without records,
    and empty files, give no rows. A file that breaks off or holds something else is an error.
    """
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(_parse, READ)
    response = got.filter("record_type = 'response'").groupBy("record_id").agg(F.max("page_id").alias("o_page"), F.max("payload_bytes").alias("o_bytes"), F.max("payload_digest").alias("o_digest"))
    joined = got.join(response.withColumnRenamed("record_id", "o_record"), (F.col("refers_to_record") == F.col("o_record")) & (F.col("payload_digest") == F.col("o_digest")), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "o_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("o_page").alias("refers_to"), "url", "record_id")
