"""WARC archives with revisit records.

Headers (digest, size, page) are shuffled by payload digest and reduced to one
original per digest; every other record of the payload becomes a revisit of
it. Archives are written by Spark's text sink with the record separator of the
format (CRLF CRLF) as line separator, one gzip file per task, so they land
wherever Spark can write. Reading takes the same separator and puts blocks
together again by Content-Length, as a payload may hold the separator itself;
gzip files are not split, so a record never spans tasks.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes

SEPARATOR = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 1000
READ = "page_id bigint, url string, record_id string, record_type string, refers_id string, " \
       "payload_digest string, payload_bytes bigint, payload string"


def _uuid(page: Column, row: Column) -> Column:
    """A record id that a repeated task gives again."""
    h = F.md5(F.concat_ws(":", F.lit("record"), F.coalesce(page.cast("string"), F.lit("none")), row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"),
                    F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
                    F.lit(">"))


def resolve_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                     min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``pages`` (a stored table) as records: ``page_id, url, payload, digest,
    record_id, refers_id, refers_url``; ``refers_id`` is null for responses.

    Of equal payloads of at least ``min_bytes`` bytes the record with the
    largest id is the response (of repeated ids the last row; null ids come
    before all others). A null payload is empty; other columns are not read,
    so their names cannot clash; an empty table gives no records."""
    rows = pages.select(F.monotonically_increasing_id().alias("_row"),
                        F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                        F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("payload")) \
        .withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    # shorter payloads (all empty ones share a digest) can be no copies: they stay where they are
    large = rows.where(F.octet_length("payload") >= min_bytes)
    copies = large.groupBy("digest").agg(
        F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("order"), F.col("_row"), F.col("page_id"),
                       F.col("url"))).alias("original"), F.count("*").alias("n")) \
        .where("n > 1").select("digest", "original")
    other = F.col("original").isNotNull() & (F.col("original._row") != F.col("_row"))
    small = rows.where(F.octet_length("payload") < min_bytes) \
        .withColumn("original", F.lit(None).cast(copies.schema["original"].dataType))
    return large.join(copies, "digest", "left").unionByName(small).select(
        "page_id", "url", "payload", "digest", _uuid(F.col("page_id"), F.col("_row")).alias("record_id"),
        F.when(other, _uuid(F.col("original.page_id"), F.col("original._row"))).alias("refers_id"),
        F.when(other, F.col("original.url")).alias("refers_url"))


def _line(name: str, value: Column) -> Column:
    """A header line; none for null. Control characters cannot break it."""
    return F.concat(F.lit(f"\r\n{name}: "), F.regexp_replace(value, "[\\x00-\\x1F\\x7F]+", " "))


def write_archives(records: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z") -> None:
    """Records of ``resolve_revisits`` as gzip WARC 1.1 files below ``path``."""
    revisit = F.col("refers_id").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(SEPARATOR))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat_ws(
        "", F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        _line("WARC-Record-ID", F.col("record_id")), _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Refers-To", F.col("refers_id")), _line("WARC-Refers-To-Target-URI", F.col("refers_url")),
        F.when(revisit, F.lit(f"\r\nWARC-Profile: {PROFILE}")),
        _line("X-Page-ID", F.col("page_id").cast("string")),
        F.lit("\r\nContent-Type: application/http;msgtype=response"),
        _line("Content-Length", F.octet_length("block").cast("string")), F.lit(SEPARATOR))
    records.withColumn("block", block).select(F.concat(head, "block").alias("value")) \
        .write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path)


class _Parser:
    """Records from the parts between separators, in file order."""

    def __init__(self):
        self.head, self.parts, self.have = None, [], 0

    def take(self, part: bytes):
        """Records that this part completes: (header, HTTP header, payload)."""
        while True:
            if self.head is None:
                first, *lines = part.split(b"\r\n")
                if not first.startswith(b"WARC/"):
                    raise ValueError(f"no record header: {part[:80]!r}")
                self.head = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
                self.need, self.parts, self.have = int(self.head["content-length"]), [], 0
                return
            self.have += len(part) + 4 * bool(self.parts)
            self.parts.append(part)
            if self.have < self.need:
                return
            # a block that ends with line breaks moves the separator behind it into itself: cut by length
            stream, separator = SEPARATOR.encode().join(self.parts), SEPARATOR.encode()
            block, rest = stream[:self.need], stream[self.need:]
            if rest and not rest.startswith(separator):
                raise ValueError(f"record {self.head.get('warc-record-id')} is longer than its Content-Length")
            head, self.head = self.head, None
            http, _, payload = block.partition(separator)
            yield head, http, payload
            part = rest[len(separator):]
            if not part:
                return


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of archives as they stand: a revisit has no payload (null) and
    no ``payload_bytes``. The digest of every response is computed anew from
    its payload; another one in its header raises ValueError."""
    def run(batches):
        parser = _Parser()
        for batch in batches:
            out = []
            for head, _, payload in (r for part in as_bytes(batch["value"]) for r in parser.take(part)):
                kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                whole, page = kind == "response", head.get("x-page-id")
                if whole and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"digest of record {head['warc-record-id']} does not match its payload")
                out.append((int(page) if page is not None else None, head.get("warc-target-uri"),
                            head["warc-record-id"], kind, head.get("warc-refers-to"), digest,
                            len(payload) if whole else None, payload.decode() if whole and with_payload else None))
            if out:
                types = [pa.int64()] + [pa.string()] * 5 + [pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                 [f.split()[0] for f in READ.split(", ")])
        if parser.head is not None:
            raise ValueError("an archive ends within a record")

    return spark.read.option("lineSep", SEPARATOR).text(path).mapInArrow(run, READ)


def joined_to_originals(records: DataFrame) -> DataFrame:
    """Records of ``read_archives`` with what a revisit takes from its
    response: ``payload_bytes``, ``payload``, and the response's page in
    ``refers_to``."""
    responses = records.where("record_type = 'response'")
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes", "payload")
    found = responses.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"),
                             "payload_bytes", "payload")
    return responses.withColumn("refers_to", F.lit(None).cast("bigint")) \
        .unionByName(revisits.join(found, "refers_id").select(*responses.columns, "refers_to"))
