"""WARC archives: captures written as transactions of records, and assembled from them again."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .common import broadcast_if_small, materialize, new_path, tidy

#: Bytes of an archive file after which the next one begins; a single larger capture has a file of its own.
ARCHIVE_BYTES = 8 << 20
#: Payloads from this many bytes on are stored once.
LEAST_SHARED = 1000
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_DATE = "2024-01-01T00:00:00Z"


def record_id(kind: str, page_id, url, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{kind}|{page_id}|{url}|{digest}')}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _field(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" and c != "%" else f"%{ord(c):02X}" for c in value)


def transaction(page_id, url: str | None, payload: bytes, response_of: tuple | None) -> bytes:
    """The request, response (or revisit) and metadata records of a capture. response_of: (page_id, url) of the stored equal payload."""
    sha = hashlib.sha1(payload)
    hex_digest, digest = sha.hexdigest(), f"sha1:{base64.b32encode(sha.digest()).decode()}"
    target = [("WARC-Target-URI", _field(url))] if url is not None else []
    own = record_id("response", page_id, url, hex_digest)
    date = [("WARC-Date", _DATE)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if response_of is None:
        main = _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *date, *target, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")], http + payload)
    else:
        main = _record(
            [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *date, *target, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Payload-Digest", digest),
             ("WARC-Refers-To", record_id("response", *response_of, hex_digest)), ("Content-Type", "application/http; msgtype=response")], http,
        )
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", page_id, url, hex_digest)), *date, *target, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\n\r\n")
    facts = [f"payload-bytes: {len(payload)}"] + ([f"page-id: {page_id}"] if page_id is not None else []) + ([f"refers-to-page: {response_of[0]}"] if response_of and response_of[0] is not None else [])
    meta = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", page_id, url, hex_digest)), *date, *target, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], "".join(f + "\r\n" for f in facts).encode())
    return request + main + meta


def _unfield(value: str) -> str:
    out, i = [], 0
    while i < len(value):
        if value[i] == "%":
            out.append(chr(int(value[i + 1 : i + 3], 16)))
            i += 3
        else:
            out.append(value[i])
            i += 1
    return "".join(out)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive. Lengths rule, so a payload may hold anything."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, archive[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def write(pages: DataFrame, path: str, least_shared: int = LEAST_SHARED, archive_bytes: int = ARCHIVE_BYTES, compression: str = "gzip") -> None:
    """Writes pages (page_id, url, html) as WARC archives of about archive_bytes each into the folder path.

    Of rows with equal payloads of least_shared bytes or more that with the largest (page_id, url) is stored as response, the others
    revisit it. Digests are found and compared in Spark, with partial maxima before the shuffle; only digests that occur more than once
    come to the pages again. Files are written by Spark's committer, so a lost task leaves no half archive behind.
    """
    ship(pages.sparkSession)
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    long_ = rows.where(F.octet_length("payload") >= least_shared).select(F.sha2("payload", 256).alias("same"), "page_id", "url")
    owners = long_.groupBy("same").agg(F.max(F.struct("page_id", "url")).alias("owner"), F.count("*").alias("n")).where("n > 1")
    owners = materialize(owners.select(F.col("same").alias("_same"), "owner"), "owners")
    same = F.when(F.octet_length("payload") >= least_shared, F.sha2("payload", 256))
    marked = rows.withColumn("same", same).join(broadcast_if_small(owners, limit=100_000), F.col("same") == F.col("_same"), "left")
    marked = marked.select("page_id", "url", "payload", F.col("owner.page_id").alias("o_id"), F.col("owner.url").alias("o_url"), F.when(F.col("owner").isNotNull(), ~(F.col("owner.page_id").eqNullSafe(F.col("page_id")))).otherwise(False).alias("again"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def full() -> pa.RecordBatch:
            # the writer ends each value with a line end, the last one of the last record
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-2]], pa.binary())], names=["value"])

        for batch in batches:
            ids, urls, o_ids, o_urls, again = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            for i, payload in enumerate(batch.column(2)):
                one = transaction(ids[i], urls[i], payload.as_py(), (o_ids[i], o_urls[i]) if again[i] else None)
                if held and size + len(one) > archive_bytes:
                    yield full()
                    held, size = [], 0
                held.append(one)
                size += len(one)
        if held:
            yield full()

    blobs = marked.mapInArrow(tidy(archives), "value binary").select(F.col("value").cast("string").alias("value"))
    blobs.write.option("lineSep", "\r\n").option("maxRecordsPerFile", 1).option("compression", compression).text(path)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per capture of the archives in path:

    page_id, url, record_type, record_id, payload_bytes, payload_digest (hex), refers_to (record), refers_to_page,
    request (struct) and, on demand, payload (null for a revisit). Request and metadata records meet their response through
    WARC-Concurrent-To. Records of identical captures have identical ids: they are counted, joined once and given back as
    often as they occur.
    """
    ship(spark)
    schema = "kind string, id string, main string, target string, digest string, refers string, bytes long, page_id long, page_refers long, method string, payload binary"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.string()] * 6 + [pa.int64()] * 3 + [pa.string(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                rows, size = [], 0
                for f, block in records(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw):
                    kind, target = f["WARC-Type"], f.get("WARC-Target-URI")
                    target = None if target is None else _unfield(target)
                    if kind in ("response", "revisit"):
                        payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
                        digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"digest of {f['WARC-Record-ID']} doesn't fit its payload")
                        rows.append((kind, f["WARC-Record-ID"], f["WARC-Record-ID"], target, digest, f.get("WARC-Refers-To"), None if payload is None else len(payload), None, None, None, payload if with_payload else None))
                    elif kind == "metadata":
                        facts = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if x)
                        number = lambda k, facts=facts: int(facts[k]) if k in facts else None
                        rows.append((kind, f["WARC-Record-ID"], f["WARC-Concurrent-To"], target, None, None, number("payload-bytes"), number("page-id"), number("refers-to-page"), None, None))
                    else:
                        rows.append((kind, f["WARC-Record-ID"], f["WARC-Concurrent-To"], target, None, None, None, None, None, block.split(b" ", 1)[0].decode(), None))
                    size += len(rows[-1][-1] or b"") + 300
                    if size > ARCHIVE_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = files.mapInArrow(tidy(parse), schema)
    of = lambda *kinds: found.where(F.col("kind").isin(*kinds))
    main = of("response", "revisit").groupBy("id").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("kind", "target", "digest", "refers", "bytes", *(["payload"] if with_payload else []))])
    request = of("request").groupBy("main").agg(F.first(F.struct("id", "method", F.col("target").alias("url"))).alias("request")).withColumnRenamed("main", "r_main")
    meta = of("metadata").groupBy("main").agg(F.first(F.struct("page_id", "bytes", "page_refers")).alias("meta")).withColumnRenamed("main", "m_main")
    joined = main.join(request, F.col("id") == F.col("r_main"), "left").join(meta, F.col("id") == F.col("m_main"), "left")
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        F.col("meta.page_id").alias("page_id"), F.col("target").alias("url"), F.col("kind").alias("record_type"), F.col("id").alias("record_id"), F.coalesce("bytes", "meta.bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("refers").alias("refers_to"), F.col("meta.page_refers").alias("refers_to_page"), "request", *(["payload"] if with_payload else []),
    )


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back, a nested row per capture.

    Null html: an empty payload. Null url: records without a target. Null page_id: none in the metadata, and such a row is the response
    of its payload only if no row with a page_id has it. Rows that repeat page_id and payload are each stored if theirs is the largest page_id. Empty table: no
    archives and no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    return read(spark, path, with_payload)
