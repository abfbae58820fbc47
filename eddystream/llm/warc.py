"""A content-addressed WARC archive.

Payload bytes are stored once, deflated, under a strong digest (SHA-256 with the
length), and verified against it whenever they are read; the exact bytes of every
record's head (WARC head and the block's own head) are stored apart. Original
records come back by joining both on the digest.
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

from eddystream.llm.common import dropped, plain, scratch, small_batches, stored, tidy

#: The date that all records bear: an archive of one input is always the same.
DATE = "2024-01-01T00:00:00Z"
#: Digests that a task remembers, to give few copies of one payload.
SEEN = 100_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def b32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, row: int) -> str:
    """One for each row of an input, also where page_ids are null or repeat."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{row}')}>"


def heads_of(page_id: int | None, row: int, url: str | None, n: int, sha1: str, first: tuple[int | None, int] | None) -> bytes:
    """The record up to its payload, for a response (``first`` is None) or a revisit of page and row ``first``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    uri = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")
    number = lambda x: "" if x is None else str(x)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, row)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        *([] if first is None else [f"WARC-Refers-To: {record_id(*first)}", f"WARC-Profile: {REVISIT}", f"X-Refers-To-Page: {number(first[0])}"]),
        f"X-Page: {number(page_id)}",
        f"X-Payload-Length: {n}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (n if first is None else 0)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields of a record's head, and its payload: what follows the block's own head, which a revisit ends with."""
    head, block = record.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    if not block.endswith(b"\r\n\r\n") or len(block) - 4 != int(fields["Content-Length"]):
        raise ValueError(f"record {fields['WARC-Record-ID']} has another length than it says")
    return fields, block[:-4].split(b"\r\n\r\n", 1)[1]


def digests(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, sha256, n_bytes) of every row; a null html is an empty payload."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary"))
    out = plain(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    return out.select("page_id", "url", "payload", F.sha2("payload", 256).alias("sha256"), F.length("payload").cast("long").alias("n_bytes"))


def deflated(rows: DataFrame) -> DataFrame:
    """(sha256, n_bytes, sha1, deflated) of ``rows`` (sha256, n_bytes, payload), with the base32 SHA-1 from the very bytes that go in; a task gives few copies of one payload."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            new = []
            for i, key in enumerate(b.column("sha256").to_pylist()):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            if len(seen) > SEEN:
                seen.clear()
            b = b.take(pa.array(new, pa.int64()))
            data = b.column("payload").to_pylist()
            sums, small = pa.array([b32_sha1(x) for x in data], pa.string()), pa.array([zlib.compress(x, 6) for x in data], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("sha256"), b.column("n_bytes"), sums, small], ["sha256", "n_bytes", "sha1", "deflated"])

    return rows.mapInArrow(tidy(pack), "sha256 string, n_bytes long, sha1 string, deflated binary")


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes ``path``/payloads and ``path``/heads for ``pages`` (page_id, url, html).

    Of records with equal payloads of at least ``least_bytes`` bytes the one
    with the largest page_id (a null one is the smallest) is the response that
    the others revisit; smaller ones are all responses. Where several rows have
    that largest page_id, one of them is the response. Every row has a record
    with an id of its own. A payload of any length is one value, so it has to
    fit into one (2 GB). A table without rows makes an archive without records.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = digests(pages)
    # deflated before they are shuffled: what moves and what is stored is the small form
    store = deflated(rows.select("sha256", "n_bytes", "payload")).dropDuplicates(["sha256"])
    store.write.mode("overwrite").parquet(f"{path}/payloads")
    kept = spark.read.parquet(f"{path}/payloads").select("sha256", "sha1")

    # written, so that a row's number holds
    slim = stored(rows.select("page_id", "url", "sha256", "n_bytes", F.monotonically_increasing_id().alias("row")), "warc-rows")
    # one row a payload: the partial maximum makes a payload with many copies cheap
    first = slim.groupBy("sha256").agg(F.max(F.struct("page_id", "row")).alias("first"))
    joined = slim.join(first, "sha256").join(kept, "sha256").withColumn("revisit", (F.col("n_bytes") >= least_bytes) & (F.col("row") != F.col("first.row")))
    joined = joined.select("page_id", "row", "url", "sha256", "n_bytes", "sha1", "revisit", F.col("first.page_id").alias("to_page"), F.col("first.row").alias("to_row"))

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, row, url, n, sha1, again, *to in zip(*(b.column(c).to_pylist() for c in ("page_id", "row", "url", "n_bytes", "sha1", "revisit", "to_page", "to_row")), strict=True):
                out.append(heads_of(page, row, url, n, sha1, tuple(to) if again else None))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("sha256"), b.column("revisit"), pa.array(out, pa.binary())], ["page_id", "sha256", "revisit", "head"])

    joined.mapInArrow(tidy(head), "page_id long, sha256 string, revisit boolean, head binary").write.mode("overwrite").parquet(f"{path}/heads")
    dropped(slim)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, n_bytes, sha1, payload): one row a digest, every payload inflated and checked against its digests."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for sha256, n, sha1, small in zip(*(b.column(c).to_pylist() for c in ("sha256", "n_bytes", "sha1", "deflated")), strict=True):
                data = zlib.decompress(small)
                if len(data) != n or hashlib.sha256(data).hexdigest() != sha256 or b32_sha1(data) != sha1:
                    raise ValueError(f"payload {sha256} is damaged")
                out.append(data)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], ["sha256", "n_bytes", "sha1", "payload"])

    small_batches(spark)
    kept = spark.read.parquet(f"{path}/payloads").select("sha256", "n_bytes", "sha1", "deflated")
    return kept.mapInArrow(tidy(check), "sha256 string, n_bytes long, sha1 string, payload binary")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, sha256, sha1, n_bytes, record): the exact original records, a revisit without its payload, from both tables."""
    heads = spark.read.parquet(f"{path}/heads")
    end = F.lit(b"\r\n\r\n").cast("binary")
    full = heads.where("not revisit").join(read_payloads(spark, path), "sha256")
    full = full.select("page_id", "sha256", "sha1", "n_bytes", F.concat("head", "payload", end).alias("record"))
    sums = spark.read.parquet(f"{path}/payloads").select("sha256", "sha1", "n_bytes")
    again = heads.where("revisit").join(sums, "sha256")
    return full.unionByName(again.select("page_id", "sha256", "sha1", "n_bytes", F.concat("head", end).alias("record")))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as parsed from the rebuilt records.

    A response's payload must have the digest and length that its head names, a
    revisit's head those of the stored payload; anything else raises an error.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[tuple] = []
            for sha1, n, record in zip(*(b.column(c).to_pylist() for c in ("sha1", "n_bytes", "record")), strict=True):
                h, payload = parse_record(record)
                if h["WARC-Type"] == "response":
                    sha1, n = b32_sha1(payload), len(payload)
                elif payload:
                    raise ValueError(f"revisit {h['WARC-Record-ID']} has a payload")
                if h["WARC-Payload-Digest"] != f"sha1:{sha1}" or int(h["X-Payload-Length"]) != n:
                    raise ValueError(f"record {h['WARC-Record-ID']} doesn't match its payload")
                number = lambda x: int(x) if x else None
                got.append((number(h["X-Page"]), n, sha1, h["WARC-Type"], number(h.get("X-Refers-To-Page"))))
            cols = list(zip(*got, strict=True)) if got else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    records = read_records(spark, path).select("sha1", "n_bytes", "record")
    return records.mapInArrow(tidy(parse), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc_archive(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path)
