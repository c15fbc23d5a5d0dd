"""WARC archives without repeated payloads: writing, reading, and resolving revisit records by payload digest."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, scratch, small_batches

FILE_MB = 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "key", "maybe", "payload"]
MOST_BITS = 1 << 28  # of a Bloom filter: 32 MB
FEW = 100_000  # headers that may be broadcast: 6 MB
EMPTY = zlib.compress(b"", wbits=31)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1, as in WARC-Payload-Digest after "sha1:"."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_headers(pages: DataFrame, revisits: Broadcast | None = None) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, key, maybe, payload) of every page; null html is an empty payload.

    key is a 64-bit name of page_id and payload; maybe tells whether the Bloom filter ``revisits`` may hold it.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.encode() for x in b.column("payload").to_pylist()]
            sums = [hashlib.sha1(x).digest() for x in raw]
            ids = b.column("page_id").fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            key = (np.frombuffer(b"".join(x[:8] for x in sums), np.uint64) ^ (ids >> np.uint64(7)) ^ ids).view(np.int64)
            maybe = _may_hold(revisits.value, key) if revisits is not None else np.zeros(len(raw), bool)
            made = [pa.array([len(x) for x in raw], pa.int64()), pa.array([base64.b32encode(x).decode() for x in sums], pa.string()), pa.array(key), pa.array(maybe)]
            # ids stay in Arrow: pandas makes doubles of whole numbers beside a null
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *made, b.column("payload")], NAMES)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    return rows.mapInArrow(hashed, "page_id long, url string, payload_bytes long, payload_digest string, key long, maybe boolean, payload string")


def _may_hold(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys a Bloom filter (64-bit words) of two bits a key may hold."""
    k, ok = key.view(np.uint64), np.ones(len(key), bool)
    for at in (k, k >> np.uint64(32)):
        at = at & np.uint64(64 * len(bits) - 1)
        ok &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


def _bloom(keys: DataFrame, n: int) -> Broadcast:
    """Bloom filter of ``n`` keys, 32 bits for each but at most MOST_BITS: words are put together by Spark, the driver gets these."""
    size = min(MOST_BITS, max(1 << 16, 1 << (32 * n).bit_length()))
    at = F.explode(F.array(F.col("key"), F.shiftrightunsigned("key", 32))).alias("at")
    at = keys.select(at).select(F.col("at").bitwiseAND(F.lit(size - 1)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bits)


def resolve_revisits(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``headers`` with record_type and refers_to.

    Of the records with one digest and at least ``least_bytes`` the one with the largest page_id is the response
    and the others revisit it; smaller ones are all responses.  Headers alone are shuffled, by digest: the
    largest page_id of each digest that occurs twice comes back by a join, whose hot side AQE can split.  Payloads stay where they are.  A
    null page_id counts as smallest; records that tie for the largest are all responses.
    """
    original = headers.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1 and __first is not null")
    joined = headers.join(original.select("payload_digest", "__first"), "payload_digest", "left")
    revisit = F.col("__first").isNotNull() & (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return joined.select(*headers.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("__first")).alias("refers_to"))


def write_archive(records: DataFrame, path: str, per_file: int = 5000) -> None:
    """Write (page_id, url, payload_digest, payload, record_type, refers_to) as WARC/1.1, each record a gzip member of its own.

    Every record gets a fresh header.  A revisit has its original's digest and record id and an empty block.
    Record ids name the page.  A member is one row of Spark's text writer, whose commit protocol covers lost executors:
    the member's last byte, the highest of its size, is 0 and is written as the row's end; a record of 16 MB or
    more is followed by an empty member, which ends so.  A file gets at most ``per_file`` records; payloads aren't
    shuffled for the sake of file sizes.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, url, said, payload, kind, to in zip(*(b.column(i).to_pylist() for i in range(6))):
                block = b"" if kind == "revisit" else (payload or "").encode()
                fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'none' if page is None else page}>"), ("WARC-Date", DATE)]
                if url is not None:
                    fields.append(("WARC-Target-URI", re.sub(r"[\r\n]+", "%0A", url)))
                fields.append(("WARC-Payload-Digest", f"sha1:{said}"))
                if kind == "revisit":
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{to}>")]
                fields += [("Content-Type", "text/html"), ("Content-Length", len(block))]
                head = "".join(f"{k}: {v}\r\n" for k, v in fields)
                member = zlib.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n", wbits=31)
                out.append((member if member[-1] == 0 else member + EMPTY)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    made = records.select("page_id", "url", "payload_digest", "payload", "record_type", "refers_to").mapInArrow(members, "value binary")
    made.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)


def unzip(data: bytes) -> Iterator[bytes]:
    """The content of each gzip member."""
    while data:
        one = zlib.decompressobj(31)
        yield one.decompress(data)
        data = one.unused_data


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record; the block's length is the header's, never searched for."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to (, payload).

    For responses size and digest are taken of the block read, and a digest unlike its header's is an error;
    a revisit's size is null here.  Files are small (write_archive's caller sees to it), a task holds one.
    """

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * with_payload]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in (x.as_py() for b in batches for x in b.column("content")):
            out = []
            for f, block in (r for member in unzip(content) for r in parse(member)):
                page, kind = f["warc-record-id"][len("<urn:page:") : -1], f["warc-type"]
                said = f["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and digest(block) != said:
                    raise ValueError(f"damaged record {page}")
                to = int(f["warc-refers-to"][len("<urn:page:") : -1]) if kind == "revisit" else None
                row = (None if page == "none" else int(page), f.get("warc-target-uri"), len(block) if kind == "response" else None, said, kind, to)
                out.append((*row, block.decode()) if with_payload else row)
                if len(out) == 2000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(records, HEADER + ", payload string" * with_payload)


def restored(records: DataFrame) -> DataFrame:
    """Revisits with the size of their original's payload, joined by its page_id and digest."""
    size = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("__bytes"))
    joined = records.join(size, ["refers_to", "payload_digest"], "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "__bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def deduplicate_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) to WARC files under ``path``, repeated payloads as revisits.

    Only headers are shuffled.  Revisits need no payload and are written from their headers.  Responses are written where
    their pages lie: a Bloom filter of all revisits tells most pages that they are responses, and the few that it
    holds wrongly are known by name from the headers (broadcast up to FEW of them, else these pages alone are joined).
    """
    small_batches(pages.sparkSession)
    heads = materialize(page_headers(pages).drop("maybe", "payload"))
    n, size = heads.agg(F.count(F.lit(1)), F.sum("payload_bytes")).first()
    per_file = min(1_000_000, max(1, (FILE_MB << 20) * n // max(size or 0, 1)))  # records that make FILE_MB on average
    revisits = materialize(resolve_revisits(heads, least_bytes).where("record_type = 'revisit'"))
    again = revisits.count()
    if not again:
        write_archive(page_headers(pages).select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")), path, per_file)
        release(heads, revisits)
        return
    bits = _bloom(revisits.select("key"), again)

    @F.pandas_udf("boolean")
    def held(key: pd.Series) -> pd.Series:
        return pd.Series(_may_hold(bits.value, key.to_numpy(np.int64)))

    name = [F.coalesce("page_id", F.lit(-1)).alias("id"), F.col("page_id").isNull().alias("none"), "payload_digest"]
    by = ["id", "none", "payload_digest"]
    wrong = materialize(heads.where(held("key")).select(*name).join(revisits.select(*name), by, "left_anti").distinct())
    rows = page_headers(pages, bits).select("*", *name[:2])
    if wrong.count() <= FEW:
        wrong = F.broadcast(wrong.select(*by, F.lit(True).alias("response")))
        responses = rows.join(wrong, by, "left").where(~F.col("maybe") | F.col("response"))
    else:
        responses = rows.where(~F.col("maybe")).unionByName(rows.where("maybe").join(wrong, by, "left_semi").select(*rows.columns))
    responses = responses.select("page_id", "url", "payload_digest", "payload", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    write_archive(responses.unionByName(revisits.select("page_id", "url", "payload_digest", F.lit("").alias("payload"), "record_type", "refers_to")), path, per_file)
    release(heads, revisits)


def op7_warc(pages: DataFrame) -> DataFrame:
    """Archive of ``pages``, read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, a null page_id counts as smallest.  Rows equal in page_id and html share a verdict.
    Other columns aren't read, whatever their names.  A page of any length is one row.  No pages: no records.
    """
    path = scratch(pages.sparkSession, "warc")
    deduplicate_pages(pages, path)
    # read once: sizes and records are two views of the same headers
    return restored(materialize(read_archive(pages.sparkSession, path)))
