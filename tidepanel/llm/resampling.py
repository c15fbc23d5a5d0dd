"""Drawing the documents most like a target set: hashed n-gram importance weights with Gumbel noise.

Texts stay in their Arrow buffers.  A table classifies every byte, differences of the classes are the word borders, and the
CRCs of all words of a slice advance together, one byte of each at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, release, small_batches, without

BUCKETS = 10_000
SLICE = 1 << 20  # bytes that are worked on at once
LONG = 48  # bytes; the CRC of a longer word is taken alone

#: Lower-case of each byte, A-Z alone.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Whether a byte belongs to a word: digits, letters and all of a character outside ASCII.
IN_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _crc_table() -> np.ndarray:
    """One step of CRC-32 for each byte, by its reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


STEP = _crc_table()


def advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC registers (not yet inverted) after ``size`` bytes of ``data`` from ``start`` each, all words at once."""
    order = np.argsort(-size, kind="stable")
    at, left, reg = start[order], size[order], state[order]
    alone = int(np.searchsorted(-left, -LONG))  # words over LONG bytes
    for i in range(alone):
        reg[i] = zlib.crc32(data[at[i] : at[i] + left[i]], int(reg[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    longest = int(left[alone]) if alone < len(left) else 0
    for j in range(longest):
        k = int(np.searchsorted(-left, -j))  # words with a byte at j
        r = reg[alone:k]
        reg[alone:k] = STEP[(r ^ data[at[alone:k] + j]) & 255] ^ (r >> np.uint32(8))
    out = np.empty_like(reg)
    out[order] = reg
    return out


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow array of strings, without a copy; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def features(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, bucket, words of each feature: 1 or 2) of each feature, a slice of the texts at a time.

    A slice ends where a word does, and hands its last word's register on, so a text of any length is many slices.
    """
    data, at = text_buffers(texts)
    a, stop = int(at[0]), int(at[-1])
    last_doc, last_reg = -1, np.zeros(1, np.uint32)
    while a < stop:
        b = min(a + SLICE, stop)
        while b < stop and IN_WORD[data[b - 1]]:  # up to the end of a word that the border cuts, wherever that is
            more = np.flatnonzero(~IN_WORD[data[b : b + SLICE]])
            b = b + int(more[0]) + 1 if len(more) else min(b + SLICE, stop)
        part = LOWER[data[a:b]]
        word = IN_WORD[part]
        begins = np.zeros(b - a + 1, bool)  # of documents
        inside = at[np.searchsorted(at, a) : np.searchsorted(at, b, "right")]
        begins[inside - a] = True
        before = np.concatenate(([False], word))  # of the byte before each place
        here = np.concatenate((word, [False]))
        start = np.flatnonzero(here & (~before | begins))
        end = np.flatnonzero(before & (~here | begins))
        if len(start):
            doc = np.searchsorted(at, start + a, "right") - 1
            size = end - start
            reg = advance(np.full(len(start), 0xFFFFFFFF, np.uint32), part, start, size)
            yield doc, (reg ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets), np.ones(len(start), np.int8)
            first = np.concatenate(([last_doc], doc[:-1]))
            pair = np.flatnonzero(first == doc)
            if len(pair):
                head = np.concatenate((last_reg, reg[:-1]))[pair]
                head = STEP[(head ^ np.uint32(32)) & 255] ^ (head >> np.uint32(8))  # the space
                both = advance(head, part, start[pair], size[pair])
                yield doc[pair], (both ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets), np.full(len(pair), 2, np.int8)
            last_doc, last_reg = int(doc[-1]), reg[-1:]
        a = b


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts, counted in each task before they are added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, bucket, _ in features(b.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])

    small_batches(docs.sparkSession)
    parts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: how much more the target's texts use it than ``docs``, in thousandths of a logarithm."""
    s, t = (materialize(bucket_counts(x, text_col, buckets)) for x in (docs, target))
    def all_of(x: DataFrame) -> DataFrame:
        return x.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("all"))

    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = every.join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    rows = rows.join(F.broadcast(all_of(s).withColumnRenamed("all", "s_all"))).join(F.broadcast(all_of(t).withColumnRenamed("all", "t_all")))  # a row each
    ratio = ((F.col("t") + 1).cast("double") * (F.col("s_all") + buckets)) / ((F.col("s") + 1).cast("double") * (F.col("t_all") + buckets))
    return rows.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def _weigher(gains: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces the last column, texts, by words, n_features and weight; all others pass as they are."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n, total = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for doc, bucket, words in features(b.column(b.num_columns - 1), len(gains)):
                first, last = int(doc[0]), int(doc[-1]) + 1
                found = np.bincount(doc - first, minlength=last - first)
                n[first:last] += found
                if words[0] == 1:
                    n_words[first:last] += found
                # whole numbers far below 2 ** 53, so adding them as doubles is exact
                total[first:last] += np.bincount(doc - first, weights=gains[bucket], minlength=last - first).astype(np.int64)
            weight = np.floor_divide(total, np.maximum(n, 1))
            kept = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words), pa.array(n), pa.array(weight)], [*b.schema.names[:-1], "n_words", "n_features", "weight"])

    return weigh


def weighted_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """``docs`` with n_words, n_features, weight and score of every document: weight plus Gumbel noise of its id.

    Null and empty texts have no features and weigh 0; a null id has the noise of an empty one.  Rows equal in id and text
    are scored alike.  Texts are read whole, in slices.  Columns of these names are replaced, all others pass through
    unread.  The gains are one number a bucket, whatever the corpus.
    """
    spark = docs.sparkSession
    docs = without(docs, "n_words", "n_features", "weight", "score")
    gains = np.zeros(buckets, np.float64)
    for r in bucket_gains(docs, target, text_col, buckets).toLocalIterator():
        gains[r.bucket] = r.gain
    row, text = fresh(docs, "row", "body")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(f"`{text_col}`").cast("string").alias(text))
    small_batches(spark)
    schema = f"`{row}` {packed.schema[0].dataType.simpleString()}, n_words long, n_features long, weight long"
    out = packed.mapInArrow(_weigher(gains), schema)
    return out.select(f"{row}.*", "n_words", "n_features", "weight", (F.col("weight") + noise(out[row][id_col], seed)).alias("score"))


def noise(name: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the SHA-256 of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(name.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, percent: int = 25, id_col: str = "doc_id", min_words: int = 20) -> DataFrame:
    """``scored`` with rank: 1, 2, 3... for the ``percent`` of highest scores among rows of ``min_words`` or more, else null.

    Ties go to the smaller id, null ids last, then by row hash.  Scores are whole numbers, so counts by score find the lowest
    score drawn; rows from there on are range-sorted over the cluster, and each range's ranks begin after the rows
    of those before it.  Rows that tie in score and id are spread over ranges by their hash and a salt.
    """
    spark = scored.sparkSession
    rank, part, salt = fresh(without(scored, "rank"), "rank", "part", "salt")
    scored = without(scored, "rank")
    able = F.col("n_words") >= min_words
    n = scored.where(able).count()
    k = percent * n // 100
    none = F.lit(None).cast("long").alias(rank)
    if not k:
        return scored.select("*", none)
    by_score = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # distinct scores are bounded by their range, some ten thousands, not by the rows
    upto = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score")))
    cut = by_score.select("score", upto.alias("upto")).where(F.col("upto") >= k).agg(F.max("score")).first()[0]
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.asc(salt)]
    high = scored.where(able & (F.col("score") >= cut)).select("*", F.xxhash64(*[c for c, t in scored.dtypes if not t.startswith("map")], F.monotonically_increasing_id()).alias(salt))
    ranged = materialize(high.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).select("*", F.spark_partition_id().alias(part)))
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(part, (F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy(part)) - F.col("n")).alias("__offset"))  # a row for each partition
    placed = ranged.join(F.broadcast(offsets), part).select("*", (F.row_number().over(Window.partitionBy(part).orderBy(*order)) + F.col("__offset")).cast("long").alias("__rank"))
    cols = [F.col(f"`{c}`") for c in scored.columns]
    drawn = placed.select(*cols, F.when(F.col("__rank") <= k, F.col("__rank")).alias(rank))
    return scored.where(F.coalesce(~(able & (F.col("score") >= cut)), F.lit(True))).select(*cols, none).unionByName(drawn)


def op12_importance_resampling(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document (see :func:`weighted_documents`, :func:`draw`)."""
    scored = materialize(weighted_documents(docs.select("doc_id", "text"), benchmark).select("doc_id", "n_words", "n_features", "weight", "score"))
    return draw(scored).drop("n_words")
