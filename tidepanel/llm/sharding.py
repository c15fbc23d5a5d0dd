"""Reproducible shuffle into shards by a Feistel permutation with cycle walking.  DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, without

ROUNDS = 4


def _permuted(x: Column, left: int, right: int, seed: int) -> Column:
    """One pass of an unbalanced Feistel network on Z_left x Z_right: a bijection of [0, left * right)."""
    r = x % F.lit(right)
    l = ((x - r) / F.lit(right)).cast("long")  # exact: x is below 2^53
    for k in range(ROUNDS):
        if k % 2 == 0:
            l = (l + F.pmod(F.xxhash64(F.lit(seed + k), r), F.lit(left))) % F.lit(left)
        else:
            r = (r + F.pmod(F.xxhash64(F.lit(seed + k), l), F.lit(right))) % F.lit(right)
    return l * F.lit(right) + r


def _sides(n: int) -> tuple[int, int]:
    left = max(1, math.isqrt(n - 1) + 1)
    return left, -(-n // left)


def walk_length(spark: SparkSession, n: int, seed: int) -> int:
    """Passes that bring every number below ``n`` back below ``n``.

    Only walks through the surplus [n, left * right) (fewer than sqrt(n) + 1 numbers) need more than one
    pass, so those alone are followed.
    """
    left, right = _sides(n)
    steps, front = 1, spark.range(n, left * right).select(F.col("id").cast("long").alias("x"))
    while front.limit(1).count():
        steps += 1
        front = materialize(front.select(_permuted(F.col("x"), left, right, seed).alias("x")).where(F.col("x") >= n))
    return steps


def permute(x: Column, n: int, steps: int, seed: int) -> Column:
    """Where row number ``x`` of ``n`` goes: passes are repeated while they lead outside [0, n)."""
    left, right = _sides(n)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), x,
        lambda at, k: F.when((k > 1) & (at < n), at).otherwise(_permuted(at, left, right, seed)),
    )


def assign_shards(df: DataFrame, n_shards: int = 16, seed: int = 7, rows_a_bucket: int = 65536) -> DataFrame:
    """Deal all rows of ``df`` over ``n_shards``: adds shard (int) and slot (long, gapless from 0 in a shard).

    Shard sizes differ by one row at most (law "rows").  A row's global number is its place in the order
    (hash bucket, hash, all columns); hash-bucket counts, a table of at most 65536 rows, give each bucket
    its first number, and no order over the whole table is needed.  Equal rows are grouped first, so a row
    repeated without end is one row with a count until its numbers are dealt out in chunks.  The same rows
    give the same result on every run, in any physical order.

    Nulls are values like any other, and texts of any length are hashed whole.  Columns named shard or slot are replaced,
    all others pass through, whatever their names.  An empty table gives none.  Columns of map type can't be grouped and aren't supported.
    """
    spark, rows = df.sparkSession, without(df, "shard", "slot")
    cols = [F.col(f"`{c}`") for c in rows.columns]
    # The number of buckets follows the row count, which for files comes from their footers.
    n = rows.count()
    if not n:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    buckets = min(65536, max(256, 1 << math.ceil(math.log2(max(1, n / rows_a_bucket)))))
    h, bucket, many, start, first, at, number, place = fresh(rows, "hash", "bucket", "many", "start", "first", "at", "number", "place")
    keyed = rows.select(*cols, F.xxhash64(*cols).alias(h)).select("*", F.pmod(h, F.lit(buckets)).alias(bucket))
    counts = materialize(keyed.groupBy(bucket).agg(F.count(F.lit(1)).alias(many)))
    total, most = counts.agg(F.sum(many), F.max(many)).first()
    starts = counts.select(bucket, (F.sum(many).over(Window.orderBy(bucket)) - F.col(many)).alias(start))
    grouped = keyed.groupBy(bucket, h, *cols).agg(F.count(F.lit(1)).alias(many))
    w = Window.partitionBy(bucket).orderBy(h, *cols).rowsBetween(Window.unboundedPreceding, -1)
    placed = grouped.select("*", F.coalesce(F.sum(many).over(w), F.lit(0)).alias(at)).join(F.broadcast(starts), bucket)
    placed = placed.select(*cols, many, (F.col(start) + F.col(at)).alias(first))

    def dealt(part: DataFrame) -> DataFrame:
        return part.select(*cols, F.explode(F.sequence(F.col(first), F.col(first) + F.col(many) - 1)).alias(number))

    if most <= 4 * total / buckets + rows_a_bucket:
        numbered = dealt(placed)
    else:  # some row is repeated very often: its numbers go out in chunks, over all tasks
        heavy = placed.where(F.col(many) > 4096)
        chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1, F.lit(4096).cast("long"))).alias(at)
        heavy = heavy.select(*cols, many, first, chunk).select(*cols, F.least(F.lit(4096).cast("long"), F.col(many) - F.col(at)).alias(many), (F.col(first) + F.col(at)).alias(first))
        numbered = dealt(placed.where(F.col(many) <= 4096)).unionByName(dealt(heavy.repartition(max(8, int(n // 1_000_000)), first)))
    steps = walk_length(spark, total, seed)
    moved = numbered.select(*cols, permute(F.col(number), total, steps, seed).alias(place))
    return moved.select(*cols, (F.col(place) % n_shards).cast("int").alias("shard"), F.floor(F.col(place) / n_shards).cast("long").alias("slot"))


def op1_sharding(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Digest of :func:`assign_shards` over documents: size is UTF-8 bytes + 1 (null text: 1, CRC of nothing)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign_shards(narrow, n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
