"""Mixing sources to target weights by hash-random order and distributed prefix sums.  DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, folded, materialize

WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """(skey, source_size) -> + target.  ``sizes`` has a narrow row per source; one task orders them, hosts as sources too.

    Sources in code-point order, null last, get the weights in turn.  All want ``share`` of the whole; none
    gets over ``cap`` times its size, and what is over goes to the others by weight.  The result of that
    resharing is a water level: in order of cap / weight the sources are full up to some place and the
    others have level times weight.  All sums are integers, so the result doesn't depend on their order.
    """
    everything = Window.partitionBy(F.lit(1))
    by_name = everything.orderBy(F.col("skey").startswith("n"), "skey")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("skey", "source_size", pick.cast("long").alias("w"))
    ratio = everything.orderBy(F.col("source_size") / F.col("w"), "skey")
    upto = ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.select(
        "*", (F.lit(cap).cast("long") * F.col("source_size")).alias("most"),
        (F.sum("source_size").over(everything) * F.lit(share)).alias("all"),
        (F.sum("w").over(everything) - F.sum("w").over(upto) + F.col("w")).alias("w_left"),
        (F.lit(cap).cast("long") * (F.sum("source_size").over(upto) - F.col("source_size"))).alias("full"),
    )
    # level if this source and all after it were open; it is full where that level is over its cap
    level = (F.col("all") - F.col("full")) / F.col("w_left")
    s = s.select("*", (level * F.col("w") >= F.col("most")).alias("capped"), level.alias("level"))
    open_level = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("w"), "skey", "level"))).over(everything)["level"]
    return s.select("skey", "source_size", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(open_level * F.col("w")).alias("target"))


def plan_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, seed: int = 17, size: str | None = None, often: int = 4096) -> DataFrame:
    """(row, size, source_size, target, epochs, rest): what the mix takes of every row of ``df``, which is a struct here.

    Rows get a hash-random key from their id; within a source they are range-sorted by it.  Sums by
    (source, key range) and prefix sums over those ranges give every range its offset, and a running sum in
    the range gives the words before each row.  Every source is taken whole ``epochs`` times, then once more
    up to its exact budget; the row at the cut gives its first ``rest`` words.  A hot source is many ranges; an
    id (or none) that more than ``often`` rows have gets ranges of its own by text, and a row repeated
    more than ``often`` times is placed as one and dealt out again.  ``size`` names a column of sizes, else words are counted.

    Null text: size 0.  Null source: a source of its own, last in order.  Null and repeated ids share a key
    and are ordered by text.  Other columns pass through in ``row``, whatever their names.  A text of any length is one
    row.  Empty table: empty result.
    """
    n = df.count()
    digits = max(2, min(5, math.ceil(math.log(max(n, 1) / 2**20, 16)) + 2)) if n else 2
    rows = folded(df, often)
    name, text, source = (F.col("row")[c] for c in (id_col, text_col, source_col))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(name.cast("string"), F.lit(""))).cast("binary"))
    words = n_words(text) if size is None else F.col("row")[size]
    rows = rows.select("row", "times", words.alias("size"), F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("n")).alias("skey"), key.alias("key"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")).alias("by_text"))
    busy = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > often).select("key", F.lit(True).alias("busy")))
    if busy.limit(1).count():
        # behind the other rows of the range that the key lies in: "~" is over all digits
        own = F.concat(F.substring("key", 1, digits), F.lit("~"), "key", F.substring("by_text", 1, digits))
        rows = rows.join(busy, "key", "left").withColumn("range", F.when(F.col("busy"), own).otherwise(F.substring("key", 1, digits))).drop("busy")
    else:
        rows = rows.withColumn("range", F.substring("key", 1, digits))
    ranges = rows.groupBy("skey", "range").agg(F.sum(F.col("size") * F.col("times")).alias("sum"))
    before = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = ranges.select("skey", "range", (F.sum("sum").over(before) - F.col("sum")).alias("offset"))
    targets = source_targets(ranges.groupBy("skey").agg(F.sum("sum").alias("source_size")), weights, share, cap)
    w = Window.partitionBy("skey", "range").orderBy("key", name, "by_text", F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.col("size") * F.col("times")
    placed = rows.select("row", "times", "size", "skey", "range", (F.sum(whole).over(w) - whole).alias("before"))
    placed = placed.join(offsets.join(targets, "skey"), ["skey", "range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    placed = placed.select("*", epochs.alias("epochs"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("copy"))
    budget = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    rest = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - F.col("offset") - F.col("before") - F.col("copy") * F.col("size")))
    return placed.select("row", "size", "source_size", "target", "epochs", rest.alias("rest"))


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word."""
    cut = F.concat(F.lit(r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){"), n.cast("string"), F.lit("}+"))  # possessive: no stack
    return F.rtrim(F.regexp_substr(text, cut))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken, cut at the budget (:func:`plan_mix`)."""
    copies = F.col("epochs") + F.when(F.col("rest") > 0, 1).otherwise(0)
    taken = plan_mix(docs, **options).where(copies > 0).select("row", "size", "rest", "epochs", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"))
    cut = (F.col("copy") > F.col("epochs")) & (F.col("rest") < F.col("size"))
    taken = taken.select("row", F.when(cut, first_words(F.col("row.text"), F.col("rest"))).otherwise(F.col("row.text")).alias("text"), cut.alias("cut"))

    def out(c: str) -> Column:
        old = F.col("row")[c]
        if c == "text":
            return F.col("text")
        return F.when(F.col("cut"), F.length("text")).otherwise(old).cast("long").alias(c) if c == "n_chars" else old.alias(c)

    return taken.select(*[out(c) for c in docs.columns])


def op4_mixing(docs: DataFrame) -> DataFrame:
    """Digest of :func:`plan_mix` over documents."""
    narrow = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "source", n_words(F.col("text")).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text"))
    p = plan_mix(narrow, size="size")
    return p.select("row.doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
c AS (SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5 AS everything,
             (sum(w) OVER () - sum(w) OVER o + w)::DOUBLE AS w_left,
             (2 * (sum(source_size) OVER o - source_size))::DOUBLE AS filled
      FROM s WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (everything - filled) / w_left AS level, (everything - filled) / w_left * w >= 2 * source_size AS capped FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN (2 * source_size)::DOUBLE
             ELSE arg_min(level, source_size::DOUBLE / w) FILTER (NOT capped) OVER () * w END AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('17:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken FROM p
"""
