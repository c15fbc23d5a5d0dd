"""Exact quantiles whose state doesn't grow with the rows: values are counted by range, and only the ranges that hold a quantile are looked into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, release

CUTS = 256
FEW = 4096  # distinct values that one window may order


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: tuple[float, ...], cuts: int = CUTS, few: int = FEW) -> DataFrame:
    """(keys, q): for each group an array of the quantiles ``probs`` of ``value``, with linear interpolation; groups and probs are few.

    Equal values are counted first, which the map stage does for the most part.  Then each group's values are cut into ranges by approximate
    quantiles, whose errors don't matter: exact counts of the ranges tell which of them hold the ranks asked for, and only these are
    kept and cut again, until a range has at most ``few`` distinct values, which a window orders.  A round leaves some 1 / ``cuts`` of the
    rows for each rank.  Null values don't count; a group without values has no row; keys must not be null.
    """
    names = keys or ["__all"]
    base = df.where(F.col(value).isNotNull()).select(*keys, *([] if keys else [F.lit(1).alias("__all")]), F.col(value).cast("double").alias("__x"))
    now = materialize(base.groupBy(*names, "__x").agg(F.count(F.lit(1)).alias("__n")).select("*", F.lit("").alias("__cell")))
    at = [(F.col("__total") - 1) * F.lit(float(p)) for p in probs]
    totals = now.groupBy(*names).agg(F.sum("__n").alias("__total")).select(*names, *[a.alias(f"__at{i}") for i, a in enumerate(at)])
    totals = materialize(totals)
    ranks = F.array_distinct(F.array(*[f(F.col(f"__at{i}")).cast("long") for i in range(len(probs)) for f in (F.floor, F.ceil)]))
    wanted = materialize(totals.select(*names, F.lit("").alias("__cell"), F.explode(ranks).alias("__rank")).select("*", F.col("__rank").alias("__left")))
    cell = [*names, "__cell"]
    while (now.groupBy(*cell).count().agg(F.max("count")).first()[0] or 0) > few:
        ask = F.percentile_approx("__x", F.array(*[F.lit(k / cuts) for k in range(1, cuts)]), F.lit(4 * cuts)).alias("__cuts")
        split = now.join(F.broadcast(now.groupBy(*cell).agg(ask)), cell).select(*cell, "__x", "__n", F.size(F.filter("__cuts", lambda c: c < F.col("__x"))).alias("__part"))
        sums = split.groupBy(*cell, "__part").agg(F.sum("__n").alias("__sum"))
        upto = F.sum("__sum").over(Window.partitionBy(*cell).orderBy("__part"))
        spans = sums.select(*cell, "__part", upto.alias("__upto"), (upto - F.col("__sum")).alias("__before"))
        name = F.concat("__cell", F.lit("."), F.col("__part").cast("string")).alias("__cell")
        found = materialize(wanted.join(spans, cell).where((F.col("__left") >= F.col("__before")) & (F.col("__left") < F.col("__upto"))).select(*names, name, "__rank", (F.col("__left") - F.col("__before")).alias("__left")))
        kept = materialize(split.select(*names, "__x", "__n", name).join(F.broadcast(found.select(*cell).distinct()), cell, "left_semi"))  # a row for each group and rank
        release(now, wanted)
        now, wanted = kept, found
    order = Window.partitionBy(*cell).orderBy("__x")
    placed = now.select(*cell, "__x", "__n", F.sum("__n").over(order).alias("__upto"))
    hit = wanted.join(placed, cell).where((F.col("__left") < F.col("__upto")) & (F.col("__left") >= F.col("__upto") - F.col("__n")))
    values = hit.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__x"))).alias("__v"))  # two ranks for each quantile at most

    def one(i: int) -> Column:
        a = F.col(f"__at{i}")
        low, high = F.floor(a).cast("long"), F.ceil(a).cast("long")
        x, y = F.col("__v")[low], F.col("__v")[high]
        return F.when(low == high, x).otherwise((high - a) * x + (a - low) * y)

    return totals.join(values, names).select(*keys, F.array(*[one(i) for i in range(len(probs))]).alias("q"))
