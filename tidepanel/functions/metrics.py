"""Exact ranking metrics and drift, grouped, without collecting scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .quantiles import exact_quantiles


def by_score(df: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """One row for each group and distinct score, with tp and fp at a threshold of that score.

    Null scores are left out.  Sums run in descending order within the group.
    """
    s = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    return s.select(*keys, F.col(score).alias("thr"), "pos", "n", F.sum("pos").over(down).alias("tp"), F.sum(F.col("n") - F.col("pos")).over(down).alias("fp"), F.sum("pos").over(every).alias("all_pos"), F.sum(F.col("n") - F.col("pos")).over(every).alias("all_neg"))


def average_precision(df: DataFrame, keys: list[str], **cols) -> DataFrame:
    """Sum of precision times gain in recall over distinct scores; null for a group of one class."""
    s = by_score(df, keys, **cols)
    gain = F.try_divide(F.col("pos"), F.col("all_pos")) * F.col("tp") / (F.col("tp") + F.col("fp"))
    return s.groupBy(*keys).agg(F.when((F.first("all_pos") > 0) & (F.first("all_neg") > 0), F.sum(gain)).alias("ap"))


def average_precision_of_many(df: DataFrame, keys: list[str], y: str = "y", score: str = "score", parts: int = 32) -> DataFrame:
    """:func:`average_precision` for groups whose distinct scores are too many for one task; groups themselves are few.

    Approximate quantiles cut each group's scores into ``parts`` ranges.  Sums of whole ranges, a row for each group and range,
    give every range what lies above it; within ranges the sums run in tasks of their own.  The result is exact, ties included.
    """
    s = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    s = materialize(s)
    cuts = F.percentile_approx(score, F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(1000)).alias("cuts")
    cut = s.join(F.broadcast(s.groupBy(*keys).agg(cuts)), keys)  # a row for each group
    cut = cut.select(*keys, score, "pos", "n", F.size(F.filter("cuts", lambda c: c < F.col(score))).alias("part"))
    whole = cut.groupBy(*keys, "part").agg(F.sum("pos").alias("p"), F.sum("n").alias("q"))
    above = Window.partitionBy(*keys).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    none = F.lit(0)
    whole = whole.select(*keys, "part", F.coalesce(F.sum("p").over(above), none).alias("pos_above"), F.coalesce(F.sum("q").over(above), none).alias("n_above"), F.sum("p").over(every).alias("all_pos"), F.sum("q").over(every).alias("all_n"))
    down = Window.partitionBy(*keys, "part").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    x = cut.join(F.broadcast(whole), [*keys, "part"]).select(*keys, "pos", "all_pos", "all_n", (F.sum("pos").over(down) + F.col("pos_above")).alias("tp"), (F.sum("n").over(down) + F.col("n_above")).alias("alarms"))
    gain = F.try_divide(F.col("pos"), F.col("all_pos")) * F.col("tp") / F.col("alarms")
    return x.groupBy(*keys).agg(F.when((F.first("all_pos") > 0) & (F.first("all_n") > F.first("all_pos")), F.sum(gain)).alias("ap"))


def roc_auc(df: DataFrame, keys: list[str], **cols) -> DataFrame:
    """Mann-Whitney statistic with ties counting half; null for a group of one class."""
    s = by_score(df, keys, **cols)
    # negatives below this score, and half of those that tie
    below = F.col("pos") * (F.col("all_neg") - F.col("fp") + (F.col("n") - F.col("pos")) / 2)
    return s.groupBy(*keys).agg(F.when((F.first("all_pos") > 0) & (F.first("all_neg") > 0), F.sum(below) / F.first("all_pos") / F.first("all_neg")).alias("auc"))


def best_threshold(df: DataFrame, keys: list[str], metric: str = "f1", precision_target: float = 0.5, **cols) -> DataFrame:
    """Lowest threshold that is best by f1, f2 or precision_target (else the highest threshold)."""
    s = by_score(df, keys, **cols).select("*", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide(F.col("tp"), F.col("all_pos")).alias("recall"))
    if metric == "precision_target":
        ok = F.min(F.when(F.col("precision") >= precision_target, F.col("thr")))
        return s.groupBy(*keys).agg(F.coalesce(ok, F.max("thr")).alias("threshold"))
    b = {"f1": 1, "f2": 4}[metric]
    f = F.coalesce(F.try_divide((1 + b) * F.col("precision") * F.col("recall"), b * F.col("precision") + F.col("recall")), F.lit(0.0))
    return s.groupBy(*keys).agg(F.when(F.first("all_pos") > 0, F.max_by("thr", F.struct(F.round(f, 12), -F.col("thr")))).otherwise(F.max("thr") + 1e-9).alias("threshold"))


def confusion(keys: list[str], df: DataFrame, y: str = "y", score: str = "score", threshold: Column | str = "threshold") -> DataFrame:
    """Counts and rates of alarms; a null score is no alarm.  Rates are null where they mean nothing."""
    a = F.coalesce(F.col(score) >= (F.col(threshold) if isinstance(threshold, str) else threshold), F.lit(False))
    pos = F.col(y) == 1
    c = df.groupBy(*keys).agg(F.sum((a & pos).cast("long")).alias("tp"), F.sum((a & ~pos).cast("long")).alias("fp"), F.sum((~a & pos).cast("long")).alias("fn"), F.count(F.lit(1)).alias("n"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(*keys, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"), (1 - p).alias("far"), ((F.col("tp") + F.col("fp")) / F.col("n")).alias("alarm_rate"))


def psi(df: DataFrame, feature: str, expected: Column, bins: int = 10, least: int = 100) -> DataFrame:
    """One row: population stability index of ``feature`` between rows where ``expected`` holds and the others.

    Bins are between distinct quantiles of the expected values; actual ones are clipped into their range, shares
    floored at 1e-4.  Null with fewer than ``least`` values on a side, 0 with fewer than three edges.
    """
    d = df.where(F.col(feature).isNotNull()).select(F.col(feature).alias("x"), expected.alias("e"))
    q = exact_quantiles(d.where("e"), [], "x", tuple(i / bins for i in range(bins + 1))).select(F.array_sort(F.array_distinct("q")).alias("edges"))
    edges = d.agg(F.sum(F.col("e").cast("long")).alias("ne"), F.sum((~F.col("e")).cast("long")).alias("na")).join(F.broadcast(q), F.lit(True), "left")  # a row each
    last = F.size("edges") - 1
    x = F.greatest(F.element_at("edges", 1), F.least(F.element_at("edges", -1), F.col("x")))
    b = d.crossJoin(F.broadcast(edges)).select("*", F.least(last - 1, F.size(F.filter("edges", lambda v: v <= x)) - 1).alias("bin"))
    c = b.groupBy("bin").agg(F.sum(F.col("e").cast("long")).alias("ce"), F.sum((~F.col("e")).cast("long")).alias("ca"))
    every = edges.select("edges", "ne", "na", F.explode(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0)))).alias("bin")).join(c, "bin", "left")
    pe = F.greatest(F.lit(1e-4), F.try_divide(F.coalesce("ce", F.lit(0)), F.col("ne")))
    pa = F.greatest(F.lit(1e-4), F.try_divide(F.coalesce("ca", F.lit(0)), F.col("na")))
    value = F.sum((pa - pe) * F.ln(pa / pe))
    return every.agg(F.when((F.first("ne") >= least) & (F.first("na") >= least), F.when(F.first(F.size("edges")) < 3, 0.0).otherwise(value)).alias("psi"))


def psi_band(value: Column) -> Column:
    """stable up to 0.1, moderate up to 0.25, else drifted; null stays null."""
    return F.when(value <= 0.1, "stable").when(value <= 0.25, "moderate").when(value.isNotNull(), "drifted")


def dependence(df: DataFrame, feature: str, value: str, bins: int = 25) -> DataFrame:
    """(bin, n, x, mean): mean ``value`` in equal bins of ``feature`` between its 1st and 99th percentile, others clipped into them."""
    d = df.where(F.col(feature).isNotNull() & F.col(value).isNotNull()).select(F.col(feature).cast("double").alias("x"), F.col(value).cast("double").alias("v"))
    ends = exact_quantiles(d, [], "x", (0.01, 0.99)).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    x = F.greatest("low", F.least("high", "x"))
    place = F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide(x - F.col("low"), F.col("high") - F.col("low")) * bins)), F.lit(0)).cast("int")
    return d.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("x"), F.avg("v").alias("mean"))


def fold_statistics(df: DataFrame, fold: str, model: str, value: str, against: str) -> DataFrame:
    """(model, mean, sd, least, most, share_won) of a metric over folds; won: above the model ``against`` in the same fold."""
    other = df.where(F.col(model) == against).select(fold, F.col(value).alias("rival"))
    won = F.when(F.col("rival").isNotNull() & F.col(value).isNotNull(), (F.col(value) > F.col("rival")).cast("int"))
    return df.join(other, fold, "left").groupBy(model).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(won).alias("share_won"))
