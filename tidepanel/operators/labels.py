"""Spikes, onsets, labels and events on a dense daily panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Target
from .panel import SERIES, in_order, lag_of, numbered, rows, run_length


def thresholds(series: DataFrame, categories: DataFrame, cfg: Target) -> DataFrame:
    """(commodity_id, province_id, thr): by commodity, else by category, else the default.

    ``categories`` is (commodity_id, cat_id).  The overrides are literal maps, the joins small.
    """
    spark = series.sparkSession
    com = spark.createDataFrame(list(cfg.by_commodity.items()), "commodity_id string, by_com double")
    cat = spark.createDataFrame(list(cfg.by_category.items()), "cat_id string, by_cat double")
    s = series.select(*SERIES).distinct().join(F.broadcast(categories), "commodity_id", "left").join(F.broadcast(com), "commodity_id", "left").join(F.broadcast(cat), "cat_id", "left")
    return s.select(*SERIES, F.coalesce("by_com", "by_cat", F.lit(cfg.threshold)).alias("thr"))


def make_labels(panel: DataFrame, cfg: Target = Target(), thr: DataFrame | None = None) -> DataFrame:
    """Adds r14, spike, onset, y and eligible to a dense panel.

    A missing rise is no spike for onsets and null for spike; a series without a threshold never spikes.  y is
    null where fewer than half of the next ``horizon`` rises are known, and in the panel's last ``horizon`` days.
    """
    p = panel.join(thr, SERIES, "left") if thr is not None else panel.select("*", F.lit(cfg.threshold).alias("thr"))
    base = lag_of("price", cfg.change_days)
    p = p.select("*", F.try_divide("price", base).alias("q")).select("*", (F.col("q") - 1).alias("r14")).drop("q")
    p = p.select("*", F.when(F.col("r14").isNotNull(), F.coalesce((F.col("r14") > F.col("thr")).cast("int"), F.lit(0))).alias("spike"))
    p = p.select("*", F.coalesce("spike", F.lit(0)).alias("s0"))
    prior = F.coalesce(F.max("s0").over(rows(-cfg.cooldown, -1)), F.lit(0))
    p = p.select("*", ((F.col("s0") == 1) & (prior == 0)).cast("int").alias("onset"))
    known = F.coalesce(F.sum(F.col("r14").isNotNull().cast("int")).over(rows(1, cfg.horizon)), F.lit(0))
    last = F.max("date").over(Window.partitionBy(*SERIES))  # a dense panel: the same in all series
    y = F.when((known >= cfg.horizon / 2) & (F.col("date") <= F.date_sub(last, cfg.horizon)), F.max("onset").over(rows(1, cfg.horizon)))
    return p.select(*SERIES, "date", "price", "thr", "r14", "spike", "s0", "onset", y.alias("y"), ((F.col("spike") == 0) & F.col("price").isNotNull()).alias("eligible")).select("*").withColumn("eligible", F.coalesce("eligible", F.lit(False)))


def events_table(labels: DataFrame, cfg: Target = Target(), peak_days: int = 30) -> DataFrame:
    """One row for each onset with size and length of the spike."""
    e = numbered(labels)
    base = F.lag("price", cfg.change_days).over(in_order())
    e = e.select("*", base.alias("price_before"), F.max("price").over(rows(0, peak_days - 1)).alias("peak"), run_length("s0").alias("spike_days")).where("onset = 1")
    return e.select("date", *SERIES, F.col("r14").alias("rise_at_onset"), (F.col("peak") / F.col("price_before") - 1).alias("peak_rise_30d"), "spike_days", "price_before", F.col("price").alias("price_at_onset"))
