"""Reports over panels and predictions: completeness, categories, success criteria, a case, differences by period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from .events import event_detection
from .panel import SERIES


def completeness(obs: DataFrame, years: list[int]) -> DataFrame:
    """(price_type_id, y<year> ...): share of cells with a price, by price type and year; null where a type has no cells.

    A type's cells are its days with any price times its series with any price.  Provinces count, the national series doesn't.
    """
    one = obs.where("province_id > 0 and price is not null").groupBy("price_type_id", *SERIES, "date").agg(F.lit(1).alias("seen"))
    series = one.groupBy("price_type_id").agg(F.count_distinct(*SERIES).alias("series"))
    cells = obs.where("price is not null").select("price_type_id", "date").distinct().groupBy("price_type_id", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("days"))
    filled = one.groupBy("price_type_id", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    # cells are counted, not made: days of a year times series of a type
    share = F.coalesce("n", F.lit(0)) / (F.col("days") * F.col("series"))
    x = cells.join(series, "price_type_id").join(filled, ["price_type_id", "year"], "left").select("price_type_id", F.concat(F.lit("y"), F.col("year").cast("string")).alias("year"), share.alias("share"))
    return x.groupBy("price_type_id").pivot("year", [f"y{y}" for y in years]).agg(F.first("share"))


def by_category(pred: DataFrame, events: DataFrame, categories: DataFrame, horizon: int = 14) -> DataFrame:
    """(cat_id, n, pos_rate, pr_auc, n_events, event_detection_rate, median_lead_days) of (series, date, y, score, threshold).

    Categories without events in scope stay, with 0 events and null shares.  ``categories`` is (commodity_id, cat_id), a dimension.
    """
    x = pred.join(categories, "commodity_id")
    rows = x.groupBy("cat_id").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("pos_rate"))
    found = event_detection(pred, events, horizon).join(categories, "commodity_id").groupBy("cat_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.avg(F.col("detected").cast("int")).alias("event_detection_rate"), F.percentile("lead_days", F.lit(0.5)).alias("median_lead_days"))  # leads are 1 to horizon
    ap = metrics.average_precision(x, ["cat_id"]).withColumnRenamed("ap", "pr_auc")
    return rows.join(ap, "cat_id", "left").join(found, "cat_id", "left").select("cat_id", "n", "pos_rate", "pr_auc", F.coalesce("n_events", F.lit(0)).alias("n_events"), "event_detection_rate", "median_lead_days")


def success_criteria(table: DataFrame, model: str, against: str = "naive", ratio: float = 1.5, detected: float = 0.6, lead: float = 7.0) -> DataFrame:
    """(criterion, target, result, met): what was asked of ``model``, held against a comparison of models.

    Criteria are pr_auc_ratio, better_than_all (the least lead over another model), event_detection_rate, median_lead_days, and far and
    false_episodes_per_series_year, which need only be known.  A result that is null isn't met.
    """
    def of(column: str, key: str):
        return F.max(F.when(F.col("key") == key, F.col(column)))

    best = F.max(F.when(F.col("key") != model, F.col("pr_auc")))
    one = table.agg(of("pr_auc", model).alias("ap"), of("pr_auc", against).alias("base"), best.alias("best"), *[of(c, model).cast("double").alias(c) for c in ("event_detection_rate", "median_lead_days", "far", "false_episodes_per_series_year")])
    rows = [
        ("pr_auc_ratio", F.lit(ratio), F.try_divide("ap", "base"), lambda x: x >= ratio),
        ("better_than_all", F.lit(0.0), F.col("ap") - F.col("best"), lambda _: F.col("ap") > F.col("best")),
        ("event_detection_rate", F.lit(detected), F.col("event_detection_rate"), lambda x: x >= detected),
        ("median_lead_days", F.lit(lead), F.col("median_lead_days"), lambda x: x >= lead),
        *[(c, F.lit(None).cast("double"), F.col(c), lambda x: x.isNotNull()) for c in ("far", "false_episodes_per_series_year")],
    ]
    each = F.array(*[F.struct(F.lit(n).alias("criterion"), t.alias("target"), r.alias("result"), F.coalesce(ok(r), F.lit(False)).alias("met")) for n, t, r, ok in rows])
    return one.select(F.explode(each).alias("r")).select("r.*")


def case_study(pred: DataFrame, events: DataFrame, panel: DataFrame, commodities: list[str], since: str, least_lead: int = 7, before: int = 60, after: int = 30, horizon: int = 14) -> DataFrame:
    """(series, onset, first_alarm, date, price, score, threshold, is_alarm): days around one real event.

    The event is the one of the largest rise among those of ``commodities`` from ``since`` + ``horizon`` on that were seen ``least_lead`` days ahead or
    more; ties go to the earliest, then the smallest series.  No rows if there is none.  Only the one event's series is joined, by a broadcast row.
    """
    seen = event_detection(pred, events, horizon).where((F.col("date") >= F.date_add(F.lit(since).cast("date"), horizon)) & F.col("detected") & (F.col("lead_days") >= least_lead) & F.col("commodity_id").isin(*commodities))
    found = seen.join(events.select(*SERIES, "date", "peak_rise_30d"), [*SERIES, "date"]).orderBy(F.desc_nulls_last("peak_rise_30d"), "date", *SERIES).limit(1)
    case = found.select(*SERIES, F.col("date").alias("onset"), F.date_sub("date", F.col("lead_days")).alias("first_alarm"))
    days = panel.select(*SERIES, "date", "price").join(F.broadcast(case), SERIES).where((F.col("date") >= F.date_sub("onset", before)) & (F.col("date") <= F.date_add("onset", after)))
    scores = pred.select(*SERIES, "date", "score", "threshold").join(F.broadcast(case.select(*SERIES)), SERIES)
    x = days.join(scores, [*SERIES, "date"], "left")
    return x.select(*SERIES, "onset", "first_alarm", "date", "price", "score", "threshold", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)).alias("is_alarm"))


def deltas_by_period(pred: DataFrame, model: str, period: str = "fold") -> DataFrame:
    """(variant, pr_auc, delta, mean_delta, n_won, n_periods): ``model`` less every other score_m of ``pred`` (y, period, score_m).

    ``delta`` is of all rows together; means and won periods are over those where both have an average precision, aligned by ``period``.
    """
    names = [c.removeprefix("score_") for c in pred.columns if c.startswith("score_")]
    x = pred.select(period, "y", F.explode(F.array(*[F.struct(F.lit(m).alias("variant"), F.col(f"score_{m}").alias("score")) for m in names])).alias("e")).select(period, "y", "e.*")
    whole = metrics.average_precision(x, ["variant"]).withColumnRenamed("ap", "pr_auc")
    parts = metrics.average_precision(x, ["variant", period])
    full = parts.where(F.col("variant") == model).select(period, F.col("ap").alias("full"))
    d = F.col("full") - F.col("ap")
    by = parts.where(F.col("variant") != model).join(full, period).groupBy("variant").agg(F.avg(d).alias("mean_delta"), F.sum(F.when(d > 0, 1).otherwise(0)).alias("n_won"), F.count(d).alias("n_periods"))
    best = F.max(F.when(F.col("variant") == model, F.col("pr_auc"))).over(Window.partitionBy(F.lit(1)))  # a row for each model
    return whole.select("variant", "pr_auc", (best - F.col("pr_auc")).alias("delta")).where(F.col("variant") != model).join(by, "variant", "left")
