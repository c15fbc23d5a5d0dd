"""Queries of the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels, reports
from ..sources import fixtures as fx
from ..sources import grid_json
from ..storage import materialize
from . import export
from .model_queries import DETECT_SQL, WF_SQL, _significant, _summary_sql, compare_models, forward, marked, predictions
from .panel_queries import CAT_SQL, CATEGORIES, CELLS_SQL, NAMES_SQL, TARGET, categories, parse_price_grid, rounded
from .registry import query
from .sql import with_

STUDIED = list(range(1992, 2004))
COMPLETE_SQL = """SELECT price_type_id, {years} FROM (SELECT c.price_type_id, year, coalesce(n, 0) / (days * series) AS share
    FROM (SELECT price_type_id, year(date) AS year, count(DISTINCT date) AS days FROM obs WHERE price IS NOT NULL GROUP BY 1, 2) c
    JOIN (SELECT price_type_id, count(DISTINCT (commodity_id, province_id)) AS series FROM obs WHERE price IS NOT NULL GROUP BY 1) s USING (price_type_id)
    LEFT JOIN (SELECT price_type_id, year(date) AS year, count(price) AS n FROM obs GROUP BY 1, 2) f USING (price_type_id, year)) GROUP BY 1"""


@query("completeness_by_type_year", with_(COMPLETE_SQL.format(years=", ".join(f"round(max(share) FILTER (year = {y}), 8) AS y{y}" for y in STUDIED))))
def completeness_by_type_year(spark, d):
    return rounded(reports.completeness(fx.observations(spark, d), STUDIED), *[f"y{y}" for y in STUDIED], n=8)


AP_SQL = """SELECT {key}, CASE WHEN min(p_all) > 0 AND min(n_all) > 0 THEN sum(pos / p_all * tp / (tp + fp)) END AS ap FROM (
    SELECT *, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER (PARTITION BY {key}) AS p_all, sum(n - pos) OVER (PARTITION BY {key}) AS n_all
    FROM (SELECT {key}, score, sum(y) AS pos, count(*) AS n FROM {rows} WHERE score IS NOT NULL GROUP BY {key}, score) WINDOW w AS (PARTITION BY {key} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY {key}"""


@query("category_detection", with_(f"""SELECT cat_id, n, round(pos_rate, 8) AS pos_rate, round(ap, 6) AS pr_auc, coalesce(n_events, 0) AS n_events, round(rate, 8) AS event_detection_rate, mid AS median_lead_days
    FROM (SELECT cat_id, count(*) AS n, avg(y) AS pos_rate FROM cpred GROUP BY 1) LEFT JOIN ({AP_SQL.format(key='cat_id', rows='cpred')}) USING (cat_id)
    LEFT JOIN (SELECT {CAT_SQL} AS cat_id, count(*) AS n_events, avg(detected::INT) AS rate, median(lead_days)::DOUBLE AS mid FROM ({DETECT_SQL}) GROUP BY 1) USING (cat_id)""", cpred=f"SELECT {CAT_SQL} AS cat_id, * FROM pred"))
def category_detection(spark, d):
    x = marked(spark, d)
    out = reports.by_category(predictions(x), labels.events_table(x, TARGET), categories(spark))
    return rounded(rounded(out, "pr_auc"), "pos_rate", "event_detection_rate", n=8)


CRITERIA_SQL = """SELECT criterion, target::DOUBLE AS target, round(result, 6) AS result, coalesce(met, false) AS met FROM (
    SELECT 'pr_auc_ratio' AS criterion, 1.5 AS target, ap / nullif(base, 0) AS result, ap / nullif(base, 0) >= 1.5 AS met FROM one_
    UNION ALL SELECT 'better_than_all', 0, ap - best, ap > best FROM one_
    UNION ALL SELECT 'event_detection_rate', 0.6, rate, rate >= 0.6 FROM one_
    UNION ALL SELECT 'median_lead_days', 7, mid, mid >= 7 FROM one_
    UNION ALL SELECT 'far', NULL, far, far IS NOT NULL FROM one_
    UNION ALL SELECT 'false_episodes_per_series_year', NULL, f, f IS NOT NULL FROM one_)"""
ONE_SQL = "SELECT max(pr_auc) FILTER (key = 'seasonal') AS ap, max(pr_auc) FILTER (key = 'naive') AS base, max(pr_auc) FILTER (key <> 'seasonal') AS best, " + ", ".join(
    f"max({c}) FILTER (key = 'seasonal') AS {n}" for n, c in (("rate", "event_detection_rate"), ("mid", "median_lead_days"), ("far", "far"), ("f", "false_episodes_per_series_year"))) + " FROM (" + " UNION ALL ".join(_summary_sql(m) for m in ("naive", "seasonal")) + ")"


@query("success_criteria", with_(CRITERIA_SQL, one_=ONE_SQL, **WF_SQL))
def success_criteria(spark, d):
    """What is asked of a model, held against both naive models' walk-forward summaries."""
    return rounded(reports.success_criteria(materialize(compare_models(spark, d)), "seasonal"), "result")


CASE_SQL = f"""SELECT c.commodity_id, c.province_id, onset, first_alarm, p.date, round(p.price, 4) AS price, round(score, 6) + 0 AS score, threshold, coalesce(score >= threshold, false) AS is_alarm
    FROM (SELECT d.commodity_id, d.province_id, d.date AS onset, d.date - lead_days AS first_alarm FROM ({DETECT_SQL}) d JOIN events_ e ON e.commodity_id = d.commodity_id AND e.province_id = d.province_id AND e.date = d.date
        WHERE d.date >= DATE '1998-07-01' + 14 AND detected AND lead_days >= 7 AND d.commodity_id IN ('PROMO', 'LARGE', 'SMALL') ORDER BY peak_rise_30d DESC NULLS LAST, d.date, d.commodity_id, d.province_id LIMIT 1) c
    JOIN panel p ON p.commodity_id = c.commodity_id AND p.province_id = c.province_id AND p.date BETWEEN onset - 60 AND onset + 30
    LEFT JOIN pred q ON q.commodity_id = p.commodity_id AND q.province_id = p.province_id AND q.date = p.date"""


@query("case_study", with_(CASE_SQL))
def case_study(spark, d):
    """The days around the event of the largest rise that was seen a week ahead."""
    x = marked(spark, d)
    out = reports.case_study(predictions(x), materialize(labels.events_table(x, TARGET)), x, ["PROMO", "LARGE", "SMALL"], "1998-07-01")
    return rounded(out, "price", n=4).withColumn("score", F.round("score", 6) + F.lit(0.0))


_MODELS = ("naive", "seasonal")
DELTA_SQL = f"""SELECT 'naive' AS variant, round(v.ap, 6) AS pr_auc, round(f.ap - v.ap, 6) AS delta, round(mean_delta, 6) AS mean_delta, n_won, n_periods
    FROM ({AP_SQL.format(key='variant', rows='dlong')}) v, ({AP_SQL.format(key='variant', rows='dlong')}) f,
    (SELECT avg(b.ap - a.ap) AS mean_delta, sum(coalesce(b.ap > a.ap, false)::INT)::BIGINT AS n_won, count(b.ap - a.ap) AS n_periods FROM dparts a JOIN dparts b ON a.period = b.period AND a.variant = 'naive' AND b.variant = 'seasonal')
    WHERE v.variant = 'naive' AND f.variant = 'seasonal'"""


@query("period_deltas", with_(DELTA_SQL, dlong=" UNION ALL ".join(f"SELECT strftime(date, '%Y-%m') AS period, y, '{m}' AS variant, round(score_{m}, 9) AS score FROM wfpred" for m in _MODELS),
    dparts=AP_SQL.format(key="variant, period", rows="dlong"), **WF_SQL))
def period_deltas(spark, d):
    """By how much the seasonal model is ahead of the other, in all and by month."""
    p = materialize(forward(spark, d, marked(spark, d)))
    p = p.select(F.date_format("date", "yyyy-MM").alias("period"), "y", *[F.round(f"score_{m}", 9).alias(f"score_{m}") for m in _MODELS])
    return rounded(reports.deltas_by_period(p, "seasonal", "period"), "pr_auc", "delta", "mean_delta")


@query("network_docs", with_("""SELECT commodity_id, '[' || string_agg('{"strength":' || strength || ',"source":' || source || ',"target":' || target || '}', ',' ORDER BY rank) || ']' AS doc FROM (
    SELECT *, row_number() OVER (PARTITION BY commodity_id ORDER BY strength DESC, source DESC, target DESC) AS rank FROM (
    SELECT commodity_id, source, target, round(-log10(greatest(p_value, 1e-300)), 3) AS strength FROM bh WHERE q_value < 0.02 AND coef_sum > 0)) WHERE rank <= 30 GROUP BY 1"""))
def network_docs(spark, d):
    """The documents that the site shows of each commodity's network: its 30 strongest edges."""
    return export.network_docs(_significant(spark, d))


NAMED_SQL = f"""SELECT date, price_type_id, CASE price_type_id WHEN 1 THEN 'Traditional' WHEN 4 THEN 'Producer' END AS price_type, 'com_' || lower(commodity_id) AS commodity_id, upper(left(commodity_id, 1)) || lower(substr(commodity_id, 2)) AS commodity,
    'cat_' || {CAT_SQL} AS cat_id, CASE {CAT_SQL} WHEN 'kind' THEN 'Kinds' END AS category, province_id, CASE WHEN province_id = 0 THEN 'Nasional' ELSE c.name END AS province, price
    FROM ({CELLS_SQL}) c JOIN {NAMES_SQL} ON t.name = c.name WHERE c.name <> 'Dum'"""


@query("named_observations", with_(NAMED_SQL))
def named_observations(spark, d):
    """The long table as it is stored: parsed grids with the names of price types, commodities, categories and places; unlisted names are null."""
    cells = parse_price_grid(spark, d).select("*", F.lit("a").alias("file")).withColumn("commodity_id", F.concat(F.lit("com_"), F.lower("commodity_id")))
    tree = [("cat_kind", "Kinds", None), *[(f"com_{c.lower()}", c.capitalize(), f"cat_{k}") for c, k in CATEGORIES]]
    places = fx.provinces(spark).where("province_id <> 5").select(F.col("province_id").alias("id"), F.col("province").alias("name"))
    kinds = spark.createDataFrame([(1, "Traditional"), (4, "Producer")], "id int, name string")
    return grid_json.load_long(cells, places, spark.createDataFrame(tree, "id string, name string, cat_id string"), kinds)
