"""Queries over networks, metrics, events, folds, drift and models."""

from __future__ import annotations

import re

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, metrics
from ..operators import calendar, events, features, graph, grid, labels, models, panel
from ..operators.panel import SERIES, lag_of
from ..sources import fixtures as fx
from ..storage import materialize
from .feature_queries import feature_table_of
from .panel_queries import CAT_SQL, TARGET, categories, clean_panel, labelled, rounded
from .registry import query
from .sql import CTE, SERIES as SERIES_SQL, W, with_

PROVINCES_SQL = "(VALUES " + ", ".join(f"({p[0]}, {p[2]}::DOUBLE, {p[3]}::DOUBLE)" for p in fx.PROVINCES) + ") t(id, lat, lon)"
KM_SQL = f"SELECT a.id AS province_id, b.id AS other, 2 * 6371.0 * asin(sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)) AS km FROM (SELECT * FROM {PROVINCES_SQL}) a JOIN (SELECT * FROM {PROVINCES_SQL}) b ON a.id <> b.id"


#: Mean log price of each week that ends on Friday, and its change from the week before.
WK_SQL = """SELECT *, x - lag(x) OVER (PARTITION BY commodity_id, province_id ORDER BY date) AS ret
    FROM (SELECT commodity_id, province_id, date + (CASE WHEN isodow(date) <= 5 THEN 5 - isodow(date) ELSE 12 - isodow(date) END)::INT AS date, avg(ln(price)) AS x FROM panel GROUP BY ALL)"""


SITES_SQL = "SELECT s_nationkey AS id, avg((s_suppkey * 37) % 170 / 10.0 - 8) AS lat, avg((s_suppkey * 53) % 460 / 10.0 + 95) AS lon FROM supplier GROUP BY 1"


@query("haversine_knn", f"""WITH sites AS ({SITES_SQL})
    SELECT province_id, other, round(km, 4) AS km, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY province_id ORDER BY km, other) AS rank
    FROM (SELECT a.id AS province_id, b.id AS other, 2 * 6371.0 * asin(sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)) AS km
    FROM sites a JOIN sites b ON a.id <> b.id)) WHERE rank <= 3""")
def haversine_knn(spark, d):
    """The three nearest of the nations' centres, which are the means of where their suppliers lie (by key)."""
    lat, lon = (F.col("s_suppkey") * 37) % 170 / 10.0 - 8, (F.col("s_suppkey") * 53) % 460 / 10.0 + 95
    sites = materialize(fx.read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("province_id")).agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon")))
    return rounded(geo.nearest(sites), "km", n=4)


@query("distance_corr_bins", with_(f"""SELECT floor(k.km / 250)::BIGINT AS bin, count(*) AS n, round(avg(c), 6) AS corr FROM (SELECT a.commodity_id, a.province_id AS p, b.province_id AS q, corr(a.ret, b.ret) AS c, count(a.ret + b.ret) AS m
    FROM wk a JOIN wk b ON a.commodity_id = b.commodity_id AND a.date = b.date AND a.province_id < b.province_id GROUP BY 1, 2, 3) x JOIN ({KM_SQL}) k ON k.province_id = p AND k.other = q WHERE m >= 100 GROUP BY 1""",
    wk=WK_SQL))
def distance_corr_bins(spark, d):
    w = panel.weekly(clean_panel(spark, d)).select(*SERIES, "date", "ret")
    b = w.select("commodity_id", "date", F.col("province_id").alias("other"), F.col("ret").alias("ret2"))
    c = w.join(b, ["commodity_id", "date"]).where("province_id < other").groupBy(*SERIES, "other").agg(F.corr("ret", "ret2").alias("c"), F.count(F.col("ret") + F.col("ret2")).alias("m")).where("m >= 100")
    k = geo.distances(fx.provinces(spark))
    return c.join(F.broadcast(k), ["province_id", "other"]).groupBy(F.floor(F.col("km") / 250).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("corr"))


WEEKLY_SQL = f"SELECT commodity_id, province_id, date, round(x, 6) AS x, round(x - lag(x) OVER ({W}), 6) + 0 AS ret FROM (SELECT commodity_id, province_id, date + (CASE WHEN isodow(date) <= 5 THEN 5 - isodow(date) ELSE 12 - isodow(date) END)::INT AS date, avg(ln(price)) AS x FROM panel GROUP BY ALL)"


@query("weekly_returns", with_(WEEKLY_SQL))
def weekly_returns(spark, d):
    return rounded(panel.weekly(clean_panel(spark, d)), "x", "ret").withColumn("ret", F.col("ret") + F.lit(0.0))  # no negative zero


@query("lagged_cross_corr", with_(f"SELECT k AS lag, round(avg(c), 6) AS corr FROM (SELECT commodity_id, province_id, k, corr(x, y) AS c FROM (SELECT a.commodity_id, a.province_id, 0 AS k, a.r AS x, a.p AS y FROM rr a " + " ".join(f"UNION ALL SELECT commodity_id, province_id, {k}, r, lag(p, {k}) OVER ({W}) FROM rr" for k in (7, 14, 21)) + ") GROUP BY 1, 2, 3) GROUP BY 1",
    rr=f"SELECT a.commodity_id, a.province_id, a.date, ln(a.price) - lag(ln(a.price), 7) OVER (PARTITION BY a.commodity_id, a.province_id ORDER BY a.date) AS r, ln(b.price) - lag(ln(b.price), 7) OVER (PARTITION BY a.commodity_id, a.province_id ORDER BY a.date) AS p FROM panelp a LEFT JOIN paneln4 b USING (commodity_id, province_id, date)"))
def lagged_cross_corr(spark, d):
    from .panel_queries import CLEAN
    o = fx.observations(spark, d, True)
    a, b = panel.price_panel(o, 1, CLEAN).where("province_id <> 0"), panel.price_panel(o, 4, CLEAN).select(*SERIES, "date", F.ln("price").alias("y"))
    x = a.select(*SERIES, "date", F.ln("price").alias("x")).join(b, [*SERIES, "date"], "left")
    x = x.select(*SERIES, "date", (F.col("x") - lag_of("x", 7)).alias("r"), (F.col("y") - lag_of("y", 7)).alias("p"))
    x = x.select(*SERIES, "r", F.array(*[lag_of("p", k) for k in (0, 7, 14, 21)]).alias("ps"))
    c = x.select(*SERIES, "r", F.posexplode("ps").alias("k", "p")).groupBy(*SERIES, "k").agg(F.corr("r", "p").alias("c"))
    return c.groupBy((F.col("k") * 7).alias("lag")).agg(F.round(F.avg("c"), 6).alias("corr"))


@query("granger_edges")
def granger_edges(spark, d):
    """Edges of the network with false-discovery control; least squares have no SQL, tests compare with NumPy."""
    e = graph.bh_fdr(graph.granger_edges(panel.weekly(clean_panel(spark, d))))
    return e.select("*", ((F.col("q_value") < 0.05) & (F.col("coef_sum") > 0)).alias("significant"))


def p_values(spark, d) -> DataFrame:
    line = fx.read(spark, d, "lineitem").join(fx.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    p = (((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 1000 + 1) / F.lit(1001.0)).alias("p")
    x = line.select(F.col("p_type").alias("commodity_id"), (F.col("l_suppkey") % 7 + 1).cast("int").alias("source"), (F.col("l_partkey") % 7 + 1).cast("int").alias("target"), p, (F.col("l_suppkey") % 5 - 2).alias("c")).where("source <> target")
    return x.groupBy("commodity_id", "source", "target").agg(F.min("p").alias("p_value"), F.sum("c").cast("double").alias("coef_sum"))


def _significant(spark, d) -> DataFrame:
    return graph.bh_fdr(p_values(spark, d)).select("*", ((F.col("q_value") < 0.02) & (F.col("coef_sum") > 0)).alias("significant"))


@query("bh_fdr", with_("SELECT commodity_id, source, target, round(p_value, 8) AS p_value, round(q_value, 8) AS q_value FROM bh"))
def bh_fdr(spark, d):
    return rounded(graph.bh_fdr(p_values(spark, d)).drop("coef_sum"), "p_value", "q_value", n=8)


@query("leader_scores", with_("SELECT commodity_id, province_id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(o - i)::BIGINT AS leader_score FROM (SELECT commodity_id, source AS province_id, (q_value < 0.02 AND coef_sum > 0)::INT AS o, 0 AS i FROM bh UNION ALL SELECT commodity_id, target, 0, (q_value < 0.02 AND coef_sum > 0)::INT FROM bh) GROUP BY 1, 2"))
def leader_scores(spark, d):
    return graph.leader_scores(_significant(spark, d))


@query("select_leaders", with_("SELECT commodity_id, target AS province_id, source, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY commodity_id, target ORDER BY greatest(p_value, 1e-300), source) AS rank FROM pv WHERE coef_sum > 0) WHERE rank <= 3"))
def select_leaders(spark, d):
    return graph.select_leaders(p_values(spark, d))


@query("radar_top10", with_("SELECT province_id, sum(o - i)::BIGINT AS total FROM (SELECT commodity_id, source AS province_id, (q_value < 0.02 AND coef_sum > 0)::INT AS o, 0 AS i FROM bh UNION ALL SELECT commodity_id, target, 0, (q_value < 0.02 AND coef_sum > 0)::INT FROM bh) GROUP BY 1 ORDER BY total DESC, province_id LIMIT 10"))
def radar_top10(spark, d):
    return leader_scores(spark, d).groupBy("province_id").agg(F.sum("leader_score").alias("total")).orderBy(F.desc("total"), "province_id").limit(10)


@query("event_precedence_lift", with_(f"""SELECT a.commodity_id, a.province_id AS source, b.province_id AS target, a.n AS n_onset_source, b.n AS n_onset_target, coalesce(c.k, 0)::BIGINT AS n_followed, round(coalesce(c.k, 0) / nullif(a.n, 0) / nullif(b.base, 0), 6) AS lift
    FROM per a JOIN per b ON a.commodity_id = b.commodity_id AND a.province_id <> b.province_id LEFT JOIN (SELECT x.commodity_id, x.province_id AS p, z.province_id AS q, sum(x.onset * z.f) AS k FROM fut x JOIN fut z ON x.commodity_id = z.commodity_id AND x.date = z.date GROUP BY 1, 2, 3) c ON c.commodity_id = a.commodity_id AND c.p = a.province_id AND c.q = b.province_id""",
    per="SELECT commodity_id, province_id, sum(onset)::BIGINT AS n, avg(f) AS base FROM fut GROUP BY 1, 2",
    fut=f"SELECT commodity_id, province_id, date, onset, coalesce(max(onset) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING), 0) AS f FROM marked"))
def event_precedence_lift(spark, d):
    return rounded(graph.precedence(labelled(spark, d)), "lift")


# --- ranking metrics on (y, score) pairs with ties


def pairs(spark, d) -> DataFrame:
    doc = fx.read(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return doc.join(fx.read(spark, d, "labels").select("doc_id", F.col("toxic").alias("y"), F.col("quality").alias("g")), "doc_id")


CTE["curve"] = """SELECT *, sum(pos) OVER (PARTITION BY g ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n - pos) OVER (PARTITION BY g ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
    sum(pos) OVER (PARTITION BY g) AS p_all, sum(n - pos) OVER (PARTITION BY g) AS n_all FROM (SELECT g, score, sum(y) AS pos, count(*) AS n FROM pairs GROUP BY 1, 2)"""


@query("average_precision", with_("SELECT g, round(CASE WHEN min(p_all) > 0 AND min(n_all) > 0 THEN sum(pos / p_all * tp / (tp + fp)) END, 8) AS ap FROM curve GROUP BY g"))
def average_precision(spark, d):
    return rounded(metrics.average_precision(pairs(spark, d), ["g"]), "ap", n=8)


@query("roc_auc", with_("SELECT g, round(CASE WHEN min(p_all) > 0 AND min(n_all) > 0 THEN sum(pos * (n_all - fp + (n - pos) / 2.0)) / min(p_all) / min(n_all) END, 8) AS auc FROM curve GROUP BY g"))
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(pairs(spark, d), ["g"]), "auc", n=8)


def _f_sql(b: int) -> str:
    return with_(f"SELECT g, threshold FROM (SELECT g, score AS threshold, row_number() OVER (PARTITION BY g ORDER BY round(coalesce({1 + b} * (tp / (tp + fp)) * (tp / p_all) / nullif({b} * (tp / (tp + fp)) + tp / p_all, 0), 0), 12) DESC, score) AS k FROM curve) WHERE k = 1")


@query("best_threshold_f1", _f_sql(1))
def best_threshold_f1(spark, d):
    return metrics.best_threshold(pairs(spark, d), ["g"], "f1")


@query("best_threshold_f2", _f_sql(4))
def best_threshold_f2(spark, d):
    return metrics.best_threshold(pairs(spark, d), ["g"], "f2")


@query("best_threshold_precision", with_("SELECT g, coalesce(min(CASE WHEN tp / (tp + fp) >= 0.15 THEN score END), max(score)) AS threshold FROM curve GROUP BY g"))
def best_threshold_precision(spark, d):
    return metrics.best_threshold(pairs(spark, d), ["g"], "precision_target", 0.15)


def _confusion_sql(keys: str, source: str, alarm: str) -> str:
    return f"""SELECT {keys}, tp, fp, fn, round(tp / nullif(tp + fp, 0), 8) AS precision, round(tp / nullif(tp + fn, 0), 8) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END, 8) AS f1, round(1 - tp / nullif(tp + fp, 0), 8) AS far, round((tp + fp) / n, 8) AS alarm_rate
        FROM (SELECT {keys}, count(*) FILTER ({alarm} AND y = 1) AS tp, count(*) FILTER ({alarm} AND y <> 1) AS fp, count(*) FILTER (NOT {alarm} AND y = 1) AS fn, count(*) AS n FROM {source} GROUP BY ALL)"""


RATES = ("precision", "recall", "f1", "far", "alarm_rate")


@query("confusion_at_threshold", with_(_confusion_sql("g", "pairs", "(score >= 2000)")))
def confusion_at_threshold(spark, d):
    return rounded(metrics.confusion(["g"], pairs(spark, d), threshold=F.lit(2000.0)), *RATES, n=8)


CUTS = (500, 1000, 2000, 4000, 8000, 16000)


@query("threshold_sweep", with_(_confusion_sql("t", f"(SELECT * FROM pairs CROSS JOIN (SELECT unnest({list(CUTS)}) AS t))", "(score >= t)")))
def threshold_sweep(spark, d):
    x = pairs(spark, d).select("*", F.explode(F.array(*[F.lit(t) for t in CUTS])).alias("t"))
    return rounded(metrics.confusion(["t"], x, threshold="t"), *RATES, n=8)


@query("brier", with_("SELECT g, round(avg((least(greatest(score / 20000, 0), 1) - y) ** 2), 8) AS brier FROM pairs GROUP BY g"))
def brier(spark, d):
    p = F.least(F.greatest(F.col("score") / 20000, F.lit(0.0)), F.lit(1.0))
    return pairs(spark, d).groupBy("g").agg(F.round(F.avg((p - F.col("y")) ** 2), 8).alias("brier"))


# --- alarms and events


def marked(spark, d) -> DataFrame:
    """Labels of the whole panel, computed once for predictions and events alike."""
    return materialize(labelled(spark, d))


def predictions(x: DataFrame) -> DataFrame:
    x = x.select(*SERIES, "date", "y", "eligible", (F.ln("price") - F.lag(F.ln("price"), 7).over(panel.in_order())).alias("score"))
    return x.where("date >= date'1998-01-01' and eligible and y is not null").select(*SERIES, "date", "y", "score", F.lit(0.6).alias("threshold"))


DETECT_SQL = """SELECT e.date, e.commodity_id, e.province_id, min(a.date) IS NOT NULL AS detected, (e.date - min(a.date))::INT AS lead_days FROM events_ e
    JOIN (SELECT commodity_id, province_id, min(date) AS begun FROM pred GROUP BY 1, 2) s ON s.commodity_id = e.commodity_id AND s.province_id = e.province_id AND s.begun <= e.date - 14
    LEFT JOIN pred a ON a.commodity_id = e.commodity_id AND a.province_id = e.province_id AND a.score >= a.threshold AND a.date BETWEEN e.date - 14 AND e.date - 1
    WHERE e.date - 14 >= (SELECT min(date) FROM pred) AND e.date - 1 <= (SELECT max(date) FROM pred) GROUP BY 1, 2, 3"""
EPISODE_SQL = f"""SELECT p.commodity_id, p.province_id, p.start, p."end", p.n_days, NOT coalesce(bool_or(e.date > p.start AND e.date <= p."end" + 14), false) AS is_false FROM (
    SELECT commodity_id, province_id, ep, min(date) AS start, max(date) AS "end", count(*) AS n_days FROM (SELECT *, sum((coalesce(date - before, 5) > 4)::INT) OVER ({W}) AS ep FROM (
    SELECT *, lag(date) OVER ({W}) AS before FROM pred WHERE score >= threshold)) GROUP BY 1, 2, 3) p LEFT JOIN events_ e ON e.commodity_id = p.commodity_id AND e.province_id = p.province_id GROUP BY 1, 2, p.ep, 3, 4, 5"""


@query("event_detection", with_(DETECT_SQL))
def event_detection(spark, d):
    x = marked(spark, d)
    return events.event_detection(predictions(x), labels.events_table(x, TARGET))


@query("alarm_episodes", with_(EPISODE_SQL))
def alarm_episodes(spark, d):
    x = marked(spark, d)
    return events.alarm_episodes(predictions(x), labels.events_table(x, TARGET))


@query("alarm_summary", with_("""SELECT d.n AS n_events, round(d.rate, 8) AS event_detection_rate, d.mid AS median_lead_days, round(d.mean, 8) AS mean_lead_days, round(d.share, 8) AS share_lead_ge_7, e.n AS n_episodes, round(1 - e.f / e.n, 8) AS episode_precision,
    round(e.f / greatest(s.series * s.span / 365.25, 1e-9), 8) AS false_episodes_per_series_year FROM (SELECT count(*) AS n, avg(detected::INT) AS rate, median(lead_days)::DOUBLE AS mid, avg(lead_days) AS mean, avg(coalesce(lead_days >= 7, false)::INT) AS share FROM det) d,
    (SELECT count(*) AS n, sum(is_false::INT) AS f FROM epi) e, (SELECT count(DISTINCT (commodity_id, province_id)) AS series, max(date) - min(date) AS span FROM pred) s""", det=DETECT_SQL, epi=EPISODE_SQL))
def alarm_summary(spark, d):
    x = marked(spark, d)
    p, ev = predictions(x), labels.events_table(x, TARGET)
    det, ep = events.event_detection(p, ev), events.alarm_episodes(p, ev)
    a = det.agg(F.count(F.lit(1)).alias("n_events"), F.avg(F.col("detected").cast("int")).alias("event_detection_rate"), F.percentile("lead_days", F.lit(0.5)).alias("median_lead_days"), F.avg("lead_days").alias("mean_lead_days"), F.avg(F.coalesce(F.col("lead_days") >= 7, F.lit(False)).cast("int")).alias("share_lead_ge_7"))
    b = ep.agg(F.count(F.lit(1)).alias("n_episodes"), F.sum(F.col("is_false").cast("long")).alias("f"))
    s = p.agg(F.count_distinct(*SERIES).alias("series"), F.datediff(F.max("date"), F.min("date")).alias("span"))
    x = a.crossJoin(b).crossJoin(s)
    out = x.select("n_events", "event_detection_rate", "median_lead_days", "mean_lead_days", "share_lead_ge_7", "n_episodes", (1 - F.col("f") / F.col("n_episodes")).alias("episode_precision"), (F.col("f") / F.greatest(F.col("series") * F.col("span") / 365.25, F.lit(1e-9))).alias("false_episodes_per_series_year"))
    return rounded(out, "event_detection_rate", "mean_lead_days", "share_lead_ge_7", "episode_precision", "false_episodes_per_series_year", n=8)


FOLDS_SQL = """SELECT fold, val_start - 15 AS fit_end, val_start, val_end, test_start, test_end FROM (SELECT *, val_end - 119 AS val_start FROM (SELECT (row_number() OVER (ORDER BY t) - 1)::INT AS fold, t::DATE AS test_start,
    least((t + INTERVAL 3 MONTH)::DATE - 1, last) AS test_end, t::DATE - 15 AS val_end FROM (SELECT last, unnest(generate_series(TIMESTAMP '1998-01-01', last::TIMESTAMP, INTERVAL 3 MONTH)) AS t FROM (SELECT max(date) AS last FROM obs))))"""


def folds(spark, d) -> DataFrame:
    return events.make_folds(fx.observations(spark, d), "1998-01-01")


@query("walk_forward_folds", with_(FOLDS_SQL))
def walk_forward_folds(spark, d):
    return folds(spark, d)


@query("fold_roles", with_("""SELECT fold, role, count(*) AS n, sum(y)::BIGINT AS n_pos FROM (SELECT fold, y, CASE WHEN date <= fit_end THEN 'fit' WHEN date BETWEEN val_start AND val_end THEN 'val' WHEN date BETWEEN test_start AND test_end THEN 'test' END AS role
    FROM marked CROSS JOIN folds_ WHERE eligible AND y IS NOT NULL) WHERE role IS NOT NULL GROUP BY 1, 2""", folds_=FOLDS_SQL))
def fold_roles(spark, d):
    x = labelled(spark, d).where("eligible and y is not null").select(*SERIES, "date", "y")
    return events.fold_roles(x, folds(spark, d)).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"))


@query("monthly_pr_auc", with_("SELECT month, round(CASE WHEN min(p_all) > 0 AND min(n_all) > 0 THEN sum(pos / p_all * tp / (tp + fp)) END, 6) AS ap FROM mcurve GROUP BY month",
    mcurve="SELECT *, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER (PARTITION BY month) AS p_all, sum(n - pos) OVER (PARTITION BY month) AS n_all FROM (SELECT month, score, sum(y) AS pos, count(*) AS n FROM (SELECT date_trunc('month', date)::DATE AS month, round(score, 9) AS score, y FROM pred WHERE score IS NOT NULL) GROUP BY 1, 2) WINDOW w AS (PARTITION BY month ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"))
def monthly_pr_auc(spark, d):
    p = predictions(labelled(spark, d)).select(F.trunc("date", "MM").alias("month"), F.round("score", 9).alias("score"), "y")
    return rounded(metrics.average_precision(p, ["month"]), "ap")


@query("psi_drift", with_("""SELECT round(sum((pa - pe) * ln(pa / pe)), 6) AS psi FROM (SELECT greatest(1e-4, count(*) FILTER (e) / (SELECT count(*) FILTER (e) FROM px)) AS pe, greatest(1e-4, count(*) FILTER (NOT e) / (SELECT count(*) FILTER (NOT e) FROM px)) AS pa
    FROM (SELECT e, least(len(edges) - 2, len(list_filter(edges, lambda v: v <= least(greatest(x, edges[1]), edges[-1]))) - 1) AS bin FROM px, ed) GROUP BY bin)""",
    px=f"SELECT ln(price) AS x, date < DATE '1999-01-01' AS e FROM panel WHERE price IS NOT NULL",
    ed="SELECT list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM px WHERE e"))
def psi_drift(spark, d):
    p = clean_panel(spark, d).select("date", F.ln("price").alias("x"))
    return rounded(metrics.psi(p, "x", F.col("date") < F.to_date(F.lit("1999-01-01"))), "psi")


@query("freshness_bdays", with_("SELECT price_type_id, max(date) AS last, (SELECT count(*) FROM (SELECT unnest(generate_series(max(date)::TIMESTAMP, TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS t) WHERE isodow(t) <= 5) - 1 AS bdays_old FROM obs GROUP BY 1"))
def freshness_bdays(spark, d):
    o = fx.observations(spark, d).groupBy("price_type_id").agg(F.max("date").alias("last"))
    return o.select("price_type_id", "last", (calendar.business_days(F.col("last"), F.to_date(F.lit("2001-12-31"))) - 1).alias("bdays_old"))


RISK_SQL = "SELECT commodity_id, province_id, round(p, 6) AS prob, CASE WHEN s0 = 1 THEN 'Sedang lonjak' WHEN p >= 0.5 THEN 'Tinggi' WHEN p >= 0.25 THEN 'Waspada' ELSE 'Rendah' END AS level FROM (SELECT *, 1 / (1 + exp(-r14)) - 0.3 AS p FROM marked WHERE date = (SELECT max(date) FROM marked WHERE r14 IS NOT NULL) AND r14 IS NOT NULL)"


def risk(spark, d) -> DataFrame:
    x = labelled(spark, d).where("r14 is not null")
    last = x.agg(F.max("date").alias("date"))
    x = x.join(F.broadcast(last), "date").select(*SERIES, "s0", (1 / (1 + F.exp(-F.col("r14"))) - 0.3).alias("p"))
    return x.select(*SERIES, F.round("p", 6).alias("prob"), models.risk_level(F.col("p"), F.col("s0"), 0.5).alias("level"))


@query("risk_levels", with_(RISK_SQL))
def risk_levels(spark, d):
    return risk(spark, d)


@query("risk_by_level", with_(f"SELECT commodity_id, count(*) FILTER (level = 'Tinggi') AS tinggi, count(*) FILTER (level = 'Waspada') AS waspada, count(*) FILTER (level = 'Rendah') AS rendah FROM ({RISK_SQL}) GROUP BY 1"))
def risk_by_level(spark, d):
    p = risk(spark, d).groupBy("commodity_id").pivot("level", ["Tinggi", "Waspada", "Rendah"]).count().na.fill(0)
    return p.select("commodity_id", F.col("Tinggi").alias("tinggi"), F.col("Waspada").alias("waspada"), F.col("Rendah").alias("rendah"))


@query("top_k_risk", with_(f"SELECT commodity_id, province_id, prob, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY commodity_id ORDER BY prob DESC, province_id) AS rank FROM ({RISK_SQL})) WHERE rank <= 2"))
def top_k_risk(spark, d):
    r = F.row_number().over(Window.partitionBy("commodity_id").orderBy(F.desc("prob"), "province_id")).alias("rank")
    return risk(spark, d).select(*SERIES, "prob", r).where("rank <= 2")


@query("risk_docs", with_(f"""SELECT commodity_id, '[' || string_agg('{{"p":' || r.province_id || ',"prob":' || prob::DECIMAL(18, 4) || ',"level":"' || level || '"' || ',"r14":' || r14::DECIMAL(18, 4) || ',"price":' || round(price)::BIGINT || '}}', ',' ORDER BY r.province_id) || ']' AS doc
    FROM ({RISK_SQL}) r JOIN (SELECT commodity_id, province_id, r14, price FROM marked WHERE r14 IS NOT NULL AND date = (SELECT max(date) FROM marked WHERE r14 IS NOT NULL)) m USING (commodity_id, province_id) GROUP BY 1"""))
def risk_docs(spark, d):
    """The dashboard's risks of the newest day, one document for each commodity."""
    from .export import risk_docs as docs
    x = marked(spark, d).where("r14 is not null")
    now = x.join(F.broadcast(x.agg(F.max("date").alias("date"))), "date")
    p = 1 / (1 + F.exp(-F.col("r14"))) - 0.3
    return docs(now.select(*SERIES, F.round(p, 6).alias("prob"), models.risk_level(p, F.col("s0"), 0.5).alias("level"), F.col("r14").alias("r14_now")), now.select(*SERIES, "price"))


@query("site_meta", with_(f"""SELECT '{{"asof":"' || strftime(last, '%Y-%m-%d') || '","window":{{"start":"' || strftime(last + 1, '%Y-%m-%d') || '","end":"' || strftime(last + 14, '%Y-%m-%d') || '"}},"horizon_days":14,"alarm_threshold":0.5000,"commodities":[' || coms || '],"centroids":[' || spots || ']}}' AS doc FROM (SELECT max(date) AS last FROM obs),
    (SELECT string_agg('{{"id":"' || commodity_id || '","cat_id":"' || {CAT_SQL} || '","threshold":' || thr::DECIMAL(18, 4) || '}}', ',' ORDER BY commodity_id) AS coms FROM (SELECT DISTINCT commodity_id, thr FROM rise)), (SELECT string_agg('{{"p":' || id || ',"lat":' || lat::DECIMAL(18, 4) || ',"lon":' || lon::DECIMAL(18, 4) || '}}', ',' ORDER BY id) AS spots FROM {PROVINCES_SQL})"""))
def site_meta(spark, d):
    from .export import site_meta as docs
    o = fx.observations(spark, d)
    coms = labels.thresholds(o.where("price_type_id = 1"), categories(spark), TARGET).join(F.broadcast(categories(spark)), "commodity_id").select(F.col("commodity_id").alias("id"), "cat_id", F.col("thr").alias("threshold")).distinct()
    return docs(o.agg(F.max("date").alias("date")), coms, fx.provinces(spark).select(F.col("province_id"), "lat", "lon"), 0.5)


@query("latest_price_asof", with_("SELECT commodity_id, province_id, arg_max(round(price, 4), date) AS price, max(date) AS date FROM obs WHERE price_type_id = 1 AND date <= DATE '2000-06-30' GROUP BY 1, 2"))
def latest_price_asof(spark, d):
    o = fx.observations(spark, d).where("price_type_id = 1 and date <= date'2000-06-30' and price is not null")
    return o.groupBy(*SERIES).agg(F.round(F.max_by("price", "date"), 4).alias("price"), F.max("date").alias("date"))


@query("set_ops", with_("SELECT 'both' AS kind, commodity_id, date FROM (SELECT commodity_id, date FROM obs WHERE price_type_id = 1 INTERSECT SELECT commodity_id, date FROM obs WHERE price_type_id = 4) UNION ALL SELECT 'only_1', commodity_id, date FROM (SELECT commodity_id, date FROM obs WHERE price_type_id = 1 EXCEPT SELECT commodity_id, date FROM obs WHERE price_type_id = 4)"))
def set_ops(spark, d):
    o = fx.observations(spark, d)
    a, b = (o.where(f"price_type_id = {k}").select("commodity_id", "date") for k in (1, 4))
    both, only = a.intersect(b), a.subtract(b)
    return both.select(F.lit("both").alias("kind"), "*").unionByName(only.select(F.lit("only_1").alias("kind"), "*"))


@query("session_alarms", "SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (SELECT *, sum((coalesce(ts - before > INTERVAL 4 HOUR, true))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type = 'error')) GROUP BY user_id, k")
def session_alarms(spark, d):
    e = fx.read(spark, d, "events").where("event_type = 'error'")
    s = e.groupBy("user_id", F.session_window("ts", "4 hours").alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return s.select("user_id", "first", "last", "n")


@query("hourly_panel", "SELECT date_trunc('hour', ts) AS hour, event_type, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def hourly_panel(spark, d):
    e = fx.read(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.round(F.avg("value"), 6).alias("value"))


WF_SQL = {
    "wfrows": f"SELECT {SERIES_SQL}, date, y, ret AS score_naive, seas AS score_seasonal FROM (SELECT *, ln(price) - lag(ln(price), 7) OVER ({W}) AS ret, lag(ln(price), 350) OVER ({W}) - lag(ln(price), 364) OVER ({W}) AS seas FROM marked) WHERE eligible AND y IS NOT NULL",
    "wfroles": "SELECT w.*, fold, CASE WHEN date <= fit_end THEN 'fit' WHEN date BETWEEN val_start AND val_end THEN 'val' WHEN date BETWEEN test_start AND test_end THEN 'test' END AS role FROM wfrows w CROSS JOIN folds_",
    "folds_": FOLDS_SQL,
    "wfused": "SELECT fold FROM wfroles GROUP BY 1 HAVING sum(y) FILTER (role = 'fit') > 0 AND count(*) FILTER (role = 'test') > 0",
} | {
    f"wf{m}": f"""SELECT fold, CASE WHEN max(p_all) = 0 THEN max(score) + 1e-9 ELSE arg_max(score, (round(f, 12), -score)) END AS thr FROM (SELECT fold, score, p_all, coalesce(2.0 * tp / nullif(tp + fp + p_all, 0), 0) AS f FROM (SELECT fold, score, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER (PARTITION BY fold) AS p_all
        FROM (SELECT fold, score_{m} AS score, sum(y) AS pos, count(*) AS n FROM wfroles WHERE role = 'val' AND score_{m} IS NOT NULL GROUP BY 1, 2) WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING))) GROUP BY 1""" for m in ("naive", "seasonal")
} | {"wfpred": f"SELECT r.{SERIES_SQL.replace(', ', ', r.')}, date, y, r.fold, score_naive, a.thr AS thr_naive, score_seasonal, b.thr AS thr_seasonal FROM wfroles r JOIN wfused u ON u.fold = r.fold LEFT JOIN wfnaive a ON a.fold = r.fold LEFT JOIN wfseasonal b ON b.fold = r.fold WHERE role = 'test'"}


def forward(spark, d, x: DataFrame) -> DataFrame:
    rows = x.select(*SERIES, "date", "y", "eligible", F.ln("price").alias("x"))
    rows = rows.select("*", models.naive(F.col("x")).alias("naive"), models.seasonal_naive(F.col("x")).alias("seasonal")).where("eligible and y is not null")
    return models.walk_forward(materialize(rows), folds(spark, d), {"naive": F.col("naive"), "seasonal": F.col("seasonal")})


@query("walk_forward_naive", with_("SELECT commodity_id, province_id, date, y, fold, " + ", ".join(f"round({c}, 6) + 0 AS {c}" for c in ("score_naive", "thr_naive", "score_seasonal", "thr_seasonal")) + " FROM wfpred", **WF_SQL))
def walk_forward_naive(spark, d):
    """Out-of-sample scores of both naive models over all folds, with thresholds from the validation rows."""
    out = forward(spark, d, marked(spark, d))
    return out.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if c.startswith(("score_", "thr_")) else F.col(c) for c in out.columns])


def _summary_sql(m: str, rows: str = "wfpred") -> str:
    p = f"(SELECT {SERIES_SQL}, date, y, score_{m} AS score, thr_{m} AS threshold FROM {rows})"
    det, epi = (re.sub(r"\bpred\b", p + " pred", q).replace(p + " pred a ON", p + " a ON") for q in (DETECT_SQL, EPISODE_SQL))
    return f"""SELECT '{m}' AS key, q.n_rows, round(pos_rate, 8) AS pos_rate, round(c.ap, 6) AS pr_auc, round(c.auc, 6) AS roc_auc, round(tp / nullif(tp + fp, 0), 8) AS precision, round(tp / nullif(tp + fn, 0), 8) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END, 8) AS f1, round(1 - tp / nullif(tp + fp, 0), 8) AS far, round((tp + fp) / n_rows, 8) AS alarm_rate,
        d.n AS n_events, round(d.rate, 8) AS event_detection_rate, d.mid AS median_lead_days, round(d.mean, 8) AS mean_lead_days, round(d.share, 8) AS share_lead_ge_7, round(e.f / greatest(q.series * q.span / 365.25, 1e-9), 8) AS false_episodes_per_series_year, round(1 - e.f / e.n, 8) AS episode_precision
        FROM (SELECT count(*) AS n_rows, avg(y) AS pos_rate, count(DISTINCT (commodity_id, province_id)) AS series, max(date) - min(date) AS span, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (NOT coalesce(score >= threshold, false) AND y = 1) AS fn FROM {p}) q,
        (SELECT sum(pos / p_all * tp / (tp + fp)) AS ap, sum(pos * (n_all - fp + (n - pos) / 2.0)) / min(p_all) / min(n_all) AS auc FROM (SELECT *, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER () AS p_all, sum(n - pos) OVER () AS n_all FROM (SELECT score, sum(y) AS pos, count(*) AS n FROM {p} WHERE score IS NOT NULL GROUP BY 1) WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))) c,
        (SELECT count(*) AS n, avg(detected::INT) AS rate, median(lead_days)::DOUBLE AS mid, avg(lead_days) AS mean, avg(coalesce(lead_days >= 7, false)::INT) AS share FROM ({det})) d, (SELECT count(*) AS n, sum(is_false::INT) AS f FROM ({epi})) e"""


@query("compare_models", with_(" UNION ALL ".join(_summary_sql(m) for m in ("naive", "seasonal")), **WF_SQL))
def compare_models(spark, d):
    x = marked(spark, d)
    out = events.compare_models(materialize(forward(spark, d, x)), materialize(labels.events_table(x, TARGET)))
    out = rounded(out, "pr_auc", "roc_auc")
    return rounded(out, "pos_rate", "precision", "recall", "f1", "far", "alarm_rate", "event_detection_rate", "mean_lead_days", "share_lead_ge_7", "false_episodes_per_series_year", "episode_precision", n=8)


@query("site_summary", with_("SELECT max(pr_auc) FILTER (key = 'seasonal') AS pr_auc, max(pr_auc) FILTER (key = 'naive') AS pr_auc_naive, " + ", ".join(
    f"max({c}) FILTER (key = 'seasonal') AS {c}" for c in ("event_detection_rate", "median_lead_days", "far", "false_episodes_per_series_year")) + " FROM (" + " UNION ALL ".join(_summary_sql(m) for m in ("naive", "seasonal")) + ")", **WF_SQL))
def site_summary(spark, d):
    return events.site_summary(compare_models(spark, d), "seasonal")


GRID = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6)


def _sweep_sql(t: float) -> str:
    p = f"(SELECT {SERIES_SQL}, date, y, score, {t}::DOUBLE AS threshold FROM pred)"
    det, epi = (re.sub(r"\bpred\b", "one_", q) for q in (DETECT_SQL, EPISODE_SQL))
    return f"""SELECT {t}::DOUBLE AS threshold, n_rows, round(tp / nullif(tp + fp, 0), 8) AS precision, round(tp / nullif(p, 0), 8) AS recall, round(1 - tp / nullif(tp + fp, 0), 8) AS far, round((tp + fp) / n_rows, 8) AS alarm_rate,
        d.n AS n_events, round(d.rate, 8) AS event_detection_rate, d.mid AS median_lead_days, e.n AS n_episodes, round(coalesce(e.f, 0) / greatest(q.series * q.span / 365.25, 1e-9), 8) AS false_episodes_per_series_year
        FROM (SELECT count(*) AS n_rows, count(DISTINCT (commodity_id, province_id)) AS series, max(date) - min(date) AS span, sum(y) AS p, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp FROM {p}) q,
        (WITH one_ AS {p} SELECT count(*) AS n, avg(detected::INT) AS rate, median(lead_days)::DOUBLE AS mid FROM ({det})) d,
        (WITH one_ AS {p} SELECT count(*) AS n, sum(is_false::INT) AS f FROM ({epi})) e"""


@query("threshold_sweep_events", with_(" UNION ALL ".join(_sweep_sql(t) for t in GRID)))
def threshold_sweep_events(spark, d):
    """Rows, events and episodes of last week's return as a score, at nine thresholds."""
    x = materialize(marked(spark, d))
    pred = materialize(predictions(x).select(*SERIES, "date", "y", "score"))
    out = events.threshold_sweep(pred, materialize(labels.events_table(x, TARGET)), GRID)
    return rounded(out, "precision", "recall", "far", "alarm_rate", "event_detection_rate", "false_episodes_per_series_year", n=8)


WEEKLY_SQL = WF_SQL | {
    "wk": WK_SQL,
    "wkroles": """SELECT commodity_id, province_id, date, m.y, f.fold, CASE WHEN date BETWEEN val_start AND val_end THEN 'val' WHEN date BETWEEN test_start AND test_end THEN 'test' END AS role, ret AS score_weekly
        FROM wk JOIN marked m USING (commodity_id, province_id, date) CROSS JOIN folds_ f WHERE ret IS NOT NULL AND m.eligible AND m.y IS NOT NULL""",
    "wkthr": """SELECT fold, CASE WHEN max(p_all) = 0 THEN max(score) + 1e-9 ELSE arg_max(score, (round(f, 12), -score)) END AS thr
        FROM (SELECT fold, score, p_all, coalesce(2.0 * tp / nullif(tp + fp + p_all, 0), 0) AS f
            FROM (SELECT fold, score, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER (PARTITION BY fold) AS p_all
                FROM (SELECT fold, score_weekly AS score, sum(y) AS pos, count(*) AS n FROM wkroles WHERE role = 'val' GROUP BY 1, 2)
                WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING)))
        GROUP BY 1""",
    "wkpred": """SELECT p.*, r.score_weekly, t.thr AS thr_weekly FROM wfpred p JOIN (SELECT * FROM wkroles WHERE role = 'test') r USING (commodity_id, province_id, date, fold) LEFT JOIN wkthr t ON t.fold = p.fold""",
}


@query("compare_weekly", with_(" UNION ALL ".join(_summary_sql(m, "wkpred") for m in ("naive", "seasonal", "weekly")), **WEEKLY_SQL))
def compare_weekly(spark, d):
    """Naive, seasonal and last week's return as a score on the same rows: the weekly origins that all three score."""
    x = materialize(marked(spark, d))
    pred = forward(spark, d, x)
    ends = materialize(panel.weekly(clean_panel(spark, d)).where("ret is not null").select(*SERIES, "date", F.col("ret").alias("score")))
    weekly = events.fold_roles(ends, folds(spark, d)).where("role <> 'fit'").drop("role")
    rows = models.weekly_comparison(pred, weekly, x.where("eligible and y is not null"), folds(spark, d), "weekly")
    out = events.compare_models(materialize(rows), materialize(labels.events_table(x, TARGET)))
    out = rounded(out, "pr_auc", "roc_auc")
    return rounded(out, "pos_rate", "precision", "recall", "f1", "far", "alarm_rate", "event_detection_rate", "mean_lead_days", "share_lead_ge_7", "false_episodes_per_series_year", "episode_precision", n=8)


CTE["fut"] = f"SELECT commodity_id, province_id, date, onset, coalesce(max(onset) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING), 0) AS f FROM (SELECT * FROM marked)"
CTE["futlate"] = f"SELECT commodity_id, province_id, date, onset, coalesce(max(onset) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING), 0) AS f FROM (SELECT * FROM marked WHERE date >= DATE '1999-01-01')"


def _precedence_sql(fut: str) -> str:
    per = f"(SELECT commodity_id, province_id, sum(onset)::BIGINT AS n, avg(f) AS base FROM {fut} GROUP BY 1, 2)"
    return f"""SELECT a.commodity_id, a.province_id AS source, b.province_id AS target, a.n AS n_onset_source, b.n AS n_onset_target, coalesce(c.k, 0)::BIGINT AS n_followed, coalesce(c.k, 0) / nullif(a.n, 0) / nullif(b.base, 0) AS lift
        FROM {per} a JOIN {per} b ON a.commodity_id = b.commodity_id AND a.province_id <> b.province_id LEFT JOIN (SELECT x.commodity_id, x.province_id AS p, z.province_id AS q, sum(x.onset * z.f) AS k FROM {fut} x JOIN {fut} z ON x.commodity_id = z.commodity_id AND x.date = z.date GROUP BY 1, 2, 3) c ON c.commodity_id = a.commodity_id AND c.p = a.province_id AND c.q = b.province_id"""


@query("network_with_precedence", with_(f"SELECT commodity_id, source, target, q_value < 0.02 AND coef_sum > 0 AS significant, n_onset_source, n_onset_target, n_followed, round(lift, 6) AS lift FROM bh LEFT JOIN ({_precedence_sql('fut')}) p USING (commodity_id, source, target)"))
def network_with_precedence(spark, d):
    out = graph.with_precedence(_significant(spark, d), graph.precedence(marked(spark, d)))
    return rounded(out.select("commodity_id", "source", "target", "significant", "n_onset_source", "n_onset_target", "n_followed", "lift"), "lift")


@query("network_out_of_period", with_(f"""SELECT *, round(lift_significant / nullif(lift_others, 0), 5) AS ratio FROM (SELECT commodity_id, round(avg(lift) FILTER (s), 6) AS lift_significant, round(avg(lift) FILTER (NOT s), 6) AS lift_others, count(*) FILTER (s) AS n_significant
    FROM (SELECT *, q_value < 0.02 AND coef_sum > 0 AS s FROM bh) JOIN ({_precedence_sql('futlate')}) p USING (commodity_id, source, target) WHERE lift IS NOT NULL AND n_onset_source >= 3 AND commodity_id IN (SELECT commodity_id FROM futlate GROUP BY 1 HAVING sum(onset) >= 20) GROUP BY 1)
    WHERE lift_significant IS NOT NULL AND lift_others IS NOT NULL"""))
def network_out_of_period(spark, d):
    out = rounded(graph.out_of_period(_significant(spark, d), marked(spark, d).where("date >= date'1999-01-01'")), "lift_significant", "lift_others")
    return out.select("commodity_id", "lift_significant", "lift_others", "n_significant", F.round(F.try_divide("lift_significant", "lift_others"), 5).alias("ratio"))


@query("psi_bands", with_("SELECT feature, psi, CASE WHEN psi <= 0.1 THEN 'stable' WHEN psi <= 0.25 THEN 'moderate' ELSE 'drifted' END AS band FROM (" + " UNION ALL ".join(f"""SELECT '{n}' AS feature, round(sum((pa - pe) * ln(pa / pe)), 6) AS psi FROM (SELECT greatest(1e-4, count(*) FILTER (e) / (SELECT count(*) FILTER (e) FROM {t})) AS pe, greatest(1e-4, count(*) FILTER (NOT e) / (SELECT count(*) FILTER (NOT e) FROM {t})) AS pa
    FROM (SELECT e, least(len(edges) - 2, len(list_filter(edges, lambda v: v <= least(greatest(x, edges[1]), edges[-1]))) - 1) AS bin FROM {t}, {t}e) GROUP BY bin)""" for n, t in (("x", "bx"), ("r14", "br"))) + ")",
    bx="SELECT ln(price) AS x, date < DATE '1999-01-01' AS e FROM marked WHERE price IS NOT NULL", br="SELECT r14 AS x, date < DATE '1999-01-01' AS e FROM marked WHERE r14 IS NOT NULL",
    **{f"{t}e": f"SELECT list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM {t} WHERE e" for t in ("bx", "br")}))
def psi_bands(spark, d):
    x = marked(spark, d).select("date", F.ln("price").alias("x"), "r14")
    out = [metrics.psi(x, f, F.col("date") < F.to_date(F.lit("1999-01-01"))).select(F.lit(f).alias("feature"), F.round("psi", 6).alias("psi")) for f in ("x", "r14")]
    return out[0].unionByName(out[1]).select("*", metrics.psi_band(F.col("psi")).alias("band"))


@query("dependence_bins", with_("""SELECT coalesce(least(24, floor((z - low) / nullif(high - low, 0) * 25)), 0)::INT AS bin, count(*) AS n, round(avg(z), 6) AS x, round(avg(y), 6) AS mean FROM (SELECT greatest(low, least(high, r14)) AS z, y, low, high FROM (SELECT r14, y FROM marked WHERE r14 IS NOT NULL AND y IS NOT NULL),
    (SELECT quantile_cont(r14, 0.01) AS low, quantile_cont(r14, 0.99) AS high FROM marked WHERE r14 IS NOT NULL AND y IS NOT NULL)) GROUP BY 1"""))
def dependence_bins(spark, d):
    return rounded(metrics.dependence(marked(spark, d), "r14", "y"), "x", "mean")


@query("fold_statistics", with_("""SELECT model, round(avg(ap), 6) AS mean, round(stddev_samp(ap), 6) AS sd, round(min(ap), 6) AS least, round(max(ap), 6) AS most, round(avg(won), 6) AS share_won FROM (SELECT a.model, a.ap, CASE WHEN a.ap IS NOT NULL AND b.ap IS NOT NULL THEN (a.ap > b.ap)::INT END AS won FROM faps a LEFT JOIN (SELECT * FROM faps WHERE model = 'seasonal') b USING (fold)) GROUP BY 1""",
    faps=" UNION ALL ".join(f"""SELECT fold, '{m}' AS model, round(CASE WHEN min(p_all) > 0 AND min(n_all) > 0 THEN sum(pos / p_all * tp / (tp + fp)) END, 8) AS ap FROM (SELECT *, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER (PARTITION BY fold) AS p_all, sum(n - pos) OVER (PARTITION BY fold) AS n_all FROM (
        SELECT fold, round(score_{m}, 9) AS score, sum(y) AS pos, count(*) AS n FROM wfpred WHERE score_{m} IS NOT NULL GROUP BY 1, 2) WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY fold""" for m in ("naive", "seasonal")), **WF_SQL))
def fold_statistics(spark, d):
    p = materialize(forward(spark, d, marked(spark, d)))
    x = p.select("fold", "y", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.round(f"score_{m}", 9).alias("score")) for m in ("naive", "seasonal")])).alias("e")).select("fold", "y", "e.*")
    ap = rounded(metrics.average_precision(x, ["fold", "model"]), "ap", n=8)
    return rounded(metrics.fold_statistics(ap, "fold", "model", "ap", "seasonal"), "mean", "sd", "least", "most", "share_won")


@query("future_returns", with_(f"SELECT commodity_id, province_id, date, " + ", ".join(f"round(lead(ln(price), {k}) OVER ({W}) - ln(price), 6) + 0 AS fwd_{k}" for k in (7, 14)) + " FROM panel"))
def future_returns(spark, d):
    x = clean_panel(spark, d).select(*SERIES, "date", F.ln("price").alias("x"))
    return x.select(*SERIES, "date", *[(F.round(F.lead("x", k).over(panel.in_order()) - F.col("x"), 6) + F.lit(0.0)).alias(f"fwd_{k}") for k in (7, 14)])


@query("seeded_sample", with_("SELECT commodity_id, province_id, date, y FROM marked WHERE y IS NOT NULL AND md5('7:' || commodity_id || ':' || province_id || ':' || date) < '1999'"))
def seeded_sample(spark, d):
    """A tenth of the labelled rows, drawn by a hash of their keys, so that it is the same in any order of rows."""
    name = F.concat_ws(":", F.lit("7"), "commodity_id", F.col("province_id").cast("string"), F.col("date").cast("string"))
    return labelled(spark, d).where("y is not null").where(F.md5(name.cast("binary")) < "1999").select(*SERIES, "date", "y")


# --- models (rows only: training has no SQL)

SPLIT = "2000-01-01"


def _split(spark, d) -> tuple[DataFrame, DataFrame, list[str]]:
    x = materialize(features.modeling_rows(feature_table_of(spark, d)))
    before = F.col("date") < SPLIT
    return x.where(before), x.where(~before), features.feature_columns(x.columns)


@query("logreg_scores")
def logreg_scores(spark, d):
    fit, test, cols = _split(spark, d)
    m = models.fit_logistic(fit, [c for c in cols if c not in features.IDENTITY])
    return models.scored(m, test).select(*SERIES, "date", "y", "score")


ROUNDS = 60  # of boosting in these queries, of which the validation rows keep the best; the library's default is 300


def _boosted(spark, d) -> tuple[PipelineModel, DataFrame, DataFrame, list[str]]:
    """A model of the rows before SPLIT, cut at its best round; validation and test rows."""
    fit, test, cols = _split(spark, d)
    late = F.col("date") > F.date_sub(F.lit(SPLIT).cast("date"), 120)
    val = fit.where(late)
    return models.fit_boosted(fit.where(~late), cols, val, trees=ROUNDS), val, test, cols


@query("gbt_scores")
def gbt_scores(spark, d):
    """Scores of boosted trees, as many as do best on the validation rows."""
    model, _, test, _ = _boosted(spark, d)
    return models.scored(model, test).select(*SERIES, "date", "y", "score")


@query("boosting_rounds")
def boosting_rounds(spark, d):
    """Average precision on the validation rows after each round of boosting, and whether early stopping keeps the round."""
    fit, _, cols = _split(spark, d)
    late = F.col("date") > F.date_sub(F.lit(SPLIT).cast("date"), 120)
    model = models.fit_boosted(fit.where(~late), cols, None, trees=ROUNDS)
    by_round = materialize(models.round_precision(model, fit.where(late)))
    return by_round.select("round", "ap", (F.col("round") == F.lit(models.best_round(by_round))).alias("kept"))


@query("tree_reasons")
def tree_reasons(spark, d):
    """Reasons of the newest risks by Shapley values of the boosted trees."""
    model, _, test, cols = _boosted(spark, d)
    last = test.agg(F.max("date").alias("date"))
    return models.top_reasons(models.contributions(model, test.join(F.broadcast(last), "date"), cols))


@query("tree_importance")
def tree_importance(spark, d):
    """Mean absolute Shapley values of the boosted trees over all test rows, by feature group."""
    model, _, test, cols = _boosted(spark, d)
    return models.importance_by_group(models.importance(models.contributions(model, test, cols)))


@query("top_reasons")
def top_reasons(spark, d):
    fit, test, cols = _split(spark, d)
    cols = [c for c in cols if c not in features.IDENTITY]
    last = test.agg(F.max("date").alias("date"))
    return models.top_reasons(models.contributions(models.fit_logistic(fit, cols), models.finite(test.join(F.broadcast(last), "date"), cols), cols))


@query("importance_by_group")
def importance_by_group(spark, d):
    """Mean absolute contributions of the linear model, by feature group."""
    fit, test, cols = _split(spark, d)
    cols = [c for c in cols if c not in features.IDENTITY]
    return models.importance_by_group(models.importance(models.contributions(models.fit_logistic(fit, cols), models.finite(test, cols), cols)))


@query("ablation_folds")
def ablation_folds(spark, d):
    """What feature groups are worth: average precision by fold with all numbers, without a group, and with own prices alone."""
    x = features.modeling_rows(feature_table_of(spark, d))
    numbers = [c for c in features.feature_columns(x.columns) if c not in features.IDENTITY]
    without = {f"without {g}": [c for c in numbers if features.group_of(c) != g] for g in ("rain", "calendar", "neighbours", "supply_chain")}
    own = [c for c in numbers if features.group_of(c) == "price"]
    parts = events.make_folds(fx.observations(spark, d), "2000-10-01")
    out = grid.ablation(x.select(*SERIES, "date", "y", *numbers), parts, {"all": numbers, **without, "price alone": own})
    return out.select("candidate", "fold", "n", F.round("ap", 4).alias("ap"))


@query("latest_risk")
def latest_risk(spark, d):
    """Final training on all labelled rows, then the newest day's risks with reasons, places and categories."""
    x = materialize(feature_table_of(spark, d))
    model, threshold = models.final_model(features.modeling_rows(x), features.feature_columns(x.columns), trees=ROUNDS)
    places = fx.provinces(spark).select("province_id", "province", "lat", "lon")
    return models.predict_latest(model, threshold, x, {"province_id": F.broadcast(places), "commodity_id": categories(spark)})


@query("sarima_scores")
def sarima_scores(spark, d):
    return models.sarima_scores(panel.weekly(clean_panel(spark, d)), 1.0, "1998-12-31", "1999-01-01", "2001-12-31")


@query("seasonal_naive_scores", with_(f"SELECT commodity_id, province_id, date, round(ln(price) - lag(ln(price), 7) OVER ({W}), 6) AS naive, round(lag(ln(price), 350) OVER ({W}) - lag(ln(price), 364) OVER ({W}), 6) AS seasonal FROM panel"))
def seasonal_naive_scores(spark, d):
    x = clean_panel(spark, d).select(*SERIES, "date", F.ln("price").alias("x"))
    return rounded(x.select(*SERIES, "date", models.naive(F.col("x")).alias("naive"), models.seasonal_naive(F.col("x")).alias("seasonal")), "naive", "seasonal")
