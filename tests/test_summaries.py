import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import metrics
from tidepanel.operators import events, models, reports
from tidepanel.plans.model_queries import _summary_sql
from tidepanel.plans.panel_queries import rounded
from tidepanel.plans.report_queries import CRITERIA_SQL

START = dt.date(2024, 1, 1)
PRED = "commodity_id string, province_id int, date date, y int, score_m double, thr_m double"


def day(n):
    return START + dt.timedelta(days=n)


def flat(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v if v is None or isinstance(v, (str, bool)) else round(float(v), 6)


def against_sql(spark, rows, onsets):
    """Rows of the summary of one model by Spark and by its SQL."""
    con = duckdb.connect()
    con.sql("create table rows_ (commodity_id varchar, province_id int, date date, y int, score_m double, thr_m double)")
    con.sql("create table events_ (date date, commodity_id varchar, province_id int)")
    for table, values in (("rows_", rows), ("events_", onsets)):
        for v in values:
            con.execute(f"insert into {table} values ({', '.join('?' * len(v))})", v)
    want = con.sql(_summary_sql("m", "rows_"))
    names = want.columns
    got = events.compare_models(spark.createDataFrame(rows, PRED), spark.createDataFrame(onsets, "date date, commodity_id string, province_id int"))
    return [[flat(r[c]) for c in names] for r in got.collect()], [[flat(v) for v in r] for r in want.fetchall()]


def row(n, y, score, thr=0.5):
    return ("c", 1, day(n), y, score, thr)


@pytest.mark.parametrize("rows", [
    [],
    [row(n, 0, n / 40) for n in range(40)],
    [row(n, 1, n / 40) for n in range(40)],
    [row(n, int(20 <= n < 34), n / 100) for n in range(40)],
    [row(n, int(20 <= n < 34), None) for n in range(40)],
    [row(n, int(20 <= n < 34), (n * 7 % 40) / 40) for n in range(40)],
], ids=["no rows", "no positive", "all positive", "no alarms", "no scores", "usual"])
def test_summaries_of_odd_predictions_equal_sql(spark, rows):
    got, want = against_sql(spark, rows, [(day(34), "c", 1)])
    assert got == want and len(got) == 1


def test_f1_that_ends_in_a_five_is_rounded_as_in_sql(spark):
    table = [("k", n, y, a) for n, y, a in ((1, 1, True), (1008, 0, True), (14, 1, False), (5, 0, False))]  # 2 / 1024 = 0.001953125
    rows = spark.createDataFrame([(k, y, float(a)) for k, n, y, a in table for _ in range(n)], "k string, y int, score double")
    got = rounded(metrics.confusion(["k"], rows, threshold=F.lit(0.5)), "f1", n=8).first()
    assert (got.tp, got.fp, got.fn, got.f1) == (1, 1008, 14, duckdb.connect().execute("SELECT round(2.0 * 1 / (2 * 1 + 1008 + 14), 8)").fetchone()[0])


def test_weekly_comparison_without_usable_folds_has_a_row_for_each_model(spark):
    keys = "commodity_id string, province_id int, date date"
    labels = spark.createDataFrame([("c", 1, day(n), 0) for n in range(120)], keys + ", y int")
    folds = spark.createDataFrame([(0, day(20), day(30), day(60), day(75), day(110))], "fold int, fit_end date, val_start date, val_end date, test_start date, test_end date")
    pred = models.walk_forward(labels.select("*", F.lit(0.1).alias("s")), folds, {"naive": F.col("s")})
    weekly = spark.createDataFrame([("c", 1, day(n), 0, 0.2) for n in range(35, 110, 7)], keys + ", fold int, score double")
    both = models.weekly_comparison(pred, weekly, labels, folds, "weekly")
    got = events.compare_models(both, spark.createDataFrame([], "date date, commodity_id string, province_id int")).collect()
    assert [(r.key, r.n_rows, r.n_events) for r in got] == [("naive", 0, 0), ("weekly", 0, 0)] and all(math.isnan(r.alarm_rate) and r.pr_auc is None for r in got)


@pytest.mark.parametrize("ap,base", [(math.nan, math.nan), (math.nan, 0.2), (0.2, math.nan), (0.3, 0.2), (None, None)])
def test_criteria_of_nan_equal_sql(spark, ap, base):
    table = spark.createDataFrame([("m", ap, 0.7, 9.0, 0.2, 0.1), ("naive", base, 0.1, 3.0, 0.5, 1.0)], "key string, pr_auc double, event_detection_rate double, median_lead_days double, far double, false_episodes_per_series_year double")
    got = [tuple(flat(v) for v in (r.criterion, r.result, r.met)) for r in reports.success_criteria(table, "m").collect()]
    want = duckdb.connect().execute("WITH one_ AS (SELECT ?::DOUBLE AS ap, ?::DOUBLE AS base, ?::DOUBLE AS best, 0.7 AS rate, 9.0 AS mid, 0.2 AS far, 0.1 AS f) " + CRITERIA_SQL, [ap, base, base]).fetchall()
    assert sorted(got) == sorted(tuple(flat(v) for v in (c, result, met)) for c, _, result, met in want)


def test_a_model_of_one_class_has_no_shares(spark):
    rows = spark.createDataFrame([("c", 1, day(n), 0, float(n % 7), float(n % 5)) for n in range(200)], "commodity_id string, province_id int, date date, y int, ret_7 double, rain_30 double")
    shares = models.importance(models.contributions(models.fit_logistic(rows, ["ret_7", "rain_30"]), rows, ["ret_7", "rain_30"]))
    assert {(r.feature, r.mean_abs, r.share) for r in shares.collect()} == {("ret_7", 0.0, None), ("rain_30", 0.0, None)}
    assert {(r.group, r.mean_abs, r.share) for r in models.importance_by_group(shares).collect()} == {("price", 0.0, None), ("rain", 0.0, None)}
