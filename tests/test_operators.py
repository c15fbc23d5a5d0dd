import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.config import Target
from tidepanel.functions import geo, metrics
from tidepanel.operators import calendar, events, graph, labels, panel, weather
from tidepanel.sources import fixtures, grid_json

DAY = dt.date(2020, 1, 1)


def series(spark, values, com="com_1", prov=1, start=DAY):
    rows = [(com, prov, start + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "commodity_id string, province_id int, date date, price double")


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_parse_price(spark):
    df = spark.createDataFrame([(x,) for x in ["67,000", " 12 ", "-", "", None, "0", "-5", "abc", "NaN"]], "v string")
    assert [r[0] for r in df.select(grid_json.parse_price(F.col("v"))).collect()] == [67000.0, 12.0, None, None, None, None, None, None, None]


def test_month_chunks_clip(spark):
    got = [tuple(r) for r in grid_json.month_chunks(spark, "2020-01-15", "2020-03-02").orderBy("chunk_start").collect()]
    assert got == [(dt.date(2020, 1, 15), dt.date(2020, 1, 31)), (dt.date(2020, 2, 1), dt.date(2020, 2, 29)), (dt.date(2020, 3, 1), dt.date(2020, 3, 2))]


def test_grid_is_of_dates_with_any_price(spark):
    obs = spark.createDataFrame([(1, "a", 1, DAY, 1.0), (1, "b", 1, DAY + dt.timedelta(days=2), 2.0), (1, "b", 1, DAY + dt.timedelta(days=1), None), (2, "a", 1, DAY + dt.timedelta(days=5), 3.0)], "price_type_id int, commodity_id string, province_id int, date date, price double")
    assert panel.observation_grid(obs, 1).count() == 4


def test_smoothing_fills_short_gaps_and_calendar_fills_seven_days(spark):
    flagged = series(spark, [10.0, None, None, None, 12.0]).withColumn("bad", F.lit(False))
    assert column(panel.smooth(flagged), "price") == [10.0, 10.0, 10.0, None, 12.0]
    sparse = series(spark, [5.0])
    span = spark.createDataFrame([(DAY, DAY + dt.timedelta(days=9))], "first date, last date")
    assert column(panel.to_calendar(sparse, span, 7), "price") == [5.0] * 8 + [None, None]


def test_blip_is_flagged_but_a_step_is_not(spark):
    blip = panel.flag_bad_values(series(spark, [10.0, 10.0, 30.0, 10.0, 10.0]))
    assert column(blip, "bad") == [False, False, True, False, False]
    step = panel.flag_bad_values(series(spark, [10.0, 10.0, 30.0, 30.0, 30.0]))
    assert not any(column(step, "bad"))


def test_labels_against_pandas(spark):
    rng = np.random.default_rng(1)
    values = [None if x < 0.05 else float(v) for x, v in zip(rng.random(120), np.exp(np.cumsum(rng.normal(0, 0.05, 120))))]
    got = labels.make_labels(series(spark, values), Target(threshold=0.15)).orderBy("date").toPandas()
    p = pd.Series(values, dtype=float)
    r = p / p.shift(14) - 1
    s0 = (r > 0.15).astype(float)
    onset = ((s0 == 1) & (s0.shift(1).rolling(14, min_periods=1).max().fillna(0) == 0)).astype(float)
    y = onset[::-1].rolling(14, min_periods=1).max()[::-1].shift(-1)
    valid = r.notna().astype(float)[::-1].rolling(14, min_periods=1).sum()[::-1].shift(-1)
    y = y.where(valid >= 7)
    y[len(y) - 14 :] = np.nan
    np.testing.assert_allclose(got["r14"].astype(float), r, atol=1e-12)
    assert got["onset"].tolist() == onset.astype(int).tolist()
    np.testing.assert_array_equal(got["y"].astype(float), y)
    assert got["eligible"].tolist() == ((r.notna()) & (s0 == 0) & p.notna()).tolist()


def test_labels_do_not_look_back_from_the_future(spark):
    values = [float(v) for v in np.exp(np.cumsum(np.random.default_rng(2).normal(0, 0.05, 90)))]
    full = labels.make_labels(series(spark, values)).where(F.col("date") < DAY + dt.timedelta(days=60)).orderBy("date").select("r14", "spike", "onset").collect()
    cut = labels.make_labels(series(spark, values[:60])).orderBy("date").select("r14", "spike", "onset").collect()
    assert full == cut


def test_runs_and_days_since(spark):
    x = panel.numbered(series(spark, [1.0] * 7)).withColumn("f", F.element_at(F.array(*[F.lit(v) for v in (0, 1, 1, 0, 0, 1, 1)]), F.col("i").cast("int")))
    assert column(x.select("date", panel.run_length("f").alias("v")), "v") == [0, 2, 1, 0, 0, 2, 1]
    assert column(x.select("date", panel.days_since("f", 9).alias("v")), "v") == [9, 0, 0, 1, 2, 0, 0]


def test_granger_against_least_squares(spark):
    rng = np.random.default_rng(3)
    n = 200
    a = rng.normal(size=n)
    b = np.concatenate([[0, 0], 0.6 * a[:-2]]) + rng.normal(size=n) * 0.5
    rows = [("c", p, DAY + dt.timedelta(weeks=i), float(v)) for p, x in ((1, a), (2, b)) for i, v in enumerate(x)]
    e = {(r.source, r.target): r for r in graph.granger_edges(spark.createDataFrame(rows, "commodity_id string, province_id int, date date, ret double")).collect()}
    y, own, src = b[2:], np.column_stack([b[1:-1], b[:-2]]), np.column_stack([a[1:-1], a[:-2]])
    one = np.ones((len(y), 1))
    rss = [float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()) for x in (np.hstack([one, own]), np.hstack([one, own, src]))]
    f = (rss[0] - rss[1]) / 2 / (rss[1] / (len(y) - 5))
    assert e[1, 2].F == pytest.approx(f, rel=1e-9) and e[1, 2].p_value < 1e-10 < e[2, 1].p_value


@pytest.mark.parametrize("f,d1,d2", [(0.5, 3, 40), (2.7, 1, 25), (4.1, 4, 200)])
def test_f_tail(f, d1, d2):
    u = np.linspace(0, math.sqrt(f), 200_001)[1:]  # x = u * u: with one degree of freedom the density has a pole at 0
    x = u * u
    c = math.exp(math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2)) * (d1 / d2) ** (d1 / 2)
    density = c * x ** (d1 / 2 - 1) * (1 + d1 * x / d2) ** (-(d1 + d2) / 2)
    assert graph.f_tail(f, d1, d2) == pytest.approx(1 - np.trapezoid(density * 2 * u, u), abs=2e-5)


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 0.2, None, 0.04]
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(p)], "commodity_id string, i int, p_value double")
    got = column(graph.bh_fdr(df), "q_value", "i")
    assert [None if q is None else round(q, 6) for q in got] == [0.05, 0.05, 0.05, 0.2, None, 0.05]


def test_ranking_metrics(spark):
    rng = np.random.default_rng(4)
    y, s = (rng.random(300) < 0.2).astype(int), np.round(rng.random(300), 1)
    df = spark.createDataFrame([("g", int(a), float(b)) for a, b in zip(y, s)] + [("one", 1, 0.5), ("g", 1, None)], "g string, y int, score double")
    thr = np.unique(s)[::-1]
    tp = np.array([(y[s >= t] == 1).sum() for t in thr])
    n = np.array([(s >= t).sum() for t in thr])
    ap = float((np.diff(np.concatenate([[0], tp])) / y.sum() * tp / n).sum())
    pairs = (s[y == 1][:, None] > s[y == 0][None, :]) + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :])
    got = {r.g: r.ap for r in metrics.average_precision(df, ["g"]).collect()}
    assert got["g"] == pytest.approx(ap) and got["one"] is None
    auc = {r.g: r.auc for r in metrics.roc_auc(df, ["g"]).collect()}
    assert auc["g"] == pytest.approx(float(pairs.mean())) and auc["one"] is None
    f1 = 2 * tp / (n + y.sum())
    best = min(t for t, f in zip(thr, f1) if f >= f1.max() - 1e-12)
    assert {r.g: r.threshold for r in metrics.best_threshold(df, ["g"]).collect()}["g"] == best


def test_episodes_and_detection(spark):
    days = [0, 1, 5, 20]
    pred = spark.createDataFrame([("a", 1, DAY + dt.timedelta(days=i), 1.0 if i in days else 0.0, 0.5) for i in range(40)], "commodity_id string, province_id int, date date, score double, threshold double")
    ev = spark.createDataFrame([("a", 1, DAY + dt.timedelta(days=14)), ("a", 1, DAY + dt.timedelta(days=38))], "commodity_id string, province_id int, date date")
    ep = [(r.start, r.end, r.n_days, r.is_false) for r in events.alarm_episodes(pred, ev).orderBy("start").collect()]
    assert ep == [(DAY, DAY + dt.timedelta(days=5), 3, False), (DAY + dt.timedelta(days=20), DAY + dt.timedelta(days=20), 1, True)]
    det = [(r.detected, r.lead_days) for r in events.event_detection(pred, ev).orderBy("date").collect()]
    assert det == [(True, 14), (False, None)]


def test_calendar(spark):
    h = fixtures.holidays(spark, 2019, 2021)
    days = spark.createDataFrame([(dt.date(2020, 5, 24),), (dt.date(2020, 5, 1),), (dt.date(2021, 12, 31),)], "date date")
    got = {r.date: r for r in calendar.calendar_features(days, h).collect()}
    assert got[dt.date(2020, 5, 24)].days_to_idulfitri == 0 == got[dt.date(2020, 5, 24)].days_since_idulfitri
    assert got[dt.date(2020, 5, 1)].is_ramadan == 1 and got[dt.date(2020, 5, 24)].is_ramadan == 0
    assert got[dt.date(2021, 12, 31)].days_to_natal is None and got[dt.date(2021, 12, 31)].is_nataru == 1


def test_business_days(spark):
    days = pd.date_range("2020-01-01", "2020-02-20")
    rows = [(days[i].date(), days[j].date()) for i in range(0, 20) for j in range(i, len(days), 7)]
    got = spark.createDataFrame(rows, "a date, b date").select("a", "b", calendar.business_days(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == len(pd.bdate_range(r.a, r.b)) for r in got)


def test_climatology_wraps_the_year(spark):
    days = pd.date_range("2001-01-01", "2002-12-31")
    x = np.random.default_rng(5).random(len(days))
    df = spark.createDataFrame([(1, d.date(), float(v)) for d, v in zip(days, x)], "province_id int, date date, roll_7 double")
    got = {r.doy: r for r in weather.climatology(df, 7, "2001-01-01", "2002-12-31").collect()}
    doy = np.minimum(days.dayofyear, 365).to_numpy()
    for d in (1, 180, 365):
        sel = x[np.abs((doy - d + 182) % 365 - 182) <= 15]
        assert got[d].mu == pytest.approx(sel.mean()) and got[d].sd == pytest.approx(sel.std())


def test_nearest_and_folds(spark):
    near = geo.nearest(fixtures.provinces(spark), 3)
    assert near.count() == 102 and near.where("province_id = other").count() == 0
    f = events.make_folds(spark.createDataFrame([(dt.date(2022, 8, 20),)], "date date"), "2022-01-01").orderBy("fold").collect()
    assert [tuple(r) for r in f][0] == (0, dt.date(2021, 8, 5), dt.date(2021, 8, 20), dt.date(2021, 12, 17), dt.date(2022, 1, 1), dt.date(2022, 3, 31)) and f[-1].test_end == dt.date(2022, 8, 20)


def test_upsert_keeps_old_and_prefers_fresh(spark):
    cached = spark.createDataFrame([(1, DAY, 1.0), (1, DAY + dt.timedelta(days=60), 2.0)], "province_id int, date date, v double")
    fresh = spark.createDataFrame([(1, DAY + dt.timedelta(days=60), 9.0)], "province_id int, date date, v double")
    assert sorted(r.v for r in grid_json.upsert_recent(cached, fresh, ["province_id", "date"], "v").collect()) == [1.0, 9.0]
