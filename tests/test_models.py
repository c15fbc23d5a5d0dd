import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.config import Features, Target
from tidepanel.functions import metrics
from tidepanel.operators import calendar, events, features, labels, models, weather
from tidepanel.sources import fixtures as fx

DAY = dt.date(2018, 1, 1)


def prices(days, seed=1, until=None):
    r = np.random.default_rng(seed)
    rows = []
    for c in ("com_1", "com_2"):
        for p in (0, 1, 2, 3):
            x = 10 + np.cumsum(r.normal(0, 0.04, days))
            rows += [(c, p, DAY + dt.timedelta(i), None if r.random() < 0.03 else float(math.exp(v))) for i, v in enumerate(x)]
    return [x for x in rows if until is None or x[2] <= until]


def table(spark, until=None, days=520):
    schema = "commodity_id string, province_id int, date date, price double"
    panels = {k: spark.createDataFrame(prices(days, k, until), schema) for k in (1, 2, 3, 4)}
    marked = labels.make_labels(panels[1].where("province_id > 0"), Target(threshold=0.12))
    near = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2)], "province_id int, other int")
    rain = [(p, DAY + dt.timedelta(i), float((i * 7 + p * 3) % 11)) for p in (1, 2, 3) for i in range(days)]
    rain = spark.createDataFrame([r for r in rain if until is None or r[1] <= until], "province_id int, date date, precip_mm double")
    days_ = marked.select("date").distinct()
    codes = spark.createDataFrame([("com_1", 1, 1), ("com_2", 2, 1)], "commodity_id string, commodity_code int, category_code int")
    anomaly = weather.anomalies(rain, "2018-01-01", "2018-06-30")
    cfg = Features(min_date="2018-02-01", centre_provinces=(1, 2))
    return features.build_features(marked, panels, near, near.select(F.lit("com_1").alias("commodity_id"), "*"), calendar.calendar_features(days_, fx.holidays(spark, 2017, 2020)), anomaly, codes, cfg)


def test_features_are_complete_and_never_look_ahead(spark):
    cut = DAY + dt.timedelta(450)
    whole = table(spark)
    cols = features.feature_columns(whole.columns)
    assert len(cols) == 78
    groups = [features.group_of(c) for c in cols]
    assert {g: groups.count(g) for g in features.GROUPS} == {"price": 20, "national": 6, "supply_chain": 18, "neighbours": 5, "leaders": 3, "calendar": 13, "rain": 10, "identity": 3}
    assert len(features.feature_columns(whole.columns, ("rain", "identity"))) == 65
    keep = cut - dt.timedelta(45)
    a = {(r.commodity_id, r.province_id, r.date): r for r in whole.where(F.col("date") <= keep).collect()}
    b = {(r.commodity_id, r.province_id, r.date): r for r in table(spark, cut).where(F.col("date") <= keep).collect()}
    assert a.keys() == b.keys() and len(a) > 1000 and all(r.date.weekday() < 5 for r in a.values())
    for k, r in a.items():
        for c in (*cols, "spike_now", "onset_now", "y"):
            x, y = r[c], b[k][c]
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-6, abs=1e-9)), (k, c)


def rows(spark, n=1500):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.0] - 1)))).astype(int)
    data = [("c", int(i % 5), DAY + dt.timedelta(int(i // 5)), int(t), float(a), None if i % 50 == 0 else float(b), float("inf") if i % 60 == 0 else float(c)) for i, (t, (a, b, c)) in enumerate(zip(y, x))]
    return spark.createDataFrame(data, "commodity_id string, province_id int, date date, y int, f1 double, f2 double, f3 double").repartition(3).cache()


def test_logistic_regression_against_newton_steps(spark):
    df = rows(spark)
    m = models.fit_logistic(df, ["f1", "f2", "f3"], rate=1.0, c=0.5)
    data = df.toPandas().sort_values(["date", "province_id"])
    x = data[["f1", "f2", "f3"]].replace(np.inf, np.nan)
    x = x.fillna(x.quantile(0.5, interpolation="lower")).to_numpy()
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    a, y, w = np.hstack([x, np.ones((len(x), 1))]), data["y"].to_numpy(), np.zeros(4)
    for _ in range(50):  # penalty of 1 / c on the weights alone
        p = 1 / (1 + np.exp(-a @ w))
        pen = np.diag([2.0, 2.0, 2.0, 0.0])
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pen, a.T @ (p - y) + pen @ w)
    got = np.array([r.score for r in models.scored(m, df).orderBy("date", "province_id").collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-a @ w)), atol=0.01)


def test_walk_forward_trains_on_the_past_alone(spark, tmp_path):
    df = rows(spark)
    folds = events.make_folds(df, "2018-07-01", 1, 30, 5)
    seen = []

    def train(fit, val):
        seen.append((fit.agg(F.max("date")).first()[0], val.agg(F.min("date"), F.max("date")).first()))
        rate = fit.agg(F.avg("y")).first()[0]
        return lambda x: x.select("*", (F.col("f1") * rate).alias("score"))

    out = models.walk_forward(df, folds, {"plain": F.col("f1")}, {"mean": train}).collect()
    for f, (last, (a, b)) in zip(folds.orderBy("fold").collect(), seen):
        assert last <= f.fit_end and f.val_start <= a and b <= f.val_end and b < f.test_start
        mine = [r for r in out if r.fold == f.fold]
        assert mine and all(f.test_start <= r.date <= f.test_end for r in mine) and len({r.thr_plain for r in mine}) == 1
    # the threshold is the best by F1 on the validation rows
    f = folds.orderBy("fold").first()
    val = df.where(F.col("date").between(f.val_start, f.val_end)).toPandas()
    best = max(sorted(val["f1"]), key=lambda t: (round(2 * ((val.f1 >= t) & (val.y == 1)).sum() / ((val.f1 >= t).sum() + val.y.sum()), 12), -t))
    assert [r for r in out if r.fold == f.fold][0].thr_plain == pytest.approx(best)


def test_final_model_round_trip_and_latest_risk(spark, tmp_path):
    df = rows(spark).select("*", F.lit(0).alias("spike_now"), F.lit(0.1).alias("r14_now"), F.col("f1").alias("ret_7"), F.col("province_id").alias("province_code"))
    model, thr = models.final_model(df, ["f1", "f2", "f3", "province_code"], val_days=60, trees=5)
    models.save_model(model, thr, str(tmp_path / "m"))
    again, same = models.load_model(spark, str(tmp_path / "m"))
    a, b = (sorted(map(str, models.predict_latest(m, t, df).collect())) for m, t in ((model, thr), (again, same)))
    assert a == b and len(a) == 5 and 0 < thr < 1
    auc = metrics.roc_auc(models.scored(model, df).select(F.lit(1).alias("g"), "y", "score"), ["g"]).first().auc
    assert auc > 0.8


def test_arima_scores_do_not_move_with_what_comes_later(spark):
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(0, 0.05, 200)) + 3
    week = [("c", 1, DAY + dt.timedelta(7 * i), None if i in (50, 140) else float(v)) for i, v in enumerate(x)]
    later = week[:160] + [(*r[:3], 9.0) for r in week[160:]]
    def run(rs):
        df = spark.createDataFrame(rs, "commodity_id string, province_id int, date date, x double")
        return {r.date: r.score for r in models.sarima_scores(df, 0.1, str(week[129][2]), str(week[130][2]), str(week[159][2])).collect()}
    a, b = run(week), run(later)
    assert a == b and len(a) == 29 and all(0 <= v <= 1 for v in a.values())


def test_top_reasons_are_the_largest_of_each_family(spark):
    c = spark.createDataFrame([("c", 1, DAY, f, 1.0, s) for f, s in (("ret_7", 0.5), ("ret_14", 0.9), ("vol_7", 0.3), ("z_30", -1.0), ("dow", 0.4), ("x", 0.1))], "commodity_id string, province_id int, date date, feature string, value double, shap double")
    doc = models.top_reasons(c, 3).first().reasons_json
    assert [p.split('"')[0] for p in doc.split('"feature":"')[1:]] == ["ret_14", "vol_7", "x"]
