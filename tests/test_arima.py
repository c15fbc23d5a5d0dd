import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import arima, events, models


def dense_log_likelihood(y, x, phi, theta, beta, variance):
    """Normal density of all known values less the first, from the autocovariances of the changes."""
    n = len(y)
    g = np.zeros(n)
    g[0] = (1 + 2 * phi * theta + theta**2) / (1 - phi**2)
    if n > 1:
        g[1] = (1 + phi * theta) * (phi + theta) / (1 - phi**2)
    for k in range(2, n):
        g[k] = phi * g[k - 1]
    change = g[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    known = np.flatnonzero(np.isfinite(y))
    add = np.tril(np.ones((n, n)))
    take = add[known[1:]] - add[known[0]]
    cov = variance * take @ change @ take.T
    level = y - x @ beta
    d = level[known[1:]] - level[known[0]]
    return -0.5 * (len(d) * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + d @ np.linalg.solve(cov, d))


def series(n, phi, theta, seed, gaps=()):
    r = np.random.default_rng(seed)
    e = r.normal(0, 0.05, n + 1)
    w = np.zeros(n)
    for i in range(1, n):
        w[i] = phi * w[i - 1] + e[i] + theta * e[i - 1]
    t = np.arange(n + 2) / 52
    x = np.column_stack([np.sin(2 * np.pi * t), np.cos(2 * np.pi * t)])
    y = 3 + np.cumsum(w) + x[:n] @ [0.2, -0.1]
    y[list(gaps)] = np.nan
    return y, x


@pytest.mark.parametrize("phi,theta", [(0.5, 0.3), (-0.7, 0.6), (0.0, 0.0), (0.9, -0.4)])
def test_likelihood_equals_a_dense_normal(phi, theta):
    y, x = series(50, 0.4, 0.2, 3, gaps=(0, 1, 10, 11, 12, 30, 49))
    value, beta, variance = arima.profile(y, x[:50], np.array([phi, 0.1]), np.array([theta, 0.1]))
    assert value[0] == pytest.approx(dense_log_likelihood(y, x[:50], phi, theta, beta[0], variance[0]), abs=1e-8)
    for more in (1.1, 0.9):  # regressors and variance are the best there are
        assert dense_log_likelihood(y, x[:50], phi, theta, beta[0] * more, variance[0]) < value[0] and dense_log_likelihood(y, x[:50], phi, theta, beta[0], variance[0] * more) < value[0]


@pytest.mark.parametrize("phi,theta", [(0.6, 0.2), (-0.4, 0.5), (0.2, -0.7)])
def test_the_maximum_is_found(phi, theta):
    y, x = series(400, phi, theta, 5, gaps=range(100, 110))
    m = arima.fit(y, x[:400])
    net = np.array([(a, b) for a in np.linspace(-0.95, 0.95, 39) for b in np.linspace(-0.95, 0.95, 39)])
    assert m.log_likelihood >= arima.profile(y, x[:400], net[:, 0], net[:, 1])[0].max() - 1e-6
    assert abs(m.phi - phi) < 0.25 and abs(m.theta - theta) < 0.25 and m.variance == pytest.approx(0.0025, rel=0.2)
    assert m.beta == pytest.approx([0.2, -0.1], abs=0.25)


def test_forecasts_equal_conditional_normals():
    y, x = series(40, 0.5, 0.3, 9, gaps=(5, 20, 21))
    m = arima.Fit(0.5, 0.3, np.array([0.2, -0.1]), 0.0025, 0.0)
    mean, spread = arima.forecasts(y, x, m)
    g = np.zeros(42)
    g[0], g[1] = (1 + 2 * 0.15 + 0.09) / 0.75, (1 + 0.15) * 0.8 / 0.75
    for k in range(2, 42):
        g[k] = 0.5 * g[k - 1]
    add = np.tril(np.ones((42, 42)))
    cov = 0.0025 * add @ g[np.abs(np.subtract.outer(np.arange(42), np.arange(42)))] @ add.T
    for i in (4, 19, 21, 22, 39):
        known = [k for k in range(i + 1) if np.isfinite(y[k])]
        d = (y - x[:40] @ m.beta)[known]
        # levels relative to the first known one
        take, ahead = np.eye(42)[known[1:]] - np.eye(42)[known[0]], np.eye(42)[[i + 1, i + 2]] - np.eye(42)[known[0]]
        s = take @ cov @ take.T
        want = d[0] + ahead @ cov @ take.T @ np.linalg.solve(s, d[1:] - d[0]) + x[[i + 1, i + 2]] @ m.beta
        var = ahead @ cov @ ahead.T - ahead @ cov @ take.T @ np.linalg.solve(s, take @ cov @ ahead.T)
        assert mean[i] == pytest.approx(want, abs=1e-9) and spread[i] == pytest.approx(np.diag(var), abs=1e-9)


def test_models_meet_on_the_weekly_rows(spark):
    day = dt.date(2020, 1, 3)
    every = [("c", p, day + dt.timedelta(i), int((i + p) % 5 == 0)) for p in (1, 2) for i in range(400)]
    df = spark.createDataFrame(every, "commodity_id string, province_id int, date date, y int")
    folds = events.make_folds(df, "2020-10-01", 1, 60, 5)
    pred = events.fold_roles(df, folds).where("role = 'test'").select("commodity_id", "province_id", "date", "y", "fold", F.rand(1).alias("score_naive"), F.lit(0.5).alias("thr_naive"))
    score = F.dayofmonth("date") / 31.0
    weekly = events.fold_roles(df, folds).where("role <> 'fit' and dayofweek(date) = 6 and province_id = 1").select("commodity_id", "province_id", "date", "fold", score.alias("score"))
    out = models.weekly_comparison(pred, weekly, df, folds).collect()
    tests = {(r.date, r.fold) for r in pred.where("province_id = 1").collect() if r.date.weekday() == 4}
    assert {(r.date, r.fold) for r in out} == tests and len(out) == len(tests) > 10
    assert all(r.score_sarima == pytest.approx(r.date.day / 31) and r.score_naive is not None for r in out)
    f = folds.orderBy("fold").first()
    val = [(d.day / 31, y) for c, p, d, y in every if p == 1 and d.weekday() == 4 and f.val_start <= d <= f.val_end]
    def f1(t):
        tp = sum(y for s, y in val if s >= t)
        return round(2 * tp / max(1, sum(s >= t for s, _ in val) + sum(y for _, y in val)), 12)
    best = max(sorted({s for s, _ in val}), key=lambda t: (f1(t), -t))
    (thr,) = {r.thr_sarima for r in out if r.fold == f.fold}
    assert thr == pytest.approx(best)
