import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import rows

from tidepanel.functions import metrics
from tidepanel.operators import events, grid, models

MASKS = {"all": ["f1", "f2", "f3"], "without f1": ["f2", "f3"], "f1 alone": ["f1"], "noise": ["f3"]}


def test_ablation_against_fits_one_by_one(spark):
    df = rows(spark)
    folds = events.make_folds(df, "2018-06-01", 1, 30, 5).where("fold < 3")
    got = {(r.candidate, r.fold): r for r in grid.ablation(df, folds, MASKS, rate=0.7).collect()}
    assert len(got) == 12
    data = df.toPandas()
    data = data.replace([np.inf, -np.inf], np.nan)
    few = folds.orderBy("fold").collect()
    fill = data.loc[data["date"] <= few[0].fit_end, ["f1", "f2", "f3"]].quantile(0.5, interpolation="lower")
    drawn = {(r.province_id, r.date): r.weight for r in models.weighted(df, 0.7).collect()}
    data["w"] = [drawn.get((p, d), 0.0) for p, d in zip(data["province_id"], data["date"])]
    for f in few:
        fit, test = data[(data["date"] <= f.fit_end) & (data["w"] > 0)], data[data["date"].between(f.test_start, f.test_end)]
        for name, cols in MASKS.items():
            x, z = (d[cols].fillna(fill[cols]).to_numpy(float) for d in (fit, test))
            mu, sd = x.mean(0), x.std(0, ddof=1)
            a, y, w = np.hstack([np.ones((len(x), 1)), (x - mu) / sd]), fit["y"].to_numpy(), fit["w"].to_numpy()
            beta, pen = np.zeros(1 + len(cols)), np.diag([0.0] + [2.0] * len(cols))
            for _ in range(40):
                p = 1 / (1 + np.exp(-a @ beta))
                beta -= np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + pen, a.T @ (w * (p - y)) + pen @ beta)
            s = np.hstack([np.ones((len(z), 1)), (z - mu) / sd]) @ beta
            want = metrics.average_precision(spark.createDataFrame([(1, int(t), float(np.round(v, 9))) for t, v in zip(test["y"], s)], "g int, y int, score double"), ["g"]).first().ap
            assert got[name, f.fold].ap == pytest.approx(want, abs=2e-3) and got[name, f.fold].n == len(test)
        assert got["all", f.fold].ap > got["noise", f.fold].ap


def test_tuning_side_by_side_equals_one_by_one(spark):
    df = rows(spark, 900)
    folds = events.make_folds(df, "2018-05-01", 1, 20, 5).where("fold < 2")
    made = {"f1": lambda fit, val: lambda x: x.withColumn("score", F.col("f1")), "rate": lambda fit, val: (lambda r: lambda x: x.withColumn("score", F.coalesce(F.col("f2"), F.lit(0.0)) * r))(fit.agg(F.avg("y")).first()[0])}
    got = {(r.candidate, r.fold): r.ap for r in grid.tuning(df, folds, made, 4).collect()}
    assert len(got) == 4
    for f in folds.collect():
        test = df.where(F.col("date").between(f.test_start, f.test_end))
        val = df.where(F.col("date").between(f.val_start, f.val_end))
        for name, make in made.items():
            one = make(df.where(F.col("date") <= f.fit_end), val)(test).select(F.lit(1).alias("g"), "y", "score")
            assert got[name, f.fold] == pytest.approx(metrics.average_precision(one, ["g"]).first().ap)
