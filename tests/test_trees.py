import itertools
import json
import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from test_models import DAY, rows

from tidepanel.functions import metrics
from tidepanel.operators import models, trees

SIX = ["f1", "f2", "f3", "f4", "f5", "province_code"]


@pytest.fixture(scope="module")
def fitted(spark):
    df = rows(spark, 600).select("*", (F.col("f1") * F.col("f2")).alias("f4"), F.rand(3).alias("f5"), F.col("province_id").alias("province_code")).cache()
    return df, models.fit_boosted(df, SIX, None, 6, rate=1.0)


def test_contributions_add_up_to_the_margin(fitted):
    df, model = fitted
    x = models.finite(df, SIX[:5])
    out, base = trees.tree_contributions(model, x, ["date", "province_id"])
    shap = {(r.date, r.province_id): r.shap for r in out.collect()}
    raw = model.transform(x).select("date", "province_id", "rawPrediction").collect()
    assert len(raw) == len(shap) == 600
    assert all(abs(base + sum(shap[r.date, r.province_id]) - 2 * r.rawPrediction[1]) < 1e-6 for r in raw)


def plain_expectation(nodes, at, x, known):
    """Mean of a tree over training weight where a split's feature is unknown."""
    n = nodes[at]
    if n.leftChild < 0:
        return n.prediction
    f, cut = n.split.featureIndex, list(n.split.leftCategoriesOrThreshold)
    if f in known:
        left = x[f] in cut if n.split.numCategories >= 0 else x[f] <= cut[0]
        return plain_expectation(nodes, n.leftChild if left else n.rightChild, x, known)
    share = nodes[n.leftChild].impurityStats[0] / n.impurityStats[0]
    return share * plain_expectation(nodes, n.leftChild, x, known) + (1 - share) * plain_expectation(nodes, n.rightChild, x, known)


def test_contributions_against_all_subsets(spark, fitted, tmp_path):
    df, model = fitted
    gbt = model.stages[-1]
    gbt.write().overwrite().save(str(tmp_path / "m"))
    nodes = {}
    for r in spark.read.parquet(str(tmp_path / "m" / "data")).select("treeID", "nodeData.*").collect():
        nodes.setdefault(r.treeID, {})[r.id] = r
    some = models.finite(df, SIX[:5]).orderBy("date", "province_id").limit(25)
    vectors = {(r.date, r.province_id): r.features.toArray() for r in PipelineModel(model.stages[:-1]).transform(some).collect()}
    out, base = trees.tree_contributions(model, some, ["date", "province_id"])
    seen = 0
    for r in out.collect():
        x = vectors[r.date, r.province_id]
        value = {}
        for k in range(7):
            for s in itertools.combinations(range(6), k):
                value[frozenset(s)] = sum(2 * w * plain_expectation(nodes[t], 0, x, set(s)) for t, w in enumerate(gbt.treeWeights))
        assert base == pytest.approx(value[frozenset()], abs=1e-9)
        for i in range(6):
            want = sum(math.factorial(len(s)) * math.factorial(5 - len(s)) / math.factorial(6) * (value[s | {i}] - value[s]) for s in value if i not in s)
            assert r.shap[i] == pytest.approx(want, abs=1e-9)
            seen += want != 0
    assert seen > 60  # and the categories take part
    assert any(n.split.numCategories >= 0 for t in nodes.values() for n in t.values() if n.leftChild >= 0)


def test_precision_of_each_round_and_the_round_kept(spark, fitted):
    df, model = fitted
    x = models.finite(df, SIX[:5])
    staged = trees.staged_scores(model, x, ["y"]).collect()
    y, s = np.array([r.y for r in staged]), np.array([r.staged for r in staged])
    got = {r["round"]: r.ap for r in models.round_precision(model, df).collect()}
    assert sorted(got) == list(range(1, 7))
    for k, ap in got.items():
        want = tp = n = 0
        for v in sorted(set(s[:, k - 1]), reverse=True):
            hit = y[s[:, k - 1] == v]
            tp, n = tp + hit.sum(), n + len(hit)
            want += hit.sum() / y.sum() * tp / n
        assert ap == pytest.approx(want, abs=1e-12)
    cut = PipelineModel([*model.stages[:-1], trees.first_trees(model.stages[-1], 4)])
    margins = sorted(r.rawPrediction[1] * 2 for r in cut.transform(x).collect())
    short, base = trees.tree_contributions(cut, x, ["y"])
    assert sorted(base + sum(r.shap) for r in short.collect()) == pytest.approx(margins)
    assert margins == pytest.approx(sorted(s[:, 3]))
    kept = models.fit_boosted(df.where("f5 < 0.6"), SIX, df.where("f5 >= 0.6"), 6, rate=1.0, seed=7)
    full = models.fit_boosted(df.where("f5 < 0.6"), SIX, None, 6, rate=1.0, seed=7)
    precision = {r["round"]: r.ap for r in models.round_precision(full, df.where("f5 >= 0.6")).collect()}
    assert kept.stages[-1].getNumTrees == max(precision, key=lambda k: (precision[k], -k))


def test_the_round_that_early_stopping_keeps(spark):
    def kept(aps, patience):
        return models.best_round(spark.createDataFrame([(k + 1, a) for k, a in enumerate(aps)], "round int, ap double"), patience)
    assert kept([0.2, 0.5, 0.4, 0.4, 0.9], 2) == 2 and kept([0.2, 0.5, 0.4, 0.4, 0.9], 3) == 5
    assert kept([0.5, 0.5], 9) == 1 and kept([None, None], 9) is None


def test_precision_of_many_equals_that_of_one_task(spark):
    r = np.random.default_rng(0)
    data = [(int(g), int(v > 1), float(np.round(v + r.normal(), 1)) if k % 17 else None) for g in range(5) for k, v in enumerate(r.normal(size=400))] + [(9, 1, 0.5), (8, 0, 0.5), (8, 0, 0.1)]
    df = spark.createDataFrame(data, "g int, y int, score double").repartition(3)
    a, b = ({x.g: x.ap for x in f(df, ["g"]).collect()} for f in (metrics.average_precision, metrics.average_precision_of_many))
    assert a.keys() == b.keys() and a[9] is b[9] is None and all(a[g] == pytest.approx(b[g]) for g in range(5))


def test_reasons_and_groups_take_boosted_trees(fitted):
    df, model = fitted
    long = models.contributions(model, df, SIX).cache()
    assert long.count() == 6 * 600 and long.where("feature = 'f2' and value is null").count() == 12
    shares = models.importance(long).collect()
    assert sum(r.share for r in shares) == pytest.approx(1) and max(shares, key=lambda r: r.mean_abs).feature == "f1"
    assert {r.group for r in models.importance_by_group(models.importance(long)).collect()} >= {"identity"}
    best = {}
    for r in long.collect():
        if r.shap > 0 and r.value is not None and math.isfinite(r.value) and r.feature != "province_code":
            best.setdefault((r.date, r.province_id), []).append((-round(r.shap, 9), r.feature))
    got = {(r.date, r.province_id): [x["feature"] for x in json.loads(r.reasons_json)] for r in models.top_reasons(long, 3).collect()}
    assert got == {k: [f for _, f in sorted(v)[:3]] for k, v in best.items()} and min(k[0] for k in got) == DAY
