import numpy as np
import pytest

from tidepanel.functions.quantiles import exact_quantiles

PROBS = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)


@pytest.mark.parametrize(("cuts", "few"), [(4, 3), (16, 20), (256, 4096)])
def test_quantiles_equal_numpy(spark, cuts, few):
    r = np.random.default_rng(4)
    groups = {"a": r.normal(size=500), "ties": np.repeat([1.0, 2.0, 2.5], [200, 1, 99]), "one": np.array([3.0]), "two": np.array([1.0, -1.0]), "mix": np.concatenate([np.zeros(150), r.normal(size=150)])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {x.g: x.q for x in exact_quantiles(df, ["g"], "x", PROBS, cuts, few).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g] == pytest.approx(np.quantile(vs, PROBS).tolist())
    (whole,) = exact_quantiles(df, [], "x", (0.5,), cuts, few).collect()
    assert whole.q == [pytest.approx(np.median([v for _, v in rows if v is not None]))]
    assert exact_quantiles(df.where("x is null"), ["g"], "x", PROBS, cuts, few).collect() == []
