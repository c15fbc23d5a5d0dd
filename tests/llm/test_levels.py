"""Sums in levels: no group grows with the number of tasks."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidepanel.llm import common, embeddings


def test_two_thousand_parts_meet_in_groups_of_64(spark):
    rows = spark.range(4000).select((F.col("id") % 2).cast("int").alias("i"), F.floor(F.col("id") / 2).cast("int").alias("part"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("most"))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "n": [pdf["n"].sum()], "most": [max(len(pdf), pdf["most"].max())]})

    got = common.in_levels(rows, ["i"], 2000, add).collect()
    assert sorted((r.i, r.part, r.n) for r in got) == [(0, 0, 2000), (1, 0, 2000)] and all(r.most <= 64 for r in got)


def test_means_of_many_tasks(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 3)) + [2, 0, 0]
    df = spark.createDataFrame([("ab"[i % 2], [float(t) for t in v]) for i, v in enumerate(x)], "label string, v array<double>").repartition(70)
    got = {r.label: np.frombuffer(r.mu, np.float64) for r in embeddings._centres(df, 0.93).collect() if r.mu is not None}
    for k, label in enumerate("ab"):
        u = x[k::2] / np.linalg.norm(x[k::2], axis=1)[:, None]
        if label in got:
            assert np.allclose(got[label], u.sum(axis=0) / (200 + 256), atol=2**-19)
    whole = embeddings.in_levels(df.select("label", "v").mapInPandas(embeddings._sums, "label string, dim int, part int, n long, total binary"), ["label", "dim"], 70, embeddings._added)
    assert {(r.label, r.n) for r in whole.collect()} == {("a", 200), ("b", 200)}
