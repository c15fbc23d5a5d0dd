"""Lead-lag networks: conditional Granger tests, false-discovery control, precedence, leaders, neighbour means."""

from __future__ import annotations

from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import SERIES, future_max, rows


def granger_edges(weekly: DataFrame, lags: int = 2, min_obs: int = 60, national: int = 0) -> DataFrame:
    """(commodity_id, source, target, F, p_value, coef_sum, n_weeks) for all ordered pairs of provinces.

    ``weekly`` is (commodity_id, province_id, date, ret) on a dense grid of weeks.  The target's return is
    regressed on its own lags, the national return's where there is one, and the source's; both models use the
    rows complete for the larger one.  One task takes one commodity (weeks x provinces); least squares are
    minimum-norm.  With two lags the p-value is exact in closed form, otherwise a continued fraction gives it.
    """
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="date", columns="province_id", values="ret", dropna=False).sort_index()
        shifted = {c: np.column_stack([wide[c].shift(k).to_numpy() for k in range(1, lags + 1)]) for c in wide.columns}
        out, control = [], [shifted[national]] if national in shifted else []
        for target in (c for c in wide.columns if c != national):
            y = wide[target].to_numpy()
            base = np.column_stack([np.ones(len(y)), shifted[target], *control])
            for source in (c for c in wide.columns if c not in (national, target)):
                full = np.column_stack([base, shifted[source]])
                ok = np.isfinite(full).all(axis=1) & np.isfinite(y)
                n, df = int(ok.sum()), int(ok.sum()) - full.shape[1]
                if n < min_obs or df <= 0:
                    continue
                rss = []
                for x in (base[ok], full[ok]):
                    coef = np.linalg.lstsq(x, y[ok], rcond=None)[0]
                    rss.append(float(((y[ok] - x @ coef) ** 2).sum()))
                if rss[1] <= 0:
                    continue
                f = (rss[0] - rss[1]) / lags / (rss[1] / df)
                out.append((pdf["commodity_id"].iloc[0], int(source), int(target), f, f_tail(f, lags, df), float(coef[-lags:].sum()), n))
        return pd.DataFrame(out, columns=["commodity_id", "source", "target", "F", "p_value", "coef_sum", "n_weeks"])

    return weekly.select(*SERIES, "date", "ret").groupBy("commodity_id").applyInPandas(fit, "commodity_id string, source int, target int, F double, p_value double, coef_sum double, n_weeks int")


def f_tail(f: float, d1: int, d2: int) -> float:
    """P(F > f) for d1 and d2 degrees of freedom."""
    if f <= 0:
        return 1.0
    if d1 == 2:
        return float((1 + 2 * f / d2) ** (-d2 / 2))
    return _beta(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 500):
        before = h
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= c * d
        if abs(h - before) < 1e-14 * abs(h):
            break
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
    return front * h / a


def bh_fdr(edges: DataFrame, by: str = "commodity_id", p: str = "p_value") -> DataFrame:
    """Adds q_value: Benjamini-Hochberg within each group; a null p stays null and doesn't count."""
    ok = F.col(p).isNotNull()
    m = F.sum(ok.cast("long")).over(Window.partitionBy(by))
    rank = F.row_number().over(Window.partitionBy(by, ok).orderBy(p))
    e = edges.select("*", F.when(ok, F.col(p) * m / rank).alias("raw_q"))
    # the least over all p from this one upwards, as a running minimum from the largest down
    w = Window.partitionBy(by).orderBy(F.desc_nulls_first(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.least(F.lit(1.0), F.min("raw_q").over(w))
    return e.select(*edges.columns, F.when(ok, q).alias("q_value"))


def leader_scores(edges: DataFrame) -> DataFrame:
    """(commodity_id, province_id, out_degree, in_degree, leader_score) over significant edges, every node kept."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")
    s = F.col("significant").cast("long")
    d = edges.select("commodity_id", s.alias("s"), ends).groupBy("commodity_id", F.col("e.n").alias("province_id")).agg(F.sum(F.col("s") * F.col("e.o")).alias("out_degree"), F.sum(F.col("s") * F.col("e.i")).alias("in_degree"))
    return d.select("*", (F.col("out_degree") - F.col("in_degree")).alias("leader_score"))


def select_leaders(edges: DataFrame, k: int = 3) -> DataFrame:
    """(commodity_id, province_id, source, rank): the k sources of least p with a positive sum of coefficients.

    Significance isn't asked for; ties go to the smaller source.
    """
    r = F.row_number().over(Window.partitionBy("commodity_id", "target").orderBy(F.greatest("p_value", F.lit(1e-300)), "source"))
    return edges.where("coef_sum > 0").select("commodity_id", F.col("target").alias("province_id"), "source", r.alias("rank")).where(F.col("rank") <= k)


def precedence(labels: DataFrame, window: int = 14) -> DataFrame:
    """(commodity_id, source, target, n_onset_source, n_onset_target, n_followed, lift) of ordered pairs of provinces.

    An onset is followed if the target has one in the next ``window`` days; the base rate is the target's share
    of days that would be, over all days.
    """
    f = labels.select(*SERIES, "date", "onset", F.coalesce(future_max("onset", window), F.lit(0)).alias("f"))
    per = f.groupBy(*SERIES).agg(F.sum("onset").alias("n"), F.avg("f").alias("base"))
    hits = f.where("onset = 1").select("commodity_id", F.col("province_id").alias("source"), "date").join(f.where("f = 1").select("commodity_id", F.col("province_id").alias("target"), "date"), ["commodity_id", "date"]).where("source <> target").groupBy("commodity_id", "source", "target").count()
    a = per.select("commodity_id", F.col("province_id").alias("source"), F.col("n").alias("n_onset_source"))
    b = per.select("commodity_id", F.col("province_id").alias("target"), F.col("n").alias("n_onset_target"), "base")
    pairs = a.join(b, "commodity_id").where("source <> target").join(hits, ["commodity_id", "source", "target"], "left")
    n = F.coalesce("count", F.lit(0))
    return pairs.select("commodity_id", "source", "target", "n_onset_source", "n_onset_target", n.alias("n_followed"), F.try_divide(F.try_divide(n, F.col("n_onset_source")), F.col("base")).alias("lift"))


def over_neighbours(panel: DataFrame, edges: DataFrame, by_commodity: bool = False, **aggs) -> DataFrame:
    """Aggregates of other provinces' values along ``edges`` (province_id, other), which grow with the places; Spark decides how to join them."""
    key = ["commodity_id"] if by_commodity else []
    e = edges.select(*key, F.col("province_id").alias("to"), F.col("other").alias("province_id"))
    return panel.join(e, [*key, "province_id"]).groupBy("commodity_id", F.col("to").alias("province_id"), "date").agg(*[a.alias(n) for n, a in aggs.items()])


def build_network(weekly: DataFrame, labels: DataFrame | None = None, lags: int = 2, alpha: float = 0.05, window: int = 14, start: str | None = None, end: str | None = None, min_obs: int = 60, national: int = 0) -> DataFrame:
    """Granger edges of [start, end] with q_value and significant; with ``labels`` their onsets' precedence too.

    Significant: q below ``alpha`` and a positive sum of coefficients.
    """
    def cut(df: DataFrame) -> DataFrame:
        return df.where((F.col("date") >= start if start else F.lit(True)) & (F.col("date") <= end if end else F.lit(True)))

    edges = bh_fdr(granger_edges(cut(weekly), lags, min_obs, national))
    edges = edges.select("*", (F.coalesce(F.col("q_value") < alpha, F.lit(False)) & (F.col("coef_sum") > 0)).alias("significant"))
    return edges if labels is None else with_precedence(edges, precedence(cut(labels), window))


def with_precedence(edges: DataFrame, found: DataFrame) -> DataFrame:
    """``edges`` with the onset counts and lift of their pair, null where it has none."""
    return edges.join(found, ["commodity_id", "source", "target"], "left")


def out_of_period(edges: DataFrame, later: DataFrame, least_source: int = 3, least_onsets: int = 20) -> DataFrame:
    """(commodity_id, lift_significant, lift_others, n_significant, ratio): do edges found earlier still lead in ``later`` labels?

    Pairs whose source has under ``least_source`` onsets, and commodities with under ``least_onsets``, are left out, as
    are commodities with pairs of one kind only.
    """
    enough = later.groupBy("commodity_id").agg(F.sum("onset").alias("n")).where(F.col("n") >= least_onsets).select("commodity_id")
    pairs = edges.select("commodity_id", "source", "target", "significant").join(precedence(later), ["commodity_id", "source", "target"]).join(enough, "commodity_id")
    pairs = pairs.where(F.col("lift").isNotNull() & (F.col("n_onset_source") >= least_source))
    yes, no = (F.avg(F.when(F.col("significant") == k, F.col("lift"))) for k in (True, False))
    out = pairs.groupBy("commodity_id").agg(yes.alias("lift_significant"), no.alias("lift_others"), F.sum(F.col("significant").cast("long")).alias("n_significant"))
    return out.where("lift_significant is not null and lift_others is not null").select("*", F.try_divide("lift_significant", "lift_others").alias("ratio"))
