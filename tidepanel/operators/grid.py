"""Many fits at once: ablation of feature groups by Newton steps that all candidates and folds take together, and tuning grids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..storage import materialize, release, scratch
from .models import finite, weighted
from .panel import SERIES

EPOCH = np.datetime64("1970-01-01")


@dataclass(frozen=True)
class Fold:
    number: int
    fit_end: int
    test_start: int
    test_end: int


def _matrix(b: pa.RecordBatch, features: list[str], fill: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, weight, day) of a batch; missing numbers are filled."""
    x = np.column_stack([b.column(f).fill_null(np.nan).to_numpy(zero_copy_only=False) for f in features]) if b.num_rows else np.zeros((0, len(features)))
    x = np.where(np.isnan(x), fill, x)
    return x, *(b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "weight")), b.column("day").to_numpy(zero_copy_only=False)


def _summed(rows: DataFrame, size: int, work: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of ``work`` over all batches: each task adds up its own, Spark adds those by place; ``size`` is bounded by the models."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += work(b)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["i", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out


def fit_masks(train: DataFrame, folds: list[Fold], features: list[str], masks: dict[str, list[int]], fill: np.ndarray, c: float = 0.5, rounds: int = 25, near: float = 1e-9) -> dict[tuple[str, int], np.ndarray]:
    """Weights (intercept first, on standardised features of the mask) of logistic regressions, one for each mask and fold.

    ``train`` has day, y, weight and ``features``.  A fold fits all rows up to its fit_end.  The penalty is half the squared weights over ``c``, as in
    :func:`models.fit_logistic`.  Every pass over the rows gives the slopes and curvatures of all fits together, so the number of passes is that of the
    slowest fit and not a multiple of it.
    """
    p, k = len(features), len(folds)
    ends = [f.fit_end for f in folds]

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x, _, _, day = _matrix(b, features, fill)
        return np.concatenate([np.concatenate([[m.sum()], x[m].sum(axis=0), (x[m] ** 2).sum(axis=0)]) for m in (day <= e for e in ends)])

    got = _summed(train, k * (1 + 2 * p), moments).reshape(k, 1 + 2 * p)
    n = np.maximum(got[:, :1], 2)
    mu = got[:, 1 : 1 + p] / n
    sd = np.sqrt(np.maximum(got[:, 1 + p :] - n * mu**2, 0) / (n - 1))
    sd = np.where(sd > 1e-12, sd, np.inf)  # a constant has weight 0
    jobs = [(name, cols, i) for name, cols in masks.items() for i in range(k)]
    sizes = [1 + len(cols) for _, cols, _ in jobs]
    weights = [np.zeros(s) for s in sizes]
    for _ in range(rounds):

        def slopes(b: pa.RecordBatch, weights: list[np.ndarray] = weights) -> np.ndarray:
            x, y, w, day = _matrix(b, features, fill)
            out: list[np.ndarray] = []
            parts = [(m, (x[m] - mu[i]) / sd[i]) for i, m in enumerate(day <= e for e in ends)]
            for (_, cols, i), beta in zip(jobs, weights):
                m, z = parts[i]
                a = np.column_stack([np.ones(len(z)), z[:, cols]])
                q = 1 / (1 + np.exp(-np.clip(a @ beta, -500, 500)))
                out += [a.T @ (w[m] * (q - y[m])), ((a * (w[m] * q * (1 - q))[:, None]).T @ a).ravel()]
            return np.concatenate(out)

        total, at, moved = _summed(train, sum(s + s * s for s in sizes), slopes), 0, 0.0
        new = []
        for beta, s in zip(weights, sizes):
            g, h = total[at : at + s], total[at + s : at + s + s * s].reshape(s, s)
            at += s + s * s
            ridge = np.full(s, 1 / c)
            ridge[0] = 1e-9
            step = np.linalg.solve(h + np.diag(ridge), g + np.where(np.arange(s) > 0, beta / c, 0.0))
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
            new.append(beta - step)
            moved = max(moved, float(np.abs(step).max()))
        weights = new
        if moved < near:
            break
    raw = {}
    for (name, cols, i), beta in zip(jobs, weights):
        scale = beta[1:] / sd[i][cols]
        raw[name, folds[i].number] = np.concatenate([[beta[0] - scale @ mu[i][cols]], scale])
    return raw


def ablation(data: DataFrame, folds: DataFrame, candidates: dict[str, list[str]], c: float = 0.5, rate: float = 0.5, seed: int = 7) -> DataFrame:
    """(candidate, fold, n, ap): average precision on each fold's test rows of logistic regression on each candidate's features.

    ``data`` (keys, date, y, features) is written once; all fits read it together (:func:`fit_masks`), then one pass scores all
    test rows by all candidates.  Infinite and missing numbers are filled with the medians of the first fold's fitting rows, so that
    nothing later shows.  Folds and candidates are few.
    """
    features = sorted({f for fs in candidates.values() for f in fs})
    masks = {name: [features.index(f) for f in fs] for name, fs in candidates.items()}
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    rows = materialize(finite(data, features).select(*SERIES, "date", day.alias("day"), "y", *features))
    few = [Fold(r.fold, *((np.datetime64(x, "D") - EPOCH).astype(int).item() for x in (r.fit_end, r.test_start, r.test_end))) for r in folds.orderBy("fold").collect()]
    first = rows.where(F.col("day") <= few[0].fit_end).agg(*[F.percentile_approx(f, 0.5, 10_000).alias(f) for f in features]).first()
    fill = np.array([0.0 if first[f] is None else first[f] for f in features], float)
    train = weighted(rows.where(F.col("day") <= max(f.fit_end for f in few)), rate, seed).select("day", "y", "weight", *features)
    fits = fit_masks(train, few, features, masks, fill, c)
    names = list(masks)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, _, at = _matrix(b, features, fill)
            for f in few:
                m = (at >= f.test_start) & (at <= f.test_end)
                if not m.any():
                    continue
                for name in names:
                    beta = fits[name, f.number]
                    s = beta[0] + x[m][:, masks[name]] @ beta[1:]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(s)), pa.array(np.full(len(s), f.number, np.int32)), pa.array(y[m].astype(np.int32)), pa.array(s)], ["candidate", "fold", "y", "score"])

    tests = rows.where(F.col("day").between(min(f.test_start for f in few), max(f.test_end for f in few))).select("day", "y", F.lit(1.0).alias("weight"), *features)
    scored = materialize(tests.mapInArrow(score, "candidate string, fold int, y int, score double"))
    release(rows)
    ap = metrics.average_precision_of_many(scored, ["candidate", "fold"])
    return scored.groupBy("candidate", "fold").agg(F.count(F.lit(1)).alias("n")).join(ap, ["candidate", "fold"])


def tuning(data: DataFrame, folds: DataFrame, candidates: dict[str, Callable[[DataFrame, DataFrame], Callable[[DataFrame], DataFrame]]], workers: int = 4) -> DataFrame:
    """(candidate, fold, n, ap) for models that Spark trains itself: candidate and fold pairs are jobs that run side by side.

    A candidate is made of a fold's fitting and validation rows and adds score to rows, as in :func:`models.walk_forward`.  The pairs share
    ``data``, written once; ``workers`` of them are submitted at a time, so that one fit's small steps don't leave the cluster idle.
    """
    rows = materialize(data)
    path = scratch(data.sparkSession, "tuning")

    def one(job: tuple) -> None:
        k, name, f = job
        fit = rows.where(F.col("date") <= f.fit_end)
        val, test = (rows.where(F.col("date").between(a, b)) for a, b in ((f.val_start, f.val_end), (f.test_start, f.test_end)))
        candidates[name](fit, val)(test).select(F.lit(name).alias("candidate"), F.lit(f.fold).alias("fold"), "y", "score").write.parquet(f"{path}/{k}")

    jobs = [(k, name, f) for k, (name, f) in enumerate((name, f) for name in candidates for f in folds.orderBy("fold").collect())]
    with ThreadPoolExecutor(workers) as pool:
        list(pool.map(one, jobs))
    scored = data.sparkSession.read.parquet(*[f"{path}/{k}" for k, _, _ in jobs])
    ap = metrics.average_precision_of_many(scored, ["candidate", "fold"])
    out = materialize(scored.groupBy("candidate", "fold").agg(F.count(F.lit(1)).alias("n")).join(ap, ["candidate", "fold"]))
    release(rows, path)
    return out
