"""Boosted trees beyond prediction: exact contributions of features, scores after every round, ensembles cut at their best round.

An ensemble is read once into arrays of leaves.  A leaf is the features on its path, each with one condition (all splits on it together)
and the share of training weight that goes that way.  Rows meet all leaves at once in Arrow batches; the arrays are bounded by
the model, never by the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import release, scratch

MOST = 8  # different features on a path; tables of subsets have 2 ** MOST rows
CELLS = 4_000_000  # rows times leaves that are held at once


@dataclass(frozen=True)
class Group:
    """Leaves with the same number of features: conds and feature are (leaf, place), table is (leaf, pattern of met conditions, place)."""

    conds: np.ndarray
    feature: np.ndarray
    table: np.ndarray
    tree: np.ndarray
    value: np.ndarray


@dataclass(frozen=True)
class Ensemble:
    """Leaves in groups; conditions as (feature, low, high, allowed), allowed being a row of categories or -1; base is the expected margin."""

    groups: tuple[Group, ...]
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    allowed: np.ndarray
    categories: np.ndarray
    base: float
    n_trees: int

    def met(self, x: np.ndarray) -> np.ndarray:
        """(row, condition): whether a row meets it.  A missing number goes right, as MLlib sends it."""
        at = x[:, self.feature]
        ok = ~(at <= self.low) & ((at <= self.high) | np.isinf(self.high))
        for k in np.flatnonzero(self.allowed >= 0):
            code = at[:, k]
            known = (code >= 0) & (code < self.categories.shape[1])
            ok[:, k] = known & self.categories[self.allowed[k], np.where(known, code, 0).astype(int)]
        return ok

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """(row, feature): Shapley values of the margin; with ``base`` they add up to it."""
        out = np.zeros(x.shape)
        ok = self.met(x)
        for g in self.groups:
            d = g.conds.shape[1]
            if not d:
                continue
            code = np.zeros((len(x), len(g.conds)), np.int64)
            for p in range(d):
                code += ok[:, g.conds[:, p]].astype(np.int64) << p
            leaf = np.arange(len(g.conds))
            for p in range(d):
                place = np.zeros((len(g.conds), x.shape[1]))
                place[leaf, g.feature[:, p]] = 1.0
                out += g.table[leaf[None, :], code, p] @ place
        return out

    def tree_outputs(self, x: np.ndarray) -> np.ndarray:
        """(row, tree): each tree's weighted output."""
        out = np.zeros((len(x), self.n_trees))
        ok = self.met(x)
        for g in self.groups:
            here = np.ones((len(x), len(g.conds)), bool)
            for p in range(g.conds.shape[1]):
                here &= ok[:, g.conds[:, p]]
            to = np.zeros((len(g.conds), self.n_trees))
            to[np.arange(len(g.conds)), g.tree] = g.value
            out += here @ to
        return out


def subset_table(share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """(leaf, pattern, place): what each condition of a path adds to the margin, given which conditions a row meets.

    The features that a subset knows decide by the row, the others by their shares.  The products over all subsets of k others are
    the k-th coefficient of one polynomial, and a subset of k among d weighs k! (d - k - 1)! / d!.
    """
    n, d = share.shape
    bits = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
    weigh = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
    out = np.zeros((n, 1 << d, d))
    for i in range(d):
        poly = np.zeros((n, 1 << d, d))
        poly[:, :, 0] = 1.0
        for j in (j for j in range(d) if j != i):
            up = poly * share[:, j][:, None, None]
            up[:, :, 1:] += poly[:, :, :-1] * bits[None, :, j, None]
            poly = up
        out[:, :, i] = (poly @ np.array(weigh)) * (bits[None, :, i] - share[:, i][:, None]) * value[:, None]
    return out


def read_ensemble(model: GBTClassificationModel, margin: float = 2.0) -> Ensemble:
    """The leaves of ``model``; values are multiplied by ``margin``, which makes them log odds (MLlib's probability is that of twice its sum)."""
    spark = SparkSession.active()
    path = scratch(spark, "trees")
    model.write().save(path)
    # nodes are bounded by trees and depth
    saved = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    release(path)
    trees: dict[int, dict[int, object]] = {}
    for r in saved:
        trees.setdefault(r.treeID, {})[r.id] = r
    weights = list(model.treeWeights)
    conds: dict[tuple, int] = {}
    found: dict[int, list[tuple]] = {}
    base = 0.0
    for t, nodes in trees.items():
        stack: list[tuple[int, dict[int, tuple]]] = [(0, {})]
        while stack:
            at, path_ = stack.pop()
            node = nodes[at]
            if node.leftChild < 0:
                value = margin * weights[t] * node.prediction
                base += value * math.prod(c[3] for c in path_.values())
                if len(path_) > MOST:
                    raise ValueError(f"a path with {len(path_)} features; at most {MOST} are supported")
                keys = [(f, c[0], c[1], c[2]) for f, c in sorted(path_.items())]
                ids = [conds.setdefault(k, len(conds)) for k in keys]
                found.setdefault(len(ids), []).append((ids, sorted(path_), [c[3] for _, c in sorted(path_.items())], t, value))
                continue
            f, split = node.split.featureIndex, list(node.split.leftCategoriesOrThreshold)
            weight = node.impurityStats[0]
            low, high, some, share = path_.get(f, (-math.inf, math.inf, None, 1.0))
            for child, left in ((node.leftChild, True), (node.rightChild, False)):
                part = share * (nodes[child].impurityStats[0] / weight if weight > 0 else 0.5)
                if node.split.numCategories >= 0:
                    mine = frozenset(int(c) for c in split) if left else frozenset(range(node.split.numCategories)) - {int(c) for c in split}
                    cond = (low, high, mine if some is None else some & mine, part)
                else:
                    cond = (low, min(high, split[0]), some, part) if left else (max(low, split[0]), high, some, part)
                stack.append((child, path_ | {f: cond}))
    sets = sorted({c[3] for c in conds if c[3] is not None}, key=sorted)
    wide = max((max(s, default=0) + 1 for s in sets), default=1)
    categories = np.array([[c in s for c in range(wide)] for s in sets], bool).reshape(len(sets), wide)
    order = sorted(conds, key=conds.get)
    groups = []
    for d, leaves in sorted(found.items()):
        ids, feats, shares = (np.array([x[k] for x in leaves]).reshape(len(leaves), d) for k in range(3))
        value = np.array([x[4] for x in leaves])
        table = subset_table(shares.astype(float), value) if d else np.zeros((len(leaves), 1, 0))
        groups.append(Group(ids.astype(int), feats.astype(int), table, np.array([x[3] for x in leaves]), value))
    return Ensemble(
        tuple(groups), np.array([c[0] for c in order], int), np.array([c[1] for c in order], float), np.array([c[2] for c in order], float),
        np.array([-1 if c[3] is None else sets.index(c[3]) for c in order], int), categories, base, len(trees),
    )


def inputs(model: PipelineModel) -> list[str]:
    """The features of a fitted pipeline in the order of its vector."""
    (assembler,) = [s for s in model.stages if type(s).__name__ == "VectorAssembler"]
    return [c.removesuffix("_i") for c in assembler.getInputCols()]


def _over_rows(model: PipelineModel, df: DataFrame, keep: list[str], name: str, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``keep`` columns and ``name``, an array<double> that ``work`` makes of a matrix of rows; columns stay in Arrow."""
    ready = PipelineModel(model.stages[:-1]).transform(df).select(F.struct(*keep).alias("row"), vector_to_array("features").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            x = np.asarray(b.column("x").flatten()).reshape(n, -1) if n else np.zeros((0, 1))
            out = work(x) if n else np.zeros((0, 1))
            made = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("row"), made], ["row", name])

    return ready.mapInArrow(run, f"row {ready.schema['row'].dataType.simpleString()}, {name} array<double>").select("row.*", name)


def _in_parts(work: Callable[[np.ndarray], np.ndarray], x: np.ndarray, leaves: int) -> np.ndarray:
    step = max(1, CELLS // max(leaves, 1))
    return np.concatenate([work(x[a : a + step]) for a in range(0, len(x), step)])


def tree_contributions(model: PipelineModel, df: DataFrame, keep: list[str]) -> tuple[DataFrame, float]:
    """(``keep`` columns and shap, an array in the order of :func:`inputs`; the base value) of a pipeline that ends in boosted trees.

    Path-dependent Shapley values of the log odds: base and contributions add up to the model's margin.
    """
    e = read_ensemble(model.stages[-1])
    leaves = max(len(g.value) for g in e.groups)
    return _over_rows(model, df, keep, "shap", lambda x: _in_parts(e.contributions, x, leaves)), e.base


def staged_scores(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and staged, the log odds after each round as an array."""
    e = read_ensemble(model.stages[-1])
    leaves = max(len(g.value) for g in e.groups)
    return _over_rows(model, df, keep, "staged", lambda x: np.cumsum(_in_parts(e.tree_outputs, x, leaves), axis=1))


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model after its first ``n`` rounds."""
    j, gateway = model._java_obj, SparkSession.active().sparkContext._gateway
    jvm = gateway.jvm
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(jvm.double, n)
    for k, t in enumerate(list(j.trees())[:n]):
        trees[k], weights[k] = t, float(model.treeWeights[k])
    cut = jvm.org.apache.spark.ml.classification.GBTClassificationModel(j.uid(), trees, weights)
    cut.setFeaturesCol(model.getFeaturesCol())
    return GBTClassificationModel(cut)

