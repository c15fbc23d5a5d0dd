"""Near-duplicate embeddings by spherical-cap filters from random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, in_levels, materialize

LEAST = 0.93
MISS = 1e-4  # nominal chance that a pair at LEAST shares no filter
MEASURED = 5e-4  # share of simulated pairs at LEAST that may share none, or the plan gets more filters
PAIRS = 4000  # simulated pairs
BUCKET = 256  # vectors that a filter should hold
PART = 8192  # rows of a group that one task compares with each other
ROWS = 1024
LEAN = 0.3  # length of a label's mean from which its vectors are decoded relative to that mean
NEAREST = 0.55  # unless one of them is nearer to the mean than this


def _tail(t: float) -> float:
    return 0.5 * math.erfc(t / math.sqrt(2))


def _shared(t: float, rho: float) -> float:
    """P(y exceeds t | x exceeds t) for standard normal scores with correlation rho."""
    xs = np.linspace(t, t + 6, 2001)
    weight = np.exp(-xs * xs / 2)
    over = np.array([_tail((t - rho * x) / math.sqrt(1 - rho * rho)) for x in xs])
    return float((weight * over).sum() / weight.sum())


def _bisect(low: float, high: float, over) -> float:
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) else (low, mid)
    return low


@lru_cache(maxsize=64)
def _table(dim: int, size: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random rotation and the code of each half, scaled so that scores of a unit vector spread by 1; alike wherever made."""
    rng = np.random.default_rng([dim, number])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    half = max(1, dim // 2)
    codes = [c / np.linalg.norm(c, axis=1, keepdims=True) * math.sqrt(dim / 2) for c in (rng.standard_normal((size, half)), rng.standard_normal((size, max(1, dim - half))))]
    return turn, *codes


@dataclass(frozen=True)
class Code:
    """``tables`` product codes, each of a rotation and two blocks of ``size`` code vectors.

    A filter is a pair of code vectors of one table; its cap begins at ``cap`` / sqrt(dim).
    """

    dim: int
    tables: int
    size: int
    cap: float

    @classmethod
    def plan(cls, dim: int, n: int, rho: float = LEAST) -> "Code":
        """For the largest label's ``n`` distinct vectors of ``dim``: filters that hold about BUCKET of them each.

        How many filters a vector needs is first reckoned as if they were independent and scores normal; they
        aren't, least of all in few dimensions, so the cap is set by simulated vectors and the chance of a miss is
        measured on PAIRS simulated pairs at cosine ``rho``.  While it is over MEASURED the plan gets more tables,
        then wider filters.  Rotations are random, so a pair of any data fares like a simulated one.
        """
        rng = np.random.default_rng(7)
        x = rng.standard_normal((PAIRS, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        e = rng.standard_normal((PAIRS, dim))
        e -= (e * x).sum(axis=1, keepdims=True) * x
        y = rho * x + math.sqrt(1 - rho * rho) * e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
        share, more = min(0.25, BUCKET / max(n, 1)), 1.0
        while True:
            t = _bisect(-4.0, 8.0, lambda v: _tail(v) > share)
            need = more * max(4.0, math.log(MISS) / math.log(max(1 - _shared(t, rho), 1e-9)))
            tables = max(4, min(24, round(need / 3)))
            size = max(4, math.ceil(math.sqrt(need / tables / share)))
            few = x[:256]
            scores = [cls(dim, 1, size, 0.0)._scores(few, 0)]
            cap = _bisect(-8.0, 4 * math.sqrt(dim), lambda v: sum(_over(a, b, v)[1].sum() for a, b in scores) > len(few) * need / tables)
            code = cls(dim, tables, size, cap)
            if dim == 1 or code.misses(x, y) <= MEASURED:
                return code
            if more < 3:
                more *= 1.4
            else:
                share, more = min(1.0, 3 * share), 1.5

    def misses(self, x: np.ndarray, y: np.ndarray) -> float:
        """Share of the pairs (x[i], y[i]) that meet in no filter."""
        keys = []
        for v in (x, y):
            row, found = self.decode(v)
            keys.append(row * (self.tables * self.size**2) + found)
        met = np.unique(keys[0][np.isin(keys[0], keys[1])] // (self.tables * self.size**2))
        return 1 - len(met) / len(x)

    def _scores(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        turn, c1, c2 = _table(self.dim, self.size, table)
        x = unit @ turn
        return x[:, : c1.shape[1]] @ c1.T, x[:, self.dim - c2.shape[1] :] @ c2.T

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that a row of ``unit`` exceeds the cap of, in order of row and filter.

        Block by block: only first codes that can still reach the cap with the row's best second code are followed,
        and of their second codes, in falling order, those up to the cap.  A row over no cap of a table gets the
        filter of its two best codes there.
        """
        rows, found = [], []
        for at in range(0, len(unit), 512):
            for table in range(self.tables):
                a, b = self._scores(unit[at : at + 512], table)
                (i, f), counts, order = _over(a, b, self.cap)
                lonely = np.setdiff1d(np.arange(len(a)), i)
                row = np.concatenate([np.repeat(i, counts), lonely])
                place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                second = np.concatenate([order[np.repeat(i, counts), place], b[lonely].argmax(axis=1)])
                first = np.concatenate([np.repeat(f, counts), a[lonely].argmax(axis=1)])
                rows.append(row + at)
                found.append((table * self.size + first) * self.size + second)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, found = np.concatenate(rows), np.concatenate(found)
        by = np.lexsort((found, rows))
        return rows[by].astype(np.int64), found[by].astype(np.int64)


def _over(a: np.ndarray, b: np.ndarray, cap: float) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """(row, first code) with some score a + b of ``cap`` or more, how many second codes each has, and these in falling order."""
    order = np.argsort(-b, axis=1, kind="stable")
    rising = -np.take_along_axis(b, order, axis=1)
    i, f = np.nonzero(a - rising[:, :1] >= cap)
    # one search in all rows at once: each row is shifted beyond the last
    span = 4 * (np.abs(a).max(initial=0) + np.abs(b).max(initial=0) + abs(cap)) + 1
    shifted = (rising + span * np.arange(len(b))[:, None]).ravel()
    counts = np.searchsorted(shifted, a[i, f] - cap + span * i, side="right") - i * b.shape[1]
    keep = counts > 0
    return (i[keep], f[keep]), counts[keep], order


def _unit(rows: pd.Series, dtype) -> np.ndarray:
    v = np.stack([np.frombuffer(r, dtype) for r in rows]).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _compare(dtype, least: float):
    """Of one group (label, dimension, first code, two parts): links of each vector and its component in each filter.

    A pair of vectors meets in every filter that both exceed; it is counted in the smallest of these, which a
    product of membership matrices over smaller filters tells, so no list of pairs is made.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        unit, node, times = _unit(pdf["vec"], dtype), pdf["node"].to_numpy(), pdf["times"].to_numpy(np.float64)
        lists = [np.frombuffer(f, np.int32) for f in pdf["filters"]]
        part, lo, hi, first = pdf["part"].to_numpy(), pdf["lo"].iloc[0], pdf["hi"].iloc[0], pdf["first"].iloc[0]
        size = pdf["size"].iloc[0]
        flat, row = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        here = flat // size == first
        by = pd.Series(row[here]).groupby(flat[here], sort=True)
        links, edges = np.zeros(len(pdf)), []
        for f, members in by:
            m = members.to_numpy()
            if len(m) < 2:
                continue
            v = unit[m]
            for at in range(0, len(m), ROWS):
                top = np.arange(at, min(at + ROWS, len(m)))
                near = v[top] @ v.T >= least
                near[np.arange(len(top)), top] = False
                if lo != hi:
                    near &= part[m[top]][:, None] != part[m][None, :]
                if not near.any():
                    continue
                r, c = near.any(axis=1), near.any(axis=0)
                rows, cols, near = top[r], np.flatnonzero(c), near[np.ix_(r, c)]
                use = np.union1d(rows, cols)
                below = (flat < f) & np.isin(row, m[use])
                names, col = np.unique(flat[below], return_inverse=True)
                has = np.zeros((len(pdf), len(names)), np.float32) if len(pdf) * len(names) < 1 << 24 else None
                if has is None:  # index by member instead of by row
                    place = np.zeros(len(pdf), np.int64)
                    place[m[use]] = np.arange(len(use))
                    has = np.zeros((len(use), len(names)), np.float32)
                    has[place[row[below]], col] = 1
                    x, y = has[np.searchsorted(use, rows)], has[np.searchsorted(use, cols)]
                else:
                    has[row[below], col] = 1
                    x, y = has[m[rows]], has[m[cols]]
                fresh = near & ~(x @ y.T > 0)
                links[m[rows]] += fresh @ times[m[cols]]
                # components of the links between these rows and columns
                label_r, label_c = node[m[rows]].copy(), node[m[cols]].copy()
                big = np.iinfo(np.int64).max
                while True:
                    new_r = np.minimum(label_r, np.where(near, label_c[None, :], big).min(axis=1))
                    new_c = np.minimum(label_c, np.where(near, new_r[:, None], big).min(axis=0))
                    if (new_r == label_r).all() and (new_c == label_c).all():
                        break
                    label_r, label_c = new_r, new_c
                edges.append(pd.DataFrame({"a": np.concatenate([node[m[rows]], node[m[cols]]]), "b": np.concatenate([label_r, label_c])}))
        hit = np.flatnonzero(links)
        out = pd.DataFrame({"a": node[hit], "b": node[hit], "links": links[hit].astype(np.int64)})
        if edges:
            e = pd.concat(edges).drop_duplicates().query("a != b")
            out = pd.concat([out, e.assign(links=0)], ignore_index=True)
        return out

    return compare


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(label, dim, part, n, total): sums of unit vectors by label, put together in a task as long as labels are few."""
    held: dict[tuple, list] = {}

    def given() -> pd.DataFrame:
        rows = [(label, dim, TaskContext.get().partitionId(), n, total.tobytes()) for (label, dim), (n, total) in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["label", "dim", "part", "n", "total"])

    for b in batches:
        for key, part in b.groupby(["label", b["v"].map(len)]):
            n, total = held.get(key, (0, 0.0))
            held[key] = (n + len(part), total + _units(part["v"]).sum(axis=0))
        if len(held) > 2048:
            yield given()
    yield given()


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(t, np.float64) for t in pdf["total"])
    return pd.DataFrame({"label": pdf["label"].iloc[:1], "dim": pdf["dim"].iloc[:1], "n": [pdf["n"].sum()], "total": [total.tobytes()]})


def _mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A label's mean direction, drawn towards 0 where vectors are few, in steps of 2^-20 so that no order of addition shows."""
    for b in batches:
        mus = [np.round(np.frombuffer(t, np.float64) / (n + 256) * 2**20) / 2**20 for t, n in zip(b["total"], b["n"])]
        yield pd.DataFrame({"label": b["label"], "dim": b["dim"], "n": b["n"], "mu": [mu.tobytes() if mu @ mu >= LEAN**2 else None for mu in mus]})


def _radii(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(label, dim, radius): the least distance of a unit vector from its label's mean in each batch."""
    for b in batches:
        for (label, dim), part in b.groupby(["label", b["v"].map(len)]):
            x = _units(part["v"]) - np.frombuffer(part["mu"].iloc[0], np.float64)
            yield pd.DataFrame({"label": [label], "dim": [dim], "radius": [math.sqrt((x * x).sum(axis=1).min())]})


def _units(rows: pd.Series) -> np.ndarray:
    return _unit(pd.Series([np.asarray(v, np.float64).tobytes() for v in rows]), np.float64)


def _centres(classes: DataFrame, least: float) -> DataFrame:
    """(label, dim, n, mu, rho) of each label and length: rho is the cosine that linked vectors have at least, seen from mu.

    Where vectors lean one way (a mean longer than LEAN), most would exceed the caps of the same few filters;
    seen from the mean they don't.  Unit vectors with cosine ``least`` are d apart, d * d = 2 (1 - least), so if none
    is nearer to the mean than r their cosine from there is 1 - d * d / (2 r * r) or more.  With a vector nearer
    than NEAREST (or as near as linked ones may be to each other) the label keeps mu null: the origin.
    """
    vectors = classes.select("label", "v")
    sums = vectors.mapInPandas(_sums, "label string, dim int, part int, n long, total binary")
    sums = in_levels(sums, ["label", "dim"], max(2, vectors.rdd.getNumPartitions()), _added)
    means = materialize(sums.mapInPandas(_mean, "label string, dim int, n long, mu binary"))
    lean = means.where("mu is not null")
    if not lean.limit(1).count():
        return means.select("*", F.lit(least).alias("rho"))
    near = classes.select("label", "v", F.size("v").alias("dim")).join(lean, ["label", "dim"]).select("label", "v", "mu")
    near = near.mapInPandas(_radii, "label string, dim int, radius double").groupBy("label", "dim").agg(F.min("radius").alias("radius"))
    floor = max(NEAREST, math.sqrt(2 * (1 - least)) * 1.05)
    step = F.when(F.col("radius") >= 0.8, 0.8).when(F.col("radius") >= floor, floor)
    placed = means.join(near, ["label", "dim"], "left").select("*", step.alias("r"))
    rho = F.coalesce(1 - (1 - least) / (F.col("r") * F.col("r")), F.lit(least))
    return materialize(placed.select("label", "dim", "n", F.when(F.col("r").isNotNull(), F.col("mu")).alias("mu"), rho.alias("rho")))


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST) -> DataFrame:
    """(id, n_links, component_id) of every row: links join rows of one label with cosine ``least`` or more.

    Equal vectors of a label are one class with a count.  Each class is list-decoded to all filters of some
    product codes whose spherical cap it lies in (:class:`Code`; its best filter in a code that has none), and classes
    of a label meet in filters; cosines there are taken in double precision.  Where a label's vectors lean one way they
    are decoded as seen from their mean (:func:`_centres`).  Filters with one first code form a group, so a vector
    is sent once for each of its first codes; groups over PART rows are compared part against part in several tasks.
    The codes grow with the largest label, so that filters stay small.  A pair at exactly ``least`` is missed with a
    measured chance below MEASURED, more alike ones less often.

    A null label, and a vector that is null, zero or holds null or non-finite components, links with nothing;
    so do vectors of unlike length.  Ids may be null or repeated.  component_id is the smallest id of a component (nulls
    aside).  Other columns, whatever their names, aren't read.  An empty table gives no rows.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    dtype = np.float32 if kind == "array<float>" else np.float64
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if dtype is np.float32 else "array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    limit = F.lit(float("inf"))
    good = F.col("v").isNotNull() & F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists("v", lambda x: x != 0)
    rows = rows.select("id", "label", "v", F.when(good, F.xxhash64("label", "v")).alias("node"))
    classes = rows.where("node is not null").groupBy("node", "label", "v").agg(F.count(F.lit(1)).alias("times"))
    classes = materialize(classes)
    centres = _centres(classes, least)
    # one row for each length of vector and each of at most three cosines
    codes = {(r.dim, r.rho): Code.plan(r.dim, 1 << max(0, (r.n - 1).bit_length()), r.rho) for r in centres.groupBy("dim", "rho").agg(F.max("n").alias("n")).collect()}

    def decoded(batches):
        for b in batches:
            for (dim, rho), part in b.groupby([b["v"].map(len), "rho"]):
                code = codes[dim, rho]
                for at in range(0, len(part), 2048):
                    p = part.iloc[at : at + 2048].reset_index(drop=True)
                    raw = [np.asarray(v, dtype).tobytes() for v in p["v"]]
                    x = _unit(pd.Series(raw), dtype)
                    seen = p["mu"].notna().to_numpy()
                    if seen.any():
                        x[seen] -= np.stack([np.frombuffer(m, np.float64) for m in p["mu"][seen]])
                        x[seen] /= np.sqrt((x[seen] ** 2).sum(axis=1, keepdims=True))
                    row, found = code.decode(x)
                    ends = np.searchsorted(row, np.arange(len(p) + 1))
                    lists = [found[a:e].astype(np.int32) for a, e in zip(ends[:-1], ends[1:])]
                    made = pd.DataFrame({"label": p["label"], "dim": dim, "size": code.size, "node": p["node"], "times": p["times"], "vec": raw, "filters": [f.tobytes() for f in lists], "first": [np.unique(f // code.size) for f in lists]})
                    yield made.explode("first", ignore_index=True).astype({"first": np.int64})

    placed = classes.select("label", F.size("v").alias("dim"), "node", "times", "v").join(centres.select("label", "dim", "mu", "rho"), ["label", "dim"])
    met = materialize(placed.select("label", "node", "times", "v", "mu", "rho").mapInPandas(decoded, "label string, dim int, size int, node long, times long, vec binary, filters binary, first long"))
    sizes = met.groupBy("label", "dim", "first").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / PART).cast("int")
    dealt = met.join(sizes.where("n > 1"), ["label", "dim", "first"]).select("*", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select("label", "dim", "first", "size", "node", "times", "vec", "filters", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    found = materialize(dealt.groupBy("label", "dim", "first", "lo", "hi").applyInPandas(_compare(dtype, least), "a long, b long, links long"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    comp = components(found.where("a <> b").select("a", "b"))
    info = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times")).join(links, "node", "left").join(comp, "node", "left")
    info = info.select("node", "first", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp"))
    least_id = info.groupBy("comp").agg(F.min("first").alias("component_id"))
    info = info.join(least_id, "comp").select("node", "n_links", "component_id")
    out = rows.select("id", "node").join(info, "node", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op10_embedding_dedup(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.  Vectors that are null, zero or not finite, and null labels, link with nothing; equal vectors of a label are one class from the start."""
    found = near_duplicate_vectors(vectors)
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
