"""Quality classifier by co-training: a text view and a metadata view teach each other, then score together."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_levels, materialize, release, small_batches

SHAPES, WORDS, NUMBERS, META = 128, 512, 4, 96
CONTENT = SHAPES + WORDS + NUMBERS
ROWS_AT_ONCE = 1000
SLICES = 16


def _hashed(values: pa.Array, n: int) -> np.ndarray:
    return (pd.util.hash_array(np.asarray(values.to_pylist(), dtype=object)) % n).astype(np.int64) if len(values) else np.zeros(0, np.int64)


def content_features(texts: list[str | None]) -> np.ndarray:
    """One row of CONTENT float32 for each whole text; an empty or null text is all zeros.

    Shares of hashed word shapes (letters of one case, digits: a run is one mark) and of hashed words, each
    under a square root, then share of distinct words, mean word length, share of distinct lines, log of length.
    """
    out = np.zeros((len(texts), CONTENT), np.float32)
    for a in range(0, len(texts), ROWS_AT_ONCE):
        part = [t or "" for t in texts[a : a + ROWS_AT_ONCE]]
        tokens = pc.split_pattern_regex(pc.utf8_trim_whitespace(pa.array(part, pa.large_string())), r"\s+")
        lens = np.array([0 if t == "" else n for t, n in zip(part, pc.list_value_length(tokens).to_numpy())])
        flat = pc.list_flatten(tokens)
        code = flat.dictionary_encode()
        code = code if isinstance(code, pa.DictionaryArray) else code.combine_chunks()
        idx, vocabulary = code.indices.to_numpy(), code.dictionary
        doc = np.repeat(np.arange(len(part)), pc.list_value_length(tokens).to_numpy())
        shape = vocabulary
        for pattern, mark in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"\p{Nd}+", "9")):
            shape = pc.replace_substring_regex(shape, pattern, mark)
        shape = shape.dictionary_encode()
        by_shape = _hashed(shape.dictionary, SHAPES)[shape.indices.to_numpy()] if len(vocabulary) else np.zeros(0, np.int64)
        n, k = np.maximum(lens, 1)[:, None], len(part)
        block = out[a : a + k]
        block[:, :SHAPES] = np.sqrt(np.bincount(doc * SHAPES + by_shape[idx], minlength=k * SHAPES).reshape(k, SHAPES) / n)
        block[:, SHAPES : SHAPES + WORDS] = np.sqrt(np.bincount(doc * WORDS + _hashed(pc.utf8_lower(vocabulary), WORDS)[idx], minlength=k * WORDS).reshape(k, WORDS) / n)
        distinct = np.bincount(np.unique(doc.astype(np.int64) * (len(vocabulary) + 1) + idx) // (len(vocabulary) + 1), minlength=k)
        chars = np.bincount(doc, weights=pc.utf8_length(vocabulary).to_numpy()[idx] if len(vocabulary) else None, minlength=k)
        lines = [t.split("\n") for t in part]
        block[:, -4:] = np.stack([distinct / n[:, 0], chars / n[:, 0] / 10, [len(set(x)) / len(x) for x in lines], np.log1p(lens) / 10], axis=1)
        block[lens == 0] = 0
    return out


def meta_features(lang, source, n_chars) -> np.ndarray:
    """One row of META float32: hashed language and source (null is a value), log of length in bins."""
    out = np.zeros((len(lang), META), np.float32)
    row = np.arange(len(lang))
    for at, size, values in ((0, 16, lang), (16, 64, source)):
        names = np.asarray(["\x00" if v is None or v != v else str(v) for v in values], dtype=object)
        if len(names):
            out[row, at + (pd.util.hash_array(names) % size).astype(int)] = 1
    chars = pd.to_numeric(pd.Series(n_chars), errors="coerce").fillna(0).clip(lower=0).to_numpy()
    out[row, 80 + np.minimum(np.log2(chars + 1), 15).astype(int)] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; classes weigh alike.  The last weight is the intercept."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    w, share = np.zeros(x.shape[1]), np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + penalty * w
        h = (x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x.astype(np.float64) @ w[:-1] + w[-1], -30, 30)


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class Model:
    """Weights of both views, their calibrations (slope, shift) and how calibrated logits are combined."""

    content: np.ndarray
    meta: np.ndarray
    calibrations: tuple[np.ndarray, np.ndarray]
    combine: np.ndarray

    def score(self, xc: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c, m = (_logit(_logit(x, w)[:, None], k) for x, w, k in ((xc, self.content, self.calibrations[0]), (xm, self.meta, self.calibrations[1])))
        return _p(c), _p(m), _p(_logit(np.stack([c, m], axis=1), self.combine))


def _labels_given(x: tuple[np.ndarray, np.ndarray], history: list, sure: float) -> list[np.ndarray]:
    """For each view the labels that the other one gives (nan: none): those of the first round in which it is sure."""
    out = []
    for v in range(2):
        got = np.full(len(x[v]), np.nan)
        for ws in history:
            p = _p(_logit(x[1 - v], ws[1 - v]))
            free = np.isnan(got)
            got[free & (p >= sure)], got[free & (p <= 1 - sure)] = 1.0, 0.0
        out.append(got)
    return out


def _loss_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weighted log loss, its gradient and its Hessian (products in single precision: they only steer the steps), flat."""
    z = np.clip(x.astype(np.float64) @ w[:-1] + w[-1], -30, 30)
    p, weight = _p(z), share[y.astype(int)]
    loss = (weight * (np.logaddexp(0, z) - y * z)).sum()
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    h = (x * (weight * p * (1 - p) + 1e-9).astype(x.dtype)[:, None]).T @ x
    return np.concatenate([[loss], x.astype(np.float64).T @ (weight * (p - y)), h.astype(np.float64).ravel()])


def pool_sums(x: tuple[np.ndarray, np.ndarray], history: list, w: list | None, shares: np.ndarray | None, sure: float) -> np.ndarray:
    """What some unlabelled rows add to the training of both views, as one flat array that can be added up.

    Without ``w`` the number of pseudo-labels 0 and 1 for each view, else the ``_loss_sums`` of each view whose weights are given.
    """
    labels = _labels_given(x, history, sure)
    if w is None:
        return np.array([float((y == c).sum()) for y in labels for c in (0, 1)])
    out = []
    for v in range(2):
        if w[v] is not None:
            known = ~np.isnan(labels[v])
            out.append(_loss_sums(x[v][known], labels[v][known], w[v], shares[v]))
    return np.concatenate(out)


def co_train(xc: np.ndarray, xm: np.ndarray, y: np.ndarray, held: np.ndarray, pool_c: np.ndarray, pool_m: np.ndarray, rounds: int = 3, sure: float = 0.97) -> Model:
    """``co_train_by_sums`` over a pool of unlabelled rows in memory."""
    return co_train_by_sums(xc, xm, y, held, lambda *task: pool_sums((pool_c, pool_m), *task), rounds, sure)


def co_train_by_sums(xc: np.ndarray, xm: np.ndarray, y: np.ndarray, held: np.ndarray, added: Callable[..., np.ndarray], rounds: int = 3, sure: float = 0.97, ridge: float = 1.0, steps: int = 12) -> Model:
    """Train both views on the rows that aren't ``held``; calibrate and combine on those that are.

    In each round a view labels all pool rows that it is sure of (probability ``sure`` or more either way) for
    the other view's next training; a row keeps the first label that it was given.  ``added(history, w, shares,
    sure)`` is the sum of ``pool_sums`` over the whole pool, of any size.  Pseudo-labels together weigh no more than
    the labelled rows, so that these aren't drowned in a large pool; classes weigh alike.
    """
    fit = ~held
    x, y_fit, history = (xc[fit], xm[fit]), y[fit], []
    w = [fit_logistic(part, y_fit, ridge) for part in x]
    for _ in range(rounds):
        history = [*history, tuple(w)]
        given = added(history, None, None, sure).reshape(2, 2)
        trust = [min(1.0, len(y_fit) / max(n, 1.0)) for n in given.sum(axis=1)]
        sizes = np.stack([np.array([(y_fit == c).sum() for c in (0, 1)]) + t * g for t, g in zip(trust, given)])
        shares = 0.5 * sizes.sum(axis=1, keepdims=True) / sizes
        trial, step, best, open_ = list(w), [None, None], [np.inf, np.inf], [0, 1]
        for _ in range(steps):
            ask = [trial[v] if v in open_ else None for v in range(2)]
            total, at = added(history, ask, shares * np.array(trust)[:, None], sure), 0
            for v in list(open_):
                n = len(w[v])
                sums = total[at : at + 1 + n + n * n] + _loss_sums(x[v], y_fit, trial[v], shares[v])
                at += 1 + n + n * n
                penalty = np.full(n, ridge)
                penalty[-1] = 1e-6
                loss = sums[0] + 0.5 * (penalty * trial[v] ** 2).sum()
                if loss > best[v] * (1 + 1e-12):  # too far
                    step[v] = step[v] / 2
                else:
                    w[v], best[v] = trial[v], loss
                    step[v] = np.linalg.solve(sums[1 + n :].reshape(n, n) + np.diag(penalty), sums[1 : 1 + n] + penalty * trial[v])
                trial[v] = w[v] - step[v]
                if np.abs(step[v]).max() < 1e-4:  # steps shrink quadratically
                    w[v] = trial[v]
                    open_.remove(v)
            if not open_:
                break
    c, m = _logit(xc[held], w[0]), _logit(xm[held], w[1])
    kc, km = (fit_logistic(z[:, None], y[held], ridge=0.1) for z in (c, m))
    both = np.stack([_logit(c[:, None], kc), _logit(m[:, None], km)], axis=1)
    return Model(w[0], w[1], (kc, km), fit_logistic(both, y[held], ridge=0.1))


def _unpacked(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(map(bytes, batch[c])), np.float32).reshape(len(batch), -1) for c in ("xc", "xm"))


def _added_on_executors(pool: DataFrame) -> Callable[..., np.ndarray]:
    """``added`` of ``co_train_by_sums``: one pass over ``pool`` (xc, xm), summed in slices and levels; the driver gets one sum."""
    n_parts = max(2, pool.rdd.getNumPartitions())

    def added(history: list, w: list | None, shares: np.ndarray | None, sure: float) -> np.ndarray:
        size = 4 if w is None else sum(1 + len(x) + len(x) ** 2 for x in w if x is not None)

        def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size)
            for b in batches:
                if len(b):
                    total += pool_sums(_unpacked(b), history, w, shares, sure)
            pieces = [x.tobytes() for x in np.array_split(total, SLICES)]
            yield pd.DataFrame({"i": range(SLICES), "part": TaskContext.get().partitionId(), "sums": pieces})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            # in order of the parts, so that equal layouts give equal sums
            total = sum(np.frombuffer(b, np.float64) for b in pdf["sums"])
            return pd.DataFrame({"i": pdf["i"].iloc[:1], "sums": [total.tobytes()]})

        parts = pool.mapInPandas(some, "i int, part int, sums binary")
        got = {r.i: r.sums for r in in_levels(parts, ["i"], n_parts, add).collect()}
        return np.frombuffer(b"".join(bytes(got[i]) for i in range(SLICES)), np.float64) if got else np.zeros(size)

    return added


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, target: str = "quality", rounds: int = 3, sure: float = 0.97) -> Model | None:
    """Fit on at most ``max_labelled`` labelled documents, those of least id hash, and on all other documents.

    That bound is the only sampling here; it holds the labelled rows (about 20 MB) on the driver.  All other
    documents, those without an id or with a label beyond the bound included, are unlabelled: their features are
    written to the shared folder once, and each round adds up what the sure ones contribute on the executors.
    Of rows that share a labelled id the one of least text hash trains, and the others aren't used, so reruns agree.
    Labels of one document are averaged, 0.5 or more counting as 1; null labels don't count.  A quarter of the
    labelled rows, by hash, is held for calibration.  None if either part lacks one of the classes.
    """
    want = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(target) >= 0.5).cast("double").alias("y"))
    # bounded by the limit, so the ids can be broadcast
    ids = docs.select("doc_id").where("doc_id is not null").join(want, "doc_id").select("doc_id", "y", F.xxhash64(F.lit(3), "doc_id").alias("h")).distinct()
    some = materialize(ids.orderBy("h").limit(max_labelled))
    names = {c.lower() for c in docs.columns}
    meta = [F.col(c).cast("string").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in ("lang", "source")] + [F.col("n_chars").cast("long").alias("n_chars") if "n_chars" in names else F.length("text").cast("long").alias("n_chars")]
    whole = docs.select("doc_id", F.col("text").cast("string").alias("text"), *meta)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            xc, xm = content_features(b["text"].tolist()), meta_features(b["lang"].tolist(), b["source"].tolist(), b["n_chars"].tolist())
            yield pd.DataFrame({"h": b["h"], "y": b["y"], "xc": [r.tobytes() for r in xc], "xm": [r.tobytes() for r in xm]})

    schema = "h long, y double, xc binary, xm binary"
    one = whole.join(F.broadcast(some), "doc_id").groupBy("h", "y").agg(F.min(F.struct(F.xxhash64("text").alias("th"), "text", "lang", "source", "n_chars")).alias("m"))
    got = one.select("h", "y", "m.*").mapInPandas(features, schema).toPandas().sort_values("h", kind="stable", ignore_index=True)
    if got.empty:
        return None
    xc, xm = _unpacked(got)
    y = got["y"].to_numpy()
    held = (got["h"].to_numpy() >> 7) % 4 == 0
    parts = [y[held], y[~held]]
    if any(len(set(p.tolist())) < 2 for p in parts):
        return None
    others = whole.join(F.broadcast(some.select("doc_id")), "doc_id", "left_anti").select("*", F.lit(None).cast("long").alias("h"), F.lit(None).cast("double").alias("y"))
    pool = materialize(others.mapInPandas(features, schema).select("xc", "xm"), compression="zstd")
    model = co_train_by_sums(xc, xm, y, held, _added_on_executors(pool), rounds, sure)
    release(pool, some)
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **bounds) -> DataFrame:
    """``docs`` with content_score, meta_score, score and kept (score >= ``threshold``); all whole documents are scored.

    Null text, language, source and length are features like any other; ids may be null or repeated.  With too few
    labels to train on, the scores are null and everything is kept.  Columns of these names are replaced; others pass
    through, whatever their names.  A text of any length is one row.  An empty table gives no rows.
    """
    outs = ("content_score", "meta_score", "score", "kept")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in outs])
    small_batches(docs.sparkSession)
    model = train(docs, labels, **bounds)
    if model is None:
        return docs.select("*", *[F.lit(None).cast("double").alias(c) for c in outs[:3]], F.lit(True).alias("kept"))

    @F.pandas_udf("content_score double, meta_score double, score double")
    def scores(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        c, m, s = model.score(content_features(text.tolist()), meta_features(lang.tolist(), source.tolist(), n_chars.tolist()))
        return pd.DataFrame({"content_score": c, "meta_score": m, "score": s})

    names = {c.lower() for c in docs.columns}
    text = F.col("text").cast("string")
    args = [text, *[F.col(c).cast("string") if c in names else F.lit(None).cast("string") for c in ("lang", "source")], F.col("n_chars").cast("long") if "n_chars" in names else F.length(text).cast("long")]
    (s,) = fresh(docs, "scored")
    scored = docs.select("*", scores(*args).alias(s))
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(s)[c].alias(c) for c in outs[:3]], (F.col(s)["score"] >= threshold).alias("kept"))


def op3_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, both views' scores, the joint score and kept of every document; edge cases as in :func:`classify`."""
    return classify(docs, labels).select("doc_id", "content_score", "meta_score", "score", "kept")
