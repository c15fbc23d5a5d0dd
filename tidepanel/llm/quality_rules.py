"""Rejecting documents by minimum-covariance-determinant estimates per language and source.  DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

GRID = 1000  # statistics are kept as whole thousandths, so that sums are exact in any order
DIMS = ("x0", "x1", "x2", "x3", "x4")
P = len(DIMS)
CELLS = [(i, j) for i in range(P) for j in range(i + 1)]
#: Least spread of each statistic, in thousandths: differences below it mean nothing.
FLOORS = (50, 40, 100, 100, 40)
STARTS = ("median", "tanh", "sign", "mean")
H = 0.5
#: Of a normal distribution in 5 dimensions: what the covariance of its inner 50 % and 97.5 % is to be multiplied by, and
#: the squared distance that 97.5 % lie within.
INNER, REWEIGHTED, WITHIN = 1.912, 1.056, 12.83
#: The squared distance that a share of 1 - 1e-9 of a normal distribution in 5 dimensions lies within.
CUTOFF = 50.7
PRIOR = 50  # documents that the language's estimate counts for in each of its sources


def text_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """Word statistics of every whole text, in the row (nothing is exploded or shuffled).

    Null text counts as empty.  Repeated 5-word windows are found by sorting the text's own window hashes with
    their indices: equal hashes become neighbours.  A text of any length is one row; its windows take some 60 bytes a word.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(*keep, text.alias("t"), F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"))
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        *keep, "words", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).cast("long").alias("n_upper"), lines.alias("lines"),
    )
    windows = F.when(F.size("words") >= 5, F.transform(F.sequence(F.lit(1), F.size("words") - 4), lambda i: F.struct(F.xxhash64(F.slice("words", i, 5)).alias("h"), i.alias("i")))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    d = d.select(*keep, "n_words", "word_chars", "n_symbols", "n_upper", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.sort_array(windows).alias("s"))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce(x["h"] == y["h"], F.lit(False))

    found = F.filter("s", lambda x, k: same(x, F.get("s", k + 1)) | same(x, F.get("s", k - 1)))
    d = d.select("*", F.sort_array(F.transform(found, lambda x: x["i"])).alias("at"))
    reached = F.transform("at", lambda i, k: F.least(F.lit(5), F.coalesce(F.get("at", k + 1) - i, F.lit(5))))
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", F.aggregate(reached, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))


def _vector() -> list[Column]:
    """Transformed statistics in whole thousandths; all are 0 for a text without words."""
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.sqrt(F.col(a) / F.col(b))).otherwise(0.0)

    xs = [F.when(F.col("n_words") > 0, F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.col("n_words"))).otherwise(0.0), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_upper", "word_chars")]
    return [F.round(x * GRID).cast("long").alias(n) for x, n in zip(xs, DIMS)]


def _cholesky() -> list[str]:
    """SQL of the Cholesky factor l_i_j of columns c_i_j, in an order in which each needs only earlier ones."""
    out = []
    for j in range(P):
        for i in range(j, P):
            s = " - ".join([f"c_{i}_{j}", *[f"l_{i}_{k} * l_{j}_{k}" for k in range(j)]])
            out.append((f"sqrt(greatest({s}, 1e-9D))" if i == j else f"({s}) / l_{j}_{j}") + f" AS l_{i}_{j}")
    return out


def _distance(rows: DataFrame) -> DataFrame:
    """``rows`` with z_i and d2, the squared Mahalanobis distance of the DIMS from m_i with Cholesky factor l_i_j."""
    zs = [f"({' - '.join([f'{x} - m_{i}', *[f'l_{i}_{k} * z_{k}' for k in range(i)]])}) / l_{i}_{i} AS z_{i}" for i, x in enumerate(DIMS)]
    return rows.selectExpr("*", *zs, " + ".join(f"z_{i} * z_{i}" for i in range(P)) + " AS d2")


def _sums(by: list[str]) -> list[Column]:
    """Count, sums and sums of products of whole-number columns given in SQL."""
    return [F.expr(x) for x in ["count(1) AS n", *[f"sum({c}) AS s_{i}" for i, c in enumerate(by)], *[f"sum({by[i]} * {by[j]}) AS s_{i}_{j}" for i, j in CELLS]]]


def _cov(i: int, j: int) -> str:
    return f"(s_{i}_{j} / n - s_{i} / n * (s_{j} / n))"


def _floored(scale: float) -> list[str]:
    """SQL of the means and of the covariances times ``scale``, of ``_sums``; the floors keep the matrix regular from the first row on."""
    return [*[f"s_{i} / n AS m_{i}" for i in range(P)], *[f"{scale}D * {_cov(i, j)}" + (f" + {FLOORS[i] ** 2}D" if i == j else "") + f" AS c_{i}_{j}" for i, j in CELLS]]


M = [f"m_{i}" for i in range(P)]
C = [f"c_{i}_{j}" for i, j in CELLS]
L = [f"l_{i}_{j}" for i, j in CELLS]


def _factored(params: DataFrame) -> DataFrame:
    """``params`` with the Cholesky factor of its covariances and the logarithm of their determinant."""
    return params.selectExpr("*", *_cholesky(), "2 * (" + " + ".join(f"ln(l_{i}_{i})" for i in range(P)) + ") AS logdet")


def _starts(use: DataFrame) -> DataFrame:
    """(g, start, m_i, c_i_j): four first estimates of each group.

    median: medians and quartile spreads.  tanh, sign: the same with the correlations of squashed standardised
    statistics, or of their directions.  mean: plain mean and covariance.
    """
    box = use.groupBy("g").agg(*[F.expr(f"percentile({x}, array(0.25D, 0.5D, 0.75D)) AS q_{i}") for i, x in enumerate(DIMS)])
    box = materialize(box.selectExpr("g", *[f"q_{i}[1] AS m_{i}" for i in range(P)], *[f"greatest((q_{i}[2] - q_{i}[0]) / 1.349D, {FLOORS[i]}D) AS d_{i}" for i in range(P)]))
    z = use.join(box, "g").selectExpr("g", *DIMS, *[f"({x} - m_{i}) / d_{i} AS z_{i}" for i, x in enumerate(DIMS)])
    z = z.selectExpr("*", "sqrt(" + " + ".join(f"z_{i} * z_{i}" for i in range(P)) + ") AS length")
    z = z.selectExpr("g", *DIMS, *[f"cast(round(tanh(z_{i}) * {GRID}) AS long) AS t_{i}" for i in range(P)], *[f"cast(round(CASE WHEN length > 0 THEN z_{i} / length ELSE 0D END * {GRID}) AS long) AS u_{i}" for i in range(P)])
    kinds = {"tanh": [f"t_{i}" for i in range(P)], "sign": [f"u_{i}" for i in range(P)], "mean": list(DIMS)}
    wide = materialize(z.groupBy("g").agg(*[F.struct(*_sums(cols)).alias(kind) for kind, cols in kinds.items()]))
    parts = [box.selectExpr("g", "'median' AS start", *M, *[(f"d_{i} * d_{i}" if i == j else "0D") + f" AS c_{i}_{j}" for i, j in CELLS])]
    for kind in ("tanh", "sign"):
        one = wide.select("g", f"{kind}.*").join(box, "g")
        # correlations drawn towards 0 a little, so that the matrix is regular
        r = {(i, j): "1D" if i == j else f"0.98D * {_cov(i, j)} / sqrt(({_cov(i, i)} + 1D) * ({_cov(j, j)} + 1D))" for i, j in CELLS}
        parts.append(one.selectExpr("g", f"'{kind}' AS start", *M, *[f"d_{i} * d_{j} * {r[i, j]} AS c_{i}_{j}" for i, j in CELLS]))
    parts.append(wide.select("g", "mean.*").selectExpr("g", "'mean' AS start", *_floored(1.0)))
    return reduce(DataFrame.unionByName, parts)


def _concentrated(use: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step: mean and covariance of the nearest half of each group, for each start.

    One aggregation by (group, start, bin of distance) with exact whole-number sums; bins up to the half are added
    up, so no sort, no sample and no row order comes in.
    """
    keys = ["g", "start"]
    near = _distance(use.join(params.select(*keys, *M, *L), "g"))
    binned = near.groupBy(*keys, F.expr("floor(ln(1D + d2) * 64) AS bin")).agg(*_sums(list(DIMS)))
    w = Window.partitionBy(*keys)
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inner = binned.select("*", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(w).alias("all")).where(F.col("before") < F.col("all") * H)
    total = inner.groupBy(*keys).agg(*[F.expr(f"cast(sum({c}) AS double) AS {c}") for c in ["n", *[f"s_{i}" for i in range(P)], *[f"s_{i}_{j}" for i, j in CELLS]]])
    return _factored(total.selectExpr(*keys, *_floored(INNER)))


def mcd_estimates(use: DataFrame, most_steps: int = 10) -> DataFrame:
    """(g, n, m_i, c_i_j): reweighted minimum-covariance-determinant estimates of the DIMS of each group ``g``.

    Four starts (:func:`_starts`) go through two concentration steps; each group goes on with the one of the least
    determinant until no determinant falls any more, or ``most_steps``.  Rows within the 97.5 % distance of the
    result give the final mean and covariance, n is their count.
    """
    params = materialize(_factored(_starts(use)))
    for _ in range(2):
        params, old = materialize(_concentrated(use, params)), params
        release(old)
    best = params.groupBy("g").agg(F.min(F.struct("logdet", "start")).alias("best")).select("g", F.col("best.start").alias("start"))
    params = materialize(params.join(best, ["g", "start"]))
    for _ in range(most_steps):
        new = materialize(_concentrated(use, params))
        fell = params.join(new.select("g", F.col("logdet").alias("new")), "g").where(F.col("new") < F.col("logdet") - 1e-3).limit(1).count()
        release(params)
        params = new
        if not fell:
            break
    near = _distance(use.join(params.select("g", *M, *L), "g")).where(F.col("d2") <= WITHIN)
    final = near.groupBy("g").agg(*_sums(list(DIMS)))
    return materialize(final.selectExpr("g", "n", *_floored(REWEIGHTED)))


def mcd_distances(rows: DataFrame, group: str = "pair", wider: str = "wide", fit: Column | None = None) -> DataFrame:
    """``rows`` (group, wider, DIMS and others) with d2, the squared Mahalanobis distance by the estimate of the row's group.

    A group's estimate is pooled with that of the wider group that it lies in, which counts for PRIOR rows (its own
    share of these rows is not taken out): mean, covariance, and the distance between both means as covariance.  So
    an estimate is there from the first row on and changes smoothly with the count.  Rows for which ``fit`` is false get a distance
    but don't take part.  A group none of whose rows takes part has that of the wider one; if there is none
    either, d2 is null.
    """
    use = rows if fit is None else rows.where(fit)
    both = use.select(F.explode(F.array(F.concat(F.lit("g"), group), F.concat(F.lit("w"), wider))).alias("g"), *DIMS)
    found = mcd_estimates(both)
    own = found.where(F.col("g").startswith("g")).select(F.substring("g", 2, 1 << 30).alias(group), F.col("n").alias("own"), *[F.col(c).alias(f"g{c}") for c in M + C])
    wide = found.where(F.col("g").startswith("w")).select(F.substring("g", 2, 1 << 30).alias(wider), *[F.col(c).alias(f"w{c}") for c in M + C])
    pairs = rows.select(group, wider).distinct().join(wide, wider).join(own, group, "left").selectExpr("*", "cast(coalesce(own, 0) AS double) AS k", f"{PRIOR}D AS p")

    def pooled(c: str) -> str:
        return f"(k * coalesce(g{c}, 0D) + p * w{c}) / (k + p)"

    def apart(i: int) -> str:
        return f"coalesce(gm_{i} - wm_{i}, 0D)"

    params = pairs.selectExpr(group, *[f"{pooled(m)} AS {m}" for m in M], *[f"{pooled(f'c_{i}_{j}')} + k * p / ((k + p) * (k + p)) * {apart(i)} * {apart(j)} AS c_{i}_{j}" for i, j in CELLS])
    params = materialize(_factored(params).select(group, *M, *L))
    return _distance(rows.join(params, group, "left")).select(*rows.columns, "d2")


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, base statistics, base_failed, d2 and kept of every document.

    A group is a (language, source) pair, its wider group the language.  Null language, source or text are values of
    their own (text: empty, which fails the base).  Where no document of a language passes the base, d2 is
    null and the base decides.  Ids may be null or repeated, equal rows have equal results, other columns aren't
    read, and an empty table gives no rows.
    """
    s = text_statistics(docs)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    wide, narrow = (F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in ("lang", "source"))
    s = materialize(s.select("doc_id", wide.alias("wide"), F.concat_ws("\x01", wide, narrow).alias("pair"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *_vector()))
    d = mcd_distances(s, fit=~F.col("base_failed"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", kept.alias("kept"))


def op6_quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, statistics, base_failed and kept of every document.  Null and empty texts have no words and fail the base; a text of any length is one row."""
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
