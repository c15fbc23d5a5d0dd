"""Early-warning models: naive scores, logistic and boosted trees on MLlib, ARIMA per series, contributions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics, texts
from ..storage import materialize, scratch, shared_dir
from . import arima
from .events import fold_roles
from .features import GROUPS, IDENTITY
from .panel import SERIES, in_order
from .trees import first_trees, inputs, staged_scores, tree_contributions

def naive(x: Column) -> Column:
    return x - F.lag(x, 7).over(in_order())


def seasonal_naive(x: Column) -> Column:
    return F.lag(x, 350).over(in_order()) - F.lag(x, 364).over(in_order())


def risk_level(prob: Column, spiking: Column, threshold: float) -> Column:
    return F.when(spiking == 1, "Sedang lonjak").when(prob >= threshold, "Tinggi").when(prob >= 0.5 * threshold, "Waspada").otherwise("Rendah")


def weighted(df: DataFrame, rate: float, seed: int = 7) -> DataFrame:
    """All positives and a share of the negatives, these weighing 1 / rate; the draw is a hash of the row's key."""
    draw = F.pmod(F.xxhash64(F.lit(seed), *SERIES, "date"), F.lit(1_000_000)) / 1_000_000
    return df.where((F.col("y") == 1) | (draw < rate)).select("*", F.when(F.col("y") == 1, 1.0).otherwise(1.0 / rate).alias("weight"))


def fit_logistic(rows: DataFrame, features: list[str], rate: float = 0.5, c: float = 0.5, seed: int = 7) -> PipelineModel:
    """Logistic regression on numbers: infinities are missing, medians fill in, all standardised; L2 by 1 / (c * weights).

    MLlib divides the loss by the sum of weights, so the penalty is divided by it too.
    """
    train = weighted(finite(rows, features), rate, seed)
    total = train.agg(F.sum("weight")).first()[0]
    names = [f"{f}_i" for f in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=names), VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(withMean=True, inputCol="raw", outputCol="features"), LogisticRegression(labelCol="y", weightCol="weight", regParam=1 / (c * total), maxIter=100)]
    return Pipeline(stages=stages).fit(train)


def finite(rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with features as doubles, infinite ones null."""
    cols = {f: F.when(F.abs(F.col(f).cast("double")) < float("inf"), F.col(f).cast("double")) for f in features}
    return rows.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in rows.columns])


def fit_boosted(rows: DataFrame, features: list[str], val: DataFrame | None = None, trees: int = 300, rate: float = 0.5, seed: int = 7, patience: int = 100, depth: int = 5, step: float = 0.1) -> PipelineModel:
    """Boosted trees on numbers and identity codes, these as categories.

    With ``val`` the ensemble is cut at the round that early stopping on the average precision of ``val`` keeps: the first that no
    later one surpasses within ``patience`` rounds (:func:`round_precision`); rows of one class in ``val`` leave all rounds.
    Rounds may be hundreds: where a folder is set for it, MLlib cuts the lineage of its errors every 10 rounds.
    """
    codes = [f for f in features if f in IDENTITY]
    numbers = [f for f in features if f not in IDENTITY]
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    train = weighted(finite(rows, numbers), rate, seed)
    names = [f"{f}_i" for f in numbers]
    gbt = GBTClassifier(labelCol="y", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=step, minInstancesPerNode=20, subsamplingRate=0.8, seed=seed, maxBins=64)
    assemble = VectorAssembler(inputCols=[*names, *codes], outputCol="raw", handleInvalid="keep")
    index = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=40, handleInvalid="keep")
    model = Pipeline(stages=[Imputer(strategy="median", inputCols=numbers, outputCols=names), assemble, index if codes else index.setMaxCategories(2), gbt]).fit(train)
    if val is None:
        return model
    best = best_round(round_precision(model, val), patience)
    return PipelineModel([*model.stages[:-1], first_trees(model.stages[-1], best or len(model.stages[-1].treeWeights))])


def round_precision(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(round, ap): average precision on ``rows`` after each round of boosting, all rounds in one pass over the rows."""
    numbers = model.stages[0].getInputCols()
    staged = staged_scores(model, finite(rows, numbers), ["y"]).select("y", F.posexplode("staged").alias("k", "score"))
    return metrics.average_precision_of_many(staged.select((F.col("k") + 1).alias("round"), "y", "score"), ["round"])


def best_round(precision: DataFrame, patience: int = 100) -> int | None:
    """The round that early stopping keeps; rounds are few, so this reads one number of each.  None where there are no numbers."""
    best, at = -1.0, None
    for r in precision.where("ap is not null").orderBy("round").collect():
        if at is not None and r["round"] - at > patience:
            break
        if r.ap > best:
            best, at = r.ap, r["round"]
    return at


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with score, the probability of a spike; missing numbers are filled as in training."""
    numbers = model.stages[0].getInputCols()
    return model.transform(finite(df, numbers)).select(*df.columns, vector_to_array("probability")[1].alias("score"))


def walk_forward(data: DataFrame, folds: DataFrame, given: dict[str, Column], trained: dict[str, Callable[[DataFrame, DataFrame], Callable[[DataFrame], DataFrame]]] | None = None, metric: str = "f1", precision_target: float = 0.5) -> DataFrame:
    """(keys, date, y, fold, score_m, thr_m) of every test row: out-of-sample scores, thresholds from validation rows.

    ``given`` scores are columns; a ``trained`` model is made of each fold's fitting and validation rows, and adds
    score to rows.  Folds without test rows or without a positive to fit on are left out.  Folds are few (one a quarter), and
    training goes from one to the next; all else is one pass over all folds.  A fold whose validation rows
    are missing has an infinite threshold.
    """
    roles = fold_roles(data, folds)
    usable = roles.groupBy("fold").agg(F.sum(F.when(F.col("role") == "fit", F.col("y"))).alias("pos"), F.max((F.col("role") == "test").cast("int")).alias("tested")).where("pos > 0 and tested = 1").select("fold")
    used = folds.join(F.broadcast(usable), "fold").orderBy("fold")
    keys = [*SERIES, "date"]
    x = fold_roles(data, used).where("role <> 'fit'").select(*keys, "y", "fold", "role", *[c.alias(f"score_{m}") for m, c in given.items()])
    spark = data.sparkSession
    for m, train in (trained or {}).items():
        path = scratch(spark, "scores")
        for f in used.collect():
            fit = data.where(F.col("date") <= f.fit_end)
            val, test = (data.where(F.col("date").between(a, b)) for a, b in ((f.val_start, f.val_end), (f.test_start, f.test_end)))
            predict = train(fit, val)
            predict(val.unionByName(test)).select(*keys, F.lit(f.fold).alias("fold"), F.col("score").alias(f"score_{m}")).write.mode("append").parquet(path)
        x = x.join(spark.read.parquet(path), [*keys, "fold"], "left")
    for m in [*given, *(trained or {})]:
        thr = metrics.best_threshold(x.where("role = 'val'"), ["fold"], metric, precision_target, score=f"score_{m}")
        x = x.join(F.broadcast(thr.select("fold", F.col("threshold").alias(f"thr_{m}"))), "fold", "left").fillna(float("inf"), [f"thr_{m}"])  # a row for each fold
    return x.where("role = 'test'").drop("role")


def final_model(data: DataFrame, features: list[str], val_days: int = 120, trees: int = 300) -> tuple[PipelineModel, float]:
    """(model, threshold): rounds and threshold from the last ``val_days``, then a tenth more rounds on all rows."""
    last = data.agg(F.max("date")).first()[0]
    late = F.col("date") > F.date_sub(F.lit(last), val_days)
    val = data.where(late)
    first = fit_boosted(data.where(~late), features, val, trees)
    thr = metrics.best_threshold(scored(first, val).withColumn("all", F.lit(1)), ["all"]).first()
    rounds = max(int(first.stages[-1].getNumTrees * 1.1), 20)
    return fit_boosted(data, features, None, rounds), float(thr.threshold) if thr else float("inf")


def save_model(model: PipelineModel, threshold: float, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(threshold,)], "threshold double").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, float]:
    return PipelineModel.load(f"{path}/model"), spark.read.schema("threshold double").json(f"{path}/meta").first().threshold


def predict_latest(model: PipelineModel, threshold: float, features: DataFrame, names: dict[str, DataFrame] | None = None, k: int = 3) -> DataFrame:
    """(keys, date, prob, spike_now, r14_now, ret_7, level, reasons, reasons_json and names) of the newest rows.

    Reasons are the ``k`` largest contributions of :func:`top_reasons`, an empty list where nothing raises the risk.  ``names`` maps a key column to a
    table of it and its attributes, dimensions that are joined where they have the key.
    """
    last = features.agg(F.max("date").alias("date"))
    now = materialize(features.join(F.broadcast(last), "date"))
    order = inputs(model)
    why = top_reasons(contributions(model, now, order), k, texts.names_of(features.sparkSession, order))
    risks = scored(model, now).select(*SERIES, "date", F.col("score").alias("prob"), "spike_now", "r14_now", "ret_7", risk_level(F.col("score"), F.coalesce("spike_now", F.lit(0)), threshold).alias("level"))
    out = risks.join(why, [*SERIES, "date"], "left").fillna("[]", ["reasons_json"]).fillna("", ["reasons"])
    for key, dim in (names or {}).items():
        out = out.join(dim, key, "left")
    return out


def importance_by_group(shares: DataFrame) -> DataFrame:
    """(group, mean_abs, share) of (feature, mean_abs); shares are null where nothing contributes."""
    name = F.when(F.lit(False), "")
    for g, p in GROUPS.items():
        name = name.when(F.col("feature").rlike(p), g)
    m = shares.groupBy(name.otherwise("other").alias("group")).agg(F.sum("mean_abs").alias("mean_abs"))
    return m.select("*", F.try_divide("mean_abs", F.sum("mean_abs").over(Window.partitionBy(F.lit(1)))).alias("share"))


def contributions(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """(series, date, feature, value, shap): exact contributions to the log odds of each of ``features``.

    Of a linear model they are coefficient times distance from the mean, of boosted trees path-dependent Shapley values
    (:func:`trees.tree_contributions`); the model's other features are left out.  Values are those before filling.
    """
    last = model.stages[-1]
    df = finite(df, [f for f in features if f not in IDENTITY])
    values = [F.col(f).cast("double") for f in features]
    keep = [*SERIES, "date", *features]
    if isinstance(last, GBTClassificationModel):
        order = inputs(model)
        out, _ = tree_contributions(model, df, keep)
        shap = [F.col("shap")[order.index(f)] for f in features]
    else:
        coef = last.coefficients.toArray()
        out = model.transform(df).select(*keep, vector_to_array("features").alias("z"))
        shap = [F.col("z")[i] * float(coef[i]) for i in range(len(features))]
    items = F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.array(*values).alias("value"), F.array(*shap).alias("shap"))).alias("e")
    return out.select(*SERIES, "date", items).select(*SERIES, "date", "e.*")


def top_reasons(contrib: DataFrame, k: int = 3, names: DataFrame | None = None) -> DataFrame:
    """The k largest positive contributions of each row, one for each family of features, as JSON.

    Identity codes, the weekday, the season's sine and cosine and features without a finite value are no reasons.  With ``names``, the features there are
    (feature), each reason has its sentence, and ``reasons`` has the row's sentences in order, with bars between.
    """
    family = F.regexp_replace("feature", r"_\d+", "")
    best = F.row_number().over(Window.partitionBy(*SERIES, "date", "family").orderBy(F.desc("shap"), "feature"))
    told = ~F.col("feature").isin(*IDENTITY, "dow") & ~F.col("feature").startswith("doy_") & (F.abs("value") < float("inf"))
    c = contrib.where((F.col("shap") > 0) & told).select("*", family.alias("family")).select("*", best.alias("b")).where("b = 1")
    r = F.row_number().over(Window.partitionBy(*SERIES, "date").orderBy(F.desc("shap"), "feature"))
    c = c.select("*", r.alias("rank")).where(F.col("rank") <= k)
    told = ["rank", "feature", F.round("shap", 6).alias("shap"), F.round("value", 6).alias("value")]
    if names is not None:
        c, told = texts.describe(c, names), [*told, "text"]
    out = c.groupBy(*SERIES, "date").agg(F.sort_array(F.collect_list(F.struct(*told))).alias("r"))  # at most k
    said = [] if names is None else [F.array_join(F.col("r.text"), " | ").alias("reasons")]
    return out.select(*SERIES, "date", *said, F.to_json("r").alias("reasons_json"))


def importance(contrib: DataFrame) -> DataFrame:
    """Mean absolute contribution of each feature and its share, null where nothing contributes (a model of rows of one class)."""
    m = contrib.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs"))
    return m.select("*", F.try_divide("mean_abs", F.sum("mean_abs").over(Window.partitionBy(F.lit(1)))).alias("share"))


def sarima_scores(weekly: DataFrame, thresholds: DataFrame | float, fit_end: str, score_start: str, score_end: str, min_weeks: int = 104, k: int = 2) -> DataFrame:
    """(series, date, score): chance that the next or second week's log price is over the threshold above today's.

    ARIMA(1,1,1) with ``k`` pairs of Fourier terms by exact likelihood (:mod:`arima`), fitted on weeks up to ``fit_end`` (``min_weeks``
    known ones at least) and then filtered over all; known weeks in [score_start, score_end] that have two later weeks in
    the panel are scored.  Missing weeks are skipped by the filter, and no score looks at what comes later.
    ``thresholds`` is one number or a table of (series, thr).  One task a series, which is a few hundred weeks.
    """
    names = ["commodity_id", "province_id", "date", "score"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"commodity_id": [], "province_id": [], "date": [], "score": []})
        seen = pdf.loc[pdf["x"].notna()].set_index(pd.to_datetime(pdf.loc[pdf["x"].notna(), "date"]))["x"].sort_index()
        if seen.empty or pd.isna(pdf["thr"].iloc[0]):
            return none
        last = min(pd.to_datetime(pdf["date"]).max(), pd.Timestamp(score_end) + pd.Timedelta(days=21))
        dates = pd.date_range(seen.index[0], last, freq="7D")
        y = seen.reindex(dates).to_numpy(float)
        n_fit = int((dates <= pd.Timestamp(fit_end)).sum())
        if np.isfinite(y[:n_fit]).sum() < min_weeks:
            return none
        t = (dates - pd.Timestamp("2000-01-01")).days.to_numpy() / 365.25
        x = np.column_stack([f(2 * np.pi * i * t) for i in range(1, k + 1) for f in (np.sin, np.cos)])
        model = arima.fit(y[:n_fit], x[:n_fit])
        mean, spread = arima.forecasts(y[:-2], x, model)
        at = np.flatnonzero(np.isfinite(y[:-2]) & (dates[:-2] >= pd.Timestamp(score_start)) & (dates[:-2] <= pd.Timestamp(score_end)))
        far = (math.log1p(pdf["thr"].iloc[0]) - (mean[at] - y[at][:, None])) / np.sqrt(spread[at])
        p = [max(0.5 * math.erfc(z / math.sqrt(2)) for z in row) for row in far]
        return pd.DataFrame({"commodity_id": pdf["commodity_id"].iloc[0], "province_id": pdf["province_id"].iloc[0], "date": dates[at].date, "score": p}, columns=names)

    w = weekly.select(*SERIES, "date", "x")
    w = w.join(thresholds.select(*SERIES, F.col("thr").cast("double")), SERIES, "left") if isinstance(thresholds, DataFrame) else w.select("*", F.lit(float(thresholds)).alias("thr"))
    return w.groupBy(*SERIES).applyInPandas(fit, "commodity_id string, province_id int, date date, score double")


def weekly_comparison(pred: DataFrame, weekly: DataFrame, labels: DataFrame, folds: DataFrame, name: str = "sarima", metric: str = "f1") -> DataFrame:
    """``pred`` (keys, y, fold, score_m, thr_m) on the rows that a weekly model scores too, with its score_``name`` and thr_``name``.

    ``weekly`` is (series, date, fold, score) at weekly origins, of validation and test days; a score belongs to the label of its own day, which the
    inner joins find.  Thresholds come from each fold's validation days.  So all models are compared on the same rows.
    """
    keys = [*SERIES, "date"]
    days = fold_roles(labels.select(*keys, "y"), folds).where("role <> 'fit'")
    rows = days.join(weekly.select(*keys, "fold", F.col("score").alias(f"score_{name}")), [*keys, "fold"])
    thr = metrics.best_threshold(rows.where("role = 'val'"), ["fold"], metric, score=f"score_{name}")
    test = rows.where("role = 'test'").select(*keys, "fold", f"score_{name}")
    test = test.join(F.broadcast(thr.select("fold", F.col("threshold").alias(f"thr_{name}"))), "fold", "left").fillna(float("inf"), [f"thr_{name}"])  # a row for each fold
    return pred.join(test, [*keys, "fold"])
