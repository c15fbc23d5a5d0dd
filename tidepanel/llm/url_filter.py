"""Verdicts on URLs: listed rules first, then boosted trees on lexical features.  DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, release, without

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words in a host's name that label its URLs as blocked.
LISTED = ("adult", "ads", "bets", "casino", "pills", "spam")
NAMES = ("url_length", "host_length", "labels", "depth", "path_length", "digit_ratio", "host_digit_ratio", "host_marks", "host_entropy", "path_entropy", "parameters", "query_length")
SUFFIXES = ("top_share", "domain_share", "extension_share")
UNIT = 1 << 20  # gradients are whole numbers of this fraction, so that sums don't depend on their order
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first "://"; empty without one."""
    url = F.coalesce(url, F.lit(""))
    return F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*+", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; empty without "://"."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*+([^?#]*+)", 1)


def _query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*+\?([^#]*+)", 1)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule (verdict, host, path) that fits; null if none does.

    A rule fits its host and what ends with a dot and it, where the path starts with the rule's.  Rules are part of the
    plan, so they are meant for some hundreds.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(s: Column) -> Column:
    """Bits per character: characters are sorted, so equal ones are runs."""
    n = F.length(s).cast("double")
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(s, "")), ""), F.lit(r"(?s)((.)\2*+)"), 1)
    sum_ = F.aggregate(runs, F.lit(0.0), lambda a, r: a + F.length(r) * F.log2(F.length(r).cast("double")))
    return F.when(n > 0, F.log2(n) - sum_ / n).otherwise(0.0)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def suffixes(host: Column, path: Column) -> list[Column]:
    """The host's last label, its last two, and the path's extension."""
    return [F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)]


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    """Numbers of NAMES, in this order, as doubles."""
    url = F.coalesce(url, F.lit(""))
    query = _query_of(url)

    def digits(s: Column) -> Column:
        return F.regexp_count(s, F.lit("[0-9]"))

    columns = [
        F.length(url), F.length(host), F.size(F.split(host, r"\.", -1)), F.regexp_count(path, F.lit("/[^/]")), F.length(path), _ratio(digits(url), F.length(url)), _ratio(digits(host), F.length(host)),
        F.regexp_count(host, F.lit("[^a-z0-9.]")), _entropy(host), _entropy(path), F.regexp_count(query, F.lit("[^&]+")), F.length(query),
    ]
    return [c.cast("double") for c in columns]


@dataclass(frozen=True)
class UrlModel:
    """Boosted trees, all splits of a level alike: per tree its splits (feature, threshold) and 2 ** depth leaves; and how many of the training URLs each suffix has."""

    trees: tuple[tuple[tuple[tuple[int, float], ...], tuple[float, ...]], ...]
    start: float
    total: int
    rates: DataFrame | None

    def margin(self, x: Column) -> Column:
        """Log odds of "block" from an array of features."""
        if not self.trees:
            return F.lit(self.start)
        def numbers(xs: Iterable[float]) -> Column:
            return F.array(*[F.lit(x) for x in xs])

        trees = F.array(*[F.struct(numbers(f + 1 for f, _ in s).alias("f"), numbers(t for _, t in s).alias("t"), numbers(leaf).alias("leaf")) for s, leaf in self.trees])

        def leaf_of(a: Column, t: Column) -> Column:
            bits = F.zip_with(t["f"], t["t"], lambda f, v: (F.element_at(x, f) > v).cast("int"))
            return a + F.element_at(t["leaf"], F.aggregate(bits, F.lit(0), lambda n, b: n * 2 + b) + 1)

        return F.aggregate(trees, F.lit(self.start), leaf_of)


def _described(df: DataFrame, url: str) -> DataFrame:
    """``df`` with host, path (if it lacks them), keys (suffixes) and numbers."""
    df = df.select("*", *[c.alias(n) for n, c in (("host", host_of(F.col(url))), ("path", path_of(F.col(url)))) if n not in df.columns])
    return df.select("*", F.array(*suffixes(F.col("host"), F.col("path"))).alias("keys"), F.array(*lexical(F.col(url), F.col("host"), F.col("path"))).alias("numbers"))


def _joined(df: DataFrame, rates: DataFrame, total: int) -> DataFrame:
    """``df`` with x, all features: numbers, and for each suffix the logarithm of its share of the training URLs.

    Shares know no labels, so a training row's own label can't shine through.  ``rates`` has at most 3 rows for each training row.
    """
    out, rate = df, []
    for k in range(len(SUFFIXES)):
        mine = rates.where(F.col("kind") == k).select(F.col("key").alias(f"key{k}"), F.col("n").alias(f"n{k}"))
        out = out.withColumn(f"key{k}", F.col("keys")[k]).join(F.broadcast(mine), f"key{k}", "left")
        rate.append(F.log((F.coalesce(f"n{k}", F.lit(0)) + 1) / F.lit(float(total + 1))))
    return out.select(*df.columns, F.concat("numbers", F.array(*rate)).alias("x"))


def _best_splits(hist: list, n_nodes: int, n_features: int, smooth: float) -> tuple[int, int] | None:
    """(feature, bin): the split of all nodes together with the largest gain; ties go to the first."""
    table: dict[tuple[int, int, int], tuple[int, int]] = {(r.node, r.feature, r.bin): (r.g, r.h) for r in hist}
    bins = max((k[2] for k in table), default=0) + 1
    whole = [(sum(table.get((n, 0, b), (0, 0))[0] for b in range(bins)), sum(table.get((n, 0, b), (0, 0))[1] for b in range(bins))) for n in range(n_nodes)]
    best, at = 1e-9, None
    for f in range(n_features):
        left = [(0, 0)] * n_nodes
        for b in range(bins - 1):
            left = [(g + table.get((n, f, b), (0, 0))[0], h + table.get((n, f, b), (0, 0))[1]) for n, (g, h) in enumerate(left)]
            gain = sum((g / UNIT) ** 2 / (h / UNIT + smooth) + ((a - g) / UNIT) ** 2 / ((c - h) / UNIT + smooth) - (a / UNIT) ** 2 / (c / UNIT + smooth) for (g, h), (a, c) in zip(left, whole))
            if gain > best + 1e-9:
                best, at = gain, (f, b)
    return at


def train(labelled: DataFrame, url: str = "url", blocked: str = "blocked", trees: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 32, smooth: float = 1.0, max_labelled: int = 20_000) -> UrlModel:
    """Boosted trees on a bounded sample of ``labelled`` (url, blocked; rows with a null label are left out).

    Logistic loss, Newton leaves.  Of more than ``max_labelled`` distinct URLs those with the smallest hashes are
    taken, which is the only bound; a URL with both labels is an example of each.  Each level of a tree is one
    aggregation by node, feature and bin; its sums alone (at most 2 ** depth x features x bins) reach the driver.
    All splits of a level are alike, so a tree is its ``depth`` thresholds.  Without labels of both kinds there are no trees:
    all are allowed if there is no label, else the one label's verdict.
    """
    rows = labelled.where(F.col(blocked).isNotNull()).select(F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.col(blocked).cast("int").alias("y")).distinct()
    rows = materialize(rows.select("*", F.pmod(F.xxhash64("url"), F.lit(1 << 30)).alias("draw")))
    n = rows.count()
    if n > max_labelled:
        near = math.ceil((1 << 30) * min(1.0, max_labelled / n + 8 * math.sqrt(max_labelled) / n))  # holds max_labelled but for one time in 10 ** 14
        chosen = rows.where(F.col("draw") <= near).orderBy("draw", "url", "y").limit(max_labelled)
    else:
        chosen = rows
    sample = materialize(_described(chosen.select("url", "y"), "url"))
    release(rows)
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad")).first()
    if not totals.n or totals.bad in (0, totals.n):
        release(sample)
        return UrlModel((), 1.0 if totals.n and totals.bad else -1.0, totals.n, None)
    start = math.log(totals.bad / (totals.n - totals.bad))
    keys = F.posexplode("keys").alias("kind", "key")
    rates = materialize(sample.select(keys).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).coalesce(1))
    known = materialize(_joined(sample, rates, totals.n).select("y", "x").repartition(4))
    release(sample)
    size = len(NAMES) + len(SUFFIXES)
    ask = F.array(*[F.lit((k + 1) / bins) for k in range(bins - 1)])
    found = known.agg(*[F.percentile_approx(F.col("x")[f], ask, F.lit(10_000)).alias(f"f{f}") for f in range(size)]).first()
    edges = [sorted(set(found[f])) for f in range(size)]

    def level(f: int) -> Column:
        """Number of edges below the feature's value."""
        return F.size(F.filter(F.array(*[F.lit(e) for e in edges[f]]), lambda e: e < F.col("x")[f]))

    state = materialize(known.select("y", F.array(*[level(f) for f in range(size)]).alias("bin"), F.lit(start).alias("margin")))
    release(known)
    grown: list[tuple[tuple[tuple[int, float], ...], tuple[float, ...]]] = []
    for _ in range(trees):
        p = 1 / (1 + F.exp(-F.col("margin")))
        rows = state.select("bin", F.round((p - F.col("y")) * UNIT).cast("long").alias("g"), F.round(p * (1 - p) * UNIT).cast("long").alias("h"))
        splits: list[tuple[int, int]] = []
        node = F.lit(0)
        for _ in range(depth):
            hist = rows.select(node.alias("node"), "g", "h", F.posexplode("bin").alias("feature", "bin")).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            at = _best_splits(hist, 1 << len(splits), size, smooth)
            if at is None:  # nothing to gain from a further level: one that parts nothing
                at = (0, bins)
            splits.append(at)
            node = node * 2 + (F.col("bin")[at[0]] > at[1]).cast("int")
        f, b = splits[-1]
        sums: dict[int, tuple[int, int]] = {}
        for r in hist:  # the last level's sums, by leaf
            if r.feature == f:
                leaf = r.node * 2 + (r.bin > b)
                g, h = sums.get(leaf, (0, 0))
                sums[leaf] = (g + r.g, h + r.h)
        leaves = tuple(-rate * (g / UNIT) / (h / UNIT + smooth) for g, h in (sums.get(k, (0, 0)) for k in range(1 << len(splits))))
        grown.append((tuple((f, edges[f][b] if b < len(edges[f]) else math.inf) for f, b in splits), leaves))
        new = materialize(state.select("y", "bin", (F.col("margin") + F.element_at(F.array(*[F.lit(v) for v in leaves]), node + 1)).alias("margin")))
        release(state)
        state = new
    release(state)
    return UrlModel(tuple(grown), start, totals.n, rates)


def block_odds(df: DataFrame, model: UrlModel, url: str = "url") -> DataFrame:
    """``df`` (url, host, path and more) with margin, the log odds that a URL is to be blocked."""
    if model.rates is None:
        return df.select("*", F.lit(model.start).alias("margin"))
    made = _joined(_described(df, url), model.rates, model.total)
    return made.select(*df.columns, model.margin(F.col("x")).alias("margin"))


def listed_labels(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, listed: tuple[str, ...] = LISTED) -> DataFrame:
    """(url, blocked) of every row: what its rule says; without one, whether a part of its host's name is a listed word.

    Unlisted hosts count as allowed, as is usual where only a list of bad ones is at hand.  Host names are cut at all
    but letters and digits.
    """
    found = pages.select(F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    found = found.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = F.arrays_overlap(F.split("host", "[^a-z0-9]+"), F.array(*[F.lit(w) for w in listed]))
    rule = rule_for(F.col("host"), F.col("path"), rules)["verdict"]
    return found.select("url", F.when(rule.isNotNull(), rule == "block").otherwise(named).alias("blocked"))


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, **options: float) -> DataFrame:
    """``pages`` with host, path, rule and verdict ("allow" or "block"): the longest rule's, else the trees' (:func:`train`).

    Null URLs and those without "://" have an empty host and path; no rule fits them and the trees judge them as an empty URL.  URLs
    of any length are one value.  Repeated rows are judged alike.  Columns of the four names are replaced, others pass through,
    whatever their names.  No pages: no rows; no labels: what no rule fits is allowed.
    """
    model = train(labelled, **options)
    pages = without(pages, "host", "path", "rule", "verdict")
    (row,) = fresh(pages, "row")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias(row), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("__url"))
    rows = rows.select(row, "__url", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    judged = block_odds(rows, model, "__url").select(row, "host", "path", "margin", rule_for(F.col("host"), F.col("path"), rules).alias("found"))
    own = F.when(F.col("margin") > 0, "block").otherwise("allow")
    return judged.select(f"{row}.*", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"))


def op11_url_filter(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page (:func:`filter_urls`), trained on :func:`listed_labels` of the pages."""
    return filter_urls(pages.select("page_id", "url"), listed_labels(pages))
