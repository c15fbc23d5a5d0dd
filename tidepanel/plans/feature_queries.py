"""The assembled feature table and what is told about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Features
from ..functions import texts
from ..operators import calendar, features, labels, panel, weather
from ..operators.panel import SERIES
from ..sources import fixtures as fx
from ..storage import materialize
from .export import data_dictionary
from .panel_queries import CAT_SQL, CATEGORIES, CLEAN, CLIMATE, NEIGHBOURS, NEIGHBOURS_SQL, STUDY, TARGET, YEARS, _z_sql, categories, rounded
from .registry import query
from .sql import CTE, W, with_

SETTINGS = Features(min_date="1996-01-01", centre_provinces=(1, 3))
COMMODITY_CODES = {c: i + 1 for i, (c, _) in enumerate(CATEGORIES)}
CATEGORY_CODES = {"kind": 1, "size": 2}


def feature_table_of(spark: SparkSession, d: str, until: str | None = None) -> DataFrame:
    """All feature groups of the consumer panel; with ``until`` as if the tables ended on that day."""
    obs, rain = fx.observations(spark, d, True), fx.rainfall(spark, d)
    if until:
        obs, rain = obs.where(F.col("date") <= until), rain.where(F.col("date") <= until)
    # tables of days and places are written before several steps read them: orders and line items are read once
    obs, rain = materialize(obs), materialize(rain)
    anomaly = materialize(weather.anomalies(rain, *CLIMATE))
    # panels and labels meet in several groups: each is computed once
    panels = {k: materialize(panel.price_panel(obs, k, CLEAN)) for k in (1, 2, 3, 4)}
    mine = panels[1].where("province_id <> 0")
    marked = materialize(labels.make_labels(mine, TARGET, labels.thresholds(mine, categories(spark), TARGET)))
    near = spark.createDataFrame(NEIGHBOURS, "province_id int, other int")
    leading = categories(spark).select("commodity_id").crossJoin(near).where("commodity_id = 'PROMO' or province_id < other")
    days = obs.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    codes = spark.createDataFrame([(c, COMMODITY_CODES[c], CATEGORY_CODES[k]) for c, k in CATEGORIES], "commodity_id string, commodity_code int, category_code int")
    return features.build_features(marked, panels, near, leading, calendar.calendar_features(days, fx.holidays(spark, *YEARS, STUDY)), anomaly, codes, SETTINGS)


def _ago(x: str, n: int, by: str = "commodity_id, province_id") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {by} ORDER BY date)"


def _since(x: str, n: int, by: str = "commodity_id, province_id") -> str:
    return f"{x} - {_ago(x, n, by)}"


def _frame(f: str, x: str, w: int, least: int) -> str:
    o = f"OVER ({W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {o} >= {least} THEN {f}({x}) {o} END"


OWN = {f"ret_{k}": _since("x", k) for k in (1, 3, 7, 14, 28)} | {"ret_7_prev": f"{_ago('x', 7)} - {_ago('x', 14)}"}
OWN |= {f"vol_{w}": _frame("stddev_samp", "d1", w, max(3, w // 2)) for w in (7, 14, 30)} | {f"z_{w}": _z_sql("x", w, w // 2) for w in (30, 90)}
OWN |= {"dist_max_90": f"x - {_frame('max', 'x', 90, 30)}", "dist_min_90": f"x - {_frame('min', 'x', 90, 30)}", "rel_365": f"x - {_frame('avg', 'x', 365, 180)}"}
OWN |= {"ret_yoy": _since("x", 364), "seas_ret_14_ly": f"{_ago('x', 350)} - {_ago('x', 364)}", "r14_now": "r14", "gap_to_threshold": "thr - r14"}
OWN |= {"days_since_spike": f"least(365, coalesce(i - last_value(CASE WHEN s0 = 1 THEN i END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 365))::DOUBLE", "n_onsets_365": f"(sum(onset) OVER ({W} ROWS BETWEEN 364 PRECEDING AND CURRENT ROW))::DOUBLE"}
OWN |= {f"ret_{k}_{t}": _since(f"x_{t}", k) for t in ("prod", "whole", "modern") for k in (7, 14)}
OWN |= {"margin_cons_prod": "m_prod", "margin_cons_prod_chg14": _since("m_prod", 14), "margin_cons_prod_z90": _z_sql("m_prod", 90, 30), "margin_cons_whole": "m_whole", "margin_cons_whole_chg14": _since("m_whole", 14), "margin_whole_prod": "x_whole - x_prod", "gap_modern": "x_modern - x", "rel_nat": "rel", "rel_nat_chg14": _since("rel", 14)}
OTHER = ["nat_ret_7", "nat_ret_14", "nat_ret_14_prod", "nat_ret_14_whole", "nat_ret_14_modern", "nat_margin_cons_prod", "nat_margin_cons_prod_chg14", "nat_spike_share", "nat_spike_share_chg7", "nbr_ret_7_mean", "nbr_ret_14_mean", "nbr_ret_7_max", "nbr_spike_share", "nbr_rel_price", "lead_ret_7_mean", "lead_ret_14_mean", "lead_spike_share"]
RAIN = [f"rain_{w}_anom" for w in (7, 30, 90)]
LAGS = [f"rain_30_anom_lag{k}" for k in (30, 60)]
DAYS = [f"days_to_{e}" for e in calendar.EVENTS] + [f"days_since_{e}" for e in calendar.EVENTS[:3]] + ["is_ramadan", "is_nataru", "doy_sin", "doy_cos", "dow"]
CTE["fbase"] = """SELECT *, x - lag(x) OVER (PARTITION BY commodity_id, province_id ORDER BY date) AS d1, x - x_prod AS m_prod, x - x_whole AS m_whole, x - nx AS rel FROM (SELECT l.*, ln(l.price) AS x, ln(b.price) AS x_modern, ln(c.price) AS x_whole, ln(e.price) AS x_prod, ln(n.price) AS nx
    FROM numberedn l LEFT JOIN paneln2 b USING (commodity_id, province_id, date) LEFT JOIN paneln3 c USING (commodity_id, province_id, date) LEFT JOIN paneln4 e USING (commodity_id, province_id, date) LEFT JOIN (SELECT * FROM paneln1 WHERE province_id = 0) n USING (commodity_id, date))"""
CTE["fown"] = f"SELECT * EXCLUDE (i, n), {', '.join(f'{q} AS {n}' for n, q in OWN.items())} FROM fbase"
CTE["fnat"] = f"""SELECT commodity_id, date, {_since('nx', 7, 'commodity_id')} AS nat_ret_7, {_since('nx', 14, 'commodity_id')} AS nat_ret_14, {', '.join(f"{_since(f'nx_{t}', 14, 'commodity_id')} AS nat_ret_14_{t}" for t in ('prod', 'whole', 'modern'))},
    nx - nx_prod AS nat_margin_cons_prod, {_since('(nx - nx_prod)', 14, 'commodity_id')} AS nat_margin_cons_prod_chg14 FROM (SELECT a.commodity_id, a.date, ln(a.price) AS nx, ln(b.price) AS nx_modern, ln(c.price) AS nx_whole, ln(e.price) AS nx_prod
    FROM paneln1 a LEFT JOIN paneln2 b USING (commodity_id, province_id, date) LEFT JOIN paneln3 c USING (commodity_id, province_id, date) LEFT JOIN paneln4 e USING (commodity_id, province_id, date) WHERE a.province_id = 0)"""
CTE["fshare"] = f"SELECT *, {_since('nat_spike_share', 7, 'commodity_id')} AS nat_spike_share_chg7 FROM (SELECT commodity_id, date, avg(s0) AS nat_spike_share FROM numberedn GROUP BY 1, 2)"
CTE["fmoves"] = f"SELECT commodity_id, province_id, date, s0, x, {_since('x', 7)} AS r7, {_since('x', 14)} AS r14x FROM fbase"
CTE["fnear"] = f"SELECT commodity_id, p AS province_id, date, avg(r7) AS nbr_ret_7_mean, avg(r14x) AS nbr_ret_14_mean, max(r7) AS nbr_ret_7_max, avg(s0) AS nbr_spike_share, avg(x) AS around FROM fmoves JOIN {NEIGHBOURS_SQL} ON province_id = q GROUP BY 1, 2, 3"
CTE["flead"] = f"SELECT commodity_id, p AS province_id, date, avg(r7) AS lead_ret_7_mean, avg(r14x) AS lead_ret_14_mean, avg(s0) AS lead_spike_share FROM fmoves JOIN {NEIGHBOURS_SQL} ON province_id = q AND (commodity_id = 'PROMO' OR p < q) GROUP BY 1, 2, 3"
CTE["fcentre"] = "SELECT date, " + ", ".join(f"avg({c}) AS {c}_centre" for c in RAIN) + " FROM anom WHERE province_id IN (1, 3) GROUP BY 1"


def _digits(name: str) -> int:
    return 4 if name.startswith(("vol_", "z_")) or name.endswith("_z90") else 5 if name.startswith("rain_") else 6


FEATURE_SQL = with_("SELECT commodity_id, o.province_id, o.date, " + ", ".join(f"round({n}, {_digits(n)}) + 0 AS {n}" for n in [*OWN, *[n for n in OTHER if n != "nbr_rel_price"]]) + ", round(o.x - around, 6) + 0 AS nbr_rel_price, " + ", ".join(DAYS) + ", "
    + ", ".join(f"round(a0.{c}, 5) + 0 AS {c}, round(c0.{c}_centre, 5) + 0 AS {c}_centre" for c in RAIN) + ", " + ", ".join(f"round(a{k}.rain_30_anom, 5) + 0 AS rain_30_anom_lag{k}, round(c{k}.rain_30_anom_centre, 5) + 0 AS rain_30_anom_lag{k}_centre" for k in (30, 60))
    + ", CASE commodity_id " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in COMMODITY_CODES.items()) + f" END AS commodity_code, CASE {CAT_SQL} WHEN 'kind' THEN 1 ELSE 2 END AS category_code, o.province_id AS province_code, y, eligible::INT AS eligible, spike AS spike_now, onset AS onset_now"
    + " FROM fown o LEFT JOIN fnat USING (commodity_id, date) LEFT JOIN fshare USING (commodity_id, date) LEFT JOIN fnear USING (commodity_id, province_id, date) LEFT JOIN flead USING (commodity_id, province_id, date) LEFT JOIN cal ON cal.date = o.date"
    + " ".join(f" LEFT JOIN anom a{k} ON a{k}.province_id = o.province_id AND a{k}.date = o.date - {k} LEFT JOIN fcentre c{k} ON c{k}.date = o.date - {k}" for k in (0, 30, 60))
    + " WHERE price IS NOT NULL AND isodow(o.date) <= 5 AND o.date >= DATE '1996-01-01'")


def shown(table: DataFrame) -> DataFrame:
    """Rounded for comparison, without negative zeros."""
    plain = {*SERIES, "date", *features.IDENTITY, *features.LABELS, *[c for c in DAYS if not c.startswith("doy_")]}
    return table.select(*[F.col(c) if c in plain else (F.round(c, _digits(c)) + F.lit(0.0)).alias(c) for c in table.columns])


@query("feature_table", FEATURE_SQL)
def feature_table(spark, d):
    return shown(feature_table_of(spark, d))


_ALL = list(OWN) + OTHER + DAYS + [n for c in RAIN + LAGS for n in (c, f"{c}_centre")] + features.IDENTITY


def _values(rules) -> str:
    def shown(x) -> str:
        return f"'{x}'::DOUBLE" if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''").replace("$", "\\") + "'" if not x.startswith("^") else f"'{x}'"

    return "(VALUES " + ", ".join("(" + ", ".join(shown(x) for x in r) + ")" for r in rules) + ")"


_NAMES = "(VALUES " + ", ".join(f"('{c}', '{features.group_of(c)}')" for c in _ALL) + ") AS names(feature, \"group\")"
DICTIONARY_SQL = f"""WITH ft AS MATERIALIZED ({FEATURE_SQL}), shares AS (UNPIVOT (SELECT {', '.join(f'avg(({c} IS NULL)::INT) AS {c}' for c in _ALL)} FROM ft) ON {', '.join(_ALL)} INTO NAME feature VALUE s),
    rules AS (SELECT * FROM {_values((i, *r) for i, r in enumerate(texts.DESCRIPTIONS))} AS t(rank, pattern, body))
    SELECT feature, "group", round(s, 8) AS null_share, (SELECT regexp_replace(n.feature, pattern, body) FROM rules WHERE regexp_matches(n.feature, pattern) ORDER BY rank LIMIT 1) AS description FROM (SELECT * FROM {_NAMES}) n JOIN shares USING (feature)"""


@query("feature_dictionary", DICTIONARY_SQL)
def feature_dictionary(spark, d):
    """Every feature with its group, its description and the share of rows that lack it."""
    table = feature_table_of(spark, d)
    names = features.feature_columns(table.columns)
    out = data_dictionary(table.select(*names)).withColumnRenamed("column", "feature")
    groups = spark.createDataFrame([(c, features.group_of(c)) for c in names], "feature string, group string")
    told = texts.descriptions(texts.names_of(spark, names))
    return out.join(F.broadcast(groups), "feature").join(F.broadcast(told), "feature").select("feature", "group", F.round("null_share", 8).alias("null_share"), "description")


def _number_sql(kind: str) -> str:
    of, digits, signed = texts.NUMBERS[kind]
    return f"replace(format('{{:{'+' if signed else ''}.{digits}f}}', round_even(({of.replace('expm1(value)', '(exp(value) - 1)')}) * 1e{digits}, 0) / 1e{digits}), '.', ',')"


_SAID = "replace(t, '{{{0}}}', {1})"
TEXT_SQL = rf"""WITH ft AS MATERIALIZED ({FEATURE_SQL}), facts AS (FROM (SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in _ALL)} FROM ft) UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(_ALL)}))),
    rules AS (SELECT * FROM {_values((i, *r) for i, r in enumerate(texts.SENTENCES))} AS t(rank, pattern, least, below, body)),
    met AS (SELECT feature, least, below, regexp_replace(feature, pattern, body) AS t FROM {_NAMES} JOIN rules ON regexp_matches(feature, pattern)),
    filled AS (SELECT feature, least, below, CASE WHEN t LIKE '%{{%+%}}%' THEN regexp_replace(t, '\{{\d+\+\d+\}}', (regexp_extract(t, '\{{(\d+)\+', 1)::INT + regexp_extract(t, '\+(\d+)\}}', 1)::INT)::VARCHAR) ELSE t END AS t FROM met)
    SELECT feature, text, count(*) AS n FROM (SELECT feature, CASE WHEN value IS NULL THEN feature || '{texts.MISSING}' {' '.join(f"WHEN t LIKE '%{{{k}}}%' THEN {_SAID.format(k, _number_sql(k))}" for k in texts.NUMBERS)} ELSE t END AS text
    FROM (SELECT f.feature, f.value, r.t FROM facts f LEFT JOIN filled r ON f.feature = r.feature AND f.value >= r.least AND f.value < r.below)) GROUP BY 1, 2"""


@query("feature_texts", TEXT_SQL)
def feature_texts(spark, d):
    """What is said of every value of every feature, and how often."""
    table = shown(feature_table_of(spark, d))
    names = features.feature_columns(table.columns)
    facts = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names])).alias("f")).select("f.*")
    return texts.describe(facts, texts.names_of(spark, names)).groupBy("feature", "text").agg(F.count(F.lit(1)).alias("n"))
