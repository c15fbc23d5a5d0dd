"""Queries over panels: scans, aggregates, cleaning, windows, labels, features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Cleaning, Target
from ..functions.quantiles import exact_quantiles
from ..operators import calendar, graph, labels, panel, weather
from ..operators.panel import SERIES, guarded, in_order, lag_of, rows
from ..sources import fixtures as fx
from ..sources import grid_json
from ..storage import materialize
from .registry import query
from .sql import CTE, W, with_

CLEAN = Cleaning(blip=math.log(6))
TARGET = Target(threshold=1.0, by_commodity={"PROMO": 0.8}, by_category={"size": 1.2})
CATEGORIES = [("STANDARD", "kind"), ("ECONOMY", "kind"), ("MEDIUM", "kind"), ("PROMO", "kind"), ("LARGE", "size"), ("SMALL", "size")]
CAT_SQL = "CASE WHEN commodity_id IN ('LARGE', 'SMALL') THEN 'size' ELSE 'kind' END"


def r6(c: Column | str, name: str | None = None, n: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) and name is None else c
    return F.round(F.col(c) if isinstance(c, str) else c, n).alias(name) if name else F.round(c, n)


def rounded(df: DataFrame, *names: str, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if c in names else F.col(c) for c in df.columns])


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "commodity_id string, cat_id string")


def clean_panel(spark: SparkSession, d: str) -> DataFrame:
    return panel.price_panel(fx.observations(spark, d), 1, CLEAN)


def labelled(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    p = clean_panel(spark, d) if of is None else of
    return labels.make_labels(p, TARGET, labels.thresholds(p, categories(spark), TARGET))


# --- scans and plain aggregates


@query("long_scan_dedup", with_("""SELECT price_type_id, commodity_id, province_id, date, round(cents / 100.0, 2) AS price FROM
    (SELECT *, row_number() OVER (PARTITION BY price_type_id, commodity_id, province_id, date ORDER BY k DESC) AS rn FROM (
    SELECT (CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 4 WHEN l_linestatus = 'F' THEN 2 ELSE 3 END)::INT AS price_type_id, p_type AS commodity_id, (n_regionkey + 1)::INT AS province_id,
    l_shipdate::DATE AS date, round(l_extendedprice * 100)::BIGINT AS cents, l_orderkey * 10 + l_linenumber AS k
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)) WHERE rn = 1"""))
def long_scan_dedup(spark, d):
    line = fx.read(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 4).when(F.col("l_linestatus") == "F", 2).otherwise(3)
    nations = fx.read(spark, d, "nation").select("n_nationkey", (F.col("n_regionkey") + 1).cast("int").alias("province_id"))
    s = fx.read(spark, d, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "province_id")
    p = fx.read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("commodity_id"))
    r = line.select("l_partkey", "l_suppkey", kind.cast("int").alias("price_type_id"), F.to_date("l_shipdate").alias("date"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")).join(p, "l_partkey").join(s, "l_suppkey")
    keys = ["price_type_id", "commodity_id", "province_id", "date"]
    return grid_json.keep_last(r, keys, "k").select(*keys, F.round(F.col("cents") / 100, 2).alias("price"))


NAMES_SQL = "(VALUES (0, 'Semua Provinsi'), " + ", ".join("({}, '{}')".format(p[0], p[1].replace("'", "''")) for p in fx.PROVINCES if p[0] != 5) + ", (5, 'Dum')) t(province_id, name)"
CELLS_SQL = f"""SELECT price_type_id, commodity_id, name, (CASE WHEN province_id = 0 THEN 0 ELSE 1 END)::INT AS level, date, CASE WHEN day(date) <> 13 THEN nullif(floor(price), 0) END AS price
    FROM obsn JOIN {NAMES_SQL} USING (province_id)"""


def grids(spark, d) -> DataFrame:
    """The observations as monthly grid documents, with gaps on the 13th and a place that no province has in place of the fifth."""
    names = fx.provinces(spark).where("province_id <> 5").select("province_id", F.col("province").alias("name"))
    names = names.unionByName(spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("province_id"), F.lit(grid_json.NATIONAL).alias("name")), F.struct(F.lit(5).alias("province_id"), F.lit("Dum").alias("name")))).alias("x")).select("x.*"))
    o = fx.observations(spark, d, True).withColumn("price", F.when(F.dayofmonth("date") != 13, F.col("price")))
    return grid_json.write_grids(o, names)


@query("parse_price_grid", with_(CELLS_SQL))
def parse_price_grid(spark, d):
    return grid_json.parse_grid(grids(spark, d).drop("month"))


@query("unknown_regions", with_(f"SELECT name, count(*) AS n_cells, count(price) AS n_priced FROM ({CELLS_SQL}) WHERE name = 'Dum' GROUP BY 1"))
def unknown_regions(spark, d):
    return grid_json.unknown_regions(parse_price_grid(spark, d), fx.provinces(spark).withColumnRenamed("province", "name"))


@query("month_chunks", with_("""SELECT price_type_id, greatest(m, lo)::DATE AS chunk_start, least(m + INTERVAL 1 MONTH - INTERVAL 1 DAY, hi)::DATE AS chunk_end
    FROM (SELECT price_type_id, lo, hi, unnest(generate_series(date_trunc('month', lo)::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM (SELECT price_type_id, min(date) AS lo, max(date) AS hi FROM obs GROUP BY 1))"""))
def month_chunks(spark, d):
    """The months that each price type's collection is made of."""
    return grid_json.chunks_of(fx.observations(spark, d).groupBy("price_type_id").agg(F.min("date").alias("start"), F.max("date").alias("end")))


@query("collection_report", with_("SELECT price_type_id, count(*) AS n_rows, count(price) AS n_prices, min(date) AS first, max(date) AS last, count(DISTINCT CASE WHEN province_id > 0 THEN province_id END) AS n_provinces, count(DISTINCT commodity_id) AS n_commodities FROM obsn GROUP BY 1"))
def collection_report(spark, d):
    o = fx.observations(spark, d, True)
    return o.groupBy("price_type_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("price").alias("n_prices"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct(F.when(F.col("province_id") > 0, F.col("province_id"))).alias("n_provinces"), F.count_distinct("commodity_id").alias("n_commodities"))


@query("describe_by_category", with_(f"SELECT price_type_id, {CAT_SQL} AS cat_id, count(price) AS n, round(avg(price), 4) AS mean, round(min(price), 4) AS low, round(median(price), 4) AS mid, round(max(price), 4) AS high FROM obs GROUP BY ALL"))
def describe_by_category(spark, d):
    o = fx.observations(spark, d).join(F.broadcast(categories(spark)), "commodity_id")
    keys = ["price_type_id", "cat_id"]
    mid = exact_quantiles(o, keys, "price", (0.5,)).select(*keys, F.col("q")[0].alias("mid"))
    g = o.groupBy(*keys).agg(F.count("price").alias("n"), F.avg("price").alias("mean"), F.min("price").alias("low"), F.max("price").alias("high")).join(mid, keys, "left")
    return rounded(g.select(*keys, "n", "mean", "low", "mid", "high"), "mean", "low", "mid", "high", n=4)


@query("quantiles_by_category", with_(f"SELECT {CAT_SQL} AS cat_id, round(quantile_cont(r14, 0.5), 6) AS p50, round(quantile_cont(r14, 0.9), 6) AS p90, round(quantile_cont(r14, 0.95), 6) AS p95, round(quantile_cont(r14, 0.99), 6) AS p99 FROM rise GROUP BY 1"))
def quantiles_by_category(spark, d):
    q = exact_quantiles(labelled(spark, d).join(F.broadcast(categories(spark)), "commodity_id"), ["cat_id"], "r14", (0.5, 0.9, 0.95, 0.99))
    return q.select("cat_id", *[F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))])


@query("completeness_by_year", with_("SELECT year(date)::INT AS year, round(avg((price IS NOT NULL)::INT), 6) AS share FROM grid GROUP BY 1"))
def completeness_by_year(spark, d):
    g = panel.observation_grid(fx.observations(spark, d), 1)
    return g.groupBy(F.year("date").alias("year")).agg(F.round(F.avg(F.col("price").isNotNull().cast("int")), 6).alias("share"))


@query("quality_report", with_("SELECT price_type_id, commodity_id, province_id, min(date) AS first, max(date) AS last, count(price) AS n, round(median(price), 4) AS mid, round(count(price) / (SELECT count(*) FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS t FROM (SELECT min(date) AS lo, max(date) AS hi FROM obs)) WHERE isodow(t) <= 5), 6) AS coverage FROM obs GROUP BY ALL"))
def quality_report(spark, d):
    o = fx.observations(spark, d)
    span = o.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(calendar.business_days(F.col("lo"), F.col("hi")).alias("bdays"))
    g = o.groupBy("price_type_id", *SERIES).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("price").alias("n"), F.round(F.percentile("price", F.lit(0.5)), 4).alias("mid"))
    return g.crossJoin(F.broadcast(span)).select("price_type_id", *SERIES, "first", "last", "n", "mid", F.round(F.col("n") / F.col("bdays"), 6).alias("coverage"))


@query("national_grouping_sets", with_("SELECT price_type_id, commodity_id, province_id, date, round(price, 4) AS price FROM obsn"))
def national_grouping_sets(spark, d):
    return rounded(fx.observations(spark, d, True), "price", n=4)


COMMODITIES = [c for c, _ in CATEGORIES]
WIDE = [f"{c.lower()}__{p}" for c in COMMODITIES for p in range(1, 6)]


@query("wide_pivot", with_("SELECT date, " + ", ".join(f"round(max(CASE WHEN commodity_id = '{n.split('__')[0].upper()}' AND province_id = {n.split('__')[1]} THEN price END), 4) AS {n}" for n in WIDE) + " FROM obs WHERE price_type_id = 1 GROUP BY date"))
def wide_pivot(spark, d):
    """The wide panel that lies on disk: a column for each commodity and province."""
    o = fx.observations(spark, d).where("price_type_id = 1").select("date", F.concat(F.lower("commodity_id"), F.lit("__"), F.col("province_id").cast("string")).alias("series"), "price")
    return rounded(o.groupBy("date").pivot("series", WIDE).agg(F.avg("price")), *WIDE, n=4)


@query("panel_unpivot", with_("SELECT date, commodity_id, province_id, round(price, 4) AS price FROM obs WHERE price_type_id = 1"))
def panel_unpivot(spark, d):
    w = wide_pivot(spark, d)
    u = w.unpivot("date", [c for c in w.columns if c != "date"], "series", "price").where("price is not null")
    return u.select("date", F.upper(F.split("series", "__")[0]).alias("commodity_id"), F.split("series", "__")[1].cast("int").alias("province_id"), "price")


# --- cleaning


@query("bad_value_flags", with_("SELECT commodity_id, province_id, date, round(price, 4) AS price FROM flagged WHERE bad"))
def bad_value_flags(spark, d):
    return rounded(panel.flag_bad_values(panel.observation_grid(fx.observations(spark, d), 1), CLEAN).where("bad").drop("bad"), "price", n=4).select(*SERIES, "date", "price")


@query("cleaning_log", with_("SELECT commodity_id, province_id, count(price) AS n_obs, sum(bad::INT)::BIGINT AS n_removed FROM flagged GROUP BY 1, 2"))
def cleaning_log(spark, d):
    return panel.cleaning_log(panel.flag_bad_values(panel.observation_grid(fx.observations(spark, d), 1), CLEAN))


@query("smoothed_panel", with_("SELECT commodity_id, province_id, date, round(price, 4) AS price FROM smooth"))
def smoothed_panel(spark, d):
    return rounded(panel.smooth(panel.flag_bad_values(panel.observation_grid(fx.observations(spark, d), 1), CLEAN), CLEAN), "price", n=4)


@query("calendar_ffill", with_("SELECT commodity_id, province_id, date, round(price, 4) AS price FROM panel"))
def calendar_ffill(spark, d):
    return rounded(clean_panel(spark, d), "price", n=4)


@query("flat_runs", with_(f"""SELECT commodity_id, province_id, max(c) - 1 AS longest_flat FROM (SELECT commodity_id, province_id, run, count(*) AS c FROM (
    SELECT commodity_id, province_id, sum((p IS DISTINCT FROM price)::INT) OVER ({W}) AS run FROM (SELECT *, lag(price) OVER ({W}) AS p FROM panel WHERE price IS NOT NULL)) GROUP BY ALL) GROUP BY ALL"""))
def flat_runs(spark, d):
    return panel.flat_runs(clean_panel(spark, d))


# --- own-price windows


def logs(spark, d):
    return clean_panel(spark, d).select(*SERIES, "date", F.ln("price").alias("x"))


@query("log_returns", with_(f"SELECT commodity_id, province_id, date, " + ", ".join(f"round(ln(price) - lag(ln(price), {k}) OVER ({W}), 6) AS ret_{k}" for k in (1, 3, 7, 14, 28)) + f", round(lag(ln(price), 7) OVER ({W}) - lag(ln(price), 14) OVER ({W}), 6) AS ret_7_prev FROM panel"))
def log_returns(spark, d):
    return logs(spark, d).select(*SERIES, "date", *[F.round(F.col("x") - lag_of("x", k), 6).alias(f"ret_{k}") for k in (1, 3, 7, 14, 28)], F.round(lag_of("x", 7) - lag_of("x", 14), 6).alias("ret_7_prev"))


@query("volatility", with_("SELECT commodity_id, province_id, date, " + ", ".join(f"CASE WHEN count(d1) OVER ({W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) >= {max(3, w // 2)} THEN round(stddev_samp(d1) OVER ({W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 4) END AS vol_{w}" for w in (7, 14, 30)) + f" FROM (SELECT *, ln(price) - lag(ln(price)) OVER ({W}) AS d1 FROM panel)"))
def volatility(spark, d):
    x = logs(spark, d).select(*SERIES, "date", (F.col("x") - lag_of("x", 1)).alias("d1"))
    return x.select(*SERIES, "date", *[F.round(guarded(F.stddev_samp("d1"), F.col("d1"), max(3, w // 2), rows(1 - w, 0)), 4).alias(f"vol_{w}") for w in (7, 14, 30)])


def _z(x: Column, w: int, least: int) -> Column:
    over = rows(1 - w, 0)
    s = guarded(F.stddev_samp(x), x, max(2, least), over)
    return (x - guarded(F.avg(x), x, least, over)) / F.when(s > 1e-9, s)


def _z_sql(x: str, w: int, least: int) -> str:
    o = f"OVER ({W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {o} >= {least} AND stddev_samp({x}) {o} > 1e-9 THEN round(({x} - avg({x}) {o}) / stddev_samp({x}) {o}, 4) + 0 END"


@query("zscore", with_(f"SELECT commodity_id, province_id, date, {_z_sql('x', 30, 15)} AS z_30, {_z_sql('x', 90, 45)} AS z_90 FROM (SELECT *, ln(price) AS x FROM panel)"))
def zscore(spark, d):
    return logs(spark, d).select(*SERIES, "date", *[(F.round(_z(F.col("x"), w, w // 2), 4) + F.lit(0.0)).alias(f"z_{w}") for w in (30, 90)])


def _frame_sql(f: str, w: int, least: int) -> str:
    o = f"OVER ({W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(x) {o} >= {least} THEN round(x - {f}(x) {o}, 6) END"


@query("range_distance", with_(f"SELECT commodity_id, province_id, date, {_frame_sql('max', 90, 30)} AS dist_max_90, {_frame_sql('min', 90, 30)} AS dist_min_90, {_frame_sql('avg', 365, 180)} AS rel_365 FROM (SELECT *, ln(price) AS x FROM panel)"))
def range_distance(spark, d):
    x = F.col("x")
    return logs(spark, d).select(*SERIES, "date", F.round(x - guarded(F.max("x"), x, 30, rows(-89, 0)), 6).alias("dist_max_90"), F.round(x - guarded(F.min("x"), x, 30, rows(-89, 0)), 6).alias("dist_min_90"), F.round(x - guarded(F.avg("x"), x, 180, rows(-364, 0)), 6).alias("rel_365"))


@query("yoy_seasonal", with_(f"SELECT commodity_id, province_id, date, round(x - lag(x, 364) OVER ({W}), 6) AS ret_yoy, round(lag(x, 350) OVER ({W}) - lag(x, 364) OVER ({W}), 6) AS seas_ret_14_ly FROM (SELECT *, ln(price) AS x FROM panel)"))
def yoy_seasonal(spark, d):
    return logs(spark, d).select(*SERIES, "date", F.round(F.col("x") - lag_of("x", 364), 6).alias("ret_yoy"), F.round(lag_of("x", 350) - lag_of("x", 364), 6).alias("seas_ret_14_ly"))


# --- labels and events


@query("labels", with_("SELECT commodity_id, province_id, date, round(r14, 6) AS r14, spike, onset, y, eligible::INT AS eligible FROM marked"), name="panel_labels")
def panel_labels(spark, d):
    return labelled(spark, d).select(*SERIES, "date", F.round("r14", 6).alias("r14"), "spike", "onset", "y", F.col("eligible").cast("int").alias("eligible"))


EVENTS_SQL = with_("SELECT date, commodity_id, province_id, round(rise_at_onset, 6) AS rise_at_onset, round(peak_rise_30d, 6) AS peak_rise_30d, spike_days, round(price_before, 4) AS price_before, round(price_at_onset, 4) AS price_at_onset FROM events_")


@query("events_table", EVENTS_SQL)
def events_table(spark, d):
    e = labels.events_table(labelled(spark, d), TARGET)
    return rounded(rounded(e, "rise_at_onset", "peak_rise_30d"), "price_before", "price_at_onset", n=4)


@query("spike_state", with_(f"""SELECT commodity_id, province_id, date,
    CASE WHEN s0 = 0 THEN 0 ELSE coalesce(first_value(CASE WHEN s0 = 0 THEN i END IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n + 1) - i END AS run_length,
    least(365, coalesce(i - last_value(CASE WHEN s0 = 1 THEN i END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 365)) AS days_since_spike,
    (sum(onset) OVER ({W} ROWS BETWEEN 364 PRECEDING AND CURRENT ROW))::BIGINT AS n_onsets_365,
    max(onset) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING) AS future_onset, round(max(price) OVER ({W} ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING), 4) AS forward_peak FROM numbered"""))
def spike_state(spark, d):
    x = panel.numbered(labelled(spark, d))
    return x.select(*SERIES, "date", panel.run_length("s0").alias("run_length"), panel.days_since("s0").alias("days_since_spike"), F.sum("onset").over(rows(-364, 0)).alias("n_onsets_365"), panel.future_max("onset", 14).alias("future_onset"), F.round(F.max("price").over(rows(0, 29)), 4).alias("forward_peak"))


@query("threshold_overrides", with_("SELECT DISTINCT commodity_id, province_id, thr::DOUBLE AS thr FROM rise"))
def threshold_overrides(spark, d):
    p = fx.observations(spark, d).where("price_type_id = 1")
    return labels.thresholds(p, categories(spark), TARGET).select(*SERIES, "thr")


SWEEP = (0.6, 0.8, 1.0, 1.5, 2.0)


@query("event_rate_by_threshold", with_(f"""SELECT t AS threshold, sum(onset)::BIGINT AS n_onsets, round(sum(onset) / (count(*) / 365.25), 6) AS per_series_year FROM (
    SELECT *, (s = 1 AND coalesce(max(s) OVER (PARTITION BY t, commodity_id, province_id ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 0) = 0)::INT AS onset FROM (
    SELECT commodity_id, province_id, date, t, coalesce((r14 > t)::INT, 0) AS s FROM rise CROSS JOIN (SELECT unnest([{', '.join(map(str, SWEEP))}]::DOUBLE[]) AS t))) GROUP BY 1"""))
def event_rate_by_threshold(spark, d):
    x = labelled(spark, d).select(*SERIES, "date", "r14", F.explode(F.array(*[F.lit(t) for t in SWEEP])).alias("t"))
    x = x.select(*SERIES, "date", "t", F.coalesce((F.col("r14") > F.col("t")).cast("int"), F.lit(0)).alias("s"))
    prior = F.coalesce(F.max("s").over(rows(-14, -1, ["t", *SERIES])), F.lit(0))
    return x.select("t", ((F.col("s") == 1) & (prior == 0)).cast("int").alias("onset")).groupBy(F.col("t").alias("threshold")).agg(F.sum("onset").alias("n_onsets"), F.round(F.sum("onset") / (F.count(F.lit(1)) / 365.25), 6).alias("per_series_year"))


@query("events_by_month_pivot", with_(f"SELECT {CAT_SQL} AS cat_id, " + ", ".join(f"count(*) FILTER (month(date) = {m}) AS m{m}" for m in range(1, 13)) + " FROM events_ GROUP BY 1"))
def events_by_month_pivot(spark, d):
    e = labels.events_table(labelled(spark, d), TARGET).join(F.broadcast(categories(spark)), "commodity_id")
    p = e.select("cat_id", F.concat(F.lit("m"), F.month("date").cast("string")).alias("m")).groupBy("cat_id").pivot("m", [f"m{m}" for m in range(1, 13)])
    return p.count().na.fill(0)


@query("event_summary", with_(f"SELECT {CAT_SQL} AS cat_id, count(*) AS n, round(median(peak_rise_30d), 6) AS mid_peak, round(median(spike_days), 2) AS mid_days FROM events_ GROUP BY 1"))
def event_summary(spark, d):
    e = materialize(labels.events_table(labelled(spark, d), TARGET).join(F.broadcast(categories(spark)), "commodity_id"))
    peak, days = (exact_quantiles(e, ["cat_id"], c, (0.5,)).select("cat_id", F.col("q")[0].alias(n)) for c, n in (("peak_rise_30d", "mid_peak"), ("spike_days", "mid_days")))
    out = e.groupBy("cat_id").agg(F.count(F.lit(1)).alias("n")).join(peak, "cat_id", "left").join(days, "cat_id", "left")
    return out.select("cat_id", "n", F.round("mid_peak", 6).alias("mid_peak"), F.round("mid_days", 2).alias("mid_days"))


#: Start of Ramadan, Eid al-Fitr and Eid al-Adha around the years of the tables.
STUDY = {
    1995: ("1995-02-01", "1995-03-03", "1995-05-10"), 1996: ("1996-01-22", "1996-02-20", "1996-04-28"), 1997: ("1997-01-10", "1997-02-09", "1997-04-18"), 1998: ("1997-12-31", "1998-01-30", "1998-04-08"),
    1999: ("1998-12-20", "1999-01-19", "1999-03-28"), 2000: ("1999-12-09", "2000-01-08", "2000-03-16"), 2001: ("2000-11-27", "2000-12-27", "2001-03-06"), 2002: ("2001-11-17", "2001-12-16", "2002-02-23"),
}
YEARS = (min(STUDY), max(STUDY))
STUDY_SQL = "(VALUES " + ", ".join(f"(DATE '{v[1]}')" for v in STUDY.values()) + ") h(day)"


@query("event_study", with_(f"""SELECT rel, round(avg(price / base), 6) AS level FROM (SELECT h.day, commodity_id, province_id, (date - h.day)::INT AS rel, price,
    max(CASE WHEN date - h.day = -60 THEN price END) OVER (PARTITION BY h.day, commodity_id, province_id) AS base FROM panel JOIN {STUDY_SQL} ON date BETWEEN h.day - 60 AND h.day + 30) GROUP BY rel"""))
def event_study(spark, d):
    h = fx.holidays(spark, *YEARS, STUDY).where("event = 'idulfitri'").select(F.col("date").alias("day"))
    x = clean_panel(spark, d).join(F.broadcast(h), F.col("date").between(F.date_sub("day", 60), F.date_add("day", 30)))
    x = x.select("day", *SERIES, F.datediff("date", "day").alias("rel"), "price")
    base = F.max(F.when(F.col("rel") == -60, F.col("price"))).over(Window.partitionBy("day", *SERIES))
    return x.select("rel", (F.col("price") / base).alias("v")).groupBy("rel").agg(F.round(F.avg("v"), 6).alias("level"))


# --- features from other series


@query("national_features", with_(f"""SELECT l.commodity_id, l.province_id, l.date, round(n.x - n.x7, 6) AS nat_ret_7, round(n.x - n.x14, 6) AS nat_ret_14, round(ln(l.price) - n.x, 6) AS rel_nat,
    round((ln(l.price) - n.x) - lag(ln(l.price) - n.x, 14) OVER (PARTITION BY l.commodity_id, l.province_id ORDER BY l.date), 6) AS rel_nat_chg14, round(s.share, 6) AS nat_spike_share, round(s.share - s.share7, 6) AS nat_spike_share_chg7
    FROM markedn l LEFT JOIN (SELECT *, ln(price) AS x, lag(ln(price), 7) OVER ({W}) AS x7, lag(ln(price), 14) OVER ({W}) AS x14 FROM paneln1 WHERE province_id = 0) n ON n.commodity_id = l.commodity_id AND n.date = l.date
    JOIN (SELECT *, lag(share, 7) OVER (PARTITION BY commodity_id ORDER BY date) AS share7 FROM (SELECT commodity_id, date, avg(s0) AS share FROM markedn GROUP BY 1, 2)) s ON s.commodity_id = l.commodity_id AND s.date = l.date"""))
def national_features(spark, d):
    from ..operators import features
    p = panel.price_panel(fx.observations(spark, d, True), 1, CLEAN)
    x = labelled(spark, d, p.where("province_id <> 0"))
    out = features.national(x, p.where("province_id = 0"))
    names = ["nat_ret_7", "nat_ret_14", "rel_nat", "rel_nat_chg14", "nat_spike_share", "nat_spike_share_chg7"]
    return rounded(out.select(*SERIES, "date", *names), *names)


@query("supply_chain_features", with_(f"""SELECT commodity_id, province_id, date, round(x4 - lag(x4, 7) OVER ({W}), 6) AS ret_7_prod, round(x4 - lag(x4, 14) OVER ({W}), 6) AS ret_14_prod, round(x3 - lag(x3, 7) OVER ({W}), 6) AS ret_7_whole, round(x3 - lag(x3, 14) OVER ({W}), 6) AS ret_14_whole,
    round(x2 - lag(x2, 7) OVER ({W}), 6) AS ret_7_modern, round(x2 - lag(x2, 14) OVER ({W}), 6) AS ret_14_modern, round(m, 6) AS margin_cons_prod, round(m - lag(m, 14) OVER ({W}), 6) AS margin_cons_prod_chg14, {_z_sql('m', 90, 30)} AS margin_cons_prod_z90,
    round(x - x3, 6) AS margin_cons_whole, round((x - x3) - lag(x - x3, 14) OVER ({W}), 6) AS margin_cons_whole_chg14, round(x3 - x4, 6) AS margin_whole_prod, round(x2 - x, 6) AS gap_modern FROM (
    SELECT a.commodity_id, a.province_id, a.date, ln(a.price) AS x, ln(b.price) AS x2, ln(c.price) AS x3, ln(e.price) AS x4, ln(a.price) - ln(e.price) AS m FROM panelp a
    LEFT JOIN paneln2 b USING (commodity_id, province_id, date) LEFT JOIN paneln3 c USING (commodity_id, province_id, date) LEFT JOIN paneln4 e USING (commodity_id, province_id, date))"""))
def supply_chain_features(spark, d):
    from ..operators import features
    o = fx.observations(spark, d, True)
    panels = {pt: panel.price_panel(o, pt, CLEAN) for pt in (1, 2, 3, 4)}
    out = features.supply_chain(panels[1].where("province_id <> 0"), {t: panels[k] for t, k in (("prod", 4), ("whole", 3), ("modern", 2))})
    names = [c for c in out.columns if c not in (*SERIES, "date")]
    out = rounded(rounded(out, *[n for n in names if not n.endswith("z90")]), "margin_cons_prod_z90", n=4)
    return out.withColumn("margin_cons_prod_z90", F.col("margin_cons_prod_z90") + F.lit(0.0))  # no negative zero


NEIGHBOURS = [(p, q) for p in range(1, 6) for q in ((p % 5) + 1, ((p + 1) % 5) + 1)]
NEIGHBOURS_SQL = "(VALUES " + ", ".join(map(str, NEIGHBOURS)) + ") e(p, q)"


@query("neighbor_features", with_(f"""SELECT a.commodity_id, a.province_id, a.date, round(m7, 6) AS nbr_ret_7_mean, round(m14, 6) AS nbr_ret_14_mean, round(mx7, 6) AS nbr_ret_7_max, round(share, 6) AS nbr_spike_share, round(a.x - mx, 6) AS nbr_rel_price FROM lx a JOIN (
    SELECT commodity_id, p AS province_id, date, avg(r7) AS m7, avg(r14x) AS m14, max(r7) AS mx7, avg(s0) AS share, avg(x) AS mx FROM lx JOIN {NEIGHBOURS_SQL} ON province_id = q GROUP BY 1, 2, 3) b USING (commodity_id, province_id, date)""",
    lx=f"SELECT *, ln(price) AS x, ln(price) - lag(ln(price), 7) OVER ({W}) AS r7, ln(price) - lag(ln(price), 14) OVER ({W}) AS r14x FROM marked"))
def neighbor_features(spark, d):
    from ..operators import features
    e = spark.createDataFrame(NEIGHBOURS, "province_id int, other int")
    out = features.neighbours(labelled(spark, d), e)
    names = [c for c in out.columns if c.startswith("nbr_")]
    return rounded(out.select(*SERIES, "date", *names), *names)


@query("leader_features", with_(f"""SELECT commodity_id, p AS province_id, date, round(avg(r7), 6) AS lead_ret_7_mean, round(avg(r14x), 6) AS lead_ret_14_mean, round(avg(s0), 6) AS lead_spike_share FROM lx JOIN {NEIGHBOURS_SQL} ON province_id = q AND (commodity_id = 'PROMO' OR p < q) GROUP BY 1, 2, 3""",
    lx=f"SELECT *, ln(price) AS x, ln(price) - lag(ln(price), 7) OVER ({W}) AS r7, ln(price) - lag(ln(price), 14) OVER ({W}) AS r14x FROM marked"))
def leader_features(spark, d):
    from ..operators import features
    e = categories(spark).select("commodity_id").crossJoin(spark.createDataFrame(NEIGHBOURS, "province_id int, other int")).where("commodity_id = 'PROMO' or province_id < other")
    out = features.leaders(labelled(spark, d), e)
    names = [c for c in out.columns if c.startswith("lead_")]
    return rounded(out.select(*SERIES, "date", *names), *names)


def _capped_sql(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN least(120, {x}) END)"


HOLIDAYS_SQL = "(VALUES " + ", ".join([f"(DATE '{x}', '{e}')" for v in STUDY.values() for e, x in zip(fx.MOVING_EVENTS, v)] + [f"(DATE '{y}-{x}', '{e}')" for y in range(YEARS[0], YEARS[1] + 1) for e, x in fx.FIXED_EVENTS.items()]) + ") h(day, event)"


CTE["cal"] = ("SELECT * EXCLUDE (date), date, coalesce(days_since_awal_ramadan < 30 AND days_to_idulfitri <= 30 AND days_to_idulfitri > 0, false)::INT AS is_ramadan, ((month(date) = 12 AND day(date) >= 15) OR (month(date) = 1 AND day(date) <= 7))::INT AS is_nataru, round(sin(2 * pi() * dayofyear(date) / 365.25), 6) AS doy_sin, round(cos(2 * pi() * dayofyear(date) / 365.25), 6) AS doy_cos, (isodow(date) - 1)::INT AS dow FROM (SELECT date, "
    + ", ".join(_capped_sql(f"min(CASE WHEN event = '{e}' AND day >= date THEN day - date END)") + f"::INT AS days_to_{e}" for e in calendar.EVENTS) + ", " + ", ".join(_capped_sql(f"min(CASE WHEN event = '{e}' AND day <= date THEN date - day END)") + f"::INT AS days_since_{e}" for e in calendar.EVENTS[:3]) + f" FROM days CROSS JOIN {HOLIDAYS_SQL} GROUP BY date)")


@query("calendar_features", with_("SELECT * FROM cal"))
def calendar_features(spark, d):
    o = fx.observations(spark, d).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = o.select(F.explode(F.sequence("a", "b")).alias("date"))
    return rounded(calendar.calendar_features(days, fx.holidays(spark, *YEARS, STUDY)), "doy_sin", "doy_cos")


@query("fourier_terms", with_("SELECT date, " + ", ".join(f"round({f}(2 * pi() * {i} * (date - DATE '2000-01-01') / 365.25), 6) AS {f}{i}" for i in (1, 2) for f in ("sin", "cos")) + " FROM days"))
def fourier_terms(spark, d):
    o = fx.observations(spark, d).agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    return rounded(o.select("date", *calendar.fourier_terms(F.col("date"))), "sin1", "cos1", "sin2", "cos2")


CTE["raind"] = """SELECT g.province_id, g.date, last_value(precip_mm IGNORE NULLS) OVER (PARTITION BY g.province_id ORDER BY g.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS mm FROM (SELECT p.province_id, t.date FROM (SELECT DISTINCT province_id FROM rain) p
    CROSS JOIN (SELECT unnest(generate_series((SELECT min(date) FROM rain), (SELECT max(date) FROM rain), INTERVAL 1 DAY))::DATE AS date) t) g LEFT JOIN rain r ON r.province_id = g.province_id AND r.date = g.date"""
CTE["rolled"] = "SELECT province_id, date, " + ", ".join(f"CASE WHEN count(mm) OVER (PARTITION BY province_id ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) >= {int(w * 0.8)} THEN sum(mm) OVER (PARTITION BY province_id ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) END AS roll_{w}" for w in (7, 30, 90)) + " FROM raind"
for _w in (7, 30, 90):
    CTE[f"clim{_w}"] = f"""SELECT province_id AS pid, ((((d - 1 + k) % 365) + 365) % 365 + 1)::INT AS doy, avg(x) AS mu, stddev_pop(x) AS sd FROM (SELECT province_id, least(dayofyear(date), 365) AS d, roll_{_w} AS x FROM rolled
        WHERE date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31') CROSS JOIN (SELECT unnest(generate_series(-15, 15)) AS k) GROUP BY 1, 2"""
CTE["anom"] = "SELECT province_id, date, " + ", ".join(f"CASE WHEN roll_{w} IS NOT NULL AND clim{w}.mu IS NOT NULL THEN greatest(-5, least(5, (roll_{w} - clim{w}.mu) / greatest(clim{w}.sd, {float(w)}))) END AS rain_{w}_anom" for w in (7, 30, 90)) + " FROM rolled " + " ".join(f"LEFT JOIN clim{w} ON clim{w}.pid = province_id AND clim{w}.doy = least(dayofyear(date), 365)" for w in (7, 30, 90))
CLIMATE = ("1995-01-01", "1998-12-31")


@query("rain_climatology", with_("SELECT pid AS province_id, doy, round(mu, 5) AS mu, round(sd, 5) AS sd FROM clim30"))
def rain_climatology(spark, d):
    return rounded(weather.climatology(weather.rolling_rain(fx.rainfall(spark, d)), 30, *CLIMATE), "mu", "sd", n=5)


@query("rain_anomaly", with_("SELECT province_id, date, " + ", ".join(f"round(rain_{w}_anom, 5) AS rain_{w}_anom" for w in (7, 30, 90)) + " FROM anom"))
def rain_anomaly(spark, d):
    names = [f"rain_{w}_anom" for w in (7, 30, 90)]
    return rounded(weather.anomalies(fx.rainfall(spark, d), *CLIMATE), *names, n=5)


@query("rain_lagged", with_("SELECT province_id, (date + 30)::DATE AS date, round(rain_30_anom, 5) AS rain_30_anom_lag30 FROM anom"))
def rain_lagged(spark, d):
    return rounded(weather.lagged(weather.anomalies(fx.rainfall(spark, d), *CLIMATE), "rain_30_anom", 30), "rain_30_anom_lag30", n=5)


@query("data_dictionary", with_("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, round(avg(({c} IS NULL)::INT), 8) AS null_share FROM marked" for c, t in (("commodity_id", "string"), ("province_id", "int"), ("date", "date"), ("r14", "double"), ("spike", "int"), ("onset", "int"), ("y", "int"))) + ")"))
def data_dictionary(spark, d):
    from .export import data_dictionary as dictionary
    return rounded(dictionary(panel_labels(spark, d).drop("eligible")), "null_share", n=8)


HISTORY_SQL = with_("""SELECT commodity_id, '{' || string_agg('"' || province_id || '":[' || points || ']', ',' ORDER BY province_id::VARCHAR) || '}' AS doc FROM (SELECT commodity_id, province_id,
    string_agg('{"d":"' || strftime(date, '%Y-%m-%d') || '"' || CASE WHEN price IS NULL THEN '' ELSE ',"p":' || round(price)::BIGINT END || '}', ',' ORDER BY date) AS points FROM panel WHERE date > (SELECT max(date) FROM panel) - 180 GROUP BY 1, 2) GROUP BY 1""")


@query("history_docs", HISTORY_SQL)
def history_docs(spark, d):
    from .export import history_docs as docs
    return docs(clean_panel(spark, d))
