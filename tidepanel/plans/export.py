"""Dashboard documents as JSON strings, one row for each document, and the Parquet, CSV and JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(x):
    """Null for NaN and infinities, which JSON doesn't have."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def history_docs(panel: DataFrame, days: int = 180) -> DataFrame:
    """(commodity_id, doc): the last days' prices by province, as whole numbers, {"province": [[date, price], ...]}."""
    last = panel.agg(F.max("date").alias("last"))
    p = panel.join(F.broadcast(last)).where(F.col("date") > F.date_sub("last", days))
    series = p.groupBy("commodity_id", "province_id").agg(F.sort_array(F.collect_list(F.struct(F.date_format("date", "yyyy-MM-dd").alias("d"), F.round(finite(F.col("price"))).cast("long").alias("p")))).alias("points"))
    return series.groupBy("commodity_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("province_id").cast("string"), "points"))))).alias("doc"))


def network_docs(edges: DataFrame, k: int = 30) -> DataFrame:
    """(commodity_id, doc): the k strongest significant edges of each commodity."""
    strength = F.round(-F.log10(F.greatest("p_value", F.lit(1e-300))), 3).alias("strength")
    e = edges.where("significant").select("commodity_id", F.struct(strength, "source", "target").alias("e"))
    return e.groupBy("commodity_id").agg(F.to_json(F.slice(F.sort_array(F.collect_list("e"), asc=False), 1, k)).alias("doc"))


def risk_docs(risk: DataFrame, last_price: DataFrame) -> DataFrame:
    """(commodity_id, doc): the newest risks of a commodity with its last price, by province.

    ``risk`` is (series, prob, level, r14_now), ``last_price`` (series, price).  Numbers have four decimals, null if not finite.
    """
    def number(c: str):
        return finite(F.col(c)).cast("decimal(18,4)")

    x = risk.join(last_price, ["commodity_id", "province_id"], "left")
    row = F.struct(F.col("province_id").alias("p"), number("prob").alias("prob"), "level", number("r14_now").alias("r14"), F.round(finite(F.col("price"))).cast("long").alias("price"))
    return x.groupBy("commodity_id").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("doc"))


def site_meta(asof: DataFrame, commodities: DataFrame, places: DataFrame, threshold: float, horizon: int = 14) -> DataFrame:
    """One row (doc): the day, the warning window, the alarm threshold, commodities with thresholds and places.

    ``asof`` has one row (date), ``commodities`` (id, cat_id, threshold) and ``places`` (province_id, lat, lon) are dimensions.
    """
    def day(c):
        return F.date_format(c, "yyyy-MM-dd")

    coms = commodities.groupBy().agg(F.sort_array(F.collect_list(F.struct("id", "cat_id", F.col("threshold").cast("decimal(18,4)").alias("threshold")))).alias("commodities"))
    at = places.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("province_id").alias("p"), F.col("lat").cast("decimal(18,4)").alias("lat"), F.col("lon").cast("decimal(18,4)").alias("lon")))).alias("centroids"))
    window = F.struct(day(F.date_add("date", 1)).alias("start"), day(F.date_add("date", horizon)).alias("end"))
    doc = F.struct(day("date").alias("asof"), window.alias("window"), F.lit(horizon).alias("horizon_days"), F.lit(threshold).cast("decimal(18,4)").alias("alarm_threshold"), "commodities", "centroids")
    return asof.crossJoin(coms).crossJoin(at).select(F.to_json(doc).alias("doc"))


def write_tables(tables: dict[str, DataFrame], root: str, kind: str = "parquet") -> None:
    """Each table to ``root``/name, overwriting; small reports as CSV come as one file."""
    for name, df in tables.items():
        if kind == "csv":
            df.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{root}/{name}")
        else:
            df.write.mode("overwrite").format(kind).save(f"{root}/{name}")


def data_dictionary(df: DataFrame) -> DataFrame:
    """(column, type, null_share) of every column, in one pass."""
    shares = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"c{i}").alias("null_share")) for i, (c, t) in enumerate(df.dtypes)])
    return shares.select(F.explode(rows).alias("r")).select("r.*")
