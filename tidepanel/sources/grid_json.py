"""Reading price grids: JSON records with one key per date, and the long table made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

META_KEYS = ("no", "name", "level")
NATIONAL = "Semua Provinsi"  # the grid's name of the national row


def parse_price(value: Column) -> Column:
    """Positive number of a price string with thousands commas; anything else is null."""
    p = F.regexp_replace(F.trim(value), ",", "").try_cast("double")
    return F.when((p > 0) & ~F.isnan(p), p)


def parse_grid(records: DataFrame, json_col: str = "data") -> DataFrame:
    """Rows of grid documents: other columns, name, level, date, price.

    ``json_col`` holds an array of objects.  Every key but the fixed ones is a date DD/MM/YYYY; other keys
    are dropped.
    """
    keep = [c for c in records.columns if c != json_col]
    row = F.explode(F.from_json(json_col, "array<map<string,string>>")).alias("row")
    cells = records.select(*keep, row).select(*keep, F.col("row")["name"].alias("name"), F.col("row")["level"].cast("int").alias("level"), F.explode(F.map_filter("row", lambda k, _: ~k.isin(*META_KEYS))).alias("key", "value"))
    return cells.select(*keep, F.trim("name").alias("name"), "level", F.try_to_date("key", "dd/MM/yyyy").alias("date"), parse_price(F.col("value")).alias("price")).where("date is not null")


def read_grid_files(spark: SparkSession, root: str) -> DataFrame:
    """All grid files under ``root`` (pt{n}/{commodity}/{YYYY-MM}.json.gz): price_type_id, commodity_id, file, data."""
    path = F.col("_metadata.file_path")
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json.gz").text(root)
    return files.select(
        F.regexp_extract(path, r"/pt(\d+)/", 1).cast("int").alias("price_type_id"), F.regexp_extract(path, r"/pt\d+/([^/]+)/", 1).alias("commodity_id"), path.alias("file"), F.get_json_object("value", "$.data").alias("data"),
    ).where("data is not null and data <> '[]'")


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in order of ``order``."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.select("*", rn.alias("__rn")).where("__rn = 1").drop("__rn")


def load_long(cells: DataFrame, provinces: DataFrame, commodities: DataFrame, price_types: DataFrame) -> DataFrame:
    """Observations of parsed cells (price_type_id, commodity_id, file, name, date, price).

    Unknown regions are dropped (see :func:`unknown_regions`), one row stays for each key, that of the last file.
    """
    known = provinces.select(F.col("id").alias("province_id"), F.trim("name").alias("name")).unionByName(cells.sparkSession.createDataFrame([(0, NATIONAL)], "province_id int, name string"))
    rows = cells.join(F.broadcast(known), "name")
    rows = keep_last(rows, ["price_type_id", "commodity_id", "province_id", "date"], "file")
    cats = commodities.where(F.col("id").startswith("cat_")).select(F.col("id").alias("cat_id"), F.col("name").alias("category"))
    coms = commodities.where(F.col("id").startswith("com_")).select(F.col("id").alias("commodity_id"), F.col("name").alias("commodity"), "cat_id").join(F.broadcast(cats), "cat_id", "left")
    kinds = price_types.select(F.col("id").alias("price_type_id"), F.col("name").alias("price_type"))
    out = rows.join(F.broadcast(coms), "commodity_id", "left").join(F.broadcast(kinds), "price_type_id", "left")
    name = F.when(F.col("province_id") == 0, "Nasional").otherwise(F.col("name"))
    return out.select("date", "price_type_id", "price_type", "commodity_id", "commodity", "cat_id", "category", "province_id", name.alias("province"), "price")


def unknown_regions(cells: DataFrame, provinces: DataFrame) -> DataFrame:
    """Names in the grids that no province has, with occurrences and priced cells."""
    known = provinces.select(F.trim("name").alias("name"))
    return cells.where(F.col("name") != NATIONAL).join(F.broadcast(known), "name", "left_anti").groupBy("name").agg(F.count(F.lit(1)).alias("n_cells"), F.count("price").alias("n_priced"))


def month_chunks(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Calendar months that cover [start, end], clipped to it: (chunk_start, chunk_end)."""
    return chunks_of(spark.range(1).select(F.to_date(F.lit(start)).alias("start"), F.to_date(F.lit(end)).alias("end"))).select("chunk_start", "chunk_end")


def chunks_of(spans: DataFrame) -> DataFrame:
    """``spans`` (start, end and more) as calendar months: its other columns, chunk_start, chunk_end."""
    keep = [c for c in spans.columns if c not in ("start", "end")]
    m = spans.select("*", F.explode(F.sequence(F.trunc("start", "MM"), "end", F.expr("interval 1 month"))).alias("m"))
    return m.select(*keep, F.greatest("m", "start").alias("chunk_start"), F.least(F.last_day("m"), "end").alias("chunk_end"))


def write_grids(observations: DataFrame, names: DataFrame) -> DataFrame:
    """(price_type_id, commodity_id, month, data): observations as grid documents, a row for each place and a key for each date.

    The reverse of :func:`parse_grid` for whole prices; ``names`` is (province_id, name).  A missing price is written as "-".
    """
    said = F.coalesce(F.format_number(F.floor("price"), 0), F.lit("-"))
    cells = observations.join(F.broadcast(names), "province_id").groupBy("price_type_id", "commodity_id", F.trunc("date", "MM").alias("month"), "name", F.when(F.col("province_id") == 0, "0").otherwise("1").alias("level"))
    days = F.map_from_entries(F.collect_list(F.struct(F.date_format("date", "dd/MM/yyyy"), said)))
    rows = cells.agg(days.alias("days")).select("*", F.map_concat(F.create_map(F.lit("name"), F.concat(F.lit(" "), "name"), F.lit("level"), "level", F.lit("remark"), F.lit("x")), "days").alias("row"))
    return rows.groupBy("price_type_id", "commodity_id", "month").agg(F.to_json(F.collect_list("row")).alias("data"))


def upsert_recent(cached: DataFrame, fresh: DataFrame, keys: list[str], value: str, refresh_days: int = 45) -> DataFrame:
    """Cached rows older than ``refresh_days`` before the last one with a value, and all fresh rows; fresh ones win."""
    last = cached.where(F.col(value).isNotNull()).agg(F.max("date").alias("last"))
    old = cached.join(F.broadcast(last)).where(F.col("last").isNotNull() & (F.col("date") < F.date_sub("last", refresh_days))).drop("last")
    both = old.select("*", F.lit(0).alias("__rank")).unionByName(fresh.select(*cached.columns, F.lit(1).alias("__rank")))
    return keep_last(both, keys, "__rank").drop("__rank")
