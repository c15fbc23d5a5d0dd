"""Panel inputs made of the TPC-H-like tables, and literal dimension tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

# Official dates of moving holidays (start of Ramadan, Eid al-Fitr, Eid al-Adha) by year.
MOVING_HOLIDAYS = {
    2017: ("2017-05-27", "2017-06-25", "2017-09-01"),
    2018: ("2018-05-17", "2018-06-15", "2018-08-22"),
    2019: ("2019-05-06", "2019-06-05", "2019-08-11"),
    2020: ("2020-04-24", "2020-05-24", "2020-07-31"),
    2021: ("2021-04-13", "2021-05-13", "2021-07-20"),
    2022: ("2022-04-03", "2022-05-02", "2022-07-10"),
    2023: ("2023-03-23", "2023-04-22", "2023-06-29"),
    2024: ("2024-03-12", "2024-04-10", "2024-06-17"),
    2025: ("2025-03-01", "2025-03-31", "2025-06-06"),
    2026: ("2026-02-19", "2026-03-21", "2026-05-27"),
}
# Provinces (id, name, latitude, longitude of the capital, island group).
PROVINCES = [
    (1, "Aceh", 5.5483, 95.3238, "Sumatera"), (2, "Sumatera Utara", 3.5952, 98.6722, "Sumatera"), (3, "Sumatera Barat", -0.9471, 100.4172, "Sumatera"),
    (4, "Riau", 0.5071, 101.4478, "Sumatera"), (5, "Kepulauan Riau", 0.9186, 104.4665, "Sumatera"), (6, "Jambi", -1.6101, 103.6131, "Sumatera"),
    (7, "Bengkulu", -3.7928, 102.2608, "Sumatera"), (8, "Sumatera Selatan", -2.9761, 104.7754, "Sumatera"), (9, "Kepulauan Bangka Belitung", -2.1316, 106.1169, "Sumatera"),
    (10, "Lampung", -5.3971, 105.2668, "Sumatera"), (11, "Banten", -6.1104, 106.164, "Jawa"), (12, "Jawa Barat", -6.9175, 107.6191, "Jawa"),
    (13, "DKI Jakarta", -6.2088, 106.8456, "Jawa"), (14, "Jawa Tengah", -6.9667, 110.4167, "Jawa"), (15, "DI Yogyakarta", -7.7956, 110.3695, "Jawa"),
    (16, "Jawa Timur", -7.2575, 112.7521, "Jawa"), (17, "Bali", -8.6705, 115.2126, "Bali-Nusa Tenggara"), (18, "Nusa Tenggara Barat", -8.5833, 116.1167, "Bali-Nusa Tenggara"),
    (19, "Nusa Tenggara Timur", -10.1772, 123.607, "Bali-Nusa Tenggara"), (20, "Kalimantan Barat", -0.0263, 109.3425, "Kalimantan"), (21, "Kalimantan Selatan", -3.3186, 114.5944, "Kalimantan"),
    (22, "Kalimantan Tengah", -2.2161, 113.9135, "Kalimantan"), (23, "Kalimantan Timur", -0.5022, 117.1536, "Kalimantan"), (24, "Kalimantan Utara", 2.8375, 117.3653, "Kalimantan"),
    (25, "Gorontalo", 0.5435, 123.0568, "Sulawesi"), (26, "Sulawesi Selatan", -5.1477, 119.4327, "Sulawesi"), (27, "Sulawesi Tenggara", -3.9985, 122.513, "Sulawesi"),
    (28, "Sulawesi Tengah", -0.8917, 119.8707, "Sulawesi"), (29, "Sulawesi Utara", 1.4748, 124.8421, "Sulawesi"), (30, "Sulawesi Barat", -2.6748, 118.8885, "Sulawesi"),
    (31, "Maluku", -3.6954, 128.1814, "Maluku"), (32, "Maluku Utara", 0.7893, 127.3842, "Maluku"), (33, "Papua", -2.5337, 140.7181, "Papua"), (34, "Papua Barat", -0.8615, 134.062, "Papua"),
]
MOVING_EVENTS = ("awal_ramadan", "idulfitri", "iduladha")
FIXED_EVENTS = {"natal": "12-25", "tahun_baru": "01-01"}


def provinces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVINCES, schemas.PROVINCES)


def _islamic(year: int, month: int, day: int) -> date:
    """Day of the tabular Islamic calendar: months of 30 and 29 days in turn, 11 leap days in 30 years."""
    return date.fromordinal(227014 + day + (59 * (month - 1) + 1) // 2 + (year - 1) * 354 + (3 + 11 * year) // 30)


def estimated_holidays(year: int) -> tuple[str, str, str] | None:
    """The moving holidays of a year by the tabular calendar, a day or two off at most; None if one doesn't fall in it.

    Of two in one year the later one counts.
    """
    near = round((year - 622) * 33 / 32)
    found = []
    for month, day in ((9, 1), (10, 1), (12, 10)):
        hits = [d for y in range(near - 2, near + 3) if (d := _islamic(y, month, day)).year == year]
        found.append(max(hits).isoformat() if hits else None)
    return tuple(found) if all(found) else None


def holidays(spark: SparkSession, first: int = 2017, last: int = 2026, moving: dict | None = None) -> DataFrame:
    """(date, event, source): fixed holidays of every year, moving ones of the years in the table, else estimated."""
    moving = MOVING_HOLIDAYS if moving is None else moving
    years = range(first, last + 1)
    rows = [(d, e, "resmi") for y in years if y in moving for e, d in zip(MOVING_EVENTS, moving[y])]
    rows += [(d, e, "estimasi-hijri") for y in years if y not in moving for e, d in zip(MOVING_EVENTS, estimated_holidays(y) or ())]
    rows += [(f"{y}-{d}", e, "tetap") for y in years for e, d in FIXED_EVENTS.items()]
    return spark.createDataFrame(rows, "date string, event string, source string").select(F.to_date("date").alias("date"), "event", "source")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as price reports: price type, commodity, province, date, price in cents."""
    line = read(spark, sf_dir, "lineitem")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") + 1).cast("int").alias("province_id"))
    suppliers = read(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "province_id")
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("commodity_id"))
    kind = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 4).when(F.col("l_linestatus") == "F", 2).otherwise(3)
    rows = line.select("l_partkey", "l_suppkey", kind.cast("int").alias("price_type_id"), F.to_date("l_shipdate").alias("date"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return rows.join(parts, "l_partkey").join(suppliers, "l_suppkey").select("price_type_id", "commodity_id", "province_id", "date", "cents")


def observations(spark: SparkSession, sf_dir: str, national: bool = False) -> DataFrame:
    """(price_type_id, commodity_id, province_id, date, price), one row for each key; province 0 is the national mean."""
    keys = ["price_type_id", "commodity_id", "date"]
    # reports are added up once; national means are made of these sums, which no longer grow with the reports
    cells = _sales(spark, sf_dir).groupBy(*keys, "province_id").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"))
    if not national:
        return cells.select("price_type_id", "commodity_id", "province_id", "date", (F.col("cents").cast("double") / F.col("n") / 100).alias("price"))
    price = (F.sum("cents").cast("double") / F.sum("n") / 100).alias("price")
    grouped = cells.groupingSets([[F.col(k) for k in (*keys, "province_id")], [F.col(k) for k in keys]], *keys, "province_id")
    out = grouped.agg(price, F.grouping("province_id").alias("__all"))
    return out.select("price_type_id", "commodity_id", F.when(F.col("__all") == 1, 0).otherwise(F.col("province_id")).cast("int").alias("province_id"), "date", "price")


def rainfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, province_id, precip_mm): order totals by date and region, scaled."""
    nations = read(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") + 1).cast("int").alias("province_id"))
    customers = read(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "province_id")
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return orders.join(customers, "o_custkey").groupBy("date", "province_id").agg((F.sum("cents").cast("double") / 10_000_000).alias("precip_mm"))
