"""Calendar features: as-of joins to holidays, seasons, business days."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENTS = ("awal_ramadan", "idulfitri", "iduladha", "natal", "tahun_baru")


def calendar_features(dates: DataFrame, holidays: DataFrame, cap: int = 120) -> DataFrame:
    """One row for each date: days to and since each event (the day itself is 0 both ways), capped, and season flags.

    Holidays fit one array per event in a single broadcast row, so a date needs no join partner search.
    """
    lists = holidays.groupBy().agg(*[F.sort_array(F.collect_set(F.when(F.col("event") == e, F.col("date")))).alias(e) for e in EVENTS])
    d = dates.select("date").distinct().crossJoin(F.broadcast(lists))

    def to(e: str) -> Column:
        return F.least(F.lit(cap), F.datediff(F.array_min(F.filter(e, lambda h: h >= F.col("date"))), F.col("date")))

    def since(e: str) -> Column:
        return F.least(F.lit(cap), F.datediff(F.col("date"), F.array_max(F.filter(e, lambda h: h <= F.col("date")))))

    def capped(x: Column, known: Column) -> Column:
        return F.when(known.isNotNull(), x)

    cols = [capped(to(e), F.array_min(F.filter(e, lambda h: h >= F.col("date")))).alias(f"days_to_{e}") for e in EVENTS]
    cols += [capped(since(e), F.array_max(F.filter(e, lambda h: h <= F.col("date")))).alias(f"days_since_{e}") for e in EVENTS[:3]]
    d = d.select("date", *cols)
    ramadan = (F.col("days_since_awal_ramadan") < 30) & (F.col("days_to_idulfitri") <= 30) & (F.col("days_to_idulfitri") > 0)
    m, day, turn = F.month("date"), F.day("date"), 2 * math.pi * F.dayofyear("date") / 365.25
    year_end = ((m == 12) & (day >= 15)) | ((m == 1) & (day <= 7))
    return d.select("*", F.coalesce(ramadan, F.lit(False)).cast("int").alias("is_ramadan"), year_end.cast("int").alias("is_nataru"), F.sin(turn).alias("doy_sin"), F.cos(turn).alias("doy_cos"), F.weekday("date").alias("dow"))


def fourier_terms(date: Column, period: float = 365.25, k: int = 2) -> list[Column]:
    t = F.datediff(date, F.to_date(F.lit("2000-01-01")))
    return [f(2 * math.pi * i * t / period).alias(f"{n}{i}") for i in range(1, k + 1) for n, f in (("sin", F.sin), ("cos", F.cos))]


def business_days(start: Column, end: Column) -> Column:
    """Weekdays in [start, end], without a list of the days in between."""
    def upto(d: Column) -> Column:  # weekdays from a Monday up to d
        n = F.datediff(d, F.to_date(F.lit("1900-01-01")))
        return F.floor(n / 7) * 5 + F.least(F.lit(5), n % 7 + 1)

    return (upto(end) - upto(F.date_sub(start, 1))).cast("long")
