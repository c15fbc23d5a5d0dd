"""Rainfall anomalies against a smoothed day-of-year climatology."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .panel import rows, to_calendar

KEY = ["province_id"]


def rolling_rain(rain: DataFrame, windows: tuple[int, ...] = (7, 30, 90), ffill: int = 5) -> DataFrame:
    """(province_id, date, roll_w): sums of the last w days on a daily grid, with 80 % of the days known."""
    r = rain.where("precip_mm is not null").groupBy("province_id", "date").agg(F.avg("precip_mm").alias("precip_mm"))
    daily = to_calendar(r, r.agg(F.min("date").alias("first"), F.max("date").alias("last")), ffill, KEY, "precip_mm")
    sums = [F.when(F.count("precip_mm").over(rows(1 - w, 0, KEY)) >= int(w * 0.8), F.sum("precip_mm").over(rows(1 - w, 0, KEY))).alias(f"roll_{w}") for w in windows]
    return daily.select("province_id", "date", *sums)


def day_of_year(date) -> F.Column:
    return F.least(F.dayofyear(date), F.lit(365))


def climatology(rolled: DataFrame, window: int, first: str, last: str, half: int = 15) -> DataFrame:
    """(province_id, doy, mu, sd) over days within ``half`` of doy, around the year's end too; sd is the population's.

    Each day is sent to the 2 * half + 1 days of the year that it counts for, so the join by distance is an
    equi-aggregation.
    """
    base = rolled.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    doy = F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("k")
    spread = base.select("province_id", day_of_year("date").alias("d"), F.col(f"roll_{window}").alias("x"), doy)
    return spread.select("province_id", (F.pmod(F.col("d") - 1 + F.col("k"), F.lit(365)) + 1).alias("doy"), "x").groupBy("province_id", "doy").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))


def anomalies(rain: DataFrame, first: str, last: str, windows: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """(province_id, date, rain_w_anom): z-scores, spread floored at 1 mm a day, clipped to 5."""
    rolled = rolling_rain(rain, windows)
    usual = [climatology(rolled, w, first, last).select("province_id", "doy", F.col("mu").alias(f"mu_{w}"), F.col("sd").alias(f"sd_{w}")) for w in windows]
    usual = reduce(lambda a, b: a.join(b, ["province_id", "doy"], "full"), usual)  # grows with the places: Spark decides whether to broadcast it
    out = rolled.select("*", day_of_year("date").alias("doy")).join(usual, ["province_id", "doy"], "left")
    z = [F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (F.col(f"roll_{w}") - F.col(f"mu_{w}")) / F.greatest(F.col(f"sd_{w}"), F.lit(float(w))))) for w in windows]
    return out.select("province_id", "date", *[F.when(F.col(f"roll_{w}").isNotNull() & F.col(f"mu_{w}").isNotNull(), x).alias(f"rain_{w}_anom") for w, x in zip(windows, z)])


def lagged(anomaly: DataFrame, name: str, lag: int) -> DataFrame:
    """A column moved by days, not rows, so it goes on past the last day."""
    return anomaly.select("province_id", F.date_add("date", lag).alias("date"), F.col(name).alias(f"{name}_lag{lag}"))
