"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def distances(places: DataFrame) -> DataFrame:
    """(province_id, other, km) of all ordered pairs of a dimension table of places, which is small."""
    a = places.select("province_id", "lat", "lon")
    b = places.select(F.col("province_id").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.crossJoin(F.broadcast(b)).where("province_id <> other").select("province_id", "other", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("km"))


def nearest(places: DataFrame, k: int = 3) -> DataFrame:
    """(province_id, other, km, rank) of the ``k`` nearest others, ties by id."""
    r = F.row_number().over(Window.partitionBy("province_id").orderBy("km", "other"))
    return distances(places).select("*", r.alias("rank")).where(F.col("rank") <= k)
