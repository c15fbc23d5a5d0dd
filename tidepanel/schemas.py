"""Explicit schemas of the data sets that operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SERIES = ("commodity_id", "province_id")

OBSERVATIONS = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("price_type_id", T.IntegerType()), T.StructField("price_type", T.StringType()),
    T.StructField("commodity_id", T.StringType()), T.StructField("commodity", T.StringType()), T.StructField("cat_id", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("province_id", T.IntegerType()), T.StructField("province", T.StringType()), T.StructField("price", T.DoubleType()),
])
HOLIDAYS = T.StructType([T.StructField("date", T.DateType()), T.StructField("event", T.StringType()), T.StructField("source", T.StringType())])
PROVINCES = T.StructType([T.StructField("province_id", T.IntegerType()), T.StructField("province", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("island", T.StringType())])


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` itself, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
