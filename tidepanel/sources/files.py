"""Dimension tables and documents on disk: CSV with a given schema, JSON maps, and JSON written whole."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = {
    "provinces": "id int, name string",
    "commodities": "id string, name string, cat_id string, denomination string, sort int",
    "price_types": "id int, name string",
    "holidays": "date date, event string, source string",
}


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A dimension with its schema; columns are found by name, a missing one or a bad value is an error."""
    schema = DIMENSIONS[kind]
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").csv(path)


def commodity_tree(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(categories, commodities with their category's name) of a table whose categories have no cat_id."""
    cats = tree.where("cat_id is null").select(F.col("id").alias("cat_id"), F.col("name").alias("category"), F.col("sort").alias("cat_sort"))
    coms = tree.where("cat_id is not null").join(F.broadcast(cats), "cat_id", "left")  # a dimension: tens of rows
    return cats, coms.select(F.col("id").alias("commodity_id"), F.col("name").alias("commodity"), "cat_id", "category", "denomination", "sort")


def read_leaders(spark: SparkSession, path: str) -> DataFrame:
    """(commodity_id, province_id, other, rank) of a JSON object {"commodity|province": [province, ...]}, best first."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<int>>").alias("m"))
    rows = doc.select(F.explode("m").alias("key", "others")).select(F.split("key", r"\|").alias("k"), F.posexplode("others").alias("at", "other"))
    return rows.select(F.col("k")[0].alias("commodity_id"), F.col("k")[1].cast("int").alias("province_id"), "other", (F.col("at") + 1).alias("rank"))


def write_json(spark: SparkSession, path: str, doc: dict | list, compress: bool = False) -> None:
    """One document as one file of a folder, by Spark's writer: whole or not at all, wherever ``path`` lies."""
    text = json.dumps(doc, ensure_ascii=False, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def read_json(spark: SparkSession, path: str) -> dict | list:
    return json.loads(spark.read.text(path, wholetext=True).first().value)
