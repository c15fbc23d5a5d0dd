import re
from pathlib import Path

from pyspark.sql import functions as F

from tidepanel.config import Target
from tidepanel.operators.labels import make_labels
from tidepanel.operators.panel import SERIES
from tidepanel.sources.tables import attach_by_series, save_by_series

COLUMNS = "commodity_id string, province_id int, date date, price double, price_type_id int"


def prices(spark):
    x = spark.range(2 * 3 * 4 * 40).select(
        F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("commodity_id"), (F.floor(F.col("id") / 3) % 4).cast("int").alias("province_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.floor(F.col("id") / 12) % 40).cast("int")).alias("date"), (100 + (F.col("id") * 37) % 90).cast("double").alias("price"), (1 + F.floor(F.col("id") / 480)).cast("int").alias("price_type_id"))
    return x


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def check(spark, table):
    plan = plan_of(make_labels(table.where("price_type_id = 2").drop("price_type_id"), Target()))
    plan = plan.split("== Initial Plan ==")[0]
    assert "Window" in plan and "Exchange" not in plan
    assert re.search(r"PartitionFilters: \[[^\]]*price_type_id#\d+ = 2", plan) and re.search(r"Bucketed: true", plan)


def test_types_are_pruned_and_windows_need_no_exchange(spark, tmp_path):
    x, path = prices(spark), str(tmp_path / "prices")
    t = save_by_series(x, "prices_by_series", path, 4)
    try:
        check(spark, t)
        for folder in Path(path).glob("price_type_id=*"):
            assert 1 < len(list(folder.glob("*.parquet"))) <= 4  # a file a bucket
        assert sorted(map(str, t.select(x.columns).collect())) == sorted(map(str, x.collect()))
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # else a join by series and day isn't content with series
        joined = plan_of(t.where("price_type_id = 1").hint("merge").join(t.where("price_type_id = 2").select(*SERIES, "date", F.col("price").alias("q")), [*SERIES, "date"]))
        assert "Exchange" not in joined.split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.sql("DROP TABLE prices_by_series")


def test_attached_table_reads_as_it_was_written(spark, tmp_path):
    x, path = prices(spark), str(tmp_path / "prices")
    save_by_series(x, "prices_once", path, 4)
    spark.sql("DROP TABLE prices_once")  # the files stay, the catalog forgets
    t = attach_by_series(spark, "prices_again", path, COLUMNS, 4)
    try:
        check(spark, t)
        assert sorted(map(str, t.select(x.columns).collect())) == sorted(map(str, x.collect()))
    finally:
        spark.sql("DROP TABLE prices_again")


def test_nulls_empty_and_unpartitioned(spark, tmp_path):
    rows = [(None, None, None, None), ("a", 1, None, 2.0), ("a", 1, None, 2.0)]
    x = spark.createDataFrame(rows, "commodity_id string, province_id int, date date, price double")
    try:
        assert sorted(map(str, save_by_series(x, "odd_prices", str(tmp_path / "odd"), 2).collect())) == sorted(map(str, x.collect()))
        assert save_by_series(x.limit(0), "no_prices", str(tmp_path / "none"), 2).count() == 0
    finally:
        spark.sql("DROP TABLE IF EXISTS odd_prices")
        spark.sql("DROP TABLE IF EXISTS no_prices")
