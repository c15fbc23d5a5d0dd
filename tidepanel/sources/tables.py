"""Stored tables laid out for the reads that follow: partitioned by price type, bucketed and sorted by series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.panel import SERIES


def save_by_series(df: DataFrame, name: str, path: str, buckets: int, partition: list[str] | None = None, keys: list[str] = SERIES, order: str = "date") -> DataFrame:
    """Write ``df`` to ``path`` as table ``name`` and return it as stored.

    Folders are by ``partition`` (price_type_id if there is such a column), so that a filter on it reads its folders alone.  Rows are dealt by the
    same hash as the buckets first, so each folder gets one file a bucket and not one for each task and bucket.  What groups,
    joins or runs windows by ``keys`` then needs no exchange (joins by keys and day neither, with
    ``spark.sql.requireAllClusterKeysForCoPartition`` off).  Choose ``buckets`` by the table's size: some 200 MB a
    bucket and folder.  Null keys are a bucket's rows like any other; an existing table is replaced.
    """
    parts = (["price_type_id"] if "price_type_id" in df.columns else []) if partition is None else partition
    write = df.repartition(buckets, *keys).write.mode("overwrite").option("path", path)
    write = write.partitionBy(*parts) if parts else write
    write.bucketBy(buckets, *keys).sortBy(*keys, order).saveAsTable(name)
    return df.sparkSession.table(name)


def attach_by_series(spark: SparkSession, name: str, path: str, columns: str, buckets: int, partition: list[str] | None = None, keys: list[str] = SERIES, order: str = "date") -> DataFrame:
    """Declare what :func:`save_by_series` left in ``path`` to a session whose catalog doesn't know it.

    ``columns`` is the DDL of all columns; ``buckets``, ``partition`` and ``keys`` must be those it was written with.
    """
    parts = (["price_type_id"] if "price_type_id" in columns else []) if partition is None else partition
    folders = f"PARTITIONED BY ({', '.join(parts)})" if parts else ""
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {folders} CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join([*keys, order])}) INTO {buckets} BUCKETS LOCATION '{path}'")
    if parts:
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)
