"""State between steps: written to the folder that driver and executors share, read back, deleted when no longer needed."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset a local master (tests) gets a temporary one; on a cluster that would lie on one machine only,
    so there it is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidepanel-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


_WRITTEN: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, kind: str = "state") -> str:
    """A new path in the shared folder; what lies there goes with :func:`release`, or when Python ends."""
    path = f"{shared_dir(spark)}/tidepanel-{kind}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def release(*frames: DataFrame | str) -> None:
    """Delete what :func:`materialize` wrote for ``frames``, which nothing may read any more."""
    for frame in frames:
        path = frame if isinstance(frame, str) else frame.scratch_path
        spark = _WRITTEN.pop(path, None)
        if spark is not None:
            delete(spark, path)


@atexit.register
def _release_all() -> None:
    for path in list(_WRITTEN):
        try:
            release(path)
        except Exception:  # the session is gone; nothing can be deleted through it
            return
