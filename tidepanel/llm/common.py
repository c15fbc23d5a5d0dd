"""What several corpus operators share: cutting lineage, connected components, column hygiene."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, release, scratch, shared_dir  # noqa: F401  the operators take them from here

#: Word characters of every word-based contract: all but space and \t\n\v\f\r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\f\r"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get at most ``rows`` rows at a time, so that long texts fit beside an executor's heap.

    Spark bounds the bytes of a batch too (64 MB).  The session keeps the setting, because results are computed later.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, in any case: outputs replace inputs of the same name."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def folded(df: DataFrame, often: int = 4096) -> DataFrame:
    """(row, times): rows of ``df`` as structs; those equal in all columns and there more than ``often`` times are one.

    Row hashes are counted first, equal ones in the map stage; only the few that occur more than ``often`` times are
    looked up again, and these are aggregated before a shuffle too.  Other rows aren't shuffled (where the
    list of the former is small enough that Spark broadcasts it by itself).  Hashes are 128 bits.  Columns of map type
    can't be hashed and aren't supported.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    keyed = df.select(F.struct(*cols).alias("row"), F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(1), *cols).alias("h2"))
    many = materialize(keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > often).select("h1", "h2"))
    if not many.limit(1).count():
        release(many)
        return keyed.select("row", F.lit(1).cast("long").alias("times"))
    few = keyed.join(many, ["h1", "h2"], "left_anti").select("row", F.lit(1).cast("long").alias("times"))
    return few.unionByName(keyed.join(many, ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("times")).select("row", "times"))


def in_levels(rows: DataFrame, keys: list[str], n_parts: int, add: Callable[[pd.DataFrame], pd.DataFrame], fan: int = 64) -> DataFrame:
    """``rows`` (``keys``, part and more) with the parts of each key put together by ``add``, ``fan`` at a time.

    ``part`` is a number below ``n_parts``, such as a task's.  ``add`` makes one row of several, with the same columns; its part is replaced.
    So no group has more than ``fan`` rows, however many tasks there are.
    """
    columns, schema = list(rows.columns), rows.schema
    while n_parts > 1:
        up = rows.select("*", F.floor(F.col("part") / fan).cast("int").alias("__up"))

        def together(pdf: pd.DataFrame) -> pd.DataFrame:
            return add(pdf.drop(columns="__up").sort_values("part")).assign(part=pdf["__up"].iloc[0])[columns]

        rows = up.groupBy(*keys, "__up").applyInPandas(together, schema)
        n_parts = -(-n_parts // fan)
    return rows


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: (node, comp), comp the smallest node reachable.

    Min-label hooking with pointer jumping; every round is two equi-joins whose state is written to the
    shared folder, so neither edges nor labels reach the driver (one number per round does).  A label
    reached by many nodes is aggregated before the shuffle.  Self-loops and repeated edges do no harm;
    an empty edge list gives an empty result.  Null ends are not allowed.  One component with a third of all nodes is
    one key of the jump's join, whose many side AQE splits; its other side is one row.
    """
    both = materialize(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
        .select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        .select("e.u", "e.v").distinct()
    )
    label = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("comp")))
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("node").alias("v"), F.col("comp").alias("c")), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c"))
        hooked = label.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        # the label's own label, one step up the tree
        up = label.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        new = materialize(hooked.join(up, "comp", "left").select("node", "old", F.least("comp", F.coalesce("top", "comp")).alias("comp")))
        moved = new.where("old <> comp").limit(1).count()
        release(label)
        label = new.select("node", "comp")
        label.scratch_path = new.scratch_path
        if not moved:
            release(both)
            return label
    raise RuntimeError("components did not settle")
