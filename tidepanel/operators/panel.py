"""Dense panels: grids, cleaning, smoothing, bounded filling, window algebra on dense series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import Cleaning

SERIES = ["commodity_id", "province_id"]


def in_order(keys: list[str] = SERIES) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("date")


def rows(a: int, b: int, keys: list[str] = SERIES) -> WindowSpec:
    return in_order(keys).rowsBetween(a, b)


def backwards(keys: list[str] = SERIES) -> WindowSpec:
    """All later rows, nearest last, for ``F.last``: a frame that only grows, as one that ends in the future does not."""
    return Window.partitionBy(*keys).orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)


def by_series(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """``df`` dealt by series over all shuffle partitions, for the windows that follow.

    Windows cost far more by the row than adaptive execution reckons from bytes; left to it, small panels end in one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def guarded(value: Column, x: Column, least: int, over: WindowSpec) -> Column:
    """``value`` over the frame where it has ``least`` non-null ``x``, else null."""
    return F.when(F.count(x).over(over) >= least, value.over(over))


def lag_of(x: Column | str, n: int, keys: list[str] = SERIES) -> Column:
    return F.lag(x, n).over(in_order(keys))


def observation_grid(obs: DataFrame, price_type: int) -> DataFrame:
    """Dates with a price in any series times series with any price, for one price type; missing cells are null.

    Repeated keys are averaged first.  Both sides of the product are distinct lists, so their sizes are days and
    series, not observations; the product is hash-joined back to the prices.
    """
    one = obs.where((F.col("price_type_id") == price_type) & F.col("price").isNotNull()).groupBy(*SERIES, "date").agg(F.avg("price").alias("price"))
    grid = one.select(*SERIES).distinct().crossJoin(one.select("date").distinct())
    return grid.join(one, [*SERIES, "date"], "left")


def flag_bad_values(grid: DataFrame, cfg: Cleaning = Cleaning()) -> DataFrame:
    """Adds bad: a one-off blip against both neighbours, or far from the centred median."""
    x = F.ln("price")
    g = by_series(grid).select("*", x.alias("x"))
    far = rows(-(cfg.window // 2), cfg.window // 2)
    g = g.select(
        "*", F.last("x", True).over(rows(Window.unboundedPreceding, -1)).alias("prev"), F.last("x", True).over(backwards()).alias("next"),
        guarded(F.percentile("x", F.lit(0.5)), F.col("x"), cfg.min_obs, far).alias("mid"),
    )
    up = (F.col("x") - F.col("prev") > cfg.blip) & (F.col("x") - F.col("next") > cfg.blip)
    down = (F.col("prev") - F.col("x") > cfg.blip) & (F.col("next") - F.col("x") > cfg.blip)
    off = F.abs(F.col("x") - F.col("mid")) > cfg.scale
    return g.select(*grid.columns, (F.coalesce(up | down | off, F.lit(False)) & F.col("x").isNotNull()).alias("bad"))


def cleaning_log(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy(*SERIES).agg(F.count("price").alias("n_obs"), F.sum(F.col("bad").cast("long")).alias("n_removed"))


def smooth(flagged: DataFrame, cfg: Cleaning = Cleaning()) -> DataFrame:
    """Median of the last ``cfg.smooth`` grid rows of values that aren't bad; it also fills short gaps."""
    good = flagged.select(*SERIES, "date", F.when(~F.col("bad"), F.col("price")).alias("price"))
    return good.select(*SERIES, "date", F.percentile("price", F.lit(0.5)).over(rows(-(cfg.smooth - 1), 0)).alias("price"))


def to_calendar(df: DataFrame, span: DataFrame, limit: int = 7, keys: list[str] = SERIES, value: str = "price") -> DataFrame:
    """``df`` on every day of ``span`` (one row: first, last), values carried forward over at most ``limit`` days."""
    days = span.select(F.explode(F.sequence("first", "last")).alias("date"))
    grid = df.select(*keys).distinct().crossJoin(days).join(df.select(*keys, "date", value), [*keys, "date"], "left")
    return by_series(grid, keys).select(*keys, "date", F.last(value, True).over(rows(-limit, 0, keys)).alias(value))


def price_panel(obs: DataFrame, price_type: int = 1, cfg: Cleaning = Cleaning()) -> DataFrame:
    """Clean daily panel (commodity_id, province_id, date, price) of one price type on the calendar of all types."""
    span = obs.where("price is not null").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return to_calendar(smooth(flag_bad_values(observation_grid(obs, price_type), cfg), cfg), span, cfg.ffill)


def future_max(x: Column | str, horizon: int) -> Column:
    return F.max(x).over(rows(1, horizon))


def run_length(flag: str) -> Column:
    """Rows from here on with ``flag`` = 1 without a break; 0 where it isn't 1.  Needs column i, the row's number."""
    end = F.last(F.when(F.col(flag) == 0, F.col("i")), True).over(backwards())
    n = F.count(F.lit(1)).over(Window.partitionBy(*SERIES))
    return F.when(F.col(flag) == 0, 0).otherwise(F.coalesce(end, n + 1) - F.col("i")).cast("long")


def days_since(flag: str, cap: int = 365) -> Column:
    """Rows since ``flag`` was last 1, at most ``cap``, which also stands for never.  Needs column i."""
    last = F.last(F.when(F.col(flag) == 1, F.col("i")), True).over(rows(Window.unboundedPreceding, 0))
    return F.least(F.lit(cap), F.coalesce(F.col("i") - last, F.lit(cap))).cast("long")


def numbered(df: DataFrame) -> DataFrame:
    return df.select("*", F.row_number().over(in_order()).alias("i"))


def weekly(df: DataFrame, value: str = "price") -> DataFrame:
    """Mean of each week that ends on Friday, and its log-return on the dense grid of weeks."""
    week = F.next_day(F.date_sub("date", 1), "FRI").alias("date")
    w = df.select(*SERIES, week, F.ln(value).alias("x")).groupBy(*SERIES, "date").agg(F.avg("x").alias("x"))
    return w.select(*SERIES, "date", "x", (F.col("x") - lag_of("x", 1)).alias("ret"))


def flat_runs(df: DataFrame) -> DataFrame:
    """Longest run of unchanged prices of each series, in changes that didn't happen (non-null rows only)."""
    d = df.where("price is not null").select(*SERIES, "date", "price", lag_of("price", 1).alias("p"))
    d = d.select(*SERIES, F.sum(F.when(F.col("p").eqNullSafe(F.col("price")), 0).otherwise(1)).over(rows(Window.unboundedPreceding, 0)).alias("run"))
    n = d.groupBy(*SERIES, "run").count()
    return n.groupBy(*SERIES).agg((F.max("count") - 1).alias("longest_flat"))
