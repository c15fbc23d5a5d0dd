"""The daily update as streams: idempotent upserts of late data, sessions of alarms, onsets with a cooldown."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..sources.grid_json import keep_last
from ..storage import exists, materialize, release

DAY_MS = 86_400_000


def upsert_days(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, partition: str = "date") -> DataStreamWriter:
    """Writer that merges each micro-batch into a Parquet table, last row of a key first; run again, it changes nothing.

    Only the days in a batch are rewritten: their stored rows are read, merged, written to the shared folder, and put in place from there by
    dynamic partition overwrite, so an executor lost meanwhile takes nothing with it.
    """
    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = materialize(batch.select("*", F.lit(1).alias("__new")))
        both = new
        if exists(spark, path):
            old = spark.read.schema(batch.schema).parquet(path).join(new.select(partition).distinct(), partition, "left_semi").select(*batch.columns, F.lit(0).alias("__new"))
            both = old.unionByName(new)
        ranked = both.select("*", F.struct("__new", order).alias("__order"))
        done = materialize(keep_last(ranked, keys, "__order").select(*batch.columns))  # read before its partitions are replaced
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        release(new, done)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def alarm_sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "4 hours", late: str = "1 day") -> DataFrame:
    """(key, first, last, n) of sessions whose events are at most ``gap`` apart; works on streams, with a watermark."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    s = e.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"))
    return s.select(key, "first", "last", "n")


def hourly_means(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", late: str = "2 hours") -> DataFrame:
    """Mean value by hour and kind, late data allowed for."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.window(time, "1 hour").alias("w"), kind).agg(F.avg(value).alias("value")).select(F.col("w.start").alias("hour"), kind, "value")


class _Onsets(StatefulProcessor):
    """Spike days of a key wait until the watermark has passed them; then they are settled in order."""

    def __init__(self, keys: list[str], cooldown: int) -> None:
        self.keys, self.cooldown = keys, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "day int")  # the last settled spike day
        self.waiting = handle.getMapState("waiting", "day int", "spike boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for b in rows:
            for day in b.loc[b["spike"] == 1, "day"].unique().tolist():
                self.waiting.updateValue((int(day),), (True,))
                self.handle.registerTimer((int(day) + 1) * DAY_MS)
        yield self._made(key, [])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for day in sorted(d for (d,) in self.waiting.keys() if d <= passed):
            if last is None or day - last > self.cooldown:
                out.append(day)
            last = day
            self.waiting.removeKey((day,))
            self.handle.registerTimer((day + self.cooldown + 1) * DAY_MS)  # when it has no more say
        if last is not None and passed - last >= self.cooldown:
            self.last.clear()
        elif last is not None:
            self.last.update((last,))
        yield self._made(key, out)

    def _made(self, key: tuple, days: list[int]) -> pd.DataFrame:
        return pd.DataFrame([(*key, dt.date(1970, 1, 1) + dt.timedelta(days=d)) for d in days], columns=[*self.keys, "date"])

    def close(self) -> None:
        pass


def onsets(spikes: DataFrame, keys: list[str], cooldown: int = 14, late: str = "7 days") -> DataFrame:
    """(keys, date) of onsets in a stream of (keys, date, spike): a spike day with none in ``cooldown`` days before.

    Days may come late by ``late``, out of order and repeated: a day is settled when the watermark has passed it, and its onset is
    given then, so the result is that of a batch over all days that weren't later.  A key's state is its last settled spike day
    and the spike days that wait; the former goes when it is ``cooldown`` days past, so idle keys leave nothing.
    """
    spark = spikes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = T.StructType([*[spikes.schema[k] for k in keys], T.StructField("date", T.DateType())])
    timed = spikes.select(*keys, "spike", F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day"), F.col("date").cast("timestamp").alias("__time")).withWatermark("__time", late)
    return timed.groupBy(*keys).transformWithStateInPandas(_Onsets(keys, cooldown), out, "append", "EventTime")
