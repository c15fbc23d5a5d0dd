import datetime as dt
import random

from tidepanel.streaming import ingest

DAY = dt.date(2024, 1, 1)


def test_upsert_is_idempotent_and_keeps_the_last(spark, tmp_path):
    schema = "province_id int, date date, v double, seq int"
    for k, rows in enumerate(([(1, DAY, 1.0, 1), (1, DAY, 2.0, 2), (2, DAY + dt.timedelta(days=1), 5.0, 1)], [(1, DAY, 9.0, 1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        ingest.upsert_days(stream, f"{tmp_path}/out", f"{tmp_path}/check", ["province_id", "date"], "seq").start().awaitTermination()
        got = sorted((r.province_id, r.v) for r in spark.read.parquet(f"{tmp_path}/out").collect())
        assert got == ([(1, 2.0), (2, 5.0)] if k == 0 else [(1, 9.0), (2, 5.0)])


def batch_onsets(days, cooldown=14):
    return [d for k, d in enumerate(sorted(set(days))) if k == 0 or d - sorted(set(days))[k - 1] > cooldown]


def test_onsets_of_late_repeated_and_unordered_days(spark, tmp_path):
    """Each file is a micro-batch; days come up to 6 days late, twice, and in any order."""
    r = random.Random(3)
    spikes = {"a": [0, 1, 10, 30, 34, 60, 80, 95], "b": [5, 20, 35, 36, 52, 90], "idle": [2]}
    rows = [(k, i, int(i in days)) for k, days in spikes.items() for i in range(3 if k == "idle" else 100)]
    rows += [x for x in rows if r.random() < 0.2]
    rows.sort(key=lambda x: x[1] + r.uniform(0, 6))
    schema = "k string, date date, spike int"
    for part in [rows[i : i + 40] for i in range(0, len(rows), 40)] + [[("end", 200, 0)]]:
        spark.createDataFrame([(k, DAY + dt.timedelta(days=i), s) for k, i, s in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = ingest.onsets(stream, ["k"]).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()  # stopped and started again for each batch
    got = sorted((x.k, (x.date - DAY).days) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((k, d) for k, days in spikes.items() for d in batch_onsets(days))


def test_sessions_touching_the_gap_are_one(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t), (1, t + dt.timedelta(hours=4)), (1, t + dt.timedelta(hours=9))]
    got = ingest.alarm_sessions(spark.createDataFrame(rows, "user_id int, ts timestamp")).collect()
    assert sorted(r.n for r in got) == [1, 2]
