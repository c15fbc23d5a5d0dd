"""Remote sources: price grids and daily weather as Spark data sources, dimensions, and a collection that can be resumed."""

from __future__ import annotations

import datetime as dt
import gzip
import json
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import exists, materialize, release
from .files import DIMENSIONS

SCHEMA = "price_type_id int, commodity_id string, chunk_start date, data string, error string"
STATUS = "price_type_id int, commodity_id string, chunk_start date, state string, n_bytes long, error string, run long"
KEYS = ["price_type_id", "commodity_id", "chunk_start"]


def fetch(address: str, retries: int = 3, pause: float = 0.5, parse: Callable = str):
    """What ``parse`` makes of the text at a URL or path, unzipped where it is gzip; either failing, tried again after ever longer pauses."""
    for k in range(retries + 1):
        try:
            with urllib.request.urlopen(address if "://" in address else f"file://{address}", timeout=60) as answer:
                raw = answer.read()
            return parse((gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode())
        except Exception:
            if k == retries:
                raise
            time.sleep(pause * 2**k)
    raise AssertionError


class Chunk(InputPartition):
    def __init__(self, price_type: int, commodity: str, start: dt.date) -> None:
        self.price_type, self.commodity, self.start = price_type, commodity, start


class GridReader(DataSourceReader):
    """A partition for each price type, commodity and month that the options ask for.

    Filters aren't taken: Spark keeps those of a frame's first query with the frame, so a second one would miss rows.
    """

    def __init__(self, options: dict) -> None:
        self.options = options
        self.types = [int(x) for x in options["price_types"].split(",")]
        self.commodities = options["commodities"].split(",")
        first, last = (dt.date.fromisoformat(options[k]).replace(day=1) for k in ("start", "end"))
        self.skipped = set(options.get("skip", "").split(","))
        self.months = []
        while first <= last:
            self.months.append(first)
            first = (first + dt.timedelta(days=31)).replace(day=1)

    def partitions(self) -> list[Chunk]:
        return [Chunk(t, c, m) for t in self.types for c in self.commodities for m in self.months if f"{t}/{c}/{m}" not in self.skipped]

    def read(self, chunk: Chunk) -> Iterator[tuple]:
        address = f"{self.options['root'].rstrip('/')}/pt{chunk.price_type}/{chunk.commodity}/{chunk.start:%Y-%m}.json.gz"
        data = error = None
        try:
            data = fetch(address, int(self.options.get("retries", 3)), float(self.options.get("pause", 0.5)))
        except Exception as e:
            if self.options.get("errors", "raise") == "raise":
                raise
            error = f"{type(e).__name__}: {e}"[:500]
        yield (chunk.price_type, chunk.commodity, chunk.start, data, error)


class GridSource(DataSource):
    """Grid documents by month.  Options: root (URL or folder), start, end (dates), price_types, commodities (comma-joined), retries, pause, errors ("raise", or "column" to get them as rows), skip (chunks type/commodity/month to leave out)."""

    @classmethod
    def name(cls) -> str:
        return "price_grid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GridReader:
        return GridReader(dict(self.options))


def read_grids(spark: SparkSession, **options: str) -> DataFrame:
    """(price_type_id, commodity_id, chunk_start, data, error) from :class:`GridSource`."""
    spark.dataSource.register(GridSource)
    return spark.read.format("price_grid").options(**options).load()


class Spell(InputPartition):
    def __init__(self, place: int, lat: float, lon: float, start: dt.date, end: dt.date) -> None:
        self.place, self.lat, self.lon, self.start, self.end = place, lat, lon, start, end


class WeatherReader(DataSourceReader):
    """A partition for each place and calendar year that the options ask for."""

    def __init__(self, options: dict) -> None:
        self.options = options
        self.places = [tuple(p.split(":")) for p in options["places"].split(",") if p]
        self.first, self.last = (dt.date.fromisoformat(options[k]) for k in ("start", "end"))

    def partitions(self) -> list[Spell]:
        years = range(self.first.year, self.last.year + 1)
        spells = [(max(self.first, dt.date(y, 1, 1)), min(self.last, dt.date(y, 12, 31))) for y in years]
        return [Spell(int(p), float(lat), float(lon), a, b) for p, lat, lon in self.places for a, b in spells if a <= b]

    def read(self, spell: Spell) -> Iterator[tuple]:
        name = self.options.get("parameter", "PRECTOTCORR")

        def days(text: str) -> list[tuple]:
            doc = json.loads(text)
            fill = doc.get("header", {}).get("fill_value", -999.0)
            found = doc["properties"]["parameter"][name]
            return [(dt.datetime.strptime(day, "%Y%m%d").date(), None if v is None or v == fill else float(v)) for day, v in sorted(found.items())]

        where = self.options["address"].format(place=spell.place, lat=spell.lat, lon=spell.lon, start=f"{spell.start:%Y%m%d}", end=f"{spell.end:%Y%m%d}", parameter=name)
        for day, value in fetch(where, int(self.options.get("retries", 4)), float(self.options.get("pause", 2.0)), days):
            yield (spell.place, day, value)


class WeatherSource(DataSource):
    """Daily weather of places, sorted by day in each partition.  Options: address (URL or path with the fields {place}, {lat}, {lon}, {start}, {end}, {parameter}), places ("id:lat:lon", comma-joined), start, end (dates), parameter, retries, pause."""

    @classmethod
    def name(cls) -> str:
        return "daily_weather"

    def schema(self) -> str:
        return "province_id int, date date, value double"

    def reader(self, schema) -> WeatherReader:
        return WeatherReader(dict(self.options))


def read_weather(spark: SparkSession, places: list[tuple[int, float, float]], **options: str) -> DataFrame:
    """(province_id, date, value) from :class:`WeatherSource`; the service's filling value is null, and so is a null."""
    spark.dataSource.register(WeatherSource)
    listed = ",".join(f"{p}:{lat}:{lon}" for p, lat, lon in places)
    return spark.read.format("daily_weather").options(places=listed, **options).load()


def read_dimension(spark: SparkSession, address: str, kind: str, retries: int = 3, pause: float = 0.5) -> DataFrame:
    """A dimension from a document {"data": [...]}: names trimmed, numbered ones by id; without data, empty.

    ``kind`` is one of :data:`files.DIMENSIONS` or regencies.  These are tens to hundreds of rows, so the driver asks for them.
    """
    columns = DIMENSIONS.get(kind, "id int, name string")
    text = fetch(address, retries, pause)
    rows = spark.createDataFrame([(text,)], "value string").select(F.explode(F.from_json("value", f"data array<struct<{columns}>>", {"mode": "FAILFAST"})["data"]).alias("r")).select("r.*")
    rows = rows.withColumn("name", F.trim("name")) if "name" in rows.columns else rows
    return rows.orderBy("id") if rows.columns[0] == "id" and rows.schema["id"].dataType.simpleString() == "int" else rows


def statuses(spark: SparkSession, path: str) -> DataFrame:
    """The last status of each chunk; empty before the first run."""
    found = spark.read.schema(STATUS).parquet(path) if exists(spark, path) else spark.createDataFrame([], STATUS)
    return found.groupBy(*KEYS).agg(F.max_by(F.struct("state", "n_bytes", "error", "run"), "run").alias("s")).select(*KEYS, "s.*")


def collect_grids(spark: SparkSession, path: str, status_path: str, **options: str) -> DataFrame:
    """Bring the chunks asked for to ``path`` and return their statuses; run again, it fetches those that failed or are missing.

    Chunks that came are put in place by dynamic overwrite of their own partitions, then their status rows are appended: a run that breaks off
    between the two fetches these chunks once more and writes the same.  A chunk that can't be had, after retries, is a "failed" row
    with its error and doesn't stop the others.  Chunks that are done aren't read again.
    """
    known = statuses(spark, status_path)
    done = [f"{r.price_type_id}/{r.commodity_id}/{r.chunk_start}" for r in known.where("state = 'done'").select(*KEYS).collect()]  # as many as the plan has partitions
    run = (known.agg(F.max("run")).first()[0] or 0) + 1
    left = options | {"errors": "column", "skip": ",".join(done)}
    if not GridReader(left).partitions():
        return known
    came = materialize(read_grids(spark, **left))
    came.where("error is null").select("data", *KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)
    state = F.when(F.col("error").isNull(), "done").otherwise("failed")
    came.select(*KEYS, state.alias("state"), F.octet_length("data").cast("long").alias("n_bytes"), "error", F.lit(run).cast("long").alias("run")).write.mode("append").parquet(status_path)
    release(came)
    return statuses(spark, status_path)
