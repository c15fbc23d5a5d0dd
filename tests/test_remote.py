import gzip
import http.server
import json
import threading

import pytest

from tidepanel.sources import grid_json, remote

OPTIONS = {"start": "2024-01-15", "end": "2024-03-02", "price_types": "1,3", "commodities": "com_1", "retries": "2", "pause": "0.01"}


def put(root, kind, month):
    folder = root / f"pt{kind}" / "com_1"
    folder.mkdir(parents=True, exist_ok=True)
    doc = [{"name": " Aceh ", "level": "1", f"0{d}/{month[5:]}/{month[:4]}": f"{kind},00{d}"} for d in (1, 2)]
    (folder / f"{month}.json.gz").write_bytes(gzip.compress(json.dumps(doc).encode()))


def test_partitions_are_the_months_asked_for(spark, tmp_path):
    for kind in (1, 3):
        for month in ("2024-01", "2024-02", "2024-03"):
            put(tmp_path, kind, month)
    df = remote.read_grids(spark, root=str(tmp_path), **OPTIONS)
    assert df.rdd.getNumPartitions() == 6
    some = df.where("price_type_id = 3 and chunk_start >= date'2024-02-01'")
    assert {(r.price_type_id, str(r.chunk_start)) for r in some.collect()} == {(3, "2024-02-01"), (3, "2024-03-01")}
    late = remote.read_grids(spark, root=str(tmp_path), **(OPTIONS | {"start": "2024-02-01", "price_types": "3", "skip": "3/com_1/2024-02-01"}))
    assert late.rdd.getNumPartitions() == 1 and [str(r.chunk_start) for r in late.collect()] == ["2024-03-01"]
    cells = grid_json.parse_grid(df.select("price_type_id", "commodity_id", "data"))
    assert cells.count() == 12 and {r.price for r in cells.where("price_type_id = 3").collect()} == {3001.0, 3002.0}


@pytest.mark.parametrize("failures", [2, 3])
def test_reads_are_tried_again(spark, tmp_path, failures):
    put(tmp_path, 1, "2024-01")
    asked = []

    class Answer(http.server.SimpleHTTPRequestHandler):
        def __init__(self, *args):
            super().__init__(*args, directory=str(tmp_path))

        def do_GET(self):
            asked.append(self.path)
            if len(asked) <= failures:
                self.send_error(503)
            else:
                super().do_GET()

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    options = OPTIONS | {"root": f"http://127.0.0.1:{server.server_port}", "price_types": "1", "end": "2024-01-31", "errors": "column"}
    (row,) = remote.read_grids(spark, **options).collect()
    server.shutdown()
    assert len(asked) == 3 and (row.error is None) == (failures == 2) and (row.data is None) == (failures == 3)


def test_a_collection_is_resumed(spark, tmp_path):
    root, out, status = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "status")
    for month in ("2024-01", "2024-03"):
        put(root, 1, month)
    options = OPTIONS | {"root": str(root), "price_types": "1", "retries": "0"}
    def states():
        return {str(r.chunk_start)[:7]: (r.state, r.run) for r in remote.collect_grids(spark, out, status, **options).collect()}
    assert states() == {"2024-01": ("done", 1), "2024-02": ("failed", 1), "2024-03": ("done", 1)}
    put(root, 1, "2024-02")
    (root / "pt1" / "com_1" / "2024-01.json.gz").unlink()  # what is done isn't asked for again
    assert states() == {"2024-01": ("done", 1), "2024-02": ("done", 2), "2024-03": ("done", 1)}
    assert states() == {"2024-01": ("done", 1), "2024-02": ("done", 2), "2024-03": ("done", 1)}
    stored = spark.read.parquet(out)
    assert stored.count() == 3 and grid_json.parse_grid(stored.select("data")).count() == 6


def test_weather_by_place_and_year(spark, tmp_path):
    def put_weather(place, start, end, values, **header):
        (tmp_path / f"{place}_{start}_{end}.json").write_text(json.dumps({"header": header, "properties": {"parameter": {"PRECTOTCORR": values}}}))

    put_weather(1, "20231230", "20231231", {"20231231": 2.5, "20231230": -999.0})
    put_weather(1, "20240101", "20240102", {"20240101": 0.0, "20240102": None})
    put_weather(2, "20231230", "20231231", {"20231230": -5.0}, fill_value=-5.0)
    put_weather(2, "20240101", "20240102", {})
    options = {"address": str(tmp_path / "{place}_{start}_{end}.json"), "start": "2023-12-30", "end": "2024-01-02", "retries": "0"}
    df = remote.read_weather(spark, [(1, -6.2, 106.8), (2, 5.5, 95.3)], **options)
    assert df.rdd.getNumPartitions() == 4
    assert [(r.province_id, str(r.date), r.value) for r in df.orderBy("province_id", "date").collect()] == [(1, "2023-12-30", None), (1, "2023-12-31", 2.5), (1, "2024-01-01", 0.0), (1, "2024-01-02", None), (2, "2023-12-30", None)]
    with pytest.raises(Exception, match="No such file"):
        remote.read_weather(spark, [(3, 0.0, 0.0)], **options).collect()


def test_what_can_not_be_parsed_is_asked_for_again(tmp_path):
    seen = []

    def parse(text):
        seen.append(text)
        return json.loads(text)

    (tmp_path / "x.json").write_text("{")
    with pytest.raises(ValueError):
        remote.fetch(str(tmp_path / "x.json"), 2, 0.0, parse)
    assert len(seen) == 3


def test_dimensions_are_trimmed_and_ordered(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"data": [{"id": 3, "name": " Riau "}, {"id": 1, "name": "Aceh"}]}))
    (tmp_path / "none.json").write_text("{}")
    assert [tuple(r) for r in remote.read_dimension(spark, str(tmp_path / "p.json"), "provinces").collect()] == [(1, "Aceh"), (3, "Riau")]
    assert remote.read_dimension(spark, str(tmp_path / "none.json"), "regencies").collect() == []
    (tmp_path / "c.json").write_text(json.dumps({"data": [{"id": "com_1", "name": "Beras ", "cat_id": "cat_1", "denomination": "kg", "sort": 2}, {"id": "cat_1", "name": "Beras", "cat_id": None, "denomination": None, "sort": 1}]}))
    assert {r.id: (r.name, r.cat_id) for r in remote.read_dimension(spark, str(tmp_path / "c.json"), "commodities").collect()} == {"com_1": ("Beras", "cat_1"), "cat_1": ("Beras", None)}
