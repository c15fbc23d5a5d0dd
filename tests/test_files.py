import datetime as dt
import gzip
import json

import pytest

from tidepanel.sources import files, fixtures, grid_json


def test_dimensions_from_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,name,cat_id,denomination,sort\ncat_1,Beras,,kg,1\ncom_1,Beras Bawah,cat_1,kg,2\ncom_2,Lain,cat_9,kg,3\n")
    cats, coms = files.commodity_tree(files.read_csv(spark, str(tmp_path / "c.csv"), "commodities"))
    assert [tuple(r) for r in cats.collect()] == [("cat_1", "Beras", 1)]
    assert sorted((r.commodity_id, r.category) for r in coms.collect()) == [("com_1", "Beras"), ("com_2", None)]
    (tmp_path / "bad.csv").write_text("id,name\nx,Aceh\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "bad.csv"), "provinces").collect()


def test_leaders_and_documents(spark, tmp_path):
    doc = {"com_1|3": [5, 2], "com_2|1": []}
    files.write_json(spark, str(tmp_path / "l"), doc, compress=True)
    assert files.read_json(spark, str(tmp_path / "l")) == doc
    assert [tuple(r) for r in files.read_leaders(spark, str(tmp_path / "l")).collect()] == [("com_1", 3, 5, 1), ("com_1", 3, 2, 2)]


def test_grid_files_to_long_observations(spark, tmp_path):
    def put(kind, com, month, rows):
        path = tmp_path / f"pt{kind}" / com / f"{month}.json.gz"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(gzip.compress(json.dumps({"meta": {"price_type_id": kind}, "data": rows}).encode()))

    put(1, "com_1", "2026-09", [{"no": "I", "name": "Semua Provinsi", "level": "0", "15/09/2026": "67,000"}, {"no": "1", "name": "Aceh ", "level": "1", "15/09/2026": "-", "16/09/2026": "70,500"}, {"name": "Dum", "level": "1", "15/09/2026": "1"}])
    put(1, "com_1", "2026-10", [{"name": "Aceh", "level": "1", "16/09/2026": "71,000", "01/10/2026": ""}])
    put(2, "com_2", "2026-09", [])
    cells = grid_json.parse_grid(grid_json.read_grid_files(spark, str(tmp_path)))
    tree = spark.createDataFrame([("cat_1", "Beras", None), ("com_1", "Beras Bawah", "cat_1")], "id string, name string, cat_id string")
    kinds = spark.createDataFrame([(1, "Pasar Modern")], "id int, name string")
    places = fixtures.provinces(spark)
    places = places.select(places.columns[0], places.columns[1]).toDF("id", "name")
    got = {(r.province_id, r.date): r for r in grid_json.load_long(cells, places, tree, kinds).collect()}
    assert {k: v.price for k, v in got.items()} == {(0, dt.date(2026, 9, 15)): 67000.0, (1, dt.date(2026, 9, 15)): None, (1, dt.date(2026, 9, 16)): 71000.0, (1, dt.date(2026, 10, 1)): None}
    first = got[1, dt.date(2026, 9, 16)]
    assert (first.price_type, first.commodity, first.category, first.province) == ("Pasar Modern", "Beras Bawah", "Beras", "Aceh")
    assert [(r.name, r.n_cells) for r in grid_json.unknown_regions(cells, places).collect()] == [("Dum", 1)]


def test_estimated_holidays_are_near_the_official_ones():
    for year, days in fixtures.MOVING_HOLIDAYS.items():
        for a, b in zip(days, fixtures.estimated_holidays(year)):
            assert abs((dt.date.fromisoformat(a) - dt.date.fromisoformat(b)).days) <= 2
    assert all(fixtures.estimated_holidays(y) is None or all(d.startswith(str(y)) for d in fixtures.estimated_holidays(y)) for y in range(1990, 2060))
