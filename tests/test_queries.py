import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["parse_price_grid", "collection_report", "quality_report", "panel_labels", "events_table", "weekly_returns", "bh_fdr", "average_precision", "rain_climatology", "walk_forward_folds", "alarm_summary", "session_alarms", "feature_table", "compare_models", "history_docs", "wide_pivot", "feature_texts", "success_criteria", "case_study", "network_docs", "named_observations"]


def flat(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name])
    names = list(want.columns)
    assert sorted(names) == cols
    rows = sorted([flat(r[names.index(c)]) for c in cols] for r in want.fetchall())
    assert sorted([flat(r[c]) for c in cols] for r in got.collect()) == rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
