import datetime as dt

from tidepanel.operators import reports

PRED = "commodity_id string, province_id int, date date, y int, score double, threshold double"
EVENTS = "date date, commodity_id string, province_id int, peak_rise_30d double"
START = dt.date(2024, 1, 1)


def day(n):
    return START + dt.timedelta(days=n)


def rows(spark):
    pred = [(c, 1, day(n), int(20 <= n < 34), 1.0 if c == "a" and n == 25 else 0.0, 0.5) for c in "abc" for n in range(80)]
    events = [(day(34), "a", 1, 0.4), (day(34), "b", 1, 0.9)]
    return spark.createDataFrame(pred, PRED), spark.createDataFrame(events, EVENTS)


def test_case_is_the_largest_that_was_seen_in_time(spark):
    pred, events = rows(spark)
    panel = pred.selectExpr("commodity_id", "province_id", "date", "100.0 as price")
    got = reports.case_study(pred, events, panel, ["a", "b"], "2024-01-01").collect()
    assert {(r.commodity_id, r.onset, r.first_alarm) for r in got} == {("a", day(34), day(25))}
    assert len(got) == 65 and [r.date for r in got if r.is_alarm] == [day(25)]
    assert reports.case_study(pred, events, panel, ["b"], "2024-01-01").collect() == []
    assert reports.case_study(pred.limit(0), events, panel, ["a"], "2024-01-01").collect() == []


def test_categories_without_events_stay(spark):
    pred, events = rows(spark)
    cats = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "commodity_id string, cat_id string")
    got = {r.cat_id: r for r in reports.by_category(pred, events, cats).collect()}
    assert (got["x"].n_events, got["x"].event_detection_rate, got["x"].median_lead_days) == (2, 0.5, 9.0)
    assert (got["y"].n_events, got["y"].event_detection_rate, got["y"].n) == (0, None, 80)


def test_criteria_of_unknown_results_are_not_met(spark):
    cols = "key string, pr_auc double, event_detection_rate double, median_lead_days double, far double, false_episodes_per_series_year double"
    table = spark.createDataFrame([("m", 0.375, 0.7, None, 0.2, 0.1), ("naive", 0.2, 0.1, 3.0, 0.5, 1.0), ("other", 0.25, 0.1, 3.0, 0.5, 1.0)], cols)
    got = {r.criterion: r for r in reports.success_criteria(table, "m").collect()}
    assert {c: r.met for c, r in got.items()} == {"pr_auc_ratio": True, "better_than_all": True, "event_detection_rate": True, "median_lead_days": False, "far": True, "false_episodes_per_series_year": True}
    assert abs(got["better_than_all"].result - 0.125) < 1e-12
    assert not any(r.met for r in reports.success_criteria(table.limit(0), "m").collect())


def test_completeness_counts_cells(spark):
    obs = spark.createDataFrame([(1, "a", 1, day(0), 1.0), (1, "a", 1, day(1), 1.0), (1, "b", 1, day(1), 1.0), (1, "b", 0, day(2), 1.0), (1, "b", 1, day(3), None)], "price_type_id int, commodity_id string, province_id int, date date, price double")
    (r,) = reports.completeness(obs, [2023, 2024]).collect()
    assert (r.y2023, r.y2024) == (None, 3 / 6)
    assert reports.completeness(obs.limit(0), [2024]).collect() == []


def test_deltas_leave_out_periods_of_one_class(spark):
    rows = [("p", 1, 0.9, 0.1), ("p", 0, 0.1, 0.9), ("q", 1, 0.1, 0.9), ("q", 0, 0.9, 0.1), ("r", 0, 0.5, 0.5)]
    (r,) = reports.deltas_by_period(spark.createDataFrame(rows, "fold string, y int, score_full double, score_less double"), "full").collect()
    assert (r.variant, r.n_won, r.n_periods, r.mean_delta) == ("less", 1, 2, 0.0)
