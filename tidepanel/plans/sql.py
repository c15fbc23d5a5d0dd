"""Common table expressions that the SQL of many queries shares; ``with_`` puts the needed ones before a body."""

from __future__ import annotations

import re

SERIES = "commodity_id, province_id"
W = "PARTITION BY commodity_id, province_id ORDER BY date"

CTE = {
    "sales": """SELECT (CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 4 WHEN l_linestatus = 'F' THEN 2 ELSE 3 END)::INT AS price_type_id,
        p_type AS commodity_id, (n_regionkey + 1)::INT AS province_id, l_shipdate::DATE AS date, round(l_extendedprice * 100)::BIGINT AS cents
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "obs": "SELECT price_type_id, commodity_id, province_id, date, sum(cents)::DOUBLE / count(*) / 100 AS price FROM sales GROUP BY ALL",
    "obsn": """SELECT price_type_id, commodity_id, coalesce(province_id, 0)::INT AS province_id, date, sum(cents)::DOUBLE / count(*) / 100 AS price
        FROM sales GROUP BY GROUPING SETS ((price_type_id, commodity_id, date, province_id), (price_type_id, commodity_id, date))""",
    "days": "SELECT unnest(generate_series((SELECT min(date) FROM obs), (SELECT max(date) FROM obs), INTERVAL 1 DAY))::DATE AS date",
    "rain": """SELECT o_orderdate::DATE AS date, (n_regionkey + 1)::INT AS province_id, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 10000000 AS precip_mm
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
}


def _panel(tag: str, obs: str, pt: int) -> None:
    """Adds grid, flagged, smooth and panel CTEs of one price type."""
    CTE[f"grid{tag}"] = f"""SELECT s.*, d.date, o.price FROM (SELECT DISTINCT {SERIES} FROM {obs} WHERE price_type_id = {pt}) s
        CROSS JOIN (SELECT DISTINCT date FROM {obs} WHERE price_type_id = {pt}) d
        LEFT JOIN {obs} o ON o.price_type_id = {pt} AND o.commodity_id = s.commodity_id AND o.province_id = s.province_id AND o.date = d.date"""
    CTE[f"near{tag}"] = f"""SELECT *, ln(price) AS x,
        last_value(ln(price) IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
        first_value(ln(price) IGNORE NULLS) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
        CASE WHEN count(price) OVER ({W} ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) >= 5
             THEN median(ln(price)) OVER ({W} ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) END AS mid FROM grid{tag}"""
    CTE[f"flagged{tag}"] = f"""SELECT {SERIES}, date, price, coalesce((x - prev > ln(6) AND x - nxt > ln(6)) OR (prev - x > ln(6) AND nxt - x > ln(6)) OR abs(x - mid) > ln(4), false)
        AND x IS NOT NULL AS bad FROM near{tag}"""
    CTE[f"smooth{tag}"] = f"SELECT {SERIES}, date, median(CASE WHEN NOT bad THEN price END) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS price FROM flagged{tag}"
    CTE[f"panel{tag}"] = f"""SELECT {SERIES}, date, last_value(price IGNORE NULLS) OVER ({W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS price
        FROM (SELECT s.*, days.date FROM (SELECT DISTINCT {SERIES} FROM smooth{tag}) s CROSS JOIN days) g LEFT JOIN smooth{tag} USING ({SERIES}, date)"""


_panel("", "obs", 1)
for _pt in (1, 2, 3, 4):
    _panel(f"n{_pt}", "obsn", _pt)


def _labels(tag: str, panel: str) -> None:
    CTE[f"rise{tag}"] = f"""SELECT *, CASE WHEN commodity_id = 'PROMO' THEN 0.8 WHEN commodity_id IN ('LARGE', 'SMALL') THEN 1.2 ELSE 1.0 END AS thr,
        price / lag(price, 14) OVER ({W}) - 1 AS r14 FROM {panel}"""
    CTE[f"spikes{tag}"] = f"SELECT *, CASE WHEN r14 IS NOT NULL THEN (r14 > thr)::INT END AS spike, coalesce((r14 > thr)::INT, 0) AS s0 FROM rise{tag}"
    CTE[f"onsets{tag}"] = f"""SELECT *, (s0 = 1 AND coalesce(max(s0) OVER ({W} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 0) = 0)::INT AS onset FROM spikes{tag}"""
    CTE[f"marked{tag}"] = f"""SELECT *, CASE WHEN count(r14) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING) >= 7 AND date <= max(date) OVER () - 14
        THEN max(onset) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING) END AS y, coalesce(spike = 0 AND price IS NOT NULL, false) AS eligible FROM onsets{tag}"""
    CTE[f"numbered{tag}"] = f"SELECT *, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY {SERIES}) AS n FROM marked{tag}"


_labels("", "panel")
_labels("n", "panelp")
CTE["panelp"] = "SELECT * FROM paneln1 WHERE province_id <> 0"
CTE["events_"] = f"""SELECT date, {SERIES}, r14 AS rise_at_onset, peak / price_before - 1 AS peak_rise_30d, spike_days, price_before, price AS price_at_onset FROM (
    SELECT *, lag(price, 14) OVER ({W}) AS price_before, max(price) OVER ({W} ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS peak,
    CASE WHEN s0 = 0 THEN 0 ELSE coalesce(first_value(CASE WHEN s0 = 0 THEN i END IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n + 1) - i END AS spike_days
    FROM numbered) WHERE onset = 1"""
CTE["pred"] = f"SELECT {SERIES}, date, y, ret AS score, 0.6::DOUBLE AS threshold FROM (SELECT *, ln(price) - lag(ln(price), 7) OVER ({W}) AS ret FROM marked) WHERE date >= DATE '1998-01-01' AND eligible AND y IS NOT NULL"
CTE["pairs"] = "SELECT d.doc_id, l.toxic AS y, l.quality AS g, d.n_chars::DOUBLE AS score FROM documents d JOIN labels l USING (doc_id)"
CTE["pv"] = """SELECT commodity_id, source, target, p_value, coef_sum FROM (SELECT p_type AS commodity_id, (l_suppkey % 7 + 1)::INT AS source, (l_partkey % 7 + 1)::INT AS target,
    min(((l_partkey * 37 + l_suppkey * 11) % 1000 + 1) / 1001.0::DOUBLE) AS p_value, sum(l_suppkey % 5 - 2)::DOUBLE AS coef_sum FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) WHERE source <> target"""
CTE["bh"] = """SELECT *, least(1.0, min(p_value * m / rank) OVER (PARTITION BY commodity_id ORDER BY p_value RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value
    FROM (SELECT *, count(*) OVER (PARTITION BY commodity_id) AS m, row_number() OVER (PARTITION BY commodity_id ORDER BY p_value) AS rank FROM pv)"""


def with_(body: str, **extra: str) -> str:
    """``body`` behind the CTEs that it names, and those that these name, in order."""
    every, order = CTE | extra, []

    def add(text: str) -> None:
        for name in every:
            if name not in order and re.search(rf"\b{name}\b", text) and text is not every[name]:
                add(every[name])
                if name not in order:
                    order.append(name)

    add(body)
    return f"WITH {', '.join(f'{n} AS MATERIALIZED ({every[n]})' for n in order)} {body}" if order else body
