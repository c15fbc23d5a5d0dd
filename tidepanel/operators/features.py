"""The feature table and its groups: own price, national level, supply chain, neighbours, leaders, calendar, rain, identity."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Features
from . import weather
from .graph import over_neighbours
from .panel import SERIES, by_series, days_since, guarded, lag_of, numbered, rows

TAGS = {"prod": 4, "whole": 3, "modern": 2}  # price types beside the consumer's
IDENTITY = ["commodity_code", "category_code", "province_code"]
LABELS = ["y", "eligible", "spike_now", "onset_now"]


def national(labelled: DataFrame, level: DataFrame) -> DataFrame:
    """National returns and a series' distance from the national price; share of provinces that spike.

    ``labelled`` is a dense panel on the full product of commodities and provinces, ``level`` the national series.
    """
    n = level.select("commodity_id", "date", F.ln("price").alias("nx"), F.lit(0).alias("province_id"))
    n = n.select("commodity_id", "date", "nx", (F.col("nx") - lag_of("nx", 7)).alias("nat_ret_7"), (F.col("nx") - lag_of("nx", 14)).alias("nat_ret_14"))
    share = labelled.groupBy("commodity_id", "date").agg(F.avg("s0").alias("nat_spike_share"))
    share = share.select("*", (F.col("nat_spike_share") - lag_of("nat_spike_share", 7, ["commodity_id"])).alias("nat_spike_share_chg7"))
    x = labelled.join(share.join(n, ["commodity_id", "date"], "left"), ["commodity_id", "date"])
    x = x.select("*", (F.ln("price") - F.col("nx")).alias("rel_nat"))
    return x.select("*", (F.col("rel_nat") - lag_of("rel_nat", 14)).alias("rel_nat_chg14")).drop("nx")


def supply_chain(consumer: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Returns of producer, wholesale and modern prices and the margins between them and the consumer price."""
    x = consumer.select(*SERIES, "date", F.ln("price").alias("x"))
    for tag, p in others.items():
        x = x.join(p.select(*SERIES, "date", F.ln("price").alias(f"x_{tag}")), [*SERIES, "date"], "left")
    own = {}
    for tag in others:
        own |= {f"ret_{k}_{tag}": F.col(f"x_{tag}") - lag_of(f"x_{tag}", k) for k in (7, 14)}
    if "prod" in others:
        x = x.select("*", (F.col("x") - F.col("x_prod")).alias("margin_cons_prod"))
        m, over = F.col("margin_cons_prod"), rows(-89, 0)
        sd = guarded(F.stddev_samp(m), m, 30, over)
        own |= {"margin_cons_prod": m, "margin_cons_prod_chg14": m - lag_of(m, 14), "margin_cons_prod_z90": (m - guarded(F.avg(m), m, 30, over)) / F.when(sd > 1e-9, sd)}
    if "whole" in others:
        m = F.col("x") - F.col("x_whole")
        own |= {"margin_cons_whole": m, "margin_cons_whole_chg14": m - lag_of(m, 14)}
    if "whole" in others and "prod" in others:
        own["margin_whole_prod"] = F.col("x_whole") - F.col("x_prod")
    if "modern" in others:
        own["gap_modern"] = F.col("x_modern") - F.col("x")
    return x.select(*SERIES, "date", *[c.alias(n) for n, c in own.items()])


def _moves(labelled: DataFrame) -> DataFrame:
    x = labelled.select(*SERIES, "date", F.ln("price").alias("x"), "s0")
    return x.select("*", (F.col("x") - lag_of("x", 7)).alias("r7"), (F.col("x") - lag_of("x", 14)).alias("r14x"))


def neighbours(labelled: DataFrame, edges: DataFrame) -> DataFrame:
    """Means over the neighbouring provinces, missing values left out; spikes count over all neighbours."""
    x = _moves(labelled)
    n = over_neighbours(x, edges, nbr_ret_7_mean=F.avg("r7"), nbr_ret_14_mean=F.avg("r14x"), nbr_ret_7_max=F.max("r7"), nbr_spike_share=F.avg("s0"), nx=F.avg("x"))
    return x.join(n, [*SERIES, "date"]).select("*", (F.col("x") - F.col("nx")).alias("nbr_rel_price"))


def leaders(labelled: DataFrame, edges: DataFrame) -> DataFrame:
    """Means over each series' leading provinces; ``edges`` is (commodity_id, province_id, other)."""
    return over_neighbours(_moves(labelled), edges, by_commodity=True, lead_ret_7_mean=F.avg("r7"), lead_ret_14_mean=F.avg("r14x"), lead_spike_share=F.avg("s0"))


def _z(x: str, window: int, least: int) -> F.Column:
    c, over = F.col(x), rows(1 - window, 0)
    sd = guarded(F.stddev_samp(c), c, least, over)
    return (c - guarded(F.avg(c), c, least, over)) / F.when(sd > 1e-9, sd)


def own_price(cfg: Features = Features()) -> dict[str, F.Column]:
    """Features of a series' own price; needs columns x (log price), d1 (its change), r14, thr, s0, onset and i."""
    x = F.col("x")
    out = {f"ret_{k}": x - lag_of("x", k) for k in cfg.returns}
    out["ret_7_prev"] = lag_of("x", 7) - lag_of("x", 14)
    out |= {f"vol_{w}": guarded(F.stddev_samp("d1"), F.col("d1"), max(3, w // 2), rows(1 - w, 0)) for w in cfg.volatility}
    out |= {f"z_{w}": _z("x", w, w // 2) for w in cfg.zscores}
    out |= {"dist_max_90": x - guarded(F.max("x"), x, 30, rows(-89, 0)), "dist_min_90": x - guarded(F.min("x"), x, 30, rows(-89, 0)), "rel_365": x - guarded(F.avg("x"), x, 180, rows(-364, 0))}
    out |= {"ret_yoy": x - lag_of("x", 364), "seas_ret_14_ly": lag_of("x", 350) - lag_of("x", 364), "r14_now": F.col("r14"), "gap_to_threshold": F.col("thr") - F.col("r14")}
    return out | {"days_since_spike": days_since("s0").cast("double"), "n_onsets_365": F.sum("onset").over(rows(-364, 0)).cast("double")}


def _chain(names: list[str]) -> dict[str, F.Column]:
    """Features of the other price types that are there; needs their log prices x_tag and the margins m_prod, m_whole."""
    out = {f"ret_{k}_{t}": F.col(f"x_{t}") - lag_of(f"x_{t}", k) for t in names for k in (7, 14)}
    for t in ("prod", "whole"):
        if t in names:
            out |= {f"margin_cons_{t}": F.col(f"m_{t}"), f"margin_cons_{t}_chg14": F.col(f"m_{t}") - lag_of(f"m_{t}", 14)}
    if "prod" in names:
        out["margin_cons_prod_z90"] = _z("m_prod", 90, 30)
    if {"prod", "whole"} <= set(names):
        out["margin_whole_prod"] = F.col("x_whole") - F.col("x_prod")
    if "modern" in names:
        out["gap_modern"] = F.col("x_modern") - F.col("x")
    return out


def rain_features(anomaly: DataFrame, centres: tuple[int, ...], lags: tuple[int, ...] = (30, 60)) -> tuple[DataFrame, DataFrame]:
    """Anomalies with the 30-day one moved by ``lags`` days, by province and date, and their means over ``centres`` by date.

    Moved by days, not rows, so they go on past the last day of rain.
    """
    by = anomaly
    for k in lags:
        by = by.join(weather.lagged(anomaly, "rain_30_anom", k), ["province_id", "date"], "full")
    names = [c for c in by.columns if c.startswith("rain_")]
    one = anomaly.where(F.col("province_id").isin(*centres)).groupBy("date").agg(*[F.avg(c).alias(f"{c}_centre") for c in anomaly.columns if c.startswith("rain_")])
    centre = one
    for k in lags:
        centre = centre.join(one.select(F.date_add("date", k).alias("date"), F.col("rain_30_anom_centre").alias(f"rain_30_anom_lag{k}_centre")), "date", "full")
    return by.select("province_id", "date", *names), centre


def build_features(labelled: DataFrame, panels: dict[int, DataFrame], near: DataFrame, leading: DataFrame | None, calendar: DataFrame, rain: DataFrame | None, codes: DataFrame, cfg: Features = Features()) -> DataFrame:
    """One row for each priced weekday cell from ``cfg.min_date`` on: keys, all feature groups, labels.

    ``labelled`` is the consumer panel of provinces with its labels, ``panels`` all price types, with national series as
    province 0 where there are any.  ``near`` (province_id, other) and ``leading`` (commodity_id, province_id,
    other) are edges, ``codes`` (commodity_id, commodity_code, category_code) numbers.  Groups whose input is missing are left out.

    Log prices of all types are joined first, by series and date, so every window of a series is over one
    partitioning and one order.  What goes by commodity, date or province is computed on its own short key and joined.
    """
    tags = [t for t, k in TAGS.items() if k in panels]
    x = numbered(labelled).select("*", F.ln("price").alias("x"))
    for t in tags:
        x = x.join(panels[TAGS[t]].where("province_id <> 0").select(*SERIES, "date", F.ln("price").alias(f"x_{t}")), [*SERIES, "date"], "left")
    nat = panels[1].where("province_id = 0").select("commodity_id", "date", F.ln("price").alias("nx"))
    x = by_series(x.join(nat, ["commodity_id", "date"], "left"))
    x = x.select("*", (F.col("x") - lag_of("x", 1)).alias("d1"), *[(F.col("x") - F.col(f"x_{t}")).alias(f"m_{t}") for t in tags], (F.col("x") - F.col("nx")).alias("rel_nat"))
    made = own_price(cfg) | _chain(tags) | {"rel_nat_chg14": F.col("rel_nat") - lag_of("rel_nat", 14)}
    own = x.select(*SERIES, "date", "price", "rel_nat", *[c.alias(n) for n, c in made.items()], "y", F.col("eligible").cast("int").alias("eligible"), F.col("spike").alias("spike_now"), F.col("onset").alias("onset_now"))
    kept = own.where((F.col("price").isNotNull()) & (F.col("date") >= F.lit(cfg.min_date).cast("date")) & ((F.weekday("date") < 5) if cfg.weekdays_only else F.lit(True)))

    by = ["commodity_id"]
    level = nat
    for t in tags:
        level = level.join(panels[TAGS[t]].where("province_id = 0").select("commodity_id", "date", F.ln("price").alias(f"nx_{t}")), ["commodity_id", "date"], "left")
    margin = [(F.col("nx") - F.col("nx_prod")).alias("nat_margin_cons_prod")] if "prod" in tags else []
    level = level.select("*", *margin)
    nats = [(F.col("nx") - lag_of("nx", k, by)).alias(f"nat_ret_{k}") for k in (7, 14)] + [(F.col(f"nx_{t}") - lag_of(f"nx_{t}", 14, by)).alias(f"nat_ret_14_{t}") for t in tags]
    if margin:
        nats += ["nat_margin_cons_prod", (F.col("nat_margin_cons_prod") - lag_of("nat_margin_cons_prod", 14, by)).alias("nat_margin_cons_prod_chg14")]
    level = level.select("commodity_id", "date", *nats)
    share = labelled.groupBy("commodity_id", "date").agg(F.avg("s0").alias("nat_spike_share"))
    share = share.select("*", (F.col("nat_spike_share") - lag_of("nat_spike_share", 7, by)).alias("nat_spike_share_chg7"))
    around = neighbours(labelled, near).drop("x", "s0", "r7", "r14x", "nx")
    out = kept.join(level, ["commodity_id", "date"], "left").join(share, ["commodity_id", "date"], "left").join(around, [*SERIES, "date"], "left")
    if leading is not None:
        out = out.join(leaders(labelled, leading), [*SERIES, "date"], "left")
    out = out.join(calendar, "date", "left")
    if rain is not None:
        local, centre = rain_features(rain, cfg.centre_provinces)
        out = out.join(local, ["province_id", "date"], "left")
        out = out.join(centre, "date", "left") if cfg.centre_provinces else out
    out = out.join(F.broadcast(codes), "commodity_id", "left").withColumn("province_code", F.col("province_id"))  # codes: a row for each commodity
    names = [c for c in out.columns if c not in (*SERIES, "date", "price", *IDENTITY, *LABELS)]
    return out.select(*SERIES, "date", *names, *IDENTITY, *LABELS)


def modeling_rows(features: DataFrame) -> DataFrame:
    """Rows to train and test on: no spike now, and a label."""
    return features.where("eligible = 1 and y is not null")


GROUPS = {
    "price": r"^(ret_\d+|ret_7_prev|vol_\d+|z_\d+|dist_(max|min)_90|rel_365|ret_yoy|seas_ret_14_ly|r14_now|gap_to_threshold|days_since_spike|n_onsets_365)$",
    "national": r"^(nat_ret_(7|14)|rel_nat(_chg14)?|nat_spike_share(_chg7)?)$",
    "supply_chain": r"^((ret_(7|14)|nat_ret_14)_(prod|whole|modern)|(nat_)?margin_.*|gap_modern)$",
    "neighbours": r"^nbr_", "leaders": r"^lead_", "calendar": r"^(days_to_.*|days_since_(?!spike).*|is_.*|doy_.*|dow)$", "rain": r"^rain_", "identity": r"_code$",
}


def group_of(feature: str) -> str:
    """The group that a feature belongs to, by its name."""
    return next((g for g, p in GROUPS.items() if re.search(p, feature)), "other")


def feature_columns(columns: list[str], without: tuple[str, ...] = ()) -> list[str]:
    """Features among ``columns``, those of the groups ``without`` left out."""
    return [c for c in columns if c not in (*SERIES, "date", "price", *LABELS) and group_of(c) != "other" and group_of(c) not in without]
