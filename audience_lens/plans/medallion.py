"""Silver -> features -> 360 -> served view, composed from the operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from audience_lens.config import EngineConfig
from audience_lens.functions.cleaning import moment
from audience_lens.operators import features as ft
from audience_lens.operators import intent_ml
from audience_lens.operators.activity import activity_feed
from audience_lens.operators.silver import CLEANERS


@dataclass(frozen=True)
class Silver:
    supporters: DataFrame
    web_events: DataFrame
    ecommerce_orders: DataFrame
    ticket_orders: DataFrame
    marketing_events: DataFrame


def build_silver(raw: Mapping[str, DataFrame]) -> Silver:
    return Silver(**{source: clean(raw[source]) for source, clean in CLEANERS.items()})


def as_of(silver: Silver, cutoff: dt.datetime) -> Silver:
    """The same layer as it was known before ``cutoff``; the dimension is kept."""
    def before(df: DataFrame, at: str) -> DataFrame:
        return df.filter(F.col(at) < moment(cutoff))

    return replace(
        silver,
        web_events=before(silver.web_events, "event_timestamp"),
        ecommerce_orders=before(silver.ecommerce_orders, "purchase_timestamp"),
        ticket_orders=before(silver.ticket_orders, "purchase_timestamp"),
        marketing_events=before(silver.marketing_events, "event_timestamp"),
    )


def build_base(silver: Silver, cfg: EngineConfig) -> DataFrame:
    return ft.base_360(
        silver.supporters,
        ft.web_features(silver.web_events, cfg),
        ft.ecom_features(silver.ecommerce_orders),
        ft.ticket_features(silver.ticket_orders),
        ft.marketing_features(silver.marketing_events, cfg),
    )


def build_scored(silver: Silver, cfg: EngineConfig) -> DataFrame:
    """360 with the rule baseline; the frame that models train on."""
    return ft.score_360(build_base(silver, cfg), cfg)


def build_360(silver: Silver, cfg: EngineConfig, ml: DataFrame | None = None) -> DataFrame:
    return ft.overlay_scores(build_scored(silver, cfg), ml, cfg)


def build_activity(silver: Silver) -> DataFrame:
    return activity_feed(silver.web_events, silver.ecommerce_orders, silver.ticket_orders,
                         silver.marketing_events)


def leak_free_frame(silver: Silver, cfg: EngineConfig) -> DataFrame:
    """Features known before the last window and the label of that window: no shared rows."""
    cutoff = cfg.window_start
    known = build_scored(as_of(silver, cutoff), replace(cfg, ref_ts=cutoff))
    labels = intent_ml.engagement_label(silver.marketing_events, cfg, (cutoff, cfg.ref_ts - cutoff))
    return intent_ml.feature_frame(known, labels)
