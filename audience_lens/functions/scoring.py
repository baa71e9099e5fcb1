"""Score formulas as column expressions over the 360 feature columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from audience_lens.config import INTENT_BANDS, NEVER, NEVER_DAYS, EngineConfig
from audience_lens.functions.cleaning import moment


def never() -> Column:
    return moment(NEVER)


def ref_ts(cfg: EngineConfig) -> Column:
    return moment(cfg.ref_ts)


def in_window(ts: str, cfg: EngineConfig) -> Column:
    """Inside the recent window; only a lower bound, as future rows count too."""
    return F.col(ts) >= moment(cfg.window_start)


def latest(*ts: str) -> Column:
    """Latest of several nullable timestamps, the sentinel when all are NULL."""
    return F.greatest(*[F.coalesce(F.col(t), never()) for t in ts]) if len(ts) > 1 else (
        F.coalesce(F.col(ts[0]), never()))


def recency_days(last: str, cfg: EngineConfig, when_never: int = NEVER_DAYS) -> Column:
    """Calendar days from the reference time; ``when_never`` for the sentinel."""
    return F.when(F.col(last) == never(), F.lit(when_never)).otherwise(
        F.datediff(ref_ts(cfg), F.col(last)))


def _clamp(c: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.round(c, 0))).cast("int")


def engagement_score(cfg: EngineConfig) -> Column:
    w = cfg.engagement
    idle = F.greatest(F.lit(0), F.col("days_since_last_activity") - w.grace_days)
    return _clamp(
        F.col("website_sessions_30d") * F.lit(w.sessions)
        + F.col("product_views_30d") * F.lit(w.product_views)
        + F.col("ticket_views_30d") * F.lit(w.ticket_views)
        + F.col("marketing_opens_30d") * F.lit(w.opens)
        + F.col("matches_attended") * F.lit(w.attended)
        - idle * F.lit(w.idle_day)
    )


def baseline_intent(cfg: EngineConfig) -> Column:
    """Needs ``last_purchase_ts``: never purchased counts as 60 days here, not as 999."""
    w = cfg.intent
    idle = recency_days("last_purchase_ts", cfg, w.never_purchased_days)
    return _clamp(
        F.col("ticket_views_30d") * F.lit(w.ticket_views)
        + F.col("product_views_30d") * F.lit(w.product_views)
        + F.col("cart_abandons_30d") * F.lit(w.carts)
        + F.col("membership_views_30d") * F.lit(w.membership_views)
        + F.col("hospitality_views_30d") * F.lit(w.hospitality_views)
        + F.col("marketing_clicks_30d") * F.lit(w.clicks)
        + F.col("matches_attended") * F.lit(w.attended)
        - idle * F.lit(w.idle_day)
    )


def behaviour_signal(cfg: EngineConfig) -> Column:
    w = cfg.signal
    raw = (
        F.col("ticket_views_30d") * w.ticket_views
        + F.col("cart_abandons_30d") * w.carts
        + F.col("membership_views_30d") * w.membership_views
        + F.col("product_views_30d") * w.product_views
        + F.col("hospitality_views_30d") * w.hospitality_views
    )
    return F.least(F.lit(100), F.greatest(F.lit(0), raw))


def blended_intent(probability: Column, cfg: EngineConfig) -> Column:
    """Probability and behaviour signal blended; rounds half to even."""
    w = cfg.signal
    mix = F.lit(w.model_share) * (probability * 100.0) + F.lit(w.signal_share) * behaviour_signal(cfg)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.bround(mix, 0))).cast("int")


def intent_band(score: Column | str) -> Column:
    score = F.coalesce(F.col(score) if isinstance(score, str) else score, F.lit(0))
    (low, _), (mid, mid_from), (high, high_from) = INTENT_BANDS
    return (F.when(score >= high_from, high).when(score >= mid_from, mid).otherwise(low))
