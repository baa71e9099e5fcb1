"""Ordered rule tables compiled to one CASE expression, and label lookups."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from audience_lens import config as C
from audience_lens.config import EngineConfig


@dataclass(frozen=True)
class Rule:
    condition: Column
    action: str
    reason: Column | None = None


def rule_table(rules: Iterable[tuple[Column, Column]], default: Column) -> Column:
    """First matching (condition, value) wins."""
    chain = F
    for condition, value in rules:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def is_non_member(tier: str = "membership_tier") -> Column:
    return F.col(tier).isin(*C.NON_MEMBER_TIERS)


def is_member(tier: str = "membership_tier") -> Column:
    return ~is_non_member(tier)


def _says(*parts: Column | str) -> Column:
    """Sentence about the supporter; NULL when the first name is NULL."""
    return F.concat(F.col("first_name"), *[F.lit(p) if isinstance(p, str) else p.cast("string")
                                           for p in parts])


# Order of the rules, action labels and reason sentences.
def baseline_rules(cfg: EngineConfig) -> list[Rule]:
    t = cfg.baseline
    col = F.col
    pounds = F.round("total_customer_value", 0).cast("bigint")
    return [
        Rule((col("ticket_views_30d") >= t.ticket_views) & (col("ticket_purchases") <= t.max_purchases),
             C.MATCH_TICKET,
             _says(" viewed match tickets ", col("ticket_views_30d"),
                   " times in the last 30 days but has not purchased.")),
        Rule((col("matches_attended") >= t.hospitality_attended)
             & (col("total_customer_value") >= t.hospitality_value),
             C.HOSPITALITY,
             _says(" attended ", col("matches_attended"), " matches and has spent £", pounds,
                   " - a strong hospitality candidate.")),
        Rule((col("matches_attended") >= t.upgrade_attended) & is_non_member(),
             C.MEMBERSHIP_UPGRADE,
             _says(" attended ", col("matches_attended"),
                   " matches this season but is not a paying member.")),
        Rule((col("product_views_30d") >= t.product_views) | (col("cart_abandons_30d") >= t.carts),
             cfg.merchandise,
             _says(" browsed merchandise ", col("product_views_30d"), " times with ",
                   col("cart_abandons_30d"), " abandoned baskets recently.")),
        Rule((col("membership_views_30d") >= t.membership_views) & is_non_member(),
             C.MEMBERSHIP_UPGRADE,
             _says(" visited membership pages ", col("membership_views_30d"),
                   " times in the last 30 days.")),
        Rule(col("days_since_last_activity") >= t.inactive_days,
             C.REENGAGEMENT,
             _says(" has had no meaningful interaction for ", col("days_since_last_activity"),
                   " days.")),
        Rule(col("hospitality_views_30d") >= t.hospitality_views,
             C.HOSPITALITY,
             _says(" has shown interest in hospitality experiences recently.")),
    ]


# Order of the rules and action labels.
def overlay_rules(cfg: EngineConfig) -> list[Rule]:
    t = cfg.overlay
    col = F.col
    return [
        Rule((col("ticket_views_30d") >= t.ticket_views) & (col("ticket_purchases") <= t.max_purchases),
             C.MATCH_TICKET),
        Rule((col("total_customer_value") >= t.hospitality_value)
             & (col("matches_attended") >= t.hospitality_attended), C.HOSPITALITY),
        Rule(((col("matches_attended") >= t.upgrade_attended)
              | (col("membership_views_30d") >= t.membership_views)) & is_non_member(),
             C.MEMBERSHIP_UPGRADE),
        Rule((col("product_views_30d") >= t.product_views) | (col("cart_abandons_30d") >= t.carts),
             cfg.merchandise),
        Rule(col("hospitality_views_30d") >= t.hospitality_views, C.HOSPITALITY),
        Rule(col("days_since_last_activity") >= t.inactive_days, C.REENGAGEMENT),
    ]


def baseline_nba(cfg: EngineConfig) -> Column:
    return rule_table([(r.condition, F.lit(r.action)) for r in baseline_rules(cfg)],
                      F.lit(C.STADIUM_TOUR))


def baseline_reason(cfg: EngineConfig) -> Column:
    return rule_table([(r.condition, r.reason) for r in baseline_rules(cfg)],
                      _says(" is an engaged supporter - nurture with an experience offer."))


def overlay_nba(cfg: EngineConfig) -> Column:
    return rule_table([(r.condition, F.lit(r.action)) for r in overlay_rules(cfg)],
                      F.lit(C.STADIUM_TOUR))


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def opportunity_type(action: Column, cfg: EngineConfig) -> Column:
    return _lookup(F.coalesce(action, F.lit(C.STADIUM_TOUR)), cfg.opportunity_of, C.EXPERIENCE)


def action_meta(action: Column, cfg: EngineConfig) -> tuple[Column, Column, Column]:
    """(channel, primary KPI, supporting KPI) of an action, with a fallback for others."""
    key = F.coalesce(action, F.lit(C.STADIUM_TOUR))
    return tuple(
        _lookup(key, {a: m[i] for a, m in cfg.action_meta.items()}, C.DEFAULT_ACTION_META[i])
        for i in range(3)
    )


def opportunity_meta(kind: Column) -> tuple[Column, Column, Column, Column]:
    """(description, action, owner, KPI) of an opportunity type, NULL for an unknown one."""
    return tuple(
        F.element_at(F.create_map(*[F.lit(x) for t, m in C.OPPORTUNITY_META.items() for x in (t, m[i])]),
                     kind)
        for i in range(4)
    )


def tier_ordinal(tier: str = "membership_tier") -> Column:
    pairs = [F.lit(x) for i, t in enumerate(C.TIERS) for x in (t, i)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(tier)), F.lit(0))
