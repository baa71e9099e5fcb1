"""Frozen business parameters: reference time, windows, weights, thresholds."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from decimal import Decimal


# Membership tiers in ascending order; the first two are not members.
TIERS = ("None", "Free", "Silver", "Gold", "Red Member")
NON_MEMBER_TIERS = ("None", "Free")

# Known click-stream event types and the page each one lands on.
EVENT_PAGES = {
    "viewed_match_ticket": ("Tickets", "Buy Match Tickets"),
    "viewed_home_shirt": ("Store", "2024/25 Home Shirt"),
    "viewed_away_shirt": ("Store", "2024/25 Away Shirt"),
    "added_to_cart": ("Store", "Cart"),
    "abandoned_cart": ("Store", "Cart Abandoned"),
    "viewed_membership": ("Membership", "Become a Member"),
    "viewed_hospitality": ("Hospitality", "Club Level & Boxes"),
    "viewed_stadium_tour": ("Experience", "Stadium Tour"),
    "viewed_fixtures": ("Fixtures", "Upcoming Fixtures"),
    "viewed_news": ("News", "Latest News"),
}

# Action labels.
MATCH_TICKET = "Match Ticket"
MEMBERSHIP_UPGRADE = "Membership Upgrade"
HOSPITALITY = "Hospitality"
REENGAGEMENT = "Re-engagement Campaign"
STADIUM_TOUR = "Stadium Tour"

# Opportunity types.
TICKET_INTENT = "Ticket Intent"
MEMBERSHIP_OPPORTUNITY = "Membership Opportunity"
MERCHANDISE_OPPORTUNITY = "Merchandise Opportunity"
HOSPITALITY_OPPORTUNITY = "Hospitality Opportunity"
REENGAGEMENT_OPPORTUNITY = "Re-engagement"
EXPERIENCE = "Experience"

# Intent bands, lower bound inclusive.
INTENT_BANDS = (("0-39 Low", 0), ("40-69 Medium", 40), ("70-100 High", 70))
HIGH_INTENT = 70

# Fixed values: "never happened" markers of the recency columns.
NEVER = dt.datetime(2000, 1, 1)
NEVER_DAYS = 999


# Fixed values, down to BusinessAssumptions: weights, limits and rates of the rules.
@dataclass(frozen=True)
class EngagementWeights:
    sessions: Decimal = Decimal("3.0")
    product_views: Decimal = Decimal("1.2")
    ticket_views: Decimal = Decimal("2.0")
    opens: Decimal = Decimal("2.0")
    attended: Decimal = Decimal("5.0")
    grace_days: int = 30
    idle_day: Decimal = Decimal("0.3")


@dataclass(frozen=True)
class IntentWeights:
    ticket_views: Decimal = Decimal("6.0")
    product_views: Decimal = Decimal("2.0")
    carts: Decimal = Decimal("8.0")
    membership_views: Decimal = Decimal("5.0")
    hospitality_views: Decimal = Decimal("6.0")
    clicks: Decimal = Decimal("4.0")
    attended: Decimal = Decimal("2.0")
    never_purchased_days: int = 60
    idle_day: Decimal = Decimal("0.3")


@dataclass(frozen=True)
class SignalWeights:
    """Behaviour signal of the model overlay and its blend with the probability."""

    ticket_views: int = 6
    carts: int = 8
    membership_views: int = 5
    product_views: int = 2
    hospitality_views: int = 6
    model_share: float = 0.7
    signal_share: float = 0.3


@dataclass(frozen=True)
class BaselineThresholds:
    """Rule list used when no model score exists."""

    ticket_views: int = 3
    max_purchases: int = 0
    hospitality_attended: int = 4
    hospitality_value: float = 400.0
    upgrade_attended: int = 3
    product_views: int = 4
    carts: int = 1
    membership_views: int = 1
    inactive_days: int = 60
    hospitality_views: int = 1


@dataclass(frozen=True)
class OverlayThresholds:
    """Rule list of the model overlay; order and limits differ from the baseline."""

    ticket_views: int = 2
    max_purchases: int = 0
    hospitality_attended: int = 3
    hospitality_value: float = 350.0
    upgrade_attended: int = 2
    membership_views: int = 1
    product_views: int = 3
    carts: int = 1
    hospitality_views: int = 1
    inactive_days: int = 60


@dataclass(frozen=True)
class BusinessAssumptions:
    baseline_conversion_pct: float = 8.0
    expected_uplift_pct: float = 25.0
    contribution_margin_pct: float = 60.0
    annual_platform_cost: float = 120_000.0
    representative_base: int = 250_000


@dataclass(frozen=True)
class EngineConfig:
    ref_ts: dt.datetime = dt.datetime(2025, 9, 20, 12, 0, 0)  # fixed value
    window_days: int = 30
    brand: str = "Club"
    home_country: str = "United Kingdom"
    enriched_reasons: int = 120
    engagement: EngagementWeights = field(default_factory=EngagementWeights)
    intent: IntentWeights = field(default_factory=IntentWeights)
    signal: SignalWeights = field(default_factory=SignalWeights)
    baseline: BaselineThresholds = field(default_factory=BaselineThresholds)
    overlay: OverlayThresholds = field(default_factory=OverlayThresholds)
    business: BusinessAssumptions = field(default_factory=BusinessAssumptions)

    @property
    def merchandise(self) -> str:
        return f"{self.brand} Shirt / Merchandise"

    @property
    def window_start(self) -> dt.datetime:
        return self.ref_ts - dt.timedelta(days=self.window_days)

    @property
    def opportunity_of(self) -> dict[str, str]:
        """Action label -> opportunity type (fixed values)."""
        return {
            MATCH_TICKET: TICKET_INTENT,
            MEMBERSHIP_UPGRADE: MEMBERSHIP_OPPORTUNITY,
            self.merchandise: MERCHANDISE_OPPORTUNITY,
            HOSPITALITY: HOSPITALITY_OPPORTUNITY,
            REENGAGEMENT: REENGAGEMENT_OPPORTUNITY,
            STADIUM_TOUR: EXPERIENCE,
        }

    # Channel, primary KPI and supporting KPI per action.
    @property
    def action_meta(self) -> dict[str, tuple[str, str, str]]:
        return {
            MATCH_TICKET: ("Email / App Push", "Ticket conversion", "Revenue per targeted supporter"),
            MEMBERSHIP_UPGRADE: ("Email / Direct Mail", "Membership conversion", "Membership revenue"),
            self.merchandise: ("Email / Retargeting", "Merchandise conversion", "Merchandise revenue"),
            HOSPITALITY: (
                "Account Manager Outreach / Email", "Hospitality utilisation", "Hospitality revenue",
            ),
            REENGAGEMENT: ("Email / App Push", "Reactivation rate", "Retained supporter value"),
            STADIUM_TOUR: ("Email / App Push", "Experience uptake", "Engagement score"),
        }


# Channel and KPIs of an action outside the table.
DEFAULT_ACTION_META = ("Email", "Engagement", "Revenue per supporter")

# Description, action, owner and KPI per opportunity type.
OPPORTUNITY_META = {
    TICKET_INTENT: (
        "Viewed tickets multiple times but have not purchased.",
        "Match Ticket Offer", "Ticketing / Fan Engagement", "Ticket conversion",
    ),
    MEMBERSHIP_OPPORTUNITY: (
        "Frequent match attendees who are not currently members.",
        "Membership Upgrade", "Head of Membership / Fan Engagement", "Membership conversion",
    ),
    MERCHANDISE_OPPORTUNITY: (
        "High product browsing or abandoned baskets.",
        "Merchandise Reminder", "Retail / Ecommerce", "Merchandise revenue",
    ),
    HOSPITALITY_OPPORTUNITY: (
        "High spend and attendance — premium experience candidates.",
        "Hospitality Invite", "Commercial / Hospitality", "Hospitality utilisation / revenue",
    ),
    REENGAGEMENT_OPPORTUNITY: (
        "No meaningful interaction during the last 60 days.",
        "Re-engagement Campaign", "CRM / Fan Engagement", "Reactivation rate",
    ),
    EXPERIENCE: (
        "Engaged supporters to nurture with an experience offer.",
        "Stadium Tour", "Fan Engagement", "Experience uptake",
    ),
}
