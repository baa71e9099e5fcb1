"""Raw (landing) schemas: every raw column is a string, typed later in Silver."""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
RESCUED = "_rescued_data"
DEALT = "_dealt"

RAW_COLUMNS = {
    "supporters": (
        "supporter_id", "first_name", "age_band", "country", "city", "membership_tier",
        "favourite_player", "favourite_product_category", "registration_date",
        "email_opt_in", "season_ticket_holder",
    ),
    "web_events": (
        "supporter_id", "event_timestamp", "page_type", "page_name", "product_id",
        "match_id", "session_id", "event_type",
    ),
    "ecommerce_orders": (
        "supporter_id", "order_id", "product", "category", "quantity", "revenue",
        "purchase_timestamp",
    ),
    "ticket_orders": (
        "supporter_id", "match", "competition", "ticket_type", "ticket_price",
        "purchase_timestamp", "attended",
    ),
    "marketing_events": (
        "supporter_id", "campaign", "sent", "opened", "clicked", "converted", "timestamp",
    ),
}

SOURCES = tuple(RAW_COLUMNS)


def raw_schema(source: str, corrupt: bool = False) -> T.StructType:
    names = RAW_COLUMNS[source] + ((CORRUPT,) if corrupt else ())
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


SCORES_SCHEMA = T.StructType([
    T.StructField("supporter_id", T.StringType(), False),
    T.StructField("purchase_intent_score", T.IntegerType(), True),
    T.StructField("recommended_next_action", T.StringType(), True),
    T.StructField("genai_reason", T.StringType(), True),
    T.StructField("model_intent_prob", T.DoubleType(), True),
])

GOLD_COLUMNS = (
    "supporter_id", "first_name", "age_band", "country", "city", "membership_tier",
    "favourite_player", "favourite_product_category", "registration_date", "email_opt_in",
    "season_ticket_holder", "total_ticket_spend", "total_merchandise_spend",
    "total_customer_value", "matches_attended", "last_match_attended", "ticket_purchases",
    "merchandise_orders", "website_sessions_30d", "product_views_30d", "ticket_views_30d",
    "cart_abandons_30d", "membership_views_30d", "hospitality_views_30d",
    "marketing_opens_30d", "marketing_clicks_30d", "days_since_last_purchase",
    "days_since_last_activity", "engagement_score", "purchase_intent_score",
    "recommended_next_action", "recommendation_reason", "scored_at",
)

PROFILE_COLUMNS = (
    "supporter_id", "first_name", "age_band", "country", "city", "membership_tier",
    "favourite_player", "favourite_product_category", "season_ticket_holder",
    "total_ticket_spend", "total_merchandise_spend", "total_customer_value",
    "matches_attended", "ticket_views_30d", "product_views_30d", "cart_abandons_30d",
    "membership_views_30d", "marketing_opens_30d", "marketing_clicks_30d",
    "days_since_last_purchase", "days_since_last_activity", "engagement_score",
    "purchase_intent_score",
)

ACTIVATION_SCHEMA = T.StructType([
    T.StructField("activation_id", T.StringType(), False),
    T.StructField("supporter_id", T.StringType(), False),
    T.StructField("recommended_action", T.StringType()),
    T.StructField("selected_action", T.StringType()),
    T.StructField("campaign", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
    T.StructField("next_best_action", T.StringType()),
    T.StructField("campaign_objective", T.StringType()),
    T.StructField("recommended_channel", T.StringType()),
    T.StructField("campaign_message", T.StringType()),
    T.StructField("approved_by_user", T.StringType()),
    T.StructField("approved_at", T.TimestampNTZType()),
])

LOG_SCHEMA = T.StructType([*ACTIVATION_SCHEMA.fields, T.StructField("batch_id", T.StringType())])
