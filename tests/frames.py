"""Small hand-made frames."""

from audience_lens.schemas import RAW_COLUMNS, raw_schema

FEATURE_TYPES = {
    "supporter_id": "string", "first_name": "string", "membership_tier": "string",
    "ticket_views_30d": "bigint", "ticket_purchases": "bigint", "matches_attended": "bigint",
    "total_customer_value": "double", "product_views_30d": "bigint", "cart_abandons_30d": "bigint",
    "membership_views_30d": "bigint", "hospitality_views_30d": "bigint",
    "days_since_last_activity": "int", "website_sessions_30d": "bigint",
    "marketing_opens_30d": "bigint", "marketing_clicks_30d": "bigint",
}
DEFAULTS = {"supporter_id": "S1", "first_name": "Ada", "membership_tier": "Gold", "ticket_purchases": 1,
            "total_customer_value": 0.0}


def features(spark, *rows, **types):
    """Feature rows; unstated counts are 0, one ticket purchase, Gold tier."""
    all_types = FEATURE_TYPES | types
    schema = ", ".join(f"{n} {t}" for n, t in all_types.items())
    data = [tuple(r.get(n, DEFAULTS.get(n, 0 if n in FEATURE_TYPES else None)) for n in all_types)
            for r in rows]
    return spark.createDataFrame(data, schema)


def raw(spark, source, *rows):
    names = RAW_COLUMNS[source]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], raw_schema(source))


ORDER = {"supporter_id": "S1", "order_id": "O1", "product": "Scarf", "category": "Retro", "quantity": "1",
         "revenue": "10.0", "purchase_timestamp": "2025-09-01 10:00:00"}
TICKET = {"supporter_id": "S1", "match": "A vs B", "competition": "Cup", "ticket_type": "Club Level",
          "ticket_price": "50", "purchase_timestamp": "2025-09-01 10:00:00", "attended": "True"}
WEB = {"supporter_id": "S1", "event_timestamp": "2025-09-10 10:00:00", "page_type": "Store",
       "page_name": "Cart", "product_id": "P1001", "match_id": "", "session_id": "SESS1",
       "event_type": "added_to_cart"}
MAIL = {"supporter_id": "S1", "campaign": "Membership Drive", "sent": "True", "opened": "True",
        "clicked": "False", "converted": "False", "timestamp": "2025-09-05 08:00:00"}
PERSON = {"supporter_id": "S1", "first_name": "ada", "age_band": "18-24", "country": "United Kingdom",
          "city": "London", "membership_tier": "Free", "favourite_player": "P", "email_opt_in": "True",
          "favourite_product_category": "Retro", "registration_date": "2020-01-01",
          "season_ticket_holder": "False"}
