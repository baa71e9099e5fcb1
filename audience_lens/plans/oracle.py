"""SQL twins of the registered queries, written for DuckDB on the same parquet tables.

``LAYERS`` holds one CTE per layer with the layers it needs; a twin is the chain of its layers
plus one final SELECT. Dates and times are printed as text, as ``registry.portable`` does.
"""

from __future__ import annotations

REF = "TIMESTAMP '2024-01-31 00:00:00'"
SINCE = "TIMESTAMP '2024-01-24 00:00:00'"
NEVER = "TIMESTAMP '2000-01-01 00:00:00'"
SHIFT = "INTERVAL 8122 DAY"
NON_MEMBER = "membership_tier IN ('None', 'Free')"

# Product categories and campaign names.
CATEGORIES = ("['Home Shirt', 'Away Shirt', 'Third Kit', 'Training Wear', 'Accessories', 'Retro', "
              "'Kids', 'Hospitality']")
CAMPAIGNS = ("['Season Ticket Renewal', 'New Home Kit Launch', 'Membership Drive', "
             "'Champions League Hospitality', 'Black Friday Store', 'Matchday Ticket Alert', "
             "'Stadium Tour Promo', 'International Fan Club', 'Re-engagement Winback']")


def blank(c: str) -> str:
    return f"NULLIF(TRIM(CAST({c} AS VARCHAR)), '')"


def title(c: str) -> str:
    return (f"array_to_string(list_transform(string_split(lower(TRIM({c})), ' '), "
            "lambda w: upper(w[1:1]) || w[2:]), ' ')")


def true(c: str) -> str:
    return f"(lower({c}) = 'true')"


def micro(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def total(c: str) -> str:
    return f"CAST(ROUND(SUM(CAST({c} AS DECIMAL(18,4))), 2) AS DOUBLE)"


def cents(c: str) -> str:
    return f"CAST(COALESCE({c}, 0) AS DECIMAL(18,2))"


def whole(c: str) -> str:
    return f"CAST(round_even(CAST({c} AS DOUBLE), 0) AS BIGINT)"


def first_by(key: str, order: str, columns: list[str]) -> str:
    rest = ", ".join(f"{c} ASC NULLS FIRST" for c in columns if c not in (key, order))
    return f"row_number() OVER (PARTITION BY {key} ORDER BY {order} ASC NULLS FIRST, {rest})"


SUP = ["supporter_id", "first_name", "age_band", "country", "city", "membership_tier",
       "favourite_player", "favourite_product_category", "registration_date", "email_opt_in",
       "season_ticket_holder"]
MERCH = ["supporter_id", "order_id", "product", "category", "quantity", "revenue",
         "purchase_timestamp"]
TIX = ["supporter_id", "match", "competition", "ticket_type", "ticket_price",
       "purchase_timestamp", "attended"]
WEB = ["supporter_id", "event_timestamp", "page_type", "page_name", "product_id", "match_id",
       "session_id", "event_type"]
MKT = ["supporter_id", "campaign", "sent", "opened", "clicked", "converted"]


def cols(names: list[str]) -> str:
    return ", ".join(f'"{n}"' for n in names)


LAYERS: dict[str, tuple[tuple[str, ...], str]] = {}


def layer(name: str, needs: str, sql: str) -> None:
    LAYERS[name] = (tuple(needs.split()), sql)


# ---- raw --------------------------------------------------------------------------------

layer("raw_supporters", "", f"""
  SELECT CASE cp WHEN 'empty_id' THEN '' WHEN 'null_id' THEN NULL ELSE 'S' || c_custkey END AS supporter_id,
    '  ' || lower(c_name) || ' ' AS first_name,
    CASE WHEN c_acctbal < 0 THEN '' WHEN c_acctbal < 2000 THEN '18-24' WHEN c_acctbal < 4000 THEN '25-34'
         WHEN c_acctbal < 6000 THEN '35-44' WHEN c_acctbal < 8000 THEN '45-54' ELSE '55-64' END AS age_band,
    n_name AS country, r_name AS city,
    CASE WHEN c_custkey % 307 = 3 THEN 'Platinum' WHEN c_custkey % 10 = 0 THEN '  ' || tier || ' '
         ELSE tier END AS membership_tier,
    'Player ' || (c_custkey % 11 + 1) AS favourite_player,
    {CATEGORIES}[c_custkey % 8 + 1] AS favourite_product_category,
    CASE WHEN c_custkey % 173 = 11 THEN 'unknown' ELSE strftime(DATE '2016-01-01'
         + CAST(c_custkey % 2900 AS INT) + CASE WHEN cp = 'replay' THEN 1 ELSE 0 END, '%Y-%m-%d')
         END AS registration_date,
    CASE WHEN c_custkey % 100 < 82 THEN 'True' ELSE 'False' END AS email_opt_in,
    CASE WHEN tier IN ('Gold', 'Red Member') AND c_custkey % 10 < 6 THEN 'true' ELSE 'FALSE' END
      AS season_ticket_holder
  FROM (
    SELECT *, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'None' WHEN 'FURNITURE' THEN 'Free'
                WHEN 'BUILDING' THEN 'Silver' WHEN 'MACHINERY' THEN 'Gold'
                WHEN 'AUTOMOBILE' THEN 'Red Member' END AS tier
    FROM (SELECT *, 'row' AS cp FROM customer
          UNION ALL SELECT *, 'replay' FROM customer WHERE c_custkey % 89 = 4
          UNION ALL SELECT *, 'empty_id' FROM customer WHERE c_custkey % 422 = 7
          UNION ALL SELECT *, 'null_id' FROM customer WHERE c_custkey % 422 = 218)
  ) c LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")

layer("raw_web", "", """
  SELECT CASE WHEN event_id % 503 = 3 THEN '' WHEN event_id % 503 = 5 THEN NULL ELSE 'S' || user_id END
      AS supporter_id,
    CASE WHEN event_id % 509 <> 11 THEN ts END AS event_timestamp,
    CASE WHEN e IN ('viewed_home_shirt', 'viewed_away_shirt', 'added_to_cart', 'abandoned_cart') THEN 'Store'
         WHEN e = 'viewed_match_ticket' THEN 'Tickets' WHEN e = 'viewed_membership' THEN 'Membership'
         WHEN e = 'viewed_hospitality' THEN 'Hospitality' WHEN e = 'viewed_stadium_tour' THEN 'Experience'
         WHEN e = 'viewed_fixtures' THEN 'Fixtures' WHEN e = 'viewed_news' THEN 'News' ELSE 'Unknown' END
      AS page_type,
    CASE e WHEN 'viewed_match_ticket' THEN 'Buy Match Tickets' WHEN 'viewed_home_shirt' THEN '2024/25 Home Shirt'
           WHEN 'viewed_away_shirt' THEN '2024/25 Away Shirt' WHEN 'added_to_cart' THEN 'Cart'
           WHEN 'abandoned_cart' THEN 'Cart Abandoned' WHEN 'viewed_membership' THEN 'Become a Member'
           WHEN 'viewed_hospitality' THEN 'Club Level & Boxes' WHEN 'viewed_stadium_tour' THEN 'Stadium Tour'
           WHEN 'viewed_fixtures' THEN 'Upcoming Fixtures' WHEN 'viewed_news' THEN 'Latest News' ELSE '??' END
      AS page_name,
    CASE WHEN e IN ('viewed_home_shirt', 'viewed_away_shirt', 'added_to_cart', 'abandoned_cart')
         THEN 'P' || (1000 + k) ELSE '' END AS product_id,
    CASE WHEN e = 'viewed_match_ticket' THEN 'M' || lpad(CAST(k % 12 + 1 AS VARCHAR), 3, '0') ELSE '' END
      AS match_id,
    'SESS' || user_id || '-' || strftime(ts, '%Y%m%d') AS session_id,
    ' ' || upper(e) AS event_type
  FROM (
    SELECT *, CASE event_type
        WHEN 'view' THEN CASE WHEN k % 5 < 2 THEN 'viewed_match_ticket' WHEN k % 5 = 2 THEN 'viewed_home_shirt'
                              WHEN k % 5 = 3 THEN 'viewed_away_shirt' ELSE 'viewed_stadium_tour' END
        WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'viewed_membership' ELSE 'added_to_cart' END
        WHEN 'error' THEN 'abandoned_cart'
        WHEN 'signup' THEN 'viewed_hospitality'
        ELSE CASE WHEN k = 99 THEN '???invalid' WHEN k % 2 = 0 THEN 'viewed_fixtures' ELSE 'viewed_news' END
      END AS e
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM
            (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 101 = 0))
  )""")

layer("raw_mkt", "", f"""
  SELECT CASE WHEN event_id % 509 = 4 THEN '' ELSE 'S' || user_id END AS supporter_id,
    {CAMPAIGNS}[CAST(json_extract_string(props, '$.k') AS INT) % 9 + 1] AS campaign,
    'True' AS sent,
    CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'True' ELSE 'False' END AS opened,
    CASE WHEN event_type IN ('click', 'purchase') AND CAST(json_extract_string(props, '$.k') AS INT) % 16 = 3
      THEN 'True' ELSE 'False' END AS clicked,
    CASE WHEN event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS INT) % 16 = 3
      THEN 'True' ELSE 'False' END AS converted,
    CASE WHEN event_id % 521 <> 2 THEN ts END AS "timestamp"
  FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 103 = 0)""")

layer("raw_merch", "", f"""
  SELECT CASE WHEN o_orderkey % 701 = 9 THEN '' ELSE 'S' || o_custkey END AS supporter_id,
    CASE WHEN l_orderkey % 1511 = 21 THEN '' ELSE l_orderkey || '-' || l_linenumber END AS order_id,
    'Product ' || l_partkey AS product, {CATEGORIES}[l_partkey % 7 + 1] AS category,
    CAST(l_quantity AS INT) AS quantity,
    CASE WHEN (l_partkey + l_linenumber) % 499 = 5 THEN -rev WHEN l_partkey % 997 <> 13 THEN rev END AS revenue,
    l_shipdate + {SHIFT} AS purchase_timestamp
  FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))
               AS DOUBLE) AS rev FROM lineitem) JOIN orders ON l_orderkey = o_orderkey""")

layer("raw_tix", "", f"""
  SELECT CASE WHEN o_orderkey % 613 = 1 THEN ''
      ELSE 'S' || (o_custkey - CASE WHEN o_custkey % 5 = 2 THEN 1 ELSE 0 END) END AS supporter_id,
    CASE WHEN o_orderkey % 401 = 7 THEN '' ELSE 'Match ' || (o_orderkey % 12 + 1) END AS match,
    CASE WHEN o_orderkey % 12 < 9 THEN 'Premier League' WHEN o_orderkey % 12 < 11 THEN 'Champions League'
         ELSE 'Carabao Cup' END AS competition,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Hospitality' WHEN '2-HIGH' THEN 'Club Level'
         WHEN '3-MEDIUM' THEN 'Family Enclosure' WHEN '4-NOT SPECIFIED' THEN 'Away End'
         WHEN '5-LOW' THEN 'General Admission' END AS ticket_type,
    CASE WHEN o_orderkey % 463 = 17 THEN -o_totalprice WHEN o_orderkey % 1201 <> 5 THEN o_totalprice END
      AS ticket_price,
    o_orderdate + {SHIFT} AS purchase_timestamp,
    CASE o_orderstatus WHEN 'F' THEN 'True' WHEN 'O' THEN 'False' END AS attended
  FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 97 = 0)""")

# ---- silver -----------------------------------------------------------------------------

layer("typed_supporters", "raw_supporters", f"""
  SELECT {blank('supporter_id')} AS supporter_id, {title('first_name')} AS first_name,
    COALESCE({blank('age_band')}, 'Unknown') AS age_band, {title('country')} AS country,
    {title('city')} AS city, COALESCE({blank('membership_tier')}, 'None') AS membership_tier,
    TRIM(favourite_player) AS favourite_player,
    TRIM(favourite_product_category) AS favourite_product_category,
    TRY_CAST(registration_date AS DATE) AS registration_date,
    {true('email_opt_in')} AS email_opt_in, {true('season_ticket_holder')} AS season_ticket_holder
  FROM raw_supporters""")
layer("s_sup", "typed_supporters", f"""
  SELECT {cols(SUP)} FROM (
    SELECT *, {first_by('supporter_id', 'registration_date', SUP)} AS rn FROM typed_supporters)
  WHERE rn = 1 AND supporter_id IS NOT NULL""")
layer("s_web", "raw_web", f"""
  SELECT DISTINCT {blank('supporter_id')} AS supporter_id, event_timestamp, page_type, page_name,
    {blank('product_id')} AS product_id, {blank('match_id')} AS match_id, session_id,
    lower(TRIM(event_type)) AS event_type
  FROM raw_web WHERE {blank('supporter_id')} IS NOT NULL AND event_timestamp IS NOT NULL""")
layer("typed_merch", "raw_merch", f"""
  SELECT {blank('supporter_id')} AS supporter_id, {blank('order_id')} AS order_id, product, category,
    quantity, revenue, purchase_timestamp FROM raw_merch""")
layer("s_merch", "typed_merch", f"""
  SELECT {cols(MERCH)} FROM (
    SELECT *, {first_by('order_id', 'purchase_timestamp', MERCH)} AS rn FROM typed_merch)
  WHERE rn = 1 AND order_id IS NOT NULL AND supporter_id IS NOT NULL AND revenue >= 0""")
layer("s_tix", "raw_tix", f"""
  SELECT DISTINCT {blank('supporter_id')} AS supporter_id, match, competition, ticket_type, ticket_price,
    purchase_timestamp, {true('attended')} AS attended
  FROM raw_tix WHERE {blank('supporter_id')} IS NOT NULL AND ticket_price >= 0""")
layer("s_mkt", "raw_mkt", f"""
  SELECT DISTINCT {blank('supporter_id')} AS supporter_id, campaign, {true('sent')} AS sent,
    {true('opened')} AS opened, {true('clicked')} AS clicked, {true('converted')} AS converted,
    "timestamp" AS event_timestamp
  FROM raw_mkt WHERE {blank('supporter_id')} IS NOT NULL AND "timestamp" IS NOT NULL""")

# ---- features ---------------------------------------------------------------------------

layer("f_web", "s_web", f"""
  SELECT supporter_id,
    COUNT(DISTINCT CASE WHEN event_timestamp >= {SINCE} THEN session_id END) AS website_sessions_30d,
    COUNT(*) FILTER (page_type = 'Store' AND event_timestamp >= {SINCE}) AS product_views_30d,
    COUNT(*) FILTER (event_type = 'viewed_match_ticket' AND event_timestamp >= {SINCE}) AS ticket_views_30d,
    COUNT(*) FILTER (event_type = 'abandoned_cart' AND event_timestamp >= {SINCE}) AS cart_abandons_30d,
    COUNT(*) FILTER (event_type = 'viewed_membership' AND event_timestamp >= {SINCE}) AS membership_views_30d,
    COUNT(*) FILTER (event_type = 'viewed_hospitality' AND event_timestamp >= {SINCE}) AS hospitality_views_30d,
    MAX(event_timestamp) AS last_web_event
  FROM s_web GROUP BY supporter_id""")
layer("f_merch", "s_merch", f"""
  SELECT supporter_id, {total('revenue')} AS total_merchandise_spend, COUNT(*) AS merchandise_orders,
    MAX(purchase_timestamp) AS last_merch_purchase FROM s_merch GROUP BY supporter_id""")
layer("f_tix", "s_tix", f"""
  SELECT supporter_id, {total('ticket_price')} AS total_ticket_spend, COUNT(*) AS ticket_purchases,
    COUNT(*) FILTER (attended) AS matches_attended,
    MAX(CASE WHEN attended THEN purchase_timestamp END) AS last_match_attended,
    MAX(purchase_timestamp) AS last_ticket_purchase FROM s_tix GROUP BY supporter_id""")
layer("f_mkt", "s_mkt", f"""
  SELECT supporter_id, COUNT(*) FILTER (opened AND event_timestamp >= {SINCE}) AS marketing_opens_30d,
    COUNT(*) FILTER (clicked AND event_timestamp >= {SINCE}) AS marketing_clicks_30d,
    MAX(event_timestamp) AS last_marketing_event FROM s_mkt GROUP BY supporter_id""")

COUNTS = ["matches_attended", "ticket_purchases", "merchandise_orders", "website_sessions_30d",
          "product_views_30d", "ticket_views_30d", "cart_abandons_30d", "membership_views_30d",
          "hospitality_views_30d", "marketing_opens_30d", "marketing_clicks_30d"]

layer("base", "s_sup f_web f_merch f_tix f_mkt", f"""
  SELECT s.*, COALESCE(total_ticket_spend, 0.0::DOUBLE) AS total_ticket_spend,
    COALESCE(total_merchandise_spend, 0.0::DOUBLE) AS total_merchandise_spend,
    {", ".join(f"COALESCE({c}, 0) AS {c}" for c in COUNTS)},
    last_match_attended,
    GREATEST(COALESCE(last_merch_purchase, {NEVER}), COALESCE(last_ticket_purchase, {NEVER})) AS last_purchase_ts,
    GREATEST(COALESCE(last_web_event, {NEVER}), COALESCE(last_merch_purchase, {NEVER}),
             COALESCE(last_ticket_purchase, {NEVER}), COALESCE(last_marketing_event, {NEVER}))
      AS last_activity_ts
  FROM s_sup s LEFT JOIN f_web USING (supporter_id) LEFT JOIN f_merch USING (supporter_id)
    LEFT JOIN f_tix USING (supporter_id) LEFT JOIN f_mkt USING (supporter_id)""")


def days(last: str, never: int) -> str:
    return (f"CASE WHEN {last} = {NEVER} THEN {never} "
            f"ELSE CAST(date_diff('day', {last}, {REF}) AS INT) END")


def clamp(c: str) -> str:
    return f"CAST(LEAST(100, GREATEST(0, ROUND({c}))) AS INT)"


ENGAGEMENT = clamp(
    "website_sessions_30d * 3.0 + product_views_30d * 1.2 + ticket_views_30d * 2.0 "
    "+ marketing_opens_30d * 2.0 + matches_attended * 5.0 "
    "- GREATEST(0, days_since_last_activity - 30) * 0.3")
INTENT = clamp(
    "ticket_views_30d * 6.0 + product_views_30d * 2.0 + cart_abandons_30d * 8.0 "
    "+ membership_views_30d * 5.0 + hospitality_views_30d * 6.0 + marketing_clicks_30d * 4.0 "
    f"+ matches_attended * 2.0 - ({days('last_purchase_ts', 60)}) * 0.3")

BASELINE = [
    ("ticket_views_30d >= 3 AND ticket_purchases <= 8", "Match Ticket",
     "' viewed match tickets ' || ticket_views_30d || ' times in the last 30 days but has not purchased.'"),
    ("matches_attended >= 5 AND total_customer_value >= 4000000", "Hospitality",
     "' attended ' || matches_attended || ' matches and has spent £' || "
     "CAST(ROUND(total_customer_value) AS BIGINT) || ' - a strong hospitality candidate.'"),
    (f"matches_attended >= 5 AND {NON_MEMBER}", "Membership Upgrade",
     "' attended ' || matches_attended || ' matches this season but is not a paying member.'"),
    ("product_views_30d >= 4 OR cart_abandons_30d >= 1", "Club Shirt / Merchandise",
     "' browsed merchandise ' || product_views_30d || ' times with ' || cart_abandons_30d || "
     "' abandoned baskets recently.'"),
    (f"membership_views_30d >= 1 AND {NON_MEMBER}", "Membership Upgrade",
     "' visited membership pages ' || membership_views_30d || ' times in the last 30 days.'"),
    ("days_since_last_activity >= 60", "Re-engagement Campaign",
     "' has had no meaningful interaction for ' || days_since_last_activity || ' days.'"),
    ("hospitality_views_30d >= 1", "Hospitality",
     "' has shown interest in hospitality experiences recently.'"),
]
NBA = ("CASE " + " ".join(f"WHEN {c} THEN '{a}'" for c, a, _ in BASELINE) + " ELSE 'Stadium Tour' END")
REASON = ("first_name || CASE " + " ".join(f"WHEN {c} THEN {r}" for c, _, r in BASELINE)
          + " ELSE ' is an engaged supporter - nurture with an experience offer.' END")
OVERLAY_NBA = f"""CASE WHEN ticket_views_30d >= 2 AND ticket_purchases <= 8 THEN 'Match Ticket'
      WHEN total_customer_value >= 3500000 AND matches_attended >= 4 THEN 'Hospitality'
      WHEN (matches_attended >= 5 OR membership_views_30d >= 1) AND {NON_MEMBER} THEN 'Membership Upgrade'
      WHEN product_views_30d >= 3 OR cart_abandons_30d >= 1 THEN 'Club Shirt / Merchandise'
      WHEN hospitality_views_30d >= 1 THEN 'Hospitality'
      WHEN days_since_last_activity >= 60 THEN 'Re-engagement Campaign' ELSE 'Stadium Tour' END"""
SIGNAL = ("LEAST(100, GREATEST(0, ticket_views_30d * 6 + cart_abandons_30d * 8 + membership_views_30d * 5 "
          "+ product_views_30d * 2 + hospitality_views_30d * 6))")
BLEND = ("CAST(LEAST(100.0::DOUBLE, GREATEST(0.0::DOUBLE, round_even(0.7::DOUBLE * (probability * 100.0::DOUBLE) "
         f"+ 0.3::DOUBLE * {SIGNAL}, 0))) AS INT)")
PROBABILITY = "purchase_intent_score / 100.0::DOUBLE"


def opportunity(action: str) -> str:
    return f"""CASE COALESCE({action}, 'Stadium Tour') WHEN 'Match Ticket' THEN 'Ticket Intent'
      WHEN 'Membership Upgrade' THEN 'Membership Opportunity'
      WHEN 'Club Shirt / Merchandise' THEN 'Merchandise Opportunity'
      WHEN 'Hospitality' THEN 'Hospitality Opportunity'
      WHEN 'Re-engagement Campaign' THEN 'Re-engagement' ELSE 'Experience' END"""


layer("valued", "base", f"""
  SELECT *, CAST({cents('total_ticket_spend')} + {cents('total_merchandise_spend')} AS DOUBLE)
      AS total_customer_value,
    {days('last_purchase_ts', 999)} AS days_since_last_purchase,
    {days('last_activity_ts', 999)} AS days_since_last_activity FROM base""")
layer("scored", "valued", f"""
  SELECT *, {ENGAGEMENT} AS engagement_score, {INTENT} AS purchase_intent_score,
    {NBA} AS recommended_next_action, {REASON} AS recommendation_reason FROM valued""")
layer("rule_scores", "scored", f"""
  SELECT supporter_id, {BLEND} AS purchase_intent_score, {OVERLAY_NBA} AS recommended_next_action, probability
  FROM (SELECT *, {PROBABILITY} AS probability FROM scored)""")
layer("scores", "rule_scores", """
  SELECT supporter_id, purchase_intent_score, recommended_next_action,
    CASE WHEN rn <= 120 THEN 'Recommended ' || recommended_next_action || ' at intent '
      || purchase_intent_score || '/100.' END AS genai_reason, probability AS model_intent_prob
  FROM (SELECT *, row_number() OVER (ORDER BY purchase_intent_score DESC, supporter_id) AS rn FROM rule_scores)""")

GOLD = SUP + ["total_ticket_spend", "total_merchandise_spend", "total_customer_value", "matches_attended",
              "last_match_attended", "ticket_purchases", "merchandise_orders", "website_sessions_30d",
              "product_views_30d", "ticket_views_30d", "cart_abandons_30d", "membership_views_30d",
              "hospitality_views_30d", "marketing_opens_30d", "marketing_clicks_30d",
              "days_since_last_purchase", "days_since_last_activity", "engagement_score"]

layer("gold", "scored scores", f"""
  SELECT {", ".join("b." + c for c in GOLD)},
    COALESCE(m.purchase_intent_score, b.purchase_intent_score) AS purchase_intent_score,
    COALESCE(m.recommended_next_action, b.recommended_next_action) AS recommended_next_action,
    COALESCE(m.genai_reason, b.recommendation_reason) AS recommendation_reason, {REF} AS scored_at
  FROM scored b LEFT JOIN scores m USING (supporter_id)""")

PROFILE = ["supporter_id", "first_name", "age_band", "country", "city", "membership_tier",
           "favourite_player", "favourite_product_category"]
AMOUNTS = ["total_ticket_spend", "total_merchandise_spend", "total_customer_value"]
P_COUNTS = ["matches_attended", "ticket_views_30d", "product_views_30d", "cart_abandons_30d",
            "membership_views_30d", "marketing_opens_30d", "marketing_clicks_30d",
            "days_since_last_purchase", "days_since_last_activity", "engagement_score",
            "purchase_intent_score"]

layer("profile", "gold", f"""
  SELECT {cols(PROFILE)}, COALESCE(season_ticket_holder, false) AS season_ticket_holder, {cols(AMOUNTS)},
    {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in P_COUNTS)} FROM gold""")
layer("nba", "gold", f"""
  SELECT supporter_id, recommended_next_action AS recommended_action, recommendation_reason,
    CAST(purchase_intent_score AS BIGINT) AS intent_score,
    {opportunity('recommended_next_action')} AS opportunity_type, {REF} AS updated_at FROM gold""")
layer("served", "profile nba", """
  SELECT p.*, recommended_action, recommendation_reason, intent_score, opportunity_type
  FROM profile p JOIN nba USING (supporter_id)""")
layer("activity", "s_web s_merch s_tix s_mkt", """
  SELECT supporter_id, 'web' AS channel, event_type AS activity_type, page_name AS activity_detail,
    event_timestamp AS activity_timestamp FROM s_web
  UNION ALL SELECT supporter_id, 'merch', 'purchase', product, purchase_timestamp FROM s_merch
  UNION ALL SELECT supporter_id, 'ticketing', CASE WHEN attended THEN 'attended' ELSE 'ticket_purchase' END,
    match, purchase_timestamp FROM s_tix
  UNION ALL SELECT supporter_id, 'marketing', CASE WHEN converted THEN 'converted' WHEN clicked THEN 'clicked'
    WHEN opened THEN 'opened' ELSE 'sent' END, campaign, event_timestamp FROM s_mkt""")
layer("feed", "activity", """
  SELECT supporter_id, string_agg(channel || '/' || activity_type || '/' || COALESCE(activity_detail, '?') || '/'
      || strftime(activity_timestamp, '%Y-%m-%d %H:%M:%S'), '; ' ORDER BY rn) AS activity
  FROM (SELECT *, row_number() OVER (PARTITION BY supporter_id ORDER BY activity_timestamp DESC NULLS LAST,
          channel, activity_type, activity_detail NULLS LAST) AS rn FROM activity)
  WHERE rn <= 10 GROUP BY supporter_id""")
layer("labels_", "s_mkt", f"""
  SELECT supporter_id, CAST(MAX(CASE WHEN (clicked OR converted) AND event_timestamp >= {SINCE} THEN 1 ELSE 0 END)
    AS INT) AS engaged FROM s_mkt GROUP BY supporter_id""")

FEATURES = ["matches_attended", "total_ticket_spend", "total_merchandise_spend", "total_customer_value",
            "website_sessions_30d", "product_views_30d", "ticket_views_30d", "cart_abandons_30d",
            "membership_views_30d", "hospitality_views_30d", "marketing_opens_30d",
            "days_since_last_purchase", "days_since_last_activity", "ticket_purchases",
            "merchandise_orders"]
ORDINAL = ("CASE membership_tier WHEN 'Free' THEN 1 WHEN 'Silver' THEN 2 WHEN 'Gold' THEN 3 "
           "WHEN 'Red Member' THEN 4 ELSE 0 END")
layer("frame", "scored labels_", f"""
  SELECT supporter_id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURES)},
    CAST({ORDINAL} AS DOUBLE) AS membership_tier_ord, COALESCE(engaged, 0) AS engaged
  FROM scored LEFT JOIN labels_ USING (supporter_id)""")
CUTOFF, BEFORE = "TIMESTAMP '2024-01-24 00:00:00'", "TIMESTAMP '2024-01-17 00:00:00'"
for _name, _at in (("web", "event_timestamp"), ("merch", "purchase_timestamp"),
                   ("tix", "purchase_timestamp"), ("mkt", "event_timestamp")):
    layer(f"p_{_name}", f"s_{_name}", f"SELECT * FROM s_{_name} WHERE {_at} < {CUTOFF}")
    _sql = LAYERS[f"f_{_name}"][1].replace(SINCE, BEFORE).replace(f"FROM s_{_name}", f"FROM p_{_name}")
    layer(f"pf_{_name}", f"p_{_name}", _sql)
layer("p_base", "s_sup pf_web pf_merch pf_tix pf_mkt", LAYERS["base"][1].replace(" f_", " pf_"))
layer("p_valued", "p_base", LAYERS["valued"][1].replace(REF, CUTOFF).replace("FROM base", "FROM p_base"))
layer("p_labels", "s_mkt", f"""
  SELECT supporter_id, CAST(MAX(CASE WHEN (clicked OR converted) AND event_timestamp >= {CUTOFF}
    AND event_timestamp < {REF} THEN 1 ELSE 0 END) AS INT) AS engaged FROM s_mkt GROUP BY supporter_id""")
layer("p_frame", "p_valued p_labels",
      LAYERS["frame"][1].replace("FROM scored", "FROM p_valued").replace("labels_", "p_labels"))
layer("predicted", "frame scored", f"""
  SELECT supporter_id, engaged, {PROBABILITY} AS probability
  FROM frame JOIN (SELECT supporter_id, purchase_intent_score FROM scored) USING (supporter_id)""")
layer("cm", "predicted", """
  SELECT COUNT(*) FILTER (probability < 0.5 AND engaged = 0) AS tn,
    COUNT(*) FILTER (probability >= 0.5 AND engaged = 0) AS fp,
    COUNT(*) FILTER (probability < 0.5 AND engaged = 1) AS fn,
    COUNT(*) FILTER (probability >= 0.5 AND engaged = 1) AS tp FROM predicted""")

# ---- generator --------------------------------------------------------------------------

GEN_REF = "TIMESTAMP '2024-01-31 00:00:00'"


def u(key: str, tag: str, draw: int = 0) -> str:
    digest = f"md5('7|{tag}|' || CAST({key} AS VARCHAR))"
    return f"(CAST('0x' || substr({digest}, {1 + 8 * draw}, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def idx(x: str, n: int | str) -> str:
    return f"CAST(floor({x} * {n}) AS BIGINT)"


def pick(x: str, values: list[str]) -> str:
    listed = "[" + ", ".join(f"'{v}'" for v in values) + "]"
    return f"{listed}[{idx(x, len(values))} + 1]"


def weighted(x: str, pairs: list[tuple[object, float]]) -> str:
    whole_, reached, arms = sum(w for _, w in pairs), 0.0, []
    for value, weight in pairs[:-1]:
        reached += weight
        arms.append(f"WHEN {x} < {round(reached / whole_, 12)}::DOUBLE THEN {lit(value)}")
    return f"CASE {' '.join(arms)} ELSE {lit(pairs[-1][0])} END"


def lit(value: object) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value)


def moment(x: str, start: str, end: str) -> str:
    return (f"({start} + to_seconds(CAST(floor({x} * (date_diff('second', {start}, {end}) + 1)) AS BIGINT)))")


def clock(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def sid(n: str) -> str:
    return f"'S' || lpad(CAST({n} AS VARCHAR), GREATEST(6, length(CAST({n} AS VARCHAR)))::INT, '0')"


def ago(n: int) -> str:
    return f"({GEN_REF} - INTERVAL {n} DAY)"


PERSONAS = [("ticket_browser", .14), ("cart_abandoner", .13), ("loyal_attendee", .12), ("big_spender", .10),
            ("lapsed", .14), ("intl_merch", .12), ("casual", .25)]
GEN_COUNTRIES = [("United Kingdom", .55), ("United States", .14), ("Nigeria", .06), ("India", .06),
                 ("Germany", .04), ("Norway", .03), ("Japan", .03), ("Canada", .03), ("Australia", .03),
                 ("United Arab Emirates", .03)]
GEN_CITIES = {"United Kingdom": ["Bath", "York", "Cardiff", "Dundee"], "United States": ["Portland", "Tucson", "Omaha"],
              "Nigeria": ["Jos", "Enugu"], "India": ["Pune", "Jaipur"], "Germany": ["Bremen", "Leipzig"],
              "Norway": ["Tromso", "Bodo"], "Japan": ["Kobe", "Sapporo"], "Canada": ["Halifax", "Regina"],
              "Australia": ["Perth", "Hobart"], "United Arab Emirates": ["Sharjah", "Ajman"]}
GEN_TIERS = {"loyal_attendee": ["None", "Free", "Silver"], "big_spender": ["Gold", "Red Member", "Silver"],
             "lapsed": ["None", "Free"], "intl_merch": ["None", "Free", "Silver"]}
NAMES = ["Ada", "Ben", "Cleo", "Dara", "Eli", "Fay", "Gus", "Hana", "Ivo", "June", "Kit", "Lena", "Milo",
         "Nia", "Omar", "Pia", "Quin", "Rosa", "Seth", "Tara"]
CATEGORY_LIST = ["Home Shirt", "Away Shirt", "Third Kit", "Training Wear", "Accessories", "Retro", "Kids",
                 "Hospitality"]
CAMPAIGN_LIST = ["Season Ticket Renewal", "New Home Kit Launch", "Membership Drive",
                 "Champions League Hospitality", "Black Friday Store", "Matchday Ticket Alert",
                 "Stadium Tour Promo", "International Fan Club", "Re-engagement Winback"]
EVENT_LIST = ["viewed_match_ticket", "viewed_home_shirt", "viewed_away_shirt", "added_to_cart",
              "abandoned_cart", "viewed_membership", "viewed_hospitality", "viewed_stadium_tour",
              "viewed_fixtures", "viewed_news"]
EVENT_WEIGHTS = {"ticket_browser": (45, 8, 6, 5, 3, 6, 4, 3, 12, 8),
                 "cart_abandoner": (6, 30, 22, 18, 14, 3, 2, 2, 2, 1),
                 "loyal_attendee": (20, 8, 6, 4, 2, 22, 6, 6, 18, 8),
                 "intl_merch": (4, 30, 26, 16, 8, 4, 2, 3, 4, 3),
                 "lapsed": (8, 6, 6, 4, 4, 6, 4, 6, 30, 26)}


def persona(n: str) -> str:
    return weighted(u(n, "persona"), PERSONAS)


def arms(column: str, values: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


layer("g_sup0", "", f"""
  SELECT n, persona, country, {arms('country', {c: pick(u('n', 'city'), v) for c, v in GEN_CITIES.items()}, "'Bath'")} AS city,
    {arms('persona', {p: pick(u('n', 'tier'), v) for p, v in GEN_TIERS.items()},
          weighted(u('n', 'tier'), [('None', 30), ('Free', 25), ('Silver', 20), ('Gold', 15), ('Red Member', 10)]))}
      AS membership_tier
  FROM (SELECT n, {persona('n')} AS persona, {weighted(u('n', 'country'), GEN_COUNTRIES)} AS country
        FROM (SELECT c_custkey + 1 AS n FROM customer))""")
layer("g_sup", "g_sup0", f"""
  SELECT {sid('n')} AS supporter_id, {pick(u('n', 'name', 0), NAMES)} AS first_name,
    {weighted(u('n', 'name', 1), [('18-24', 18), ('25-34', 28), ('35-44', 22), ('45-54', 15), ('55-64', 10), ('65+', 7)])}
      AS age_band, country, city, membership_tier,
    'Player ' || ({idx(u('n', 'name', 2), 11)} + 1) AS favourite_player,
    {pick(u('n', 'name', 3), CATEGORY_LIST)} AS favourite_product_category,
    strftime(DATE '2016-01-01' + CAST({idx(u('n', 'misc', 0), "(date_diff('day', DATE '2016-01-01', DATE '2024-01-01') + 1)")} AS INT),
      '%Y-%m-%d') AS registration_date,
    CASE WHEN {u('n', 'misc', 1)} < 0.82::DOUBLE THEN 'True' ELSE 'False' END AS email_opt_in,
    CASE WHEN membership_tier IN ('Gold', 'Red Member') AND {u('n', 'misc', 2)} < 0.6::DOUBLE THEN 'True'
         ELSE 'False' END AS season_ticket_holder, persona
  FROM g_sup0""")


def channel(tag: str, table: str, key: str) -> str:
    who = f"{idx(u('n', tag + '.who'), '(SELECT count(*) FROM customer)')} + 1"
    return (f"(SELECT n, who, {persona('who')} AS persona FROM "
            f"(SELECT n, {who} AS who FROM (SELECT {key} + 1 AS n FROM {table})))")


def redrawn(tag: str, table: str, key: str, personas: str, chance: float) -> str:
    other = f"{idx(u('n', tag + '.again', 1), '(SELECT count(*) FROM customer)')} + 1"
    return (f"(SELECT n, who, {persona('who')} AS persona FROM (SELECT n, CASE WHEN persona IN ({personas}) "
            f"AND {u('n', tag + '.again', 0)} < {chance}::DOUBLE THEN {other} ELSE who END AS who "
            f"FROM {channel(tag, table, key)}))")


layer("g_web", "", f"""
  SELECT {sid('who')} AS supporter_id,
    {clock(f"CASE WHEN persona = 'lapsed' THEN {moment(u('n', 'web', 1), ago(365), ago(60))} "
           f"WHEN {u('n', 'web', 2)} < 0.6::DOUBLE THEN {moment(u('n', 'web', 1), ago(30), GEN_REF)} "
           f"ELSE {moment(u('n', 'web', 1), ago(365), GEN_REF)} END")} AS event_timestamp,
    {arms('e', {'viewed_match_ticket': "'Tickets'", 'viewed_membership': "'Membership'",
                'viewed_hospitality': "'Hospitality'", 'viewed_stadium_tour': "'Experience'",
                'viewed_fixtures': "'Fixtures'", 'viewed_news': "'News'"}, "'Store'")} AS page_type,
    {arms('e', {'viewed_match_ticket': "'Buy Match Tickets'", 'viewed_home_shirt': "'2024/25 Home Shirt'",
                'viewed_away_shirt': "'2024/25 Away Shirt'", 'added_to_cart': "'Cart'",
                'abandoned_cart': "'Cart Abandoned'", 'viewed_membership': "'Become a Member'",
                'viewed_hospitality': "'Club Level & Boxes'", 'viewed_stadium_tour': "'Stadium Tour'",
                'viewed_fixtures': "'Upcoming Fixtures'"}, "'Latest News'")} AS page_name,
    CASE WHEN e IN ('viewed_home_shirt', 'viewed_away_shirt', 'added_to_cart', 'abandoned_cart')
         THEN 'P' || (1000 + {idx(u('n', 'web', 3), 100)}) ELSE '' END AS product_id,
    CASE WHEN e = 'viewed_match_ticket'
         THEN 'M' || lpad(CAST({idx(u('n', 'web', 3), 12)} + 1 AS VARCHAR), 3, '0') ELSE '' END AS match_id,
    'SESS' || ({idx(u('n', 'session'), 900000)} + 100000) AS session_id, e AS event_type
  FROM (SELECT *, {arms('persona', {p: weighted(u('n', 'web', 0), list(zip(EVENT_LIST, w)))
                                    for p, w in EVENT_WEIGHTS.items()}, pick(u('n', 'web', 0), EVENT_LIST))} AS e
        FROM {channel('web', 'events', 'event_id')})""")
layer("g_merch", "", f"""
  SELECT {sid('who')} AS supporter_id,
    'O' || lpad(CAST(n AS VARCHAR), GREATEST(7, length(CAST(n AS VARCHAR)))::INT, '0') AS order_id,
    category || ' 2024/25' AS product, category, CAST(quantity AS VARCHAR) AS quantity,
    CAST(CAST(CAST(floor((0.9::DOUBLE + {u('n', 'merch', 1)} * 0.35::DOUBLE) * price * quantity * 100
      + 0.5::DOUBLE) AS BIGINT) AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2))::VARCHAR AS revenue,
    {clock(f"CASE WHEN {u('n', 'merch.ts')} < 0.55::DOUBLE THEN {moment(u('n', 'merch', 2), ago(365), GEN_REF)} "
           f"ELSE {moment(u('n', 'merch', 2), ago(30), GEN_REF)} END")} AS purchase_timestamp
  FROM (SELECT *, {arms('category', {'Home Shirt': '80', 'Away Shirt': '80', 'Third Kit': '75',
                                     'Training Wear': '55', 'Accessories': '20', 'Retro': '65'}, '50')} AS price
        FROM (SELECT *, {pick(u('n', 'merch', 0), CATEGORY_LIST[:-1])} AS category,
                {weighted(u('n', 'merch', 3), [(1, 85), (2, 10), (3, 5)])} AS quantity
              FROM {redrawn('merch', 'orders', 'o_orderkey', "'ticket_browser', 'lapsed'", 0.7)}))""")

OPPONENTS = [f"Visitors {c}" for c in "ABCDEFGHIJKL"]
layer("g_tix", "", f"""
  SELECT {sid('who')} AS supporter_id, 'Club vs ' || opponent AS match,
    CASE WHEN opponent IN ('Visitors J', 'Visitors K') THEN 'Champions League'
         WHEN opponent = 'Visitors L' THEN 'Carabao Cup' ELSE 'Premier League' END AS competition, ticket_type,
    CAST(CAST(CAST(floor((0.9::DOUBLE + {u('n', 'ticket', 2)} * 0.4::DOUBLE) * price * 100 + 0.5::DOUBLE) AS BIGINT)
      AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2))::VARCHAR AS ticket_price,
    {clock(moment(u('n', 'ticket', 3), ago(365), GEN_REF))} AS purchase_timestamp,
    CASE WHEN {u('n', 'ticket.seen')} < CASE WHEN persona IN ('loyal_attendee', 'big_spender') THEN 0.9::DOUBLE
         ELSE 0.75::DOUBLE END THEN 'True' ELSE 'False' END AS attended
  FROM (SELECT *, {arms('ticket_type', {'General Admission': '55', 'Club Level': '120', 'Family Enclosure': '45',
                                        'Hospitality': '350'}, '40')} AS price
        FROM (SELECT *, {pick(u('n', 'ticket', 0), OPPONENTS)} AS opponent,
                {weighted(u('n', 'ticket', 1), [('General Admission', 45), ('Club Level', 20),
                                                ('Family Enclosure', 15), ('Hospitality', 12), ('Away End', 8)])}
                  AS ticket_type
              FROM {redrawn('ticket', 'orders', 'o_orderkey', "'ticket_browser'", 0.85)}))""")
layer("g_mkt", "", f"""
  SELECT {sid('who')} AS supporter_id, {pick(u('n', 'mail', 0), CAMPAIGN_LIST)} AS campaign, 'True' AS sent,
    CASE WHEN o THEN 'True' ELSE 'False' END AS opened, CASE WHEN o AND c THEN 'True' ELSE 'False' END AS clicked,
    CASE WHEN o AND c AND v THEN 'True' ELSE 'False' END AS converted,
    {clock(f"CASE WHEN persona = 'lapsed' THEN {moment(u('n', 'mail', 1), ago(365), ago(45))} "
           f"WHEN {u('n', 'mail', 2)} < 0.5::DOUBLE THEN {moment(u('n', 'mail', 1), ago(365), GEN_REF)} "
           f"ELSE {moment(u('n', 'mail', 1), ago(30), GEN_REF)} END")} AS "timestamp"
  FROM (SELECT *, {u('n', 'mail', 3)} < {arms('persona', {
      'loyal_attendee': '0.62::DOUBLE', 'big_spender': '0.58::DOUBLE', 'ticket_browser': '0.5::DOUBLE',
      'cart_abandoner': '0.48::DOUBLE', 'intl_merch': '0.45::DOUBLE', 'casual': '0.32::DOUBLE',
      'lapsed': '0.12::DOUBLE'}, '0')} AS o,
      {u('n', 'mail.funnel', 0)} < 0.4::DOUBLE AS c, {u('n', 'mail.funnel', 1)} < 0.22::DOUBLE AS v
    FROM {channel('mail', 'events', 'event_id')})""")


def h60(key: str, tag: str, seed: int = 7) -> str:
    return f"CAST('0x' || substr(md5('{seed}|{tag}|' || {key}), 1, 15) AS BIGINT)"


layer("g_dirty", "g_sup", f"""
  SELECT supporter_id, CASE WHEN rn <= 20 THEN upper(country) ELSE country END AS country,
    CASE WHEN rn > 20 AND rn <= 30 THEN '  ' || membership_tier || ' ' ELSE membership_tier END AS membership_tier,
    CASE WHEN rn > 30 AND rn <= 40 THEN '' ELSE age_band END AS age_band
  FROM (SELECT *, row_number() OVER (ORDER BY {h60('supporter_id', 'dirty')}, supporter_id) AS rn FROM g_sup)""")

# ---- twins ------------------------------------------------------------------------------

ORACLE_SQL: dict[str, str] = {}


def chain(names: tuple[str, ...]) -> list[str]:
    """Layers needed for ``names``, each after its own needs."""
    ordered: list[str] = []
    for name in names:
        for need in (*chain(LAYERS[name][0]), name):
            if need not in ordered:
                ordered.append(need)
    return ordered


def twin(name: str, needs: str, sql: str) -> None:
    ctes = ",\n".join(f"{n} AS ({LAYERS[n][1]})" for n in chain(tuple(needs.split())))
    ORACLE_SQL[name] = (f"WITH {ctes}\n" if ctes else "") + sql


def rows(name: str, source: str, columns: list[str], times: tuple[str, ...] = (), dates: tuple[str, ...] = (),
         tail: str = "") -> None:
    def out(c: str) -> str:
        if c in times:
            return f'{micro(c)} AS "{c}"'
        if c in dates:
            return f"strftime({c}, '%Y-%m-%d') AS \"{c}\""
        return f'"{c}"'

    twin(name, source, f"SELECT {', '.join(out(c) for c in columns)} FROM {source} {tail}")


rows("ingest_batch", "s_web", WEB, ("event_timestamp",))
DRIFTED = f"""
SELECT {blank('supporter_id')} AS supporter_id, campaign, {true('sent')} AS sent, {true('opened')} AS opened, {true('clicked')} AS clicked,
  CASE WHEN lacks THEN NULL ELSE {true('converted')} END AS converted, {micro('"timestamp"')} AS event_timestamp,
  CASE WHEN lacks THEN '{{"device":"say \\"hi\\", you"}}' END AS rescued
FROM (SELECT *, COALESCE(length(supporter_id), 0) % 4 = 2 AS lacks FROM raw_mkt)"""
for _drifted in ("ingest_drifted_batch", "ingest_drifted_stream"):
    twin(_drifted, "raw_mkt", DRIFTED)
rows("ingest_stream_exactly_once", "s_mkt", [*MKT, "event_timestamp"], ("event_timestamp",))
SOURCES = {"supporters": ("raw_supporters", "s_sup"), "web_events": ("raw_web", "s_web"),
           "ecommerce_orders": ("raw_merch", "s_merch"), "ticket_orders": ("raw_tix", "s_tix"),
           "marketing_events": ("raw_mkt", "s_mkt")}
twin("ingest_stream_all_sources", " ".join(f"{r} {c}" for r, c in SOURCES.values()), " UNION ALL ".join(
    f"SELECT '{s}' AS source, count(*) AS ingested, count(*) AS with_file, (SELECT count(*) FROM {c}) AS passed FROM {r}"
    for s, (r, c) in SOURCES.items()))
twin("with_lineage", " ".join(r for r, _ in SOURCES.values()), " UNION ALL ".join(
    f"SELECT '{s}' AS source, count(*) AS ingested, count(*) AS with_file, count(*) AS with_time FROM {r}"
    for s, (r, _) in SOURCES.items()))
twin("rescue_malformed", "", """
SELECT 'S' || user_id AS supporter_id, event_type AS campaign, 'S' || user_id || ',' || event_type
  || ',True,True,False,False,' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ',extra' || event_id AS _corrupt_record
FROM events WHERE event_id % 7 = 3""")
twin("write_table", "", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {micro('o_orderdate')} AS o_orderdate, o_orderpriority
FROM orders""")
PROFILE_ALL = [*PROFILE, "season_ticket_holder", *AMOUNTS, *P_COUNTS]
rows("publish_profile", "profile", PROFILE_ALL)
rows("publish_nba", "nba", ["supporter_id", "recommended_action", "recommendation_reason", "intent_score",
                            "opportunity_type", "updated_at"], ("updated_at",))
rows("export_snapshot_json", "served", [*PROFILE_ALL, "recommended_action", "recommendation_reason",
                                        "opportunity_type"])
rows("export_activity_json", "feed", ["supporter_id", "activity"])
rows("load_serving", "served", [*PROFILE_ALL, "recommended_action", "recommendation_reason", "intent_score",
                                "opportunity_type"])

# What goes with each action.
META = {  # action -> channel, KPI, supporting KPI
    "Match Ticket": ("Email / App Push", "Ticket conversion", "Revenue per targeted supporter"),
    "Membership Upgrade": ("Email / Direct Mail", "Membership conversion", "Membership revenue"),
    "Club Shirt / Merchandise": ("Email / Retargeting", "Merchandise conversion", "Merchandise revenue"),
    "Hospitality": ("Account Manager Outreach / Email", "Hospitality utilisation", "Hospitality revenue"),
    "Re-engagement Campaign": ("Email / App Push", "Reactivation rate", "Retained supporter value"),
    "Stadium Tour": ("Email / App Push", "Experience uptake", "Engagement score"),
}


def meta(action: str, i: int) -> str:
    default = ("Email", "Engagement", "Revenue per supporter")[i]
    return arms(action, {a: f"'{m[i]}'" for a, m in META.items()}, f"'{default}'")


FACTS = ["supporter_id", "first_name", "membership_tier", "country", "matches_attended", "ticket_views_30d",
         "product_views_30d", "cart_abandons_30d", "membership_views_30d", "marketing_opens_30d",
         "days_since_last_activity", "total_customer_value", "purchase_intent_score", "recommended_action",
         "recommendation_reason"]
layer("facts", "served", "SELECT " + ", ".join(
    f"{whole('total_customer_value')} AS total_customer_value" if c == "total_customer_value" else c
    for c in FACTS) + " FROM served")
layer("brief", "facts", f"""
  SELECT supporter_id, recommended_action,
    'Convert ' || first_name || '''s current intent into a ' || lower(recommended_action) || ' outcome.' AS objective,
    COALESCE(NULLIF(recommendation_reason, ''), first_name || ' has an intent score of ' || purchase_intent_score
      || '/100 with recent relevant activity.') AS why_now,
    {meta('recommended_action', 0)} AS recommended_channel,
    'Relevant, timely and brand-appropriate — grounded in this supporter''s recent behaviour.' AS offer_angle,
    'Hi ' || first_name || ', based on your recent activity we''ve lined up something for you. Explore your '
      || lower(recommended_action) || ' options with Club.' AS suggested_message,
    {meta('recommended_action', 1)} AS primary_kpi, {meta('recommended_action', 2)} AS supporting_kpi,
    'Do not over-target recently contacted supporters; respect email opt-in and contact frequency caps.'
      AS risk_guardrail, 'template (LLM unavailable)' AS generated_by, purchase_intent_score
  FROM facts""")


def activation(at: str, where: str, batch: str, action: str = "recommended_action",
               channel: str = "recommended_channel", message: str = "suggested_message") -> str:
    marked = "|| '|' ||".join(f"COALESCE(length({c}) || ':' || {c}, '-')" for c in (
        "supporter_id", action, "objective", channel, message, "'marketing_user'"))
    return f"""
  SELECT 'act-' || md5({marked} || '|' || {micro(at)}) AS activation_id, supporter_id, {action} AS recommended_action,
    {action} AS selected_action, objective AS campaign, {at} AS created_at, 'queued' AS status,
    {action} AS next_best_action, objective AS campaign_objective, {channel} AS recommended_channel,
    {message} AS campaign_message, 'marketing_user' AS approved_by_user, {at} AS approved_at, '{batch}' AS batch_id
  FROM brief WHERE purchase_intent_score >= 70 {where}"""


layer("activation_log", "brief", activation(REF, "", "day-1") + " UNION ALL "
      + activation(f"({REF} + INTERVAL 1 DAY)", "AND recommended_action = 'Membership Upgrade'", "day-2"))
layer("channel_log", "brief", activation(REF, "", "batch-1", channel="'Email'") + " UNION ALL "
      + activation(REF, "", "batch-1", channel="'App Push'", message="'Open the app'") + " UNION ALL "
      + activation(REF, "", "batch-1", action="CAST(NULL AS VARCHAR)", channel="'Email'", message="CAST(NULL AS VARCHAR)"))
LOG = ["activation_id", "supporter_id", "recommended_action", "selected_action", "campaign", "created_at",
       "status", "next_best_action", "campaign_objective", "recommended_channel", "campaign_message",
       "approved_by_user", "approved_at", "batch_id"]
rows("append_activations_channels", "channel_log", LOG, ("created_at", "approved_at"))
for _log in ("append_activations", "append_activations_reused_id"):
    rows(_log, "activation_log", LOG, ("created_at", "approved_at"))
rows("recent_activations", "activation_log", LOG, ("created_at", "approved_at"),
     tail="ORDER BY activation_log.approved_at DESC, activation_id LIMIT 20")
layer("first_batch", "brief", activation(REF, "", "day-1"))
twin("evolve_log_schema", "first_batch", f"""
SELECT activation_id, supporter_id, status, {micro('approved_at')} AS approved_at,
  CAST(NULL AS VARCHAR) AS campaign_objective, CAST(NULL AS VARCHAR) AS reviewer FROM first_batch""")
rows("merge_scores", "gold", ["supporter_id", "purchase_intent_score", "recommended_next_action",
                              "recommendation_reason"])

# cleaning
twin("blank_to_null", "raw_web", f"""
SELECT {blank('supporter_id')} AS supporter_id, {blank('product_id')} AS product_id,
  {blank('match_id')} AS match_id, count(*) AS n FROM raw_web GROUP BY ALL""")
twin("title_case", "", f"""
SELECT p_partkey, {title("'  ' || upper(p_name) || ' ' || lower(p_brand) || ' '")} AS name FROM part""")
twin("default_if_blank", "raw_supporters", f"""
SELECT COALESCE({blank('age_band')}, 'Unknown') AS age_band, COALESCE({blank('membership_tier')}, 'None')
  AS membership_tier, count(*) AS n FROM raw_supporters GROUP BY ALL""")
twin("to_bool", "raw_tix", f"SELECT {true('attended')} AS attended, count(*) AS n FROM raw_tix GROUP BY ALL")
twin("to_timestamp_lenient", "", f"""
SELECT event_id, {micro("TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'not-a-timestamp' WHEN event_id % 11 = 0 THEN '' "
                        "ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP)")} AS parsed FROM events""")
twin("to_number_lenient", "", """
SELECT count(*) AS n, count(q) AS quantities, CAST(sum(q) AS BIGINT) AS quantity, count(p) AS prices,
  CAST(sum(CAST(p AS DECIMAL(18,2))) AS DOUBLE) AS price, count(d) AS days, strftime(max(d), '%Y-%m-%d') AS last_day
FROM (SELECT
    TRY_CAST(CASE WHEN l_partkey % 13 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS INT) AS q,
    TRY_CAST(CASE WHEN l_partkey % 17 = 0 THEN '' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END
      AS DOUBLE) AS p,
    TRY_CAST(CASE WHEN l_partkey % 19 = 0 THEN 'soon' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS DATE) AS d
  FROM lineitem)""")
twin("lower_trim", "raw_web",
     "SELECT lower(TRIM(event_type)) AS event_type, count(*) AS n FROM raw_web GROUP BY ALL")
rows("clean_supporters", "s_sup", SUP, dates=("registration_date",))
rows("clean_web_events", "s_web", WEB, ("event_timestamp",))
rows("clean_ecommerce_orders", "s_merch", MERCH, ("purchase_timestamp",))
twin("clean_ecommerce_orders_drop_first", "typed_merch", f"""
SELECT {cols(MERCH[:-1])}, {micro('purchase_timestamp')} AS purchase_timestamp FROM (
  SELECT *, {first_by('order_id', 'purchase_timestamp', MERCH)} AS rn FROM typed_merch
  WHERE order_id IS NOT NULL AND supporter_id IS NOT NULL AND revenue >= 0) WHERE rn = 1""")
rows("clean_ticket_orders", "s_tix", TIX, ("purchase_timestamp",))
rows("clean_marketing_events", "s_mkt", [*MKT, "event_timestamp"], ("event_timestamp",))
twin("dedup_first", "", f"""
SELECT line_id, {micro('l_shipdate')} AS l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY l_shipdate NULLS FIRST, l_partkey NULLS FIRST,
    l_suppkey NULLS FIRST, l_quantity NULLS FIRST, l_extendedprice NULLS FIRST) AS rn
  FROM (SELECT l_orderkey || '-' || l_linenumber AS line_id, * FROM lineitem)) WHERE rn = 1""")

# expectations
twin("expect_drop", "raw_tix", f"""
SELECT {blank('supporter_id')} AS supporter_id, match, competition, ticket_type, ticket_price,
  {micro('purchase_timestamp')} AS purchase_timestamp, {true('attended')} AS attended
FROM raw_tix WHERE {blank('supporter_id')} IS NOT NULL AND ticket_price >= 0""")
twin("expect_warn", "s_sup s_web s_tix", f"""
SELECT 'valid_membership_tier' AS rule, count(*) AS checked, count(*) FILTER (membership_tier NOT IN
  ('None', 'Free', 'Silver', 'Gold', 'Red Member')) AS failed FROM s_sup
UNION ALL SELECT 'sensible_registration_date', count(*),
  count(*) FILTER (registration_date > CAST({REF} AS DATE)) FROM s_sup
UNION ALL SELECT 'known_event_type', count(*), count(*) FILTER (event_type = '???invalid') FROM s_web
UNION ALL SELECT 'match_populated', count(*), count(*) FILTER (match IS NULL OR match = '') FROM s_tix""")

_ID = ("valid_supporter_id", f"{blank('supporter_id')} IS NOT NULL")
_TODAY = "CAST(current_date AS DATE)"
DROPS = {
    "supporters": ("typed_supporters", [_ID]),
    "web_events": ("raw_web", [_ID, ("valid_event_timestamp", "event_timestamp IS NOT NULL")]),
    "ecommerce_orders": ("typed_merch", [("valid_order_id", "order_id IS NOT NULL"), _ID, ("non_negative_revenue", "revenue >= 0")]),
    "ticket_orders": ("raw_tix", [_ID, ("non_negative_price", "ticket_price >= 0")]),
    "marketing_events": ("raw_mkt", [_ID, ("valid_event_timestamp", '"timestamp" IS NOT NULL')]),
}
WARNS = {
    "supporters": [("valid_membership_tier", "membership_tier IN ('None', 'Free', 'Silver', 'Gold', 'Red Member')"),
                   ("sensible_registration_date", f"registration_date IS NULL OR registration_date <= {_TODAY}")],
    "web_events": [("known_event_type", "lower(TRIM(event_type)) <> '???invalid'")],
    "ticket_orders": [("match_populated", "match IS NOT NULL AND match <> ''")],
}


def counted(source: str, kinds: str, left: str = "") -> list[str]:
    """A SELECT for each rule: drop rules on all rows, warn rules on the rows that keep the drop rules."""
    table, drops = DROPS[source]
    kept = " AND ".join(f"COALESCE({sql}, false)" for _, sql in drops)
    out = [f"SELECT '{source}' AS source, 'drop' AS kind, '{n}' AS rule, count(*) AS checked, "
           f"count(*) FILTER (NOT COALESCE({sql}, false)) AS failed{left.format(kept=kept)} FROM {table}" for n, sql in drops]
    if "warn" in kinds:
        out += [f"SELECT '{source}', 'warn', '{n}', count(*), count(*) FILTER (NOT COALESCE({sql}, false)) FROM {table} WHERE {kept}"
                for n, sql in WARNS.get(source, [])]
    return out


RULED = "typed_supporters raw_web typed_merch raw_tix raw_mkt"
twin("expect_stream", f"{RULED} scored", " UNION ALL ".join(
    [q for x in DROPS for q in counted(x, "drop warn")]
    + ["SELECT 'supporter_360', 'warn', 'one_row_per_supporter', count(*), count(*) FILTER (supporter_id IS NULL) FROM scored"]))
twin("expect_drop_all", RULED, " UNION ALL ".join(
    q for x in DROPS for q in counted(x, "drop", ', count(*) FILTER ({kept}) AS "left"')))

REJECT = {
    "supporters": f"CASE WHEN {blank('supporter_id')} IS NULL THEN 'missing_supporter_id' END",
    "web_events": f"CASE WHEN {blank('supporter_id')} IS NULL THEN 'missing_supporter_id' "
                  "WHEN event_timestamp IS NULL THEN 'invalid_event_timestamp' END",
    "ecommerce_orders": f"CASE WHEN {blank('order_id')} IS NULL THEN 'missing_order_id' "
                        f"WHEN {blank('supporter_id')} IS NULL THEN 'missing_supporter_id' "
                        "WHEN revenue < 0 THEN 'negative_revenue' WHEN revenue IS NULL THEN 'null_revenue' END",
    "ticket_orders": f"CASE WHEN {blank('supporter_id')} IS NULL THEN 'missing_supporter_id' "
                     "WHEN ticket_price < 0 THEN 'negative_price' WHEN ticket_price IS NULL THEN 'null_price' END",
    "marketing_events": f"CASE WHEN {blank('supporter_id')} IS NULL THEN 'missing_supporter_id' "
                        "WHEN \"timestamp\" IS NULL THEN 'invalid_timestamp' END",
}
RAW_COLUMNS = {"supporters": (SUP, ""), "web_events": (WEB, "event_timestamp"),
               "ecommerce_orders": (MERCH, "purchase_timestamp"), "ticket_orders": (TIX, "purchase_timestamp"),
               "marketing_events": ([*MKT, "timestamp"], "timestamp")}
for _source, (_columns, _time) in RAW_COLUMNS.items():
    _raw = SOURCES[_source][0]
    _listed = ", ".join(f'{micro(chr(34) + c + chr(34))} AS "{c}"' if c == _time else f'"{c}"' for c in _columns)
    twin(f"quarantine_{_source}", _raw,
         f"SELECT {_listed}, {REJECT[_source]} AS _reject_reason FROM {_raw} WHERE {REJECT[_source]} IS NOT NULL")
# what makes two valid raw rows the same record
IDENTITY = {"supporters": blank("supporter_id"), "ecommerce_orders": blank("order_id"),
            "web_events": f"{blank('supporter_id')}, event_timestamp, page_type, page_name, {blank('product_id')}, "
                          f"{blank('match_id')}, session_id, lower(TRIM(event_type))",
            "ticket_orders": f"{blank('supporter_id')}, match, competition, ticket_type, ticket_price, "
                             f"purchase_timestamp, {true('attended')}",
            "marketing_events": f"{blank('supporter_id')}, campaign, {true('sent')}, {true('opened')}, {true('clicked')}, "
                                f'{true("converted")}, "timestamp"'}
twin("quality_report", " ".join(f"{r} {s}" for r, s in SOURCES.values()), """
SELECT source, ingested, passed, rejected, duplicates, ingested - rejected - duplicates - passed AS lost,
  ROUND(100.0::DOUBLE * (ingested - rejected) / ingested, 2) AS pass_rate FROM (""" + " UNION ALL ".join(
    f"SELECT '{n}' AS source, count(*) AS ingested, count({REJECT[n]}) AS rejected, "
    f"(SELECT count(*) FROM {s}) AS passed, (SELECT COALESCE(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM {r} "
    f"WHERE {REJECT[n]} IS NULL GROUP BY {IDENTITY[n]})) AS duplicates FROM {r}" for n, (r, s) in SOURCES.items()) + ")")
twin("uniqueness_check", "gold", """
SELECT count(*) AS n_rows, count(DISTINCT supporter_id) AS n_keys, count(*) = count(DISTINCT supporter_id)
  AS is_unique FROM gold""")
COUNTED = ([(f"bronze_{n}", r) for n, (r, _) in SOURCES.items()]
           + [(f"silver_{n}", s) for n, (_, s) in SOURCES.items()]
           + [("gold_supporter_360", "gold"), ("gold_supporter_activity", "activity")])
twin("row_counts", " ".join(t for _, t in COUNTED),
     " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {t}" for n, t in COUNTED))

# features and 360
rows("web_features", "f_web", ["supporter_id", "website_sessions_30d", "product_views_30d", "ticket_views_30d",
                               "cart_abandons_30d", "membership_views_30d", "hospitality_views_30d",
                               "last_web_event"], ("last_web_event",))
rows("ecom_features", "f_merch", ["supporter_id", "total_merchandise_spend", "merchandise_orders",
                                  "last_merch_purchase"], ("last_merch_purchase",))
rows("ticket_features", "f_tix", ["supporter_id", "total_ticket_spend", "ticket_purchases", "matches_attended",
                                  "last_match_attended", "last_ticket_purchase"],
     ("last_match_attended", "last_ticket_purchase"))
rows("marketing_features", "f_mkt", ["supporter_id", "marketing_opens_30d", "marketing_clicks_30d",
                                     "last_marketing_event"], ("last_marketing_event",))
rows("base_360", "base", [*SUP, "total_ticket_spend", "total_merchandise_spend", *COUNTS, "last_match_attended",
                          "last_purchase_ts", "last_activity_ts"],
     ("last_match_attended", "last_purchase_ts", "last_activity_ts"), ("registration_date",))
rows("recency_days", "valued", ["supporter_id", "days_since_last_purchase", "days_since_last_activity"])
rows("total_customer_value", "valued", ["supporter_id", "total_customer_value"])
GOLD_ALL = [*GOLD, "purchase_intent_score", "recommended_next_action", "recommendation_reason", "scored_at"]
layer("gold_baseline", "scored", f"SELECT *, {REF} AS scored_at FROM scored")
rows("customer_360_baseline", "gold_baseline", GOLD_ALL, ("last_match_attended", "scored_at"),
     ("registration_date",))
rows("refresh_increments_360", "gold_baseline", GOLD_ALL, ("last_match_attended", "scored_at"), ("registration_date",))
rows("refresh_increments_orders", "s_merch", MERCH, ("purchase_timestamp",))
twin("refresh_increments_served", "gold_baseline", f"""
SELECT supporter_id, membership_tier, total_customer_value, engagement_score, purchase_intent_score,
  recommended_next_action AS recommended_action, recommendation_reason, purchase_intent_score AS intent_score,
  {opportunity('recommended_next_action')} AS opportunity_type FROM gold_baseline""")
twin("refresh_increments_recent_sessions", "s_web", f"""
SELECT supporter_id, count(DISTINCT session_id) AS sessions FROM s_web
WHERE event_timestamp >= {SINCE} AND session_id IS NOT NULL GROUP BY supporter_id""")
rows("overlay_scores", "gold", GOLD_ALL, ("last_match_attended", "scored_at"), ("registration_date",))
rows("activity_feed", "activity", ["supporter_id", "channel", "activity_type", "activity_detail",
                                   "activity_timestamp"], ("activity_timestamp",))

# scores and rules
twin("engagement_score", "scored", "SELECT supporter_id, engagement_score AS score FROM scored")
twin("baseline_intent", "scored", "SELECT supporter_id, purchase_intent_score AS score FROM scored")
twin("baseline_nba", "scored", "SELECT supporter_id, recommended_next_action AS action FROM scored")
twin("baseline_reason", "scored", "SELECT supporter_id, recommendation_reason AS reason FROM scored")
twin("behaviour_signal", "scored", f"SELECT supporter_id, CAST({SIGNAL} AS BIGINT) AS signal FROM scored")
twin("blended_intent", "rule_scores", "SELECT supporter_id, purchase_intent_score AS score FROM rule_scores")
twin("overlay_nba", "rule_scores", "SELECT supporter_id, recommended_next_action AS action FROM rule_scores")
BAND = ("CASE WHEN purchase_intent_score >= 70 THEN '70-100 High' WHEN purchase_intent_score >= 40 "
        "THEN '40-69 Medium' ELSE '0-39 Low' END")
twin("intent_band", "gold", f"SELECT supporter_id, {BAND} AS band FROM gold")
twin("opportunity_type", "gold",
     f"SELECT supporter_id, {opportunity('recommended_next_action')} AS opportunity FROM gold")
twin("action_meta", "gold", f"""
SELECT supporter_id, {meta('recommended_next_action', 0)} AS channel, {meta('recommended_next_action', 1)} AS kpi,
  {meta('recommended_next_action', 2)} AS supporting_kpi FROM gold""")
KINDS = {
    "Ticket Intent": ("Viewed tickets multiple times but have not purchased.", "Match Ticket Offer",
                      "Ticketing / Fan Engagement", "Ticket conversion"),
    "Membership Opportunity": ("Frequent match attendees who are not currently members.", "Membership Upgrade",
                               "Head of Membership / Fan Engagement", "Membership conversion"),
    "Merchandise Opportunity": ("High product browsing or abandoned baskets.", "Merchandise Reminder",
                                "Retail / Ecommerce", "Merchandise revenue"),
    "Hospitality Opportunity": ("High spend and attendance — premium experience candidates.",
                                "Hospitality Invite", "Commercial / Hospitality",
                                "Hospitality utilisation / revenue"),
    "Re-engagement": ("No meaningful interaction during the last 60 days.", "Re-engagement Campaign",
                      "CRM / Fan Engagement", "Reactivation rate"),
    "Experience": ("Engaged supporters to nurture with an experience offer.", "Stadium Tour", "Fan Engagement",
                   "Experience uptake"),
}
layer("kinds", "", "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(f"'{x}'" for x in (k, *m)) + ")" for k, m in KINDS.items())
    + ") v(type, description, action, owner, kpi)")
twin("opportunity_meta", "served kinds", """
SELECT supporter_id, description, action, owner, kpi FROM served LEFT JOIN kinds ON opportunity_type = type""")
twin("tier_ordinal", "s_sup", f"SELECT supporter_id, {ORDINAL} AS ordinal FROM s_sup")
twin("is_member", "s_sup", f"SELECT supporter_id, NOT ({NON_MEMBER}) AS member FROM s_sup")

# model
rows("engagement_label", "labels_", ["supporter_id", "engaged"])
rows("feature_frame", "frame", ["supporter_id", *FEATURES, "membership_tier_ord", "engaged"])
rows("feature_frame_leak_free", "p_frame", ["supporter_id", *FEATURES, "membership_tier_ord", "engaged"])
twin("stratified_split", "frame", f"""
SELECT supporter_id, engaged, row_number() OVER (PARTITION BY engaged ORDER BY {h60('supporter_id', 'split', 42)},
  supporter_id) <= ceil(count(*) OVER (PARTITION BY engaged) * 0.25) AS is_test FROM frame""")
def fitted(name: str, frame: str) -> str:
    """Counts of the exact split; true and 0 are what a fitted model gives."""
    return f"""
SELECT '{name}' AS model, count(*) FILTER (NOT is_test) AS n_train, count(*) FILTER (NOT is_test AND engaged = 1)
    AS train_positive, count(*) FILTER (is_test) AS n_test, count(*) FILTER (is_test AND engaged = 1) AS test_positive,
  true AS in_range, true AS beats_constant, 0.0::DOUBLE AS slope
FROM (SELECT engaged, row_number() OVER (PARTITION BY engaged ORDER BY {h60('supporter_id', 'split', 42)}, supporter_id)
  <= ceil(count(*) OVER (PARTITION BY engaged) * 0.25) AS is_test FROM {frame})"""


twin("train_logreg", "frame", fitted("logistic_regression", "frame"))
twin("train_gbt", "frame", fitted("boosted_trees", "frame"))
twin("train_logreg_leak_free", "p_frame", fitted("logistic_regression_leak_free", "p_frame"))
twin("select_best", "", "SELECT 2::BIGINT AS models, true AS is_best, true AS above_chance, 1::BIGINT AS chosen, "
     "true AS auc_agrees")
twin("feature_importance", "", """
SELECT model, 8::BIGINT AS features, 8::BIGINT AS known, true AS any_weight, true AS no_negative,
  true AS heaviest_first, true AS named_right
FROM (SELECT unnest(['logistic_regression', 'boosted_trees']) AS model)""")
twin("score_all", "frame", "SELECT supporter_id, engaged, true AS in_range, true AS agrees FROM frame")
twin("model_scores", "rule_scores", """
SELECT supporter_id, recommended_next_action, CAST(NULL AS VARCHAR) AS genai_reason, true AS is_blend FROM rule_scores""")
twin("label_balance", "frame", "SELECT engaged, count(*) AS supporters FROM frame GROUP BY engaged")
twin("positive_rate", "frame",
     "SELECT count(*) AS supporters, ROUND(avg(CAST(engaged AS DOUBLE)), 3) AS positive_rate FROM frame")
twin("confusion_matrix", "cm", "SELECT tn, fp, fn, tp FROM cm")


def share(a: str, b: str) -> str:
    return f"ROUND(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0 END, 4)"


twin("evaluate_rules", "predicted cm", f"""
SELECT 'rule_baseline' AS model, ROUND((SELECT (SUM(r) FILTER (engaged = 1)
      - CAST(COUNT(*) FILTER (engaged = 1) AS DOUBLE) * (COUNT(*) FILTER (engaged = 1) + 1) / 2.0::DOUBLE)
    / (CAST(COUNT(*) FILTER (engaged = 1) AS DOUBLE) * COUNT(*) FILTER (engaged = 0))
  FROM (SELECT engaged, rank() OVER (ORDER BY probability)
    + (count(*) OVER (PARTITION BY probability) - 1) / 2.0::DOUBLE AS r FROM predicted)), 4) AS auc,
  {share('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {share('tp', 'tp + fp')} AS "precision",
  {share('tp', 'tp + fn')} AS recall, {share('2 * tp', '2 * tp + fp + fn')} AS f1 FROM cm""")
rows("publish_scores", "scores", ["supporter_id", "purchase_intent_score", "recommended_next_action",
                                  "genai_reason", "model_intent_prob"])
twin("top_n_for_reason", "rule_scores", """
SELECT supporter_id, purchase_intent_score, recommended_next_action FROM rule_scores
ORDER BY purchase_intent_score DESC, supporter_id LIMIT 120""")
twin("score_summary", "scores", """
SELECT count(purchase_intent_score) AS n, ROUND(avg(purchase_intent_score), 2) AS mean,
  ROUND(stddev_samp(purchase_intent_score), 2) AS std, CAST(min(purchase_intent_score) AS DOUBLE) AS "min",
  quantile_cont(CAST(purchase_intent_score AS DOUBLE), 0.25) AS p25,
  quantile_cont(CAST(purchase_intent_score AS DOUBLE), 0.5) AS p50,
  quantile_cont(CAST(purchase_intent_score AS DOUBLE), 0.75) AS p75,
  CAST(max(purchase_intent_score) AS DOUBLE) AS "max" FROM scores""")

# serving queries
VALUE = cents("total_customer_value")
twin("overview_kpis", "served", f"""
SELECT count(*) AS total_supporters, count(*) FILTER (purchase_intent_score >= 70) AS high_intent,
  {whole(f'sum({VALUE})')} AS revenue, CAST(sum(matches_attended) AS BIGINT) AS matches_attended,
  count(*) FILTER (opportunity_type <> 'Experience') AS open_opportunities FROM served""")
twin("intent_distribution", "served", f"""
SELECT band, count(b) AS supporters FROM (VALUES ('0-39 Low'), ('40-69 Medium'), ('70-100 High')) v(band)
LEFT JOIN (SELECT {BAND} AS b FROM served) ON b = band GROUP BY band""")
twin("action_mix", "served", """
SELECT recommended_action AS action, count(*) AS supporters, ROUND(avg(purchase_intent_score), 1) AS avg_intent
FROM served GROUP BY 1""")
twin("revenue_by_segment", "served", f"""
SELECT CASE WHEN {NON_MEMBER} THEN 'Non-members' ELSE 'Members' END AS segment, count(*) AS supporters,
  CAST(sum({VALUE}) AS DOUBLE) AS value FROM served GROUP BY 1""")


def trend(days_since: str) -> str:
    return f"""
SELECT w AS week, '-' || w || 'w' AS label, COALESCE({whole('m')}, 0) AS score FROM range(1, 9) t(w)
LEFT JOIN (SELECT CAST(floor(d / 7) + 1 AS BIGINT) AS wk, avg(engagement_score) AS m
  FROM (SELECT engagement_score, {days_since} AS d FROM served) WHERE d >= 0 AND d < 56 GROUP BY 1) ON wk = w"""


twin("engagement_trend", "served", trend("days_since_last_activity"))
twin("engagement_trend_compat", "served",
     trend("CASE WHEN days_since_last_activity = 0 THEN 999 ELSE days_since_last_activity END"))


def top(name: str, columns: str, where: str, by: str, n: int) -> None:
    twin(name, "served",
         f"SELECT {columns} FROM served WHERE {where} ORDER BY {by} DESC, supporter_id LIMIT {n}")


SEARCH = "supporter_id, first_name, membership_tier, country, purchase_intent_score, recommended_action"
top("search", SEARCH, "contains(lower(supporter_id), '#00000001') OR contains(lower(first_name), '#00000001')",
    "purchase_intent_score", 25)
for _name, _part in (("search_index", "#00000001"), ("search_index_short", "1")):
    top(_name, SEARCH, f"contains(lower(supporter_id), '{_part}') OR contains(lower(first_name), '{_part}')",
        "purchase_intent_score", 25)
layer("opps", "served kinds", f"""
  SELECT type, description, action, owner, kpi, count(supporter_id) AS supporters,
    COALESCE({whole(f'sum({VALUE})')}, 0) AS value, COALESCE({whole('avg(purchase_intent_score)')}, 0) AS avg_intent
  FROM kinds LEFT JOIN served ON opportunity_type = type GROUP BY 1, 2, 3, 4, 5""")
rows("opportunities", "opps", ["type", "description", "action", "owner", "kpi", "supporters", "value",
                               "avg_intent"])
twin("opportunity_ranking", "opps",
     "SELECT type AS opportunity, supporters, action AS recommended FROM opps")
twin("opportunity_distribution", "served",
     "SELECT opportunity_type, count(*) AS supporters FROM served GROUP BY 1")
twin("opportunity_members", "served", f"""
SELECT opportunity_type, {SEARCH}, CAST(rn AS INT) AS "position" FROM (SELECT *, row_number() OVER (
  PARTITION BY opportunity_type ORDER BY purchase_intent_score DESC, supporter_id) AS rn FROM served)
WHERE rn <= 50""")


def measures(kind: str, prefix: str) -> str:
    f = f"FILTER (opportunity_type = '{kind}')"
    return (f"count(*) {f} AS {prefix}_count, COALESCE({whole(f'sum({VALUE}) {f}')}, 0) AS {prefix}_value, "
            f"COALESCE({whole(f'avg(purchase_intent_score) {f}')}, 0) AS {prefix}_avg_intent")


twin("commercial_kpis", "served", f"""
SELECT {whole(f'sum({VALUE})')} AS total_supporter_value,
  count(*) FILTER (purchase_intent_score >= 70) AS high_intent_supporters,
  COALESCE({whole(f'sum({VALUE}) FILTER (purchase_intent_score >= 70)')}, 0) AS high_intent_value,
  {measures('Membership Opportunity', 'membership')}, {measures('Hospitality Opportunity', 'hospitality')},
  {measures('Re-engagement', 'reengagement')}, {measures('Ticket Intent', 'ticket')},
  {measures('Merchandise Opportunity', 'merchandise')} FROM served""")
twin("business_case", "served", f"""
SELECT supporters, actionable_supporters, {whole('a')} AS addressable_value_sample,
  {whole('s')} AS scaled_addressable_value, {whole('c')} AS incremental_converted_value,
  {whole('k')} AS incremental_gross_contribution, round_even((k - 120000) / 120000.0::DOUBLE, 2) AS roi_x,
  {whole('(k - 120000) / 120000.0::DOUBLE * 100')} AS roi_pct,
  round_even(120000.0::DOUBLE / (k / 12.0::DOUBLE), 1) AS payback_months
FROM (SELECT *, c * 0.6::DOUBLE AS k FROM (SELECT *, s * 0.08::DOUBLE * 0.25::DOUBLE AS c FROM (
  SELECT *, a * (250000.0::DOUBLE / supporters) AS s FROM (
    SELECT count(*) AS supporters, count(*) FILTER (opportunity_type <> 'Experience') AS actionable_supporters,
      CAST(sum({VALUE}) FILTER (opportunity_type <> 'Experience') AS DOUBLE) AS a FROM served))))""")
top("top_intent", "supporter_id, first_name, membership_tier, purchase_intent_score, recommended_action", "true",
    "purchase_intent_score", 10)
twin("rank_intent", "served", """
SELECT intent_rank, supporter_id, first_name, purchase_intent_score, recommended_action FROM (
  SELECT *, rank() OVER (ORDER BY purchase_intent_score DESC) AS intent_rank FROM served) WHERE intent_rank <= 10""")
top("ticket_prospects", "supporter_id, first_name, ticket_views_30d, purchase_intent_score",
    "ticket_views_30d >= 2 AND (recommended_action = 'Match Ticket' OR opportunity_type = 'Ticket Intent')",
    "purchase_intent_score", 15)
top("non_member_attenders", "supporter_id, first_name, membership_tier, matches_attended, purchase_intent_score",
    NON_MEMBER, "matches_attended", 15)
twin("non_member_attender_count", "served",
     f"SELECT count(*) AS supporter_count FROM served WHERE {NON_MEMBER} AND matches_attended >= 2")
top("cart_abandoners", "supporter_id, first_name, cart_abandons_30d, product_views_30d, purchase_intent_score",
    "cart_abandons_30d >= 1", "cart_abandons_30d", 15)
top("membership_campaign", "supporter_id, first_name, matches_attended, membership_views_30d, purchase_intent_score",
    "recommended_action = 'Membership Upgrade'", "purchase_intent_score", 15)
top("international_merch", "supporter_id, first_name, country, total_merchandise_spend", "country <> 'Nation_0'",
    "total_merchandise_spend", 15)
twin("merch_category_international", "s_merch s_sup", """
SELECT category, count(*) AS orders, CAST(sum(quantity) AS BIGINT) AS items FROM s_merch JOIN s_sup
  USING (supporter_id) WHERE country <> 'Nation_0' GROUP BY category ORDER BY orders DESC, category LIMIT 1""")
twin("high_intent_value", "gold", f"""
SELECT COALESCE(CAST(sum({VALUE}) AS DOUBLE), 0) AS total_customer_value FROM gold WHERE purchase_intent_score >= 70""")
twin("non_member_value", "gold",
     f"SELECT COALESCE(CAST(sum({VALUE}) AS DOUBLE), 0) AS total_customer_value FROM gold WHERE {NON_MEMBER}")
twin("action_value", "gold", f"""
SELECT recommended_next_action, CAST(sum({VALUE}) AS DOUBLE) AS total_customer_value FROM gold
WHERE recommended_next_action IS NOT NULL GROUP BY 1""")
twin("action_like_value", "gold", f"""
SELECT count(*) AS supporter_count, COALESCE(CAST(sum({VALUE}) AS DOUBLE), 0) AS total_customer_value FROM gold
WHERE recommended_next_action ILIKE '%Hospitality%'""")
twin("inactive_over", "gold", "SELECT count(*) AS supporter_count FROM gold WHERE days_since_last_activity > 60")
twin("cohort_flags", "gold", f"""
SELECT count(*) FILTER ({BASELINE[0][0]}) AS ticket_intent, count(*) FILTER ({BASELINE[2][0]}) AS membership_opp,
  count(*) FILTER ({BASELINE[3][0]}) AS merch_opp, count(*) FILTER ({BASELINE[5][0]}) AS reengagement FROM gold""")
top("hero_pick", "supporter_id, first_name, recommended_action, intent_score", NON_MEMBER, "intent_score", 1)
DETAIL_SQL = """
SELECT supporter_id, first_name, purchase_intent_score AS intent, engagement_score AS engagement,
  recommended_action, recommendation_reason, opportunity_type, COALESCE(activity, '') AS activity
FROM served LEFT JOIN feed USING (supporter_id)"""
twin("supporter_detail", "served feed", DETAIL_SQL)
twin("supporter_detail_ids", "served feed", DETAIL_SQL + " WHERE recommended_action = 'Hospitality'")
twin("facts_json", "facts", f"SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in FACTS)} FROM facts")
rows("brief_facts", "facts", FACTS)
BRIEF = ["objective", "why_now", "recommended_channel", "offer_angle", "suggested_message", "primary_kpi",
         "supporting_kpi", "risk_guardrail"]
rows("template_brief", "brief", ["supporter_id", "recommended_action", *BRIEF, "generated_by"])
REPLIED = {"objective": "'Win ' || first_name", "why_now": "''", "offer_angle": "''", "suggested_message": "''",
           "recommended_channel": meta("recommended_action", 0), "primary_kpi": "'K' || purchase_intent_score",
           "supporting_kpi": meta("recommended_action", 2),
           "risk_guardrail": "'Respect contact frequency caps and opt-in.'"}
twin("parse_brief", "brief facts", f"""
SELECT supporter_id, recommended_action,
  {", ".join(f"CASE WHEN ok THEN {REPLIED[k]} ELSE b.{k} END AS {k}" for k in BRIEF)},
  CASE WHEN ok THEN 'GenAI' ELSE generated_by END AS generated_by
FROM (SELECT *, purchase_intent_score % 10 < 2 AS ok FROM brief) b
  JOIN (SELECT supporter_id, first_name FROM facts) USING (supporter_id)""")
twin("reason_prompt", "gold", f"""
SELECT supporter_id, 'Club wants to offer ' || recommended_next_action || ' to ' || first_name
  || '. Write one sentence of at most 30 words that says why, using these facts only: tier ' || membership_tier
  || '; matches attended ' || matches_attended || '; in the last 30 days, ticket views ' || ticket_views_30d
  || ', product views ' || product_views_30d || ', abandoned baskets ' || cart_abandons_30d
  || ', membership page views ' || membership_views_30d || '; spent so far ' || {whole('total_customer_value')}
  || ' pounds; intent ' || purchase_intent_score || ' of 100.' AS prompt FROM gold""")

# generator and profile
rows("gen_supporters", "g_sup", [*SUP, "persona"])
rows("gen_web_events", "g_web", WEB)
rows("gen_ecommerce_orders", "g_merch", MERCH)
rows("gen_ticket_orders", "g_tix", TIX)
rows("gen_marketing_events", "g_mkt", [*MKT, "timestamp"])
rows("inject_dirty", "g_dirty", ["supporter_id", "country", "membership_tier", "age_band"])
twin("inject_duplicates", "g_merch", f"""
SELECT order_id, CASE WHEN row_number() OVER (ORDER BY {h60('order_id', 'replay')}, order_id) <= 30 THEN 2 ELSE 1 END
  ::BIGINT AS n FROM g_merch""")
twin("inject_malformed", "", """
SELECT 'supporters' AS source, 'accepted' AS reason, count(*) AS n FROM customer
UNION ALL SELECT 'web_events', 'accepted', count(*) + 1 FROM events
UNION ALL SELECT 'ecommerce_orders', 'accepted', count(*) FROM orders
UNION ALL SELECT 'ticket_orders', 'accepted', count(*) FROM orders
UNION ALL SELECT 'marketing_events', 'accepted', count(*) FROM events
UNION ALL FROM (VALUES ('supporters', 'missing_supporter_id', 2), ('web_events', 'missing_supporter_id', 2),
  ('web_events', 'invalid_event_timestamp', 2), ('ecommerce_orders', 'missing_order_id', 1),
  ('ecommerce_orders', 'missing_supporter_id', 1), ('ecommerce_orders', 'negative_revenue', 2),
  ('ticket_orders', 'missing_supporter_id', 1), ('ticket_orders', 'negative_price', 1),
  ('marketing_events', 'missing_supporter_id', 1), ('marketing_events', 'invalid_timestamp', 1))""")
twin("profile_volumes", " ".join(s for _, s in SOURCES.values()), " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n FROM {s}" for n, (_, s) in SOURCES.items()))
twin("membership_split", "s_sup", f"""
SELECT count(*) AS supporters, count(*) FILTER (NOT ({NON_MEMBER})) AS members,
  count(*) FILTER ({NON_MEMBER}) AS non_members,
  ROUND(100.0::DOUBLE * count(*) FILTER (NOT ({NON_MEMBER})) / count(*), 1) AS member_pct FROM s_sup""")
twin("persona_mix", "g_sup", """
SELECT persona, count(*) AS supporters,
  ROUND(100.0::DOUBLE * count(*) / CAST(sum(count(*)) OVER () AS BIGINT), 1) AS pct FROM g_sup GROUP BY persona""")
twin("recent_counts", "f_web", """
SELECT supporter_id, ticket_views_30d AS ticket_views, cart_abandons_30d AS cart_abandons,
  product_views_30d AS product_views FROM f_web""")
twin("ticket_browsers_no_purchase", "f_web s_tix", """
SELECT supporter_id, ticket_views_30d AS ticket_views FROM f_web WHERE ticket_views_30d >= 2 AND supporter_id NOT IN (
  SELECT supporter_id FROM s_tix)""")
twin("frequent_non_members", "s_tix s_sup", f"""
SELECT supporter_id, count(*) AS matches_attended, membership_tier FROM s_tix JOIN s_sup USING (supporter_id)
WHERE attended AND {NON_MEMBER} GROUP BY supporter_id, membership_tier HAVING count(*) >= 3""")
twin("vip_spenders", "s_merch", """
SELECT supporter_id, CAST(ROUND(sum(CAST(revenue AS DECIMAL(18,4))), 2) AS DOUBLE) AS merch_spend FROM s_merch
GROUP BY supporter_id HAVING sum(CAST(revenue AS DECIMAL(18,4))) >= 2500000""")
twin("cart_abandoner_cohort", "f_web", """
SELECT supporter_id, cart_abandons_30d AS cart_abandons FROM f_web WHERE cart_abandons_30d >= 1""")
twin("international", "s_sup",
     "SELECT country, count(*) AS supporters FROM s_sup WHERE country <> 'Nation_0' GROUP BY country")
twin("distinct_buyers", "s_merch s_tix", """
SELECT 'merch' AS channel, count(DISTINCT supporter_id) AS buyers FROM s_merch
UNION ALL SELECT 'ticketing', count(DISTINCT supporter_id) FROM s_tix""")
twin("recent_share", "s_web", f"""
SELECT count(*) AS events, count(*) FILTER (event_timestamp >= {SINCE}) AS recent,
  ROUND(100.0::DOUBLE * count(*) FILTER (event_timestamp >= {SINCE}) / count(*), 1) AS recent_pct FROM s_web""")

# published tables
_IDS = ", ".join(f"'S{i}'" for i in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 0))
ORACLE_SQL["lookup_activities"] = f"SELECT * FROM ({ORACLE_SQL['export_activity_json']}) WHERE supporter_id IN ({_IDS})"
