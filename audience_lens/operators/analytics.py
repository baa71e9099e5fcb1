"""KPI, cohort and ranking queries over the served view or the Gold 360.

``served`` is the profile joined with its next best action (``serving.load_serving``). Rankings
are top-k with ``supporter_id`` as tie-break; roundings are half-even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from audience_lens import config as C
from audience_lens.config import BusinessAssumptions, EngineConfig
from audience_lens.functions import cleaning as cl
from audience_lens.functions import rules, scoring

SEARCH_COLUMNS = ("supporter_id", "first_name", "membership_tier", "country",
                  "purchase_intent_score", "recommended_action")


def _score() -> Column:
    return F.coalesce("purchase_intent_score", F.lit(0))


def _value() -> Column:
    return cl.money(F.coalesce("total_customer_value", F.lit(0.0)), 2)


def _total(amount: Column) -> Column:
    return F.coalesce(F.sum(amount), F.lit(0))


def _whole(c: Column) -> Column:
    return F.bround(c, 0).cast("bigint")


def _opportunity() -> Column:
    return F.coalesce("opportunity_type", F.lit(C.EXPERIENCE))


def _actionable() -> Column:
    return _opportunity() != C.EXPERIENCE


def _top(df: DataFrame, n: int, by: Column, columns: tuple[str, ...]) -> DataFrame:
    return df.orderBy(by.desc(), "supporter_id").limit(n).select(*columns)


def _dimension(spark: SparkSession, rows: list[Column]) -> DataFrame:
    """A few literal rows as a frame."""
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


# ---- overview ---------------------------------------------------------------------------


def overview_kpis(served: DataFrame) -> DataFrame:
    return served.agg(
        F.count("*").alias("total_supporters"),
        F.count_if(_score() >= C.HIGH_INTENT).alias("high_intent"),
        _whole(_total(_value())).alias("revenue"),
        _total(F.col("matches_attended")).alias("matches_attended"),
        F.count_if(_actionable()).alias("open_opportunities"),
    )


def intent_distribution(served: DataFrame) -> DataFrame:
    """All bands, empty ones with count 0."""
    counts = served.groupBy(scoring.intent_band("purchase_intent_score").alias("band")).count()
    bands = _dimension(served.sparkSession, [F.struct(F.lit(b).alias("band")) for b, _ in C.INTENT_BANDS])
    return bands.join(counts, "band", "left").select(
        "band", F.coalesce("count", F.lit(0)).alias("supporters"))


def action_mix(served: DataFrame, action: str = "recommended_action") -> DataFrame:
    label = F.coalesce(action, F.lit(C.STADIUM_TOUR)).alias("action")
    return (served.groupBy(label)
            .agg(F.count("*").alias("supporters"), F.round(F.avg(_score()), 1).alias("avg_intent"))
            .orderBy(F.desc("supporters"), "action"))


def revenue_by_segment(served: DataFrame) -> DataFrame:
    segment = F.when(rules.is_non_member(), "Non-members").otherwise("Members").alias("segment")
    return served.groupBy(segment).agg(
        F.count("*").alias("supporters"), F.sum(_value()).cast("double").alias("value"))


def engagement_trend(served: DataFrame, weeks: int = 8, compat: bool = False) -> DataFrame:
    """Mean engagement per week since the last activity, 0 for an empty week.

    ``compat`` treats 0 days as never active, so that today's supporters leave week 1.
    """
    days = F.coalesce("days_since_last_activity", F.lit(C.NEVER_DAYS))
    if compat:
        days = F.when(days == 0, C.NEVER_DAYS).otherwise(days)
    week = (F.floor(days / 7) + 1).alias("week")
    means = (served.filter((days >= 0) & (days < 7 * weeks)).groupBy(week)
             .agg(F.avg(F.coalesce("engagement_score", F.lit(0))).alias("mean")))
    return (served.sparkSession.range(1, weeks + 1, 1, 1).withColumnRenamed("id", "week")
            .join(means, "week", "left")
            .select("week", F.format_string("-%dw", "week").alias("label"),
                    F.coalesce(_whole(F.col("mean")), F.lit(0)).alias("score"))
            .orderBy(F.desc("week")))


# ---- lookup -----------------------------------------------------------------------------


def search(served: DataFrame, q: str = "", limit: int = 25) -> DataFrame:
    """Case-insensitive substring of id or first name, by intent."""
    q = (q or "").lower().strip()
    hits = served.filter(F.lower("supporter_id").contains(q)
                         | F.lower(F.coalesce("first_name", F.lit(""))).contains(q))
    return _top(hits.withColumn("purchase_intent_score", _score()), limit, _score(), SEARCH_COLUMNS)


def supporter_detail(served: DataFrame, feed: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Profile, scores, next best action and nested recent activity, for all or for ``ids``."""
    if ids is not None:
        served = served.join(ids, "supporter_id", "left_semi")
        feed = feed.join(ids, "supporter_id", "left_semi")
    listed = served.withColumns({
        "intent": _score(),
        "engagement": F.coalesce("engagement_score", F.lit(0)),
        "opportunity_type": _opportunity(),
    })
    nothing = F.array().cast(feed.schema["activity"].dataType)
    return (listed.join(feed, "supporter_id", "left")
            .withColumn("activity", F.coalesce("activity", nothing)))


# ---- opportunities ----------------------------------------------------------------------


def opportunities(served: DataFrame) -> DataFrame:
    """Every opportunity type with its metadata, supporters, value and mean intent."""
    grouped = served.groupBy(_opportunity().alias("type")).agg(
        F.count("*").alias("n"), F.sum(_value()).alias("v"), F.avg(_score()).alias("i"))
    names = ("type", "description", "action", "owner", "kpi")
    dim = _dimension(served.sparkSession, [
        F.struct(*[F.lit(x).alias(n) for n, x in zip(names, (t, *meta))])
        for t, meta in C.OPPORTUNITY_META.items()
    ])
    return dim.join(grouped, "type", "left").select(
        *names,
        F.coalesce("n", F.lit(0)).alias("supporters"),
        F.coalesce(_whole(F.col("v")), F.lit(0)).alias("value"),
        F.coalesce(_whole(F.col("i")), F.lit(0)).alias("avg_intent"),
    ).orderBy(F.desc("supporters"), "type")


def opportunity_ranking(served: DataFrame) -> DataFrame:
    return opportunities(served).select(
        F.col("type").alias("opportunity"), "supporters", F.col("action").alias("recommended"))


def opportunity_distribution(served: DataFrame) -> DataFrame:
    return (served.groupBy("opportunity_type").agg(F.count("*").alias("supporters"))
            .orderBy(F.desc("supporters"), "opportunity_type"))


def opportunity_members(served: DataFrame, limit: int = 50, kind: str | None = None) -> DataFrame:
    """Best ``limit`` supporters of one opportunity type, or of each type.

    For all types at once the rank filter runs per task before the shuffle, so a type that
    holds most supporters does not gather in one place.
    """
    listed = served.withColumns({"purchase_intent_score": _score(), "opportunity_type": _opportunity()})
    columns = ("opportunity_type", *SEARCH_COLUMNS)
    if kind is not None:
        return _top(listed.filter(F.col("opportunity_type") == kind), limit, _score(), columns)
    w = Window.partitionBy("opportunity_type").orderBy(F.desc("purchase_intent_score"), "supporter_id")
    return (listed.select(*columns).withColumn("position", F.row_number().over(w))
            .filter(F.col("position") <= limit))


def _measures(kind: str, prefix: str) -> list[Column]:
    here = _opportunity() == kind
    mean = F.avg(F.when(here, _score()))
    return [
        F.count_if(here).alias(f"{prefix}_count"),
        _whole(_total(F.when(here, _value()))).alias(f"{prefix}_value"),
        F.coalesce(_whole(mean), F.lit(0)).alias(f"{prefix}_avg_intent"),
    ]


def commercial_kpis(served: DataFrame) -> DataFrame:
    """Value and intent KPIs and five opportunity blocks from one pass."""
    high = _score() >= C.HIGH_INTENT
    return served.agg(
        _whole(_total(_value())).alias("total_supporter_value"),
        F.count_if(high).alias("high_intent_supporters"),
        _whole(_total(F.when(high, _value()))).alias("high_intent_value"),
        *_measures(C.MEMBERSHIP_OPPORTUNITY, "membership"),
        *_measures(C.HOSPITALITY_OPPORTUNITY, "hospitality"),
        *_measures(C.REENGAGEMENT_OPPORTUNITY, "reengagement"),
        *_measures(C.TICKET_INTENT, "ticket"),
        *_measures(C.MERCHANDISE_OPPORTUNITY, "merchandise"),
    )


def business_case(served: DataFrame, a: BusinessAssumptions) -> DataFrame:
    """Addressable value scaled to a representative base, then converted under assumptions."""
    totals = served.agg(
        F.count("*").alias("supporters"),
        F.count_if(_actionable()).alias("actionable_supporters"),
        _total(F.when(_actionable(), _value())).cast("double").alias("addressable"),
    )
    return business_case_from(totals, a)


def business_case_from(totals: DataFrame, a: BusinessAssumptions) -> DataFrame:
    """``totals``: supporters, actionable_supporters, addressable (one row)."""
    scale = F.when(F.col("supporters") > 0, F.lit(float(a.representative_base)) / F.col("supporters"))
    cost = F.lit(a.annual_platform_cost)
    steps = (
        totals
        .withColumn("scaled", F.col("addressable") * F.coalesce(scale, F.lit(1.0)))
        .withColumn("converted", F.col("scaled") * F.lit(a.baseline_conversion_pct / 100.0)
                    * F.lit(a.expected_uplift_pct / 100.0))
        .withColumn("contribution", F.col("converted") * F.lit(a.contribution_margin_pct / 100.0))
        .withColumn("roi", F.when(cost != 0, (F.col("contribution") - cost) / cost).otherwise(0.0))
        .withColumn("payback", F.when(F.col("contribution") > 0, cost / (F.col("contribution") / 12.0)))
    )
    return steps.select(
        "supporters", "actionable_supporters",
        _whole(F.col("addressable")).alias("addressable_value_sample"),
        _whole(F.col("scaled")).alias("scaled_addressable_value"),
        _whole(F.col("converted")).alias("incremental_converted_value"),
        _whole(F.col("contribution")).alias("incremental_gross_contribution"),
        F.bround("roi", 2).alias("roi_x"),
        _whole(F.col("roi") * 100).alias("roi_pct"),
        F.bround("payback", 1).alias("payback_months"),
    )


# ---- named questions --------------------------------------------------------------------


def top_intent(served: DataFrame, n: int = 10) -> DataFrame:
    return _top(served, n, _score(), ("supporter_id", "first_name", "membership_tier",
                                      "purchase_intent_score", "recommended_action"))


def rank_intent(served: DataFrame, n: int = 10) -> DataFrame:
    """Supporters with RANK() by intent at most ``n``, ties kept.

    Scores are clamped to 0..100, so ranks come from a histogram of at most 101 rows; no
    window ever spans the whole table.
    """
    w = Window.orderBy(F.desc("purchase_intent_score"))
    hist = served.groupBy("purchase_intent_score").agg(F.count("*").alias("_n"))
    above = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    ranks = (hist.withColumn("intent_rank", F.coalesce(above, F.lit(0)) + 1)
             .filter(F.col("intent_rank") <= n).drop("_n"))
    return served.join(F.broadcast(ranks), "purchase_intent_score").select(
        "intent_rank", "supporter_id", "first_name", "purchase_intent_score", "recommended_action")


def ticket_prospects(served: DataFrame, n: int = 15) -> DataFrame:
    hit = (F.col("ticket_views_30d") >= 2) & (
        (F.col("recommended_action") == C.MATCH_TICKET) | (F.col("opportunity_type") == C.TICKET_INTENT))
    return _top(served.filter(hit), n, _score(),
                ("supporter_id", "first_name", "ticket_views_30d", "purchase_intent_score"))


def non_member_attenders(served: DataFrame, n: int = 15) -> DataFrame:
    return _top(served.filter(rules.is_non_member()), n, F.col("matches_attended"),
                ("supporter_id", "first_name", "membership_tier", "matches_attended",
                 "purchase_intent_score"))


def non_member_attender_count(served: DataFrame, matches: int = 2) -> DataFrame:
    return served.filter(rules.is_non_member() & (F.col("matches_attended") >= matches)).agg(
        F.count("*").alias("supporter_count"))


def cart_abandoners(served: DataFrame, n: int = 15) -> DataFrame:
    return _top(served.filter(F.col("cart_abandons_30d") >= 1), n, F.col("cart_abandons_30d"),
                ("supporter_id", "first_name", "cart_abandons_30d", "product_views_30d",
                 "purchase_intent_score"))


def membership_campaign(served: DataFrame, n: int = 15) -> DataFrame:
    return _top(served.filter(F.col("recommended_action") == C.MEMBERSHIP_UPGRADE), n, _score(),
                ("supporter_id", "first_name", "matches_attended", "membership_views_30d",
                 "purchase_intent_score"))


def _international(cfg: EngineConfig) -> Column:
    return ~F.col("country").eqNullSafe(cfg.home_country)


def international_merch(served: DataFrame, cfg: EngineConfig, n: int = 15) -> DataFrame:
    return _top(served.filter(_international(cfg)), n, F.col("total_merchandise_spend"),
                ("supporter_id", "first_name", "country", "total_merchandise_spend"))


def merch_category_international(orders: DataFrame, supporters: DataFrame, cfg: EngineConfig,
                                 n: int = 1) -> DataFrame:
    """Most ordered categories of supporters abroad; orders shrink to one row per supporter
    and category before the join, so a hot supporter cannot skew it."""
    per_supporter = orders.groupBy("supporter_id", "category").agg(
        F.count("*").alias("orders"), F.sum("quantity").alias("items"))
    abroad = supporters.filter(_international(cfg)).select("supporter_id")
    return (per_supporter.join(abroad, "supporter_id", "left_semi").groupBy("category")
            .agg(F.sum("orders").alias("orders"), F.sum("items").alias("items"))
            .orderBy(F.desc("orders"), "category").limit(n))


def high_intent_value(gold: DataFrame) -> DataFrame:
    return gold.filter(_score() >= C.HIGH_INTENT).agg(
        _total(_value()).cast("double").alias("total_customer_value"))


def non_member_value(gold: DataFrame) -> DataFrame:
    return gold.filter(rules.is_non_member()).agg(
        _total(_value()).cast("double").alias("total_customer_value"))


def action_value(gold: DataFrame) -> DataFrame:
    return (gold.filter(F.col("recommended_next_action").isNotNull())
            .groupBy("recommended_next_action")
            .agg(F.sum(_value()).cast("double").alias("total_customer_value"))
            .orderBy(F.desc("total_customer_value"), "recommended_next_action"))


def action_like_value(gold: DataFrame, pattern: str = "%Hospitality%") -> DataFrame:
    return gold.filter(F.col("recommended_next_action").ilike(pattern)).agg(
        F.count("*").alias("supporter_count"),
        _total(_value()).cast("double").alias("total_customer_value"))


def inactive_over(gold: DataFrame, days: int = 60) -> DataFrame:
    return gold.filter(F.col("days_since_last_activity") > days).agg(
        F.count("*").alias("supporter_count"))


def cohort_flags(gold: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Overlapping cohorts: the baseline rule conditions without their priority."""
    t = cfg.baseline
    return gold.agg(
        F.count_if((F.col("ticket_views_30d") >= t.ticket_views)
                   & (F.col("ticket_purchases") <= t.max_purchases)).alias("ticket_intent"),
        F.count_if((F.col("matches_attended") >= t.upgrade_attended)
                   & rules.is_non_member()).alias("membership_opp"),
        F.count_if((F.col("product_views_30d") >= t.product_views)
                   | (F.col("cart_abandons_30d") >= t.carts)).alias("merch_opp"),
        F.count_if(F.col("days_since_last_activity") >= t.inactive_days).alias("reengagement"),
    )


def hero_pick(served: DataFrame) -> DataFrame:
    """Highest-intent non-member."""
    return _top(served.filter(rules.is_non_member()), 1, F.col("intent_score"),
                ("supporter_id", "first_name", "recommended_action", "intent_score"))
