"""Campaign briefs: grounded facts, template brief, model reply parsing, reason prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from audience_lens import config as C
from audience_lens.config import EngineConfig
from audience_lens.functions import rules

BRIEF_KEYS = ("objective", "why_now", "recommended_channel", "offer_angle", "suggested_message",
              "primary_kpi", "supporting_kpi", "risk_guardrail")

# Texts of the template brief and of a parsed brief without a guardrail.
OFFER_ANGLE = ("Relevant, timely and brand-appropriate — grounded in this supporter's recent "
               "behaviour.")
GUARDRAIL = ("Do not over-target recently contacted supporters; respect email opt-in and contact "
             "frequency caps.")
SHORT_GUARDRAIL = "Respect contact frequency caps and opt-in."
TEMPLATE_AUTHOR = "template (LLM unavailable)"

_ZERO_FILLED = ("matches_attended", "ticket_views_30d", "product_views_30d", "cart_abandons_30d",
                "membership_views_30d", "marketing_opens_30d", "purchase_intent_score")
FACTS = ("supporter_id", "first_name", "membership_tier", "country", "matches_attended",
         "ticket_views_30d", "product_views_30d", "cart_abandons_30d", "membership_views_30d",
         "marketing_opens_30d", "days_since_last_activity", "total_customer_value",
         "purchase_intent_score", "recommended_action", "recommendation_reason")


def brief_facts(served: DataFrame) -> DataFrame:
    """The only facts a brief may use; NULL counts become 0, value is whole."""
    value = F.coalesce("total_customer_value", F.lit(0.0))
    fills = {c: F.coalesce(c, F.lit(0)) for c in _ZERO_FILLED}
    fills["total_customer_value"] = F.bround(value, 0).cast("bigint")
    return served.withColumns(fills).select(*FACTS)


def facts_json(facts: DataFrame) -> DataFrame:
    """Facts as one JSON document per supporter, the payload of a prompt."""
    doc = F.to_json(F.struct(*FACTS), {"ignoreNullFields": "false"})
    return facts.select("supporter_id", doc.alias("facts"))


def _text(c: str) -> Column:
    """A NULL name prints as None, as it does in the served texts."""
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


# Wording of the objective, fallback reason and message.
def _template(cfg: EngineConfig) -> dict[str, Column]:
    action = F.coalesce("recommended_action", F.lit(C.STADIUM_TOUR))
    channel, kpi, supporting = rules.action_meta(action, cfg)
    name = _text("first_name")
    scored = F.concat(name, F.lit(" has an intent score of "), F.col("purchase_intent_score").cast("string"),
                      F.lit("/100 with recent relevant activity."))
    return {
        "objective": F.concat(F.lit("Convert "), name, F.lit("'s current intent into a "),
                              F.lower(action), F.lit(" outcome.")),
        "why_now": F.coalesce(F.nullif("recommendation_reason", F.lit("")), scored),
        "recommended_channel": channel,
        "offer_angle": F.lit(OFFER_ANGLE),
        "suggested_message": F.concat(
            F.lit("Hi "), name,
            F.lit(", based on your recent activity we've lined up something for you. Explore your "),
            F.lower(action), F.lit(f" options with {cfg.brand}.")),
        "primary_kpi": kpi,
        "supporting_kpi": supporting,
        "risk_guardrail": F.lit(GUARDRAIL),
    }


def template_brief(facts: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Deterministic brief of every supporter."""
    return facts.select(
        "supporter_id",
        F.coalesce("recommended_action", F.lit(C.STADIUM_TOUR)).alias("recommended_action"),
        *[c.alias(n) for n, c in _template(cfg).items()],
        F.lit(TEMPLATE_AUTHOR).alias("generated_by"),
    )


def _unfenced(reply: Column) -> Column:
    """Body of a fenced reply without its language tag, else the trimmed reply."""
    trimmed = F.regexp_replace(reply, r"^\s+|\s+$", "")
    body = F.element_at(F.split(trimmed, "```"), 2)
    body = F.regexp_replace(F.regexp_replace(body, "^[json]+", ""), r"^\s+|\s+$", "")
    return F.when(trimmed.startswith("```"), body).otherwise(trimmed)


def parse_brief(facts: DataFrame, reply: str, cfg: EngineConfig, author: str = "GenAI") -> DataFrame:
    """Model reply of each supporter as a brief.

    Missing keys take defaults; a reply that is not exactly one JSON object falls back to the template.
    The parser stops behind the first value, so the reply is read inside an object and inside a list:
    text behind it breaks at least one of the two, as they close differently.
    """
    broken = "_broken"
    body = _unfenced(F.col(reply))
    brief = T.StructType([T.StructField(k, T.StringType()) for k in BRIEF_KEYS])

    def inside(before: str, kind: T.DataType, after: str) -> Column:
        schema = T.StructType([T.StructField("v", kind), T.StructField(broken, T.StringType())])
        return F.from_json(F.concat(F.lit(before), body, F.lit(after)), schema, {
            "columnNameOfCorruptRecord": broken, "mode": "PERMISSIVE", "allowSingleQuotes": "false"})

    parsed = F.struct(inside('{"v":', brief, "}").alias("one"), inside('{"v":[', T.ArrayType(brief), "]}").alias("many"))
    channel, kpi, supporting = rules.action_meta(F.col("recommended_action"), cfg)
    defaults = {"recommended_channel": channel, "primary_kpi": kpi, "supporting_kpi": supporting,
                "risk_guardrail": F.lit(SHORT_GUARDRAIL)}
    template = _template(cfg)
    ok = (body.startswith("{") & F.col("_reply.one.v").isNotNull() & F.col(f"_reply.one.{broken}").isNull()
          & F.col(f"_reply.many.{broken}").isNull() & (F.size("_reply.many.v") == 1))
    usable = F.coalesce(ok, F.lit(False))
    return facts.withColumn("_reply", parsed).select(
        "supporter_id",
        F.coalesce("recommended_action", F.lit(C.STADIUM_TOUR)).alias("recommended_action"),
        *[F.when(usable, F.coalesce(f"_reply.one.v.{k}", defaults.get(k, F.lit(""))))
          .otherwise(template[k]).alias(k) for k in BRIEF_KEYS],
        F.when(usable, author).otherwise(TEMPLATE_AUTHOR).alias("generated_by"),
    )


def reason_prompt(scored: DataFrame, cfg: EngineConfig, action: str = "recommended_next_action") -> DataFrame:
    """Prompt that asks for a one-sentence reason, built from features only."""
    def n(c: str) -> Column:
        return F.col(c).cast("bigint").cast("string")

    value = F.bround("total_customer_value", 0).cast("bigint").cast("string")
    prompt = F.concat(
        F.lit(f"{cfg.brand} wants to offer "), F.col(action), F.lit(" to "), _text("first_name"),
        F.lit(". Write one sentence of at most 30 words that says why, using these facts only: tier "),
        F.col("membership_tier"), F.lit("; matches attended "), n("matches_attended"),
        F.lit("; in the last 30 days, ticket views "), n("ticket_views_30d"),
        F.lit(", product views "), n("product_views_30d"), F.lit(", abandoned baskets "), n("cart_abandons_30d"),
        F.lit(", membership page views "), n("membership_views_30d"),
        F.lit("; spent so far "), value, F.lit(" pounds; intent "), n("purchase_intent_score"), F.lit(" of 100."),
    )
    return scored.select("supporter_id", prompt.alias("prompt"))
