"""Every operator as a query over the star-schema tables: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from audience_lens import schemas
from audience_lens.functions import cleaning as cl
from audience_lens.functions import rules, scoring
from audience_lens.operators import activity as act
from audience_lens.operators import analytics as an
from audience_lens.operators import briefs, by_supporter, intent_ml, profile, search_index, serving, silver
from audience_lens.operators import expectations as ex
from audience_lens.operators import features as ft
from audience_lens.plans import medallion
from audience_lens.plans.star import MARK, Star
from audience_lens.sources import commits, generator, tables
from audience_lens.sources.workspace import in_parallel
from audience_lens.streaming.ingest import ingest_all, ingest_stream, stream_expectations

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}



def portable(df: DataFrame) -> DataFrame:
    """Dates and times as text, exact decimals as doubles: types every SQL engine prints alike."""
    def plain(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, T.TimestampNTZType):
            text = c.cast("string")
            c = F.rpad(F.when(text.contains("."), text).otherwise(F.concat(text, F.lit("."))), 26, "0")
        elif isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        return c.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def query(fn: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
    """Register ``fn(star)`` under its own name."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: portable(fn(Star(spark, sf_dir)))
    return fn


def grouped(df: DataFrame, *columns: Column) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


# ---- sources and sinks ------------------------------------------------------------------


@query
def ingest_batch(s: Star) -> DataFrame:
    bronze = tables.ingest_batch(s.spark, s.landed("web_events"), "web_events")
    return silver.clean_web_events(bronze)


@query
def ingest_stream_exactly_once(s: Star) -> DataFrame:
    """Two runs over the same landed files: the second finds nothing new."""
    landing, mark = s.landed("marketing_events"), f"{s.stamp()}/marketing_events"
    state, out = s.folder(f"stream_state/{mark}"), s.folder(f"stream_bronze/{mark}")
    for _ in range(2):
        ingest_stream(s.spark, landing, "marketing_events", state, out)
    return silver.clean_marketing_events(s.spark.read.parquet(out))


@query
def ingest_stream_all_sources(s: Star) -> DataFrame:
    """All five channels: half of the rows land, are ingested, the rest lands, is ingested, and a third
    run finds nothing new. Rows in Bronze, with lineage, and in Silver per source."""
    mark = s.stamp()
    landing, state, bronze = (s.folder(f"{x}/{mark}") for x in ("stream_landing", "stream_state", "stream_bronze"))

    def land(source: str, half: int) -> None:
        part = s.marked(source).filter(F.pmod(MARK, F.lit(2)) == half).drop(MARK)
        part.write.mode("append").option("header", "true").csv(f"{landing}/{source}")

    for half in (0, 1, None):
        if half is not None:
            in_parallel(s.spark, [partial(land, source, half) for source in schemas.SOURCES])
        ingest_all(s.spark, landing, state, bronze)

    def counted(source: str) -> DataFrame:
        rows = s.spark.read.parquet(f"{bronze}/{source}")
        clean = silver.CLEANERS[source](rows).agg(F.count("*").alias("passed"))
        return (rows.agg(F.count("*").alias("ingested"), F.count("_source_file").alias("with_file"))
                .crossJoin(clean).withColumn("source", F.lit(source)))  # one row each

    return reduce(DataFrame.unionByName, [counted(x) for x in schemas.SOURCES])


def _land_drifted(s: Star, landing: str, rows: DataFrame) -> None:
    """Campaign events in four layouts: as expected, the other way round, one column less and one unknown, in capitals."""
    names = schemas.RAW_COLUMNS["marketing_events"]
    rows = rows.select(*[F.col(c).cast("string").alias(c) for c in names], F.lit('say "hi", you').alias("device"))
    shapes = (names, names[::-1], (*names[3:5], "device", *names[:3], names[6]), tuple(map(str.upper, names)))
    for i, shape in enumerate(shapes):
        of_shape = rows.filter(F.coalesce(F.length("supporter_id"), F.lit(0)) % 4 == i)
        of_shape.select(*[F.col(c).alias(c) for c in shape]).write.mode("append").option("header", "true").csv(landing)


def _with_rescued(bronze: DataFrame) -> DataFrame:
    return bronze.select(
        cl.blank_to_null("supporter_id").alias("supporter_id"), "campaign",
        *[cl.to_bool(c).alias(c) for c in ("sent", "opened", "clicked", "converted")],
        cl.to_timestamp_lenient("timestamp").alias("event_timestamp"), F.col(schemas.RESCUED).alias("rescued"))


@query
def ingest_drifted_batch(s: Star) -> DataFrame:
    """All campaign events from files of four layouts, read at once."""
    landing = s.folder(f"drifted/{s.stamp()}")
    _land_drifted(s, landing, s.raw("marketing_events"))
    return _with_rescued(tables.ingest_batch(s.spark, landing, "marketing_events"))


@query
def ingest_drifted_stream(s: Star) -> DataFrame:
    """The same in two landings; a third run finds nothing new."""
    mark = s.stamp()
    landing, state, out = (s.folder(f"{x}/{mark}") for x in ("drifted", "drifted_state", "drifted_bronze"))
    for half in (0, 1, None):
        if half is not None:
            _land_drifted(s, landing, s.raw("marketing_events").filter(F.length("campaign") % 2 == half))
        ingest_stream(s.spark, landing, "marketing_events", state, out)
    return _with_rescued(s.spark.read.parquet(out))


@query
def with_lineage(s: Star) -> DataFrame:
    def counted(source: str) -> DataFrame:
        bronze = tables.ingest_batch(s.spark, s.landed(source), source)
        return bronze.agg(
            F.count("*").alias("ingested"), F.count("_source_file").alias("with_file"),
            F.count("_ingested_at").alias("with_time"),
        ).withColumn("source", F.lit(source))

    return reduce(DataFrame.unionByName, [counted(x) for x in schemas.SOURCES])


@query
def rescue_malformed(s: Star) -> DataFrame:
    """Campaign lines of which some carry a surplus field; those come back verbatim."""
    def build() -> DataFrame:
        kind = F.col("event_type")
        line = F.concat_ws(",", F.concat(F.lit("S"), F.col("user_id").cast("string")), kind, F.lit("True"),
                           F.lit("True"), F.lit("False"), F.lit("False"), cl.clock("ts"))
        surplus = F.when(F.col("event_id") % 7 == 3, F.concat(F.lit(",extra"), F.col("event_id").cast("string")))
        return s.table("events").select(F.concat(line, F.coalesce(surplus, F.lit(""))).alias("value"))

    path = s.landed_text("malformed_marketing", build)
    reader = s.spark.read.schema(schemas.raw_schema("marketing_events", corrupt=True))
    bronze = reader.options(**(tables.csv_options() | {"header": "false"})).csv(path)
    return tables.rescue_malformed(bronze).select("supporter_id", "campaign", schemas.CORRUPT)


@query
def write_table(s: Star) -> DataFrame:
    """Overwrite, then scan back."""
    path = s.folder(f"rewritten/{s.stamp()}/orders")
    tables.write_table(s.table("customer"), path)
    tables.write_table(s.table("orders"), path)
    return tables.read_table(s.spark, path)


@query
def refresh_increments_360(s: Star) -> DataFrame:
    """Gold after two landings that were taken in one by one; the second brings copies of the first, too."""
    return s.lake().table("gold.supporter_360")


@query
def refresh_increments_orders(s: Star) -> DataFrame:
    """First copies of orders that have landed in different runs."""
    return s.lake().table("silver.ecommerce_orders").drop("day")


@query
def refresh_increments_served(s: Star) -> DataFrame:
    """Profile and actions, both as the last run has published them."""
    return by_supporter.served(s.lake()).select(
        "supporter_id", "membership_tier", "total_customer_value", "engagement_score", "purchase_intent_score",
        "recommended_action", "recommendation_reason", "intent_score", "opportunity_type")


@query
def refresh_increments_recent_sessions(s: Star) -> DataFrame:
    """Sessions of the recent window, from the days of the state that lie in it."""
    days = s.lake().table("state.web_sessions").filter(F.col("day") >= s.cfg.window_start.date().isoformat())
    return days.groupBy("supporter_id").agg(F.count_distinct("session_id").alias("sessions"))


LOOKED_UP = tuple(f"S{i}" for i in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 0))


@query
def lookup_activities(s: Star) -> DataFrame:
    """Latest activities of some supporters, from their buckets of the published table."""
    return _activity_text(by_supporter.lookup(s.lake(), by_supporter.FEED, LOOKED_UP))


@query
def publish_profile(s: Star) -> DataFrame:
    return serving.publish_profile(s.scored_gold(), s.scores)


@query
def publish_nba(s: Star) -> DataFrame:
    return serving.publish_nba(s.scored_gold(), s.cfg, s.scores, scoring.ref_ts(s.cfg))


@query
def export_snapshot_json(s: Star) -> DataFrame:
    """Snapshot written as JSON and read back with its schema."""
    snapshot = serving.export_snapshot(s.served)
    path = s.folder(f"snapshot/{s.stamp()}")
    tables.write_table(snapshot, path, fmt="json")
    return tables.read_table(s.spark, path, "json", snapshot.schema)


def _activity_text(feed: DataFrame) -> DataFrame:
    line = F.transform("activity", lambda x: F.concat_ws(
        "/", x["channel"], x["activity_type"], F.coalesce(x["activity_detail"], F.lit("?")),
        x["activity_timestamp"]))
    return feed.withColumn("activity", F.array_join(line, "; "))


@query
def export_activity_json(s: Star) -> DataFrame:
    """Latest ten activities nested per supporter, written as JSON and read back."""
    feed = act.export_activity(s.activity)
    path = s.folder(f"activity_json/{s.stamp()}")
    tables.write_table(feed, path, fmt="json")
    return _activity_text(tables.read_table(s.spark, path, "json", feed.schema))


@query
def load_serving(s: Star) -> DataFrame:
    return serving.load_serving(s.profile, s.nba)


def _approvals(s: Star) -> DataFrame:
    """Approved template briefs of all high-intent supporters."""
    brief = briefs.template_brief(s.facts.filter(F.col("purchase_intent_score") >= 70), s.cfg)
    return brief.select(
        "supporter_id", F.col("recommended_action").alias("next_best_action"),
        F.col("objective").alias("campaign_objective"), "recommended_channel",
        F.col("suggested_message").alias("campaign_message"),
        F.lit("marketing_user").alias("approved_by_user"))


def _log(s: Star) -> DataFrame:
    """Log after three batches: two approvals on different days and a replay of the first."""
    path = s.folder(f"activation_log/{s.stamp()}")
    approvals, first = _approvals(s), scoring.ref_ts(s.cfg)
    second = first + F.expr("INTERVAL 1 DAY")
    members = approvals.filter(F.col("next_best_action") == "Membership Upgrade")
    for name, batch, at in (("day-1", approvals, first), ("day-2", members, second), ("day-1", approvals, first)):
        serving.append_activations(path, batch, name, at)
    return serving.read_activations(s.spark, path)


@query
def append_activations(s: Star) -> DataFrame:
    return _log(s)


@query
def append_activations_channels(s: Star) -> DataFrame:
    """Each approval by two channels with two messages, one of them without action or message, in a
    batch that is sent twice."""
    path = s.folder(f"activation_log/{s.stamp()}")
    mail = _approvals(s).withColumn("recommended_channel", F.lit("Email"))
    push = mail.withColumns({"recommended_channel": F.lit("App Push"), "campaign_message": F.lit("Open the app")})
    bare = mail.withColumns({"next_best_action": F.lit(None).cast("string"), "campaign_message": F.lit(None).cast("string")})
    for _ in range(2):
        serving.append_activations(path, mail.unionByName(push).unionByName(bare), "batch-1", scoring.ref_ts(s.cfg))
    return serving.read_activations(s.spark, path)


@query
def append_activations_reused_id(s: Star) -> DataFrame:
    """A batch, other approvals under its id (refused, then sent under one of their own), and rows of a stopped call."""
    path = s.folder(f"activation_log/{s.stamp()}")
    approvals, first = _approvals(s), scoring.ref_ts(s.cfg)
    second = first + F.expr("INTERVAL 1 DAY")
    members = approvals.filter(F.col("next_best_action") == "Membership Upgrade")
    serving.append_activations(path, approvals, "day-1", first)
    serving.activations(approvals, second).write.parquet(f"{path}/rows/batch_id=day-2/writing=stopped")
    try:
        serving.append_activations(path, members, "day-1", second)
    except ValueError:
        serving.append_activations(path, members, "day-2", second)
    return serving.read_activations(s.spark, path)


@query
def recent_activations(s: Star) -> DataFrame:
    return serving.recent_activations(_log(s), 20)


@query
def evolve_log_schema(s: Star) -> DataFrame:
    old = serving.activations(_approvals(s), scoring.ref_ts(s.cfg)).select(
        "activation_id", "supporter_id", "status", "approved_at")
    return serving.evolve_log_schema(old, {"status": "string", "campaign_objective": "string",
                                           "approved_at": "timestamp_ntz", "reviewer": "string"})


@query
def merge_scores(s: Star) -> DataFrame:
    return serving.merge_scores(s.scored_gold(), s.scores).select(
        "supporter_id", "purchase_intent_score", "recommended_next_action", "recommendation_reason")


# ---- cleaning ---------------------------------------------------------------------------


@query
def blank_to_null(s: Star) -> DataFrame:
    return grouped(s.raw("web_events"), *[cl.blank_to_null(c).alias(c)
                                          for c in ("supporter_id", "product_id", "match_id")])


@query
def title_case(s: Star) -> DataFrame:
    name = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "), F.lower("p_brand"), F.lit(" "))
    return s.table("part").select("p_partkey", cl.title_case(name).alias("name"))


@query
def default_if_blank(s: Star) -> DataFrame:
    return grouped(s.raw("supporters"), cl.default_if_blank("age_band", "Unknown").alias("age_band"),
                   cl.default_if_blank("membership_tier", "None").alias("membership_tier"))


@query
def to_bool(s: Star) -> DataFrame:
    return grouped(s.raw("ticket_orders"), cl.to_bool("attended").alias("attended"))


@query
def to_timestamp_lenient(s: Star) -> DataFrame:
    key = F.col("event_id")
    text = (F.when(key % 7 == 0, "not-a-timestamp").when(key % 11 == 0, "")
            .otherwise(F.col("ts").cast("string")))
    return s.table("events").select("event_id", cl.to_timestamp_lenient(text).alias("parsed"))


@query
def to_number_lenient(s: Star) -> DataFrame:
    key = F.col("l_partkey")
    quantity = F.when(key % 13 == 0, "n/a").otherwise(F.col("l_quantity").cast("int").cast("string"))
    price = F.when(key % 17 == 0, "").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    day = F.when(key % 19 == 0, "soon").otherwise(F.col("l_shipdate").cast("date").cast("string"))
    return s.table("lineitem").select(
        cl.to_number_lenient(quantity, "int").alias("q"), cl.to_number_lenient(price, "double").alias("p"),
        cl.to_date_lenient(day).alias("d"),
    ).agg(F.count("*").alias("n"), F.count("q").alias("quantities"), F.sum("q").alias("quantity"),
          F.count("p").alias("prices"), F.sum(cl.money("p", 2)).alias("price"),
          F.count("d").alias("days"), F.max("d").alias("last_day"))


@query
def lower_trim(s: Star) -> DataFrame:
    return grouped(s.raw("web_events"), cl.lower_trim("event_type").alias("event_type"))


@query
def clean_supporters(s: Star) -> DataFrame:
    return silver.clean_supporters(s.raw("supporters"))


@query
def clean_web_events(s: Star) -> DataFrame:
    return silver.clean_web_events(s.raw("web_events"))


@query
def clean_ecommerce_orders(s: Star) -> DataFrame:
    return silver.clean_ecommerce_orders(s.raw("ecommerce_orders"))


@query
def clean_ecommerce_orders_drop_first(s: Star) -> DataFrame:
    return silver.clean_ecommerce_orders(s.raw("ecommerce_orders"), drop_first=True)


@query
def clean_ticket_orders(s: Star) -> DataFrame:
    return silver.clean_ticket_orders(s.raw("ticket_orders"))


@query
def clean_marketing_events(s: Star) -> DataFrame:
    return silver.clean_marketing_events(s.raw("marketing_events"))


@query
def dedup_first(s: Star) -> DataFrame:
    """First shipped copy of every order line."""
    line = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    lines = s.table("lineitem").select(line.alias("line_id"), "l_shipdate", "l_partkey", "l_suppkey",
                                       "l_quantity", "l_extendedprice")
    return silver.dedup_first(lines, "line_id", ["l_shipdate"])


# ---- expectations -----------------------------------------------------------------------


@query
def expect_drop(s: Star) -> DataFrame:
    typed = silver.type_ticket_orders(s.raw("ticket_orders"))
    return ex.expect_drop(typed, ex.drop_rules("ticket_orders"))


@query
def expect_warn(s: Star) -> DataFrame:
    today = F.to_date(scoring.ref_ts(s.cfg))
    layers = s.silver
    return reduce(DataFrame.unionAll, [
        ex.warn_counts(getattr(layers, source), ex.warn_rules(source, today))
        for source in ("supporters", "web_events", "ticket_orders")])


@query
def expect_stream(s: Star) -> DataFrame:
    """Expectations of all sources, counted by micro-batch. The last batch runs twice, as after a driver that stopped
    between writing and committing it; the Gold rule is counted on the 360."""
    mark = s.stamp()
    state, out = s.folder(f"expect_state/{mark}"), s.folder(f"expect_bronze/{mark}")

    def ingest(source: str) -> None:
        for _ in range(2):
            ingest_stream(s.spark, s.landed(source), source, f"{state}/{source}", f"{out}/{source}", max_files=2)
            done = max(commits.names(s.spark, f"{state}/{source}/commits"), key=int)
            for name in (done, f".{done}.crc"):
                commits.remove(s.spark, f"{state}/{source}/commits/{name}")
        ingest_stream(s.spark, s.landed(source), source, f"{state}/{source}", f"{out}/{source}")

    in_parallel(s.spark, [partial(ingest, source) for source in schemas.SOURCES])
    gold = ex.warn_counts(s.scored, ex.warn_rules("supporter_360")).select(
        F.lit("supporter_360").alias("source"), F.lit("warn").alias("kind"), "rule", "checked", "failed")
    counts = [stream_expectations(s.spark, f"{state}/{source}") for source in schemas.SOURCES]
    return reduce(DataFrame.unionByName, [*counts, gold])


@query
def expect_drop_all(s: Star) -> DataFrame:
    """Rows that the drop rules of each source leave, and how many fail each rule."""
    return reduce(DataFrame.unionByName, [
        ex.expectation_counts(silver.TYPERS[x](s.raw(x)), x).filter("kind = 'drop'").crossJoin(
            ex.expect_drop(silver.TYPERS[x](s.raw(x)), ex.drop_rules(x)).agg(F.count("*").alias("left")))  # one row
        for x in schemas.SOURCES])


def _quarantine(source: str) -> None:
    def run(s: Star) -> DataFrame:
        return ex.quarantine(s.raw(source), ex.quarantine_reasons(source))

    run.__name__ = f"quarantine_{source}"
    query(run)


for _source in schemas.SOURCES:
    _quarantine(_source)


@query
def quality_report(s: Star) -> DataFrame:
    return ex.quality_report({x: (s.raw(x), getattr(s.silver, x)) for x in schemas.SOURCES},
                             silver.TYPERS, silver.KEYS)


@query
def uniqueness_check(s: Star) -> DataFrame:
    return ex.uniqueness_check(s.gold, "supporter_id")


@query
def row_counts(s: Star) -> DataFrame:
    return ex.row_counts(
        {f"bronze_{x}": s.raw(x) for x in schemas.SOURCES}
        | {f"silver_{x}": getattr(s.silver, x) for x in schemas.SOURCES}
        | {"gold_supporter_360": s.gold, "gold_supporter_activity": s.activity})


# ---- features and 360 -------------------------------------------------------------------


@query
def web_features(s: Star) -> DataFrame:
    return ft.web_features(s.silver.web_events, s.cfg)


@query
def ecom_features(s: Star) -> DataFrame:
    return ft.ecom_features(s.silver.ecommerce_orders)


@query
def ticket_features(s: Star) -> DataFrame:
    return ft.ticket_features(s.silver.ticket_orders)


@query
def marketing_features(s: Star) -> DataFrame:
    return ft.marketing_features(s.silver.marketing_events, s.cfg)


@query
def base_360(s: Star) -> DataFrame:
    return s.base()


@query
def recency_days(s: Star) -> DataFrame:
    return s.base().select("supporter_id", *[
        scoring.recency_days(f"last_{x}_ts", s.cfg).alias(f"days_since_last_{x}")
        for x in ("purchase", "activity")])


@query
def total_customer_value(s: Star) -> DataFrame:
    return s.scored.select("supporter_id", "total_customer_value")


@query
def customer_360_baseline(s: Star) -> DataFrame:
    """Raw tables to the rule-scored 360 in one plan, without any written layer."""
    return medallion.build_360(s.cleaned(), s.cfg)


@query
def overlay_scores(s: Star) -> DataFrame:
    return ft.overlay_scores(s.scored, s.scores, s.cfg)


@query
def activity_feed(s: Star) -> DataFrame:
    return medallion.build_activity(s.silver)


# ---- scores and rules -------------------------------------------------------------------


def _column(name: str, make: Callable[[Star], dict[str, Column]],
            frame: Callable[[Star], DataFrame] = lambda s: s.scored) -> None:
    def run(s: Star) -> DataFrame:
        return frame(s).select("supporter_id", *[c.alias(n) for n, c in make(s).items()])

    run.__name__ = name
    query(run)


def _action() -> Column:
    return F.col("recommended_next_action")


_column("engagement_score", lambda s: {"score": scoring.engagement_score(s.cfg)})
_column("baseline_intent", lambda s: {"score": scoring.baseline_intent(s.cfg)})
_column("baseline_nba", lambda s: {"action": rules.baseline_nba(s.cfg)})
_column("baseline_reason", lambda s: {"reason": rules.baseline_reason(s.cfg)})
_column("behaviour_signal", lambda s: {"signal": scoring.behaviour_signal(s.cfg)})
_column("blended_intent", lambda s: {
    "score": scoring.blended_intent(F.col("purchase_intent_score") / 100.0, s.cfg)})
_column("overlay_nba", lambda s: {"action": rules.overlay_nba(s.cfg)})
_column("intent_band", lambda s: {"band": scoring.intent_band("purchase_intent_score")}, lambda s: s.gold)
_column("opportunity_type", lambda s: {"opportunity": rules.opportunity_type(_action(), s.cfg)},
        lambda s: s.gold)
_column("action_meta", lambda s: dict(zip(("channel", "kpi", "supporting_kpi"),
                                          rules.action_meta(_action(), s.cfg))), lambda s: s.gold)
_column("opportunity_meta", lambda s: dict(zip(("description", "action", "owner", "kpi"),
                                               rules.opportunity_meta(F.col("opportunity_type")))),
        lambda s: s.served)
_column("tier_ordinal", lambda s: {"ordinal": rules.tier_ordinal()}, lambda s: s.silver.supporters)
_column("is_member", lambda s: {"member": rules.is_member()}, lambda s: s.silver.supporters)


# ---- model ------------------------------------------------------------------------------


@query
def engagement_label(s: Star) -> DataFrame:
    return intent_ml.engagement_label(s.silver.marketing_events, s.cfg)


@query
def feature_frame(s: Star) -> DataFrame:
    labels = intent_ml.engagement_label(s.silver.marketing_events, s.cfg)
    return intent_ml.feature_frame(s.scored, labels)


@query
def feature_frame_leak_free(s: Star) -> DataFrame:
    return medallion.leak_free_frame(s.silver, s.cfg)


@query
def stratified_split(s: Star) -> DataFrame:
    return s.frame.select("supporter_id", intent_ml.LABEL, "is_test")


@query
def label_balance(s: Star) -> DataFrame:
    return intent_ml.label_balance(s.frame)


@query
def positive_rate(s: Star) -> DataFrame:
    return intent_ml.positive_rate(s.frame)


def _fit_check(s: Star, name: str) -> DataFrame:
    return intent_ml.fit_check(s.model(name), s.model_frame(name), name)


@query
def train_logreg(s: Star) -> DataFrame:
    """Whether the regression is at its optimum on the training rows."""
    return _fit_check(s, "logistic_regression")


@query
def train_gbt(s: Star) -> DataFrame:
    return _fit_check(s, "boosted_trees")


@query
def train_logreg_leak_free(s: Star) -> DataFrame:
    """The regression on features that end before the label window starts."""
    return _fit_check(s, "logistic_regression_leak_free")


def _metrics(s: Star) -> DataFrame:
    names = ("logistic_regression", "boosted_trees")
    return reduce(DataFrame.unionByName, [intent_ml.evaluate(s.test_predictions(n), n) for n in names])


def _rule_predictions(s: Star) -> DataFrame:
    return s.frame.select("supporter_id", intent_ml.LABEL).join(s.rule_probabilities(), "supporter_id")


@query
def evaluate_rules(s: Star) -> DataFrame:
    """Metrics of the rule baseline read as a classifier."""
    return intent_ml.evaluate(_rule_predictions(s), "rule_baseline")


@query
def confusion_matrix(s: Star) -> DataFrame:
    return intent_ml.confusion_matrix(_rule_predictions(s))


def _rank_auc(predictions: DataFrame, bins: int = 100_000) -> DataFrame:
    """Share of pairs of both labels in the right order, from a histogram of at most ``bins`` + 1 rows in which pairs of one
    bin count half: another way than ``evaluate`` takes, and as exact as the bins are fine."""
    positive = F.col(intent_ml.LABEL) == 1
    found = predictions.groupBy(F.floor(F.col("probability") * bins).alias("bin")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    below = F.sum("neg").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("neg")
    return found.withColumn("below", below).agg(
        F.round(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)) / (F.sum("pos") * F.sum("neg")), 4).alias("again"))


@query
def select_best(s: Star) -> DataFrame:
    """Models compared, whether the chosen one has the largest AUC, whether that is above chance, and whether the AUCs
    are those of the ranks of the test rows."""
    metrics = s.written("metrics", lambda: _metrics(s))
    best = intent_ml.select_best(metrics).select(F.col("model").alias("chosen"), F.col("auc").alias("top"))
    again = reduce(DataFrame.unionByName, [
        _rank_auc(s.test_predictions(m)).withColumn("model", F.lit(m)) for m in ("logistic_regression", "boosted_trees")])
    return metrics.join(again, "model").join(best, F.lit(True)).agg(  # two rows and one
        F.count("*").alias("models"), F.bool_and(F.col("auc") <= F.col("top")).alias("is_best"),
        F.bool_and((F.col("top") > 0.5) & (F.col("top") <= 1)).alias("above_chance"),
        F.count_if(F.col("model") == F.col("chosen")).alias("chosen"),
        F.bool_and(F.abs(F.col("auc") - F.col("again")) < 2.5e-4).alias("auc_agrees"))


def _by_hand(s: Star) -> tuple[DataFrame, dict[str, float], dict[str, Column]]:
    """Probabilities from the published coefficients, feature by feature and by name, the weights, and the standardised features."""
    weights = {r["feature"]: r["weight"] for r in intent_ml.coefficients(s.model("logistic_regression"), s.frame).collect()}
    train = s.frame.filter("NOT is_test")
    mean, std = (train.agg(*[f(F.col(c).cast("double")).alias(c) for c in intent_ml.INPUTS]).first() for f in (F.avg, F.stddev_samp))
    scaled = {c: (F.col(c).cast("double") - mean[c]) / std[c] if std[c] else F.lit(0.0) for c in intent_ml.INPUTS}
    margin = reduce(lambda a, b: a + b, [F.lit(weights[c]) * z for c, z in scaled.items()], F.lit(weights[intent_ml.INTERCEPT]))
    return s.frame.withColumn("by_hand", 1.0 / (1.0 + F.exp(-margin))), weights, scaled


@query
def feature_importance(s: Star) -> DataFrame:
    """Per model: features listed, those known, whether they are the heaviest in order, and whether each weighs what its name
    says: the regression's derivative by each named feature is 0, and the trees split by the named features."""
    rows, weights, scaled = _by_hand(s)
    counts = intent_ml.class_counts(s.frame.filter("NOT is_test"))
    balance, n = intent_ml.balanced_weights(counts), sum(counts.values())
    residual = (F.col("by_hand") - F.col(intent_ml.LABEL)) * F.when(F.col(intent_ml.LABEL) == 1, balance.get(1, 1.0)).otherwise(balance.get(0, 1.0))
    trees = s.model("boosted_trees").stages[-1].toDebugString

    def summary(name: str) -> DataFrame:
        top = intent_ml.feature_importance(s.model(name), s.frame)
        listed = [(r["feature"], r["importance"]) for r in top.collect()]  # eight rows
        if name == "boosted_trees":
            splits = {intent_ml.INPUTS[int(i)] for i in re.findall(r"If \(feature (\d+) ", trees)}
            named = F.lit(all((weight > 0) == (feature in splits) for feature, weight in listed))
        else:
            slopes = [F.abs(F.sum(residual * scaled[f]) / n + weights[f] / n) for f, _ in listed]
            same = all(abs(weights[f]) == weight for f, weight in listed)
            steepest = rows.filter("NOT is_test").agg(F.round(F.greatest(*slopes), 2).alias("slope"))
            named = F.lit(same and steepest.first()["slope"] == 0)
        heaviest = sorted((abs(w) for f, w in weights.items() if f != intent_ml.INTERCEPT), reverse=True)[:len(listed)]
        in_order = [w for _, w in listed] == (heaviest if name != "boosted_trees" else sorted((w for _, w in listed), reverse=True))
        return top.agg(F.lit(name).alias("model"), F.count_distinct("feature").alias("features"),
                       F.count_if(F.col("feature").isin(*intent_ml.INPUTS)).alias("known"),
                       (F.max("importance") > 0).alias("any_weight"), F.bool_and(F.col("importance") >= 0).alias("no_negative"),
                       F.lit(in_order).alias("heaviest_first"), named.alias("named_right"))

    return reduce(DataFrame.unionByName, [summary(name) for name in ("logistic_regression", "boosted_trees")])


@query
def score_all(s: Star) -> DataFrame:
    """Every supporter with the label, and whether the probability is one and the one that the published coefficients give."""
    scored = intent_ml.score_all(s.model("logistic_regression"), s.frame)
    p = F.col("probability")
    return scored.join(_by_hand(s)[0].select("supporter_id", "by_hand"), "supporter_id").select(
        "supporter_id", intent_ml.LABEL, p.between(0, 1).alias("in_range"), (F.abs(p - F.col("by_hand")) < 1e-9).alias("agrees"))


@query
def model_scores(s: Star) -> DataFrame:
    """Score table of the trained model: action, and whether the score blends the probability that the published
    coefficients give with the behaviour signal."""
    probabilities = intent_ml.score_all(s.model("logistic_regression"), s.frame)
    scores = intent_ml.publish_scores(intent_ml.intent_scores(s.scored, probabilities, s.cfg), s.cfg)
    signal = s.scored.select("supporter_id", scoring.behaviour_signal(s.cfg).cast("double").alias("signal"))
    blend = F.least(F.greatest(0.7 * (F.col("by_hand") * 100.0) + 0.3 * F.col("signal"), F.lit(0.0)), F.lit(100.0))
    by_hand = _by_hand(s)[0].select("supporter_id", "by_hand")
    return scores.join(signal, "supporter_id").join(by_hand, "supporter_id").select(
        "supporter_id", "recommended_next_action", "genai_reason",
        (F.abs(F.col("purchase_intent_score") - blend) <= 0.5 + 1e-6).alias("is_blend"))


@query
def publish_scores(s: Star) -> DataFrame:
    return s.scores


@query
def top_n_for_reason(s: Star) -> DataFrame:
    return intent_ml.top_n_for_reason(s.rule_intent_scores(), s.cfg.enriched_reasons).select(
        "supporter_id", "purchase_intent_score", "recommended_next_action")


@query
def score_summary(s: Star) -> DataFrame:
    return intent_ml.score_summary(s.scores)


# ---- serving queries --------------------------------------------------------------------


def _served(name: str, run: Callable[[Star], DataFrame]) -> None:
    run.__name__ = name
    query(run)


_served("overview_kpis", lambda s: an.overview_kpis(s.served))
_served("intent_distribution", lambda s: an.intent_distribution(s.served))
_served("action_mix", lambda s: an.action_mix(s.served))
_served("revenue_by_segment", lambda s: an.revenue_by_segment(s.served))
_served("engagement_trend", lambda s: an.engagement_trend(s.served))
_served("engagement_trend_compat", lambda s: an.engagement_trend(s.served, compat=True))
_served("search", lambda s: an.search(s.served, "#00000001"))
def _search_index(s: Star, part: str) -> DataFrame:
    now = s.indexed()
    return search_index.search(now, now.table("serving.profiles"), part)


_served("search_index", lambda s: _search_index(s, "#00000001"))
_served("search_index_short", lambda s: _search_index(s, "1"))
_served("opportunities", lambda s: an.opportunities(s.served))
_served("opportunity_ranking", lambda s: an.opportunity_ranking(s.served))
_served("opportunity_distribution", lambda s: an.opportunity_distribution(s.served))
_served("opportunity_members", lambda s: an.opportunity_members(s.served, 50))
_served("commercial_kpis", lambda s: an.commercial_kpis(s.served))
_served("business_case", lambda s: an.business_case(s.served, s.cfg.business))
_served("top_intent", lambda s: an.top_intent(s.served))
_served("rank_intent", lambda s: an.rank_intent(s.served))
_served("ticket_prospects", lambda s: an.ticket_prospects(s.served))
_served("non_member_attenders", lambda s: an.non_member_attenders(s.served))
_served("non_member_attender_count", lambda s: an.non_member_attender_count(s.served))
_served("cart_abandoners", lambda s: an.cart_abandoners(s.served))
_served("membership_campaign", lambda s: an.membership_campaign(s.served))
_served("international_merch", lambda s: an.international_merch(s.served, s.cfg))
_served("merch_category_international", lambda s: an.merch_category_international(
    s.silver.ecommerce_orders, s.silver.supporters, s.cfg))
_served("high_intent_value", lambda s: an.high_intent_value(s.gold))
_served("non_member_value", lambda s: an.non_member_value(s.gold))
_served("action_value", lambda s: an.action_value(s.gold))
_served("action_like_value", lambda s: an.action_like_value(s.gold))
_served("inactive_over", lambda s: an.inactive_over(s.gold))
_served("cohort_flags", lambda s: an.cohort_flags(s.gold, s.cfg))
_served("hero_pick", lambda s: an.hero_pick(s.served))


DETAIL = ("supporter_id", "first_name", "intent", "engagement", "recommended_action", "recommendation_reason",
          "opportunity_type", "activity")


@query
def supporter_detail(s: Star) -> DataFrame:
    return _activity_text(an.supporter_detail(s.served, s.feed)).select(*DETAIL)


@query
def supporter_detail_ids(s: Star) -> DataFrame:
    """The lookup for given ids: here those recommended hospitality."""
    ids = s.served.filter(F.col("recommended_action") == "Hospitality").select("supporter_id")
    return _activity_text(an.supporter_detail(s.served, s.feed, ids)).select(*DETAIL)


@query
def brief_facts(s: Star) -> DataFrame:
    return s.facts


@query
def facts_json(s: Star) -> DataFrame:
    """Every fact as its JSON document gives it back."""
    docs = briefs.facts_json(s.facts)
    return docs.select(*[F.get_json_object("facts", f"$.{c}").alias(c) for c in briefs.FACTS])


@query
def template_brief(s: Star) -> DataFrame:
    return briefs.template_brief(s.facts, s.cfg)


@query
def parse_brief(s: Star) -> DataFrame:
    """Replies derived from the facts: fenced, bare, partial and broken JSON by intent score."""
    score = F.col("purchase_intent_score")
    body = F.concat(F.lit('{"objective": "Win '), F.col("first_name"), F.lit('", "primary_kpi": "K'),
                    score.cast("string"), F.lit('"}'))
    broken = [F.concat(F.lit("Sure: "), body), F.lit('{"objective": "cut'), F.concat(body, F.lit(" thanks!")),
              F.concat(body, F.lit(" "), body), F.concat(body, F.lit(", "), body), F.concat(F.lit("["), body, F.lit("]")),
              F.lit("null"), F.lit("")]
    reply = F.when(score % 10 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(score % 10 == 1, body)
    for i, text in enumerate(broken, 2):
        reply = reply.when(score % 10 == i, text)
    return briefs.parse_brief(s.facts.withColumn("reply", reply), "reply", s.cfg)


@query
def reason_prompt(s: Star) -> DataFrame:
    return briefs.reason_prompt(s.gold, s.cfg)


# ---- generator and profile --------------------------------------------------------------


def _rows(s: Star, table: str, key: str) -> DataFrame:
    """One generated row per row of a table, numbered from 1."""
    return s.table(table).select((F.col(key) + 1).alias("n"))


def _people(s: Star) -> int:
    return s.table("customer").count()


SEED = 7


@query
def gen_supporters(s: Star) -> DataFrame:
    return generator.gen_supporters(_rows(s, "customer", "c_custkey"), s.cfg, SEED, with_persona=True)


@query
def gen_web_events(s: Star) -> DataFrame:
    return generator.gen_web_events(_rows(s, "events", "event_id"), _people(s), s.cfg, SEED)


@query
def gen_ecommerce_orders(s: Star) -> DataFrame:
    return generator.gen_ecommerce_orders(_rows(s, "orders", "o_orderkey"), _people(s), s.cfg, SEED)


@query
def gen_ticket_orders(s: Star) -> DataFrame:
    return generator.gen_ticket_orders(_rows(s, "orders", "o_orderkey"), _people(s), s.cfg, SEED)


@query
def gen_marketing_events(s: Star) -> DataFrame:
    return generator.gen_marketing_events(_rows(s, "events", "event_id"), _people(s), s.cfg, SEED)


def _dirty_people(s: Star) -> DataFrame:
    plain = generator.gen_supporters(_rows(s, "customer", "c_custkey"), s.cfg, SEED)
    return generator.inject_dirty(plain, SEED)


@query
def inject_dirty(s: Star) -> DataFrame:
    return _dirty_people(s).select("supporter_id", "country", "membership_tier", "age_band")


@query
def inject_duplicates(s: Star) -> DataFrame:
    orders = generator.gen_ecommerce_orders(_rows(s, "orders", "o_orderkey"), _people(s), s.cfg, SEED)
    return grouped(generator.inject_duplicates(orders, SEED), F.col("order_id"))


@query
def inject_malformed(s: Star) -> DataFrame:
    """Rows per source and reject reason after the fixed defects are appended to clean rows."""
    people = _people(s)
    clean = {
        "supporters": _dirty_people(s),
        "web_events": generator.gen_web_events(_rows(s, "events", "event_id"), people, s.cfg, SEED),
        "ecommerce_orders": generator.gen_ecommerce_orders(
            _rows(s, "orders", "o_orderkey"), people, s.cfg, SEED),
        "ticket_orders": generator.gen_ticket_orders(_rows(s, "orders", "o_orderkey"), people, s.cfg, SEED),
        "marketing_events": generator.gen_marketing_events(
            _rows(s, "events", "event_id"), people, s.cfg, SEED),
    }
    return reduce(DataFrame.unionByName, [
        grouped(generator.inject_malformed(df, source), F.lit(source).alias("source"),
                F.coalesce(ex.reject_reason(ex.quarantine_reasons(source)), F.lit("accepted"))
                .alias("reason"))
        for source, df in clean.items()])


@query
def profile_volumes(s: Star) -> DataFrame:
    return profile.profile_volumes({x: getattr(s.silver, x) for x in schemas.SOURCES})


@query
def membership_split(s: Star) -> DataFrame:
    return profile.membership_split(s.silver.supporters)


@query
def persona_mix(s: Star) -> DataFrame:
    return profile.persona_mix(gen_supporters(s))


@query
def recent_counts(s: Star) -> DataFrame:
    return profile.recent_counts(s.silver.web_events, s.cfg)


@query
def ticket_browsers_no_purchase(s: Star) -> DataFrame:
    return profile.ticket_browsers_no_purchase(s.silver.web_events, s.silver.ticket_orders, s.cfg)


@query
def frequent_non_members(s: Star) -> DataFrame:
    return profile.frequent_non_members(s.silver.ticket_orders, s.silver.supporters)


@query
def vip_spenders(s: Star) -> DataFrame:
    return profile.vip_spenders(s.silver.ecommerce_orders, 2_500_000.0)


@query
def cart_abandoner_cohort(s: Star) -> DataFrame:
    return profile.cart_abandoner_cohort(s.silver.web_events, s.cfg)


@query
def international(s: Star) -> DataFrame:
    return profile.international(s.silver.supporters, s.cfg)


@query
def distinct_buyers(s: Star) -> DataFrame:
    return profile.distinct_buyers(s.silver.ecommerce_orders, s.silver.ticket_orders)


@query
def recent_share(s: Star) -> DataFrame:
    return profile.recent_share(s.silver.web_events, s.cfg)
