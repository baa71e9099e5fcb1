"""Data-quality rules: drop, warn, quarantine and the reports over them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from audience_lens.config import TIERS
from audience_lens.functions import cleaning as cl

Reasons = Sequence[tuple[str, Column]]


def expect_drop(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Keep rows for which every rule is true; a NULL verdict drops the row."""
    return df.filter(reduce(lambda a, b: a & b, rules.values()))


def _failures(rules: Mapping[str, Column]) -> list[Column]:
    return [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]


def warn_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row per rule: rows checked and rows failing; all rules in one pass."""
    one = df.agg(F.count("*").alias("checked"), *_failures(rules))
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col("checked"), F.col(n).alias("failed")) for n in rules
    ])))


def expect_warn(df: DataFrame, rules: Mapping[str, Column], name: str) -> tuple[DataFrame, Observation]:
    """Keep every row; failures are counted while the frame is written, at no extra scan."""
    seen = Observation(name)
    return df.observe(seen, *_failures(rules)), seen


COUNTS_DDL = "source string, kind string, rule string, checked long, failed long"


def expectation_counts(typed: DataFrame, source: str, today: Column | None = None) -> DataFrame:
    """One row per rule of a source, in one pass: drop rules are checked on every row, warn rules on those that keep them.

    Counts of disjoint sets of rows add up.
    """
    drops, warns = drop_rules(source), warn_rules(source, today)
    kept = reduce(lambda a, b: a & b, [F.coalesce(rule, F.lit(False)) for rule in drops.values()])

    def failed(rule: Column, among: Column) -> Column:
        return F.count_if(among & ~F.coalesce(rule, F.lit(False)))

    one = typed.agg(F.count("*").alias("all"), F.count_if(kept).alias("kept"),
                    *[failed(rule, F.lit(True)).alias(f"drop_{n}") for n, rule in drops.items()],
                    *[failed(rule, kept).alias(f"warn_{n}") for n, rule in warns.items()])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(source).alias("source"), F.lit(kind).alias("kind"), F.lit(n).alias("rule"),
                 F.col(among).alias("checked"), F.col(f"{kind}_{n}").alias("failed"))
        for kind, among, rules in (("drop", "all", drops), ("warn", "kept", warns)) for n in rules])))


def reject_reason(reasons: Reasons) -> Column:
    """First matching reason, NULL for an accepted row."""
    (first, cond), *rest = reasons
    chain = F.when(cond, first)
    for name, c in rest:
        chain = chain.when(c, name)
    return chain


def quarantine(raw: DataFrame, reasons: Reasons) -> DataFrame:
    """Rejected raw rows with ``_reject_reason``; nothing is lost."""
    return (raw.withColumn("_reject_reason", reject_reason(reasons))
            .filter(F.col("_reject_reason").isNotNull()))


def _missing(c: str) -> Column:
    return cl.blank_to_null(c).isNull()


def _double(c: str) -> Column:
    return cl.to_number_lenient(c, "double")


def quarantine_reasons(source: str) -> Reasons:
    """Complement of the drop rules, on raw columns, in order of precedence."""
    no_supporter = ("missing_supporter_id", _missing("supporter_id"))
    return {
        "supporters": lambda: [no_supporter],
        "web_events": lambda: [
            no_supporter,
            ("invalid_event_timestamp", cl.to_timestamp_lenient("event_timestamp").isNull()),
        ],
        "ecommerce_orders": lambda: [
            ("missing_order_id", _missing("order_id")),
            no_supporter,
            ("negative_revenue", _double("revenue") < 0),
            ("null_revenue", _double("revenue").isNull()),
        ],
        "ticket_orders": lambda: [
            no_supporter,
            ("negative_price", _double("ticket_price") < 0),
            ("null_price", _double("ticket_price").isNull()),
        ],
        "marketing_events": lambda: [
            no_supporter,
            ("invalid_timestamp", cl.to_timestamp_lenient("timestamp").isNull()),
        ],
    }[source]()


def drop_rules(source: str) -> dict[str, Column]:
    """Rules on Silver columns that a row must satisfy to be kept."""
    supporter = {"valid_supporter_id": F.col("supporter_id").isNotNull()}
    return {
        "supporters": lambda: supporter,
        "web_events": lambda: supporter | {"valid_event_timestamp": F.col("event_timestamp").isNotNull()},
        "ecommerce_orders": lambda: {"valid_order_id": F.col("order_id").isNotNull()} | supporter
        | {"non_negative_revenue": F.col("revenue") >= 0},
        "ticket_orders": lambda: supporter | {"non_negative_price": F.col("ticket_price") >= 0},
        "marketing_events": lambda: supporter
        | {"valid_event_timestamp": F.col("event_timestamp").isNotNull()},
    }[source]()


def warn_rules(source: str, today: Column | None = None) -> dict[str, Column]:
    """Rules on Silver columns whose failures are counted but kept."""
    today = F.current_date() if today is None else today
    registered = F.col("registration_date")
    return {
        "supporters": lambda: {
            "valid_membership_tier": F.col("membership_tier").isin(*TIERS),
            "sensible_registration_date": registered.isNull() | (registered <= today),
        },
        "web_events": lambda: {"known_event_type": cl.known_event_type("event_type")},
        "ticket_orders": lambda: {"match_populated": F.col("match").isNotNull() & (F.col("match") != "")},
        "supporter_360": lambda: {"one_row_per_supporter": F.col("supporter_id").isNotNull()},
    }.get(source, dict)()


def quality_report(layers: Mapping[str, tuple[DataFrame, DataFrame]],
                   typed: Mapping[str, Callable[[DataFrame], DataFrame]],
                   keys: Mapping[str, str]) -> DataFrame:
    """Per source ``{name: (bronze, silver)}``: ingested, passed, rejected, duplicates, lost, pass rate.

    Duplicates are counted on their own: accepted rows less distinct records, which are known by the
    source's key in ``keys`` or, without one, by all columns that ``typed`` gives. ``lost`` are accepted
    records that are neither in Silver nor a duplicate (a bad earliest copy that took its key along).
    Counts are stacked and summed per source, so no join is needed.
    """
    names = ("ingested", "rejected", "passed", "duplicates")

    def row(name: str, **counts: Column) -> list[Column]:
        zero = F.lit(0).cast("bigint")
        return [F.lit(name).alias("source"), *[counts.get(c, zero).alias(c) for c in names]]

    parts = []
    for name, (bronze, silver) in layers.items():
        verdict = reject_reason(quarantine_reasons(name))
        parts.append(bronze.agg(F.count("*").alias("n"), F.count(verdict).alias("bad"))
                     .select(*row(name, ingested=F.col("n"), rejected=F.col("bad"))))
        parts.append(silver.agg(F.count("*").alias("n")).select(*row(name, passed=F.col("n"))))
        accepted = typed[name](bronze.filter(verdict.isNull()))
        records = accepted.groupBy(*([keys[name]] if name in keys else accepted.columns)).agg(F.count("*").alias("n"))
        parts.append(records.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
                     .select(*row(name, duplicates=F.col("n"))))
    counts = reduce(DataFrame.unionAll, parts).groupBy("source").agg(*[F.sum(c).alias(c) for c in names])
    return counts.select(
        "source", "ingested", "passed", "rejected", "duplicates",
        (F.col("ingested") - F.col("rejected") - F.col("duplicates") - F.col("passed")).alias("lost"),
        F.when(F.col("ingested") > 0, F.round(
            F.lit(100.0) * (F.col("ingested") - F.col("rejected")) / F.col("ingested"), 2)
        ).alias("pass_rate"),
    )


def uniqueness_check(df: DataFrame, key: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"),
    ).withColumn("is_unique", F.col("n_rows") == F.col("n_keys"))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in tables.items()
    ])
