"""Headline queries at one scale: median of three timed runs after a warm-up, one JSON line.

``layers`` is the cold build of every written layer; queries that read written layers are timed on
top of it. Results go to the noop sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from audience_lens.plans.registry import QUERIES
from audience_lens.plans.star import Star
from audience_lens.sources.workspace import in_parallel

HEADLINE = (
    # straight from the given tables
    "customer_360_baseline", "clean_supporters", "clean_web_events", "clean_ecommerce_orders",
    "clean_ticket_orders", "clean_marketing_events", "quarantine_ecommerce_orders", "dedup_first",
    # over written Silver
    "web_features", "ecom_features", "ticket_features", "base_360", "activity_feed",
    "merch_category_international", "ticket_browsers_no_purchase",
    # over the written Gold and serving tables
    "overlay_scores", "export_activity_json", "supporter_detail", "opportunity_members",
    "overview_kpis", "commercial_kpis", "business_case", "rank_intent", "template_brief",
    "stratified_split", "evaluate_rules",
    # generator
    "gen_web_events", "gen_ecommerce_orders",
)
RUNS = 3


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site lookups
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    star = Star(spark, sf_dir)
    star.silver
    in_parallel(spark, [lambda name=name: getattr(star, name) for name in ("served", "feed", "frame")])
    queries = {"layers": round(time.perf_counter() - start, 3)}
    for name in HEADLINE:
        run(spark, name, sf_dir)
        queries[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "total_median_wall_clock", "value": round(sum(queries.values()), 3), "unit": "sec",
        "queries": queries, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
