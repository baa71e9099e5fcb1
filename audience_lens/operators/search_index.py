"""Search for a part of an id or name through runs of three characters instead of a scan.

Each id and name, in lower case and with a mark at either end, is cut into its runs of three characters. The table of
runs says how many supporters have each; the postings hold the supporters, dealt by the run's hash and sorted by run. A
search reads the postings of its rarest run, one partition and few row groups of it, and checks the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from audience_lens.operators import analytics
from audience_lens.sources.lake import Run, Snapshot

POSTINGS, GRAMS = "serving.search_postings", "serving.search_grams"
BUCKET, BUCKETS = "bucket", 64
WIDTH = 3
START, END = "\x02", "\x03"


def _runs(text: Column) -> Column:
    """Distinct runs of a marked text; none of a null."""
    marked = F.concat(F.lit(START), F.lower(text), F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - (WIDTH - 1))), lambda i: F.substring(marked, i, F.lit(WIDTH)))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("string")


def postings(served: DataFrame) -> DataFrame:
    """(gram, supporter_id, first_name, purchase_intent_score, bucket): each supporter once a run that they have."""
    none = F.array().cast("array<string>")
    grams = F.array_union(F.coalesce(_runs(F.col("supporter_id")), none), F.coalesce(_runs(F.col("first_name")), none))
    rows = served.select(F.explode(grams).alias("gram"), "supporter_id", "first_name", "purchase_intent_score")
    return rows.withColumn(BUCKET, _bucket(F.col("gram")))


def publish(run: Run, served: DataFrame) -> None:
    """Writes both tables of the index for the run's profiles."""
    run.replace(POSTINGS, postings(served), BUCKET, [str(i) for i in range(BUCKETS)], ["gram", "supporter_id"])
    run.rewrite(GRAMS, run.table(POSTINGS).groupBy("gram").agg(F.count("*").alias("n")))


def candidates(snapshot: Snapshot, part: str) -> DataFrame:
    """Postings that may match ``part``, which is in lower case; a supporter may come more than once."""
    rows, grams = snapshot.table(POSTINGS), snapshot.table(GRAMS)
    if len(part) < WIDTH:
        return rows.join(grams.filter(F.contains("gram", F.lit(part))).select("gram"), "gram", "left_semi")
    runs = {part[i:i + WIDTH] for i in range(len(part) - WIDTH + 1)}
    known = grams.filter(F.col("gram").isin(*runs)).orderBy("n", "gram").collect()  # as many as the search has runs, at most
    if len(known) < len(runs):
        return rows.limit(0)
    rarest = F.lit(known[0]["gram"])
    return rows.filter((F.col("gram") == rarest) & (F.col(BUCKET) == _bucket(rarest)))


def search(snapshot: Snapshot, served: DataFrame, part: str, limit: int = 25) -> DataFrame:
    """The rows of ``analytics.search``, for supporters that have an id. Of ``served`` only those found are looked up."""
    part = part.strip().lower()
    if not part:
        return analytics.search(served, part, limit)
    found = candidates(snapshot, part).filter(
        F.contains(F.lower("supporter_id"), F.lit(part)) | F.coalesce(F.contains(F.lower("first_name"), F.lit(part)), F.lit(False)))
    top = found.select("supporter_id", "purchase_intent_score").distinct().orderBy(
        F.coalesce("purchase_intent_score", F.lit(0)).desc(), "supporter_id").limit(limit)
    ids = [r["supporter_id"] for r in top.collect()]  # limit, at most
    return analytics.search(served.filter(F.col("supporter_id").isin(ids)), part, limit)
