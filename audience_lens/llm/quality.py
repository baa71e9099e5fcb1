"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at counts of the whole text and votes good (1), bad (-1) or abstains (0). What the
rules are worth isn't set by hand: with two hidden classes, a share of good documents and for every
rule the chance of a right vote in either class, expectation-maximisation fits these numbers to how
the votes of all documents agree. The posterior chance of "good" decides. Documents with equal votes
are alike to the model, so it is fitted to the counts of vote patterns, of which there are at most
3 to the number of rules, however large the corpus. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from audience_lens.llm.common import saved, table

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
ROUNDS = 30
RULES = ("repeats", "symbols", "lines", "word_length", "size", "symbol_runs")
#: Chances of a right vote and the share of good documents are kept inside these. A rule must be right
#: on most good documents, so the classes can't trade places; on bad ones it may miss what it isn't for.
GOOD_BOUNDS, BAD_BOUNDS, SHARE_BOUNDS = (0.6, 0.999), (0.05, 0.999), (0.3, 0.98)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more in the text. Equal windows have equal
    hashes, so texts whose hashes all differ are done; the others compare the windows themselves."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), n - WINDOW + 1)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i, WINDOW)).alias("w"),
                                                                  i.alias("i"))))

    def equal_neighbours(own: Column) -> Column:
        pairs = F.zip_with(own, F.slice(own, F.lit(2), F.size(own)),
                           lambda a, b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (a["w"] == b["w"]).alias("eq")))
        return F.flatten(F.transform(F.filter(pairs, lambda x: x["eq"]), lambda x: F.array(x["i"], x["j"])))

    # the one-element array names its value, which is then made once
    twice = F.transform(F.array(windows), equal_neighbours)[0]
    covered = F.aggregate(
        F.sort_array(F.array_distinct(twice)), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("n"), i.alias("at")),
        lambda acc: acc["n"])
    return (F.when(n < WINDOW + 1, 0)
            .when(F.size(F.array_distinct(hashes)) == n - WINDOW + 1, 0)
            .otherwise(covered).cast("long"))


def base_counts(docs: DataFrame, text_col: str = "_text") -> DataFrame:
    """Adds the base counts and ``base_failed`` to ``docs``; null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.withColumn("_words", _words(text))
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
                        lambda x: F.xxhash64(x))
    whole = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_dup = F.when(F.size(F.array_distinct(lines)) == F.size(lines), 0).otherwise(
        F.size(whole) - F.size(F.array_distinct(whole)))
    counted = split.select(
        "*", F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        n_dup.cast("long").alias("n_dup_lines"), _repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size(whole).cast("long").alias("_lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]+")).cast("long").alias("_runs")).drop("_words")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def votes(counted: DataFrame) -> DataFrame:
    """Adds ``v_<rule>`` (1 good, -1 bad, 0 abstains) for every rule. A rule without anything to
    measure abstains."""
    n, chars = F.col("n_words"), F.col("word_chars")

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    each = {
        "repeats": rule(F.col("n_repeat_words") * 6 > n, F.col("n_repeat_words") * 50 <= n),
        "symbols": rule(F.col("n_symbols") * 25 > chars, F.col("n_symbols") * 100 <= chars),
        "lines": rule(F.col("n_dup_lines") * 4 > F.col("_lines"), F.col("n_dup_lines") == 0),
        "word_length": rule((chars < 3 * n) | (chars > 11 * n), (chars >= 3.5 * n) & (chars <= 9 * n)),
        "size": rule(n < 15, n >= 30),
        "symbol_runs": rule(F.col("_runs") * 5 > n, F.col("_runs") * 20 <= n),
    }
    return counted.withColumns({f"v_{k}": F.when(n > 0, v).otherwise(0).cast("int") for k, v in each.items()})


def _posterior(share: float, right_good: dict[str, float], right_bad: dict[str, float]) -> Column:
    """Chance of "good" given the votes."""
    def odds(rule: str) -> Column:
        g, b = right_good[rule], right_bad[rule]
        return F.when(F.col(f"v_{rule}") == 1, F.lit(g / (1 - b))).when(
            F.col(f"v_{rule}") == -1, F.lit((1 - g) / b)).otherwise(F.lit(1.0))

    product = reduce(lambda a, b: a * b, (odds(r) for r in RULES), F.lit(share / (1 - share)))
    return product / (1 + product)


def fit(voted: DataFrame) -> tuple[float, dict[str, float], dict[str, float]]:
    """Share of good documents and, for every rule, the chance of a right vote on good and on bad ones.

    Each round is one aggregation over the written table of vote patterns (at most 3 to the number of
    rules); the driver sees one row of sums. An empty table keeps the starting values.
    """
    names = [f"v_{r}" for r in RULES]
    patterns = saved(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    share, right_good, right_bad = 0.85, dict.fromkeys(RULES, 0.9), dict.fromkeys(RULES, 0.5)

    def inside(x: float, bounds: tuple[float, float]) -> float:
        return round(min(max(x, bounds[0]), bounds[1]), 9)

    for _ in range(ROUNDS):
        good = F.col("n") * F.col("p")
        bad = F.col("n") * (1 - F.col("p"))
        sums = [F.sum("n").alias("n"), F.sum(good).alias("good")]
        for r in RULES:
            v = F.col(f"v_{r}")
            sums += [F.sum(F.when(v == 1, good).otherwise(0.0)).alias(f"gg_{r}"),
                     F.sum(F.when(v != 0, good).otherwise(0.0)).alias(f"g_{r}"),
                     F.sum(F.when(v == -1, bad).otherwise(0.0)).alias(f"bb_{r}"),
                     F.sum(F.when(v != 0, bad).otherwise(0.0)).alias(f"b_{r}")]
        row = patterns.withColumn("p", _posterior(share, right_good, right_bad)).agg(*sums).first()
        if not row.n:
            break
        # one right and one wrong vote for each rule and class are taken as seen, so no chance is 0 or 1
        new = (inside(row.good / row.n, SHARE_BOUNDS),
               {r: inside((row[f"gg_{r}"] + 1) / (row[f"g_{r}"] + 2), GOOD_BOUNDS) for r in RULES},
               {r: inside((row[f"bb_{r}"] + 1) / (row[f"b_{r}"] + 2), BAD_BOUNDS) for r in RULES})
        if new == (share, right_good, right_bad):
            break
        share, right_good, right_bad = new
    return share, right_good, right_bad


def judged(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``docs`` with counts, votes, ``posterior`` and ``kept``; ``keep`` are the input columns to carry.
    The counts are made once: they are written, then the model is fitted and applied."""
    carried = docs.select(*[F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(keep)],
                          F.col(f"`{text_col}`").alias("_text"))
    written = saved(votes(base_counts(carried)).drop("_text"), "votes")
    posterior = _posterior(*fit(written))
    return (written.withColumn("posterior", posterior)
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, base counts, ``base_failed``, votes, posterior and ``kept``.

    Null and empty texts have no words and fail the base rule. Null ids stay null, repeated rows are
    judged each, other columns are ignored, an empty table gives no rows.
    """
    out = judged(docs, [id_col], text_col)
    return out.select(F.col("_in_0").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept", F.round("posterior", 9).alias("posterior"),
                      *[f"v_{r}" for r in RULES])


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Null and empty texts have no word and go; repeated rows are judged each and stay or go together; null ids and columns
    of any name are carried along; an empty table gives no rows.
    """
    names = docs.columns
    out = judged(docs, names, text_col).filter("kept")
    return out.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(names)])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))
