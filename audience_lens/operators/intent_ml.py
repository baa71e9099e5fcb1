"""Engagement model: labels, features, split, training, evaluation, scores.

Everything stays distributed; the driver sees model parameters, a few metric rows and class
counts only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from audience_lens.config import EngineConfig
from audience_lens.functions import rules, scoring
from audience_lens.functions.cleaning import moment
from audience_lens.functions.hashing import hash60

# Names of the features.
FEATURES = (
    "matches_attended", "total_ticket_spend", "total_merchandise_spend", "total_customer_value",
    "website_sessions_30d", "product_views_30d", "ticket_views_30d", "cart_abandons_30d",
    "membership_views_30d", "hospitality_views_30d", "marketing_opens_30d",
    "days_since_last_purchase", "days_since_last_activity", "ticket_purchases",
    "merchandise_orders",
)
INPUTS = (*FEATURES, "membership_tier_ord")
LABEL = "engaged"
THRESHOLD = 0.5


# ---- frame ------------------------------------------------------------------------------


def engagement_label(marketing: DataFrame, cfg: EngineConfig,
                     window: tuple[dt.datetime, dt.timedelta] | None = None) -> DataFrame:
    """1 if a campaign was clicked or converted in the window, per supporter with campaigns.

    The default window is the feature window itself. ``window=(cutoff, horizon)`` labels what
    happens after the cutoff, for a model whose features end there.
    """
    at = F.col("event_timestamp")
    if window is None:
        inside = scoring.in_window("event_timestamp", cfg)
    else:
        start, horizon = window
        inside = (at >= moment(start)) & (at < moment(start + horizon))
    hit = F.coalesce((F.col("clicked") | F.col("converted")) & inside, F.lit(False))
    return marketing.groupBy("supporter_id").agg(F.max(hit.cast("int")).alias(LABEL))


def feature_frame(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Behavioural features of the 360 (never its scores), tier ordinal and label."""
    return scored.join(labels, "supporter_id", "left").select(
        "supporter_id",
        *[F.col(c).cast("double").alias(c) for c in FEATURES],
        rules.tier_ordinal().cast("double").alias("membership_tier_ord"),
        F.coalesce(LABEL, F.lit(0)).alias(LABEL),
    )


def label_balance(frame: DataFrame) -> DataFrame:
    return frame.groupBy(LABEL).agg(F.count("*").alias("supporters"))


def positive_rate(frame: DataFrame) -> DataFrame:
    return frame.agg(F.count("*").alias("supporters"),
                     F.round(F.avg(F.col(LABEL).cast("double")), 3).alias("positive_rate"))


def stratified_split(frame: DataFrame, test_share: float = 0.25, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: exactly ceil(share x rows) rows of each label, by smallest id hash.

    The cut is found from a histogram of 65,536 hash buckets per label; only the rows of the
    bucket that contains the cut are ranked, so no label is ever gathered in one place.
    """
    bits = 44
    hashed = (frame.withColumn("_h", hash60(F.col("supporter_id"), "split", seed))
              .withColumn("_bucket", F.shiftright("_h", bits)))
    by_label = Window.partitionBy(LABEL)
    upto = by_label.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    histogram = hashed.groupBy(LABEL, "_bucket").agg(F.count("*").alias("_n")).withColumns({
        "_upto": F.sum("_n").over(upto),
        "_quota": F.ceil(F.sum("_n").over(by_label) * F.lit(test_share)),
    })
    cut = (histogram.filter((F.col("_upto") >= F.col("_quota"))
                            & (F.col("_upto") - F.col("_n") < F.col("_quota")))
           .select(LABEL, F.col("_bucket").alias("_cut"),
                   (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_left")))
    placed = hashed.join(F.broadcast(cut), LABEL)  # one row per label
    clear = placed.filter(F.col("_bucket") != F.col("_cut")).withColumn(
        "is_test", F.col("_bucket") < F.col("_cut"))
    order = Window.partitionBy(LABEL).orderBy("_h", "supporter_id")
    edge = placed.filter(F.col("_bucket") == F.col("_cut")).withColumn(
        "is_test", F.row_number().over(order) <= F.col("_left"))
    return clear.unionByName(edge).select(*frame.columns, "is_test")


# ---- training ---------------------------------------------------------------------------


def class_counts(train: DataFrame) -> dict[int, int]:
    """Rows per label: two numbers on the driver."""
    return {int(r[LABEL]): int(r["supporters"]) for r in label_balance(train).collect()}


def _weighted(train: DataFrame, positive: float, negative: float) -> DataFrame:
    return train.withColumn("_weight", F.when(F.col(LABEL) == 1, F.lit(positive)).otherwise(F.lit(negative)))


def balanced_weights(counts: dict[int, int]) -> dict[int, float]:
    """Weights that give both classes the same total."""
    rows = sum(counts.values())
    return {k: rows / (len(counts) * v) for k, v in counts.items()}


def _assembler(output: str) -> VectorAssembler:
    return VectorAssembler(inputCols=list(INPUTS), outputCol=output)


def train_logreg(train: DataFrame, max_iter: int = 1000) -> PipelineModel:
    """Standardised logistic regression, balanced classes, unit-strength ridge penalty."""
    counts = class_counts(train)
    rows = sum(counts.values())
    weight = balanced_weights(counts)
    stages = [
        _assembler("_raw"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_features", labelCol=LABEL, weightCol="_weight",
                           maxIter=max_iter, regParam=1.0 / max(1, rows), standardization=False,
                           predictionCol="_pred", probabilityCol="_prob", rawPredictionCol="_margin"),
    ]
    fitted = Pipeline(stages=stages).fit(_weighted(train, weight.get(1, 1.0), weight.get(0, 1.0)))
    # The summary holds the session, which can't be sent to tasks once it has observed a frame.
    fitted.stages[-1]._java_obj.setSummary(train.sparkSession._jvm.scala.Option.empty())
    return fitted


def train_gbt(train: DataFrame, trees: int = 200, seed: int = 42) -> PipelineModel:
    """Boosted trees of depth 4, positives weighted by the class ratio."""
    counts = class_counts(train)
    ratio = max(1, counts.get(0, 0)) / max(1, counts.get(1, 0))
    stages = [
        _assembler("_features"),
        GBTClassifier(featuresCol="_features", labelCol=LABEL, weightCol="_weight", maxIter=trees,
                      maxDepth=4, stepSize=0.1, subsamplingRate=0.9, featureSubsetStrategy="0.9",
                      maxMemoryInMB=512, seed=seed, predictionCol="_pred")
        .setProbabilityCol("_prob").setRawPredictionCol("_margin"),
    ]
    return Pipeline(stages=stages).fit(_weighted(train, ratio, 1.0))


def score_all(model: PipelineModel, frame: DataFrame) -> DataFrame:
    """Probability of engagement for every row."""
    return model.transform(frame).select(
        *frame.columns, vector_to_array("_prob")[1].alias("probability"))


def fit_check(model: PipelineModel, split: DataFrame, name: str) -> DataFrame:
    """One row that tells whether ``model`` was fitted to the training rows of ``split``.

    Row and positive counts of both parts; whether every probability lies in [0, 1]; whether the log-loss
    on the training rows, both classes weighing the same, is below that of a coin; and, for the regression, the largest
    derivative of its objective (weighted residuals times each standardised feature, ridge term
    included), which is 0 at the optimum. One pass over the scored rows.
    """
    last = model.stages[-1]
    linear = hasattr(last, "coefficients")
    counts = class_counts(split.filter("NOT is_test"))
    rows = sum(counts.values())
    scored = model.transform(split).withColumn("_p", vector_to_array("_prob")[1])
    train, y, p = ~F.col("is_test"), F.col(LABEL), F.col("_p")
    sure = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.when(y == 1, F.log(sure)).otherwise(F.log(1 - sure))
    weight = balanced_weights(counts)
    w = F.when(y == 1, weight.get(1, 1.0)).otherwise(weight.get(0, 1.0))
    sums = [F.count_if(train).alias("n_train"), F.count_if(train & (y == 1)).alias("train_positive"),
            F.count_if(~train).alias("n_test"), F.count_if(~train & (y == 1)).alias("test_positive"),
            F.coalesce(F.bool_and(p.between(0, 1)), F.lit(True)).alias("in_range"), (F.sum(F.when(train, w * loss)) / F.sum(F.when(train, w))).alias("_loss")]
    if linear:
        residual = F.when(train, (p - y) * w).otherwise(0.0)
        x = vector_to_array("_features")
        ridge = [*(float(c) / max(1, rows) for c in last.coefficients), 0.0]
        parts = [*(residual * x[j] for j in range(len(INPUTS))), residual]
        sums.append(F.greatest(*[F.abs(F.sum(r) / max(1, rows) + g) for r, g in zip(parts, ridge)]).alias("_slope"))
    slope = F.round("_slope", 2) if linear else F.lit(0.0)
    return scored.agg(*sums).select(
        F.lit(name).alias("model"), "n_train", "train_positive", "n_test", "test_positive", "in_range",
        (F.col("_loss") < F.log(F.lit(2.0))).alias("beats_constant"), slope.alias("slope"))


# ---- evaluation -------------------------------------------------------------------------


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion_matrix(predictions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """tn, fp, fn, tp of ``label``/``probability`` rows, in one pass."""
    said, real = F.col("probability") >= threshold, F.col(LABEL) == 1
    return predictions.agg(
        F.count_if(~said & ~real).alias("tn"), F.count_if(said & ~real).alias("fp"),
        F.count_if(~said & real).alias("fn"), F.count_if(said & real).alias("tp"))


def auc(predictions: DataFrame) -> DataFrame:
    """Exact area under the ROC curve, ties counted half.

    Equal probabilities collapse to one row first, so a value shared by many supporters costs one
    row. The distinct values are range-partitioned into parts of equal size; pairs across parts
    come from the part totals, pairs inside a part from a window over that part alone.
    """
    return _ranked(predictions, THRESHOLD).select("auc")


def _ranked(predictions: DataFrame, threshold: float) -> DataFrame:
    """One row: ``auc`` and the four counts at the threshold, all from one histogram of probabilities."""
    parts = int(predictions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pos = F.col(LABEL).cast("bigint")
    by_value = predictions.groupBy("probability").agg(
        F.sum(pos).alias("_pos"), F.sum(1 - pos).alias("_neg"))
    ranged = by_value.repartitionByRange(parts, "probability").withColumn(
        "_part", F.spark_partition_id())
    before = Window.partitionBy("_part").orderBy("probability").rowsBetween(
        Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_neg").over(before), F.lit(0))
    won = F.col("_pos").cast("double") * (below + F.col("_neg") / 2.0)
    said = F.col("probability") >= threshold
    cells = {"tn": (~said, "_neg"), "fp": (said, "_neg"), "fn": (~said, "_pos"), "tp": (said, "_pos")}
    totals = ranged.withColumn("_won", won).groupBy("_part").agg(
        *[F.sum(c).alias(c) for c in ("_won", "_pos", "_neg")],
        *[F.sum(F.when(where, F.col(c)).otherwise(0)).alias(name) for name, (where, c) in cells.items()])
    lower = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    crossed = totals.withColumn("_below", F.coalesce(F.sum("_neg").over(lower), F.lit(0)))
    wins = F.sum(F.col("_won") + F.col("_pos").cast("double") * F.col("_below"))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return crossed.agg(F.when(pairs > 0, wins / pairs).alias("auc"),
                       *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cells])


def evaluate(predictions: DataFrame, model: str) -> DataFrame:
    """One row: AUC, accuracy, precision, recall and F1 at the threshold, four decimals."""
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rates = _ranked(predictions, THRESHOLD).select(
        F.lit(model).alias("model"), "auc",
        _ratio(F.col("tp") + F.col("tn"),
               F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"),
        _ratio(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
    return rates.select(
        "model", *[F.round(c, 4).alias(c) for c in ("auc", "accuracy", "precision", "recall", "f1")])


def select_best(metrics: DataFrame) -> DataFrame:
    """Metric row of the model with the highest AUC; on a tie the linear model wins."""
    linear_first = F.col("model") != "logistic_regression"
    return metrics.orderBy(F.desc_nulls_last("auc"), linear_first, "model").limit(1)


def feature_importance(model: PipelineModel, like: DataFrame, n: int = 8) -> DataFrame:
    """Top features by absolute coefficient or by tree importance."""
    last = model.stages[-1]
    vector = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    rows = [(name, abs(float(v))) for name, v in zip(INPUTS, vector.toArray())]
    return (like.sparkSession.createDataFrame(rows, "feature string, importance double")
            .orderBy(F.desc("importance"), "feature").limit(n))


def coefficients(model: PipelineModel, like: DataFrame) -> DataFrame:
    """(feature, weight) of the regression, on standardised features, and its intercept under ``INTERCEPT``."""
    last = model.stages[-1]
    rows = [(INTERCEPT, float(last.intercept)), *((n, float(w)) for n, w in zip(INPUTS, last.coefficients.toArray()))]
    return like.sparkSession.createDataFrame(rows, "feature string, weight double")


INTERCEPT = "(intercept)"


# ---- scores -----------------------------------------------------------------------------


def intent_scores(scored: DataFrame, probabilities: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Blended score and overlay action per supporter with a probability."""
    return (scored.drop("purchase_intent_score", "recommended_next_action")
            .join(probabilities.select("supporter_id", "probability"), "supporter_id")
            .withColumns({
                "purchase_intent_score": scoring.blended_intent(F.col("probability"), cfg),
                "recommended_next_action": rules.overlay_nba(cfg),
            }))


def top_n_for_reason(scores: DataFrame, n: int) -> DataFrame:
    """The ``n`` highest-intent supporters, whose reason is to be enriched."""
    return scores.orderBy(F.desc("purchase_intent_score"), "supporter_id").limit(n)


def publish_scores(scores: DataFrame, cfg: EngineConfig,
                   enriched: DataFrame | None = None) -> DataFrame:
    """Score table; the reason is set for the top supporters and NULL (baseline) elsewhere.

    ``enriched`` has supporter_id and genai_reason; at most ``cfg.enriched_reasons`` rows are used.
    """
    out = scores.select(
        "supporter_id", "purchase_intent_score", "recommended_next_action",
        F.col("probability").alias("model_intent_prob"))
    if enriched is None:
        out = out.withColumn("genai_reason", F.lit(None).cast("string"))
    else:
        top = top_n_for_reason(scores, cfg.enriched_reasons).select("supporter_id")
        reasons = (top.join(enriched.select("supporter_id", "genai_reason"), "supporter_id")
                   .groupBy("supporter_id").agg(F.min("genai_reason").alias("genai_reason")))  # one for each of the top
        out = out.join(F.broadcast(reasons), "supporter_id", "left")
    return out.select("supporter_id", "purchase_intent_score", "recommended_next_action",
                      "genai_reason", "model_intent_prob")


def score_summary(scores: DataFrame, column: str = "purchase_intent_score") -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of a 0..100 score.

    The exact percentile keeps one counter per distinct value, at most 101 here.
    """
    c = F.col(column)
    quart = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return scores.agg(
        F.count(c).alias("n"), F.round(F.avg(c), 2).alias("mean"),
        F.round(F.stddev_samp(c), 2).alias("std"), F.min(c).cast("double").alias("min"),
        quart.alias("_q"), F.max(c).cast("double").alias("max"),
    ).select("n", "mean", "std", "min", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"),
             F.col("_q")[2].alias("p75"), "max")
