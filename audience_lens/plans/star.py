"""The engine over the star-schema tables of one folder.

Raw frames are lazy. Silver, the 360, scores, activity and serving tables are written once per
input version to the shared work folder, as any medallion job does; later layers and the analytics
queries read the written tables.
"""

from __future__ import annotations

import uuid
from functools import cached_property, partial

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from audience_lens.config import EngineConfig
from audience_lens.functions import scoring
from audience_lens.operators import activity, briefs, intent_ml, search_index, serving
from audience_lens.operators import features as ft
from audience_lens.operators.silver import CLEANERS
from audience_lens.plans import increment, medallion
from audience_lens.schemas import SOURCES
from audience_lens.sources import adapters, commits
from audience_lens.sources.lake import Lake, Snapshot
from audience_lens.sources.workspace import (
    guard, hot_keys_split, in_parallel, input_version, materialize, materialize_path, shuffles_go, version_tag, workspace,
)


_fitted: set[str] = set()
MARK, LANDING = "_mark", "_landing"
#: CSV as extracts land it; a packed file is one task's, so none is large.
PACKED_LINES = {"header": "true", "compression": "gzip", "maxRecordsPerFile": "250000"}


class Star:
    def __init__(self, spark: SparkSession, sf_dir: str, cfg: EngineConfig = adapters.STAR_CONFIG):
        self.spark, self.dir, self.cfg = spark, sf_dir.rstrip("/"), cfg
        self.table = adapters.parquet_tables(spark, self.dir)

    # ---- lazy layers ----
    def raw(self, source: str) -> DataFrame:
        return adapters.RAW[source](self.table)

    def cleaned(self) -> medallion.Silver:
        """Silver computed in place, without a written table."""
        return medallion.build_silver({source: self.raw(source) for source in adapters.RAW})

    # ---- written layers ----
    @cached_property
    def version(self) -> str:
        paths = [f"{self.dir}/{t}.parquet" for t in adapters.TABLES]
        return f"{self.dir}|{self.cfg}|{input_version(self.spark, paths)}"

    def _written(self, name: str, build) -> DataFrame:
        return materialize(self.spark, name, self.version, build)

    def folder(self, name: str) -> str:
        return f"{workspace(self.spark)}/{name}"

    def stamp(self) -> str:
        """Name of a folder that no other call uses."""
        return uuid.uuid4().hex

    def landed_text(self, name: str, build) -> str:
        """Folder of text files, one line per row."""
        return materialize_path(self.spark, f"landing_{name}", self.version, build, fmt="text")

    def scored_gold(self) -> DataFrame:
        """Gold with the rule baseline only."""
        return ft.overlay_scores(self.scored, None, self.cfg)

    @cached_property
    def silver(self) -> medallion.Silver:
        version = self.version

        def layer(source: str) -> DataFrame:
            return materialize(self.spark, f"silver_{source}", version,
                               lambda: CLEANERS[source](adapters.RAW_DEALT[source](self.table)))

        with hot_keys_split(self.spark):
            tables = in_parallel(self.spark, [partial(layer, source) for source in adapters.RAW])
        return medallion.Silver(**dict(zip(adapters.RAW, tables)))

    def landed(self, source: str) -> str:
        """Folder of CSV files with the raw rows of a source, as an extract would land them."""
        def build() -> DataFrame:
            raw = self.raw(source)
            return raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])

        return materialize_path(self.spark, f"landing_{source}", self.version, build,
                                fmt="csv", header="true")

    def _marked(self, source: str) -> DataFrame:
        """The raw rows of a source as text with a hash of each. A table that lies in fewer splits than there are cores
        is dealt to all of them before its columns are made."""
        cores = self.spark.sparkContext.defaultParallelism

        def spread(name: str) -> DataFrame:
            table = self.table(name)
            return table if name != "events" or table.rdd.getNumPartitions() >= cores else table.repartition(cores)

        raw = adapters.RAW[source](spread)
        return raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns], F.xxhash64(*raw.columns).alias(MARK))

    def marked(self, source: str) -> DataFrame:
        """The raw rows of a source as text with a hash of each, for landings of some of them: written once, as a
        filter by the hash would make every column of a row a second time."""
        return self._written(f"marked_{source}", lambda: self._marked(source))

    def _extract(self, folder: str, source: str) -> None:
        """Files of both landings of a source, from one pass over its rows."""
        mark = F.pmod(MARK, F.lit(10))
        landings = F.when(mark == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array((mark >= 5).cast("int")))
        rows = self._marked(source).withColumn(LANDING, F.explode(landings)).drop(MARK)
        rows.write.partitionBy(LANDING).options(**PACKED_LINES).csv(f"{folder}/{source}")

    def _land(self, folder: str, landing: str, number: int, source: str) -> None:
        """Hands the files of one landing over; a header alone where there are no rows."""
        files = f"{folder}/{source}/{LANDING}={number}"
        names = commits.names(self.spark, files)
        if not names:
            rows = self._marked(source).drop(MARK).limit(0)
            rows.write.mode("append").options(**PACKED_LINES).csv(f"{landing}/{source}")
        for name in names:
            commits.move(self.spark, f"{files}/{name}", f"{landing}/{source}/{number}-{name}")

    def lake(self) -> Snapshot:
        """Two landings and a refresh after each: half of the rows, then the rest and copies of a tenth of the first half."""
        path = f"{self.folder('increments')}/{version_tag(self.version)}"

        with guard(path), shuffles_go(self.spark):
            if path not in self._lakes:
                root = f"{path}/{self.stamp()}"
                landing, extracts = f"{root}/landing", f"{root}/extracts"
                in_parallel(self.spark, [partial(self._extract, extracts, source) for source in SOURCES])
                for number in (0, 1):
                    in_parallel(self.spark, [partial(self._land, extracts, landing, number, source) for source in SOURCES])
                    increment.advance(self.spark, landing, root, self.cfg, scoring.ref_ts(self.cfg), 8, keep_landed=False)
                self._lakes[path] = f"{root}/lake"
        return Lake(self.spark, self._lakes[path]).snapshot()

    def indexed(self) -> Snapshot:
        """Served rows with their search index, both of one run."""
        path = f"{self.folder('search')}/{version_tag(self.version)}"
        with guard(path):
            if path not in self._lakes:
                self._lakes[path] = f"{path}/{self.stamp()}"
                run = Lake(self.spark, self._lakes[path]).begin()
                run.rewrite("serving.profiles", self.served)
                search_index.publish(run, run.table("serving.profiles"))
                run.commit({})
        return Lake(self.spark, self._lakes[path]).snapshot()

    _lakes: dict[str, str] = {}

    def base(self) -> DataFrame:
        return medallion.build_base(self.silver, self.cfg)

    @cached_property
    def scored(self) -> DataFrame:
        """360 features with the rule baseline (no overlay)."""
        return self._written("scored", lambda: ft.score_360(self.base(), self.cfg))

    def rule_probabilities(self) -> DataFrame:
        """Baseline intent read as a probability: a model-free stand-in for a classifier."""
        return self.scored.select(
            "supporter_id", (F.col("purchase_intent_score") / 100.0).alias("probability"))

    def rule_intent_scores(self) -> DataFrame:
        return intent_ml.intent_scores(self.scored, self.rule_probabilities(), self.cfg)

    @cached_property
    def scores(self) -> DataFrame:
        """Score table with enriched reasons for the top supporters."""
        def build() -> DataFrame:
            scores = self.rule_intent_scores()
            enriched = scores.select("supporter_id", F.concat(
                F.lit("Recommended "), "recommended_next_action", F.lit(" at intent "),
                F.col("purchase_intent_score").cast("string"), F.lit("/100.")).alias("genai_reason"))
            return intent_ml.publish_scores(scores, self.cfg, enriched)

        return self._written("scores", build)

    @cached_property
    def gold(self) -> DataFrame:
        return self._written("gold", lambda: ft.overlay_scores(self.scored, self.scores, self.cfg))

    @cached_property
    def profile(self) -> DataFrame:
        return self._written("profile", lambda: serving.publish_profile(self.gold))

    @cached_property
    def nba(self) -> DataFrame:
        return self._written("nba", lambda: serving.publish_nba(
            self.gold, self.cfg, updated_at=scoring.ref_ts(self.cfg)))

    @cached_property
    def served(self) -> DataFrame:
        """Profile and next best action in one pass over Gold; equals their join."""
        return self._written("served", lambda: serving.serve(self.gold, self.cfg))

    @cached_property
    def activity(self) -> DataFrame:
        return self._written("activity", lambda: medallion.build_activity(self.silver))

    @cached_property
    def feed(self) -> DataFrame:
        return self._written("feed", lambda: activity.export_activity(self.activity))

    @cached_property
    def facts(self) -> DataFrame:
        return briefs.brief_facts(self.served)

    # ---- model ----
    @cached_property
    def features(self) -> DataFrame:
        """Feature frame with label."""
        return self._written("features", lambda: intent_ml.feature_frame(
            self.scored, intent_ml.engagement_label(self.silver.marketing_events, self.cfg)))

    @cached_property
    def frame(self) -> DataFrame:
        """Feature frame with label and split flag."""
        return self._written("frame", lambda: intent_ml.stratified_split(self.features))

    @cached_property
    def leak_free_features(self) -> DataFrame:
        return self._written("leak_free_features", lambda: medallion.leak_free_frame(
            self.silver, self.cfg))

    @cached_property
    def leak_free_frame(self) -> DataFrame:
        return self._written("leak_free_frame", lambda: intent_ml.stratified_split(
            self.leak_free_features))

    def written(self, name: str, build) -> DataFrame:
        """A layer written once, for results that are read more than once."""
        return self._written(name, build)

    def model_frame(self, name: str) -> DataFrame:
        return self.leak_free_frame if name.endswith("leak_free") else self.frame

    def model(self, name: str) -> PipelineModel:
        """Model fitted once per input version, saved to and loaded from the work folder."""
        path = f"{self.folder('model_' + name)}/{version_tag(self.version)}"
        frame = self.model_frame(name)
        with guard(path):
            if path not in _fitted:
                fit = intent_ml.train_gbt if name == "boosted_trees" else intent_ml.train_logreg
                fit(frame.filter("NOT is_test")).write().overwrite().save(path)
                _fitted.add(path)
        return PipelineModel.load(path)

    def test_predictions(self, name: str) -> DataFrame:
        return self._written(f"predictions_{name}", lambda: intent_ml.score_all(
            self.model(name), self.model_frame(name).filter("is_test")))
