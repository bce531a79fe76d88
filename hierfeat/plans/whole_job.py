"""From shards on disk to a file of scores: build, learn, replay, score, as one job that can be resumed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hierfeat.plans.feature_build import FeatureBuild
from hierfeat.plans.learning import learn
from hierfeat.plans.manifest import RunManifest, files_digest
from hierfeat.plans.scoring_job import score_test_set
from hierfeat.sources.export import read_chunks
from hierfeat.spec import BuildConfig, HierarchySpec


@dataclass
class WholeJob:
    """Train on the shards of ``train.data_dir``, score those of ``test.data_dir``, write ``case_id,score``.

    ``fit`` learns from the chunks and stores the feature list and the model in the artifact folder. What a step hands to
    the next lies in files: chunks and imputer state, feature list and model, scores.
    """

    spec: HierarchySpec
    train: BuildConfig
    test: BuildConfig
    folder: str
    fit: Callable[[DataFrame, str], object] = learn

    def __post_init__(self):
        if self.train.is_inference or not self.test.is_inference:
            raise ValueError("the training build learns, the test build replays")
        if self.train.artifact_dir != self.test.artifact_dir:
            raise ValueError("both builds need the same artifact folder")

    @property
    def scores(self) -> str:
        return f"{self.folder}/scores"

    def run(self, spark: SparkSession) -> DataFrame:
        """The scores as read from their file. Steps recorded for the same inputs are not done again."""
        manifest = RunManifest(spark, f"{self.folder}/manifest")
        shards = files_digest(spark, self.train.data_dir)
        built = manifest.step("features", [repr(self.spec), repr(self.train), shards], lambda: self._build(spark))
        fitted = manifest.step("model", [built, self.fit.__qualname__], lambda: self._fit(spark))
        unseen = files_digest(spark, self.test.data_dir)
        manifest.step("scores", [fitted, repr(self.test), unseen], lambda: self._score(spark))
        return spark.read.option("header", True).schema("case_id bigint, score double").csv(self.scores)

    def _build(self, spark: SparkSession) -> None:
        FeatureBuild(self.spec, self.train).run(spark)

    def _fit(self, spark: SparkSession) -> None:
        self.fit(read_chunks(spark, f"{self.train.output_dir}/chunks"), self.train.artifact_dir)

    def _score(self, spark: SparkSession) -> None:
        score_test_set(spark, self.spec, self.test, self.scores)
