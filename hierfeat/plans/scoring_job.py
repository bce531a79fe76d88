"""Scoring a test set with stored state: features, probabilities, energies, CSV."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from hierfeat.operators.evaluate import energy_summary
from hierfeat.operators.score import ScoringModel
from hierfeat.plans.feature_build import FeatureBuild
from hierfeat.session import stored
from hierfeat.sources.export import export_scores
from hierfeat.sources.state import load_features
from hierfeat.spec import BuildConfig, HierarchySpec

logger = logging.getLogger(__name__)


def score_test_set(
    spark: SparkSession, spec: HierarchySpec, config: BuildConfig, output_path: str
) -> tuple[DataFrame, DataFrame]:
    """Write ``case_id,score`` and return the scored rows and their energy summary."""
    features = load_features(spark, config.artifact_dir)
    model = ScoringModel.load(spark, f"{config.artifact_dir}/model", features)
    table = FeatureBuild(spec, config).run(spark, export=False)
    # Written, summarised and returned: scored once.
    scored = stored(model.score(table), "scores")
    export_scores(scored, output_path)
    summary = energy_summary(scored)
    row = summary.first()
    logger.info("test energy: mean %.4f, std %.4f", row["mean"], row["std"])
    return scored, summary
