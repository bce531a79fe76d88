"""From stored feature chunks to a scaler, latent vectors and a scoring model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hierfeat.operators.fit import fit_encoder, fit_head
from hierfeat.operators.network import apply_network
from hierfeat.operators.prepare import (
    add_chunk_weights,
    feature_columns,
    prepare_features,
    split_by_week,
)
from hierfeat.operators.scale import ScalerModel, moments
from hierfeat.operators.score import ScoringModel, scaled_vector
from hierfeat.session import stored
from hierfeat.sources.state import save_features
from hierfeat.spec import CASE, TARGET, WEEK


@dataclass
class Learnt:
    features: list[str]
    model: ScoringModel
    latents: DataFrame


def learn(
    chunks: DataFrame, artifact_dir: str, latent_dim: int = 64, val_weeks: int = 12, chunk: str = "chunk"
) -> Learnt:
    """Select features, scale, encode and fit a head on stored chunks.

    Everything is learnt from the weeks before validation. Stores the feature list and
    the model; the latent vectors of all rows come back with chunk, class and week.
    """
    spark = chunks.sparkSession
    features = feature_columns(chunks.drop(chunk))
    prepared = prepare_features(chunks, features)
    train, _ = split_by_week(prepared, val_weeks)
    # One pass gives the variances to select by and the moments to scale with.
    scaler = ScalerModel.from_moments(moments(train, features, by=[chunk])).varying()
    features = scaler.columns
    save_features(spark, features, artifact_dir)

    keep = [CASE, chunk, TARGET, WEEK]
    scaled = train.select(scaled_vector(scaler).alias("x"))
    encoder, _ = fit_encoder(scaled, "x", min(latent_dim, len(features)))
    vectors = prepared.select(*keep, scaled_vector(scaler).alias("x"))
    latents = stored(apply_network(vectors, encoder, "x", "z", keep), "latents")
    known, _ = split_by_week(latents, val_weeks)
    head = fit_head(add_chunk_weights(known.filter(F.col(TARGET).isNotNull()), chunk), weight="weight")
    model = ScoringModel(scaler, encoder, head)
    model.save(spark, f"{artifact_dir}/model")
    return Learnt(features, model, latents)
