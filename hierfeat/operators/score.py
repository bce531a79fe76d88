"""Batch scoring: scale, encode, logits, probability and energy in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hierfeat.functions.hashing import WORD, hash_hex, hex_word
from hierfeat.functions.missing import feature_float
from hierfeat.operators.network import Network, apply_network, lists, matrix
from hierfeat.operators.scale import ScalerModel
from hierfeat.spec import CASE


def head_outputs(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of class 1 and energy, both from the same logits."""
    top = logits.max(axis=1, keepdims=True)
    scaled = np.exp(logits - top)
    total = scaled.sum(axis=1)
    return scaled[:, 1] / total, -(top[:, 0] + np.log(total))


def score_vectors(
    df: DataFrame,
    networks: Sequence[Network],
    column: str,
    keep: Sequence[str],
    with_logits: bool = False,
) -> DataFrame:
    """``score`` and ``energy`` of an array column sent through the networks in turn."""
    keep = list(keep)
    networks = list(networks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(column), column)
            for network in networks:
                x = network.apply(x)
            score, energy = head_outputs(x)
            outputs = [pa.array(score), pa.array(energy)] + ([lists(x)] if with_logits else [])
            names = ["score", "energy"] + (["logits"] if with_logits else [])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *outputs], [*keep, *names])

    fields = [df.schema[c] for c in keep]
    fields += [T.StructField("score", T.DoubleType()), T.StructField("energy", T.DoubleType())]
    if with_logits:
        fields.append(T.StructField("logits", T.ArrayType(T.DoubleType())))
    return df.select(*dict.fromkeys([*keep, column])).mapInArrow(run, T.StructType(fields))


@dataclass
class ScoringModel:
    """Scaler, encoder and head as one model over raw feature columns."""

    scaler: ScalerModel
    encoder: Network
    head: Network

    def __post_init__(self):
        if self.encoder.inputs not in (None, len(self.scaler.columns)):
            raise ValueError(
                f"the scaler has {len(self.scaler.columns)} features, the encoder takes {self.encoder.inputs}"
            )

    def features(self, df: DataFrame, name: str = "_x") -> DataFrame:
        """Add the scaled features as one array, built by Catalyst ahead of the matrix work."""
        return df.withColumn(name, scaled_vector(self.scaler))

    def encode(self, df: DataFrame, keep: Sequence[str] = (CASE,), name: str = "z") -> DataFrame:
        return apply_network(self.features(df), self.encoder, "_x", name, keep)

    def score(self, df: DataFrame, keep: Sequence[str] = (CASE,), with_logits: bool = False) -> DataFrame:
        return score_vectors(self.features(df), [self.encoder, self.head], "_x", keep, with_logits)

    def score_latent(
        self, df: DataFrame, z: str = "z", keep: Sequence[str] = (CASE,), with_logits: bool = False
    ) -> DataFrame:
        return score_vectors(df, [self.head], z, keep, with_logits)

    def save(self, spark: SparkSession, path: str) -> None:
        self.scaler.save(spark, f"{path}/scaler")
        self.encoder.save(spark, f"{path}/encoder")
        self.head.save(spark, f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str, features: Sequence[str] | None = None) -> ScoringModel:
        """Read a stored model; ``features`` must be those it was made for."""
        scaler = ScalerModel.load(spark, f"{path}/scaler")
        if features is not None:
            scaler.check(features)
        return cls(scaler, Network.load(spark, f"{path}/encoder"), Network.load(spark, f"{path}/head"))


def scaled_vector(scaler: ScalerModel) -> Column:
    """Scaled features in the scaler's order as one array; missing values count as 0 before scaling."""
    parts = []
    for i, c in enumerate(scaler.columns):
        raw = feature_float(F.col(f"`{c}`")).cast("double")
        z = (raw - F.lit(scaler.mean[i])) / F.lit(scaler._std(i))
        parts.append(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), z)))
    return F.array(*parts)


def perturb(df: DataFrame, column: str, key: str, scale: float = 10.0, seed: int = 42) -> DataFrame:
    """Add normal noise to every entry of an array column, fixed by row id and entry.

    Two hash words per entry give one normal number (Box-Muller), so the rows come out
    the same wherever and however often they are computed.
    """

    def noisy(x: Column, i: Column) -> Column:
        digits = hash_hex(seed, F.col(key), i)
        radius = F.sqrt(-2.0 * F.log((hex_word(digits) + 1) / F.lit(float(WORD))))
        angle = 2.0 * F.pi() * (hex_word(digits, 9) / F.lit(float(WORD)))
        return x.cast("double") + scale * radius * F.cos(angle)

    return df.withColumn(column, F.transform(F.col(column), noisy))
