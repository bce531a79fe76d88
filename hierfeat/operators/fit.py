"""Distributed fits of the linear encoder and the scoring head."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hierfeat.operators.network import Network, apply_network, linear, matrix
from hierfeat.spec import TARGET

#: Features up to which the driver holds their covariance (8 MB); wider rows are fitted by power iteration.
NARROW = 1_000
#: Directions beyond those wanted, turns at most, and the relative change of the variances that ends the iteration.
SPARE, TURNS, SETTLED = 10, 60, 1e-10
#: Features whose sums travel in one row.
FEATURES = 64


def fit_encoder(df: DataFrame, column: str, k: int, narrow: int = NARROW) -> tuple[Network, Network]:
    """Encoder and decoder of the best linear autoencoder of width ``k``.

    Principal components of the centred rows. Their sign is free; here the largest
    loading of each component is positive. Rows of up to ``narrow`` features bring their covariance to the
    driver; wider ones only some vectors more than the k components.
    """
    first = df.select(F.size(column)).first()
    if first is None:
        raise ValueError("no rows to fit an encoder on")
    width = first[0]
    if width <= narrow:
        rows = df.select(array_to_vector(F.col(column).cast("array<double>")).alias("x"))
        mean = rows.select(Summarizer.mean(F.col("x")).alias("m")).first()["m"].toArray()
        components = PCA(k=k, inputCol="x", outputCol="z").fit(rows).pc.toArray()
    else:
        mean, components = block_power(df, column, k, width)
    largest = np.abs(components).argmax(axis=0)
    components = components * np.sign(components[largest, np.arange(components.shape[1])])
    encoder = Network([linear(components.T, -(components.T @ mean))])
    decoder = Network([linear(components, mean)])
    return encoder, decoder


def block_power(df: DataFrame, column: str, k: int, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the ``k`` main components of wide rows, by randomised block power iteration.

    A random block of k + ``SPARE`` directions is multiplied by the covariance, made orthonormal, and so on until the
    variances along it settle. Each turn reads the rows once: a task sums up its rows' share of the product, and
    shares are added feature block by feature block before they meet on the driver, which holds width times
    (k + ``SPARE``) numbers and never the covariance.
    """
    block = min(width, k + SPARE)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, block)))
    variances, turn = np.zeros(block), 0
    _, rows, sums = _product(df, column, np.zeros((width, 0)), np.zeros(width))
    if rows < 2:
        raise ValueError("two rows at least are needed")
    mean = sums / rows
    while True:
        image = _product(df, column, basis, mean)[0] / (rows - 1)
        # Within the block the exact axes are those of a small matrix.
        small = basis.T @ image
        found, axes = np.linalg.eigh((small + small.T) / 2)
        found, axes = found[::-1], axes[:, ::-1]
        turn += 1
        if turn == TURNS or np.abs(found - variances)[:k].max() <= SETTLED * max(found[0], 1e-300):
            return mean, basis @ axes[:, :k]
        variances = found
        basis, _ = np.linalg.qr(image)


def _product(df: DataFrame, column: str, basis: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Sum over the centred rows x of x times (x dot basis), the number of rows, and the sum of x."""
    width, block = len(mean), basis.shape[1]
    shipped = df.sparkSession.sparkContext.broadcast((basis, mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, mean = shipped.value
        total, rows = np.zeros((width, block + 1)), 0
        for batch in batches:
            x = matrix(batch.column(0), column)
            if len(x) and x.shape[1] != width:
                raise ValueError(f"{column} has rows of {x.shape[1]} and {width} features")
            x = x - mean
            total[:, :block] += x.T @ (x @ basis)
            total[:, block] += x.sum(axis=0)
            rows += len(x)
        parts = [total[i : i + FEATURES].ravel().tolist() for i in range(0, width, FEATURES)] if rows else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64())), pa.array([rows] * len(parts), pa.int64())],
            ["part", "sums", "n"],
        )

    shares = df.select(F.col(column).cast("array<double>").alias("x")).mapInArrow(run, "part int, sums array<double>, n bigint")
    added = shares.groupBy("part").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"), F.sum("n").alias("n"))
    found = sorted(added.collect(), key=lambda r: r["part"])
    if not found:
        return np.zeros((width, block)), 0, np.zeros(width)
    whole = np.concatenate([r["sums"].toArray() for r in found]).reshape(width, block + 1)
    return whole[:, :block], found[0]["n"], whole[:, block]


def project(
    real: DataFrame, other: DataFrame, column: str, keep: Sequence[str], k: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Both tables on the principal components of the first."""
    encoder, _ = fit_encoder(real, column, k)
    return (
        apply_network(real, encoder, column, "pc", keep),
        apply_network(other, encoder, column, "pc", keep),
    )


def fit_head(
    df: DataFrame,
    column: str = "z",
    target: str = TARGET,
    weight: str | None = None,
    iterations: int = 100,
    regularization: float = 0.0,
) -> Network:
    """Linear class logits that minimise the weighted cross-entropy."""
    columns = [array_to_vector(F.col(column).cast("array<double>")).alias("x"), F.col(target).cast("double").alias("y")]
    if weight:
        columns.append(F.col(weight).alias("w"))
    learner = LogisticRegression(
        featuresCol="x", labelCol="y", maxIter=iterations, regParam=regularization, tol=1e-9
    )
    if weight:
        learner = learner.setWeightCol("w")
    model = learner.fit(df.select(*columns))
    weights, biases = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    if model.numClasses == 2 and len(weights) == 1:
        weights, biases = np.vstack([np.zeros_like(weights), weights]), np.array([0.0, biases[0]])
    return Network([linear(weights, biases)])


def encoder_residuals(df: DataFrame, column: str, encoder: Network) -> DataFrame:
    """How far the components of an encoder are from axes of the covariance: ``component``, ``feature``, ``variance``, ``residual``.

    With v a component and c = (x - mean) dot v, the covariance of each feature with c is ``variance * v`` exactly at an
    axis; the residual is the difference. The covariance of the features is not needed.
    """
    weight = encoder.layers[0].weights["weight"]
    coded = apply_network(df.select(column), encoder, column, "_c", [column])
    x = [F.get(column, F.lit(i)).cast("double") for i in range(weight.shape[1])]
    c = [F.get("_c", F.lit(j)) for j in range(weight.shape[0])]
    one = coded.agg(
        *[F.var_samp(c[j]).alias(f"v{j}") for j in range(len(c))],
        *[F.covar_samp(x[i], c[j]).alias(f"c{j}_{i}") for j in range(len(c)) for i in range(len(x))],
    )
    cells = [
        F.struct(
            F.lit(j).alias("component"),
            F.lit(i).alias("feature"),
            F.col(f"v{j}").alias("variance"),
            (F.col(f"c{j}_{i}") - F.col(f"v{j}") * F.lit(float(weight[j, i]))).alias("residual"),
        )
        for j in range(len(c))
        for i in range(len(x))
    ]
    return one.select(F.inline(F.array(*cells)))


def head_gradient(
    df: DataFrame, head: Network, column: str = "z", target: str = TARGET, weight: str | None = None
) -> DataFrame:
    """Mean weighted gradient of the cross-entropy by class and feature; ``feature`` -1 is the bias. Zero at the optimum."""
    layer = head.layers[0].weights
    classes, features = layer["weight"].shape
    w = F.col(weight) if weight else F.lit(1.0)
    logits = apply_network(df.select(column, target, w.alias("_w")), head, column, "_l", [column, target, "_w"])
    top = F.array_max("_l")
    total = F.aggregate(F.transform("_l", lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)
    slopes = [
        F.col("_w") * (F.exp(F.get("_l", F.lit(j)) - top) / total - (F.col(target) == j).cast("double")) for j in range(classes)
    ]
    inputs = {-1: F.lit(1.0), **{i: F.get(column, F.lit(i)).cast("double") for i in range(features)}}
    one = logits.agg(
        F.sum("_w").alias("_total"), *[F.sum(slopes[j] * x).alias(f"g{j}_{i}") for j in range(classes) for i, x in inputs.items()]
    )
    cells = [
        F.struct(F.lit(j).alias("class"), F.lit(i).alias("feature"), (F.col(f"g{j}_{i}") / F.col("_total")).alias("gradient"))
        for j in range(classes)
        for i in inputs
    ]
    return one.select(F.inline(F.array(*cells)))
