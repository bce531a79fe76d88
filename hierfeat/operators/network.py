"""Small dense networks applied to Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the layer kinds.
LEAKY_SLOPE = 0.2
NORM_EPS = 1e-5
# Weights are shipped to every executor; this bounds them (float64, 400 MB).
MOST_WEIGHTS = 50_000_000


@dataclass
class Layer:
    """One step: ``linear``, ``relu``, ``leaky_relu``, ``batch_norm`` or ``layer_norm``."""

    kind: str
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def apply(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        if self.kind == "linear":
            return x @ w["weight"].T + w["bias"]
        if self.kind == "relu":
            return np.maximum(x, 0.0)
        if self.kind == "leaky_relu":
            return np.where(x > 0, x, LEAKY_SLOPE * x)
        if self.kind == "batch_norm":
            return (x - w["mean"]) / np.sqrt(w["var"] + NORM_EPS) * w["gamma"] + w["beta"]
        if self.kind == "layer_norm":
            mean = x.mean(axis=1, keepdims=True)
            var = x.var(axis=1, keepdims=True)
            return (x - mean) / np.sqrt(var + NORM_EPS) * w["gamma"] + w["beta"]
        raise ValueError(f"unknown layer kind {self.kind!r}")


def linear(weight, bias) -> Layer:
    weight, bias = np.atleast_2d(np.asarray(weight, float)), np.asarray(bias, float)
    if weight.shape[0] != bias.shape[0]:
        raise ValueError(f"weight has {weight.shape[0]} outputs, bias {bias.shape[0]}")
    return Layer("linear", {"weight": weight, "bias": bias})


def fold_spectral_norm(weight, u, v) -> np.ndarray:
    """Plain matrix of a spectrally normed one, from its stored singular vectors."""
    weight = np.asarray(weight, float)
    return weight / float(np.asarray(u, float) @ weight @ np.asarray(v, float))


@dataclass
class Network:
    layers: list[Layer]

    def __post_init__(self):
        size = sum(w.size for layer in self.layers for w in layer.weights.values())
        if size > MOST_WEIGHTS:
            raise ValueError(f"{size} weights; at most {MOST_WEIGHTS} are shipped to executors")
        width = None
        for matrix in (layer.weights["weight"] for layer in self.layers if layer.kind == "linear"):
            if width is not None and matrix.shape[1] != width:
                raise ValueError(f"layer takes {matrix.shape[1]} inputs but gets {width}")
            width = matrix.shape[0]

    @property
    def inputs(self) -> int | None:
        return next((x.weights["weight"].shape[1] for x in self.layers if x.kind == "linear"), None)

    def apply(self, x: np.ndarray) -> np.ndarray:
        for layer in self.layers:
            x = layer.apply(x)
        return x

    def save(self, spark: SparkSession, path: str) -> None:
        rows = []
        for i, layer in enumerate(self.layers):
            for name, w in layer.weights.items() or {"": np.zeros(0)}.items():
                rows.append((i, layer.kind, name, list(w.shape), [float(x) for x in w.ravel()]))
        kind = "pos int, kind string, name string, shape array<int>, weights array<double>"
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Network:
        stored = spark.read.parquet(path)
        size = stored.agg(F.sum(F.size("weights"))).first()[0] or 0
        if size > MOST_WEIGHTS:
            raise ValueError(f"{size} weights stored; at most {MOST_WEIGHTS} are read")
        layers: dict[int, Layer] = {}
        for r in stored.collect():
            layer = layers.setdefault(r["pos"], Layer(r["kind"]))
            if r["name"]:
                layer.weights[r["name"]] = np.array(r["weights"]).reshape(r["shape"])
        return cls([layers[i] for i in sorted(layers)])


def matrix(column: pa.Array | pa.ChunkedArray, name: str) -> np.ndarray:
    """Rows of a fixed-length list column as one matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError(f"{name} has null rows")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError(f"{name} has null entries")
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values, dtype=float).ravel()))


def apply_network(
    df: DataFrame, network: Network, column: str, name: str, keep: Sequence[str] | None = None
) -> DataFrame:
    """Add ``name``, the network's output for the array column ``column``.

    The network is part of the function; Spark broadcasts functions above a megabyte.
    """
    keep = [c for c in df.columns if c not in (column, name)] if keep is None else list(keep)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = network.apply(matrix(batch.column(column), column))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists(out)], [*keep, name])

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, T.ArrayType(T.DoubleType()))])
    return df.select(*dict.fromkeys([*keep, column])).mapInArrow(run, schema)
