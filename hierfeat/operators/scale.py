"""Mergeable moments and standard scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-8
CLAMP = 10.0
# Columns aggregated in one pass; each pass reads its own columns only.
BLOCK = 100


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean and sum of squared deviations per column (and per ``by`` value).

    Rows are partial states: :func:`merge_moments` joins those of several chunks or days
    without reading the data again.
    """
    parts = [_block_moments(df, list(enumerate(columns))[at : at + BLOCK], by) for at in range(0, len(columns), BLOCK)]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _block_moments(df: DataFrame, block: Sequence[tuple[int, str]], by: Sequence[str]) -> DataFrame:
    """Moments of some columns side by side; only the result goes to one row per column."""
    aggregates, entries = [], []
    for i, c in block:
        v = F.col(f"`{c}`").cast("double")
        state = F.struct(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))
        aggregates.append(state.alias(f"_s{i}"))
        entries.append(F.struct(F.lit(i).alias("pos"), F.lit(c).alias("col"), *[F.col(f"_s{i}.{m}") for m in ("n", "mean", "m2")]))
    return df.groupBy(*by).agg(*aggregates).select(*by, F.inline(F.array(*entries)))


def merge_moments(parts: DataFrame) -> DataFrame:
    """One state per column from many; states of empty chunks drop out."""
    column = Window.partitionBy("pos", "col")
    mean = F.sum(F.col("n") * F.col("mean")).over(column) / F.sum("n").over(column)
    shifted = parts.filter(F.col("n") > 0).withColumn("_mean", mean)
    spread = F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), 2)
    return shifted.groupBy("pos", "col").agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(spread).alias("m2")
    )


def sample_variance(n: Column, m2: Column) -> Column:
    return F.when(n > 1, m2 / (n - 1)).otherwise(m2)


@dataclass
class ScalerModel:
    """Per-column mean and variance. Scales to ``(x - mean) / std`` within ±10."""

    columns: list[str]
    mean: list[float]
    var: list[float]
    eps: float = EPS

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> ScalerModel:
        return cls.from_moments(moments(df, columns))

    @classmethod
    def from_moments(cls, parts: DataFrame, eps: float = EPS) -> ScalerModel:
        """Scaler of merged states; one row per column reaches the driver."""
        merged = merge_moments(parts).withColumn("var", sample_variance(F.col("n"), F.col("m2")))
        rows = merged.orderBy("pos").collect()
        if not rows:
            raise ValueError("no values to fit a scaler on")
        return cls([r["col"] for r in rows], [r["mean"] for r in rows], [r["var"] for r in rows], eps)

    def varying(self, threshold: float = 1e-4) -> ScalerModel:
        """The same scaler without columns of lower variance."""
        kept = [i for i, v in enumerate(self.var) if v is not None and not v < threshold]
        return ScalerModel(
            [self.columns[i] for i in kept], [self.mean[i] for i in kept], [self.var[i] for i in kept], self.eps
        )

    def _std(self, position: int) -> float:
        var = self.var[position]
        return (1.0 if var < self.eps else var) ** 0.5

    def check(self, columns: Sequence[str]) -> None:
        if len(columns) != len(self.columns):
            raise ValueError(f"{len(columns)} features given, the scaler has {len(self.columns)}")
        if list(columns) != self.columns:
            raise ValueError("features are not those of the scaler, or not in its order")

    def scaled(self, column: str) -> Column:
        i = self.columns.index(column)
        z = (F.col(f"`{column}`").cast("double") - F.lit(self.mean[i])) / F.lit(self._std(i))
        bounded = F.greatest(F.lit(-CLAMP), F.least(F.lit(CLAMP), z))
        return F.when(z.isNotNull() & ~F.isnan(z), bounded).otherwise(z)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scaled(c) for c in self.columns})

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [
            (i, c, m, v, self.eps)
            for i, (c, m, v) in enumerate(zip(self.columns, self.mean, self.var, strict=True))
        ]
        spark.createDataFrame(rows, "pos int, col string, mean double, var double, eps double").coalesce(
            1
        ).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ScalerModel:
        """Read a stored scaler; one stored without ``eps`` gets the default."""
        stored = spark.read.parquet(path)
        rows = stored.orderBy("pos").collect()
        eps = rows[0]["eps"] if "eps" in stored.columns else EPS
        return cls([r["col"] for r in rows], [r["mean"] for r in rows], [r["var"] for r in rows], eps)
