"""Evaluation and monitoring of scored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hierfeat.functions import vectors
from hierfeat.operators import slices
from hierfeat.operators.quantiles import quantiles
from hierfeat.spec import TARGET, WEEK

# Fixed values of the stability metric and of the energy penalty.
FALLING_WEIGHT = 88.0
RESIDUAL_WEIGHT = 0.5
L2_ENERGY_WEIGHT = 1e-4


def _class_counts_by_score(scored: DataFrame, keys: list[str], score: str, target: str) -> DataFrame:
    known = scored.filter(F.col(score).isNotNull() & F.col(target).isNotNull())
    return known.groupBy(*keys, F.col(score).cast("double").alias("_score")).agg(
        F.count(F.when(F.col(target) == 1, 1)).alias("_pos"),
        F.count(F.when(F.col(target) != 1, 1)).alias("_neg"),
    )


def _sliced_counts(scored: DataFrame, keys: list[str], score: str, target: str) -> DataFrame:
    return slices.by_sketch(_class_counts_by_score(scored, keys, score, target), "_score")


def weekly_gini(scored: DataFrame, score: str = "score", target: str = TARGET, week: str = WEEK) -> DataFrame:
    """Area under the ROC curve and Gini per week; weeks with one class only are left out.

    Equal scores share their rank. Rows shrink to one per week and score first, then
    each positive counts the negatives below it with sliced running totals.
    """
    counts = _sliced_counts(scored, [week], score, target)
    below = slices.running_totals(counts, {"_below": F.col("_neg")}, ["_score"], [week])
    pairs = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    weeks = below.groupBy(week).agg(
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"), pairs.alias("_pairs")
    )
    weeks = weeks.filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    auc = F.col("_pairs") / (F.col("n_pos") * F.col("n_neg"))
    return weeks.select(week, "n_pos", "n_neg", auc.alias("auc"), (2.0 * auc - 1.0).alias("gini"))


def stability(weekly: DataFrame, week: str = WEEK) -> DataFrame:
    """One row: mean weekly Gini, penalised for a falling trend and for scatter around it."""
    x, y = F.col(week).cast("double"), F.col("gini")
    sums = weekly.agg(
        F.count(F.lit(1)).alias("n_weeks"),
        F.avg(y).alias("_mean"),
        F.regr_slope(y, x).alias("_slope"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_sxy(y, x).alias("_sxy"),
        F.regr_syy(y, x).alias("_syy"),
    )
    left_over = F.greatest(F.lit(0.0), F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"))
    fall = F.least(F.lit(0.0), F.col("_slope"))
    scatter = F.sqrt(left_over / F.col("n_weeks"))
    metric = F.col("_mean") + FALLING_WEIGHT * fall - RESIDUAL_WEIGHT * scatter
    enough = F.col("n_weeks") >= 2

    def value(col: Column) -> Column:
        return F.when(enough, col).otherwise(F.lit(0.0))

    return sums.select(
        value(metric).alias("stability_metric"),
        value(F.col("_mean")).alias("mean_gini"),
        value(fall).alias("falling_rate"),
        value(scatter).alias("std_residuals"),
        "n_weeks",
    )


def gini_stability(scored: DataFrame, score: str = "score", target: str = TARGET, week: str = WEEK) -> DataFrame:
    return stability(weekly_gini(scored, score, target, week), week)


def evaluate_scores(
    scored: DataFrame,
    score: str = "score",
    energy: str = "energy",
    target: str = TARGET,
    week: str = WEEK,
) -> DataFrame:
    """Stability of the scores next to the mean energy."""
    mean_energy = scored.agg(F.avg(energy)).scalar()
    return gini_stability(scored, score, target, week).withColumn("avg_energy", mean_energy)


def average_precision(scored: DataFrame, score: str = "score", target: str = TARGET) -> DataFrame:
    """Area under the precision-recall curve, one row."""
    counts = _sliced_counts(scored, [], score, target)
    below = slices.running_totals(counts, {"_p": F.col("_pos"), "_n": F.col("_neg")}, ["_score"])
    # Both totals are sums of the counts by score; the table is not scanned again.
    totals = _class_counts_by_score(scored, [], score, target)
    positives = totals.agg(F.sum("_pos")).scalar()
    rows = totals.agg(F.sum(F.col("_pos") + F.col("_neg"))).scalar()
    caught = positives - F.col("_p")
    flagged = rows - F.col("_p") - F.col("_n")
    area = F.sum(F.col("_pos") / positives * caught / flagged)
    return below.agg(area.alias("average_precision"), F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))


def calibration_curve(
    scored: DataFrame, score: str = "score", target: str = TARGET, bins: int = 10
) -> DataFrame:
    """Mean score and observed rate per quantile bin; empty bins are left out.

    Rows shrink to one per score. Running totals over these give the rank of every score, so the values at the
    ranks next to each edge, and with them the edges, come from the same grouped table; the rows are read once.
    """
    known = scored.filter(F.col(score).isNotNull() & F.col(target).isNotNull())
    by_score = known.groupBy(F.col(score).cast("double").alias("_score")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(target).cast("double")).alias("_hits")
    )
    ranked = slices.running_totals(slices.by_sketch(by_score, "_score"), {"_below": F.col("_n")}, ["_score"])
    shares = [i / bins for i in range(1, bins)]
    place = F.lit(0)
    if shares:
        last = by_score.agg(F.sum("_n")).scalar() - 1
        found = ranked.agg(*[_at_rank(r(q * last)).alias(f"_{n}{i}") for i, q in enumerate(shares) for n, r in _SIDES.items()])
        between = [(F.col(f"_low{i}"), F.col(f"_high{i}"), q * last - F.floor(q * last)) for i, q in enumerate(shares)]
        edges = F.array(*[low + (high - low) * part for low, high, part in between])
        by_score = by_score.withColumn("_edges", found.select(edges).scalar())
        place = F.size(F.filter("_edges", lambda e: e < F.col("_score")))
    return (
        by_score.groupBy(place.alias("bin"))
        .agg(
            F.sum("_n").alias("n"),
            (F.sum(F.col("_score") * F.col("_n")) / F.sum("_n")).alias("prob_pred"),
            (F.sum("_hits") / F.sum("_n")).alias("prob_true"),
        )
    )


_SIDES = {"low": F.floor, "high": F.ceil}


def _at_rank(rank: Column) -> Column:
    """The score that holds a rank, counted from 0."""
    return F.max(F.when((F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_n")), F.col("_score")))


def histogram(df: DataFrame, value: str = "energy", population: str = "population", bins: int = 50) -> DataFrame:
    """Equal-width bins over the range of each population, with density; empty bins included."""
    known = df.filter(F.col(value).isNotNull())
    ranges = known.groupBy(population).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min(value).cast("double").alias("_min"),
        F.max(value).cast("double").alias("_max"),
    )
    flat = F.col("_min") == F.col("_max")
    ranges = ranges.select(
        population,
        "_rows",
        F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_lo"),
        F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_hi"),
    )
    # Any number of populations; few of them are broadcast by the size Spark finds.
    spans = ranges
    place = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    counts = (
        known.select(population, value)
        .join(spans, population)
        .groupBy(population, F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    grid = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce(F.col("n"), F.lit(0))
    return grid.join(counts, [population, "bin"], "left").select(
        population,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("low"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"),
        n.alias("n"),
        (n / (F.col("_rows") * width)).alias("density"),
    )


def energy_summary(df: DataFrame, energy: str = "energy") -> DataFrame:
    return df.agg(
        F.count(energy).alias("n"), F.avg(energy).alias("mean"), F.stddev_pop(energy).alias("std")
    )


def energy_by_period(
    df: DataFrame, period: str, energy: str = "energy", fractions: tuple[float, ...] = (0.05, 0.5, 0.95)
) -> DataFrame:
    """Count, mean, population std and exact percentiles of the energy per period."""
    stats = df.groupBy(period).agg(
        F.count(energy).alias("n"), F.avg(energy).alias("mean"), F.stddev_pop(energy).alias("std")
    )
    spread = quantiles(df.select(period, energy), [period], energy, fractions, "linear", few_groups=False).drop("n")
    names = {f"q{i}": f"p{round(q * 100):02d}" for i, q in enumerate(fractions)}
    return stats.join(spread.withColumnsRenamed(names), period, "left")


def energy_trajectory(log: DataFrame, step: str = "step") -> DataFrame:
    """Mean energies of real and generated rows per step of a run log."""
    return log.groupBy(step).agg(F.avg("e_real").alias("e_real"), F.avg("e_fake").alias("e_fake"))


def energy_drift(df: DataFrame, reference: DataFrame, energy: str = "energy", threshold: float = 3.0) -> DataFrame:
    """Distance of each row's energy from the reference rows, in their standard deviations.

    ``reference`` is one row with ``mean`` and ``std``, as :func:`energy_summary` gives it.
    """
    mean, std = reference.select("mean").scalar(), reference.select("std").scalar()
    z = (F.col(energy) - mean) / std
    return df.withColumn("z", z).withColumn("is_ood", F.col("z") > threshold)


def drift_summary(drift: DataFrame, by: str) -> DataFrame:
    flagged = F.count(F.when(F.col("is_ood"), 1))
    return drift.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        flagged.alias("n_ood"),
        (flagged / F.count(F.lit(1))).alias("share_ood"),
        F.avg("z").alias("mean_z"),
    )


def loss_terms(
    real: DataFrame,
    fake: DataFrame,
    logits: str = "logits",
    target: str = TARGET,
    weight: str | None = None,
    l2_energy_weight: float = L2_ENERGY_WEIGHT,
) -> DataFrame:
    """Cross-entropy, energy gap and energy penalty of a head over two scored tables.

    ``clf_loss`` is the mean of the weighted cross-entropies, ``clf_loss_normed`` their
    weighted mean.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    entropy = vectors.log_sum_exp(F.col(logits)) - F.get(F.col(logits), F.col(target).cast("int"))
    rows = real.select(
        vectors.energy(F.col(logits)).alias("_real"),
        F.lit(None).cast("double").alias("_fake"),
        (entropy * w).alias("_ce"),
        w.alias("_w"),
    ).unionAll(
        fake.select(
            F.lit(None).cast("double"),
            vectors.energy(F.col(logits)),
            F.lit(None).cast("double"),
            F.lit(None).cast("double"),
        )
    )
    sums = rows.agg(
        F.avg("_ce").alias("clf_loss"),
        (F.sum("_ce") / F.sum("_w")).alias("clf_loss_normed"),
        F.avg("_real").alias("e_real"),
        F.avg("_fake").alias("e_fake"),
        (l2_energy_weight * (F.avg(F.pow("_real", F.lit(2))) + F.avg(F.pow("_fake", F.lit(2))))).alias("l2_loss"),
    )
    gap = F.col("e_real") - F.col("e_fake")
    return sums.withColumn("gen_loss", gap).withColumn("total_loss", F.col("clf_loss") + gap + F.col("l2_loss"))


def reconstruction_error(df: DataFrame, x: str, x_hat: str, weight: str | None = None) -> DataFrame:
    """Mean squared reconstruction error, plain and weighted by row, one row."""
    errors = df.select(
        vectors.mean_squared_error(F.col(x), F.col(x_hat)).alias("_e"),
        (F.lit(1.0) if weight is None else F.col(weight)).alias("_w"),
    )
    return errors.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_e").alias("mse"),
        F.avg(F.col("_e") * F.col("_w")).alias("weighted_mse"),
    )
