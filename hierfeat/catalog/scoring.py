"""Scoring, evaluation and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hierfeat.catalog import tables as t
from hierfeat.catalog.learning import MEASURES
from hierfeat.catalog.registry import query, rounded
from hierfeat.operators import evaluate, network
from hierfeat.operators.fit import encoder_residuals, fit_encoder, fit_head, head_gradient, project
from hierfeat.operators.prepare import add_class_weights
from hierfeat.operators.scale import ScalerModel
from hierfeat.operators.score import ScoringModel, perturb, scaled_vector, score_vectors

# Fixed weights of the checked models: small fractions from a rule, written out in the SQL.
WIDTH = 64


def rule(rows: int, columns: int, start: int = 0) -> list[list[float]]:
    return [[((start + i * columns + j) * 37 % 101 - 50) / 500 for j in range(columns)] for i in range(rows)]


HEAD = rule(2, WIDTH)
HEAD_BIAS = [0.1, -0.1]
ENCODE_1, ENCODE_1_BIAS = rule(5, 4, 7), [0.2, -0.1, 0.0, 0.1, 0.3]
ENCODE_2, ENCODE_2_BIAS = rule(3, 5, 31), [0.1, 0.2, -0.3]
DECODE, DECODE_BIAS = rule(4, 3, 11), [0.0, 0.1, -0.1, 0.2]


def head() -> network.Network:
    return network.Network([network.linear(HEAD, HEAD_BIAS)])


def encoder() -> network.Network:
    import numpy as np

    return network.Network(
        [
            network.linear(ENCODE_1, ENCODE_1_BIAS),
            network.Layer("relu"),
            network.linear(ENCODE_2, ENCODE_2_BIAS),
            network.Layer("layer_norm", {"gamma": np.ones(3), "beta": np.zeros(3)}),
        ]
    )


def logits_sql(name: str, source: str) -> str:
    dots = [
        f"list_dot_product(z, {row}::DOUBLE[]) + {bias}::DOUBLE AS l{i}"
        for i, (row, bias) in enumerate(zip(HEAD, HEAD_BIAS, strict=True))
    ]
    return f"{name} AS (SELECT case_id, target, WEEK_NUM, {', '.join(dots)} FROM {source})"


SCORE = "1.0::DOUBLE / (1.0::DOUBLE + exp(l0 - l1))"
ENERGY = "-(greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))))"
NOISY = """noisy AS (
  SELECT case_id, target, WEEK_NUM, list_transform(z, lambda x, i: x + 10.0::DOUBLE
    * sqrt(-2.0::DOUBLE * ln((('0x' || substr(md5('42|' || case_id || '|' || (i - 1)), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE))
    * cos(2.0::DOUBLE * pi() * (('0x' || substr(md5('42|' || case_id || '|' || (i - 1)), 9, 8))::BIGINT / 4294967296.0::DOUBLE))
  ) AS z FROM latents)"""


def scored_latents(spark, sf_dir, with_logits=False):
    return score_vectors(t.latents(spark, sf_dir), [head()], "z", ["case_id", "target", "WEEK_NUM"], with_logits)


def scored_noise(spark, sf_dir, with_logits=False):
    noisy = perturb(t.latents(spark, sf_dir), "z", "case_id")
    return score_vectors(noisy, [head()], "z", ["case_id", "target", "WEEK_NUM"], with_logits)


@query(
    "score_energy",
    f"WITH {t.LATENTS}, {logits_sql('logits', 'latents')} "
    f"SELECT case_id, round({SCORE}, 6) AS score, round({ENERGY}, 6) AS energy FROM logits",
)
def score_energy(spark, sf_dir):
    return rounded(scored_latents(spark, sf_dir).select("case_id", "score", "energy"), ["score", "energy"])


@query(
    "ood_perturb",
    f"WITH {t.LATENTS}, {NOISY}, {logits_sql('logits', 'noisy')} "
    f"SELECT case_id, round(list_sum(z), 4) AS total, round({ENERGY}, 4) AS energy "
    "FROM noisy JOIN logits USING (case_id)",
)
def ood_perturb(spark, sf_dir):
    noisy = perturb(t.latents(spark, sf_dir), "z", "case_id")
    total = F.aggregate("z", F.lit(0.0), lambda acc, x: acc + x)
    rows = score_vectors(noisy.withColumn("total", total), [head()], "z", ["case_id", "total"])
    return rounded(rows.select("case_id", "total", "energy"), ["total", "energy"], 4)


def scaled_sql() -> str:
    """CTE with the scaled measures as x0, x1, …; values pass through 32-bit floats first."""
    scaled = [
        f"greatest(-10.0, least(10.0, (CAST(CAST({c} AS FLOAT) AS DOUBLE) - (SELECT avg({c}) FROM lineitem)) "
        f"/ (SELECT stddev_samp({c}) FROM lineitem))) AS x{i}"
        for i, c in enumerate(MEASURES)
    ]
    return f"scaled AS (SELECT l_orderkey, l_linenumber, l_returnflag, {', '.join(scaled)} FROM lineitem)"


def dense_sql(source: str, inputs: str, outputs: str, weights, bias, keep: str, relu: bool = False) -> str:
    columns = []
    for i, (row, b) in enumerate(zip(weights, bias, strict=True)):
        total = " + ".join(f"{inputs}{j} * {w}::DOUBLE" for j, w in enumerate(row)) + f" + {b}::DOUBLE"
        columns.append(f"greatest(0.0, {total}) AS {outputs}{i}" if relu else f"{total} AS {outputs}{i}")
    return f"SELECT {keep}, {', '.join(columns)} FROM {source}"


KEEP = "l_orderkey, l_linenumber, l_returnflag"
ENCODED = (
    f"{scaled_sql()}, h AS ({dense_sql('scaled', 'x', 'h', ENCODE_1, ENCODE_1_BIAS, KEEP + ', x0, x1, x2, x3', True)}), "
    f"o AS ({dense_sql('h', 'h', 'o', ENCODE_2, ENCODE_2_BIAS, KEEP + ', x0, x1, x2, x3')}), "
    "m AS (SELECT *, (o0 + o1 + o2) / 3 AS mu FROM o), "
    "s AS (SELECT *, sqrt(((o0 - mu) ** 2 + (o1 - mu) ** 2 + (o2 - mu) ** 2) / 3 + 1e-5::DOUBLE) AS sd FROM m), "
    "z AS (SELECT *, (o0 - mu) / sd AS z0, (o1 - mu) / sd AS z1, (o2 - mu) / sd AS z2 FROM s)"
)


def scaled_lines(spark, sf_dir):
    lines = t.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *MEASURES)
    scaler = ScalerModel.fit(lines, MEASURES)
    return lines.select("l_orderkey", "l_linenumber", "l_returnflag", scaled_vector(scaler).alias("x"))


@query(
    "latent_encode",
    f"WITH {ENCODED} SELECT l_orderkey, l_linenumber, round(z0, 3) AS z0, round(z1, 3) AS z1, round(z2, 3) AS z2 FROM z",
)
def latent_encode(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber"]
    coded = network.apply_network(scaled_lines(spark, sf_dir), encoder(), "x", "z", keys)
    return coded.select(*keys, *[F.round(F.get("z", F.lit(i)), 3).alias(f"z{i}") for i in range(3)])


@query(
    "recon_error",
    f"WITH {ENCODED}, d AS ({dense_sql('z', 'z', 'd', DECODE, DECODE_BIAS, KEEP + ', x0, x1, x2, x3')}), "
    "e AS (SELECT ((x0 - d0) ** 2 + (x1 - d1) ** 2 + (x2 - d2) ** 2 + (x3 - d3) ** 2) / 4 AS e, "
    "(SELECT count(*) FROM lineitem) / (3.0::DOUBLE * count(*) OVER (PARTITION BY l_returnflag)) AS w FROM d) "
    "SELECT count(*) AS n, round(avg(e), 5) AS mse, round(avg(e * w), 5) AS weighted_mse FROM e",
)
def recon_error(spark, sf_dir):
    whole = network.Network([*encoder().layers, network.linear(DECODE, DECODE_BIAS)])
    weighted = add_class_weights(scaled_lines(spark, sf_dir), "l_returnflag").select("x", "weight")
    rows = network.apply_network(weighted, whole, "x", "x_hat", ["x", "weight"])
    return rounded(evaluate.reconstruction_error(rows, "x", "x_hat", "weight"), ["mse", "weighted_mse"], 5)


WEEKLY = """weekly AS (
  SELECT WEEK_NUM, sum(pos) AS n_pos, sum(neg) AS n_neg, sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS auc
  FROM (SELECT WEEK_NUM, score, pos, neg,
               coalesce(sum(neg) OVER (PARTITION BY WEEK_NUM ORDER BY score
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT WEEK_NUM, score, sum(target) AS pos, sum(1 - target) AS neg FROM scored GROUP BY WEEK_NUM, score))
  GROUP BY WEEK_NUM HAVING sum(pos) > 0 AND sum(neg) > 0),
trend AS (
  SELECT count(*) AS n, regr_slope(2 * auc - 1, WEEK_NUM) AS a, regr_intercept(2 * auc - 1, WEEK_NUM) AS b,
         avg(2 * auc - 1) AS mean FROM weekly),
stable AS (
  SELECT any_value(mean) AS mean_gini, least(0.0, any_value(a)) AS falling_rate,
         stddev_pop(2 * auc - 1 - (a * WEEK_NUM + b)) AS std_residuals, any_value(n) AS n_weeks
  FROM weekly, trend)"""
STABLE = (
    "round(mean_gini + 88.0 * falling_rate - 0.5 * std_residuals, 6) AS stability_metric, "
    "round(mean_gini, 6) AS mean_gini, round(falling_rate, 6) AS falling_rate, "
    "round(std_residuals, 6) AS std_residuals, n_weeks"
)
STABLE_COLUMNS = ["stability_metric", "mean_gini", "falling_rate", "std_residuals"]


@query(
    "weekly_gini",
    f"WITH {t.SCORED}, {WEEKLY} SELECT WEEK_NUM, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, "
    "round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini FROM weekly",
)
def weekly_gini(spark, sf_dir):
    return rounded(evaluate.weekly_gini(t.scored_orders(spark, sf_dir)), ["auc", "gini"])


@query("gini_stability", f"WITH {t.SCORED}, {WEEKLY} SELECT {STABLE} FROM stable")
def gini_stability(spark, sf_dir):
    return rounded(evaluate.gini_stability(t.scored_orders(spark, sf_dir)), STABLE_COLUMNS)


@query(
    "evaluate_scores",
    f"WITH {t.SCORED}, {WEEKLY} SELECT {STABLE}, (SELECT round(avg(energy), 6) FROM scored) AS avg_energy FROM stable",
)
def evaluate_scores(spark, sf_dir):
    return rounded(evaluate.evaluate_scores(t.scored_orders(spark, sf_dir)), [*STABLE_COLUMNS, "avg_energy"])


@query(
    "auprc",
    f"""WITH {t.SCORED}, c AS (SELECT score, sum(target) AS pos, sum(1 - target) AS neg FROM scored GROUP BY score),
r AS (SELECT pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, neg
      FROM c WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(pos / p::DOUBLE * tp / (tp + fp)), 6) AS average_precision,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM r""",
)
def auprc(spark, sf_dir):
    return rounded(evaluate.average_precision(t.scored_orders(spark, sf_dir)), ["average_precision"])


@query(
    "calibration",
    f"""WITH {t.SCORED}, edges AS (
  SELECT quantile_cont(score, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS e FROM scored),
placed AS (SELECT len(list_filter(e, lambda x: x < score)) AS bin, score, target FROM scored, edges)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS prob_pred, round(avg(target), 6) AS prob_true
FROM placed GROUP BY bin""",
)
def calibration(spark, sf_dir):
    return rounded(evaluate.calibration_curve(t.scored_orders(spark, sf_dir)), ["prob_pred", "prob_true"])


@query(
    "energy_histogram",
    f"""WITH {t.SCORED}, spans AS (
  SELECT status AS population, count(*) AS total, min(energy) AS lo, max(energy) AS hi FROM scored GROUP BY status),
counts AS (
  SELECT population, CAST(least(floor((energy - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin, count(*) AS n
  FROM scored JOIN spans ON population = status GROUP BY ALL)
SELECT s.population, CAST(b AS INTEGER) AS bin, round(lo + b * ((hi - lo) / 50), 6) AS low,
       round(lo + (b + 1) * ((hi - lo) / 50), 6) AS high, coalesce(n, 0) AS n,
       round(coalesce(n, 0) / (total * ((hi - lo) / 50)), 6) AS density
FROM spans s CROSS JOIN range(50) r(b) LEFT JOIN counts c ON c.population = s.population AND c.bin = b""",
)
def energy_histogram(spark, sf_dir):
    scored = t.scored_orders(spark, sf_dir).withColumnRenamed("status", "population")
    return rounded(evaluate.histogram(scored), ["low", "high", "density"])


@query(
    "energy_summary",
    f"WITH {t.SCORED} SELECT count(energy) AS n, round(avg(energy), 6) AS mean, round(stddev_pop(energy), 6) AS std FROM scored",
)
def energy_summary(spark, sf_dir):
    return rounded(evaluate.energy_summary(t.scored_orders(spark, sf_dir)), ["mean", "std"])


@query(
    "energy_by_period",
    f"""WITH {t.SCORED} SELECT MONTH, count(energy) AS n, round(avg(energy), 6) AS mean,
round(stddev_pop(energy), 6) AS std, round(quantile_cont(energy, 0.05), 6) AS p05,
round(quantile_cont(energy, 0.5), 6) AS p50, round(quantile_cont(energy, 0.95), 6) AS p95 FROM scored GROUP BY MONTH""",
)
def energy_by_period(spark, sf_dir):
    periods = evaluate.energy_by_period(t.scored_orders(spark, sf_dir), "MONTH")
    return rounded(periods, ["mean", "std", "p05", "p50", "p95"])


@query(
    "energy_trajectory",
    f"""WITH {t.LATENTS}, {NOISY}, {logits_sql('real', 'latents')}, {logits_sql('fake', 'noisy')},
log AS (SELECT WEEK_NUM, {ENERGY} AS e_real, NULL::DOUBLE AS e_fake FROM real
        UNION ALL SELECT WEEK_NUM, NULL, {ENERGY} FROM fake)
SELECT WEEK_NUM AS step, round(avg(e_real), 6) AS e_real, round(avg(e_fake), 6) AS e_fake FROM log GROUP BY WEEK_NUM""",
)
def energy_trajectory(spark, sf_dir):
    """Stored latents and their perturbed copies as the real and generated rows of a run."""
    step, none = F.col("WEEK_NUM").alias("step"), F.lit(None).cast("double")
    real = scored_latents(spark, sf_dir).select(step, F.col("energy").alias("e_real"), none.alias("e_fake"))
    log = real.unionByName(scored_noise(spark, sf_dir).select(step, none.alias("e_real"), F.col("energy").alias("e_fake")))
    return rounded(evaluate.energy_trajectory(log), ["e_real", "e_fake"])


@query(
    "energy_drift",
    f"""WITH {t.LATENTS}, {NOISY}, {logits_sql('real', 'latents')}, {logits_sql('fake', 'noisy')},
ref AS (SELECT avg({ENERGY}) AS mean, stddev_pop({ENERGY}) AS std FROM real),
placed AS (SELECT WEEK_NUM, ({ENERGY} - mean) / std AS z FROM fake, ref)
SELECT WEEK_NUM, count(*) AS n, count(CASE WHEN z > 3 THEN 1 END) AS n_ood,
       round(count(CASE WHEN z > 3 THEN 1 END) / count(*), 6) AS share_ood, round(avg(z), 3) AS mean_z
FROM placed GROUP BY WEEK_NUM""",
)
def energy_drift(spark, sf_dir):
    reference = evaluate.energy_summary(scored_latents(spark, sf_dir))
    drift = evaluate.energy_drift(scored_noise(spark, sf_dir), reference)
    return rounded(rounded(evaluate.drift_summary(drift, "WEEK_NUM"), ["share_ood"]), ["mean_z"], 3)


@query(
    "score_losses",
    f"""WITH {t.LATENTS}, {NOISY}, {logits_sql('real', 'latents')}, {logits_sql('fake', 'noisy')},
w AS (SELECT *, (SELECT count(*) FROM real) / (2.0::DOUBLE * count(*) OVER (PARTITION BY target)) AS w FROM real),
r AS (SELECT sum(w * (-({ENERGY}) - CASE WHEN target = 1 THEN l1 ELSE l0 END)) AS ce, sum(w) AS w, count(*) AS n,
             avg({ENERGY}) AS e_real, avg(({ENERGY}) ** 2) AS sq FROM w),
f AS (SELECT avg({ENERGY}) AS e_fake, avg(({ENERGY}) ** 2) AS sq FROM fake)
SELECT round(ce / n, 5) AS clf_loss, round(ce / w, 5) AS clf_loss_normed, round(e_real, 5) AS e_real,
       round(e_fake, 5) AS e_fake, round(1e-4::DOUBLE * (r.sq + f.sq), 5) AS l2_loss, round(e_real - e_fake, 5) AS gen_loss,
       round(ce / n + e_real - e_fake + 1e-4::DOUBLE * (r.sq + f.sq), 5) AS total_loss FROM r, f""",
)
def score_losses(spark, sf_dir):
    real = add_class_weights(scored_latents(spark, sf_dir, with_logits=True))
    losses = evaluate.loss_terms(real, scored_noise(spark, sf_dir, with_logits=True), weight="weight")
    return rounded(losses, losses.columns, 5)


@query("pca_project")
def pca_project(spark, sf_dir):
    """Latents and their perturbed copies on the two main axes of the latents."""
    real = t.latents(spark, sf_dir)
    compared = perturb(real, "z", "case_id")
    on_axes, others = project(real, compared, "z", ["case_id"])
    both = on_axes.withColumn("population", F.lit("real")).unionByName(
        others.withColumn("population", F.lit("perturbed"))
    )
    axes = [F.get("pc", F.lit(i)).alias(f"pc{i + 1}") for i in range(2)]
    return rounded(both.select("population", "case_id", *axes), ["pc1", "pc2"], 4)


@query("fit_encoder")
def encoder_fit(spark, sf_dir):
    """Reconstruction error of the linear encoder learnt on the scaled measures."""
    lines = t.read(spark, sf_dir, "lineitem").select(*MEASURES)
    scaled = lines.select(scaled_vector(ScalerModel.fit(lines, MEASURES)).alias("x"))
    learnt, decoder = fit_encoder(scaled, "x", 2)
    coded = network.apply_network(scaled, learnt, "x", "z", ["x"])
    back = network.apply_network(coded, decoder, "z", "x_hat")
    return rounded(evaluate.reconstruction_error(back, "x", "x_hat"), ["mse", "weighted_mse"], 5)


@query("fit_head")
def head_fit(spark, sf_dir):
    """Scores and energies of a head fitted on the latents with class weights."""
    rows = add_class_weights(t.latents(spark, sf_dir))
    fitted = fit_head(rows, "z", weight="weight", regularization=0.01)
    return rounded(score_vectors(rows, [fitted], "z", ["case_id", "target"]), ["score", "energy"], 4)


def no_residual(df, column: str, digits: int):
    """Rounded, with one kind of zero."""
    return df.withColumn(column, F.round(column, digits) + F.lit(0.0))


SPREAD = " + ".join(f"var_samp(CAST(CAST({c} AS FLOAT) AS DOUBLE))" for c in MEASURES)


@query(
    "encoder_residual",
    f"""SELECT c.i AS component, f.i AS feature, 0.0::DOUBLE AS residual, round((SELECT {SPREAD} FROM lineitem), 2) AS spread
FROM range({len(MEASURES)}) c(i), range({len(MEASURES)}) f(i)""",
)
def encoder_residual(spark, sf_dir):
    """All axes of the measures: each is one of the covariance, and their variances add up to those of the measures."""
    lines = t.read(spark, sf_dir, "lineitem")
    x = lines.select(F.array(*[F.col(c).cast("float").cast("double") for c in MEASURES]).alias("x"))
    learnt, _ = fit_encoder(x, "x", len(MEASURES))
    found = encoder_residuals(x, "x", learnt)
    largest = F.max("variance").over(Window.partitionBy(F.lit(0)))
    one = found.select("component", "feature", (F.col("residual") / largest).alias("residual"), "variance")
    spread = F.sum(F.when(F.col("feature") == 0, F.col("variance"))).over(Window.partitionBy(F.lit(0)))
    told = one.select(F.col("component").cast("bigint"), F.col("feature").cast("bigint"), "residual", F.round(spread, 2).alias("spread"))
    return no_residual(told, "residual", 6)


@query(
    "wide_encoder_residual",
    f"SELECT c.i AS component, f.i AS feature, 0.0::DOUBLE AS residual FROM range(3) c(i), range({WIDTH}) f(i)",
)
def wide_encoder_residual(spark, sf_dir):
    """The main axes of the latents by power iteration, as for rows too wide for a covariance."""
    rows = t.latents(spark, sf_dir)
    learnt, _ = fit_encoder(rows, "z", 3, narrow=0)
    found = encoder_residuals(rows, "z", learnt)
    return no_residual(found.select(F.col("component").cast("bigint"), F.col("feature").cast("bigint"), "residual"), "residual", 3)


@query(
    "head_residual",
    f"SELECT c.i AS class, f.i - 1 AS feature, 0.0::DOUBLE AS gradient FROM range(2) c(i), range({WIDTH + 1}) f(i)",
)
def head_residual(spark, sf_dir):
    """The weighted gradient at the fitted head is zero."""
    rows = add_class_weights(t.latents(spark, sf_dir))
    found = head_gradient(rows, fit_head(rows, "z", weight="weight", iterations=500), "z", weight="weight")
    return no_residual(found.select(F.col("class").cast("bigint"), F.col("feature").cast("bigint"), "gradient"), "gradient", 4)


TOP, TOP_BIAS = rule(2, 3, 5), [0.05, -0.05]


@query(
    "score_raw",
    f"WITH {ENCODED}, l AS ({dense_sql('z', 'z', 'l', TOP, TOP_BIAS, KEEP)}) "
    f"SELECT l_orderkey, l_linenumber, round({SCORE}, 4) AS score, round({ENERGY}, 4) AS energy FROM l",
)
def score_raw(spark, sf_dir):
    """Raw measures through scaler, encoder and head at once."""
    lines = t.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *MEASURES)
    top = network.Network([network.linear(TOP, TOP_BIAS)])
    model = ScoringModel(ScalerModel.fit(lines, MEASURES), encoder(), top)
    return rounded(model.score(lines, ["l_orderkey", "l_linenumber"]), ["score", "energy"], 4)
