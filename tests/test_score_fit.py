import numpy as np
import pytest
from conftest import records
from pyspark.sql import functions as F

from hierfeat.functions import vectors
from hierfeat.operators.fit import fit_encoder, fit_head, project
from hierfeat.operators.network import Layer, Network, apply_network, fold_spectral_norm, linear
from hierfeat.operators.scale import ScalerModel
from hierfeat.operators.score import ScoringModel, head_outputs, perturb, score_vectors


def small_model():
    rng = np.random.default_rng(0)
    encoder = Network(
        [
            linear(rng.normal(size=(5, 3)), rng.normal(size=5)),
            Layer("batch_norm", {"mean": rng.normal(size=5), "var": np.ones(5), "gamma": np.ones(5), "beta": np.zeros(5)}),
            Layer("relu"),
            linear(rng.normal(size=(2, 5)), np.zeros(2)),
            Layer("layer_norm", {"gamma": np.ones(2), "beta": np.zeros(2)}),
        ]
    )
    head = Network([linear(rng.normal(size=(4, 2)), np.zeros(4)), Layer("leaky_relu"), linear(rng.normal(size=(2, 4)), np.zeros(2))])
    return ScoringModel(ScalerModel(["a", "b", "c"], [0.0, 1.0, 2.0], [1.0, 4.0, 9.0]), encoder, head)


def table(spark, n=12):
    return spark.range(n).selectExpr(
        "id AS case_id", "double(id) AS a", "double(id % 3) AS b", "IF(id = 5, NULL, double(id % 5)) AS c"
    )


def test_scores_keep_ids_and_lie_in_0_1(spark):
    got = small_model().score(table(spark).repartition(3)).orderBy("case_id").collect()
    assert [r.case_id for r in got] == list(range(12))
    assert all(0.0 <= r.score <= 1.0 and np.isfinite(r.energy) for r in got)


def test_scores_equal_the_same_sums_by_hand(spark):
    model = small_model()
    rows = table(spark).orderBy("case_id").toPandas().fillna(0.0)
    x = np.clip((rows[["a", "b", "c"]].to_numpy() - model.scaler.mean) / np.sqrt(model.scaler.var), -10, 10)
    score, energy = head_outputs(model.head.apply(model.encoder.apply(x)))
    got = model.score(table(spark)).orderBy("case_id").toPandas()
    np.testing.assert_allclose(got["score"], score)
    np.testing.assert_allclose(got["energy"], energy)


def test_encode_then_score_latents(spark):
    model = small_model()
    z = model.encode(table(spark), ["case_id"])
    assert records(model.score_latent(z)) == records(model.score(table(spark)))
    logits = model.score(table(spark), with_logits=True)
    checked = logits.select(
        F.abs(vectors.energy(F.col("logits")) - F.col("energy")).alias("e"),
        F.abs(vectors.softmax_at(F.col("logits"), 1) - F.col("score")).alias("p"),
    ).agg(F.max("e"), F.max("p")).first()
    assert max(checked) < 1e-12


def test_energy_is_stable_for_large_logits(spark):
    score, energy = head_outputs(np.array([[1000.0, 999.0], [-1e5, -1e5]]))
    assert energy[0] == pytest.approx(-1000.3132616) and energy[1] == pytest.approx(1e5 - np.log(2))
    assert score[1] == 0.5
    df = spark.createDataFrame([([1000.0, 999.0],)], "l array<double>")
    assert df.select(vectors.energy(F.col("l"))).first()[0] == pytest.approx(-1000.3132616)
    assert df.select(vectors.dot(F.col("l"), F.col("l"))).first()[0] == 1000.0**2 + 999.0**2


def test_model_round_trip_and_dimensions(spark, tmp_path):
    model = small_model()
    model.save(spark, str(tmp_path / "m"))
    again = ScoringModel.load(spark, str(tmp_path / "m"), ["a", "b", "c"])
    assert records(again.score(table(spark))) == records(model.score(table(spark)))
    with pytest.raises(ValueError, match="2 features"):
        ScoringModel.load(spark, str(tmp_path / "m"), ["a", "b"])
    with pytest.raises(ValueError, match="encoder takes 3"):
        ScoringModel(ScalerModel(["a"], [0.0], [1.0]), model.encoder, model.head)
    with pytest.raises(ValueError, match="layer takes"):
        Network([linear(np.ones((2, 3)), np.zeros(2)), linear(np.ones((2, 3)), np.zeros(2))])
    with pytest.raises(ValueError, match="outputs"):
        linear(np.ones((2, 3)), np.zeros(3))


def test_null_vectors_are_an_error(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "case_id int, z array<double>")
    with pytest.raises(Exception, match="null rows"):
        apply_network(df, Network([linear([[1.0]], [0.0])]), "z", "y").collect()


def test_spectral_norm_folds_away():
    weight = np.array([[3.0, 0.0], [0.0, 1.0]])
    np.testing.assert_allclose(fold_spectral_norm(weight, [1.0, 0.0], [1.0, 0.0]), [[1.0, 0.0], [0.0, 1 / 3]])


def test_noise_is_normal_and_fixed(spark):
    df = spark.range(400).select(F.col("id").alias("case_id"), F.array_repeat(F.lit(1.0), 16).alias("z"))
    noisy = perturb(df, "z", "case_id")
    values = np.concatenate([r.z for r in noisy.collect()])
    assert abs(values.mean() - 1.0) < 0.5 and abs(values.std() - 10.0) < 0.5
    assert records(noisy) == records(perturb(df.repartition(5), "z", "case_id"))


def test_linear_encoder_and_projection(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 4)) + 5.0
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "case_id int, x array<double>")
    encoder, decoder = fit_encoder(df, "x", 2)
    np.testing.assert_allclose(decoder.apply(encoder.apply(x)), x, atol=1e-8)
    np.testing.assert_allclose(encoder.apply(x).mean(axis=0), 0, atol=1e-8)
    weight = encoder.layers[0].weights["weight"]
    assert (weight[np.arange(2), np.abs(weight).argmax(axis=1)] > 0).all()
    real, other = project(df, df.limit(10), "x", ["case_id"])
    assert real.count() == 300 and len(other.first().pc) == 2


def test_head_learns_the_class(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(400, 3))
    y = (z[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(int)
    rows = [(i, [float(v) for v in r], int(t), 1.0 + int(t)) for i, (r, t) in enumerate(zip(z, y, strict=True))]
    df = spark.createDataFrame(rows, "case_id int, z array<double>, target int, w double")
    head = fit_head(df, weight="w")
    assert head.layers[0].weights["weight"].shape == (2, 3)
    scored = score_vectors(df, [head], "z", ["target"])
    right = scored.filter((F.col("score") > 0.5) == (F.col("target") == 1)).count()
    assert right > 350


def wide_rows(spark, n, width, rank, seed=3):
    rng = np.random.default_rng(seed)
    spread = 10.0 / (1 + np.arange(rank))
    x = (rng.normal(size=(n, rank)) * spread) @ rng.normal(size=(rank, width)) + 0.01 * rng.normal(size=(n, width)) + 3.0
    df = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "case_id int, x array<double>").repartition(4)
    return x, df


def test_power_iteration_finds_the_axes(spark):
    x, df = wide_rows(spark, 200, 30, 6)
    exact, _ = fit_encoder(df, "x", 3)
    encoder, decoder = fit_encoder(df, "x", 3, narrow=0)
    for a, b in ((exact, encoder),):
        np.testing.assert_allclose(a.layers[0].weights["weight"], b.layers[0].weights["weight"], atol=1e-5)
        np.testing.assert_allclose(a.layers[0].weights["bias"], b.layers[0].weights["bias"], atol=1e-3)
    assert np.abs(decoder.apply(encoder.apply(x)) - x).mean() < np.abs(x - x.mean(axis=0)).mean() / 2


def test_very_wide_rows(spark):
    """5,000 features: their covariance would hold 25 million numbers."""
    x, df = wide_rows(spark, 80, 5_000, 4)
    encoder, _ = fit_encoder(df, "x", 4)
    weight = encoder.layers[0].weights["weight"]
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    np.testing.assert_allclose(np.abs((weight * axes[:4]).sum(axis=1)), 1, atol=1e-6)
    np.testing.assert_allclose(weight @ weight.T, np.eye(4), atol=1e-8)


def test_residuals_show_a_wrong_fit(spark):
    from hierfeat.operators.fit import encoder_residuals, head_gradient

    x, df = wide_rows(spark, 100, 5, 5)
    encoder, _ = fit_encoder(df, "x", 5)
    assert max(abs(r.residual) for r in encoder_residuals(df, "x", encoder).collect()) < 1e-6
    wrong = Network([linear(np.eye(5), np.zeros(5))])
    assert max(abs(r.residual) for r in encoder_residuals(df, "x", wrong).collect()) > 1
    rows = df.withColumn("target", (F.col("case_id") % 3 == 0).cast("int")).withColumn("w", F.col("case_id") % 4 + 1.0)
    fitted = fit_head(rows, "x", weight="w")
    assert max(abs(r.gradient) for r in head_gradient(rows, fitted, "x", weight="w").collect()) < 1e-4
    assert max(abs(r.gradient) for r in head_gradient(rows, Network([linear(np.zeros((2, 5)), np.zeros(2))]), "x").collect()) > 0.01


def test_encoders_need_rows(spark):
    none = spark.createDataFrame([], "x array<double>")
    with pytest.raises(ValueError, match="no rows"):
        fit_encoder(none, "x", 2)
    with pytest.raises(ValueError, match="two rows"):
        fit_encoder(spark.createDataFrame([([1.0, 2.0],)], "x array<double>"), "x", 1, narrow=0)
