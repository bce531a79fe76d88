import random
from functools import partial

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import records
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from hierfeat.operators.evaluate import gini_stability
from hierfeat.operators.scale import ScalerModel
from hierfeat.operators.skew import find_hot_keys
from hierfeat.plans.feature_build import FeatureBuild
from hierfeat.plans.learning import learn
from hierfeat.plans.scoring_job import score_test_set
from hierfeat.sources.export import read_chunks
from hierfeat.spec import BuildConfig, HierarchySpec, TableSpec
from hierfeat.streaming.chunks import chunk_stream, fold_moments, folded_scaler, score_stream

SPEC = HierarchySpec(
    (
        TableSpec("train_person_1", 1),
        TableSpec("train_person_2", 2, parent="train_person_1"),
        TableSpec("train_static_0", 0),
    )
)


def write_tables(folder, mode, n, seed):
    rng = random.Random(seed)
    folder.mkdir(parents=True, exist_ok=True)

    def save(name, **columns):
        pq.write_table(pa.table(columns), folder / f"{mode}_{name}.parquet")

    ids = list(range(n))
    base = {"case_id": ids, "MONTH": [202001 + i % 6 for i in ids], "WEEK_NUM": [i % 30 for i in ids]}
    if mode == "train":
        base["target"] = [int(rng.random() < 0.3) for _ in ids]
    save("base", **base)
    history = [(i, g) for i in ids if i % 7 for g in range(rng.randint(1, 4))]
    income = [rng.choice([None, rng.gauss(100, 20)]) for _ in history]
    kind = [rng.choice(["A", "B", None]) for _ in history]
    save(
        "person_1_0",
        case_id=[i for i, _ in history],
        num_group1=[g for _, g in history],
        income_1A=pa.array(income, pa.float64()),
        kind_2M=kind,
    )
    extra = [(n - 1, 9)]
    save(
        "person_1_1",
        case_id=[i for i, _ in extra],
        num_group1=[g for _, g in extra],
        income_1A=pa.array([50], pa.int32()),
        kind_2M=pa.nulls(1),
    )
    deep = [(i, g, k) for i, g in history if (i + g) % 2 for k in range(2)]
    save(
        "person_2",
        case_id=[i for i, _, _ in deep],
        num_group1=[g for _, g, _ in deep],
        num_group2=[k for _, _, k in deep],
        days_3P=[float(k) for _, _, k in deep],
        place_4T=[f"p{k}" for _, _, k in deep],
    )
    save("static_0", case_id=ids, debt_5A=[float(i % 13) for i in ids], vip_6L=[i % 2 == 0 for i in ids])


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    write_tables(folder / "data", "train", 400, 1)
    write_tables(folder / "data", "test", 60, 2)
    config = BuildConfig(
        data_dir=str(folder / "data"),
        sample_ratio=0.5,
        artifact_dir=str(folder / "artifacts"),
        output_dir=str(folder / "out"),
        chunk_size=64,
    )
    return folder, config, FeatureBuild(SPEC, config).run(spark)


def test_training_build(spark, run):
    folder, config, features = run
    base = spark.read.parquet(str(folder / "data" / "train_base.parquet"))
    sizes = {r.target: r["count"] for r in base.groupBy("target").count().collect()}
    assert features.count() == sum(n // 2 for n in sizes.values())
    assert features.select([c for c in features.columns if c.endswith("joined_flag")]).columns == [
        "person_1_joined_flag",
        "person_2_joined_flag",
        "static_0_joined_flag",
    ]
    filled = [F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in features.columns]
    assert set(features.agg(*filled).first()) == {0}
    assert {"income_1A_iqr", "kind_2M_mode_count", "days_3P_max", "place_4T_last", "debt_5A", "vip_6L"} <= set(features.columns)
    chunks = read_chunks(spark, f"{config.output_dir}/chunks")
    counts = {r.chunk: r["count"] for r in chunks.groupBy("chunk").count().collect()}
    assert sum(counts.values()) == features.count()
    assert [n for c, n in sorted(counts.items())][:-1] == [64] * (len(counts) - 1)
    flagged = features.filter("person_1_joined_flag = 0").select("case_id").collect()
    assert flagged and all(r.case_id % 7 == 0 for r in flagged)


def test_build_is_the_same_under_any_partitioning(spark, run, tmp_path):
    _, config, features = run
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        again = FeatureBuild(SPEC, config).run(spark, export=False)
        rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in features.dtypes]
        assert records(again.select(*rounded)) == records(features.select(*rounded))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)


def test_build_with_hot_entities(spark, run, monkeypatch):
    """Low bounds make most entities hot, some of them giant; the matrix stays the same."""
    _, config, features = run
    hot = partial(find_hot_keys, cells=30, giant=0.003)
    monkeypatch.setattr("hierfeat.plans.feature_build.find_hot_keys", hot)
    again = FeatureBuild(SPEC, config).run(spark, export=False)
    rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in features.dtypes]
    assert records(again.select(*rounded)) == records(features.select(*rounded))


def test_learn_and_score(spark, run, tmp_path):
    folder, config, _ = run
    chunks = read_chunks(spark, f"{config.output_dir}/chunks")
    learnt = learn(chunks, config.artifact_dir, latent_dim=6)
    assert learnt.latents.count() == chunks.count()
    assert set(learnt.latents.columns) == {"case_id", "chunk", "target", "WEEK_NUM", "z"}
    assert not {"case_id", "target", "chunk", "WEEK_NUM"} & set(learnt.features)
    scored = learnt.model.score_latent(learnt.latents, keep=["case_id", "target", "WEEK_NUM"])
    assert gini_stability(scored).first().n_weeks > 2

    test = BuildConfig(**{**config.__dict__, "is_inference": True})
    result, summary = score_test_set(spark, SPEC, test, str(tmp_path / "scores"))
    written = spark.read.csv(str(tmp_path / "scores"), header=True, inferSchema=True)
    assert written.columns == ["case_id", "score"] and written.count() == 60
    assert result.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert summary.first().n == 60


def test_inference_without_state_fails(spark, run, tmp_path):
    _, config, _ = run
    lost = BuildConfig(**{**config.__dict__, "is_inference": True, "artifact_dir": str(tmp_path / "none")})
    with pytest.raises(AnalysisException):
        FeatureBuild(SPEC, lost).run(spark)


def test_chunks_as_a_stream(spark, run, tmp_path):
    folder, config, _ = run
    path = f"{config.output_dir}/chunks"
    stored = spark.read.parquet(path)
    columns = ["debt_5A", "income_1A_mean"]
    schema = stored.drop("train_chunk").schema
    stream = chunk_stream(spark, path, schema, files_per_trigger=1)
    fold_moments(stream, columns, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(120)
    folded = folded_scaler(spark, str(tmp_path / "state"))
    whole = ScalerModel.fit(stored, columns)
    assert folded.mean == pytest.approx(whole.mean) and folded.var == pytest.approx(whole.var)

    import numpy as np

    from hierfeat.operators.network import Network, linear
    from hierfeat.operators.score import ScoringModel

    model = ScoringModel(whole, Network([linear(np.eye(2), np.zeros(2))]), Network([linear(np.eye(2), np.zeros(2))]))
    query = score_stream(chunk_stream(spark, path, schema), model, str(tmp_path / "scored"), str(tmp_path / "cp2"))
    query.awaitTermination(120)
    assert records(spark.read.parquet(str(tmp_path / "scored"))) == records(model.score(stored))
