"""Stored state and written tables, read back; groups whose key is null or large."""

from __future__ import annotations

from pyspark.sql import functions as F

from hierfeat.catalog import tables as t
from hierfeat.catalog.hierarchy import categories, category_sql, nearest_iqr_sql, number_sql
from hierfeat.catalog.learning import IMPUTED, MEASURES, party
from hierfeat.catalog.registry import query, rounded
from hierfeat.catalog.samples import CHUNK_ROWS, CHUNKED, SAMPLE, order_rows, sampled_ids
from hierfeat.operators import evaluate, impute
from hierfeat.operators.assemble import restrict
from hierfeat.operators.ordering import assign_chunks
from hierfeat.operators.prepare import drop_low_variance
from hierfeat.operators.rollup import rollup_history
from hierfeat.operators.sampling import random_subset, stratified_sample
from hierfeat.operators.scale import ScalerModel
from hierfeat.operators.skew import find_hot_keys
from hierfeat.session import new_folder
from hierfeat.sources import export
from hierfeat.sources.state import load_features, save_features


@query("imputer_state", IMPUTED)
def imputer_state(spark, sf_dir):
    """The imputer stored, loaded and applied to new data."""
    folder = new_folder(spark, "imputer")
    impute.Imputer().fit(party(spark, sf_dir, "customer")).save(folder)
    model = impute.ImputerModel.load(spark, folder)
    return rounded(model.transform(party(spark, sf_dir, "supplier")), ["balance"], 4)


@query(
    "scaler_state",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"round(greatest(-10, least(10, ({c} - (SELECT avg({c}) FROM lineitem)) / "
        f"sqrt((SELECT var_samp({c}) FROM lineitem)))), 5) AS {c}"
        for c in MEASURES
    )
    + " FROM lineitem",
)
def scaler_state(spark, sf_dir):
    """The scaler stored, loaded, checked against the features and applied."""
    lines = t.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *MEASURES)
    folder = new_folder(spark, "scaler")
    ScalerModel.fit(lines, MEASURES).save(spark, folder)
    model = ScalerModel.load(spark, folder)
    model.check(MEASURES)
    return rounded(model.transform(lines), MEASURES, 5)


@query(
    "feature_list_state",
    """WITH v AS (
  SELECT 1 AS place, 'l_quantity' AS col, var_samp(l_quantity) AS v FROM lineitem UNION ALL
  SELECT 2, 'flat', var_samp(l_tax / 1000.0::DOUBLE) FROM lineitem UNION ALL
  SELECT 3, 'l_tax', var_samp(l_tax) FROM lineitem UNION ALL
  SELECT 4, 'l_discount', var_samp(l_discount) FROM lineitem)
SELECT row_number() OVER (ORDER BY place) - 1 AS pos, col,
       CASE col WHEN 'l_quantity' THEN (SELECT count(l_quantity) FROM lineitem)
                WHEN 'l_tax' THEN (SELECT count(l_tax) FROM lineitem) ELSE (SELECT count(l_discount) FROM lineitem) END AS n
FROM v WHERE v >= 1e-4""",
)
def feature_list_state(spark, sf_dir):
    """Features that vary, stored and loaded in their order, with the rows that have them."""
    lines = t.read(spark, sf_dir, "lineitem").select(
        "l_quantity", (F.col("l_tax") / 1000.0).alias("flat"), "l_tax", "l_discount"
    )
    folder = new_folder(spark, "features")
    save_features(spark, drop_low_variance(lines, lines.columns), folder)
    features = load_features(spark, folder)
    place = F.create_map(*[F.lit(x) for i, c in enumerate(features) for x in (c, i)])
    counts = lines.agg(*[F.count(c).alias(c) for c in features]).unpivot([], features, "col", "n")
    return counts.select(F.element_at(place, F.col("col")).cast("bigint").alias("pos"), "col", "n")


@query(
    "chunk_files",
    f"WITH {t.SCORED}, {CHUNKED} SELECT chunk, count(*) AS n, min(case_id) AS first_id, max(case_id) AS last_id, "
    "sum(target) AS positives FROM chunked GROUP BY chunk",
)
def chunk_files(spark, sf_dir):
    """Chunks written and read back."""
    folder = new_folder(spark, "chunks")
    export.export_chunks(order_rows(spark, sf_dir), folder, CHUNK_ROWS)
    return (
        export.read_chunks(spark, folder)
        .groupBy(F.col("chunk").cast("bigint").alias("chunk"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("case_id").alias("first_id"),
            F.max("case_id").alias("last_id"),
            F.sum("target").alias("positives"),
        )
    )


@query("table_file", f"WITH {t.SCORED} SELECT case_id, target, WEEK_NUM FROM scored")
def table_file(spark, sf_dir):
    folder = new_folder(spark, "table")
    export.export_table(order_rows(spark, sf_dir), folder)
    return spark.read.parquet(folder)


@query("score_file", f"WITH {t.SCORED} SELECT case_id, score FROM scored")
def score_file(spark, sf_dir):
    """Scores written as CSV with a header and read back."""
    folder = new_folder(spark, "scores")
    export.export_scores(t.scored_orders(spark, sf_dir), folder)
    return spark.read.option("header", True).schema("case_id bigint, score double").csv(folder)


@query(
    "latent_files",
    f"""WITH {t.LATENTS}, placed AS (SELECT *, (row_number() OVER (ORDER BY case_id) - 1) // 64 + 1 AS chunk FROM latents)
SELECT chunk, target, count(*) AS n, round(sum(list_sum(z)), 4) AS total FROM placed GROUP BY ALL""",
)
def latent_files(spark, sf_dir):
    """Latent vectors written by chunk and read back."""
    folder = new_folder(spark, "latents")
    export.export_latents(assign_chunks(t.latents(spark, sf_dir), 64), folder)
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + x.cast("double"))
    stored = export.read_latents(spark, folder).groupBy(F.col("chunk").cast("bigint").alias("chunk"), "target")
    return rounded(stored.agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("total")), ["total"], 4)


@query(
    "random_subset",
    f"WITH {t.SCORED} SELECT case_id, score FROM scored ORDER BY md5('42|' || case_id), case_id LIMIT 500",
)
def subset(spark, sf_dir):
    """A fixed number of rows; the number is the feature."""
    return random_subset(t.scored_orders(spark, sf_dir).select("case_id", "score"), "case_id", 500)


@query("sample_everything", f"WITH {t.CUSTOMERS} SELECT case_id FROM customers")
def sample_everything(spark, sf_dir):
    return stratified_sample(t.customers(spark, sf_dir), 1.0)


@query(
    "sampled_depth0",
    f"WITH {t.CUSTOMERS}, {t.PLACES}, {SAMPLE} SELECT * FROM places SEMI JOIN sample USING (case_id)",
)
def sampled_depth0(spark, sf_dir):
    return restrict(t.places(spark, sf_dir), sampled_ids(spark, sf_dir))


@query(
    "sampled_hot",
    f"WITH {t.CUSTOMERS}, {t.ORDERS}, {SAMPLE} SELECT case_id, num_group1, week FROM hist SEMI JOIN sample USING (case_id)",
)
def sampled_hot(spark, sf_dir):
    """Restriction with keys of ten rows and more handled as hot."""
    rows = t.orders(spark, sf_dir).select("case_id", "num_group1", "week")
    return restrict(rows, sampled_ids(spark, sf_dir), hot=find_hot_keys(rows.select("case_id"), ["case_id"], cells=10))


UNOWNED = """unowned AS (
  SELECT CASE WHEN num_group1 % 13 = 0 THEN NULL ELSE case_id END AS case_id, num_group1, price, week, status, priority
  FROM hist)"""


def unowned_orders(spark, sf_dir):
    rows = t.orders(spark, sf_dir).select("case_id", "num_group1", "price", "week", "status", "priority")
    return rows.withColumn("case_id", F.when(F.col("num_group1") % 13 != 0, F.col("case_id")))


def unowned_sql() -> str:
    nothing = "coalesce(case_id, -1) AS case_id"
    source = f"keyed AS (SELECT * REPLACE ({nothing}) FROM unowned)"
    picks = [f"{c}_{s}" for c in ("price", "week") for s in ("max", "min", "mean", "std")]
    return (
        f"WITH {t.ORDERS}, {UNOWNED}, {source}, n AS (SELECT case_id, {number_sql('price')}, {number_sql('week')} FROM keyed "
        f"GROUP BY case_id), {nearest_iqr_sql('ip', 'keyed', 'price')}, {nearest_iqr_sql('iw', 'keyed', 'week')}, "
        f"{category_sql('s', 'keyed', 'status', 'num_group1')}, {category_sql('p', 'keyed', 'priority', 'num_group1')} "
        f"SELECT nullif(n.case_id, -1) AS case_id, {', '.join(picks)}, price_iqr, week_iqr, {categories('status')}, "
        f"{categories('priority')} FROM n LEFT JOIN ip USING (case_id) LEFT JOIN iw USING (case_id) "
        "JOIN s ON s.case_id = n.case_id JOIN p ON p.case_id = n.case_id"
    )


@query("null_key_rollup", unowned_sql())
def null_key_rollup(spark, sf_dir):
    """Orders without an owner form a group of their own, in numbers and categories alike."""
    return rounded(rollup_history(unowned_orders(spark, sf_dir)), ["price_std", "week_std"], 2)


@query("hot_key_rollup", unowned_sql())
def hot_key_rollup(spark, sf_dir):
    """The same with every key of more than eight rows, the missing one too, handled as hot."""
    rows = unowned_orders(spark, sf_dir)
    hot = find_hot_keys(rows.select("case_id"), ["case_id"], cells=8)
    return rounded(rollup_history(rows, hot=hot), ["price_std", "week_std"], 2)


COPIES = 24


@query(
    "wide_rollup",
    f"WITH {t.ORDERS}, {UNOWNED} SELECT case_id, max(status) IS NULL AS no_status, "
    + ", ".join(f"max(price + {i}) AS p{i}_max, avg(price + {i}) AS p{i}_mean" for i in range(COPIES))
    + " FROM unowned GROUP BY case_id",
)
def wide_rollup(spark, sf_dir):
    """More columns than are aggregated side by side, and a text: no group is lost."""
    rows = unowned_orders(spark, sf_dir)
    price = F.when(~F.isnan("price"), F.col("price"))
    wide = rows.select("case_id", "num_group1", "status", *[(price + i).alias(f"p{i}") for i in range(COPIES)])
    rolled = rollup_history(wide, iqr=None)
    names = [f"p{i}_{s}" for i in range(COPIES) for s in ("max", "mean")]
    return rolled.select("case_id", F.col("status_last").isNull().alias("no_status"), *names)


@query(
    "energy_by_day",
    f"""WITH {t.SCORED}, d AS (SELECT o_orderdate AS day, energy FROM scored JOIN orders ON o_orderkey = case_id)
SELECT day, count(*) AS n, round(avg(energy), 6) AS mean, round(stddev_pop(energy), 6) AS std,
       round(quantile_cont(energy, 0.05), 6) AS p05, round(quantile_cont(energy, 0.5), 6) AS p50,
       round(quantile_cont(energy, 0.95), 6) AS p95 FROM d GROUP BY day""",
)
def energy_by_day(spark, sf_dir):
    """Percentiles of many small groups."""
    days = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").alias("day"))
    rows = t.scored_orders(spark, sf_dir).select("case_id", "energy").join(days, "case_id")
    return rounded(evaluate.energy_by_period(rows, "day"), ["mean", "std", "p05", "p50", "p95"])
