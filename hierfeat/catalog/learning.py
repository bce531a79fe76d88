"""Imputation, preparation and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from hierfeat.catalog import tables as t
from hierfeat.catalog.registry import query, rounded
from hierfeat.functions.missing import null_indicator
from hierfeat.operators import impute
from hierfeat.operators.prepare import (
    feature_columns,
    inverse_class_weight,
    prepare_features,
    split_by_week,
    variances,
)
from hierfeat.operators.profile import describe
from hierfeat.operators.scale import ScalerModel, merge_moments, moments, sample_variance

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def gappy_orders(spark, sf_dir):
    """Orders with nulls and NaN in a double, nulls in a whole number and a text."""
    gap = F.col("o_orderkey")
    price = F.when(gap % 11 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return t.read(spark, sf_dir, "orders").select(
        gap.alias("case_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("target"),
        F.when(gap % 5 != 0, price).alias("price"),
        F.when(gap % 13 != 0, t.week_of(F.col("o_orderdate"))).alias("week"),
        F.when(gap % 7 != 0, F.col("o_orderpriority")).alias("priority"),
        (F.col("o_totalprice") > 250000).alias("is_large"),
    )


GAPPY = """gappy AS (
  SELECT o_orderkey AS case_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS price,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL
              ELSE CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // 7 AS INTEGER) END AS week,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority,
         o_totalprice > 250000 AS is_large
  FROM orders)"""


@query(
    "missing_indicators",
    f"""WITH {GAPPY} SELECT case_id,
CAST(CASE WHEN price IS NULL OR isnan(price) THEN 1 ELSE 0 END AS TINYINT) AS price_is_null,
CAST(CASE WHEN week IS NULL THEN 1 ELSE 0 END AS TINYINT) AS week_is_null FROM gappy""",
)
def missing_indicators(spark, sf_dir):
    df = gappy_orders(spark, sf_dir)
    return df.select(
        "case_id",
        *[null_indicator(F.col(c), df.schema[c].dataType).alias(f"{c}_is_null") for c in ("price", "week")],
    )


# DuckDB's median, too, sorts NaN last.
@query(
    "impute_fit_medians",
    f"""WITH {GAPPY}
SELECT 'price' AS col, round(quantile_cont(price, 0.5), 4) AS value FROM gappy UNION ALL
SELECT 'week', round(quantile_cont(CAST(week AS DOUBLE), 0.5), 4) FROM gappy""",
)
def impute_fit_medians(spark, sf_dir):
    return rounded(impute.median_table(gappy_orders(spark, sf_dir), ["price", "week"]), ["value"], 4)


@query(
    "impute_fit_freqs",
    f"""WITH {GAPPY}
SELECT 'priority' AS col, coalesce(priority, 'MISSING') AS value, count(*) AS n FROM gappy GROUP BY ALL UNION ALL
SELECT 'is_large', CAST(is_large AS VARCHAR), count(*) FROM gappy GROUP BY ALL""",
)
def impute_fit_freqs(spark, sf_dir):
    return impute.value_counts(gappy_orders(spark, sf_dir), ["priority", "is_large"])


def party(spark, sf_dir, table: str):
    """Customers as the training table; suppliers as new data that lack a column and have another."""
    p, key = table[0], "c_custkey" if table == "customer" else "s_suppkey"
    rows = t.read(spark, sf_dir, table)
    columns = [
        F.col(key).alias("case_id"),
        F.when(F.col(key) % 5 != 0, F.col(f"{p}_acctbal")).alias("balance"),
        F.col(f"{p}_nationkey").alias("nation_no"),
        F.when(F.col(key) % 9 != 0, F.col(f"{p}_nationkey").cast("string")).alias("nation"),
    ]
    if table == "customer":
        columns += [(F.col("c_acctbal") < 0).cast("int").alias("target"), F.col("c_mktsegment").alias("segment")]
        columns += [(F.col("c_nationkey") % 4).alias("zone")]
    else:
        columns += [F.col("s_name").alias("name")]
    return rows.select(*columns)


IMPUTED = """WITH train AS (
  SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS balance, c_nationkey % 4 AS zone,
         CASE WHEN c_custkey % 9 = 0 THEN 'MISSING' ELSE CAST(c_nationkey AS VARCHAR) END AS nation
  FROM customer),
counts AS (SELECT nation, count(*) AS n FROM train GROUP BY nation),
test AS (
  SELECT s_suppkey AS case_id, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal END AS balance, s_nationkey,
         CASE WHEN s_suppkey % 9 = 0 THEN 'MISSING' ELSE CAST(s_nationkey AS VARCHAR) END AS nation
  FROM supplier)
SELECT case_id, round(coalesce(balance, (SELECT median(balance) FROM train)), 4) AS balance,
       CAST(s_nationkey AS DOUBLE) AS nation_no, coalesce(n, 1) AS nation, CAST(1 AS BIGINT) AS segment,
       (SELECT median(zone) FROM train) AS zone,
       CAST(CASE WHEN balance IS NULL THEN 1 ELSE 0 END AS TINYINT) AS balance_is_null,
       CAST(0 AS TINYINT) AS nation_no_is_null, CAST(0 AS TINYINT) AS zone_is_null
FROM test LEFT JOIN counts USING (nation)"""


@query("impute_apply", IMPUTED)
def impute_apply(spark, sf_dir):
    model = impute.Imputer().fit(party(spark, sf_dir, "customer"))
    return rounded(model.transform(party(spark, sf_dir, "supplier")), ["balance"], 4)


@query(
    "freq_encode",
    f"""WITH {GAPPY}, filled AS (
  SELECT case_id, coalesce(priority, 'MISSING') AS priority, CAST(is_large AS VARCHAR) AS is_large FROM gappy)
SELECT case_id, count(*) OVER (PARTITION BY priority) AS priority,
       count(*) OVER (PARTITION BY is_large) AS is_large FROM filled""",
)
def freq_encode(spark, sf_dir):
    df = gappy_orders(spark, sf_dir)
    model = impute.Imputer().fit(df.select("case_id", "priority", "is_large"))
    return model.transform(df).select("case_id", "priority", "is_large")


@query(
    "freq_window",
    "SELECT p_partkey, count(*) OVER (PARTITION BY p_name) AS p_name, count(*) OVER (PARTITION BY p_brand) AS p_brand, "
    "count(*) OVER (PARTITION BY p_type) AS p_type FROM part",
)
def freq_window(spark, sf_dir):
    parts = t.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return impute.frequency_encode(parts, ["p_name", "p_brand", "p_type"], "p_partkey")


LONG_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"]


@query(
    "freq_shuffled",
    "WITH texts AS (SELECT l_orderkey AS case_id, l_linenumber, CAST(l_orderkey AS VARCHAR) AS l_orderkey, "
    "CASE WHEN l_partkey % 3 = 0 THEN 'MISSING' ELSE CAST(l_partkey AS VARCHAR) END AS l_partkey, "
    "CAST(l_suppkey AS VARCHAR) AS l_suppkey, CAST(l_shipdate AS VARCHAR) AS l_shipdate, l_returnflag FROM lineitem) "
    "SELECT case_id, l_linenumber, "
    + ", ".join(f"count(*) OVER (PARTITION BY {c}) AS {c}" for c in [*LONG_KEYS, "l_returnflag"])
    + " FROM texts",
)
def freq_shuffled(spark, sf_dir):
    """Nothing may be broadcast here: four columns go through one long-form join, one has a hot value."""
    lines = t.read(spark, sf_dir, "lineitem")
    texts = lines.select(
        F.col("l_orderkey").alias("case_id"),
        "l_linenumber",
        *[F.col(c).cast("string").alias(c) for c in LONG_KEYS if c != "l_partkey"],
        F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey").cast("string")).alias("l_partkey"),
        "l_returnflag",
    )
    return impute.frequency_encode(texts, [*LONG_KEYS, "l_returnflag"], "case_id", broadcast_bytes=0)


@query(
    "feature_cols",
    f"""WITH {GAPPY} SELECT 'price' AS col, count(price) AS n FROM gappy
UNION ALL SELECT 'week', count(week) FROM gappy""",
)
def feature_cols(spark, sf_dir):
    df = gappy_orders(spark, sf_dir)
    features = feature_columns(df)
    return df.agg(*[F.count(c).alias(c) for c in features]).unpivot([], features, "col", "n")


@query(
    "prepare_features",
    f"""WITH {GAPPY} SELECT case_id,
CASE WHEN price IS NULL OR isnan(price) THEN 0.0::FLOAT ELSE CAST(price AS FLOAT) END AS price,
CAST(coalesce(week, 0) AS FLOAT) AS week FROM gappy""",
)
def prepare(spark, sf_dir):
    df = gappy_orders(spark, sf_dir).select("case_id", "price", "week")
    return prepare_features(df, feature_columns(df))


@query(
    "low_variance",
    """WITH v AS (
  SELECT 'l_quantity' AS col, var_samp(l_quantity) AS variance FROM lineitem UNION ALL
  SELECT 'l_discount', var_samp(l_discount) FROM lineitem UNION ALL
  SELECT 'l_tax', var_samp(l_tax) FROM lineitem UNION ALL
  SELECT 'tax_share', var_samp(l_tax / 10.0::DOUBLE) FROM lineitem)
SELECT col, round(variance, 8) AS variance, variance >= 1e-4 AS kept FROM v""",
)
def low_variance(spark, sf_dir):
    lines = t.read(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", (F.col("l_tax") / 10.0).alias("tax_share")
    )
    found = variances(lines, lines.columns).withColumn("kept", F.col("variance") >= 1e-4)
    return rounded(found, ["variance"], 8)


@query(
    "chrono_split",
    f"""WITH {t.SCORED} SELECT case_id, WEEK_NUM,
CASE WHEN WEEK_NUM <= (SELECT max(WEEK_NUM) FROM scored) - 12 THEN 'train' ELSE 'val' END AS part FROM scored""",
)
def chrono_split(spark, sf_dir):
    train, val = split_by_week(t.scored_orders(spark, sf_dir).select("case_id", "WEEK_NUM"))
    return train.withColumn("part", F.lit("train")).unionAll(val.withColumn("part", F.lit("val")))


@query(
    "class_weights",
    "SELECT toxic AS target, count(*) AS n, round(1.0::DOUBLE / count(*), 8) AS weight FROM labels GROUP BY toxic",
)
def class_weights(spark, sf_dir):
    labels = t.read(spark, sf_dir, "labels")
    return rounded(inverse_class_weight(labels.withColumnRenamed("toxic", "target")), ["weight"], 8)


def measures_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS col, count({c}) AS n, round(avg({c}), 6) AS mean, round(var_samp({c}), 4) AS var FROM lineitem"
        for c in MEASURES
    )


def state_table(merged):
    var = sample_variance(F.col("n"), F.col("m2")).alias("var")
    return merged.select("col", "n", F.round("mean", 6).alias("mean"), F.round(var, 4).alias("var"))


@query("scaler_fit", measures_sql())
def scaler_fit(spark, sf_dir):
    return state_table(moments(t.read(spark, sf_dir, "lineitem"), MEASURES))


@query("scaler_merge", measures_sql())
def scaler_merge(spark, sf_dir):
    lines = t.read(spark, sf_dir, "lineitem")
    parts = moments(lines.withColumn("chunk", t.month_of(F.col("l_shipdate"))), MEASURES, by=["chunk"])
    return state_table(merge_moments(parts))


@query(
    "scale_clamp",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"round(greatest(-10.0, least(10.0, ({c} - (SELECT avg({c}) FROM lineitem)) "
        f"/ (SELECT stddev_samp({c}) FROM lineitem))), 4) AS {c}"
        for c in MEASURES
    )
    + " FROM lineitem",
)
def scale_clamp(spark, sf_dir):
    lines = t.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *MEASURES)
    return rounded(ScalerModel.fit(lines, MEASURES).transform(lines), MEASURES, 4)


def describe_sql() -> str:
    parts = []
    columns = ["l_orderkey", "l_partkey", "l_linenumber", *MEASURES, "l_returnflag", "l_shipdate"]
    for i, c in enumerate(columns):
        head = f"SELECT {i} AS pos, '{c}' AS col, count({c}) AS count, count(*) - count({c}) AS null_count, "
        if c in ("l_returnflag", "l_shipdate"):
            none = ", ".join(f"CAST(NULL AS DOUBLE) AS {s}" for s in ("mean", "std", "min", "max"))
            quarters = ", ".join(f"CAST(NULL AS DOUBLE) AS {s}" for s in ("q25", "q50", "q75"))
            texts = f"CAST(min({c}) AS VARCHAR) AS min_text, CAST(max({c}) AS VARCHAR) AS max_text"
            parts.append(f"{head}{none}, {texts}, {quarters} FROM lineitem")
            continue
        quarters = ", ".join(
            f"(SELECT CAST({c} AS DOUBLE) FROM lineitem ORDER BY {c} LIMIT 1 OFFSET "
            f"(SELECT CAST(round((count(*) - 1) * {q}) AS BIGINT) FROM lineitem)) AS q{round(q * 100)}"
            for q in (0.25, 0.5, 0.75)
        )
        parts.append(
            f"{head}round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, "
            f"CAST(max({c}) AS DOUBLE) AS max, CAST(NULL AS VARCHAR) AS min_text, CAST(NULL AS VARCHAR) AS max_text, "
            f"{quarters} FROM lineitem"
        )
    return " UNION ALL ".join(parts)


@query("describe", describe_sql())
def describe_lines(spark, sf_dir):
    lines = t.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", *MEASURES, "l_returnflag", "l_shipdate"
    )
    return rounded(describe(lines), ["mean", "std"], 4)
