"""The given tables in the shape of the data model, in Spark and as SQL.

The tables hold no missing values, so fixed rules on the row id blank some out. Money is
in whole cents, so sums do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hierfeat.spec import HierarchySpec, TableSpec

SPEC = HierarchySpec(
    base="customers",
    tables=(
        TableSpec("orders", 1, order=("num_group1",)),
        TableSpec("lines", 2, parent="orders", order=("num_group2",)),
        TableSpec("places", 0),
    ),
)
EPOCH = "1995-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def week_of(date: Column) -> Column:
    return F.floor(F.date_diff(date.cast("date"), F.lit(EPOCH).cast("date")) / 7).cast("int")


def month_of(date: Column) -> Column:
    return (F.year(date) * 100 + F.month(date)).cast("int")


def blank(col: Column, key: str, every: int, value: object = None) -> Column:
    return F.when(F.col(key) % every == 0, F.lit(value)).otherwise(col)


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("case_id"),
        (F.col("c_acctbal") < 0).cast("int").alias("target"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )


CUSTOMERS = """customers AS (
  SELECT c_custkey AS case_id, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS target,
         c_acctbal AS balance, c_mktsegment AS segment
  FROM customer)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order history of customers: numbers with nulls and NaN, texts with nulls, a date."""
    price = blank(cents("o_totalprice"), "o_orderkey", 11, float("nan"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("case_id"),
        F.col("o_orderkey").alias("num_group1"),
        blank(price, "o_orderkey", 5).alias("price"),
        week_of(F.col("o_orderdate")).alias("week"),
        F.col("o_orderstatus").alias("status"),
        blank(F.col("o_orderpriority"), "o_orderkey", 7).alias("priority"),
        F.col("o_orderdate").alias("placed"),
    )


ORDERS = """hist AS (
  SELECT o_custkey AS case_id, o_orderkey AS num_group1,
         CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE round(o_totalprice * 100) END AS price,
         CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // 7 AS INTEGER) AS week,
         o_orderstatus AS status,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority,
         o_orderdate AS placed
  FROM orders)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the customer they belong to."""
    owner = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("case_id"))
    items = read(spark, sf_dir, "lineitem")
    return items.join(owner, items.l_orderkey == owner.o_orderkey).select(
        "case_id",
        F.col("l_orderkey").alias("num_group1"),
        F.col("l_linenumber").alias("num_group2"),
        F.col("l_quantity").alias("quantity"),
        blank(cents("l_extendedprice"), "l_partkey", 6).alias("amount"),
        F.col("l_returnflag").alias("returned"),
        F.col("l_linestatus").alias("linestatus"),
        F.col("l_shipdate").alias("shipped"),
    )


LINES = """lines AS (
  SELECT o_custkey AS case_id, l_orderkey AS num_group1, l_linenumber AS num_group2,
         l_quantity AS quantity,
         CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE round(l_extendedprice * 100) END AS amount,
         l_returnflag AS returned, l_linestatus AS linestatus, l_shipdate AS shipped
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth 0: nation and region of every customer."""
    nation = read(spark, sf_dir, "nation").join(
        read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        read(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("case_id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    )


PLACES = """places AS (
  SELECT c_custkey AS case_id, n_name AS nation, r_name AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

READERS = {"customers": customers, "orders": orders, "lines": lines, "places": places}


def reader(spark: SparkSession, sf_dir: str):
    return lambda name: READERS[name](spark, sf_dir)


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with time axis, class, a coarse score (so there are ties) and an energy.

    The energy is whole cents over a power of two, so its sums are exact.
    """
    price = F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        week_of(F.col("o_orderdate")).alias("WEEK_NUM"),
        month_of(F.col("o_orderdate")).alias("MONTH"),
        (F.col("o_orderstatus") == "F").cast("int").alias("target"),
        (F.floor(price / 600.0) / 1000.0).alias("score"),
        (-cents("o_totalprice") / 1048576.0).alias("energy"),
        F.col("o_orderstatus").alias("status"),
    )


SCORED = """scored AS (
  SELECT o_orderkey AS case_id,
         CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // 7 AS INTEGER) AS WEEK_NUM,
         CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS MONTH,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target,
         floor(o_totalprice / 600.0::DOUBLE) / 1000.0::DOUBLE AS score,
         -round(o_totalprice * 100) / 1048576.0::DOUBLE AS energy,
         o_orderstatus AS status
  FROM orders)"""


def latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored latent vectors with a class and a week."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("case_id"),
        F.col("embedding").alias("z"),
        (F.col("label") >= 5).cast("int").alias("target"),
        F.col("label").alias("WEEK_NUM"),
    )


LATENTS = """latents AS (
  SELECT vec_id AS case_id, CAST(embedding AS DOUBLE[]) AS z,
         CASE WHEN label >= 5 THEN 1 ELSE 0 END AS target, label AS WEEK_NUM
  FROM embeddings)"""
