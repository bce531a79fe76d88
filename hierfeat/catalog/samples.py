"""Samples, orders, chunks and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from hierfeat.catalog import tables as t
from hierfeat.catalog.registry import query, rounded
from hierfeat.operators import ordering
from hierfeat.operators.assemble import restrict
from hierfeat.operators.prepare import chunk_class_weights
from hierfeat.operators.sampling import balanced_resample, stratified_sample
from hierfeat.sources.shards import declared_types, scan_table, union_tables

RATIO = 0.3
SAMPLE = f"""sample AS (
  SELECT case_id FROM (
    SELECT case_id, row_number() OVER (PARTITION BY target ORDER BY md5('42|' || case_id), case_id) AS rn,
           count(*) OVER (PARTITION BY target) AS n
    FROM customers WHERE target IN (0, 1))
  WHERE rn <= floor(n * CAST({RATIO} AS DOUBLE)))"""


def sampled_ids(spark, sf_dir):
    return stratified_sample(t.customers(spark, sf_dir), RATIO)


@query("stratified_sample", f"WITH {t.CUSTOMERS}, {SAMPLE} SELECT case_id FROM sample")
def stratified(spark, sf_dir):
    return sampled_ids(spark, sf_dir)


@query(
    "bernoulli_sample",
    f"WITH {t.CUSTOMERS} SELECT case_id FROM customers WHERE target IN (0, 1) "
    f"AND substr(md5('42|' || case_id), 1, 8) < '{int(RATIO * 2**32):08x}'",
)
def bernoulli(spark, sf_dir):
    return stratified_sample(t.customers(spark, sf_dir), RATIO, exact=False)


@query("sampled_base", f"WITH {t.CUSTOMERS}, {SAMPLE} SELECT * FROM customers SEMI JOIN sample USING (case_id)")
def sampled_base(spark, sf_dir):
    return restrict(t.customers(spark, sf_dir), sampled_ids(spark, sf_dir))


@query(
    "sampled_depth1",
    f"WITH {t.CUSTOMERS}, {t.ORDERS}, {SAMPLE} SELECT case_id, num_group1, week, status, priority "
    "FROM hist SEMI JOIN sample USING (case_id)",
)
def sampled_depth1(spark, sf_dir):
    rows = t.orders(spark, sf_dir).select("case_id", "num_group1", "week", "status", "priority")
    return restrict(rows, sampled_ids(spark, sf_dir))


@query("sampled_depth2", f"WITH {t.CUSTOMERS}, {t.LINES}, {SAMPLE} SELECT * FROM lines SEMI JOIN sample USING (case_id)")
def sampled_depth2(spark, sf_dir):
    return restrict(t.lines(spark, sf_dir), sampled_ids(spark, sf_dir))


def order_rows(spark, sf_dir):
    return t.scored_orders(spark, sf_dir).select("case_id", "target", "WEEK_NUM")


@query(
    "epoch_shuffle",
    f"WITH {t.SCORED} SELECT case_id, target, WEEK_NUM, "
    "row_number() OVER (ORDER BY md5('45|' || case_id), case_id) - 1 AS position FROM scored",
)
def epoch_shuffle(spark, sf_dir):
    return ordering.epoch_position(order_rows(spark, sf_dir), seed=42, epoch=3)


CHUNK_ROWS = 4000
CHUNKED = f"""chunked AS (
  SELECT *, (row_number() OVER (ORDER BY case_id) - 1) // {CHUNK_ROWS} + 1 AS chunk FROM scored)"""


def chunked_orders(spark, sf_dir):
    return ordering.assign_chunks(order_rows(spark, sf_dir), CHUNK_ROWS)


@query(
    "chunk_windows",
    f"""WITH {t.SCORED}, {CHUNKED}, windowed AS (
  SELECT case_id, chunk, CAST('0x' || substr(md5('45|' || chunk), 1, 8) AS BIGINT)
         % (SELECT CAST(ceil(max(chunk) / 3.0) AS BIGINT) FROM chunked) AS window_no FROM chunked)
SELECT case_id, chunk, window_no AS "window",
       row_number() OVER (ORDER BY window_no, md5('45|' || case_id), case_id) - 1 AS position FROM windowed""",
)
def chunk_windows(spark, sf_dir):
    chunked = chunked_orders(spark, sf_dir).select("case_id", "chunk")
    return ordering.chunk_window_position(chunked, size=3, seed=42, epoch=3)


@query(
    "chunk_sizes",
    f"WITH {t.SCORED}, {CHUNKED} SELECT chunk, count(*) AS n, min(case_id) AS first_id, max(case_id) AS last_id "
    "FROM chunked GROUP BY chunk",
)
def chunk_sizes(spark, sf_dir):
    return (
        chunked_orders(spark, sf_dir)
        .groupBy("chunk")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("case_id").alias("first_id"), F.max("case_id").alias("last_id")
        )
    )


@query(
    "worker_split",
    f"""WITH {t.SCORED}, {CHUNKED}
SELECT CAST((chunk - 1) // (SELECT CAST(ceil(max(chunk) / 3.0) AS BIGINT) FROM chunked) AS BIGINT) AS worker,
       count(*) AS n, min(chunk) AS first_chunk, max(chunk) AS last_chunk
FROM chunked GROUP BY 1""",
)
def worker_split(spark, sf_dir):
    return (
        ordering.assign_workers(chunked_orders(spark, sf_dir), 3)
        .groupBy("worker")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("chunk").alias("first_chunk"),
            F.max("chunk").alias("last_chunk"),
        )
    )


@query(
    "chunk_holdout",
    f"""WITH {t.SCORED}, {CHUNKED}
SELECT case_id, chunk, CASE WHEN chunk = (SELECT max(chunk) FROM chunked) THEN 'val' ELSE 'train' END AS part
FROM chunked WHERE (SELECT min(chunk) <> max(chunk) FROM chunked)
UNION ALL
SELECT case_id, chunk, part FROM chunked, (VALUES ('train'), ('val')) parts(part)
WHERE (SELECT min(chunk) = max(chunk) FROM chunked)""",
)
def chunk_holdout(spark, sf_dir):
    train, val = ordering.hold_out_last_chunk(chunked_orders(spark, sf_dir))
    kept = ("case_id", "chunk")
    return train.select(*kept, F.lit("train").alias("part")).unionAll(val.select(*kept, F.lit("val").alias("part")))


@query(
    "batch_assign",
    f"""WITH {t.SCORED}, numbered AS (
  SELECT case_id, (row_number() OVER (ORDER BY case_id) - 1) // 512 AS batch FROM scored)
SELECT * FROM numbered WHERE batch < (SELECT count(*) // 512 FROM scored)""",
)
def batch_assign(spark, sf_dir):
    return ordering.assign_batches(order_rows(spark, sf_dir).select("case_id"), 512, drop_last=True)


@query(
    "head_tail",
    """SELECT 'head' AS part, * FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100)
UNION ALL
SELECT 'tail', * FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 100)""",
)
def head_tail(spark, sf_dir):
    rows = t.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    first = ordering.head(rows, ["o_orderkey"]).select(F.lit("head").alias("part"), "*")
    return first.unionAll(ordering.tail(rows, ["o_orderkey"]).select(F.lit("tail"), "*"))


@query(
    "balanced_resample",
    f"""WITH {t.CUSTOMERS}, numbered AS (
  SELECT case_id, target, row_number() OVER (PARTITION BY target ORDER BY md5('42|' || case_id), case_id) - 1 AS idx,
         count(*) OVER (PARTITION BY target) AS n FROM customers),
draws AS (
  SELECT i AS draw, md5('42|draw|' || i) AS h FROM range((SELECT count(*) FROM customers)) r(i)),
picked AS (
  SELECT draw, CAST(('0x' || substr(h, 1, 8))::BIGINT % 2 AS INTEGER) AS target,
         ('0x' || substr(h, 9, 12))::BIGINT AS u FROM draws)
SELECT draw, case_id, p.target FROM picked p JOIN numbered m ON m.target = p.target AND p.u % m.n = m.idx""",
)
def resample(spark, sf_dir):
    return balanced_resample(t.customers(spark, sf_dir), "case_id")


@query(
    "class_weights_chunk",
    f"""WITH {t.SCORED}, {CHUNKED}, sizes AS (
  SELECT chunk, count(*) AS total, sum(target) AS ones FROM chunked GROUP BY chunk)
SELECT chunk, 0 AS target, CAST(total - ones AS BIGINT) AS n,
       round(total / (2.0 * greatest(total - ones, 1)), 6) AS weight FROM sizes
UNION ALL
SELECT chunk, 1, CAST(ones AS BIGINT), round(total / (2.0 * greatest(ones, 1)), 6) FROM sizes""",
)
def class_weights_chunk(spark, sf_dir):
    return rounded(chunk_class_weights(chunked_orders(spark, sf_dir)), ["weight"])


@query(
    "scan_table",
    "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY l_returnflag",
)
def scan(spark, sf_dir):
    lines = scan_table(spark, "lineitem", sf_dir)
    return lines.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("amount")
    )


@query(
    "shard_union",
    """SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, c_acctbal AS balance_A, CAST(NULL AS VARCHAR) AS closed_D
FROM customer UNION ALL
SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier UNION ALL
SELECT n_nationkey, n_name, NULL, NULL FROM nation UNION ALL
SELECT r_regionkey, r_name, CAST(r_regionkey AS DOUBLE), NULL FROM region""",
)
def shard_union(spark, sf_dir):
    """Four tables as drifted shards of one: bigint and int ids, a double, untyped and int balance."""

    def shard(name, key, label, balance):
        return t.read(spark, sf_dir, name).select(
            F.col(key).alias("id"),
            F.col(label).alias("name"),
            balance.alias("balance_A"),
            F.lit(None).alias("closed_D"),
        )

    shards = [
        shard("customer", "c_custkey", "c_name", F.col("c_acctbal")),
        shard("supplier", "s_suppkey", "s_name", F.col("s_acctbal")),
        shard("nation", "n_nationkey", "n_name", F.lit(None)),
        shard("region", "r_regionkey", "r_name", F.col("r_regionkey")),
    ]
    return union_tables([(s, declared_types(s)) for s in shards])


@query(
    "latent_scan",
    f"WITH {t.LATENTS} SELECT case_id, target, WEEK_NUM, CAST(len(z) AS INTEGER) AS width, "
    "round(list_sum(z), 4) AS total FROM latents",
)
def latent_scan(spark, sf_dir):
    rows = t.latents(spark, sf_dir)
    total = F.aggregate("z", F.lit(0.0), lambda acc, x: acc + x)
    return rows.select("case_id", "target", "WEEK_NUM", F.size("z").alias("width"), F.round(total, 4).alias("total"))
