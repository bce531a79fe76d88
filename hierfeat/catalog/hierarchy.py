"""Rollups and joins of the hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from hierfeat.catalog import tables as t
from hierfeat.catalog.registry import query, rounded
from hierfeat.operators.assemble import add_joined_flag, attach_children, fill_joined_flags, join_to_base
from hierfeat.operators.rollup import rollup_categories, rollup_children, rollup_history, rollup_numeric
from hierfeat.plans.feature_build import assemble_matrix

LAST_LINE = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY case_id, num_group1
           ORDER BY num_group2 DESC, returned DESC, linestatus DESC, shipped DESC) AS rn
  FROM lines),
rolled AS (
  SELECT case_id, num_group1, max(quantity) AS quantity, max(amount) AS amount,
         max(CASE WHEN rn = 1 THEN returned END) AS returned,
         max(CASE WHEN rn = 1 THEN linestatus END) AS linestatus,
         max(CASE WHEN rn = 1 THEN shipped END) AS shipped
  FROM ranked GROUP BY case_id, num_group1)"""


def number_sql(column: str) -> str:
    return (
        f"max({column}) AS {column}_max, min({column}) AS {column}_min, "
        f"avg({column}) AS {column}_mean, round(stddev_samp({column}), 2) AS {column}_std"
    )


def nearest_iqr_sql(name: str, source: str, column: str, key: str = "case_id") -> str:
    """CTE with the nearest-rank interquartile range of a column."""
    return f"""{name} AS (
  SELECT {key}, max(CASE WHEN rn = round((n - 1) * 0.75) + 1 THEN v END)
              - max(CASE WHEN rn = round((n - 1) * 0.25) + 1 THEN v END) AS {column}_iqr
  FROM (SELECT {key}, v, row_number() OVER (PARTITION BY {key} ORDER BY v) AS rn,
               count(*) OVER (PARTITION BY {key}) AS n
        FROM (SELECT {key}, CAST({column} AS DOUBLE) AS v FROM {source} WHERE {column} IS NOT NULL))
  GROUP BY {key})"""


def category_sql(name: str, source: str, column: str, order: str, key: str = "case_id") -> str:
    """CTE with the seven statistics of a category column."""
    return f"""{name} AS (
  SELECT a.{key},
         a.last AS {column}_last, a.first AS {column}_first, m.mode AS {column}_mode,
         coalesce(m.n, 0) AS {column}_mode_count,
         coalesce(l.n, 0) AS {column}_last_count,
         coalesce(f.n, 0) AS {column}_first_count,
         coalesce(m.modes, 0) AS {column}_n_modes
  FROM (SELECT {key}, max(CASE WHEN up = 1 THEN v END) AS first, max(CASE WHEN down = 1 THEN v END) AS last
        FROM (SELECT {key}, {column} AS v,
                     row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS up,
                     row_number() OVER (PARTITION BY {key} ORDER BY {order.replace(',', ' DESC,')} DESC) AS down
              FROM {source})
        GROUP BY {key}) a
  LEFT JOIN (SELECT {key}, {column} AS v, count(*) AS n FROM {source} GROUP BY ALL) l
    ON l.{key} = a.{key} AND l.v = a.last
  LEFT JOIN (SELECT {key}, {column} AS v, count(*) AS n FROM {source} GROUP BY ALL) f
    ON f.{key} = a.{key} AND f.v = a.first
  LEFT JOIN (SELECT {key}, max(v) AS mode, max(n) AS n, count(*) AS modes
             FROM (SELECT {key}, {column} AS v, count(*) AS n,
                          max(count(*)) OVER (PARTITION BY {key}) AS top
                   FROM {source} WHERE {column} IS NOT NULL GROUP BY {key}, {column})
             WHERE n = top GROUP BY {key}) m
    ON m.{key} = a.{key})"""


def categories(column: str) -> str:
    stats = ("last", "first", "mode", "mode_count", "last_count", "first_count", "n_modes")
    return ", ".join(f"{column}_{s}" for s in stats)


@query("depth2_rollup", f"WITH {t.LINES}, {LAST_LINE} SELECT * FROM rolled")
def depth2_rollup(spark, sf_dir):
    return rollup_children(t.lines(spark, sf_dir))


@query(
    "depth1_numeric",
    f"WITH {t.ORDERS} SELECT case_id, {number_sql('price')}, {number_sql('week')} FROM hist GROUP BY case_id",
)
def depth1_numeric(spark, sf_dir):
    rolled = rollup_numeric(t.orders(spark, sf_dir), ["case_id"], ["price", "week"], iqr=None)
    return rounded(rolled, ["price_std", "week_std"], 2)


@query(
    "depth1_categorical",
    f"WITH {t.ORDERS}, {category_sql('s', 'hist', 'status', 'num_group1')}, "
    f"{category_sql('p', 'hist', 'priority', 'num_group1')}, {category_sql('d', 'hist', 'placed', 'num_group1')} "
    f"SELECT case_id, {categories('status')}, {categories('priority')}, {categories('placed')} "
    "FROM s JOIN p USING (case_id) JOIN d USING (case_id)",
)
def depth1_categorical(spark, sf_dir):
    return rollup_categories(t.orders(spark, sf_dir), ["case_id"], ["status", "priority", "placed"], ["num_group1"])


@query(
    "iqr_nearest",
    f"WITH {t.ORDERS}, {nearest_iqr_sql('i', 'hist', 'price')} "
    "SELECT c.case_id, price_iqr FROM (SELECT DISTINCT case_id FROM hist) c LEFT JOIN i USING (case_id)",
)
def iqr_nearest(spark, sf_dir):
    rolled = rollup_numeric(t.orders(spark, sf_dir), ["case_id"], ["price"], iqr="nearest")
    return rolled.select("case_id", "price_iqr")


@query(
    "iqr_linear",
    f"WITH {t.ORDERS} SELECT case_id, "
    "quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS price_iqr FROM hist GROUP BY case_id",
)
def iqr_linear(spark, sf_dir):
    rolled = rollup_numeric(t.orders(spark, sf_dir), ["case_id"], ["price"], iqr="linear")
    return rolled.select("case_id", "price_iqr")


@query(
    "joined_flags",
    f"""WITH {t.CUSTOMERS}, {t.ORDERS}, {t.LINES}
SELECT case_id, CAST(CASE WHEN o.case_id IS NULL THEN 0 ELSE 1 END AS TINYINT) AS orders_joined_flag,
       CAST(CASE WHEN l.case_id IS NULL THEN 0 ELSE 1 END AS TINYINT) AS lines_joined_flag
FROM customers LEFT JOIN (SELECT DISTINCT case_id FROM hist) o USING (case_id)
LEFT JOIN (SELECT DISTINCT case_id FROM lines) l USING (case_id)""",
)
def joined_flags(spark, sf_dir):
    keys = ["case_id", "num_group1"]
    lines = rollup_children(add_joined_flag(t.lines(spark, sf_dir).select(*keys, "num_group2"), "train_lines"))
    history = attach_children(add_joined_flag(t.orders(spark, sf_dir).select(*keys), "train_orders"), [lines])
    base = t.customers(spark, sf_dir).select("case_id")
    return fill_joined_flags(join_to_base(base, [rollup_history(history)]))


@query("key_distinct", f"WITH {t.LINES} SELECT DISTINCT case_id, num_group1 FROM lines")
def key_distinct(spark, sf_dir):
    return rollup_children(t.lines(spark, sf_dir).select("case_id", "num_group1", "num_group2"))


@query(
    "depth2_into_depth1",
    f"WITH {t.ORDERS}, {t.LINES}, {LAST_LINE} SELECT hist.*, quantity, amount, returned, linestatus, shipped "
    "FROM hist LEFT JOIN rolled USING (case_id, num_group1)",
)
def depth2_into_depth1(spark, sf_dir):
    orders = t.orders(spark, sf_dir).withColumn("price", F.when(~F.isnan("price"), F.col("price")))
    return attach_children(orders, [rollup_children(t.lines(spark, sf_dir))])


NUMBERS = ("price", "week", "quantity", "amount")
TEXTS = ("status", "priority", "placed", "returned", "linestatus", "shipped")


def matrix_sql() -> str:
    """The whole feature matrix: one CTE per column kind, all joined on the base."""
    ctes = [t.CUSTOMERS, t.ORDERS, t.LINES, t.PLACES, LAST_LINE]
    ctes.append(
        "wide AS (SELECT hist.*, quantity, amount, returned, linestatus, shipped, "
        "CASE WHEN rolled.case_id IS NULL THEN 0 ELSE 1 END AS lines_flag "
        "FROM hist LEFT JOIN rolled USING (case_id, num_group1))"
    )
    ctes.append(
        "nums AS (SELECT case_id, 1 AS orders_flag, max(lines_flag) AS lines_flag, "
        + ", ".join(number_sql(c) for c in NUMBERS)
        + " FROM wide GROUP BY case_id)"
    )
    ctes += [nearest_iqr_sql(f"iqr_{c}", "wide", c) for c in NUMBERS]
    ctes += [category_sql(f"cat_{c}", "wide", c, "num_group1") for c in TEXTS]
    picks = ["c.case_id", "target", "balance", "segment", "nation", "region"]
    picks += [
        "CAST(coalesce(orders_flag, 0) AS TINYINT) AS orders_joined_flag",
        "CAST(coalesce(lines_flag, 0) AS TINYINT) AS lines_joined_flag",
        "CAST(CASE WHEN places.case_id IS NULL THEN 0 ELSE 1 END AS TINYINT) AS places_joined_flag",
    ]
    picks += [f"{c}_{s}" for c in NUMBERS for s in ("max", "min", "mean", "std", "iqr")]
    picks += [categories(c) for c in TEXTS]
    joins = ["nums", *[f"iqr_{c}" for c in NUMBERS], *[f"cat_{c}" for c in TEXTS], "places"]
    return (
        f"WITH {', '.join(ctes)} SELECT {', '.join(picks)} FROM customers c "
        + " ".join(f"LEFT JOIN {j} ON {j}.case_id = c.case_id" for j in joins)
    )


@query("feature_matrix", matrix_sql())
def feature_matrix(spark, sf_dir):
    matrix = assemble_matrix(t.reader(spark, sf_dir), t.SPEC)
    return rounded(matrix, [f"{c}_std" for c in NUMBERS], 2)


@query(
    "events_rollup",
    f"""WITH ev AS (
  SELECT user_id AS case_id, ts, event_id, round(value * 100) AS value, event_type AS kind FROM events),
{category_sql('k', 'ev', 'kind', 'ts, event_id')}, {nearest_iqr_sql('i', 'ev', 'value')}
SELECT case_id, {number_sql('value')}, any_value(value_iqr) AS value_iqr, any_value(kind_last) AS kind_last,
       any_value(kind_first) AS kind_first, any_value(kind_mode) AS kind_mode,
       any_value(kind_mode_count) AS kind_mode_count, any_value(kind_last_count) AS kind_last_count,
       any_value(kind_first_count) AS kind_first_count, any_value(kind_n_modes) AS kind_n_modes
FROM ev JOIN k USING (case_id) LEFT JOIN i USING (case_id) GROUP BY case_id""",
)
def events_rollup(spark, sf_dir):
    events = t.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("case_id"), "ts", "event_id", t.cents("value").alias("value"),
        F.col("event_type").alias("kind"),
    )
    numbers = rollup_numeric(events, ["case_id"], ["value"])
    kinds = rollup_categories(events, ["case_id"], ["kind"], ["ts", "event_id"])
    return rounded(numbers.join(kinds, "case_id"), ["value_std"], 2)
