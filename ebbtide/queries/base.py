"""Bases the queries run on, in Spark and as SQL text.

* orders: client = customer, one period = month, exit = first of 18 empty months, reference July 2001;
* events: client = user, one period = day, exit = first of 2 empty days, reference 29 January 2024.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import day_index, sigmoid
from ..operators import features as ft
from ..operators import labels as lb
from ..operators import panel as pn
from .registry import table

O_REF, O_GAP = 2001 * 12 + 6, 18
E_REF, E_GAP = 19751, 2
HORIZON, MIN_HIST = 3, 4


# ---------------------------------------------------------------- orders
def o_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("client"), "o_orderdate", "o_totalprice",
                                          "o_orderstatus", "o_orderpriority", "o_orderkey")
    return lb.valid_sales(o, "client", "o_orderdate", O_REF)


def o_activity(spark: SparkSession, sf: str) -> DataFrame:
    d = o_rows(spark, sf).select("client", "m", F.col("o_totalprice").alias("price"))
    return lb.activity(d, means=["price"], sums=["price"])


def o_labels(spark: SparkSession, sf: str) -> DataFrame:
    return lb.label_by_gap(o_activity(spark, sf), O_REF, O_GAP)


def o_panel(spark: SparkSession, sf: str) -> DataFrame:
    return pn.label_panel(pn.activity_grid(o_activity(spark, sf), O_REF, O_GAP), HORIZON, MIN_HIST, O_REF)


O_SQL = f"""
o_act AS (SELECT o_custkey AS client, CAST(year(o_orderdate)*12+month(o_orderdate)-1 AS INTEGER) AS m,
    count(*) AS n, avg(o_totalprice) AS price, sum(o_totalprice) AS price_sum
  FROM orders WHERE o_orderdate < DATE '2001-08-01' GROUP BY 1, 2),
o_lab AS (SELECT client, CAST(min(CASE WHEN nxt - m > {O_GAP} THEN m + 1 END) AS INTEGER) AS exit_m, min(m) AS first_m
  FROM (SELECT client, m, coalesce(lead(m) OVER (PARTITION BY client ORDER BY m), {O_REF + 1}) AS nxt FROM o_act)
  GROUP BY 1),
o_obs AS (SELECT a.* FROM o_act a JOIN o_lab l USING (client) WHERE l.exit_m IS NULL OR a.m < l.exit_m),
o_panel AS (SELECT g.client, g.m, g.cancelled, g.exit_m, CAST(g.k AS INTEGER) AS k, o.n IS NOT NULL AS has_data,
    CAST(count(o.n) OVER (PARTITION BY g.client ORDER BY g.m) AS INTEGER) AS n_hist,
    CASE WHEN g.cancelled AND g.k <= {HORIZON} THEN 1 ELSE 0 END AS y,
    NOT g.cancelled AND g.m = {O_REF} AS reference, o.n, o.price, o.price_sum
  FROM (SELECT l.client, CAST(r.m AS INTEGER) AS m, l.exit_m IS NOT NULL AS cancelled, l.exit_m,
          coalesce(l.exit_m, {O_REF + 1}) - r.m AS k
        FROM o_lab l, LATERAL (SELECT unnest(range(l.first_m, coalesce(l.exit_m, {O_REF + 1})))) r(m)) g
  LEFT JOIN o_obs o ON o.client = g.client AND o.m = g.m),
o_pan AS (SELECT *, has_data AND n_hist >= {MIN_HIST} AND (cancelled OR {O_REF} - m >= {HORIZON}) AS train,
    has_data OR reference AS scorable FROM o_panel)"""


# ---------------------------------------------------------------- events
def e_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("client"), "ts", "event_type", "value", "event_id")
    return lb.valid_sales(e, "client", "ts", E_REF, grain="day")


def e_activity(spark: SparkSession, sf: str) -> DataFrame:
    d = e_rows(spark, sf)
    buy = F.when(F.col("event_type") == "purchase", F.col("value"))
    d = d.select("client", "m", "value", buy.alias("buy"), (F.col("event_type") == "error").cast("double").alias("err"))
    return lb.activity(d, means=["value", "buy", "err"], sums=["value"])


def e_labels(spark: SparkSession, sf: str) -> DataFrame:
    return lb.label_by_gap(e_activity(spark, sf), E_REF, E_GAP)


def e_panel(spark: SparkSession, sf: str) -> DataFrame:
    return pn.label_panel(pn.activity_grid(e_activity(spark, sf), E_REF, E_GAP), HORIZON, MIN_HIST, E_REF)


def e_features(spark: SparkSession, sf: str) -> DataFrame:
    return ft.dense_features(e_panel(spark, sf), ["value", "err", "n"])


def risk_formula() -> object:
    """A fixed logistic score, so that metrics and queue can be checked without a fitted model."""
    z = (F.lit(-1.2) - 0.35 * F.coalesce(F.col("n__change"), F.lit(0.0))
         + 0.02 * F.coalesce(F.col("value__change"), F.lit(0.0)) + 0.8 * F.coalesce(F.col("err__level"), F.lit(0.0)))
    return F.when(F.col("scorable"), F.round(sigmoid(z), 4))


def e_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Panel with the risk ``p`` and the client's value: mean daily spend before the exit."""
    d = e_features(spark, sf).withColumn("p", risk_formula())
    spend = F.round(F.avg("value_sum").over(ft.W.partitionBy("client")), 2)
    return d.withColumn("amount", F.when(F.pmod("client", F.lit(13)) != 0, spend))


E_SQL = f"""
e_act AS (SELECT user_id AS client, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS m,
    count(*) AS n, avg(value) AS value, avg(CASE WHEN event_type = 'purchase' THEN value END) AS buy,
    avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS err, sum(value) AS value_sum
  FROM events WHERE ts < TIMESTAMP '2024-01-30' GROUP BY 1, 2),
e_lab AS (SELECT client, CAST(min(CASE WHEN nxt - m > {E_GAP} THEN m + 1 END) AS INTEGER) AS exit_m, min(m) AS first_m
  FROM (SELECT client, m, coalesce(lead(m) OVER (PARTITION BY client ORDER BY m), {E_REF + 1}) AS nxt FROM e_act)
  GROUP BY 1),
e_obs AS (SELECT a.* FROM e_act a JOIN e_lab l USING (client) WHERE l.exit_m IS NULL OR a.m < l.exit_m),
e_panel AS (SELECT g.client, g.m, g.cancelled, g.exit_m, CAST(g.k AS INTEGER) AS k, o.n IS NOT NULL AS has_data,
    CAST(count(o.n) OVER (PARTITION BY g.client ORDER BY g.m) AS INTEGER) AS n_hist,
    CASE WHEN g.cancelled AND g.k <= {HORIZON} THEN 1 ELSE 0 END AS y,
    NOT g.cancelled AND g.m = {E_REF} AS reference, o.n, o.value, o.buy, o.err, o.value_sum
  FROM (SELECT l.client, CAST(r.m AS INTEGER) AS m, l.exit_m IS NOT NULL AS cancelled, l.exit_m,
          coalesce(l.exit_m, {E_REF + 1}) - r.m AS k
        FROM e_lab l, LATERAL (SELECT unnest(range(l.first_m, coalesce(l.exit_m, {E_REF + 1})))) r(m)) g
  LEFT JOIN e_obs o ON o.client = g.client AND o.m = g.m),
e_pan AS (SELECT *, has_data AND n_hist >= {MIN_HIST} AND (cancelled OR {E_REF} - m >= {HORIZON}) AS train,
    has_data OR reference AS scorable FROM e_panel)"""


def _dense_sql(c: str) -> str:
    return f"""avg({c}) OVER recent AS {c}__level, avg({c}) OVER earlier AS {c}__change_ref,
      avg({c}) OVER recent - avg({c}) OVER earlier AS {c}__change,
      CASE WHEN count({c}) OVER six >= 3 THEN regr_slope({c}, m) OVER six END AS {c}__trend,
      last_value({c} IGNORE NULLS) OVER upto AS {c}__last"""


WINDOWS_SQL = """WINDOW recent AS (PARTITION BY client ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW),
    earlier AS (PARTITION BY client ORDER BY m RANGE BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING),
    six AS (PARTITION BY client ORDER BY m RANGE BETWEEN 5 PRECEDING AND CURRENT ROW),
    upto AS (PARTITION BY client ORDER BY m RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

E_FEAT_SQL = E_SQL + f""",
e_feat AS (SELECT *, {_dense_sql('value')}, {_dense_sql('err')}, {_dense_sql('n')} FROM e_pan {WINDOWS_SQL}),
e_risk AS (SELECT *, CASE WHEN scorable THEN round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(-1.2::DOUBLE
      - 0.35::DOUBLE * coalesce(n__change, 0) + 0.02::DOUBLE * coalesce(value__change, 0)
      + 0.8::DOUBLE * coalesce(err__level, 0)))), 4) END AS p,
    CASE WHEN client % 13 <> 0 THEN round(avg(value_sum) OVER (PARTITION BY client), 2) END AS amount FROM e_feat)"""

dense_sql = _dense_sql
