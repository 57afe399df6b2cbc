"""Queries: labels, panel and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as col
from ..operators import features as ft
from ..operators import labels as lb
from ..operators import panel as pn
from ..operators import stats as st
from .base import (E_FEAT_SQL, E_GAP, E_REF, E_SQL, O_GAP, O_REF, O_SQL, WINDOWS_SQL, dense_sql, e_activity,
                   e_features, e_labels, e_panel, e_rows, e_scored, o_activity, o_labels, o_panel, o_rows)
from .registry import query, table
from .rounding import r6, r6s, rd, rs


# ---------------------------------------------------------------- labels
@query("labels_valid_sales", """SELECT o_custkey AS client, count(*) AS sales, max(o_orderdate) < DATE '2001-08-01' AS complete
  FROM orders WHERE o_orderdate < DATE '2001-08-01' AND o_orderstatus <> 'P' GROUP BY 1""")
def valid_sales(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "client")
    d = lb.valid_sales(o, "client", "o_orderdate", O_REF, voided=F.col("o_orderstatus") == "P")
    return d.groupBy("client").agg(F.count(F.lit(1)).alias("sales"),
                                   (F.max("o_orderdate") < F.lit("2001-08-01").cast("date")).alias("complete"))


@query("labels_complete_sources", """WITH s AS (SELECT n.n_nationkey % 7 AS source, o.o_orderkey,
    CAST(year(o_orderdate)*12+month(o_orderdate)-1 AS INTEGER) AS m FROM orders o
    JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey
    WHERE NOT (n.n_nationkey % 7 IN (2, 5) AND o_orderdate >= DATE '2001-03-01'))
  SELECT source, count(*) AS n, max(m) AS end_m FROM s
  WHERE source IN (SELECT source FROM s GROUP BY 1 HAVING max(m) >= 24018) GROUP BY 1""")
def complete_sources(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.pmod("c_nationkey", F.lit(7)).alias("source"))
    o = table(spark, sf, "orders").withColumn("m", col.month_index(F.col("o_orderdate")))
    d = o.join(c, o.o_custkey == c.c_custkey).filter(
        ~(F.col("source").isin(2, 5) & (F.col("o_orderdate") >= F.lit("2001-03-01").cast("date"))))
    kept = lb.complete_sources(d, "source", O_REF)
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("end_m"))


@query("labels_gap_orders", f"""WITH {O_SQL} SELECT client, exit_m IS NOT NULL AS cancelled, exit_m, first_m,
  CASE WHEN exit_m IS NOT NULL THEN 'Cancelado' ELSE 'Ativo' END AS status FROM o_lab""")
def gap_orders(spark, sf):
    return o_labels(spark, sf).withColumn("status", lb.status_text(F.col("cancelled")))


@query("labels_gap_one_month", """WITH a AS (SELECT DISTINCT o_custkey AS client,
    CAST(year(o_orderdate)*12+month(o_orderdate)-1 AS INTEGER) AS m FROM orders WHERE o_orderdate < DATE '2001-08-01'),
  f AS (SELECT client, min(m) AS first_m FROM a GROUP BY 1),
  c AS (SELECT f.client, first_m, r.m FROM f, LATERAL (SELECT unnest(range(f.first_m, 24019))) r(m))
  SELECT c.client, bool_or(a.m IS NULL) AS cancelled, CAST(min(CASE WHEN a.m IS NULL THEN c.m END) AS INTEGER) AS exit_m,
    min(first_m) AS first_m FROM c LEFT JOIN a ON a.client = c.client AND a.m = c.m GROUP BY 1""")
def gap_one(spark, sf):
    return lb.label_by_gap(o_activity(spark, sf), O_REF, 1)


@query("labels_gap_events", f"WITH {E_SQL} SELECT client, exit_m IS NOT NULL AS cancelled, exit_m, first_m FROM e_lab")
def gap_events(spark, sf):
    return e_labels(spark, sf)


@query("labels_spend_before_exit", f"""WITH {O_SQL} SELECT client, {rs('avg(price_sum)', 2)} AS mean_spend
  FROM o_obs GROUP BY 1""")
def spend(spark, sf):
    rows = o_rows(spark, sf).select("client", "m", "o_totalprice")
    d = lb.mean_spend_before_exit(rows, o_labels(spark, sf), "o_totalprice")
    return d.select("client", rd("mean_spend", 2))


@query("labels_attach_client", """SELECT o_custkey AS client, CAST(count(*) AS BIGINT) AS items, round(sum(l_quantity), 2) AS qty,
    CAST(sum(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS BIGINT) AS days
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def attach_client(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("client"), "o_orderdate")
    d = lb.attach_client(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate"), o, "l_orderkey", ["client", "o_orderdate"])
    return d.groupBy("client").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("l_quantity"), 2).alias("qty"),
                                   F.sum(lb.due_days(F.col("l_shipdate"), F.col("o_orderdate"))).alias("days"))


@query("labels_master_completion", """WITH ids AS (SELECT DISTINCT concat(CAST(o_custkey % 9 AS VARCHAR), '-', CAST(o_custkey AS VARCHAR)) AS client_id,
    o_custkey FROM orders)
  SELECT client_id, coalesce(CASE WHEN c_nationkey < 20 THEN CAST(o_custkey % 9 AS VARCHAR) END, split_part(client_id, '-', 1)) AS network,
    CASE WHEN c_nationkey < 20 THEN c_mktsegment END AS segment FROM ids LEFT JOIN customer ON c_custkey = o_custkey""")
def master(spark, sf):
    def key(c):
        return F.concat_ws("-", F.pmod(c, F.lit(9)).cast("string"), F.col(c).cast("string"))
    ids = table(spark, sf, "orders").select(key("o_custkey").alias("client_id"))
    m = (table(spark, sf, "customer").filter("c_nationkey < 20")
         .select(key("c_custkey").alias("client_id"), F.pmod("c_custkey", F.lit(9)).cast("string").alias("network"),
                 F.col("c_mktsegment").alias("segment")))
    return lb.complete_master(ids, m, "client_id", "network").select("client_id", "network", "segment")


@query("labels_bounded_tables", f"""WITH {O_SQL} SELECT 'orders' AS tab, count(*) AS n FROM orders
    WHERE o_orderdate < DATE '2001-08-01' AND o_custkey IN (SELECT client FROM o_lab)
  UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey IN (SELECT client FROM o_lab)""")
def bounded(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "client").select("client", "o_orderdate")
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "client").select("client")
    t = lb.bounded_tables({"orders": o, "customer": c}, o_labels(spark, sf), "client", {"orders": "o_orderdate"}, O_REF)
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("tab"), "n") for k, df in t.items()]
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- panel
PANEL_COLS = "client, m, cancelled, exit_m, k, has_data, n_hist, y, train, reference, scorable"


@query("panel_orders", f"WITH {O_SQL} SELECT {PANEL_COLS} FROM o_pan")
def panel_orders(spark, sf):
    return o_panel(spark, sf).select(*PANEL_COLS.split(", "))


@query("panel_events", f"WITH {E_SQL} SELECT {PANEL_COLS} FROM e_pan")
def panel_events(spark, sf):
    return e_panel(spark, sf).select(*PANEL_COLS.split(", "))


@query("panel_orders_features", f"""WITH {O_SQL}, f AS (SELECT *, {dense_sql('price')} FROM o_pan {WINDOWS_SQL})
  SELECT client, m, k, y, train, {r6s('price__level', 'price__change', 'price__last')},
    CASE WHEN price__change > 50000 THEN 'alto' WHEN price__change > 0 THEN 'atencao' ELSE 'baixo' END AS band FROM f""")
def panel_orders_features(spark, sf):
    d = ft.dense_features(o_panel(spark, sf), ["price"])
    band = F.when(F.col("price__change") > 50000, "alto").when(F.col("price__change") > 0, "atencao").otherwise("baixo")
    return d.select("client", "m", "k", "y", "train", *r6("price__level", "price__change", "price__last"), band.alias("band"))


@query("panel_summary", f"""WITH {E_SQL} SELECT CAST(count(*) AS BIGINT) AS "rows", count(*) FILTER (has_data) AS rows_with_data,
  count(*) FILTER (train) AS train_rows, CAST(sum(y) FILTER (train) AS BIGINT) AS train_positives, count(DISTINCT client) AS clients,
  count(DISTINCT client) FILTER (cancelled) AS cancelled_clients, count(DISTINCT client) FILTER (NOT cancelled) AS active_clients,
  count(*) FILTER (has_data AND NOT cancelled AND NOT train AND n_hist >= 4) AS censored_rows FROM e_pan""")
def panel_summary(spark, sf):
    return pn.panel_summary(e_panel(spark, sf), 3, 4)


@query("panel_resolve_target", """WITH t AS (SELECT o_custkey AS client, o_orderkey, lower(trim(o_orderstatus)) = 'f' AS gone,
    CAST(year(o_orderdate)*12+month(o_orderdate)-1 AS INTEGER) AS m FROM orders WHERE o_orderpriority = '1-URGENT'),
  l AS (SELECT client, arg_max(gone, o_orderkey) AS gone, arg_max(m, o_orderkey) AS m FROM t GROUP BY 1)
  SELECT c_custkey AS client, coalesce(gone, false) AS cancelled, CASE WHEN gone THEN m END AS exit_m
  FROM customer LEFT JOIN l ON client = c_custkey""")
def resolve_target(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("client"))
    t = (table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
         .select(F.col("o_custkey").alias("client"), "o_orderstatus", "o_orderkey", col.month_index(F.col("o_orderdate")).alias("m")))
    return pn.resolve_target(ids, t, status="o_orderstatus", cancelled_value=" F ", exit_m="m", order="o_orderkey")


@query("panel_contract_value", """SELECT o_custkey AS client, arg_max(o_totalprice, o_orderkey) AS contract_value
  FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def contract_value(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("client"), "o_orderkey",
                                          F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("v"))
    return pn.contract_value(o, "v", order="o_orderkey")


@query("panel_client_attributes", """SELECT DISTINCT user_id AS client, c_mktsegment AS segment, n_name AS nation, r_name AS region
  FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey""")
def attributes(spark, sf):
    ids = table(spark, sf, "events").select(F.col("user_id").alias("client")).distinct()
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    full = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("c_custkey").alias("client"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"))
    return pn.client_attributes(ids, full, ["segment", "nation", "region"])


@query("panel_client_dates", """SELECT c_custkey AS client, strftime(min(o_orderdate), '%Y-%m') AS first_order,
  strftime(max(o_orderdate), '%Y-%m') AS last_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def client_dates(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("client"))
    d = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("client")).agg(
        F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return pn.client_dates(ids, d, {"first_order": F.col("a"), "last_order": F.col("b")})


@query("panel_static_first_row", """SELECT c_custkey AS client, arg_min(o_totalprice, o_orderkey) AS first_price, arg_min(o_orderstatus, o_orderkey) AS first_status
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def static_first(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("client"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("client"), "o_orderkey", F.col("o_totalprice").alias("first_price"),
                                          F.col("o_orderstatus").alias("first_status"))
    return pn.attach_static(ids, o, ["first_price", "first_status"], order="o_orderkey")


@query("panel_event_rows", """SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
  GROUP BY 1""")
def event_rows(spark, sf):
    ids = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("client"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("client"), "event_type")
    return pn.attach_events(ids, e).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("panel_orphan_rows", """SELECT count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)""")
def orphans(spark, sf):
    ids = table(spark, sf, "events").select(F.col("user_id").alias("client")).distinct()
    return pn.orphan_rows(ids, table(spark, sf, "orders").select(F.col("o_custkey").alias("client")))


@query("panel_table_density", f"""WITH {E_SQL}, {O_SQL}, x AS (
    SELECT 'events' AS tab, client, count(*) AS months, max(m)-min(m)+1 AS span, sum(n) AS nrows FROM e_act GROUP BY 2
    UNION ALL SELECT 'orders', client, count(*), max(m)-min(m)+1, sum(n) FROM o_act GROUP BY 2)
  SELECT tab, round(sum(months)::DOUBLE/sum(span), 6) AS density, round(sum(nrows)::DOUBLE/sum(months), 6) AS rows_per_month,
    sum(months)::DOUBLE/sum(span) >= 0.6 AS dense, sum(nrows)::DOUBLE/sum(months) > 1.2 AS transactional FROM x GROUP BY 1""")
def density(spark, sf):
    out = None
    for name, rows in (("events", e_rows(spark, sf)), ("orders", o_rows(spark, sf))):
        d = pn.table_density(rows).select(F.lit(name).alias("tab"), *r6("density", "rows_per_month"), "dense", "transactional")
        out = d if out is None else out.unionByName(d)
    return out


@query("panel_presence", """SELECT client, count(*) AS months FROM (
  SELECT o_custkey AS client, CAST(year(o_orderdate)*12+month(o_orderdate)-1 AS INTEGER) AS m FROM orders
  UNION SELECT o_custkey, CAST(year(l_shipdate)*12+month(l_shipdate)-1 AS INTEGER) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""")
def presence(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("client"), col.month_index(F.col("o_orderdate")).alias("m"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), col.month_index(F.col("l_shipdate")).alias("ship"))
    li = li.join(o.select("o_orderkey", "client"), "o_orderkey").select("client", F.col("ship").alias("m"))
    return pn.presence([o.select("client", "m"), li]).groupBy("client").agg(F.count(F.lit(1)).alias("months"))


@query("panel_exit_lag", f"""WITH {E_SQL} SELECT CAST(median(exit_m - last_m) AS DOUBLE) AS exit_lag, count(*) AS n FROM e_lab
  JOIN (SELECT client, max(m) AS last_m FROM e_act GROUP BY 1) USING (client) WHERE exit_m IS NOT NULL""")
def exit_lag(spark, sf):
    return pn.exit_lag(e_labels(spark, sf), e_activity(spark, sf))


@query("panel_exit_cut", f"WITH {E_SQL} SELECT client, count(*) AS months, max(m) AS last_m FROM e_obs GROUP BY 1")
def exit_cut(spark, sf):
    act = e_activity(spark, sf)
    return pn.cut_at_exit(act, lb.label_by_gap(act, E_REF, E_GAP)).groupBy("client").agg(
        F.count(F.lit(1)).alias("months"), F.max("m").alias("last_m"))


@query("panel_observation_bounds", f"""WITH {E_SQL}, x AS (SELECT client, max(m) AS last_m FROM e_obs GROUP BY 1), r AS (SELECT max(last_m) AS ref FROM x)
  SELECT max(ref) AS ref_m, greatest(max(ref), max(exit_m)) AS end_m, count(*) FILTER (exit_m IS NULL AND last_m < ref) AS stale_active
  FROM e_lab LEFT JOIN x USING (client), r""")
def bounds(spark, sf):
    act = e_activity(spark, sf)
    cl = lb.label_by_gap(act, E_REF, E_GAP)
    return pn.observation_bounds(cl, pn.cut_at_exit(act, cl))


@query("panel_inferred_exit", f"""WITH {E_SQL}, x AS (SELECT client, max(m) AS last_m FROM e_obs GROUP BY 1)
  SELECT client, exit_m IS NOT NULL AS cancelled, CASE WHEN exit_m IS NOT NULL AND client % 2 = 0 THEN last_m + 1 ELSE exit_m END AS exit_m,
   exit_m IS NOT NULL AND client % 2 = 0 AS exit_inferred FROM e_lab LEFT JOIN x USING (client)""")
def inferred(spark, sf):
    act = e_activity(spark, sf)
    cl = lb.label_by_gap(act, E_REF, E_GAP)
    seen = pn.cut_at_exit(act, cl)
    blank = cl.withColumn("exit_m", F.when(F.pmod("client", F.lit(2)) != 0, F.col("exit_m")))
    return pn.infer_exits(blank, seen).select("client", "cancelled", "exit_m", "exit_inferred")


@query("panel_excluded_clients", """WITH s AS (SELECT c_custkey AS client, c_acctbal < 0 AS cancelled FROM customer),
  o AS (SELECT o_custkey AS client, min(year(o_orderdate)*12+month(o_orderdate)-1) AS first_m FROM orders GROUP BY 1)
  SELECT client FROM s LEFT JOIN o USING (client) WHERE cancelled AND (first_m IS NULL OR first_m >= 23952)""")
def excluded(spark, sf):
    cl = table(spark, sf, "customer").select(F.col("c_custkey").alias("client"), (F.col("c_acctbal") < 0).alias("cancelled"),
                                             F.when(F.col("c_acctbal") < 0, 23952).alias("exit_m"))
    act = o_activity(spark, sf).select("client", "m")
    grid = pn.client_month_grid(cl, pn.cut_at_exit(act, cl), O_REF)
    return pn.excluded_clients(cl, grid)


@query("panel_snapshot", f"""WITH {E_SQL} SELECT client, 24000 AS m, 1 AS k, CAST(exit_m IS NOT NULL AS INTEGER) AS y, exit_m IS NULL AS reference FROM e_lab""")
def snapshot(spark, sf):
    return pn.snapshot_panel(e_labels(spark, sf), 4).select("client", "m", "k", "y", "reference")


# ---------------------------------------------------------------- features
DENSE = [f"{c}__{t}" for c in ("value", "err", "n") for t in ("level", "change", "change_ref", "trend", "last")]


@query("features_dense", f"WITH {E_FEAT_SQL} SELECT client, m, {r6s(*DENSE)} FROM e_feat")
def dense(spark, sf):
    return e_features(spark, sf).select("client", "m", *r6(*DENSE))


@query("features_missing_share", f"""WITH {E_SQL} SELECT client, m, round(CAST(sum(CASE WHEN has_data AND buy IS NULL THEN 1 ELSE 0 END) OVER w AS DOUBLE)
   / nullif(sum(CASE WHEN has_data THEN 1 ELSE 0 END) OVER w, 0), 6) AS buy__missing FROM e_pan
  WINDOW w AS (PARTITION BY client ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def missing(spark, sf):
    return ft.missing_share(e_panel(spark, sf), ["buy"], F.col("has_data")).select("client", "m", *r6("buy__missing"))


COUNTS = ["n__level", "n__change", "n__change_ref", "n__trend", "n__last"]


@query("features_transaction_count", f"""WITH {E_SQL}, b AS (SELECT min(m) AS lo FROM e_pan), z AS (SELECT l.client, CAST(r.m AS INTEGER) AS m
    FROM e_lab l, b, LATERAL (SELECT unnest(range(b.lo, {E_REF} + 1))) r(m)),
  f AS (SELECT z.client, z.m, coalesce(o.n, 0)::DOUBLE AS n FROM z LEFT JOIN e_obs o USING (client, m)),
  g AS (SELECT client, m, {dense_sql('n')} FROM f {WINDOWS_SQL})
  SELECT client, m, {r6s(*COUNTS)} FROM g JOIN (SELECT client, m FROM e_pan) USING (client, m)""")
def counts(spark, sf):
    p = e_panel(spark, sf)
    return ft.count_features(p, "n", p.select(F.min("m")).scalar()).select("client", "m", *r6(*COUNTS))


SPARSE = [f"buy__{t}" for t in ("last", "change", "change_ref", "mean", "months_since", "never")]


@query("features_sparse", f"""WITH {E_SQL} SELECT client, m, round(last_value(buy IGNORE NULLS) OVER w, 6) AS buy__last,
   round(CASE WHEN count(buy) OVER w >= 2 THEN last_value(buy IGNORE NULLS) OVER w - (sum(buy) OVER w - last_value(buy IGNORE NULLS) OVER w)/(count(buy) OVER w - 1) END, 6) AS buy__change,
   round(CASE WHEN count(buy) OVER w >= 2 THEN (sum(buy) OVER w - last_value(buy IGNORE NULLS) OVER w)/(count(buy) OVER w - 1) END, 6) AS buy__change_ref,
   round(avg(buy) OVER (PARTITION BY client ORDER BY m RANGE BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS buy__mean,
   CAST(m - max(CASE WHEN buy IS NOT NULL THEN m END) OVER w AS DOUBLE) AS buy__months_since, CASE WHEN count(buy) OVER w = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS buy__never
  FROM e_pan WINDOW w AS (PARTITION BY client ORDER BY m)""")
def sparse(spark, sf):
    return ft.sparse_features(e_panel(spark, sf), {"buy": 6}).select("client", "m", *r6(*SPARSE))


@query("features_sparse_other_table", f"""WITH {O_SQL}, b AS (SELECT min(m) AS lo FROM o_pan), s AS (
    SELECT o_custkey AS client, CAST(year(l_shipdate)*12+month(l_shipdate)-1 AS INTEGER) AS m, avg(l_quantity) AS qty
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_shipdate < DATE '2001-08-01' GROUP BY 1, 2),
  c AS (SELECT s.* FROM s JOIN o_lab l USING (client) WHERE l.exit_m IS NULL OR s.m < l.exit_m),
  u AS (SELECT client, m, g.client IS NOT NULL AS on_grid, qty FROM (SELECT client, m FROM o_pan) g FULL JOIN c USING (client, m), b WHERE m >= lo)
  SELECT client, m, round(lastq, 6) AS qty__last, round(mean6, 6) AS qty__mean FROM (SELECT client, m, on_grid, last_value(qty IGNORE NULLS) OVER (PARTITION BY client ORDER BY m) AS lastq,
     avg(qty) OVER (PARTITION BY client ORDER BY m RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS mean6 FROM u)
  JOIN (SELECT client, m FROM o_pan) USING (client, m)""")
def sparse_other(spark, sf):
    act = o_activity(spark, sf)
    cl = lb.label_by_gap(act, O_REF, O_GAP)
    p = o_panel(spark, sf)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("client"))
    li = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_quantity", "l_shipdate")
    ship = lb.valid_sales(lb.attach_client(li, o, "l_orderkey", ["client"]), "client", "l_shipdate", O_REF)
    monthly = ship.groupBy("client", "m").agg(F.avg("l_quantity").alias("qty"))
    both = ft.with_observations(p, pn.cut_at_exit(monthly, cl), ["qty"])
    d = ft.sparse_features(both, {"qty": 6}).filter("on_grid")
    return d.select("client", "m", *r6("qty__last", "qty__mean"))


@query("features_sparse_window", f"""WITH {E_SQL}, g AS (SELECT m - lag(m) OVER (PARTITION BY client ORDER BY m) AS gap FROM e_obs WHERE buy IS NOT NULL)
  SELECT CAST(median(gap) AS DOUBLE) AS median_gap, CAST(least(12, greatest(3, 2*floor(median(gap)))) AS INTEGER) AS "window" FROM g""")
def sparse_window(spark, sf):
    act = e_activity(spark, sf)
    return ft.sparse_window(pn.cut_at_exit(act, lb.label_by_gap(act, E_REF, E_GAP)), "buy")


@query("features_value_density", f"""WITH {E_SQL} SELECT c AS "column", round(d, 6) AS density, d >= 0.6 AS dense FROM (
   SELECT 'value' AS c, avg(CAST(value IS NOT NULL AS INTEGER)) AS d FROM e_pan WHERE has_data
   UNION ALL SELECT 'buy', avg(CAST(buy IS NOT NULL AS INTEGER)) FROM e_pan WHERE has_data)""")
def value_density(spark, sf):
    return ft.value_density(e_panel(spark, sf), ["value", "buy"]).withColumn("density", F.round("density", 6))


@query("features_category_levels", """SELECT coalesce(o_orderpriority, '(ausente)') AS level, count(*) AS n, round(count(*)/sum(count(*)) OVER (), 6) AS share
  FROM orders GROUP BY 1 QUALIFY count(*)/sum(count(*)) OVER () >= 0.03 ORDER BY n DESC, level LIMIT 12""")
def levels(spark, sf):
    return ft.category_levels(table(spark, sf, "orders"), "o_orderpriority").withColumn("share", F.round("share", 6))


@query("features_category_freq", f"""WITH {E_SQL}, s AS (SELECT user_id AS client, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS m,
     avg(CASE WHEN event_type='click' THEN 1.0::DOUBLE ELSE 0 END) AS c, avg(CASE WHEN event_type='error' THEN 1.0::DOUBLE ELSE 0 END) AS e FROM events GROUP BY 1, 2)
  SELECT client, m, round(avg(c) OVER w, 6) AS "event_type=click__freq", round(avg(e) OVER w, 6) AS "event_type=error__freq",
    round_even(last_value(c IGNORE NULLS) OVER u, 0) AS "event_type=click__latest_is", round_even(last_value(e IGNORE NULLS) OVER u, 0) AS "event_type=error__latest_is"
  FROM (SELECT p.client, p.m, s.c, s.e FROM e_pan p LEFT JOIN s ON s.client=p.client AND s.m=p.m AND p.has_data)
  WINDOW w AS (PARTITION BY client ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), u AS (PARTITION BY client ORDER BY m)""")
def category(spark, sf):
    rows = e_rows(spark, sf)
    shares = ft.category_shares(rows, "event_type", ["click", "error"])
    cl = e_labels(spark, sf)
    grid = pn.client_month_grid(cl, pn.cut_at_exit(shares, cl), E_REF)
    cols = ["event_type=click", "event_type=error"]
    d = ft.category_features(grid, cols, 3)
    return d.select("client", "m", *r6(*[f"{c}__freq" for c in cols]), *[F.col(f"`{c}__latest_is`") for c in cols])


@query("features_event_table", """WITH e AS (SELECT user_id AS client, count(*) AS n, avg(value) AS v,
    avg(CASE WHEN event_type='click' THEN 1.0::DOUBLE ELSE 0 END) AS c FROM events GROUP BY 1)
  SELECT c_custkey AS client, CAST(coalesce(n, 0) AS DOUBLE) AS registros__count, round(v, 6) AS value__event_mean, round(c, 6) AS "event_type=click__event_share"
  FROM customer LEFT JOIN e ON client = c_custkey""")
def event_table(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("client"))
    ev = table(spark, sf, "events").select(F.col("user_id").alias("client"), "event_type", "value")
    d = ft.event_features(ids, ev, ["value"], {"event_type": ["click"]})
    return d.select("client", "registros__count", *r6("value__event_mean", "event_type=click__event_share"))


@query("features_static_one_hot", """SELECT c_custkey AS client, c_acctbal AS c_acctbal__static,
  CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS "c_mktsegment=BUILDING__category", CAST(c_mktsegment = 'MACHINERY' AS DOUBLE) AS "c_mktsegment=MACHINERY__category" FROM customer""")
def static(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "client")
    return ft.static_features(c, ["c_acctbal"], {"c_mktsegment": ["BUILDING", "MACHINERY"]})


@query("features_one_hot_levels", """SELECT c_mktsegment AS level, count(*) AS n FROM customer GROUP BY 1
  HAVING count(*) >= greatest(3, 0.03 * (SELECT count(*) FROM customer))""")
def one_hot_levels(spark, sf):
    return ft.one_hot_levels(table(spark, sf, "customer"), "c_mktsegment")


@query("features_months_since_date", f"""WITH {O_SQL}, f AS (SELECT o_custkey AS client, CAST(min(year(o_orderdate)*12+month(o_orderdate)-1) AS INTEGER) AS s FROM orders GROUP BY 1)
  SELECT p.client, p.m, CAST(p.m - f.s AS DOUBLE) AS start__time_since FROM o_pan p LEFT JOIN f USING (client)""")
def since_date(spark, sf):
    dates = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("client")).agg(F.min(col.month_index(F.col("o_orderdate"))).alias("start"))
    return ft.months_since_date(o_panel(spark, sf).select("client", "m"), dates, "start")


@query("features_run_length", f"""WITH {E_SQL}, r AS (SELECT client, m, coalesce(value >= 45, false) AS side FROM e_pan),
  q AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY m) AS rn FROM r)
  SELECT client, m, CAST(rn - coalesce(max(CASE WHEN NOT side THEN rn END) OVER (PARTITION BY client ORDER BY m), 0) AS INTEGER) AS run FROM q""")
def run_length(spark, sf):
    d = e_panel(spark, sf)
    return st.run_length(d, st.on_risk_side(F.col("value"), 45.0, 1)).select("client", "m", "run")


@query("features_risk_delta", f"""WITH {E_FEAT_SQL} SELECT client, m, round(p - lag(p) OVER w, 6) AS risco_previsto__delta,
  round(p - avg(p) OVER (PARTITION BY client ORDER BY m ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS risco_previsto__delta_3m
  FROM e_risk WINDOW w AS (PARTITION BY client ORDER BY m)""")
def risk_delta(spark, sf):
    d = ft.risk_delta_features(e_scored(spark, sf))
    return d.select("client", "m", *r6("risco_previsto__delta", "risco_previsto__delta_3m"))


@query("features_risk_delta_placebo", f"""WITH {E_FEAT_SQL}, d AS (SELECT client, m, p - lag(p) OVER (PARTITION BY client ORDER BY m) AS v FROM e_risk),
  a AS (SELECT client, m, row_number() OVER (ORDER BY client, m) AS i FROM d WHERE v IS NOT NULL),
  b AS (SELECT v, row_number() OVER (ORDER BY md5(concat(client, '|', m, '|7')), client, m) AS i FROM d WHERE v IS NOT NULL)
  SELECT d.client, d.m, round(b.v, 6) AS risco_previsto__delta FROM d LEFT JOIN a ON a.client = d.client AND a.m = d.m LEFT JOIN b ON b.i = a.i""")
def placebo(spark, sf):
    d = ft.risk_delta_features(e_scored(spark, sf)).select("client", "m", "risco_previsto__delta")
    return ft.placebo(d, "risco_previsto__delta", seed=7).select("client", "m", *r6("risco_previsto__delta"))


@query("panel_attach_temporal", """SELECT user_id AS client, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1""")
def attach_temporal(spark, sf):
    ids = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("client"))
    return pn.attach_temporal(ids, e_rows(spark, sf).unionByName(
        table(spark, sf, "events").select(F.col("user_id").alias("client"), "ts", "event_type", "value", "event_id").filter(col.day_index(F.col("ts")) > E_REF)
        .withColumn("m", col.day_index(F.col("ts"))))).groupBy("client").agg(F.count(F.lit(1)).alias("n"))


@query("panel_usable_columns", """SELECT 'c_mktsegment' AS col, 'category' AS type UNION ALL SELECT 'c_acctbal', 'numeric' UNION ALL SELECT 'c_nationkey', 'numeric'""")
def usable(spark, sf):
    from ..operators.schema import infer_structure
    st_ = infer_structure({"customer": table(spark, sf, "customer")}, "customer", "c_custkey")
    return spark.createDataFrame(list(pn.usable_columns(st_.tables["customer"].types, ["c_custkey"]).items()), "col string, type string")


@query("panel_orders_joined", f"WITH {O_SQL} SELECT {PANEL_COLS} FROM o_pan")
def panel_orders_joined(spark, sf):
    """The general path: labels, exit cut and grid as separate steps (bases whose client table is its own)."""
    act = o_activity(spark, sf)
    clients = lb.label_by_gap(act, O_REF, O_GAP)
    grid = pn.client_month_grid(clients, pn.cut_at_exit(act, clients), O_REF)
    return pn.label_panel(grid, 3, 4, O_REF).select(*PANEL_COLS.split(", "))
