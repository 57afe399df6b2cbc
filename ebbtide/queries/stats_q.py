"""Queries: scalar functions and the statistics kernel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as col
from ..operators import stats as st
from .base import E_FEAT_SQL, E_SQL, e_features, e_labels, e_panel, e_scored
from .registry import query, table
from .rounding import r6, rd, rs


# ---------------------------------------------------------------- scalar functions
@query("fn_date_shapes", """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, true AS looks FROM orders""")
def date_shapes(spark, sf):
    o = table(spark, sf, "orders")
    shapes = ["yyyy-MM-dd", "yyyy-MM", "dd/MM/yyyy", "MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "yyyy-MM-dd HH:mm"]
    s = F.lit(None).cast("string")
    for i, f in enumerate(shapes):
        s = F.when(F.pmod("o_orderkey", F.lit(len(shapes))) == i, F.date_format("o_orderdate", f)).otherwise(s)
    d = o.select("o_orderkey", F.concat(F.lit(" "), s).alias("s"))
    return d.select("o_orderkey", col.to_month(F.col("s")).alias("month"), col.looks_like_date(F.col("s")).alias("looks"))


@query("fn_year_month_number", """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders""")
def ym_number(spark, sf):
    o = table(spark, sf, "orders")
    n = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("double")
    return o.select("o_orderkey", col.year_month_number(n).alias("month"))


@query("fn_bad_dates", """SELECT c_custkey, CAST(NULL AS DATE) AS month FROM customer""")
def bad_dates(spark, sf):
    bad = F.element_at(F.array(*[F.lit(x) for x in ("2024-13-01", "31/02/2024", "abc", "  ", "99/99/2024")]),
                       (F.pmod("c_custkey", F.lit(5)) + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", col.to_month(bad).alias("month"))


@query("fn_months_between", """SELECT l_orderkey, l_linenumber, l_partkey, CAST((year(l_shipdate)-year(o_orderdate))*12 + month(l_shipdate)-month(o_orderdate) AS INTEGER) AS months
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def months_between(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", col.months_between_int(F.col("l_shipdate"), F.col("o_orderdate")).alias("months"))


@query("fn_norm_id", """SELECT CAST(c_custkey AS VARCHAR) AS a, trim(c_name) AS b FROM customer""")
def norm_id(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(col.norm_id(F.col("c_custkey").cast("double"), numeric=True).alias("a"),
                    col.norm_id(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("b"))


@query("fn_norm_value", """SELECT o_orderkey, lower(o_orderstatus) AS a, CAST(o_orderkey % 7 AS VARCHAR) AS b,
  CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0' END AS c FROM orders""")
def norm_value(spark, sf):
    o = table(spark, sf, "orders")
    flag = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.lit(" Verdadeiro ")).otherwise(F.lit("FALSE"))
    number = F.concat(F.pmod("o_orderkey", F.lit(7)).cast("string"), F.lit(",0"))
    return o.select("o_orderkey", col.norm_value(F.concat(F.lit(" "), "o_orderstatus")).alias("a"),
                    col.norm_value(number).alias("b"), col.norm_value(flag).alias("c"))


@query("fn_numeric_text", """SELECT o_orderkey, o_totalprice AS br, o_totalprice AS us, true AS both FROM orders""")
def numeric_text(spark, sf):
    o = table(spark, sf, "orders")
    us = F.format_number("o_totalprice", 2)
    br = F.translate(us, ",.", ".,")
    return o.select("o_orderkey", col.text_to_number(br).alias("br"), col.text_to_number(us).alias("us"),
                    (col.looks_numeric(br) & col.looks_numeric(us)).alias("both"))


@query("fn_display_text", """SELECT c_custkey, replace(translate(format('{:,.2f}', c_acctbal), ',.', '.,'), '-', '−') AS number_2,
  concat('R$ ', translate(format('{:,.0f}', c_acctbal), ',.', '.,')) AS money, concat(CAST(c_custkey % 101 AS VARCHAR), '%') AS pct FROM customer""")
def display(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", col.number_text(F.col("c_acctbal"), 2).alias("number_2"), col.money_text(F.col("c_acctbal")).alias("money"),
                    col.percent_text(F.pmod("c_custkey", F.lit(101)) / 100.0).alias("pct"))


@query("fn_month_text", """SELECT o_orderkey, concat(['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez'][month(o_orderdate)], '/', CAST(year(o_orderdate) AS VARCHAR)) AS label,
  strftime(o_orderdate - INTERVAL 5 MONTH, '%Y-%m') AS back_5 FROM orders""")
def month_text(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", col.month_text(F.col("o_orderdate")).alias("label"),
                    col.shift_month_text(F.date_format("o_orderdate", "yyyy-MM"), 5).alias("back_5"))


@query("fn_round_step", """WITH s AS (SELECT o_orderkey, o_totalprice AS x, pow(10, floor(log10(o_totalprice))) AS p FROM orders)
  SELECT o_orderkey, p * (CASE WHEN x/p <= 1.5 THEN 1 WHEN x/p <= 2.25 THEN 2 WHEN x/p <= 3.75 THEN 2.5 WHEN x/p <= 7.5 THEN 5 ELSE 10 END)::DOUBLE AS step FROM s""")
def step(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", col.round_step(F.col("o_totalprice")).alias("step"))


@query("fn_sigmoid_log_loss", f"""WITH p AS (SELECT c_custkey, 1/(1+exp(-c_acctbal/1000)) AS p, c_mktsegment = 'BUILDING' AS y FROM customer)
  SELECT y, {rs('avg(p)')} AS mean_p, {rs('avg(-ln(CASE WHEN y THEN greatest(least(p, 1-1e-12), 1e-12) ELSE 1-greatest(least(p, 1-1e-12), 1e-12) END))')} AS log_loss FROM p GROUP BY 1""")
def sig(spark, sf):
    c = table(spark, sf, "customer").select((F.col("c_mktsegment") == "BUILDING").alias("y"), col.sigmoid(F.col("c_acctbal") / 1000).alias("p"))
    return c.groupBy("y").agg(rd(F.avg("p"), 6, "mean_p"), rd(F.avg(col.log_loss_term(F.col("y").cast("int"), F.col("p"))), 6, "log_loss"))


@query("fn_payment_group", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'a_prazo' WHEN 1 THEN 'pix' WHEN 2 THEN 'credito' WHEN 3 THEN 'debito' WHEN 4 THEN 'dinheiro' ELSE 'outros' END AS grp FROM orders""")
def payment(spark, sf):
    words = F.array(*[F.lit(w) for w in ("Nota a prazo", "pix loja", "Cartao visa", "debito auto", "Dinheiro", "vale")])
    return table(spark, sf, "orders").select("o_orderkey", col.payment_group(
        F.element_at(words, (F.pmod("o_orderkey", F.lit(6)) + 1).cast("int"))).alias("grp"))


@query("fn_product_category", """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'ring') THEN 'hit' ELSE 'miss' END AS category FROM part""")
def category(spark, sf):
    return table(spark, sf, "part").select("p_partkey", col.product_category(F.col("p_name"), ["RED", "RING"], "hit", "miss").alias("category"))


@query("fn_derived_columns", f"""SELECT l_orderkey, l_linenumber, l_partkey, {rs('l_extendedprice - l_quantity * coalesce(p_retailprice, 0)', 2)} AS margin,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS due_days, CAST(hour(l_shipdate) AS INTEGER) AS hour_of_day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10""")
def derived(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    p = table(spark, sf, "part").filter("p_size > 10")
    d = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey, "left")
    return d.select("l_orderkey", "l_linenumber", "l_partkey",
                    rd(col.margin(F.col("l_extendedprice"), F.col("l_quantity"), F.col("p_retailprice")), 2, "margin"),
                    F.datediff("l_shipdate", "o_orderdate").alias("due_days"), F.hour("l_shipdate").alias("hour_of_day"))


@query("fn_ratio_recode_ordinal", f"""SELECT c_custkey, CASE WHEN c_nationkey > 0 THEN {rs('100.0::DOUBLE * c_custkey / c_nationkey', 4)} END AS pct,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Construção' ELSE c_mktsegment END AS segment, CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 END AS INTEGER) AS ord FROM customer""")
def ratio(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", rd(col.safe_pct(F.col("c_custkey"), F.col("c_nationkey")), 4, "pct"),
                    col.recode(F.col("c_mktsegment"), {"BUILDING": "Construção"}).alias("segment"),
                    col.ordinal(F.col("c_mktsegment"), ["AUTOMOBILE", "BUILDING"]).alias("ord"))


@query("fn_search_text", """SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9%]+', ' ', 'g'))) AS h FROM documents""")
def search(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(col.search_text(F.col("text"))).alias("h"))


# ---------------------------------------------------------------- kernel
@query("stats_auc", f"""WITH r AS (SELECT o_orderpriority AS priority, o_orderstatus = 'F' AS y, rank() OVER w + (count(*) OVER (PARTITION BY o_orderpriority, floor(o_totalprice/1000)) - 1)/2.0 AS rk
    FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY floor(o_totalprice/1000)))
  SELECT priority, {rs("(sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1)/2.0) / (count(*) FILTER (y)::DOUBLE * count(*) FILTER (NOT y))")} AS auc,
    count(*) AS n, count(*) FILTER (y) AS n_pos FROM r GROUP BY 1""")
def auc(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), (F.col("o_orderstatus") == "F").alias("y"),
                                          F.floor(F.col("o_totalprice") / 1000).alias("s"))
    return st.auc(o, "y", "s", ["priority"]).withColumn("auc", rd("auc"))


@query("stats_average_ranks", """WITH r AS (SELECT l_quantity AS value, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1)/2.0 AS rk FROM lineitem)
  SELECT value, count(*) AS n, CAST(min(rk) AS DOUBLE) AS "rank" FROM r GROUP BY 1""")
def ranks(spark, sf):
    return st.average_ranks(table(spark, sf, "lineitem"), "l_quantity").select("value", "n", "rank")


@query("stats_quantiles", f"""SELECT o_orderpriority AS priority, {rs('quantile_cont(o_totalprice, 0.25)')} AS p25, {rs('quantile_cont(o_totalprice, 0.5)')} AS med,
  {rs('quantile_cont(o_totalprice, 0.75)')} AS p75, count(*) AS n FROM orders GROUP BY 1""")
def quant(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "priority")
    return st.quantiles(o, "o_totalprice", [0.25, 0.5, 0.75], ["p25", "med", "p75"], ["priority"]).select("priority", *r6("p25", "med", "p75"), "n")


YOUDEN = """g AS (SELECT * FROM ({src})), c AS (SELECT DISTINCT s AS cut FROM g), t AS (SELECT sum(y) AS n1, sum(1-y) AS n0 FROM g),
  j AS (SELECT cut, sum(CASE WHEN s >= cut THEN y END)::DOUBLE/max(n1) - sum(CASE WHEN s >= cut THEN 1-y END)::DOUBLE/max(n0) AS j FROM g, c, t GROUP BY 1)"""


@query("stats_youden", f"""WITH {E_SQL}, {YOUDEN.format(src="SELECT -err AS s, y FROM e_pan WHERE train AND err IS NOT NULL")}
  SELECT {rs('arg_min(-cut, struct_pack(a := -j, b := cut))')} AS threshold, {rs('max(j)')} AS j FROM j""")
def youden(spark, sf):
    d = e_panel(spark, sf).filter("train")
    return st.youden(d, "y", "err", -1, tidy=False).select(*r6("threshold", "j"))


@query("stats_youden_many_values", f"""WITH {E_SQL}, g AS (SELECT value AS s, sum(y) AS p, sum(1-y) AS q FROM e_pan WHERE train AND value IS NOT NULL GROUP BY 1),
  j AS (SELECT s, sum(p) OVER (ORDER BY s DESC)::DOUBLE/(SELECT sum(p) FROM g) - sum(q) OVER (ORDER BY s DESC)::DOUBLE/(SELECT sum(q) FROM g) AS j FROM g)
  SELECT {rs('arg_min(s, struct_pack(a := -j, b := s))', 4)} AS threshold, {rs('max(j)')} AS j FROM j""")
def youden_many(spark, sf):
    d = e_panel(spark, sf).filter("train")
    return st.youden(d, "y", "value", 1, tidy=False).select(rd("threshold", 4), rd("j"))


@query("stats_youden_round", f"""WITH {E_SQL}, {YOUDEN.format(src="SELECT err AS s, y FROM e_pan WHERE train AND err IS NOT NULL")},
  b AS (SELECT arg_min(cut, struct_pack(a := -j, b := cut)) AS lim, max(j) AS jb FROM j), q AS (SELECT stddev_pop(s)/4 AS x FROM g),
  st AS (SELECT pow(10, floor(log10(x))) * (CASE WHEN x/pow(10, floor(log10(x))) <= 1.5 THEN 1 WHEN x/pow(10, floor(log10(x))) <= 2.25 THEN 2 WHEN x/pow(10, floor(log10(x))) <= 3.75 THEN 2.5
      WHEN x/pow(10, floor(log10(x))) <= 7.5 THEN 5 ELSE 10 END)::DOUBLE AS step FROM q),
  tr AS (SELECT i, round_even(lim/(step/d), 0)*(step/d) AS cand FROM b, st, (VALUES (0, 1), (1, 2), (2, 5), (3, 10)) v(i, d)),
  tj AS (SELECT i, cand, sum(CASE WHEN s >= cand THEN y ELSE 0 END)::DOUBLE/max(n1) - sum(CASE WHEN s >= cand THEN 1-y ELSE 0 END)::DOUBLE/max(n0) AS j FROM tr, g, t GROUP BY 1, 2)
  SELECT {rs('coalesce(arg_min(cand, i) FILTER (tj.j >= 0.9*jb), max(lim))')} AS threshold, {rs('coalesce(arg_min(tj.j, i) FILTER (tj.j >= 0.9*jb), max(jb))')} AS j FROM tj, b""")
def youden_round(spark, sf):
    d = e_panel(spark, sf).filter("train")
    return st.youden(d, "y", "err", 1, tidy=True).select(*r6("threshold", "j"))


@query("stats_spearman", f"""WITH {E_FEAT_SQL}, v AS (SELECT round(n__level, 9) AS x, round(err__level, 9) AS y, n__last AS z FROM e_feat WHERE has_data),
  r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x)-1)/2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y)-1)/2.0 AS b,
    rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z)-1)/2.0 AS c FROM v)
  SELECT 'n__level' AS a, 'err__level' AS b, {rs('corr(a, b)')} AS rho FROM r UNION ALL SELECT 'n__level', 'n__last', {rs('corr(a, c)')} FROM r
  UNION ALL SELECT 'err__level', 'n__last', {rs('corr(b, c)')} FROM r""")
def spearman(spark, sf):
    d = e_features(spark, sf).filter("has_data").withColumns({c: F.round(c, 9) for c in ("n__level", "err__level")})
    return st.spearman(d, ["client", "m"], ["n__level", "err__level", "n__last"]).withColumn("rho", rd("rho"))


@query("stats_global_rank", """SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS "rank" FROM customer""")
def rank(spark, sf):
    return st.global_rank(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), F.desc("c_acctbal"), "c_custkey").select("c_custkey", "rank")


@query("stats_episodes", f"""WITH {E_SQL}, r AS (SELECT client, cancelled, -k AS rel, coalesce(value >= 45, false) AS side, row_number() OVER (PARTITION BY client ORDER BY -k) AS rn FROM e_pan WHERE has_data),
  s AS (SELECT *, rn - row_number() OVER (PARTITION BY client, side ORDER BY rel) AS grp, max(rel) OVER (PARTITION BY client) AS last_rel FROM r)
  SELECT client, cancelled, min(rel) AS start, max(rel) AS "end", count(*) AS length, max(rel) = max(last_rel) AS ongoing FROM s WHERE side GROUP BY client, cancelled, grp""")
def episodes(spark, sf):
    d = e_panel(spark, sf).filter("has_data").withColumn("rel", -F.col("k"))
    return st.episodes(d, st.on_risk_side(F.col("value"), 45.0, 1), extra=["cancelled"])


FOLD_SQL = """SELECT client, CAST((row_number() OVER (ORDER BY exit_m IS NOT NULL, md5(concat(client, '|0')), client) - 1) % 5 AS INTEGER) AS fold FROM e_lab"""


@query("validation_folds", f"WITH {E_SQL} {FOLD_SQL}")
def folds(spark, sf):
    return st.assign_folds(e_labels(spark, sf), 5).select("client", "fold")


@query("stats_running_totals", """SELECT c_acctbal AS value, count(*) AS n, CAST(coalesce(sum(count(*)) OVER (ORDER BY c_acctbal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_before,
  lead(c_acctbal) OVER (ORDER BY c_acctbal) AS next_value FROM customer GROUP BY 1""")
def running(spark, sf):
    c = st.value_counts(table(spark, sf, "customer"), "c_acctbal", n=F.lit(1).cast("bigint"))
    return st.running_totals(c, [], ["n"]).select("value", "n", "n_before", "next_value")


__all__ = ["e_scored"]
