"""Queries: exploratory comparison and rule signals on the events base."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as col
from ..operators import explore as ex
from ..operators import labels as lb
from ..operators import panel as pn
from ..operators import rules as rl
from ..operators import stats as st
from .base import E_FEAT_SQL, E_GAP, E_REF, E_SQL, e_activity, e_labels, e_panel, e_rows, e_scored
from .metrics_q import PERF, perf_sql
from .registry import query, table
from .rounding import rd, rs


def observed(spark, sf):
    """Monthly rows before the exit and the clients."""
    act = e_activity(spark, sf)
    cl = lb.label_by_gap(act, E_REF, E_GAP)
    return pn.cut_at_exit(act, cl), cl


def aligned(spark, sf):
    rows, cl = observed(spark, sf)
    return ex.aligned(rows, cl.select("client", "cancelled", "exit_m"), E_REF)


AL_SQL = f"""{E_SQL}, al AS (SELECT o.client, o.m, o.n, o.value, o.buy, o.err, l.exit_m IS NOT NULL AS cancelled, coalesce(l.exit_m, {E_REF + 1}) AS exit_m,
   CAST(o.m - coalesce(l.exit_m, {E_REF + 1}) AS INTEGER) AS rel, CAST(-((-(o.m - coalesce(l.exit_m, {E_REF + 1})) - 1) // 3 + 1) AS INTEGER) AS rel_quarter
   FROM e_obs o LEFT JOIN e_lab l USING (client))"""


@query("explore_aligned_rows", f"WITH {AL_SQL} SELECT client, m, cancelled, exit_m, rel, rel_quarter FROM al")
def aligned_rows(spark, sf):
    return aligned(spark, sf).select("client", "m", "cancelled", "exit_m", "rel", "rel_quarter")


MOVE_SQL = f"""{AL_SQL}, s AS (SELECT 'value' AS series, client, m, value AS x FROM e_obs WHERE value IS NOT NULL UNION ALL SELECT 'buy', client, m, buy FROM e_obs WHERE buy IS NOT NULL
    UNION ALL SELECT 'err', client, m, err FROM e_obs), hi AS (SELECT series, min(m) AS lo, max(m) AS hi FROM s GROUP BY 1),
  tg AS (SELECT series, client, exit_m IS NOT NULL AS cancelled, -r AS rel, coalesce(exit_m, {E_REF + 1}) - r AS t FROM e_lab, hi, range(1, 13) g(r) WHERE coalesce(exit_m, {E_REF + 1}) - r BETWEEN lo AND hi),
  mv AS (SELECT tg.series, tg.client, cancelled, rel, avg(x) AS x FROM tg JOIN s ON s.series = tg.series AND s.client = tg.client AND s.m BETWEEN t - 2 AND t GROUP BY ALL),
  pt AS (SELECT series, CAST(rel AS INTEGER) AS rel, median(x) FILTER (cancelled) AS c_med, quantile_cont(x, 0.25) FILTER (cancelled) AS c_p25, quantile_cont(x, 0.75) FILTER (cancelled) AS c_p75, nullif(count(x) FILTER (cancelled), 0) AS c_n,
     median(x) FILTER (NOT cancelled) AS a_med, quantile_cont(x, 0.25) FILTER (NOT cancelled) AS a_p25, quantile_cont(x, 0.75) FILTER (NOT cancelled) AS a_p75, nullif(count(x) FILTER (NOT cancelled), 0) AS a_n FROM mv GROUP BY 1, 2)"""
Q = ["c_med", "c_p25", "c_p75", "a_med", "a_p25", "a_p75"]


def series(spark, sf):
    rows, cl = observed(spark, sf)
    return ex.long_series(rows, ["value", "buy", "err"]), cl


@query("explore_compare_points", f"WITH {MOVE_SQL} SELECT series, rel, c_n, a_n, {', '.join(f'{rs(c)} AS {c}' for c in Q)} FROM pt")
def points(spark, sf):
    s, cl = series(spark, sf)
    p, _ = ex.compare_before_exit(s, cl, E_REF)
    return p.select("series", "rel", "c_n", "a_n", *[rd(c) for c in Q])


@query("explore_compare_summary", f"""WITH {MOVE_SQL}, r AS (SELECT series, cancelled, rank() OVER (PARTITION BY series ORDER BY x) + (count(*) OVER (PARTITION BY series, x) - 1)/2.0 AS rk FROM mv WHERE rel = -1),
  a AS (SELECT series, (sum(rk) FILTER (cancelled) - count(*) FILTER (cancelled)*(count(*) FILTER (cancelled)+1)/2.0)/(count(*) FILTER (cancelled)::DOUBLE*count(*) FILTER (NOT cancelled)) AS auc FROM r GROUP BY 1),
  l AS (SELECT series, coalesce(max(rel) FILTER (NOT coalesce(c_med < a_p25 OR c_med > a_p75, false)), -13) AS bad FROM pt GROUP BY 1)
  SELECT series, {rs('auc')} AS auc, CAST(nullif(-bad - 1, 0) AS INTEGER) AS lead FROM a JOIN l USING (series)""")
def summary(spark, sf):
    s, cl = series(spark, sf)
    _, out = ex.compare_before_exit(s, cl, E_REF)
    return out.select("series", rd("auc"), "lead")


@query("explore_group_sizes", f"WITH {MOVE_SQL} SELECT count(DISTINCT client) FILTER (cancelled) AS cancelled_clients, count(DISTINCT client) FILTER (NOT cancelled) AS active_clients FROM mv")
def sizes(spark, sf):
    s, cl = series(spark, sf)
    return ex.group_sizes(s, cl, E_REF)


@query("explore_relative_profile", f"""WITH {AL_SQL}, s AS (SELECT 'value' AS metric, cancelled, rel, value AS x FROM al UNION ALL SELECT 'err', cancelled, rel, err FROM al)
  SELECT metric, cancelled, rel, {rs('median(x)')} AS median, {rs('quantile_cont(x, 0.25)')} AS p25, {rs('quantile_cont(x, 0.75)')} AS p75, {rs('avg(x)')} AS mean, count(x) AS n FROM s WHERE rel BETWEEN -12 AND -1 GROUP BY 1, 2, 3""")
def profile(spark, sf):
    d = ex.relative_profile(aligned(spark, sf), ["value", "err"])
    return d.select("metric", "cancelled", "rel", *[rd(c) for c in ("median", "p25", "p75", "mean")], "n")


@query("explore_final_window_mean", f"WITH {AL_SQL} SELECT client, cancelled, {rs('avg(value)')} AS value, {rs('avg(err)')} AS err FROM al WHERE rel >= -3 GROUP BY 1, 2")
def final_mean(spark, sf):
    return ex.final_window_mean(aligned(spark, sf), ["value", "err"]).select("client", "cancelled", rd("value"), rd("err"))


@query("explore_separation_auc", f"""WITH {AL_SQL}, r AS (SELECT cancelled, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1)/2.0 AS rk FROM al)
  SELECT 'n' AS metric, {rs('(sum(rk) FILTER (cancelled) - count(*) FILTER (cancelled)*(count(*) FILTER (cancelled)+1)/2.0)/(count(*) FILTER (cancelled)::DOUBLE*count(*) FILTER (NOT cancelled))')} AS auc, count(*) AS n, count(*) FILTER (cancelled) AS n_pos FROM r""")
def sep_auc(spark, sf):
    return ex.separation_auc(aligned(spark, sf), ["n"]).withColumn("auc", rd("auc"))


@query("explore_smooth_rows", f"WITH {AL_SQL}, s AS (SELECT client, m, avg(value) OVER (PARTITION BY client ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS value FROM al) SELECT client, m, {rs('value')} AS value FROM s")
def smooth(spark, sf):
    return ex.smooth(aligned(spark, sf), ["value"]).select("client", "m", rd("value"))


@query("explore_churn_by_attribute", f"""WITH {E_SQL}, c AS (SELECT exit_m IS NOT NULL AS cancelled, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM e_lab JOIN customer ON c_custkey = client),
  s AS (SELECT 'c_mktsegment' AS attribute, c_mktsegment AS level, cancelled FROM c UNION ALL SELECT 'c_nationkey', c_nationkey, cancelled FROM c)
  SELECT attribute, level, count(*) AS clients, count(*) FILTER (cancelled) AS cancelled, {rs('100.0::DOUBLE * count(*) FILTER (cancelled) / count(*)')} AS churn_pct FROM s GROUP BY 1, 2""")
def churn(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "client")
    return ex.churn_by_attribute(e_labels(spark, sf).join(c, "client"), ["c_mktsegment", "c_nationkey"]).withColumn("churn_pct", rd("churn_pct"))


AMOUNT_SQL = "am AS (SELECT client, avg(value_sum) AS amount FROM e_obs GROUP BY 1)"


def client_amounts(spark, sf):
    rows, cl = observed(spark, sf)
    return cl.join(rows.groupBy("client").agg(F.avg("value_sum").alias("amount")), "client", "left")


@query("explore_exits_by_month", f"""WITH {E_SQL}, {AMOUNT_SQL}, d AS (SELECT CAST(r AS INTEGER) AS exit_m FROM range({E_REF - 28}, {E_REF + 1}) t(r)), x AS (SELECT exit_m, count(*) AS exits, sum(amount) AS lost FROM e_lab JOIN am USING (client) WHERE exit_m IS NOT NULL GROUP BY 1)
  SELECT exit_m, coalesce(exits, 0) AS exits, {rs('coalesce(lost, 0)', 2)} AS lost, {rs('sum(coalesce(lost, 0)) OVER (ORDER BY exit_m)', 2)} AS lost_total FROM d LEFT JOIN x USING (exit_m)""")
def exits(spark, sf):
    d = ex.exits_by_month(client_amounts(spark, sf), E_REF - 28, E_REF, "amount")
    return d.select("exit_m", "exits", rd("lost", 2), rd("lost_total", 2))


@query("explore_portfolio_kpis", f"""WITH {E_SQL}, {AMOUNT_SQL} SELECT count(*) AS clients, count(exit_m) AS cancelled, {rs('100.0::DOUBLE*count(exit_m)/count(*)')} AS churn_pct, {rs('sum(amount) FILTER (exit_m IS NOT NULL)', 2)} AS lost_value,
  {rs('100*sum(amount) FILTER (exit_m IS NOT NULL)/sum(amount)')} AS lost_value_pct FROM e_lab LEFT JOIN am USING (client)""")
def kpis(spark, sf):
    return ex.portfolio_kpis(client_amounts(spark, sf), "amount").select("clients", "cancelled", rd("churn_pct"), rd("lost_value", 2), rd("lost_value_pct"))


@query("explore_response_by_quarter", f"""WITH {AL_SQL} SELECT cancelled, rel_quarter, {rs('100.0::DOUBLE*count(buy)/count(*)')} AS rate, {rs('avg(buy)')} AS score, count(*) AS n, count(buy) AS responses FROM al GROUP BY 1, 2""")
def response(spark, sf):
    d = aligned(spark, sf).withColumn("responded", F.col("buy").isNotNull())
    return ex.response_by_quarter(d, "responded", "buy").select("cancelled", "rel_quarter", rd("rate"), rd("score"), "n", "responses")


@query("explore_crosstab", f"""WITH {E_SQL} SELECT exit_m IS NOT NULL AS cancelled, {', '.join(f"count(*) FILTER (event_type='{t}') AS n_{t}, {rs(f'''100.0::DOUBLE*count(*) FILTER (event_type='{t}')/count(event_type)''')} AS pct_{t}" for t in ('click', 'error', 'view'))}
  FROM events JOIN e_lab ON client = user_id WHERE ts < TIMESTAMP '2024-01-30' GROUP BY 1""")
def crosstab(spark, sf):
    d = e_rows(spark, sf).join(e_labels(spark, sf).select("client", "cancelled"), "client")
    out = ex.crosstab(d, "cancelled", "event_type", ["click", "error", "view"])
    return out.select("cancelled", *[x for t in ("click", "error", "view") for x in (F.col(f"n_{t}"), rd(f"pct_{t}"))])


@query("explore_crosstab_last_row", f"""WITH {E_SQL}, l AS (SELECT user_id AS client, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type FROM events WHERE ts < TIMESTAMP '2024-01-30' GROUP BY 1)
  SELECT exit_m IS NOT NULL AS cancelled, count(*) FILTER (event_type='click') AS n_click, {rs("100.0::DOUBLE*count(*) FILTER (event_type='click')/count(event_type)")} AS pct_click FROM l JOIN e_lab USING (client) GROUP BY 1""")
def crosstab_last(spark, sf):
    last = ex.last_row(e_rows(spark, sf), ["ts", "event_id"], ["event_type"])
    return ex.crosstab(last.join(e_labels(spark, sf), "client"), "cancelled", "event_type", ["click"]).select("cancelled", "n_click", rd("pct_click"))


@query("explore_client_month_pivot", f"""WITH {AL_SQL} SELECT client, {', '.join(f"{rs(f'max(value) FILTER (m={E_REF - i})')} AS d{i}" for i in range(6))} FROM al GROUP BY 1""")
def pivot(spark, sf):
    d = ex.client_month_pivot(aligned(spark, sf), "value", [E_REF - i for i in range(6)], [f"d{i}" for i in range(6)])
    return d.select("client", *[rd(f"d{i}") for i in range(6)])


@query("explore_spearman_matrix", f"""WITH {AL_SQL}, p AS (SELECT 'n' AS a, 'err' AS b, n::DOUBLE AS x, round(err, 9) AS y FROM al UNION ALL SELECT 'n', 'buy', n, round(buy, 9) FROM al UNION ALL SELECT 'err', 'buy', round(err, 9), round(buy, 9) FROM al),
  r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x)-1)/2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y)-1)/2.0 AS ry FROM p WHERE y IS NOT NULL AND x IS NOT NULL)
  SELECT a, b, {rs('corr(rx, ry)')} AS rho FROM r GROUP BY 1, 2""")
def spearman(spark, sf):
    d = aligned(spark, sf).select("n", F.round("err", 9).alias("err"), F.round("buy", 9).alias("buy"))
    return ex.spearman_matrix(d, ["n", "err", "buy"]).withColumn("rho", rd("rho"))


@query("explore_active_median", f"WITH {AL_SQL} SELECT m, 'value' AS metric, {rs('median(value)')} AS median, count(value) AS n FROM al WHERE NOT cancelled GROUP BY 1")
def active_median(spark, sf):
    return ex.active_median_by_month(aligned(spark, sf), ["value"]).withColumn("median", rd("median"))


# ---------------------------------------------------------------- rules
SIGNALS = [rl.Signal("value", 1, "Valor médio", "R$"), rl.Signal("n", -1, "Eventos por dia", "/dia"), rl.Signal("err", 1, "Erros", "%"),
           rl.Signal("buy", -1, "Última compra", "R$", survey=True)]
LIMITS = [rl.Threshold("value", "change", 10.0), rl.Threshold("n", "level", 2.0), rl.Threshold("err", "level", 0.34), rl.Threshold("buy", "level", 20.0)]
NAMES = [t.signal for t in LIMITS]
RULES = [rl.Rule(None, 2, 1, "2 of any"), rl.Rule(None, 3, 1, "3 of any"), rl.Rule(None, 2, 2, "2 of any, 2 months"), rl.Rule("value", 2, 1, "main or 2"),
         rl.Rule("value", 3, 1, "main or 3"), rl.Rule("value", 2, 2, "main or 2, 2 months"), rl.Rule("value", 3, 2, "main or 3, 2 months")]
RULE = RULES[5]


def values(spark, sf):
    return rl.values_until(e_panel(spark, sf), SIGNALS)


def history(spark, sf):
    return rl.firing_history(values(spark, sf), SIGNALS, LIMITS, "value")


VAL_SQL = f"""{E_FEAT_SQL}, va AS (SELECT *, last_value(buy IGNORE NULLS) OVER u AS buy__level, CASE WHEN count(buy) OVER u >= 2 THEN last_value(buy IGNORE NULLS) OVER u - (sum(buy) OVER u - last_value(buy IGNORE NULLS) OVER u)/(count(buy) OVER u - 1) END AS buy__change
    FROM e_feat WINDOW u AS (PARTITION BY client ORDER BY m)),
  h0 AS (SELECT *, coalesce(value__change >= 10, false) AS f_value, coalesce(n__level <= 2, false) AS f_n, coalesce(err__level >= 0.34::DOUBLE, false) AS f_err, coalesce(buy__level <= 20, false) AS f_buy, value__level IS NOT NULL AS has_history FROM va WHERE k <= 15),
  h AS (SELECT *, f_value::INT + f_n::INT + f_err::INT + f_buy::INT AS n_signals FROM h0)"""


def alert_sql(src: str, rule: rl.Rule, flags=("f_value", "f_n", "f_err", "f_buy"), extra: str = "") -> str:
    others = [f for f in flags if f != f"f_{rule.main}"]
    cond = f"({' + '.join(f'{f}::INT' for f in others)}) >= {rule.min_others}"
    if rule.main:
        cond = f"(f_{rule.main} OR {cond})"
    nxt = f" AND coalesce(lead({cond} AND has_history) OVER (PARTITION BY client ORDER BY k), false)" if rule.persistence == 2 else ""
    return f"SELECT {extra}client, k, cancelled, true AS scorable, ({cond} AND has_history{nxt}) AS alarm FROM {src}"


@query("rules_values_until", f"""WITH {VAL_SQL} SELECT client, k, {rs('value__level')} AS value__level, {rs('value__change_ref')} AS value__change_ref, {rs('value__change')} AS value__change, {rs('buy__level')} AS buy__level, {rs('buy__change')} AS buy__change FROM va""")
def values_q(spark, sf):
    return values(spark, sf).select("client", "k", *[rd(c) for c in ("value__level", "value__change_ref", "value__change", "buy__level", "buy__change")])


AUC_TAB_SQL = f"""{VAL_SQL}, s AS (SELECT signal, form, k, cancelled, d * x AS x FROM (SELECT k, cancelled, unnest(['value','value','n','n','err','err','buy','buy']) AS signal, unnest(['level','change','level','change','level','change','level','change']) AS form,
    unnest([1,1,-1,-1,1,1,-1,-1]) AS d, unnest([value__level, value__change, n__level, n__change, err__level, err__change, buy__level, buy__change]) AS x FROM va WHERE k <= 6) WHERE x IS NOT NULL),
  r AS (SELECT *, rank() OVER (PARTITION BY signal, form, k ORDER BY round(x, 9)) + (count(*) OVER (PARTITION BY signal, form, k, round(x, 9)) - 1)/2.0 AS rk FROM s),
  atab AS (SELECT signal, form, CAST(k AS INTEGER) AS k, (sum(rk) FILTER (cancelled) - count(*) FILTER (cancelled)*(count(*) FILTER (cancelled)+1)/2.0)/nullif(count(*) FILTER (cancelled)::DOUBLE*count(*) FILTER (NOT cancelled), 0) AS auc, count(*) AS n, count(*) FILTER (cancelled) AS n_cancelled FROM r GROUP BY 1, 2, 3)"""


def auc_table(spark, sf):
    v = values(spark, sf)
    forms = [f"{s.name}__{f}" for s in SIGNALS for f in ("level", "change")]
    return rl.oriented_auc(v.withColumns({c: F.round(c, 9) for c in forms}), SIGNALS)


@query("rules_oriented_auc", f"WITH {AUC_TAB_SQL} SELECT signal, form, k, {rs('auc')} AS auc, n, n_cancelled FROM atab")
def auc_q(spark, sf):
    return auc_table(spark, sf).withColumn("auc", rd("auc"))


@query("rules_firing_history", f"WITH {VAL_SQL} SELECT client, k, f_value AS value, f_n AS n, f_err AS err, f_buy AS buy, n_signals, has_history FROM h")
def history_q(spark, sf):
    return history(spark, sf).select("client", "k", "value", "n", "err", "buy", "n_signals", "has_history")


@query("rules_evidence_list", f"""WITH {VAL_SQL} SELECT client, concat_ws(' | ', CASE WHEN f_value THEN concat('Valor médio: ', CASE WHEN value__change < 0 THEN '−' ELSE '+' END, replace(format('{{:.1f}}', abs(value__change)), '.', ','), ' R$ vs média anterior') END,
   CASE WHEN f_n THEN concat('Eventos por dia: ', replace(format('{{:.1f}}', n__level), '.', ','), ' /dia') END, CASE WHEN f_err THEN concat('Erros: ', replace(format('{{:.1f}}', err__level), '.', ','), '%') END,
   CASE WHEN f_buy THEN concat('Última compra: ', replace(format('{{:.1f}}', buy__level), '.', ','), ' R$') END) AS evidence FROM h WHERE k = 1""")
def evidence(spark, sf):
    v = values(spark, sf).filter("k = 1")
    return v.select("client", F.array_join(rl.evidence_list(v, SIGNALS, LIMITS), " | ").alias("evidence"))


@query("rules_detection_rate", f"WITH {VAL_SQL} SELECT cancelled, {rs('100.0::DOUBLE*avg(CASE WHEN n_signals >= 2 THEN 1 ELSE 0 END)')} AS pct, count(*) FILTER (n_signals >= 2) AS n FROM h WHERE k = 1 GROUP BY 1")
def detection(spark, sf):
    return rl.detection_rate(history(spark, sf).filter("k = 1"), F.col("n_signals") >= 2).withColumn("pct", rd("pct"))


EP_SQL = f"""{E_SQL}, r AS (SELECT client, cancelled, -k AS rel, coalesce(n <= 1, false) AS side, row_number() OVER (PARTITION BY client ORDER BY -k) AS rn FROM e_pan WHERE has_data),
  s AS (SELECT *, rn - row_number() OVER (PARTITION BY client, side ORDER BY rel) AS grp, max(rel) OVER (PARTITION BY client) AS last_rel FROM r),
  ep AS (SELECT client, cancelled, min(rel) AS "start", max(rel) AS "end", count(*) AS length, max(rel) = max(last_rel) AS ongoing FROM s WHERE side GROUP BY client, cancelled, grp)"""


def ep_rows(spark, sf):
    return e_panel(spark, sf).filter("has_data").withColumn("rel", -F.col("k"))


@query("rules_episodes", f'WITH {EP_SQL} SELECT client, cancelled, "start", "end", length, ongoing FROM ep')
def episodes(spark, sf):
    return rl.episodes(ep_rows(spark, sf), st.on_risk_side(F.col("n"), 1.0, -1), extra=["cancelled"])


@query("rules_run_at_k", f"WITH {EP_SQL}, d AS (SELECT DISTINCT client FROM r) SELECT d.client, CAST(coalesce(length, 0) AS INTEGER) AS run FROM d LEFT JOIN ep ON ep.client = d.client AND \"end\" = -1")
def run_at(spark, sf):
    return rl.run_at_k(ep_rows(spark, sf), st.on_risk_side(F.col("n"), 1.0, -1))


@query("rules_recovery_summary", f"""WITH {EP_SQL} SELECT count(DISTINCT client) FILTER (NOT cancelled) AS active_ever, count(DISTINCT client) FILTER (NOT cancelled AND NOT ongoing) AS active_recovered, count(DISTINCT client) FILTER (NOT cancelled AND ongoing) AS active_ongoing,
  count(DISTINCT client) FILTER (NOT cancelled AND ongoing AND length >= 2) AS active_ongoing_2, count(DISTINCT client) FILTER (cancelled AND ongoing) AS cancelled_at_exit, count(DISTINCT client) FILTER (cancelled AND ongoing AND length >= 2) AS cancelled_at_exit_2,
  median(length) FILTER (cancelled AND ongoing)::DOUBLE AS median_cancelled, median(length) FILTER (NOT cancelled AND NOT ongoing)::DOUBLE AS median_active FROM ep""")
def recovery(spark, sf):
    return rl.recovery_summary(rl.episodes(ep_rows(spark, sf), st.on_risk_side(F.col("n"), 1.0, -1), extra=["cancelled"]))


@query("rules_alert", f"WITH {VAL_SQL} SELECT client, k, alarm AS alert FROM ({alert_sql('h', RULE)})")
def alert(spark, sf):
    return rl.rule_alert(history(spark, sf), RULE, NAMES).select("client", "k", "alert")


MONTHS15 = "(count(*) FILTER (NOT cancelled) * 12)"


@query("rules_alert_performance", f"WITH {VAL_SQL}, {perf_sql(alert_sql('h', RULE), months=MONTHS15)} SELECT {', '.join(PERF)}, active_months_pct, median_lead FROM pf")
def alert_perf(spark, sf):
    d = rl.rule_performance(rl.rule_alert(history(spark, sf), RULE, NAMES), "alert")
    return d.withColumn("active_months_pct", rd("active_months_pct"))


@query("rules_alert_lead", f"WITH {VAL_SQL}, a AS ({alert_sql('h', RULE)}) SELECT client, CAST(coalesce(min(CASE WHEN NOT alarm THEN k END), max(k)+1) - 1 AS INTEGER) AS lead FROM a GROUP BY 1")
def alert_lead(spark, sf):
    return rl.lead_time(rl.rule_alert(history(spark, sf), RULE, NAMES), "alert")


BEST_SQL = f"""{AUC_TAB_SQL}, mn AS (SELECT signal, avg(auc) FILTER (form='level') AS level, avg(auc) FILTER (form='change') AS change FROM atab WHERE k <= 3 GROUP BY 1),
  bf AS (SELECT *, CASE WHEN change > level + 0.01 THEN 'change' ELSE 'level' END AS form FROM mn),
  bl AS (SELECT signal, CAST(coalesce(min(k) FILTER (NOT round(auc, 2) >= 0.8), max(k)+1) - 1 AS INTEGER) AS auc_lead, max(auc) FILTER (k=1) AS auc_k1, max(auc) FILTER (k=3) AS auc_k3 FROM atab JOIN bf USING (signal, form) GROUP BY 1)"""


@query("rules_best_form", f"WITH {BEST_SQL} SELECT signal, form, {rs('level')} AS level, {rs('change')} AS change, auc_lead, {rs('auc_k1')} AS auc_k1, {rs('auc_k3')} AS auc_k3 FROM bf JOIN bl USING (signal)")
def best(spark, sf):
    return rl.best_form(auc_table(spark, sf)).select("signal", "form", rd("level"), rd("change"), "auc_lead", rd("auc_k1"), rd("auc_k3"))


@query("rules_quadrants", f"WITH {VAL_SQL} SELECT cancelled, value__level <= 50 AS low, value__change <= 0 AS falling, count(*) AS clients FROM va WHERE k = 1 AND value__level IS NOT NULL AND value__change IS NOT NULL GROUP BY 1, 2, 3")
def quadrants(spark, sf):
    return rl.quadrants(values(spark, sf), "value", 50.0, 0.0)


@query("rules_grid", f"""WITH {VAL_SQL}, {perf_sql(' UNION ALL '.join(alert_sql('h', r, extra=f"'{r.name}' AS rule, ") for r in RULES), by='rule', months=MONTHS15)}
  SELECT rule, {', '.join(PERF)}, active_months_pct, median_lead FROM pf""")
def grid(spark, sf):
    return rl.rule_grid(history(spark, sf), RULES, NAMES).withColumn("active_months_pct", rd("active_months_pct"))


SENS = {"value": (8.0, 12.0), "n": (1.5, 2.5), "err": (0.25, 0.5)}


def _moved(sig: str, x: float) -> str:
    e = {"value": f"value__change >= {x}", "n": f"n__level <= {x}::DOUBLE", "err": f"err__level >= {x}::DOUBLE"}[sig]
    return f"(SELECT * REPLACE (coalesce({e}, false) AS f_{sig}) FROM h)"


SENS_SRC = " UNION ALL ".join([alert_sql("h", RULE, extra="'base' AS variant, ")] + [
    alert_sql(_moved(s, x), RULE, extra=f"'{s}={x:g}' AS variant, ") for s, xs in SENS.items() for x in xs])


@query("rules_sensitivity", f"WITH {VAL_SQL}, {perf_sql(SENS_SRC, by='variant', months=MONTHS15)} SELECT variant, {', '.join(PERF)}, active_months_pct, median_lead FROM pf")
def sensitivity(spark, sf):
    d = rl.sensitivity(values(spark, sf), SIGNALS, LIMITS, SENS, RULE, "value")
    return d.withColumn("active_months_pct", rd("active_months_pct"))


@query("rules_revenue_detected", f"""WITH {VAL_SQL}, {AMOUNT_SQL}, a AS ({alert_sql('h', RULE)}), c AS (SELECT client, amount, r AS k, coalesce(bool_or(alarm) FILTER (a.k = r), false) AS hit FROM a JOIN am USING (client), range(1, 4) t(r) WHERE cancelled GROUP BY 1, 2, 3)
  SELECT CAST(k AS INTEGER) AS k, {rs('coalesce(sum(amount) FILTER (hit), 0)', 2)} AS detected, {rs('coalesce(sum(amount) FILTER (NOT hit), 0)', 2)} AS missed, count(*) FILTER (hit) AS n_detected FROM c GROUP BY 1""")
def revenue(spark, sf):
    d = rl.revenue_detected(rl.rule_alert(history(spark, sf), RULE, NAMES), "alert", client_amounts(spark, sf), "amount")
    return d.select("k", rd("detected", 2), rd("missed", 2), "n_detected")


ONE = rl.Rule("value", 2, 1)


@query("rules_situation", f"""WITH {VAL_SQL}, a AS ({alert_sql('h', RULE)}), c AS ({alert_sql('h', ONE)})
  SELECT CASE WHEN a.alarm THEN 'Alerta (regra)' WHEN c.alarm THEN 'Condição só no último mês' WHEN n_signals >= 1 THEN '1 sinal isolado' ELSE 'Sem sinal' END AS situation, count(*) AS clients
  FROM h JOIN a USING (client, k) JOIN c USING (client, k) WHERE k = 1 AND NOT h.cancelled GROUP BY 1""")
def situation(spark, sf):
    d = rl.rule_alert(rl.rule_alert(history(spark, sf), RULE, NAMES), ONE, NAMES, out="cond").filter((F.col("k") == 1) & ~F.col("cancelled"))
    return d.groupBy(rl.situation(F.col("alert"), F.col("cond"), F.col("n_signals")).alias("situation")).agg(F.count(F.lit(1)).alias("clients"))


FINAL_SRC = " UNION ALL ".join([f"SELECT '{s}' AS signal, client, k, cancelled, true AS scorable, (f_{s} AND has_history) AS alarm FROM h" for s in NAMES] + [alert_sql("h", RULE, extra="'rule' AS signal, ")])


@query("rules_signal_table", f"""WITH {BEST_SQL}, {perf_sql(FINAL_SRC, by='signal', months=MONTHS15)}
  SELECT signal, {', '.join(PERF)}, active_months_pct, median_lead, form, {rs('auc_k1')} AS auc_k1, {rs('auc_k3')} AS auc_k3, auc_lead FROM pf LEFT JOIN bf USING (signal) LEFT JOIN bl USING (signal)""")
def signal_table(spark, sf):
    h = rl.rule_alert(history(spark, sf), RULE, NAMES)
    d = rl.signal_table(h, rl.best_form(auc_table(spark, sf)), LIMITS, "alert")
    return d.withColumns({c: rd(c) for c in ("active_months_pct", "auc_k1", "auc_k3")})


@query("rules_relative_quarter", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(-((l_linenumber - 1) // 3 + 1) AS INTEGER) AS quarter FROM lineitem")
def quarter(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", col.relative_quarter(-F.col("l_linenumber")).alias("quarter"))


__all__ = ["e_scored"]
