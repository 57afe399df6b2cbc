"""Queries: queue, explanation and reports on the fixed logistic risk of the events base."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explain as xp
from ..operators import explore as ex
from ..operators import features as ft
from ..operators import metrics as mt
from ..operators import outputs as ou
from ..operators import queue as qu
from ..operators import reports as rp
from ..operators import stats as st
from ..operators.features import Feature
from .base import E_FEAT_SQL, E_REF, E_SQL, e_activity, e_panel, e_rows, e_scored
from .metrics_q import perf_sql
from .registry import query, table
from .rounding import rd, rs

HIGH, WATCH = 0.4, 0.25

QUEUE_SQL = f"""{E_FEAT_SQL}, dl AS (SELECT *, CASE WHEN lag(m) OVER w = m - 1 THEN p - lag(p) OVER w END AS risk_delta FROM e_risk WINDOW w AS (PARTITION BY client ORDER BY m)),
  q0 AS (SELECT client, m, p AS risk, amount AS monthly_value, CASE WHEN p >= {HIGH} THEN 'alto' WHEN p >= {WATCH} THEN 'atencao' ELSE 'baixo' END AS band, risk_delta, CASE WHEN p IS NOT NULL THEN least(p + greatest(coalesce(risk_delta, 0), 0), 1) END AS adjusted_risk,
     p*amount*12 AS expected_loss, least(p + greatest(coalesce(risk_delta, 0), 0), 1)*amount*12 AS adjusted_loss FROM dl WHERE reference),
  q AS (SELECT *, row_number() OVER (ORDER BY coalesce(round(adjusted_loss, 6), -1) DESC, risk DESC, client) AS priority FROM q0)"""


def unranked(spark, sf):
    return qu.build_queue(e_scored(spark, sf), HIGH, WATCH).withColumn("adjusted_loss", F.round("adjusted_loss", 6))


def ranked(spark, sf):
    return qu.rank_queue(unranked(spark, sf))


def with_attributes(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("client"), "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"))
    first = e_rows(spark, sf).groupBy("client").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("since"))
    d = ranked(spark, sf).join(c, "client", "left").join(first, "client", "left")
    return d.withColumn("attributes", F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("nation"))) \
            .withColumn("dates", F.create_map(F.lit("first_event"), F.col("since")))


@query("queue_scored_panel", f"WITH {E_FEAT_SQL} SELECT client, m, p FROM e_risk WHERE scorable")
def scored(spark, sf):
    return e_scored(spark, sf).filter("scorable").select("client", "m", "p")


@query("queue_expected_loss", f"WITH {E_FEAT_SQL} SELECT client, {rs('p*amount*12', 2)} AS expected_loss FROM e_risk WHERE reference")
def loss(spark, sf):
    d = e_scored(spark, sf).filter("reference")
    return d.select("client", rd(qu.expected_loss(F.col("p"), F.col("amount")), 2, "expected_loss"))


@query("queue_delta_prev_month", f"WITH {QUEUE_SQL} SELECT client, m, {rs('risk_delta')} AS risk_delta FROM dl")
def delta(spark, sf):
    return qu.delta_prev_month(e_scored(spark, sf)).select("client", "m", rd("risk_delta"))


@query("queue_adjusted_risk", f"WITH {QUEUE_SQL} SELECT client, {rs('adjusted_risk')} AS adjusted_risk, {rs('adjusted_loss', 2)} AS adjusted_loss FROM q")
def adjusted(spark, sf):
    return unranked(spark, sf).select("client", rd("adjusted_risk"), rd("adjusted_loss", 2))


@query("queue_priority", f"WITH {QUEUE_SQL} SELECT client, priority, band, {rs('risk')} AS risk, {rs('risk_delta')} AS risk_delta FROM q")
def priority(spark, sf):
    return ranked(spark, sf).select("client", "priority", "band", rd("risk"), rd("risk_delta"))


SCORE_SQL = """sc AS (SELECT *, 100*(2*risk + 1*(coalesce(monthly_value, 0)/vmax) + 0.5*((coalesce(risk_delta, 0) - lo)/(hi - lo)))/3.5 AS score
   FROM q, (SELECT max(monthly_value) AS vmax, least(min(risk_delta), 0) AS lo, greatest(max(risk_delta), 0) AS hi FROM q) z)"""
WEIGHTS = {"risk": 2, "value": 1, "delta": 0.5}


@query("queue_weighted_score", f"WITH {QUEUE_SQL}, {SCORE_SQL} SELECT client, {rs('score')} AS score FROM sc")
def score(spark, sf):
    return qu.weighted_score(unranked(spark, sf), WEIGHTS).select("client", rd("score"))


@query("queue_reorder", f"WITH {QUEUE_SQL}, {SCORE_SQL}, r AS (SELECT client, round(score, 1) AS score, risk FROM sc) SELECT client, score, row_number() OVER (ORDER BY score DESC, risk DESC, client) AS priority FROM r")
def reorder(spark, sf):
    return qu.reorder_queue(ranked(spark, sf), WEIGHTS).select("client", "score", "priority")


@query("queue_reorder_default", f"WITH {QUEUE_SQL} SELECT client, CAST(NULL AS DOUBLE) AS score, priority FROM q")
def reorder_default(spark, sf):
    return qu.reorder_queue(ranked(spark, sf), None).select("client", "score", "priority")


@query("queue_months_in_alert", f"""WITH {E_FEAT_SQL}, r AS (SELECT client, p >= {WATCH} AS hit, row_number() OVER (PARTITION BY client ORDER BY m DESC) AS rn FROM e_risk WHERE scorable)
  SELECT client, CAST(coalesce(min(rn) FILTER (NOT hit), count(*)+1) - 1 AS INTEGER) AS months_in_alert FROM r GROUP BY 1""")
def in_alert(spark, sf):
    return qu.months_in_alert(e_scored(spark, sf), WATCH)


# ---------------------------------------------------------------- explanation
def _f(i, table_, column, transform, label, **kw):
    return Feature(i, label, table_, column, transform, label, **kw)


META = {f.id: f for f in [
    _f("value__change", "events", "value", "change", "Valor médio"), _f("err__level", "events", "err", "level", "Erros", window=3),
    _f("n__change", "events", "n", "change", "Eventos"), _f("value__trend", "events", "value", "trend", "Valor médio", window=6)]}
FEATURES = list(META)
COEF, MEAN, SD = [0.9, 0.6, -0.8, 0.3], [0.0, 0.2, 0.0, 0.0], [40.0, 0.25, 1.5, 12.0]
LIMIT = {"value__change": 10.0, "err__level": 0.25, "n__change": -1.0, "value__trend": 5.0}
WAY = {"value__change": 1, "err__level": 1, "n__change": -1, "value__trend": 1}
ACTIONS = {"err": "Revisar a qualidade do serviço", "events.n": "Ligar para o cliente"}


def contributions():
    return F.array(*[F.lit(c) * (F.coalesce(F.col(f), F.lit(0.0)) - mu) / sd for f, c, mu, sd in zip(FEATURES, COEF, MEAN, SD)])


def explained(spark, sf, where="reference"):
    d = e_scored(spark, sf).filter(where).withColumn("contributions", contributions())
    return xp.explain(d, FEATURES, LIMIT, WAY)


EXPL_SQL = f"""{QUEUE_SQL}, ct AS (SELECT client, m, unnest(['value__change','err__level','n__change','value__trend']) AS feature, unnest([value__change, err__level, n__change, value__trend]) AS value,
     unnest([0.9::DOUBLE*coalesce(value__change, 0)/40, 0.6::DOUBLE*(coalesce(err__level, 0)-0.2::DOUBLE)/0.25::DOUBLE, -0.8::DOUBLE*coalesce(n__change, 0)/1.5::DOUBLE, 0.3::DOUBLE*coalesce(value__trend, 0)/12]) AS contribution,
     unnest([10.0::DOUBLE, 0.25, -1.0, 5.0]) AS threshold, unnest([1, 1, -1, 1]) AS direction FROM e_risk WHERE reference),
  ex AS (SELECT *, coalesce(CASE WHEN direction > 0 THEN value >= threshold ELSE value <= threshold END, false) AS passes, sum(greatest(contribution, 0)) OVER (PARTITION BY client) AS tot FROM ct),
  xf AS (SELECT *, contribution > 0 AND passes AS fires, contribution > 0 AND NOT passes AS secondary, CASE WHEN contribution > 0 THEN contribution/tot ELSE 0 END AS share FROM ex)"""


@query("explain_rows", f"WITH {EXPL_SQL} SELECT client, feature, {rs('value')} AS value, {rs('contribution')} AS contribution, threshold, passes, fires, secondary, {rs('share')} AS share FROM xf")
def explain_rows(spark, sf):
    return explained(spark, sf).select("client", "feature", rd("value"), rd("contribution"), "threshold", "passes", "fires", "secondary", rd("share"))


@query("explain_contributions", f"""WITH {E_FEAT_SQL} SELECT client, m, {rs('0.9::DOUBLE*coalesce(value__change, 0)/40 + 0.6::DOUBLE*(coalesce(err__level, 0)-0.2::DOUBLE)/0.25::DOUBLE - 0.8::DOUBLE*coalesce(n__change, 0)/1.5::DOUBLE + 0.3::DOUBLE*coalesce(value__trend, 0)/12')} AS logit FROM e_risk WHERE scorable""")
def logit(spark, sf):
    d = e_scored(spark, sf).filter("scorable")
    return d.select("client", "m", rd(F.aggregate(contributions(), F.lit(0.0), lambda a, c: a + c), 6, "logit"))


NUM = "replace(CASE WHEN abs({x} - round_even({x}, 0)) < 1e-9 OR abs({x}) >= 100 THEN translate(format('{{:,.0f}}', {x}), ',.', '.,') ELSE translate(format('{{:,.1f}}', {x}), ',.', '.,') END, '-', '−')"


@query("explain_evidence_text", f"""WITH {EXPL_SQL} SELECT client, feature, CASE WHEN value IS NULL THEN CASE feature WHEN 'err__level' THEN 'Erros' ELSE 'Eventos' END WHEN feature = 'err__level' THEN 'Erros alto' ELSE concat('Eventos ', CASE WHEN value < 0 THEN 'caiu' ELSE 'subiu' END) END AS title,
   CASE WHEN value IS NULL THEN concat(CASE feature WHEN 'err__level' THEN 'Erros' ELSE 'Eventos' END, ': sem dado (usada a mediana)')
     WHEN feature = 'err__level' THEN concat('Erros: ', replace({NUM.format(x='value')}, '−0,0', '0,0'), ' em média nos últimos 3 meses (limite ≥ 0,2)')
     ELSE concat('Eventos ', CASE WHEN value < 0 THEN 'caiu' ELSE 'subiu' END, ' ', {NUM.format(x='abs(value)')}, ' vs a média anterior do cliente; limite: queda de 1') END AS detail
  FROM xf WHERE feature IN ('err__level', 'n__change')""")
def text(spark, sf):
    d = xp.evidence_text(explained(spark, sf).filter(F.col("feature").isin("err__level", "n__change")), META)
    return d.select("client", "feature", "title", "detail")


ACT_SQL = f"""{EXPL_SQL}, ac AS (SELECT xf.*, band, CASE feature WHEN 'err__level' THEN 'Revisar a qualidade do serviço' WHEN 'n__change' THEN 'Ligar para o cliente' END AS action,
    CASE feature WHEN 'err__level' THEN 'Investigar erros' WHEN 'n__change' THEN 'Investigar eventos' ELSE 'Investigar valor médio' END AS inv, CASE WHEN fires THEN 0 ELSE 1 END AS tier FROM xf JOIN q USING (client)),
  bs AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY tier, action IS NULL, contribution DESC, feature) AS rn FROM ac WHERE fires OR (secondary AND band <> 'baixo')),
  act AS (SELECT q.client, coalesce(action, inv, 'Manter acompanhamento de rotina') AS action, feature AS dominant FROM q LEFT JOIN bs ON bs.client = q.client AND rn = 1)"""


@query("explain_suggested_action", f"WITH {ACT_SQL} SELECT client, action, dominant FROM act")
def action(spark, sf):
    return xp.suggest_action(explained(spark, sf), unranked(spark, sf), META, ACTIONS)


@query("explain_low_band_conflict", f"""WITH {EXPL_SQL} SELECT client, count(DISTINCT split_part(feature, '__', 1)) AS columns_firing FROM xf JOIN q USING (client) WHERE fires AND band <> 'x' GROUP BY 1 HAVING count(DISTINCT split_part(feature, '__', 1)) >= 2""")
def conflict(spark, sf):
    low = unranked(spark, sf).withColumn("band", F.lit("baixo"))
    return xp.inconsistent_low_band(explained(spark, sf), low, {f: META[f].column for f in FEATURES}, least=2)


@query("explain_waterfall", f"""WITH {EXPL_SQL} SELECT client, priority, feature, {rs('contribution')} AS contribution, CAST(row_number() OVER w AS INTEGER) AS step, {rs('-1.2::DOUBLE + sum(contribution) OVER (PARTITION BY client ORDER BY abs(contribution) DESC, feature)')} AS running
  FROM xf JOIN q USING (client) WHERE priority <= 3 WINDOW w AS (PARTITION BY client ORDER BY abs(contribution) DESC, feature)""")
def waterfall(spark, sf):
    d = ex.contribution_waterfall(explained(spark, sf), ranked(spark, sf), -1.2)
    return d.select("client", "priority", "feature", rd("contribution"), "step", rd("running"))


@query("explain_importance", f"WITH {EXPL_SQL} SELECT feature, {rs('avg(abs(contribution))')} AS importance FROM xf GROUP BY 1")
def importance(spark, sf):
    return explained(spark, sf).groupBy("feature").agg(rd(F.avg(F.abs("contribution")), 6, "importance"))


# ---------------------------------------------------------------- history and documents
@query("queue_monthly_values", f"""WITH {E_SQL} SELECT user_id AS client, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS m, {rs('avg(value)')} AS value, count(*)::DOUBLE AS registros,
   arg_max(event_type, ts) AS event_type FROM events WHERE ts < TIMESTAMP '2024-01-30' GROUP BY 1, 2""")
def monthly(spark, sf):
    d = qu.monthly_values(e_rows(spark, sf), ["value"], ["event_type"], order="ts")
    return d.select("client", "m", rd("value"), "registros", "event_type")


@query("queue_client_history", f"""WITH {E_FEAT_SQL} SELECT client, string_agg(concat(m, ':', round(p, 4), ':', n), '|' ORDER BY m) AS history FROM e_risk WHERE has_data GROUP BY 1""")
def history(spark, sf):
    vals = e_activity(spark, sf).select("client", "m", "n")
    d = qu.client_history(e_scored(spark, sf), vals, ["n"])
    text_ = F.transform("history", lambda h: F.concat_ws(":", h["m"].cast("string"), h["risk"].cast("string"), h["values"]["n"].cast("bigint").cast("string")))
    return d.select("client", F.array_join(text_, "|").alias("history"))


@query("queue_recent_vs_previous", f"""WITH {E_SQL}, r AS (SELECT client, value, row_number() OVER (PARTITION BY client ORDER BY m DESC) AS rn FROM e_obs WHERE value IS NOT NULL)
  SELECT client, 'value' AS series, {rs('avg(value) FILTER (rn <= 3)')} AS recent, {rs('avg(value) FILTER (rn BETWEEN 4 AND 9)')} AS previous, count(*) FILTER (rn <= 3) AS months_recent, count(*) FILTER (rn BETWEEN 4 AND 9) AS months_previous
  FROM r GROUP BY 1 HAVING count(*) FILTER (rn BETWEEN 4 AND 9) > 0""")
def recent(spark, sf):
    d = qu.recent_vs_previous(e_panel(spark, sf).filter("has_data"), ["value"])
    return d.select("client", "series", rd("recent"), rd("previous"), "months_recent", "months_previous")


@query("queue_summary", f"""WITH {QUEUE_SQL} SELECT count(*) AS active_clients, count(*) FILTER (band <> 'baixo') AS at_risk, count(*) FILTER (band = 'alto') AS high, count(*) FILTER (band = 'atencao') AS watch,
  round(sum(monthly_value) FILTER (band <> 'baixo'), 2) AS revenue_at_risk, round(coalesce(sum(monthly_value) FILTER (band = 'alto'), 0), 2) AS revenue_high, round(sum(expected_loss), 2) AS expected_loss_total FROM q""")
def summary(spark, sf):
    return qu.queue_summary(unranked(spark, sf))


@query("queue_page", f"WITH {QUEUE_SQL} SELECT client, priority, band FROM (SELECT * FROM q WHERE band IN ('alto', 'atencao') ORDER BY priority LIMIT 10 OFFSET 5)")
def page(spark, sf):
    return qu.queue_page(ranked(spark, sf), 10, 5, ["alto", "atencao"]).select("client", "priority", "band")


@query("queue_page_totals", f"WITH {QUEUE_SQL} SELECT count(*) AS total, count(*) FILTER (band = 'atencao') AS total_filtered FROM q")
def totals(spark, sf):
    return qu.page_totals(unranked(spark, sf), ["atencao"])


@query("queue_filters", f"""WITH {QUEUE_SQL}, f AS (SELECT user_id AS client, strftime(min(ts), '%Y-%m-%d') AS since FROM events WHERE ts < TIMESTAMP '2024-01-30' GROUP BY 1)
  SELECT q.client, priority FROM q JOIN customer ON c_custkey = q.client JOIN f ON f.client = q.client WHERE contains(CAST(q.client AS VARCHAR), '1') AND c_mktsegment = 'BUILDING' AND monthly_value >= 100 AND since >= '2024-01-01' AND band <> 'alto'""")
def filters(spark, sf):
    d = qu.queue_filters(with_attributes(spark, sf), search=" 1", attributes={"segment": "BUILDING"}, min_value=100, since={"first_event": "2024-01-01"})
    return d.filter("band <> 'alto'").select("client", "priority")


@query("queue_attribute_facets", f"""WITH {QUEUE_SQL}, s AS (SELECT DISTINCT unnest(['segment', 'nation']) AS attribute, unnest([c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS value FROM q JOIN customer ON c_custkey = client)
  SELECT attribute, value FROM s WHERE attribute IN (SELECT attribute FROM s GROUP BY 1 HAVING count(*) >= 2)""")
def facets(spark, sf):
    return qu.attribute_facets(with_attributes(spark, sf))


@query("queue_variation_class", f"""WITH {QUEUE_SQL}, v AS (SELECT client, risk, CASE WHEN client % 3 = 0 THEN NULL ELSE risk_delta END AS d, CASE WHEN client % 2 = 0 THEN risk - risk_delta END AS prev FROM q),
  w AS (SELECT client, coalesce(d*100, (risk - prev)*100) AS pp, CASE WHEN d IS NOT NULL THEN risk - d ELSE prev END AS b, d FROM v)
  SELECT client, CASE WHEN pp IS NULL THEN 'sem-dado' WHEN abs(round(pp, 6)) < 1 THEN 'igual' WHEN pp > 0 THEN 'pior' ELSE 'melhor' END AS variation, {rs('pp')} AS variation_pp, {rs('pp/b')} AS variation_rel,
   CASE WHEN d IS NOT NULL THEN 'motor' WHEN pp IS NOT NULL THEN 'historico' END AS variation_source FROM w""")
def variation(spark, sf):
    q = unranked(spark, sf)
    d = F.when(F.pmod("client", F.lit(3)) != 0, F.round("risk_delta", 8))
    prev = F.when(F.pmod("client", F.lit(2)) == 0, F.col("risk") - F.col("risk_delta"))
    out = qu.variation_class(F.col("risk"), d, F.round(prev, 8))
    return q.select("client", out["variation"].alias("variation"), rd(out["variation_pp"], 6, "variation_pp"), rd(out["variation_rel"], 6, "variation_rel"),
                    out["variation_source"].alias("variation_source"))


@query("queue_invariants", "SELECT unnest(['priority', 'band', 'risk_range', 'order', 'nan']) AS rule, 0::BIGINT AS violations")
def invariants(spark, sf):
    return qu.queue_invariants(ranked(spark, sf))


@query("queue_document", f"""WITH {ACT_SQL} SELECT q.client, q.priority, q.band, coalesce(string_agg(x.feature, ',' ORDER BY contribution DESC, x.feature) FILTER (fires), '') AS evidence,
   coalesce(string_agg(x.feature, ',' ORDER BY contribution DESC, x.feature) FILTER (secondary), '') AS secondary FROM q LEFT JOIN xf x ON x.client = q.client GROUP BY 1, 2, 3""")
def document(spark, sf):
    ev = xp.evidence_text(explained(spark, sf), META)
    d = rp.queue_document(ranked(spark, sf), ev)
    return d.select("client", "priority", "band", F.array_join(F.transform("evidence", lambda e: e["feature"]), ",").alias("evidence"),
                    F.array_join(F.transform("secondary_factors", lambda e: e["feature"]), ",").alias("secondary"))


@query("queue_document_json", f"""WITH {QUEUE_SQL} SELECT client, concat('{{"band":"', band, '","client":', client, ',"priority":', priority, '}}') AS doc FROM q""")
def document_json(spark, sf):
    d = ranked(spark, sf).select("client", "priority", "band")
    return d.select("client", rp.clean_json(d).alias("doc"))


@query("report_cancelled_list", f"""WITH {E_FEAT_SQL} SELECT client, exit_m, {', '.join(f"max(p) FILTER (k={k}) AS risk_k{k}, CASE WHEN max(p) FILTER (k={k}) >= {HIGH} THEN 'alto' WHEN max(p) FILTER (k={k}) >= {WATCH} THEN 'atencao' WHEN max(p) FILTER (k={k}) IS NOT NULL THEN 'baixo' END AS band_k{k}" for k in (1, 2, 3))}
  FROM e_risk WHERE cancelled GROUP BY 1, 2""")
def cancelled(spark, sf):
    return rp.cancelled_list(e_scored(spark, sf), HIGH, WATCH)


@query("report_run_summary", f"""WITH {QUEUE_SQL}, {perf_sql(f"SELECT client, k, cancelled, scorable, p >= {HIGH} AS alarm FROM e_risk")}
  SELECT 'r1' AS run_id, (SELECT count(*) FILTER (band = 'alto') FROM q) AS band_high, (SELECT count(*) FILTER (band = 'baixo') FROM q) AS band_low, detected_k1 AS detected_high_k1, active_now AS false_alarm_now, active_ever AS false_alarm_12m FROM pf""")
def run_summary(spark, sf):
    return summary_of(spark, sf, "r1", HIGH).select("run_id", "band_high", "band_low", "detected_high_k1", "false_alarm_now", "false_alarm_12m")


def summary_of(spark, sf, run, high):
    p = e_scored(spark, sf)
    perf = mt.performance_by_method(p, {"alto": F.col("p") >= high, "alto_ou_atencao": F.col("p") >= WATCH})
    stats = qu.queue_summary(qu.build_queue(p, high, WATCH))
    return rp.run_summary(run, stats, perf, mt.auc_by_k(p, ["p"], (1, 2, 3)), {"model": "logistic", "delta_feature": False})


@query("report_compare_runs", f"""WITH {QUEUE_SQL} SELECT 'band_high' AS metric, CAST(count(*) FILTER (risk >= 0.4) AS VARCHAR) AS r1, CAST(count(*) FILTER (risk >= 0.3) AS VARCHAR) AS r2 FROM q
  UNION ALL SELECT 'band_low', CAST(count(*) FILTER (risk < {WATCH}) AS VARCHAR), CAST(count(*) FILTER (risk < {WATCH}) AS VARCHAR) FROM q UNION ALL SELECT 'model', 'logistic', 'logistic'""")
def compare_runs(spark, sf):
    runs = summary_of(spark, sf, "r1", 0.4).unionByName(summary_of(spark, sf, "r2", 0.3))
    return rp.compare_runs(runs, ["r1", "r2"], ["model", "band_high", "band_low"]).drop("position")


RUNS_SQL = """runs AS (SELECT CAST(o_custkey AS VARCHAR) AS base_id, o_orderkey AS run_id, o_orderdate AS created, CASE o_orderstatus WHEN 'P' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'treinando' ELSE 'na_fila' END ELSE 'pronta' END AS state,
    o_orderkey % 4 = 1 AND o_orderstatus <> 'P' AS active, CAST(o_orderkey % 100 AS BIGINT) AS n_clients FROM orders)"""


def runs(spark, sf):
    o = table(spark, sf, "orders")
    state = F.when(F.col("o_orderstatus") == "P", F.when(F.pmod("o_orderkey", F.lit(5)) == 0, "treinando").otherwise("na_fila")).otherwise("pronta")
    return o.select(F.col("o_custkey").cast("string").alias("base_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("created"), state.alias("state"),
                    ((F.pmod("o_orderkey", F.lit(4)) == 1) & (F.col("o_orderstatus") != "P")).alias("active"), F.pmod("o_orderkey", F.lit(100)).alias("n_clients"))


@query("report_run_listing", f"WITH {RUNS_SQL} SELECT base_id, run_id, state, active FROM runs")
def run_listing(spark, sf):
    return rp.list_runs(runs(spark, sf)).select("base_id", "run_id", "state", "active")


@query("report_current_runs", f"""WITH {RUNS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY CASE WHEN state='treinando' THEN 0 WHEN state='na_fila' THEN 1 WHEN active THEN 2 ELSE 3 END, created DESC, run_id) AS rn, count(*) OVER (PARTITION BY base_id) AS n_runs FROM runs)
  SELECT CAST(c_custkey AS VARCHAR) AS base_id, run_id, coalesce(state, 'inspecionada') AS state, n_clients, coalesce(n_runs, 0) AS n_runs FROM customer LEFT JOIN p ON base_id = CAST(c_custkey AS VARCHAR) AND rn = 1""")
def current(spark, sf):
    bases = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("base_id"))
    return rp.current_runs(bases, runs(spark, sf))


@query("report_top_features", """WITH w AS (SELECT o_orderpriority AS run_id, o_orderkey AS feature, o_totalprice AS weight, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders)
  SELECT run_id, feature, weight, CAST(position AS INTEGER) AS position FROM w WHERE position <= 5""")
def top_features(spark, sf):
    w = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("run_id"), F.col("o_orderkey").alias("feature"), F.col("o_totalprice").alias("weight"))
    return rp.top_features(w)


# ---------------------------------------------------------------- what a run leaves behind
def run_rows(spark, sf):
    """The series behind two features of the events table, next to the risk of every month with data."""
    dated = {"events": e_rows(spark, sf)}
    names = ft.Names.of({"events": ["value"]})
    series = ou.model_series([names.feature("events", "value", "level", window=3), names.feature("events", ou.ROWS, "last")], dated)
    return ou.with_values(e_scored(spark, sf), ou.series_values(series, dated), "p"), series


@query("run_history", f"""WITH {E_FEAT_SQL} SELECT client, count(*) AS months, count(p) AS scored, min(m) AS first_m, max(m) AS last_m, sum(n)::DOUBLE AS events, {rs('sum(round(p, 4))')} AS risk FROM e_risk WHERE has_data GROUP BY 1""")
def run_history(spark, sf):
    rows, series = run_rows(spark, sf)
    d = ou.history(rows, series, "p").select("client", F.explode("history").alias("h"))
    return d.groupBy("client").agg(F.count(F.lit(1)).alias("months"), F.count("h.risk").alias("scored"), F.min("h.m").alias("first_m"), F.max("h.m").alias("last_m"),
                                   F.sum(F.col("h.values")["events.registros"]).alias("events"), rd(F.sum("h.risk"), alias="risk"))


@query("run_comparisons", f"""WITH {E_FEAT_SQL}, v AS (SELECT client, m, unnest(['value', 'events.registros']) AS series, unnest([value, n::DOUBLE]) AS x FROM e_risk WHERE has_data),
  o AS (SELECT *, row_number() OVER (PARTITION BY client, series ORDER BY m DESC) AS rn FROM v WHERE x IS NOT NULL)
  SELECT client, series, {rs('avg(x) FILTER (WHERE rn <= 3)')} AS recent, {rs('avg(x) FILTER (WHERE rn BETWEEN 4 AND 9)')} AS previous, count(*) FILTER (WHERE rn <= 3) AS months_recent, count(*) FILTER (WHERE rn BETWEEN 4 AND 9) AS months_previous
  FROM o GROUP BY 1, 2 HAVING count(*) > 3""")
def run_comparisons(spark, sf):
    return ou.comparisons(*run_rows(spark, sf)).select("client", "series", rd("recent"), rd("previous"), "months_recent", "months_previous")


__all__ = ["E_REF", "st"]
