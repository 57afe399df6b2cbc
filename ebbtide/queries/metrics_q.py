"""Queries: validation metrics on a fixed logistic risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as mt
from ..operators import stats as st
from .base import E_FEAT_SQL, e_labels, e_scored
from .registry import query
from .rounding import rd, rs
from .stats_q import FOLD_SQL

PERF = ["detected_k1", "detected_k2", "detected_k3", "active_now", "active_ever"]


def perf_sql(src: str, by: str = "", months: str = "sum(months) FILTER (NOT cancelled)", cut: str = "") -> str:
    b = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    return f"""x AS (SELECT *, coalesce(alarm, false) AND scorable AS a FROM ({src})),
  pc AS (SELECT {b}client, cancelled, bool_or(a AND k=1) AS k1, bool_or(a AND k=2) AS k2, bool_or(a AND k=3) AS k3,
    count(*) FILTER (scorable AND k <= 12) AS months, count(*) FILTER (a AND k <= 12) AS alarmed,
    coalesce(min(CASE WHEN NOT a THEN k END), max(k)+1) - 1 AS lead FROM x GROUP BY {b}client, cancelled),
  pf AS (SELECT {b}count(*) FILTER (cancelled AND k1) AS detected_k1, count(*) FILTER (cancelled AND k2) AS detected_k2, count(*) FILTER (cancelled AND k3) AS detected_k3,
    count(*) FILTER (NOT cancelled AND k1) AS active_now, count(*) FILTER (NOT cancelled AND alarmed > 0) AS active_ever,
    {rs(f'100.0::DOUBLE * sum(alarmed) FILTER (NOT cancelled) / nullif({months}, 0)')} AS active_months_pct,
    coalesce(median(lead) FILTER (cancelled AND lead > 0), 0)::DOUBLE AS median_lead FROM pc {g})"""


@query("metrics_alarm_performance", f"""WITH {E_FEAT_SQL}, {perf_sql("SELECT client, k, cancelled, scorable, p >= 0.3 AS alarm FROM e_risk")}
  SELECT detected_k1::BIGINT AS detected_k1, detected_k2, detected_k3, active_now, active_ever, active_months_pct, median_lead FROM pf""")
def performance(spark, sf):
    d = mt.alarm_performance(e_scored(spark, sf), F.col("p") >= 0.3)
    return d.withColumn("active_months_pct", rd("active_months_pct"))


@query("metrics_lead_time", f"""WITH {E_FEAT_SQL} SELECT client, CAST(coalesce(min(CASE WHEN NOT coalesce(p >= 0.25, false) THEN k END), max(k)+1) - 1 AS INTEGER) AS lead FROM e_risk GROUP BY 1""")
def lead(spark, sf):
    return mt.lead_time(e_scored(spark, sf), F.col("p") >= 0.25)


CURVE_SQL = f"""{E_FEAT_SQL}, cuts AS (SELECT round(i*0.01, 2)::DOUBLE AS cut FROM range(1, 96) t(i)),
  {perf_sql("SELECT cut, client, k, cancelled, scorable, p >= cut AS alarm FROM e_risk, cuts", by="cut")},
  ln AS (SELECT cut, count(*) FILTER (y=1 AND scorable AND p >= cut) AS tp, count(*) FILTER (y=0 AND scorable AND p >= cut) AS fp, count(*) FILTER (y=1) AS n1, count(*) FILTER (y=0) AS n0
    FROM e_risk, cuts WHERE train AND p IS NOT NULL GROUP BY 1),
  curve AS (SELECT pf.*, tp::DOUBLE/nullif(tp+fp, 0) AS "precision", tp::DOUBLE/n1 AS recall, fp::DOUBLE/n0 AS fpr, tp::DOUBLE/n1 - fp::DOUBLE/n0 AS youden FROM pf JOIN ln USING (cut))"""


@query("metrics_threshold_curve", f"""WITH {CURVE_SQL} SELECT cut, {', '.join(PERF)}, active_months_pct, median_lead,
  {rs('"precision"')} AS "precision", {rs('recall')} AS recall, {rs('fpr')} AS fpr, {rs('youden')} AS youden FROM curve""")
def curve(spark, sf):
    d = mt.threshold_curve(e_scored(spark, sf))
    return d.withColumns({c: rd(c) for c in ("active_months_pct", "precision", "recall", "fpr", "youden")})


@query("metrics_choose_cutoffs", f"""WITH {CURVE_SQL}, b AS (SELECT coalesce(min(cut) FILTER ("precision" >= 0.5), arg_min(cut, struct_pack(a := -"precision", b := cut)) FILTER ("precision" IS NOT NULL)) AS high,
    max(cut) FILTER (abs(youden - top) <= 1e-8 + 1e-5*abs(top)) AS youden FROM curve, (SELECT max(youden) AS top FROM curve))
  SELECT high, CASE WHEN youden < high THEN youden ELSE round_even(high/2, 2) END AS watch, youden FROM b""")
def cutoffs(spark, sf):
    return mt.choose_cutoffs(mt.threshold_curve(e_scored(spark, sf)))


@query("metrics_risk_band", f"""WITH {E_FEAT_SQL} SELECT CASE WHEN p >= 0.4 THEN 'alto' WHEN p >= 0.25 THEN 'atencao' ELSE 'baixo' END AS band, count(*) AS n, count(*) FILTER (cancelled) AS cancelled
  FROM e_risk WHERE scorable GROUP BY 1""")
def band(spark, sf):
    d = e_scored(spark, sf).filter("scorable")
    return d.groupBy(mt.risk_band(F.col("p"), 0.4, 0.25).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("cancelled"), 1)).alias("cancelled"))


@query("metrics_auc_by_k", f"""WITH {E_FEAT_SQL}, s AS (SELECT k, 'p' AS score, p AS v, cancelled FROM e_risk WHERE scorable AND k <= 6 UNION ALL SELECT k, 'value__last', value__last, cancelled FROM e_risk WHERE scorable AND k <= 6),
  r AS (SELECT *, rank() OVER (PARTITION BY k, score ORDER BY v) + (count(*) OVER (PARTITION BY k, score, v) - 1)/2.0 AS rk FROM s WHERE v IS NOT NULL)
  SELECT k, score, {rs("(sum(rk) FILTER (cancelled) - count(*) FILTER (cancelled)*(count(*) FILTER (cancelled)+1)/2.0)/nullif(count(*) FILTER (cancelled)::DOUBLE*count(*) FILTER (NOT cancelled), 0)")} AS auc,
    count(*) AS n, count(*) FILTER (cancelled) AS n_cancelled FROM r GROUP BY 1, 2""")
def auc_by_k(spark, sf):
    return mt.auc_by_k(e_scored(spark, sf), ["p", "value__last"]).withColumn("auc", rd("auc"))


@query("metrics_precision_at_top", f"""WITH {E_FEAT_SQL}, r AS (SELECT k, cancelled, row_number() OVER (PARTITION BY k ORDER BY p DESC, client) AS rn FROM e_risk WHERE scorable AND k <= 3 AND p IS NOT NULL)
  SELECT k, CAST(t AS INTEGER) AS top, count(*) FILTER (rn <= t AND cancelled) AS cancelled FROM r, (VALUES (10), (20)) v(t) GROUP BY 1, 2""")
def at_top(spark, sf):
    return mt.precision_at_top(e_scored(spark, sf), "p")


TWO_SQL = f"""{E_FEAT_SQL}, fd AS ({FOLD_SQL}), oof AS (SELECT 'a' AS model, fold, e.client, m, k, cancelled, scorable, train, y, p, amount FROM e_risk e JOIN fd USING (client)
   UNION ALL SELECT 'b', fold, e.client, m, k, cancelled, scorable, train, y, least(p + 0.02::DOUBLE * fold, 0.99::DOUBLE), amount FROM e_risk e JOIN fd USING (client)),
  ll AS (SELECT model, fold, avg(-(y*ln(p) + (1-y)*ln(1-p))) AS log_loss FROM oof WHERE train AND p IS NOT NULL GROUP BY 1, 2)"""


def two_models(spark, sf):
    f = st.assign_folds(e_labels(spark, sf), 5).select("client", "fold")
    d = st.keep(e_scored(spark, sf).join(f, "client"))
    other = F.least(F.col("p") + 0.02 * F.col("fold"), F.lit(0.99))
    return d.withColumn("model", F.lit("a")).unionByName(d.withColumn("model", F.lit("b")).withColumn("p", other))


@query("metrics_fold_log_loss", f"WITH {TWO_SQL} SELECT model, fold, {rs('log_loss')} AS log_loss FROM ll")
def fold_ll(spark, sf):
    return mt.fold_log_loss(two_models(spark, sf)).withColumn("log_loss", rd("log_loss"))


def _auc_sql(src, by, y, v):
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""(SELECT {b}(sum(rk) FILTER (yy) - count(*) FILTER (yy)*(count(*) FILTER (yy)+1)/2.0)/nullif(count(*) FILTER (yy)::DOUBLE*count(*) FILTER (NOT yy), 0) AS auc
    FROM (SELECT {b}{y} AS yy, rank() OVER ({part}ORDER BY {v}) + (count(*) OVER (PARTITION BY {b}{v}) - 1)/2.0 AS rk FROM {src} AND {v} IS NOT NULL) {'GROUP BY ' + by if by else ''})"""


@query("metrics_model_comparison", f"""WITH {TWO_SQL}, ar AS {_auc_sql('oof WHERE train', 'model', 'y = 1', 'p')}, ak AS {_auc_sql('oof WHERE scorable AND k <= 3', 'model, k', 'cancelled', 'p')},
  f AS (SELECT model, avg(log_loss) AS a, stddev_samp(log_loss)/sqrt(count(log_loss)) AS se FROM ll GROUP BY 1),
  po AS (SELECT model, avg(-(y*ln(p) + (1-y)*ln(1-p))) AS pooled FROM oof WHERE train AND p IS NOT NULL GROUP BY 1)
  SELECT model, {rs('any_value(a)')} AS log_loss, {rs('any_value(se)')} AS log_loss_se, {rs('any_value(pooled)')} AS log_loss_pooled, {rs('any_value(ar.auc)')} AS auc_rows,
   {rs('max(ak.auc) FILTER (k=1)')} AS auc_k1, {rs('max(ak.auc) FILTER (k=2)')} AS auc_k2, {rs('max(ak.auc) FILTER (k=3)')} AS auc_k3
  FROM f JOIN po USING (model) JOIN ar USING (model) JOIN ak USING (model) GROUP BY 1""")
def comparison(spark, sf):
    d = mt.model_comparison(two_models(spark, sf))
    return d.select("model", *[rd(c) for c in d.columns if c != "model"])


@query("metrics_paired_difference", f"""WITH {TWO_SQL}, d AS (SELECT fold, max(log_loss) FILTER (model='a') AS a, max(log_loss) FILTER (model='b') AS b FROM ll GROUP BY 1)
  SELECT {rs('avg(a)')} AS mean_a, {rs('avg(b)')} AS mean_b, {rs('avg(a-b)')} AS difference, {rs('stddev_samp(a-b)/sqrt(count(*))')} AS se,
   abs(avg(a-b)) > stddev_samp(a-b)/sqrt(count(*)) AS clear FROM d""")
def paired(spark, sf):
    d = mt.paired_diff(mt.fold_log_loss(two_models(spark, sf)), "a", "b")
    return d.withColumns({c: rd(c) for c in ("mean_a", "mean_b", "difference", "se")})


@query("metrics_queue_quality", f"""WITH {E_FEAT_SQL}, q AS (SELECT cancelled, amount, row_number() OVER (ORDER BY p*amount*12 DESC, client) AS r FROM e_risk WHERE k = 1 AND scorable AND p*amount IS NOT NULL),
  v AS (SELECT sum(amount) FILTER (cancelled) AS t FROM q)
  SELECT count(*) AS queue_clients, count(*) FILTER (cancelled) AS queue_cancelled, round(max(t), 2) AS cancelled_value,
   count(*) FILTER (cancelled AND r <= 10) AS cancelled_top10, count(*) FILTER (cancelled AND r <= 20) AS cancelled_top20, count(*) FILTER (cancelled AND r <= 50) AS cancelled_top50,
   round(100*coalesce(sum(amount) FILTER (cancelled AND r <= 10), 0)/max(t), 1) AS value_top10_pct, round(100*coalesce(sum(amount) FILTER (cancelled AND r <= 20), 0)/max(t), 1) AS value_top20_pct,
   round(100*coalesce(sum(amount) FILTER (cancelled AND r <= 50), 0)/max(t), 1) AS value_top50_pct, CAST(median(r) FILTER (cancelled) AS DOUBLE) AS median_position FROM q, v""")
def quality(spark, sf):
    return mt.queue_quality(e_scored(spark, sf))


PER_FOLD_SQL = f"""{TWO_SQL}, q AS (SELECT model, fold, cancelled, row_number() OVER (PARTITION BY model, fold ORDER BY p*amount*12 DESC, client) AS r, count(*) OVER (PARTITION BY model, fold) AS n
    FROM oof WHERE k = 1 AND scorable AND p*amount IS NOT NULL),
  pfm AS (SELECT model, fold, 'log_loss' AS metric, log_loss AS v FROM ll UNION ALL SELECT model, fold, 'auc_rows', auc FROM {_auc_sql('oof WHERE train', 'model, fold', 'y = 1', 'p')}
   UNION ALL SELECT model, fold, concat('auc_k', k), auc FROM {_auc_sql('oof WHERE scorable AND k <= 3', 'model, fold, k', 'cancelled', 'p')}
   UNION ALL SELECT model, fold, 'recall_top10pct_queue', count(*) FILTER (cancelled AND r <= greatest(1, round_even(0.1*n, 0)))::DOUBLE / greatest(1, count(*) FILTER (cancelled)) FROM q GROUP BY 1, 2)"""


@query("metrics_per_fold", f"WITH {PER_FOLD_SQL} SELECT fold, metric, {rs('v')} AS value FROM pfm WHERE model = 'a'")
def per_fold(spark, sf):
    return mt.per_fold(two_models(spark, sf).filter("model = 'a'")).withColumn("value", rd("value"))


ARMS_SQL = f"""{PER_FOLD_SQL}, w AS (SELECT fold, metric, max(v) FILTER (model='a') AS a, max(v) FILTER (model='b') AS b FROM pfm GROUP BY 1, 2),
  arms AS (SELECT metric, avg(a) AS mean_a, avg(b) AS mean_b, avg(b-a) AS difference, CASE WHEN count(b-a) > 1 THEN stddev_samp(b-a)/sqrt(count(b-a)) END AS se FROM w GROUP BY 1)"""


@query("metrics_compare_arms", f"""WITH {ARMS_SQL} SELECT metric, {rs('mean_a')} AS mean_a, {rs('mean_b')} AS mean_b, {rs('difference')} AS difference, {rs('se')} AS se,
  coalesce(abs(difference) > se, false) AS clear FROM arms""")
def arms(spark, sf):
    d = two_models(spark, sf)
    out = mt.compare_arms(d.filter("model = 'a'"), d.filter("model = 'b'"))
    return out.withColumns({c: rd(c) for c in ("mean_a", "mean_b", "difference", "se")})


@query("metrics_arm_verdict", f"""WITH {ARMS_SQL} SELECT {rs('difference')} AS difference, {rs('se')} AS se,
  CASE WHEN abs(difference) > se AND difference < 0 THEN 'melhora' WHEN abs(difference) > se AND difference > 0 THEN 'piora' ELSE 'não muda' END AS verdict FROM arms WHERE metric = 'log_loss'""")
def verdict(spark, sf):
    d = two_models(spark, sf)
    out = mt.arm_verdict(mt.compare_arms(d.filter("model = 'a'"), d.filter("model = 'b'")))
    return out.withColumns({c: rd(c) for c in ("difference", "se")})


@query("metrics_order_only_arm", f"""WITH {E_FEAT_SQL} SELECT client, m, {rs('CASE WHEN p IS NOT NULL THEN least(p + greatest(coalesce(p - lag(p) OVER (PARTITION BY client ORDER BY m), 0), 0), 1) END')} AS p_order FROM e_risk""")
def order_only(spark, sf):
    return mt.order_only_arm(e_scored(spark, sf)).select("client", "m", rd("p_order"))


@query("metrics_by_method", f"""WITH {E_FEAT_SQL}, {perf_sql("SELECT 'alto' AS method, client, k, cancelled, scorable, p >= 0.4 AS alarm FROM e_risk UNION ALL SELECT 'alto_ou_atencao', client, k, cancelled, scorable, p >= 0.25 FROM e_risk UNION ALL SELECT 'melhor_variavel', client, k, cancelled, scorable, n__level <= 2 FROM e_risk", by="method")}
  SELECT method, {', '.join(PERF)}, active_months_pct, median_lead FROM pf""")
def by_method(spark, sf):
    d = mt.performance_by_method(e_scored(spark, sf), {"alto": F.col("p") >= 0.4, "alto_ou_atencao": F.col("p") >= 0.25, "melhor_variavel": F.col("n__level") <= 2})
    return d.withColumn("active_months_pct", rd("active_months_pct"))


@query("metrics_fold_stability", f"""WITH {E_FEAT_SQL}, fd AS ({FOLD_SQL}), w AS (SELECT fold, feature, corr(v, y) AS weight FROM (SELECT fold, y, unnest(['value__level', 'err__level', 'n__level']) AS feature,
     unnest([value__level, err__level, n__level]) AS v FROM e_feat JOIN fd USING (client) WHERE train) GROUP BY 1, 2)
  SELECT feature, {rs('count(DISTINCT fold)/5.0')} AS fold_share, {rs('min(weight)')} AS min_weight, {rs('max(weight)')} AS max_weight FROM w WHERE weight > 0 GROUP BY 1""")
def stability(spark, sf):
    f = st.assign_folds(e_labels(spark, sf), 5).select("client", "fold")
    d = mt.stack_scores(e_scored(spark, sf).join(f, "client").filter("train"), ["value__level", "err__level", "n__level"], ["fold", "y"])
    w = d.groupBy("fold", F.col("score").alias("feature")).agg(F.corr("value", F.col("y").cast("double")).alias("weight")).filter("weight > 0")
    return mt.fold_stability(w, 5).select("feature", rd("fold_share"), rd("min_weight"), rd("max_weight"))
