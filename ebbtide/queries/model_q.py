"""Queries: supervised selection and models on the events base."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import Config
from ..operators import features as ft
from ..operators import models as mo
from ..operators import selection as se
from ..operators import stats as st
from ..plans.train import train
from ..operators.mapping import Mapping
from .base import E_FEAT_SQL, E_SQL, e_features, e_labels, e_scored
from .registry import query, table
from .rounding import rd, rs
from .schema_q import labelled_base

CFG = Config()
COLS = ["n__level", "n__last", "err__last", "buy6"]


def feature_meta():
    names, out = ft.Names.of({"events": ["value", "err", "n"]}), {}
    for c in ("value", "err", "n"):
        for t in ("level", "change", "trend", "last"):
            f = names.feature("events", c, t, window=3)
            out[f.id] = f
    return out


def train_rows(spark, sf):
    d = e_features(spark, sf).withColumn("buy6", F.round("buy", 6)).withColumn("n__level", F.round("n__level", 9)).withColumn("err__last", F.round("err__last", 9))
    return d.filter("train").withColumn("fold", F.pmod("client", F.lit(3)).cast("int"))


def cells(spark, sf):
    return st.keep(se.feature_cells(train_rows(spark, sf), COLS, 3))


LONG_SQL = f"""{E_FEAT_SQL}, lg AS (SELECT client, m, y, k, cancelled, CAST(client % 3 AS INTEGER) AS fold, unnest(['n__level','n__last','err__last','buy6']) AS feature, unnest([round(n__level, 9), n__last, round(err__last, 9), round(buy, 6)]) AS value FROM e_feat WHERE train),
  md AS (SELECT feature, median(value) AS med FROM lg GROUP BY 1), im AS (SELECT lg.* REPLACE (coalesce(value, med, 0) AS value) FROM lg JOIN md USING (feature))"""


@query("selection_null_and_mode", f"""WITH {LONG_SQL}, c AS (SELECT feature, value, count(*) AS n FROM lg GROUP BY 1, 2)
  SELECT feature, {rs('sum(n) FILTER (value IS NULL)::DOUBLE/sum(n)' .replace('sum(n) FILTER (value IS NULL)', 'coalesce(sum(n) FILTER (value IS NULL), 0)'))} AS null_share, {rs('max(n)::DOUBLE/sum(n)')} AS mode_share, count(value) AS "distinct" FROM c GROUP BY 1""")
def null_mode(spark, sf):
    return se.null_and_mode(cells(spark, sf)).select("feature", rd("null_share"), rd("mode_share"), "distinct")


@query("selection_medians", f"WITH {LONG_SQL} SELECT feature, {rs('med')} AS median FROM md")
def medians(spark, sf):
    return se.cell_medians(cells(spark, sf)).select("feature", rd("median"))


def auc_sql(src, by, y="y = 1"):
    return f"""SELECT {by}, (sum(rk) FILTER (yy) - count(*) FILTER (yy)*(count(*) FILTER (yy)+1)/2.0)/nullif(count(*) FILTER (yy)::DOUBLE*count(*) FILTER (NOT yy), 0) AS auc FROM (SELECT {by}, {y} AS yy,
    rank() OVER (PARTITION BY {by} ORDER BY value) + (count(*) OVER (PARTITION BY {by}, value) - 1)/2.0 AS rk FROM {src}) GROUP BY {by}"""


@query("selection_univariate_auc", f"""WITH {LONG_SQL}, a AS ({auc_sql('im', 'feature')}), a1 AS ({auc_sql('(SELECT * FROM im WHERE y = 0 OR k = 1)', 'feature')}), a2 AS ({auc_sql('(SELECT * FROM im WHERE y = 0 OR k >= 2)', 'feature')}),
  w0 AS ({auc_sql('(SELECT * FROM im WHERE fold <> 0)', 'feature')})
  SELECT a.feature, {rs('a.auc')} AS auc_in, {rs('a1.auc')} AS auc_k1, {rs('a2.auc')} AS auc_k2, {rs('w0.auc')} AS auc_wo_0 FROM a JOIN a1 USING (feature) JOIN a2 USING (feature) JOIN w0 USING (feature)""")
def univariate(spark, sf):
    c = cells(spark, sf)
    d = se.univariate_auc(se.impute_cells(c, se.cell_medians(c)), 3)
    return d.select("feature", rd("auc_in"), rd("auc_k1"), rd("auc_k2"), rd("auc_wo_0"))


@query("selection_out_of_fold_auc", f"""WITH {LONG_SQL}, ex AS (SELECT f.f AS left_out, im.* FROM im, range(0, 3) f(f) WHERE im.fold <> f.f), w AS ({auc_sql('ex', 'feature, left_out')}),
  o AS (SELECT im.feature, im.y, CASE WHEN coalesce(auc, 1) >= 0.5 THEN value ELSE -value END AS value FROM im JOIN w ON w.feature = im.feature AND w.left_out = im.fold), a AS ({auc_sql('o', 'feature')})
  SELECT feature, {rs('auc')} AS auc_oof FROM a""")
def oof(spark, sf):
    c = cells(spark, sf)
    i = st.keep(se.impute_cells(c, se.cell_medians(c)))
    return se.out_of_fold_auc(i, se.univariate_auc(i, 3), 3).select("feature", rd("auc_oof"))


@query("selection_client_level_auc", f"""WITH {E_SQL}, f AS (SELECT client, cancelled, row_number() OVER (PARTITION BY client ORDER BY m) AS rn FROM e_pan WHERE train), im AS (SELECT 'c_acctbal' AS feature, cancelled, c_acctbal AS value FROM f JOIN customer ON c_custkey = client WHERE rn = 1),
  a AS ({auc_sql('im', 'feature', 'cancelled')}) SELECT feature, {rs('auc')} AS auc_client FROM a""")
def client_auc(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("client"), "c_acctbal")
    return se.client_level_auc(train_rows(spark, sf).join(c, "client"), ["c_acctbal"]).select("feature", rd("auc_client"))


@query("selection_thresholds", f"""WITH {LONG_SQL}, g AS (SELECT -value AS s, y FROM lg WHERE feature = 'n__last'), c AS (SELECT DISTINCT s AS cut FROM g), t AS (SELECT sum(y) AS n1, sum(1-y) AS n0 FROM g),
  j AS (SELECT cut, sum(CASE WHEN s >= cut THEN y ELSE 0 END)::DOUBLE/max(n1) - sum(CASE WHEN s >= cut THEN 1-y ELSE 0 END)::DOUBLE/max(n0) AS j FROM g, c, t GROUP BY 1) SELECT 'n__last' AS feature, -arg_min(cut, struct_pack(a := -j, b := cut)) + 0.0 AS threshold FROM j""")
def thresholds(spark, sf):
    # whole-number values: the rounding step is one, so the tidy threshold is the raw one
    got = se.thresholds(train_rows(spark, sf), ["n__last"], {"n__last": -1})
    return spark.createDataFrame(list(got.items()), "feature string, threshold double")


@query("selection_client_sample", f"""WITH {E_SQL} SELECT exit_m IS NOT NULL AS cancelled, CAST(round_even(0.5*count(*), 0) AS BIGINT) AS clients FROM e_lab GROUP BY 1""")
def sample(spark, sf):
    return se.sample_clients(e_labels(spark, sf), 3, CFG).groupBy("cancelled").agg(F.count(F.lit(1)).alias("clients"))


@query("selection_standardised", f"""WITH {LONG_SQL}, s AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd FROM im GROUP BY 1) SELECT feature, {rs('mu')} AS mean, {rs('sd')} AS deviation FROM s WHERE feature <> 'buy6'""")
def standard(spark, sf):
    cols = COLS[:3]
    vec = se.vectors(train_rows(spark, sf), cols, {})
    _, mean, sd = se.standardised(vec)
    d = spark.createDataFrame(list(zip(cols, mean, sd)), "feature string, mean double, deviation double")
    return d.select("feature", rd("mean"), rd("deviation"))


@query("selection_rank_gram", f"""WITH {LONG_SQL}, r AS (SELECT client, m, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1)/2.0::DOUBLE AS rk FROM im)
  SELECT a.feature AS a, b.feature AS b, {rs('corr(a.rk, b.rk)', 4)} AS rho FROM r a JOIN r b ON a.client = b.client AND a.m = b.m AND a.feature < b.feature GROUP BY 1, 2""")
def rank_gram(spark, sf):
    rows = train_rows(spark, sf)
    med = {r["feature"]: r["median"] for r in se.cell_medians(cells(spark, sf)).collect()}
    names = sorted(COLS)
    rho = se.rank_correlation(rows, names, med)
    pairs = [(a, b, float(rho[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    return spark.createDataFrame(pairs, "a string, b string, rho double").select("a", "b", rd("rho", 4))


# ---------------------------------------------------------------- fits (rows only)
def panel(spark, sf):
    return st.materialize(e_features(spark, sf))


def candidates(spark, sf):
    return panel(spark, sf), feature_meta()


def fixed_selection(d, meta):
    """All given features with their univariate direction, without running the selection."""
    report = {c: {"feature": c, "reason": None, "leak": False} for c in meta}
    se._evaluate(d.filter("train"), list(meta), meta, CFG, 3, report)
    return se.Selection(report, list(meta), meta, 10, list(meta))


@query("selection_pre_select")
def pre_select(spark, sf):
    sel, _ = se.pre_select(panel(spark, sf), feature_meta(), CFG, 3)
    return se.report_frame(spark, sel)


@query("selection_stability")
def stability(spark, sf):
    d, meta = candidates(spark, sf)
    return se.report_frame(spark, se.stability_select(d, fixed_selection(d, meta), CFG))


@query("selection_shadows")
def shadows(spark, sf):
    d, meta = candidates(spark, sf)
    return se.report_frame(spark, se.shadow_select(d, fixed_selection(d, meta), CFG))


def scored_by(kind):
    def run(spark, sf):
        d, meta = candidates(spark, sf)
        sel = fixed_selection(d, meta)
        model = mo.fit_logistic(d, sel, CFG) if kind == "logistic" else mo.fit_trees(kind, d, sel, CFG)
        out = model.contributions(model.score(d).filter("scorable"))
        return out.select("client", "m", "p", F.aggregate("contributions", F.lit(model.intercept), lambda a, c: a + c).alias("logit"))
    return run


query("model_logistic")(scored_by("logistic"))
query("model_random_forest")(scored_by("random_forest"))
query("model_boosted_trees")(scored_by("boosted_trees"))


def rounded_margin(p, step=1e-4):
    """Log-odds of a probability rounded to whole steps; 0 and 1 stand for a quarter step from the end, the middle of what is rounded to them."""
    inside = F.least(F.greatest(p, F.lit(step / 4)), F.lit(1 - step / 4))
    return F.log(inside / (1 - inside))


@query("model_platt")
def platt(spark, sf):
    d = e_scored(spark, sf).filter("train")
    a, b = mo.platt(d.select("y", rounded_margin(F.col("p")).alias("margin")))
    return spark.createDataFrame([(a, b)], "a double, b double")


@query("train_events_queue")
def train_queue(spark, sf):
    """Whole plan on the labelled events base (months are too few, so the day of the event is the only period used
    by the other queries; here the panel is monthly)."""
    t = labelled_base(spark, sf)
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_totalprice", "o_orderpriority")
    last = o.groupBy("c_custkey").agg(F.max("o_orderdate").alias("last"), F.count(F.lit(1)).alias("n"))
    gone = F.col("last") < F.lit("2000-06-01").cast("date")
    status = last.select("c_custkey", F.when(gone, "Cancelado").otherwise("Ativo").alias("situacao"),
                         F.when(gone, F.date_format(F.add_months("last", 1), "yyyy-MM")).alias("mes_saida"))
    tables = {"clientes": table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "situacao": status, "pedidos": o, "uso": t["uso"].drop("ts")}
    m = Mapping("clientes", "c_custkey", "situacao", "situacao", "Cancelado", "mes_saida", "clientes", "c_acctbal")
    r = train(tables, m, replace(CFG, min_hist=2))
    return r.queue.select("client", "priority", "risk", "band", "action", "dominant")


# ---------------------------------------------------------------- reports over candidate tables
CAND_SQL = """cand AS (SELECT CAST(p_partkey AS VARCHAR) AS feature, CASE WHEN p_size % 7 <> 0 THEN (p_size % 11)/10.0::DOUBLE END AS frequency, p_retailprice/10000 AS auc_oof, p_partkey % 5 = 0 AS selected,
   CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 'selecionada em só 30% das dobras' WHEN p_partkey % 4 = 1 THEN 'fora do limite de 9 variáveis' WHEN p_partkey % 4 = 2 THEN 'escolhida em só 10% das rodadas' ELSE 'redundante' END AS reason,
   CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS direction FROM part)"""


def candidate_rows(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    m = F.pmod(k, F.lit(4))
    reason = (F.when(F.pmod(k, F.lit(5)) == 0, None).when(m == 0, "selecionada em só 30% das dobras").when(m == 1, "fora do limite de 9 variáveis")
              .when(m == 2, "escolhida em só 10% das rodadas").otherwise("redundante"))
    return p.select(k.cast("string").alias("feature"), F.when(F.pmod("p_size", F.lit(7)) != 0, F.pmod("p_size", F.lit(11)) / 10.0).alias("frequency"),
                    (F.col("p_retailprice") / 10000).alias("auc_oof"), (F.pmod(k, F.lit(5)) == 0).alias("selected"), reason.alias("reason"),
                    F.when(F.pmod(k, F.lit(2)) == 0, 1).otherwise(-1).alias("direction"))


@query("explore_selection_buckets", f"""WITH {CAND_SQL} SELECT feature, CASE WHEN selected THEN 'Selecionada' WHEN reason LIKE 'selecionada em só%' THEN 'Instável entre dobras' WHEN reason LIKE 'fora do limite%' THEN 'Fora do limite de variáveis'
   WHEN reason LIKE 'escolhida%' THEN 'Abaixo de 60% das rodadas' ELSE 'Outro motivo' END AS bucket FROM (SELECT * FROM cand WHERE frequency IS NOT NULL ORDER BY frequency DESC, auc_oof DESC, feature LIMIT 28)""")
def buckets(spark, sf):
    from ..operators.explore import selection_buckets
    return selection_buckets(candidate_rows(spark, sf)).select("feature", "bucket")


@query("report_feature_report", f"""WITH {CAND_SQL} SELECT feature, p_size::DOUBLE AS weight, coalesce(p_size, 0) IS NOT NULL AND p_partkey IS NOT NULL AS selected, CASE WHEN p_partkey IS NULL THEN coalesce(reason, 'retirada') END AS reason,
   CASE WHEN direction > 0 THEN 'maior = mais risco' ELSE 'menor = mais risco' END AS direction_text FROM cand LEFT JOIN (SELECT p_partkey, p_size FROM part WHERE p_brand = 'Brand#2') ON CAST(p_partkey AS VARCHAR) = feature""")
def feature_report(spark, sf):
    from ..operators.reports import feature_report as build
    w = table(spark, sf, "part").filter("p_brand = 'Brand#2'").select(F.col("p_partkey").cast("string").alias("feature"), F.col("p_size").cast("double").alias("weight"))
    return build(candidate_rows(spark, sf).drop("selected"), w).select("feature", "weight", "selected", "reason", "direction_text")


@query("selection_leak_flags", """SELECT 'fixed' AS feature, true AS leak UNION ALL SELECT 'last_day', true UNION ALL SELECT 'n__level', false""")
def leak_flags(spark, sf):
    """A client column filled only for leavers and a flag that shows on the last day before the exit."""
    d = st.materialize(e_features(spark, sf).withColumn("fixed", F.col("cancelled").cast("double") * (1 + F.pmod("client", F.lit(5))))
                       .withColumn("last_day", F.when(F.col("cancelled") & (F.col("k") == 1), 1.0).otherwise(0.0)))
    meta = {k: v for k, v in feature_meta().items() if k == "n__level"}
    meta["fixed"] = ft.Feature("fixed", "fixed", "t", "fixed", "static", "fixed", temporal=False)
    meta["last_day"] = ft.Feature("last_day", "last_day", "t", "last_day", "level", "last_day")
    report = {c: {"feature": c, "reason": None, "leak": False} for c in meta}
    se._evaluate(d.filter("train"), list(meta), meta, replace(CFG, leak_auc=0.98), 3, report)
    return spark.createDataFrame([(c, bool(r["leak"])) for c, r in report.items()], "feature string, leak boolean")


@query("validation_nested_oof")
def nested(spark, sf):
    from ..operators.validation import nested_oof
    d, meta = candidates(spark, sf)
    v = nested_oof(d, meta, CFG, 3, ["logistic"])
    return v.oof.join(v.baseline, ["client", "m"], "left").select("model", "client", "m", "fold", "p", "base_score", "base_alarm")


@query("model_two_stage")
def two_stage(spark, sf):
    d, meta = candidates(spark, sf)
    cfg = replace(CFG, delta_feature=True)
    model, wide, _ = mo.fit_two_stage("logistic", d, meta, cfg, 3)
    return model.score(model.prepare(wide).filter("scorable")).select("client", "m", "p", "risco_previsto__delta")
