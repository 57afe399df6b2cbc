"""Exploratory comparison of clients who left with clients who stayed (no model involved)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import relative_quarter
from .stats import auc, keep, quantiles, spearman


def aligned(rows: DataFrame, clients: DataFrame, ref_m: int | Column, client: str = "client", m: str = "m") -> DataFrame:
    """Rows with status, exit, ``rel`` (month minus exit; active: exit = ref + 1) and ``rel_quarter``."""
    ref = F.lit(ref_m) if isinstance(ref_m, int) else ref_m
    d = rows.join(clients, client, "left")
    out = d.withColumn("exit_m", F.coalesce(F.col("exit_m"), ref + 1)).withColumn("rel", (F.col(m) - F.col("exit_m")).cast("int"))
    return out.withColumn("rel_quarter", relative_quarter(F.col("rel")))


def long_series(monthly: DataFrame, cols: Sequence[str], client: str = "client", m: str = "m",
                prefix: str = "") -> DataFrame:
    """(series, client, m, x) for several columns, so one job serves all of them."""
    items = F.array(*[F.struct(F.lit(prefix + c).alias("series"), F.col(c).cast("double").alias("x")) for c in cols])
    return (monthly.select(client, m, F.explode(items).alias("s")).select("s.series", client, m, "s.x")
            .filter(F.col("x").isNotNull()))


def moving_before_exit(series: DataFrame, clients: DataFrame, ref_m: int | Column, months: int = 12, window: int = 3,
                       client: str = "client", m: str = "m") -> DataFrame:
    """Moving mean over ``window`` calendar months at each rel = -months ... -1.

    Each value is sent to the ``window`` months it belongs to and averaged there, which gives the mean of a month
    without data too and needs no month grid.
    """
    ref = F.lit(ref_m) if isinstance(ref_m, int) else ref_m
    spread = (series.withColumn("__t", F.explode(F.sequence(F.col(m), F.col(m) + window - 1)))
              .groupBy("series", client, "__t").agg(F.avg("x").alias("x")))
    last = series.groupBy("series").agg(F.max(m).alias("__hi"))
    ends = clients.select(client, "cancelled", F.coalesce(F.col("exit_m"), ref + 1).alias("__fin"))
    d = spread.join(F.broadcast(last), "series").filter(F.col("__t") <= F.col("__hi")).join(ends, client)  # one row per series
    return (d.withColumn("rel", (F.col("__t") - F.col("__fin")).cast("int")).filter(F.col("rel").between(-months, -1))
            .select("series", client, "cancelled", "rel", "x"))


def compare_before_exit(series: DataFrame, clients: DataFrame, ref_m: int | Column, months: int = 12,
                        window: int = 3, client: str = "client", m: str = "m") -> tuple[DataFrame, DataFrame]:
    """(points, summary). Points: quartiles and n per series, rel and group. Summary: AUC at -1 and lead, most
    separated series first."""
    d = keep(moving_before_exit(series, clients, ref_m, months, window, client, m))   # read by quantiles and AUC
    q = quantiles(d, "x", [0.25, 0.5, 0.75], ["p25", "med", "p75"], ["series", "rel", "cancelled"])

    def side(flag: bool, p: str) -> list[Column]:
        pick = F.col("cancelled") if flag else ~F.col("cancelled")
        return [F.max(F.when(pick, F.col(c))).alias(f"{p}_{c}") for c in ("med", "p25", "p75", "n")]

    points = keep(q.groupBy("series", "rel").agg(*side(True, "c"), *side(False, "a")))   # series x months rows
    both = points.groupBy("series").agg((F.count("c_med") > 0).alias("__c"), (F.count("a_med") > 0).alias("__a"))
    both = both.filter(F.col("__c") & F.col("__a")).select("series")
    points = points.join(both, "series", "left_semi")
    area = auc(d.filter("rel = -1"), "cancelled", "x", ["series"]).select("series", "auc")
    summary = (separation_lead(points, months).join(area, "series", "left")
               .select("series", F.coalesce("auc", F.lit(0.5)).alias("auc"), "lead"))
    return points, summary.orderBy(F.desc(F.abs(F.col("auc") - 0.5)), "series")


def separation_lead(points: DataFrame, months: int = 12) -> DataFrame:
    """Largest k with the cancelled median outside the active quartiles at every rel -1 ... -k (null when none)."""
    apart = F.coalesce((F.col("c_med") < F.col("a_p25")) | (F.col("c_med") > F.col("a_p75")), F.lit(False))
    w = W.partitionBy("series").orderBy(F.desc("rel"))
    d = points.withColumn("__rn", F.row_number().over(w)).withColumn("__bad", ~apart | (F.col("rel") != -F.col("__rn")))
    n = F.coalesce(F.min(F.when(F.col("__bad"), F.col("__rn"))), F.count(F.lit(1)) + 1) - 1
    return d.groupBy("series").agg(F.nullif(n.cast("int"), F.lit(0)).alias("lead"))


def group_sizes(series: DataFrame, clients: DataFrame, ref_m: int | Column, **kw) -> DataFrame:
    """Clients with any value in the compared months, per group."""
    d = moving_before_exit(series, clients, ref_m, **kw)
    return d.agg(F.countDistinct(F.when(F.col("cancelled"), F.col("client"))).alias("cancelled_clients"),
                 F.countDistinct(F.when(~F.col("cancelled"), F.col("client"))).alias("active_clients"))


def relative_profile(rows: DataFrame, cols: Sequence[str], lo: int = -12, hi: int = -1) -> DataFrame:
    """Median, quartiles, mean and n per metric, status and relative month."""
    items = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in cols])
    d = (rows.filter(F.col("rel").between(lo, hi)).select("cancelled", "rel", F.explode(items).alias("s"))
         .select("cancelled", "rel", "s.metric", "s.x"))
    key = ["metric", "cancelled", "rel"]
    q = quantiles(d, "x", [0.5, 0.25, 0.75], ["median", "p25", "p75"], key)
    return q.join(d.groupBy(*key).agg(F.avg("x").alias("mean")), key)


def final_window_mean(rows: DataFrame, cols: Sequence[str], months: int = 3, client: str = "client") -> DataFrame:
    return (rows.filter(F.col("rel") >= -months).groupBy(client, "cancelled")
            .agg(*[F.avg(c).alias(c) for c in cols]))


def separation_auc(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AUC of each raw metric: above one half means larger among the cancelled."""
    items = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in cols])
    return auc(rows.select("cancelled", F.explode(items).alias("s")).select("cancelled", "s.metric", "s.x"),
               "cancelled", "x", ["metric"])


def smooth(rows: DataFrame, cols: Sequence[str], n: int = 3, client: str = "client", m: str = "m") -> DataFrame:
    """Trailing mean over the last ``n`` rows of the client (rows, not calendar months)."""
    w = W.partitionBy(client).orderBy(m).rowsBetween(-(n - 1), 0)
    return rows.withColumns({c: F.avg(F.col(c)).over(w) for c in cols})


def churn_by_attribute(clients: DataFrame, cols: Sequence[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("level")) for c in cols])
    d = clients.select("cancelled", F.explode(items).alias("s")).select("cancelled", "s.*").filter("level is not null")
    return d.groupBy("attribute", "level").agg(
        F.count(F.lit(1)).alias("clients"), F.count(F.when(F.col("cancelled"), 1)).alias("cancelled"),
        (100.0 * F.avg(F.col("cancelled").cast("double"))).alias("churn_pct"))


def exits_by_month(clients: DataFrame, first_m: int, last_m: int, amount: str) -> DataFrame:
    """Exits and lost value of every month, zero-filled, with the running total. The month list is bounded."""
    spark = clients.sparkSession
    months = spark.range(first_m, last_m + 1).select(F.col("id").cast("int").alias("exit_m"))
    per = clients.filter("cancelled").groupBy("exit_m").agg(F.count(F.lit(1)).alias("exits"), F.sum(amount).alias("lost"))
    d = months.join(per, "exit_m", "left").fillna(0)
    w = W.partitionBy(F.lit(1)).orderBy("exit_m")
    return d.withColumn("lost_total", F.sum("lost").over(w))


def response_by_quarter(surveys: DataFrame, responded: str, score: str) -> DataFrame:
    """Response rate and mean score by status and relative quarter."""
    return surveys.groupBy("cancelled", "rel_quarter").agg(
        (100.0 * F.avg(F.col(responded).cast("double"))).alias("rate"), F.avg(score).alias("score"),
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(responded), 1)).alias("responses"))


def crosstab(rows: DataFrame, row: str, col: str, levels: Sequence[str]) -> DataFrame:
    """Row-normalised shares and counts, one column pair per level."""
    known = F.count(F.col(col)).cast("double")
    return rows.groupBy(row).agg(*[F.count(F.when(F.col(col) == v, 1)).alias(f"n_{v}") for v in levels],
                                 *[(100.0 * F.try_divide(F.count(F.when(F.col(col) == v, 1)).cast("double"), known)).alias(f"pct_{v}")
                                   for v in levels])


def last_row(rows: DataFrame, order: Sequence[str], cols: Sequence[str], client: str = "client") -> DataFrame:
    return (rows.groupBy(client).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("__r"))
            .select(client, *[f"__r.{c}" for c in cols]))


def client_month_pivot(rows: DataFrame, value: str, months: Sequence[int], names: Sequence[str],
                       client: str = "client", m: str = "m") -> DataFrame:
    """Client by month matrix for a fixed list of months."""
    return rows.groupBy(client).agg(*[F.max(F.when(F.col(m) == t, F.col(value))).alias(n) for t, n in zip(months, names)])


def spearman_matrix(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Spearman correlation of every metric pair."""
    return spearman(rows, [], cols, pairwise=True)


def active_median_by_month(rows: DataFrame, cols: Sequence[str], m: str = "m") -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in cols])
    d = rows.filter(~F.col("cancelled")).select(m, F.explode(items).alias("s")).select(m, "s.*")
    return quantiles(d, "x", [0.5], ["median"], ["metric", m])


def portfolio_kpis(clients: DataFrame, amount: str) -> DataFrame:
    gone = F.col("cancelled")
    return clients.agg(
        F.count(F.lit(1)).alias("clients"), F.count(F.when(gone, 1)).alias("cancelled"),
        (100.0 * F.avg(gone.cast("double"))).alias("churn_pct"), F.sum(F.when(gone, F.col(amount))).alias("lost_value"),
        (100.0 * F.sum(F.when(gone, F.col(amount))) / F.nullif(F.sum(amount), F.lit(0.0))).alias("lost_value_pct"))


def selection_buckets(report: DataFrame, top: int = 28) -> DataFrame:
    """The most frequently selected candidates, classed by why they are in or out."""
    r = F.col("reason")
    group = (F.when(F.col("selected"), "Selecionada").when(r.startswith("selecionada em só"), "Instável entre dobras")
             .when(r.startswith("fora do limite"), "Fora do limite de variáveis")
             .when(r.startswith("escolhida"), "Abaixo de 60% das rodadas").otherwise("Outro motivo"))
    return (report.filter(F.col("frequency").isNotNull()).orderBy(F.desc("frequency"), F.desc("auc_oof"), "feature")
            .limit(top).withColumn("bucket", group))


def contribution_waterfall(explanation: DataFrame, queue: DataFrame, intercept: float, top: int = 3,
                           client: str = "client") -> DataFrame:
    """Intercept, contributions by size and total for the first clients of the queue."""
    w = W.partitionBy(client).orderBy(F.desc(F.abs("contribution")), "feature")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    d = explanation.join(queue.filter(F.col("priority") <= top).select(client, "priority"), client)
    return d.select(client, "priority", "feature", "contribution", F.row_number().over(w).alias("step"),
                    (F.lit(intercept) + F.sum("contribution").over(upto)).alias("running"))
