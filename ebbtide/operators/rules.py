"""Rule-based signals: values up to -k, thresholds, episodes, alert rules and their performance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .features import dense_features, sparse_features
from .metrics import alarm_performance, lead_time
from .stats import auc, episodes, on_risk_side, run_length


@dataclass(frozen=True)
class Signal:
    name: str
    direction: int                 # +1: larger is riskier
    label: str
    unit: str = ""
    survey: bool = False           # rarely recorded: last answer instead of a window mean


@dataclass(frozen=True)
class Threshold:
    signal: str
    form: str                      # "level" or "change"
    value: float

    @property
    def column(self) -> str:
        return f"{self.signal}__{self.form}"


@dataclass(frozen=True)
class Rule:
    """Alert = (main signal, or at least ``min_others`` of the rest) for ``persistence`` months in a row."""
    main: str | None = None
    min_others: int = 2
    persistence: int = 1
    name: str = "rule"


def values_until(panel: DataFrame, signals: Sequence[Signal], window: int = 3, client: str = "client",
                 m: str = "m") -> DataFrame:
    """Level, baseline and change of each signal using only months up to -k, for every k at once.

    The panel has one row per client and month up to the exit, so "up to -k" is a trailing frame ending at the row
    with that k.
    """
    d = dense_features(panel, [s.name for s in signals if not s.survey], window, client=client, m=m)
    surveys = {s.name: 1 for s in signals if s.survey}
    if surveys:
        d = sparse_features(d, surveys, client, m)
        d = d.withColumns({f"{s}__level": F.col(f"{s}__last") for s in surveys})
    return d


def oriented_auc(values: DataFrame, signals: Sequence[Signal], ks: Sequence[int] = range(1, 7)) -> DataFrame:
    """AUC by signal, form and k with the direction fixed beforehand."""
    items = F.array(*[F.struct(F.lit(s.name).alias("signal"), F.lit(f).alias("form"),
                               (F.col(f"{s.name}__{f}") * s.direction).alias("x"))
                      for s in signals for f in ("level", "change")])
    d = values.filter(F.col("k").isin(*ks)).select("k", "cancelled", F.explode(items).alias("s")).select("k", "cancelled", "s.*")
    return auc(d, "cancelled", "x", ["signal", "form", "k"]).withColumnRenamed("n_pos", "n_cancelled")


def fires(t: Threshold, direction: int) -> Column:
    return on_risk_side(F.col(t.column), t.value, direction)


def firing_history(values: DataFrame, signals: Sequence[Signal], thresholds: Sequence[Threshold], main: str,
                   ks: int = 15) -> DataFrame:
    """One flag per threshold at each (client, k), their count and whether the client had data by then."""
    way = {s.name: s.direction for s in signals}
    d = values.filter(F.col("k").between(1, ks))
    d = d.withColumns({t.signal: fires(t, way[t.signal]) for t in thresholds} | {
        "has_history": F.col(f"{main}__level").isNotNull()})
    return d.withColumn("n_signals", sum((F.col(t.signal).cast("int") for t in thresholds), F.lit(0)))


def evidence_list(values: DataFrame, signals: Sequence[Signal], thresholds: Sequence[Threshold]) -> Column:
    """Texts of the fired signals as an array."""
    by = {s.name: s for s in signals}
    items = []
    for t in thresholds:
        s, x = by[t.signal], F.col(t.column)
        body = F.translate(F.format_number(F.abs(x), 1), ".,", ",")
        if t.form == "change":
            sign = F.when(x < 0, "−").otherwise("+")
            shown = F.concat(F.lit(f"{s.label}: "), sign, body, F.lit(f" {s.unit} vs média anterior"))
        else:
            shown = F.concat(F.lit(f"{s.label}: "), F.when(x < 0, "-").otherwise(""), body,
                             F.lit(s.unit if s.unit == "%" else (f" {s.unit}" if s.unit else "")))
        items.append(F.when(fires(t, s.direction), shown))
    return F.array_compact(F.array(*items))


def condition(rule: Rule, names: Sequence[str]) -> Column:
    others = [n for n in names if n != rule.main]
    count = sum((F.col(n).cast("int") for n in others), F.lit(0))
    ok = count >= rule.min_others
    return (F.col(rule.main) | ok) if rule.main else ok


def rule_alert(history: DataFrame, rule: Rule, names: Sequence[str], client: str = "client",
               out: str = "alert") -> DataFrame:
    """Add the alert: the condition holds at k, k + 1, ... for ``persistence`` consecutive evaluations."""
    w = W.partitionBy(client).orderBy("k")
    d = history.withColumn("__c", condition(rule, names) & F.col("has_history"))
    ok = F.col("__c")
    for j in range(1, rule.persistence):
        ok = ok & F.coalesce(F.lead("__c", j).over(w) & (F.lead("k", j).over(w) == F.col("k") + j), F.lit(False))
    return d.withColumn(out, ok).drop("__c")


def rule_performance(history: DataFrame, alert: Column | str, **kw) -> DataFrame:
    return alarm_performance(history.withColumn("scorable", F.lit(True)), alert, full_months=True, **kw)


def rule_grid(history: DataFrame, rules: Sequence[Rule], names: Sequence[str], client: str = "client") -> DataFrame:
    """Performance of several rules: every alert is a column of the same rows, stacked once for the aggregation."""
    d = history
    for i, r in enumerate(rules):
        d = rule_alert(d, r, names, client, out=f"__r{i}")
    items = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"__r{i}").alias("alert")) for i, r in enumerate(rules)])
    long = d.select(client, "k", "cancelled", F.explode(items).alias("s")).select(client, "k", "cancelled", "s.*")
    return rule_performance(long, "alert", by=["rule"])


def sensitivity(values: DataFrame, signals: Sequence[Signal], thresholds: Sequence[Threshold],
                neighbours: dict[str, Sequence[float]], rule: Rule, main: str, ks: int = 15) -> DataFrame:
    """Performance of the rule with one threshold moved at a time.

    Every variant differs in one flag only, so the base flags are computed once and each variant is one more
    boolean column before the single aggregation.
    """
    names = [t.signal for t in thresholds]
    hist = firing_history(values, signals, thresholds, main, ks)
    way = {s.name: s.direction for s in signals}
    d, labels = rule_alert(hist, rule, names, out="__v0"), ["base"]
    for t in thresholds:
        for x in neighbours.get(t.signal, ()):
            moved = fires(Threshold(t.signal, t.form, x), way[t.signal])
            labels.append(f"{t.signal}={x:g}")
            tmp = d.withColumn("__keep", F.col(t.signal)).withColumn(t.signal, moved)
            d = rule_alert(tmp, rule, names, out=f"__v{len(labels) - 1}").withColumn(t.signal, F.col("__keep")).drop("__keep")
    items = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(f"__v{i}").alias("alert")) for i, n in enumerate(labels)])
    long = d.select("client", "k", "cancelled", F.explode(items).alias("s")).select("client", "k", "cancelled", "s.*")
    return rule_performance(long, "alert", by=["variant"])


def detection_rate(history: DataFrame, alert: Column | str) -> DataFrame:
    a = F.coalesce(F.col(alert) if isinstance(alert, str) else alert, F.lit(False))
    return history.groupBy("cancelled").agg((100.0 * F.avg(a.cast("double"))).alias("pct"), F.count(F.when(a, 1)).alias("n"))


def run_at_k(rows: DataFrame, side: Column, k: int = 1, client: str = "client", rel: str = "rel") -> DataFrame:
    """Consecutive months on the risk side ending exactly at -k, 0 when -k is not on that side."""
    d = run_length(rows.filter(F.col(rel) <= -k), side, client, rel)
    per = d.groupBy(client).agg(F.max(F.when(F.col(rel) == -k, F.col("run"))).alias("__run"))
    ids = rows.select(client).distinct()
    return ids.join(per, client, "left").select(client, F.coalesce("__run", F.lit(0)).alias("run"))


def best_form(table: DataFrame, ks: Sequence[int] = (1, 2, 3), margin: float = 0.01, good: float = 0.8) -> DataFrame:
    """Better form per signal (change only when it wins by more than ``margin``) and its AUC lead."""
    mean = table.filter(F.col("k").isin(*ks)).groupBy("signal").agg(
        F.avg(F.when(F.col("form") == "level", F.col("auc"))).alias("level"),
        F.avg(F.when(F.col("form") == "change", F.col("auc"))).alias("change"))
    pick = F.when(F.col("change") > F.col("level") + margin, "change").otherwise("level")
    best = mean.withColumn("form", pick)
    rows = table.join(best.select("signal", "form"), ["signal", "form"])
    w = W.partitionBy("signal").orderBy("k")
    d = rows.withColumn("__rn", F.row_number().over(w)).withColumn("__bad", ~F.coalesce(F.round("auc", 2) >= good, F.lit(False)))
    lead = d.groupBy("signal").agg(
        (F.coalesce(F.min(F.when(F.col("__bad"), F.col("__rn"))), F.count(F.lit(1)) + 1) - 1).cast("int").alias("auc_lead"),
        F.max(F.when(F.col("k") == 1, F.col("auc"))).alias("auc_k1"), F.max(F.when(F.col("k") == 3, F.col("auc"))).alias("auc_k3"))
    return best.join(lead, "signal")


def recovery_summary(eps: DataFrame, client: str = "client") -> DataFrame:
    """Who went through an episode, recovered, is in one now, and how long those last."""
    gone, ongoing = F.col("cancelled"), F.col("ongoing")

    def clients(cond: Column) -> Column:
        return F.countDistinct(F.when(cond, F.col(client)))

    # run lengths are small integers, so the percentile buffers stay small
    return eps.agg(
        clients(~gone).alias("active_ever"), clients(~gone & ~ongoing).alias("active_recovered"),
        clients(~gone & ongoing).alias("active_ongoing"), clients(~gone & ongoing & (F.col("length") >= 2)).alias("active_ongoing_2"),
        clients(gone & ongoing).alias("cancelled_at_exit"), clients(gone & ongoing & (F.col("length") >= 2)).alias("cancelled_at_exit_2"),
        F.percentile(F.when(gone & ongoing, F.col("length")), F.lit(0.5)).alias("median_cancelled"),
        F.percentile(F.when(~gone & ~ongoing, F.col("length")), F.lit(0.5)).alias("median_active"))


def quadrants(values: DataFrame, signal: str, level: float, change: float) -> DataFrame:
    d = values.filter((F.col("k") == 1) & F.col(f"{signal}__level").isNotNull() & F.col(f"{signal}__change").isNotNull())
    return d.groupBy("cancelled", (F.col(f"{signal}__level") <= level).alias("low"),
                     (F.col(f"{signal}__change") <= change).alias("falling")).agg(F.count(F.lit(1)).alias("clients"))


def revenue_detected(history: DataFrame, alert: str, amounts: DataFrame, amount: str, ks: Sequence[int] = (1, 2, 3),
                     client: str = "client") -> DataFrame:
    """Value of the cancelled clients alerted and not alerted at each k."""
    per = history.filter("cancelled").groupBy(client).agg(
        *[F.max(F.when(F.col("k") == k, F.col(alert))).alias(f"k{k}") for k in ks]).join(amounts.select(client, amount), client, "left")
    items = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(F.col(f"k{k}"), F.lit(False)).alias("hit")) for k in ks])
    d = per.select(amount, F.explode(items).alias("s")).select(amount, "s.*")
    return d.groupBy("k").agg(F.sum(F.when(F.col("hit"), F.col(amount)).otherwise(0.0)).alias("detected"),
                              F.sum(F.when(~F.col("hit"), F.col(amount)).otherwise(0.0)).alias("missed"),
                              F.count(F.when(F.col("hit"), 1)).alias("n_detected"))


def situation(alert: Column, cond: Column, n_signals: Column) -> Column:
    return (F.when(alert, "Alerta (regra)").when(cond, "Condição só no último mês")
            .when(n_signals >= 1, "1 sinal isolado").otherwise("Sem sinal"))


def signal_table(history: DataFrame, best: DataFrame, thresholds: Sequence[Threshold], alert: str) -> DataFrame:
    """Final table: one row per signal plus the combined rule."""
    flags = F.array(*[F.struct(F.lit(t.signal).alias("signal"), (F.col(t.signal) & F.col("has_history")).alias("alert"))
                      for t in thresholds], F.struct(F.lit("rule").alias("signal"), F.col(alert).alias("alert")))
    long = history.select("client", "k", "cancelled", F.explode(flags).alias("s")).select("client", "k", "cancelled", "s.*")
    return rule_performance(long, "alert", by=["signal"]).join(
        best.select("signal", "form", "auc_k1", "auc_k3", "auc_lead"), "signal", "left")


__all__ = ["Rule", "Signal", "Threshold", "best_form", "condition", "detection_rate", "episodes", "evidence_list",
           "firing_history", "fires", "lead_time", "oriented_auc", "quadrants", "recovery_summary", "revenue_detected",
           "rule_alert", "rule_grid", "rule_performance", "run_at_k", "sensitivity", "signal_table", "situation",
           "values_until"]
