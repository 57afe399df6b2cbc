"""Leak-free client x period panel.

One shuffle on the client carries everything: presence is joined with the clients, the grid is exploded from the
gaps between presence rows (no second join to find out which months have data), and the running count and every
later trailing window use the same partitioning. A client contributes at most one row per period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import norm_value
from .stats import quantiles


# ---------------------------------------------------------------- target, value, attributes
def resolve_target(ids: DataFrame, target: DataFrame, client: str = "client", status: str | None = None,
                   cancelled_value=None, exit_m: str | None = None, order: str | None = None) -> DataFrame:
    """client, cancelled, exit_m for every id.

    Repeated target rows keep the last one by ``order``; ids without a target row are active; the exit month only
    counts for the cancelled.
    """
    month = F.col(exit_m).cast("int") if exit_m else F.lit(None).cast("int")
    if status:
        gone = norm_value(F.col(status)) == norm_value(F.lit(cancelled_value))
    else:
        gone = month.isNotNull()
    picked = F.struct(gone.alias("gone"), month.alias("exit"))
    rows = target.filter(F.col(client).isNotNull())
    last = F.max_by(picked, F.col(order)) if order else F.last(picked)
    one = rows.groupBy(client).agg(last.alias("__t"))
    out = ids.select(client).join(one, client, "left")
    gone = F.coalesce(F.col("__t.gone"), F.lit(False))
    return out.select(client, gone.alias("cancelled"), F.when(gone, F.col("__t.exit")).alias("exit_m"))


def contract_value(rows: DataFrame, value: str, client: str = "client", order: str | None = None) -> DataFrame:
    """Last non-null value per client by ``order`` (a month for temporal tables)."""
    ok = rows.filter(F.col(value).isNotNull() & F.col(client).isNotNull())
    pick = F.max_by(F.col(value), F.col(order)) if order else F.last(value)
    return ok.groupBy(client).agg(pick.cast("double").alias("contract_value"))


def client_attributes(ids: DataFrame, table: DataFrame, cols: Sequence[str], client: str = "client",
                      order: str | None = None, limit: int | None = None) -> DataFrame:
    """Descriptive columns (at most ``limit``, if given), first row per client."""
    return attach_static(ids, table, list(cols)[:limit], client, order)


def client_dates(ids: DataFrame, table: DataFrame, dates: dict[str, Column], client: str = "client",
                 order: str | None = None, limit: int | None = None) -> DataFrame:
    """Date columns (at most ``limit``, if given) as ``YYYY-MM``."""
    chosen = list(dates.items())[:limit]
    shown = table.withColumns({n: F.date_format(c, "yyyy-MM") for n, c in chosen})
    return attach_static(ids, shown, [n for n, _ in chosen], client, order)


def usable_columns(types: dict[str, str], exclude: Sequence[str] = ()) -> dict[str, str]:
    """Columns that may become features: never the key, the date, the target, ignored columns or free text."""
    return {c: t for c, t in types.items()
            if c not in set(exclude) and t in ("numeric", "binary", "category", "date")}


def attach_static(ids: DataFrame, table: DataFrame, cols: Sequence[str], client: str = "client",
                  order: str | None = None) -> DataFrame:
    """Left join of one row per client (the first by ``order``)."""
    row = F.struct(*[F.col(c) for c in cols])
    first = F.min_by(row, F.col(order)) if order else F.first(row)
    one = table.filter(F.col(client).isNotNull()).groupBy(client).agg(first.alias("__r"))
    return ids.select(client).join(one, client, "left").select(client, *[F.col(f"__r.{c}").alias(c) for c in cols])


def attach_events(ids: DataFrame, events: DataFrame, client: str = "client") -> DataFrame:
    """Rows of known clients (undated events may include rows after the exit: callers warn about it)."""
    return events.join(ids.select(client), client, "left_semi")


def orphan_rows(ids: DataFrame, rows: DataFrame, client: str = "client") -> DataFrame:
    return rows.join(ids.select(client), client, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


def attach_temporal(ids: DataFrame, rows: DataFrame, client: str = "client", m: str = "m") -> DataFrame:
    return rows.filter(F.col(m).isNotNull()).join(ids.select(client), client, "left_semi")


# ---------------------------------------------------------------- table shape
def table_density(rows: DataFrame, client: str = "client", m: str = "m", min_density: float = 0.6,
                  transactional: float = 1.2) -> DataFrame:
    """Share of months with data inside the client's span, rows per client-month and the two flags."""
    months = rows.groupBy(client, m).agg(F.count(F.lit(1)).alias("__n"))
    per = months.groupBy(client).agg(F.count(F.lit(1)).alias("__months"),
                                     (F.max(m) - F.min(m) + 1).alias("__span"), F.sum("__n").alias("__rows"))
    one = per.agg(F.try_divide(F.sum("__months").cast("double"), F.sum("__span").cast("double")).alias("density"),
                  F.try_divide(F.sum("__rows").cast("double"), F.sum("__months").cast("double"))
                  .alias("rows_per_month"))
    return one.select("density", "rows_per_month", (F.col("density") >= min_density).alias("dense"),
                      (F.col("rows_per_month") > transactional).alias("transactional"))


def presence(tables: Sequence[DataFrame], client: str = "client", m: str = "m") -> DataFrame:
    """Distinct (client, month) over the given tables."""
    out = tables[0].select(client, m)
    for t in tables[1:]:
        out = out.unionByName(t.select(client, m))
    return out.distinct()


def exit_lag(clients: DataFrame, pres: DataFrame, client: str = "client", m: str = "m") -> DataFrame:
    """Median of exit month minus last month with data over the cancelled (uses the uncut presence)."""
    last = pres.groupBy(client).agg(F.max(m).alias("__last"))
    gaps = (clients.filter(F.col("exit_m").isNotNull()).join(last, client)
            .select((F.col("exit_m") - F.col("__last")).alias("gap")))
    return quantiles(gaps, "gap", [0.5], ["exit_lag"]).select("exit_lag", "n")


def cut_at_exit(rows: DataFrame, clients: DataFrame, client: str = "client", m: str = "m") -> DataFrame:
    """Drop rows in or after the exit month."""
    ex = clients.select(client, F.col("exit_m").alias("__exit"))
    return (rows.join(ex, client, "left").filter(F.col("__exit").isNull() | (F.col(m) < F.col("__exit")))
            .drop("__exit"))


def reference_month(pres: DataFrame, m: str = "m") -> Column:
    """Latest month with data, as a scalar subquery."""
    return pres.select(F.max(m)).scalar()


def infer_exits(clients: DataFrame, pres: DataFrame, client: str = "client", m: str = "m") -> DataFrame:
    """Missing exit of a cancelled client = month after the last record; adds ``last_m`` and ``exit_inferred``."""
    last = pres.groupBy(client).agg(F.max(m).alias("last_m"))
    d = clients.join(last, client, "left")
    guess = F.col("cancelled") & F.col("exit_m").isNull() & F.col("last_m").isNotNull()
    return (d.withColumn("exit_inferred", guess)
            .withColumn("exit_m", F.when(guess, F.col("last_m") + 1).otherwise(F.col("exit_m")).cast("int")))


def observation_bounds(clients: DataFrame, pres: DataFrame, client: str = "client", m: str = "m") -> DataFrame:
    """ref_m, end_m = max(ref, latest exit) and the number of active clients without data at ref."""
    last = pres.groupBy(client).agg(F.max(m).alias("last_m"))
    ref = last.select(F.max("last_m")).scalar()
    d = clients.join(last, client, "left").withColumn("__ref", ref)
    return d.agg(F.max("__ref").alias("ref_m"),
                 F.greatest(F.max("__ref"), F.max("exit_m")).alias("end_m"),
                 F.count(F.when(~F.col("cancelled") & (F.col("last_m") < F.col("__ref")), 1)).alias("stale_active"))


# ---------------------------------------------------------------- grid and labels
def client_month_grid(clients: DataFrame, observed: DataFrame, ref_m: int | Column, client: str = "client",
                      m: str = "m") -> DataFrame:
    """Every month from the first data to min(exit - 1, ref), with ``k``, ``has_data`` and ``n_hist``.

    ``observed`` has one row per (client, month); its other columns ride along on the months that have data. Grid
    months are exploded from each observed month up to the next one, so no join back to presence is needed.
    Cancelled clients without an exit or without data before it are left out (see ``excluded_clients``); an active
    client without data keeps a single row at the reference month.
    """
    ref = F.lit(ref_m) if isinstance(ref_m, int) else ref_m
    extra = [c for c in observed.columns if c not in (client, m)]
    c = clients.select(client, "cancelled", "exit_m").withColumn("__ref", ref.cast("int"))
    c = (c.withColumn("__end", F.when(F.col("cancelled"), F.least(F.col("exit_m") - 1, F.col("__ref")))
                      .otherwise(F.col("__ref")))
         .withColumn("__out", F.when(F.col("cancelled"), F.col("exit_m")).otherwise(F.col("__ref") + 1))
         .filter(F.col("__end").isNotNull()))
    d = c.join(observed.withColumnRenamed(m, "__m"), client, "left")
    late = F.col("__m") > F.col("__end")
    # an active client whose data all lie beyond the end keeps its single row at the reference month
    d = d.withColumn("__m", F.when(~late, F.col("__m")))
    w = W.partitionBy(client).orderBy(F.col("__m").asc_nulls_last())
    d = (d.withColumn("__rn", F.row_number().over(w)).withColumn("__next", F.lead("__m").over(w))
         .filter(F.col("__m").isNotNull() | ((F.col("__rn") == 1) & ~F.col("cancelled"))))
    start = F.coalesce(F.col("__m"), F.col("__end"))
    d = d.withColumn("m", F.explode(F.sequence(start, F.coalesce(F.col("__next") - 1, F.col("__end")))))
    has = (F.col("m") == F.col("__m")) & F.col("__m").isNotNull()
    return d.select(client, F.col("m").cast("int"), "cancelled", "exit_m",
                    (F.col("__out") - F.col("m")).cast("int").alias("k"),
                    F.coalesce(has, F.lit(False)).alias("has_data"),
                    F.when(F.col("__m").isNull(), 0).otherwise(F.col("__rn")).cast("int").alias("n_hist"),
                    (F.col("m") == F.col("__ref")).alias("__at_ref"),
                    *[F.when(has, F.col(e)).alias(e) for e in extra])


def activity_grid(active: DataFrame, ref: int, gap: int = 1, client: str = "client", m: str = "m") -> DataFrame:
    """Label by gap, exit cut and month grid of one activity table in a single pass over one partitioning.

    Same rows as ``label_by_gap`` + ``cut_at_exit`` + ``client_month_grid``, for bases whose clients are the
    clients of the activity itself: the exit is a window minimum, so no table is joined and none is read twice.
    """
    extra = [c for c in active.columns if c not in (client, m)]
    w = W.partitionBy(client).orderBy(m)
    d = active.filter(F.col(m) <= ref).withColumn("__next", F.coalesce(F.lead(m).over(w), F.lit(ref + 1)))
    d = d.withColumn("__rn", F.row_number().over(w)).withColumn(
        "exit_m", F.min(F.when(F.col("__next") - F.col(m) > gap, F.col(m) + 1)).over(W.partitionBy(client)).cast("int"))
    d = d.filter(F.col("exit_m").isNull() | (F.col(m) < F.col("exit_m"))).withColumnRenamed(m, "__m")
    last = F.least(F.col("__next") - 1, F.coalesce(F.col("exit_m") - 1, F.lit(ref)))
    d = d.withColumn("m", F.explode(F.sequence(F.col("__m"), last)))
    has = F.col("m") == F.col("__m")
    return d.select(client, F.col("m").cast("int"), F.col("exit_m").isNotNull().alias("cancelled"), "exit_m",
                    (F.coalesce("exit_m", F.lit(ref + 1)) - F.col("m")).cast("int").alias("k"), has.alias("has_data"),
                    F.col("__rn").cast("int").alias("n_hist"), (F.col("m") == ref).alias("__at_ref"),
                    *[F.when(has, F.col(e)).alias(e) for e in extra])


def label_panel(grid: DataFrame, horizon: int, min_hist: int, end_m: int | Column) -> DataFrame:
    """Label, training flag (history and known outcome), reference and scorable flags."""
    end = F.lit(end_m) if isinstance(end_m, int) else end_m
    known = F.col("cancelled") | (end - F.col("m") >= horizon)
    reference = ~F.col("cancelled") & F.col("__at_ref")
    return (grid.withColumn("y", (F.col("cancelled") & (F.col("k") <= horizon)).cast("int"))
            .withColumn("train", F.col("has_data") & (F.col("n_hist") >= min_hist) & known)
            .withColumn("reference", reference)
            .withColumn("scorable", F.col("has_data") | reference).drop("__at_ref"))


def excluded_clients(clients: DataFrame, grid: DataFrame, client: str = "client") -> DataFrame:
    """Cancelled clients that have no panel row."""
    return (clients.filter("cancelled").select(client)
            .join(grid.select(client), client, "left_anti"))


def snapshot_panel(clients: DataFrame, min_hist: int, client: str = "client") -> DataFrame:
    """No temporal table: one row per client, y = cancelled."""
    return clients.select(
        client, F.lit(2000 * 12).alias("m"), "cancelled", "exit_m", F.lit(1).alias("k"),
        F.lit(True).alias("has_data"), F.lit(min_hist).alias("n_hist"), F.col("cancelled").cast("int").alias("y"),
        F.lit(True).alias("train"), (~F.col("cancelled")).alias("reference"), F.lit(True).alias("scorable"))


def panel_summary(panel: DataFrame, horizon: int, min_hist: int, client: str = "client") -> DataFrame:
    """Row, label and client counts of the validation report."""
    d = panel.groupBy(client, "cancelled").agg(
        F.count(F.lit(1)).alias("a"), F.count(F.when(F.col("has_data"), 1)).alias("b"),
        F.count(F.when(F.col("train"), 1)).alias("c"), F.sum(F.when(F.col("train"), F.col("y")).otherwise(0)).alias("d"),
        F.count(F.when(F.col("has_data") & ~F.col("cancelled") & ~F.col("train")
                       & (F.col("n_hist") >= min_hist), 1)).alias("e"))
    return d.agg(F.sum("a").alias("rows"), F.sum("b").alias("rows_with_data"), F.sum("c").alias("train_rows"),
                 F.sum("d").alias("train_positives"), F.count(F.lit(1)).alias("clients"),
                 F.count(F.when(F.col("cancelled"), 1)).alias("cancelled_clients"),
                 F.count(F.when(~F.col("cancelled"), 1)).alias("active_clients"), F.sum("e").alias("censored_rows"))
