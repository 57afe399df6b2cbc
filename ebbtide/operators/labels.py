"""From raw transactions to activity, exits and spend."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import period_index, text


def valid_sales(sales: DataFrame, client: str, stamp: str, ref: int, voided: Column | None = None,
                grain: str = "month") -> DataFrame:
    """Rows of a known client, not voided, in a complete period (``m <= ref``); adds ``m``."""
    # the bound is on the stored column, so it reaches the scan
    ok = F.col(client).isNotNull() & (F.col(stamp) < F.lit(period_start(ref + 1, grain)))
    if voided is not None:
        ok = ok & ~F.coalesce(voided, F.lit(False))
    return sales.filter(ok).withColumn("m", period_index(F.col(stamp), grain))


def period_start(m: int, grain: str) -> datetime:
    """First instant of a period, as a literal for filters on date or timestamp columns."""
    if grain == "month":
        return datetime(m // 12, m % 12 + 1, 1)
    return datetime(1970, 1, 1) + timedelta(days=m)


def complete_sources(rows: DataFrame, source: str, expected_end: int, m: str = "m") -> DataFrame:
    """Keep only sources (networks) whose data reach ``expected_end``; a truncated export is not an exit."""
    full = rows.groupBy(source).agg(F.max(m).alias("__end")).filter(F.col("__end") >= expected_end).select(source)
    return rows.join(full, source, "left_semi")


def activity(rows: DataFrame, client: str = "client", m: str = "m", means: Sequence[str] = (),
             sums: Sequence[str] = ()) -> DataFrame:
    """One row per client and period: row count, means, sums. Combined on the map side first, so a client with a
    large share of the raw rows reaches the shuffle as one row per period."""
    return rows.groupBy(client, m).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in means], *[F.sum(c).alias(f"{c}_sum") for c in sums])


def label_by_gap(active: DataFrame, ref: int, gap: int = 1, client: str = "client", m: str = "m") -> DataFrame:
    """Exit = first period of the first gap of at least ``gap`` empty periods after the first activity.

    ``active`` has at least one row per active (client, period). A trailing gap shorter than ``gap`` at ``ref`` is
    not an exit. Returns client, cancelled, exit_m, first_m.
    """
    seen = active.filter(F.col(m) <= ref).groupBy(client, m).agg(F.lit(True).alias("__seen"))
    w = W.partitionBy(client).orderBy(m)
    following = F.coalesce(F.lead(m).over(w), F.lit(ref + 1))
    spans = seen.select(client, m, F.when(following - F.col(m) > gap, F.col(m) + 1).alias("__exit"))
    out = spans.groupBy(client).agg(F.min("__exit").alias("exit_m"), F.min(m).alias("first_m"))
    return out.select(client, F.col("exit_m").isNotNull().alias("cancelled"), F.col("exit_m").cast("int"), "first_m")


def status_text(cancelled: Column) -> Column:
    return F.when(cancelled, F.lit("Cancelado")).otherwise(F.lit("Ativo"))


def mean_spend_before_exit(rows: DataFrame, exits: DataFrame, amount: str, client: str = "client",
                           m: str = "m") -> DataFrame:
    """Mean over active periods of the period total, using periods before the exit only."""
    monthly = rows.groupBy(client, m).agg(F.sum(amount).alias("__total"))
    before = (monthly.join(exits.select(client, "exit_m"), client, "left")
              .filter(F.col("exit_m").isNull() | (F.col(m) < F.col("exit_m"))))
    return before.groupBy(client).agg(F.avg("__total").alias("mean_spend"))


def attach_client(details: DataFrame, parents: DataFrame, key: str, carry: Sequence[str]) -> DataFrame:
    """Detail rows (items, payments) with the client and date of their parent row. ``key`` is unique in parents."""
    return details.join(parents.select(key, *carry), key)


def complete_master(ids: DataFrame, master: DataFrame, client: str, network: str, separator: str = "-") -> DataFrame:
    """Every client id with its master row; a missing network is the prefix of the id."""
    one = master.dropDuplicates([client])
    return (ids.select(client).distinct().join(one, client, "left")
            .withColumn(network, F.coalesce(F.col(network), F.split(F.col(client), separator)[0])))


def bounded_tables(tables: dict[str, DataFrame], clients: DataFrame, client: str, dates: dict[str, str], ref: int,
                   grain: str = "month") -> dict[str, DataFrame]:
    """Every table cut at ``ref`` (where it has a date) and restricted to the labelled clients."""
    out = {}
    for name, df in tables.items():
        if name in dates:
            df = df.filter(period_index(F.col(dates[name]), grain) <= ref)
        out[name] = df.join(clients.select(client), client, "left_semi") if client in df.columns else df
    return out


def due_days(due: Column, moved: Column) -> Column:
    return F.datediff(F.to_date(due), F.to_date(moved))


__all__ = ["activity", "attach_client", "bounded_tables", "complete_master", "complete_sources", "due_days",
           "label_by_gap", "mean_spend_before_exit", "status_text", "text", "valid_sales"]
