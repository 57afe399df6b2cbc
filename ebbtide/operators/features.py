"""Candidate features at each panel row, from data up to that row only.

``m`` is an integer period, so "the last J periods" is a RANGE frame. All windows share one partitioning
(client) and ordering (m); a client holds at most one row per period, whatever the size of its raw history.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import column_label
from .stats import global_rank, hash_order, quantiles

MISSING = "(ausente)"


# ---------------------------------------------------------------- metadata
@dataclass(frozen=True)
class Feature:
    id: str
    label: str
    table: str
    column: str
    transform: str
    column_label: str
    category: str | None = None
    window: int | None = None
    temporal: bool = True
    indicator: bool = False
    fraction: bool = False
    base: str | None = None            # persistence: the feature that is counted
    base_threshold: float | None = None
    base_direction: int | None = None


# Wording of each transform in a feature label.
SUFFIX = {
    "level": "(média {j}m)", "change": "(variação vs média anterior)", "trend": "(tendência {j}m)",
    "last": "(último)", "mean": "(média {j}m)", "months_since": "(meses desde o último registro)",
    "never": "(nunca registrado)", "missing": "(ausente, fração {j}m)",
}


@dataclass
class Names:
    """Stable feature ids: ``column[=category]__transform``, with the table in front of a repeated column."""
    repeated: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, tables: dict[str, Sequence[str]]) -> Names:
        seen = Counter(c for cols in tables.values() for c in cols)
        return cls({c for c, n in seen.items() if n > 1} | {"registros"})

    def id(self, table: str, column: str, transform: str, category: str | None = None) -> str:
        name = f"{table}.{column}" if column in self.repeated else column
        if category is not None:
            name = f"{name}={category}"
        return f"{name}__{transform}"

    def feature(self, table: str, column: str, transform: str, label: str | None = None, **kw) -> Feature:
        shown = label or column_label(column)
        cat = kw.get("category")
        suffix = SUFFIX.get(transform, "").format(j=kw.get("window"))
        text = f"{shown} = {cat}" if cat is not None else shown
        if cat is not None and transform == "freq":
            suffix = f"(fração {kw.get('window')}m)"
        if cat is not None and transform == "latest_is":
            suffix = "(último)"
        return Feature(self.id(table, column, transform, cat), f"{text} {suffix}".strip(), table, column, transform,
                       shown, **kw)


# ---------------------------------------------------------------- frames
def _by(client: str, m: str):
    return W.partitionBy(client).orderBy(m)


def _trailing(client: str, m: str, j: int, shift: int = 0):
    return _by(client, m).rangeBetween(-(j - 1) - shift, -shift)


def _until(client: str, m: str, shift: int = 0):
    return _by(client, m).rangeBetween(W.unboundedPreceding, -shift)


def with_observations(panel: DataFrame, monthly: DataFrame, cols: Sequence[str], client: str = "client",
                      m: str = "m") -> DataFrame:
    """Panel months plus the observation months of another table, from the earliest panel month of any client.

    Window features are computed on this table and joined back to the panel (rows with ``on_grid``).
    """
    first = panel.select(F.min(m)).scalar()
    grid = panel.select(client, m, F.lit(True).alias("on_grid"))
    seen = (monthly.select(client, m, *cols, F.lit(True).alias("present")).filter(F.col(m) >= first)
            .join(panel.select(client), client, "left_semi"))
    both = grid.unionByName(seen, allowMissingColumns=True).repartition(client)
    return both.groupBy(client, m).agg(
        F.coalesce(F.max("on_grid"), F.lit(False)).alias("on_grid"),
        F.coalesce(F.max("present"), F.lit(False)).alias("present"), *[F.max(c).alias(c) for c in cols])


# ---------------------------------------------------------------- temporal, numeric
def dense_features(df: DataFrame, cols: Sequence[str], window: int = 3, trend_window: int = 6,
                   client: str = "client", m: str = "m") -> DataFrame:
    """``__level``, ``__change`` (with ``__change_ref``), ``__trend`` and ``__last`` of each column."""
    recent, earlier = _trailing(client, m, window), _until(client, m, window)
    slope_w, upto = _trailing(client, m, trend_window), _until(client, m)
    new = {}
    for c in cols:
        x = F.col(c).cast("double")
        new[f"{c}__level"] = F.avg(x).over(recent)
        new[f"{c}__change_ref"] = F.avg(x).over(earlier)
        new[f"{c}__change"] = F.avg(x).over(recent) - F.avg(x).over(earlier)
        points = F.count(x).over(slope_w)
        new[f"{c}__trend"] = F.when(points >= 3, F.regr_slope(x, F.col(m).cast("double")).over(slope_w))
        new[f"{c}__last"] = F.last(x, ignorenulls=True).over(upto)
    return df.withColumns(new)


def missing_share(df: DataFrame, cols: Sequence[str], present: Column, window: int = 3, client: str = "client",
                  m: str = "m") -> DataFrame:
    """``__missing``: months present with a null value over months present, inside the window."""
    w = _trailing(client, m, window)
    here = F.when(present, 1).otherwise(0)
    return df.withColumns({
        f"{c}__missing": F.try_divide(
            F.sum(F.when(present & F.col(c).isNull(), 1).otherwise(0)).over(w).cast("double"),
            F.sum(here).over(w).cast("double")) for c in cols})


def missing_is_common(df: DataFrame, cols: Sequence[str], present: Column, share: float = 0.05) -> dict[str, bool]:
    """Columns with at least 5 % of their present months empty (those get ``__missing``)."""
    row = df.filter(present).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]).first()
    return {c: (row[c] or 0.0) >= share for c in cols}


def count_features(df: DataFrame, n: str, first_m: int | Column, window: int = 3, trend_window: int = 6,
                   client: str = "client", m: str = "m") -> DataFrame:
    """Features of a monthly row count that is zero in every month without rows, from ``first_m`` on.

    Zero months before the client's first record belong to the baseline; means and slope use the closed form over
    the known number of months, so no zero rows are created.
    """
    start = F.lit(first_m) if isinstance(first_m, int) else first_m
    t = F.col(m)
    x = F.coalesce(F.col(n), F.lit(0)).cast("double")
    age = t - start + 1
    level = F.sum(x).over(_trailing(client, m, window)) / F.least(F.lit(window), age)
    past = age - window
    ref = F.when(past > 0, F.coalesce(F.sum(x).over(_until(client, m, window)), F.lit(0.0)) / F.nullif(past, F.lit(0)))
    w = _trailing(client, m, trend_window)
    points = F.least(F.lit(trend_window), age).cast("double")
    mean_t = t - (points - 1) / 2
    cross = F.sum(x * t).over(w) - mean_t * F.sum(x).over(w)
    spread = points * (points * points - 1) / 12
    return df.withColumns({
        f"{n}__level": level, f"{n}__change_ref": ref, f"{n}__change": level - ref,
        f"{n}__trend": F.when(points >= 3, cross / F.nullif(spread, F.lit(0.0))), f"{n}__last": x})


def sparse_features(df: DataFrame, windows: dict[str, int], client: str = "client", m: str = "m") -> DataFrame:
    """``__last``, ``__change``, ``__mean``, ``__months_since`` and ``__never`` of rarely recorded columns.

    ``windows`` maps each column to its own averaging window (see ``sparse_window``).
    """
    upto = _until(client, m)
    new = {}
    for c, js in windows.items():
        x = F.col(c).cast("double")
        last = F.last(x, ignorenulls=True).over(upto)
        n = F.count(x).over(upto)
        before = F.when(n >= 2, (F.sum(x).over(upto) - last) / F.nullif(n - 1, F.lit(0)))
        seen = F.last(F.when(x.isNotNull(), F.col(m)), ignorenulls=True).over(upto)
        new[f"{c}__last"] = last
        new[f"{c}__change_ref"] = before
        new[f"{c}__change"] = last - before
        new[f"{c}__mean"] = F.avg(x).over(_trailing(client, m, js))
        new[f"{c}__months_since"] = (F.col(m) - seen).cast("double")
        new[f"{c}__never"] = F.when(n == 0, 1.0).otherwise(0.0)
    return df.withColumns(new)


def sparse_window(monthly: DataFrame, col: str, window: int = 3, cap: int = 12, client: str = "client",
                  m: str = "m") -> DataFrame:
    """Twice the median gap between observations, between ``window`` and ``cap``."""
    seen = monthly.filter(F.col(col).isNotNull())
    gaps = seen.select((F.col(m) - F.lag(m).over(_by(client, m))).alias("gap"))
    mid = quantiles(gaps, "gap", [0.5], ["median_gap"])
    # an aggregate without groups always gives one row, also when there is no gap at all
    one = mid.agg(F.max("median_gap").alias("median_gap"))
    js = F.least(F.lit(cap), F.greatest(F.lit(window), 2 * F.coalesce(F.floor("median_gap"), F.lit(window))))
    return one.select("median_gap", js.cast("int").alias("window"))


def value_density(panel: DataFrame, cols: Sequence[str], has_data: str = "has_data",
                  min_density: float = 0.6) -> DataFrame:
    """Share of panel rows with data that have a value, per column, and the dense flag."""
    one = panel.filter(has_data).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in cols])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("density"))
                                          for c in cols])).alias("s")).select("s.*")
    return long.withColumn("dense", F.col("density") >= min_density)


# ---------------------------------------------------------------- temporal, categories
def category_levels(rows: DataFrame, col: str, min_share: float = 0.03, limit: int | None = None) -> DataFrame:
    """Levels with at least ``min_share`` of the rows, most frequent first (null is a level of its own); at most ``limit``, if given."""
    level = F.coalesce(F.col(col).cast("string"), F.lit(MISSING))
    counts = rows.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).select("t").scalar()
    kept = counts.withColumn("share", F.col("n") / total).filter(F.col("share") >= min_share).orderBy(F.desc("n"), "level")
    return kept if limit is None else kept.limit(limit)


def category_shares(rows: DataFrame, col: str, levels: Sequence[str], client: str = "client",
                    m: str = "m") -> DataFrame:
    """Share of each level among the client's rows of the month: one column per level (``col=level``)."""
    value = F.coalesce(F.col(col).cast("string"), F.lit(MISSING))
    return rows.groupBy(client, m).agg(
        *[F.avg((value == lv).cast("double")).alias(f"{col}={lv}") for lv in levels])


def category_features(df: DataFrame, shares: Sequence[str], window: int, client: str = "client",
                      m: str = "m") -> DataFrame:
    """``__freq`` (mean monthly share in the window) and ``__latest_is`` (last known share, rounded)."""
    w, upto = _trailing(client, m, window), _until(client, m)
    new = {}
    for c in shares:
        x = F.col(f"`{c}`")
        new[f"{c}__freq"] = F.avg(x).over(w)
        new[f"{c}__latest_is"] = F.bround(F.last(x, ignorenulls=True).over(upto), 0)
    return df.withColumns(new)


# ---------------------------------------------------------------- per client
def event_features(ids: DataFrame, events: DataFrame, numeric: Sequence[str] = (),
                   categories: dict[str, Sequence[str]] | None = None, client: str = "client") -> DataFrame:
    """Undated events: row count (0 when none), mean of numbers, share of each level."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.avg(c).alias(f"{c}__event_mean") for c in numeric]
    for c, levels in (categories or {}).items():
        v = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
        aggs += [F.avg((v == lv).cast("double")).alias(f"{c}={lv}__event_share") for lv in levels]
    per = events.groupBy(client).agg(*aggs)
    return (ids.select(client).join(per, client, "left")
            .withColumn("registros__count", F.coalesce(F.col("__n"), F.lit(0)).cast("double")).drop("__n"))


def one_hot_levels(table: DataFrame, col: str, min_share: float = 0.03, limit: int | None = None, floor: int = 3,
                   binary: bool = False) -> DataFrame:
    """Levels of a client column with at least max(3, 3 %) clients; a binary column keeps the first one."""
    level = F.coalesce(F.col(col).cast("string"), F.lit(MISSING))
    counts = table.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).select("t").scalar()
    kept = (counts.withColumn("__t", total).filter(F.col("n") >= F.greatest(F.lit(float(floor)), min_share * F.col("__t")))
            .drop("__t").orderBy(F.desc("n"), "level"))
    kept = kept if limit is None else kept.limit(limit)
    return kept.orderBy("level").limit(1) if binary else kept


def static_features(table: DataFrame, numeric: Sequence[str] = (), one_hot: dict[str, Sequence[str]] | None = None,
                    client: str = "client") -> DataFrame:
    """Numbers as they are (``__static``) and 0/1 columns for the chosen levels (``__category``)."""
    cols = [F.col(c).cast("double").alias(f"{c}__static") for c in numeric]
    for c, levels in (one_hot or {}).items():
        v = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
        cols += [(v == lv).cast("double").alias(f"{c}={lv}__category") for lv in levels]
    return table.select(client, *cols)


def months_since_date(panel: DataFrame, dates: DataFrame, col: str, min_filled: float = 0.5,
                      client: str = "client", m: str = "m") -> DataFrame:
    """Panel month minus the client's date (a month index column); null for everyone when under half are filled."""
    filled = dates.select(F.avg(F.col(col).isNotNull().cast("double"))).scalar()
    d = panel.join(dates.select(client, col), client, "left")
    return d.withColumn(f"{col}__time_since", F.when(filled >= min_filled, (F.col(m) - F.col(col)).cast("double"))).drop(col)


# ---------------------------------------------------------------- change of the predicted risk
def risk_delta_features(panel: DataFrame, p: str = "p", three: bool = True, client: str = "client",
                        m: str = "m") -> DataFrame:
    """p minus the previous row's p and minus the mean of the three previous rows."""
    w = _by(client, m)
    new = {"risco_previsto__delta": F.col(p) - F.lag(p).over(w)}
    if three:
        new["risco_previsto__delta_3m"] = F.col(p) - F.avg(p).over(w.rowsBetween(-3, -1))
    return panel.withColumns(new)


def placebo(df: DataFrame, col: str, seed: int = 0, client: str = "client", m: str = "m") -> DataFrame:
    """Shuffle the non-null values of a column among its non-null rows (same distribution, no information)."""
    some = df.filter(F.col(col).isNotNull()).select(client, m, F.col(col).alias("__v"))
    placed = global_rank(some.select(client, m), client, m, name="__i")
    shuffled = global_rank(some.withColumn("__h", hash_order(client, m, seed=seed)), "__h", client, m, name="__i")
    new = placed.join(shuffled.select("__i", "__v"), "__i").select(client, m, "__v")
    return df.drop(col).join(new, [client, m], "left").withColumnRenamed("__v", col)
