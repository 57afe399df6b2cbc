"""Writing prepared tables and run results; reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import clean_json


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", **options) -> dict[str, str]:
    """One folder per prepared table."""
    out = {}
    for name, df in tables.items():
        target = f"{path}/{name}"
        df.write.mode("overwrite").format(fmt).options(**options).save(target)
        out[name] = target
    return out


def write_run(results: dict[str, DataFrame], path: str, run_id: str) -> dict[str, str]:
    """Result tables of a run; rerunning replaces that run only."""
    out = {}
    for name, df in results.items():
        target = f"{path}/{name}"
        (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_id").parquet(target))
        out[name] = target
    return out


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON text per row with sorted keys, rounded numbers and nulls for NaN."""
    df.select(clean_json(df).alias("value")).write.mode("overwrite").text(path)


def write_panel(panel: DataFrame, path: str) -> None:
    """Out-of-fold panel kept for arm comparison, co-located by fold."""
    panel.write.mode("overwrite").partitionBy("fold").parquet(path)


def read_panel(spark: SparkSession, path: str, fold: int | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    return d.filter(F.col("fold") == fold) if fold is not None else d
