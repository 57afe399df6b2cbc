"""Helpers shared by the operators: words, shared storage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ARROW_BYTES = 4 << 20
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the Python workers, once in a session: they need it to run the operators' functions. Arrow batches
    are bounded by bytes, so that long texts don't add up in a worker."""
    for name, most in (("maxBytesPerBatch", ARROW_BYTES), ("maxRecordsPerBatch", 10_000)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", most)
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_ebbtide_shipped", False):
        return
    packed = Path(tempfile.mkdtemp(prefix="ebbtide-")) / "ebbtide.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(packed))
    context._ebbtide_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A session in one process that names none gets a temporary one; a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="ebbtide-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and reread: cuts the lineage, survives lost executors, goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with at most max_bytes of the column's text each, and one row at least."""
    values = batch.column(column)
    sizes = [0 if n is None else n for n in pc.binary_length(values).to_pylist()]
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def drawn(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows (all, if there are fewer), those whose key has a small hash; never more than twice as many. Each task
    sends on only its share of them, however many tasks there are."""
    total = df.count()
    share = int(min(1.0, rows / max(total, 1)) * (1 << 30))
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share).limit(2 * rows)
