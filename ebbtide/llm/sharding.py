"""Sharding by weighted rendezvous hashing: a record goes to the shard whose keyed score for it is largest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import documents, text_of

BITS = 52


def key_text(*keys: str) -> Column:
    """The record key as text; nulls count as empty."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def _score(key: Column, shard: Column, weight: Column) -> Column:
    """-w / ln u for a u in (0, 1) that key and shard decide: the largest wins with probability proportional to w."""
    drawn = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, BITS // 4), 16, 10).cast("double")
    return -weight / F.log((drawn + 0.5) / float(1 << BITS))


def best_shard(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard (int); equal scores go to the smaller shard number."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    table = F.array(*[F.lit(float(w)) for w in weights])
    scored = F.transform(table, lambda w, i: F.struct(_score(key, i, w).alias("score"), (-i).alias("shard")))
    return (-F.array_max(scored)["shard"]).cast("int")


def assign(records: DataFrame, keys: Sequence[str], weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """Adds (or replaces) the shard column; a projection without shuffle. The key columns and the number and weights of the shards
    alone decide, so another shard takes records only into itself and a removed one gives up only its own."""
    return records.withColumn(shard, best_shard(key_text(*keys), weights))


def with_slots(placed: DataFrame, order: Sequence[str], rows_per_group: int = 50_000) -> DataFrame:
    """Gapless slots from 0 inside each shard, by md5 of the key, then the order columns.

    placed has ``shard`` and ``_h`` (md5 of the key). A shard is never one task: rows are numbered inside (shard, first digits of
    _h) and a group starts where the groups before it end. Equal rows are counted before the shuffle, so one that is repeated
    many times costs one row; the number of digits follows from the number of rows.
    """
    total, digits = placed.count(), 1
    while total > rows_per_group * 16 ** digits:
        digits += 1
    columns = [c for c in placed.columns]
    group = ["shard", "_g"]
    counted = placed.withColumn("_g", F.substring("_h", 1, digits)).groupBy(*columns, "_g").agg(F.count("*").alias("_n"))
    sizes = counted.groupBy(*group).agg(F.sum("_n").alias("_size"))
    starts = sizes.select(*group, F.coalesce(F.sum("_size").over(Window.partitionBy("shard").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group).orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    first = counted.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return (first.join(starts, group).withColumn("_first", F.col("_start") + F.col("_before"))
            .select(*columns, F.explode(F.sequence("_first", F.col("_first") + F.col("_n") - 1)).alias("slot")).drop("_h"))


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Placement of every document by its doc_id over n_shards equal shards.

    Law ``key``: doc_id and the shard count alone decide. A null doc_id is the empty key; a null text has no bytes (size 8, crc 0);
    repeated rows go to one shard and take one slot each; an empty table gives no rows. Other columns are not read.
    """
    key = key_text("doc_id")
    small = docs.select("doc_id", (F.octet_length(text_of()) + 8).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"),
                        F.md5(key).alias("_h"), best_shard(key, [1.0] * n_shards).alias("shard"),
                        best_shard(key, [1.0] * (n_shards + 1)).alias("grown_shard"))
    placed = with_slots(small, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


#: CRC-32 is the reflected polynomial 0xEDB88320, byte by byte.
SQL = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
pieces AS (SELECT r, encode(text) AS b FROM d),
crcs AS (
  SELECT r, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i::INT + 1, 2))::BIGINT)),
                            lambda x, y: xor(x // 256, t[(xor(x, y) % 256)::INT + 1])), 4294967295) AS crc
  FROM pieces, crc_table),
scores AS (
  SELECT d.r, s.s, -1.0 / ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s.s), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS score
  FROM d, (SELECT unnest(range(25)) AS s) s),
best AS (SELECT r, (arg_max(s, score) FILTER (WHERE s < 24))::INT AS shard, arg_max(s, score)::INT AS grown_shard FROM scores GROUP BY r)
SELECT doc_id, (octet_length(encode(text)) + 8)::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, octet_length(encode(text)), crc) - 1 AS slot, grown_shard
FROM d JOIN best USING (r) JOIN crcs USING (r)
"""
