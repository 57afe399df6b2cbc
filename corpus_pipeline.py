"""The corpus pipeline: quality classifier, near-duplicate removal, decontamination, personal data, tokens."""

from __future__ import annotations

import os
import secrets
import warnings

from pyspark.sql import DataFrame, SparkSession

from ebbtide.llm import chunked_bpe, classifier, decontamination, pii, simhash
from ebbtide.llm.common import documents, saved, ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are neither of low quality nor toxic, with all their columns, whatever their names."""
    model = classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    added = [f"_quality {name}" for name in classifier.ADDED]
    while set(added) & set(docs.columns):
        added = [f"_{name}" for name in added]
    return classifier.classify(docs, model, added=added).where(f"`{added[-1]}`").drop(*added)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontamination.without_leaks(docs, decontamination.prepare(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced. n_chars follows the text. The key is EBBTIDE_PII_KEY; without it the run draws one of
    its own, which nobody keeps: its pseudonyms are linked within the run and can't be turned back."""
    key = os.environ.get("EBBTIDE_PII_KEY")
    if not key:
        warnings.warn("EBBTIDE_PII_KEY isn't set: this run's pseudonyms get a random key and won't match other runs", stacklevel=2)
        key = secrets.token_hex(32)
    return pii.rewritten(docs, key)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return chunked_bpe.digests(chunked_bpe.encode(docs))


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("decontamination", decontaminated), ("personal data", pseudonymised), ("tokens", tokens)]

#: Fingerprints, models and tokenizers are not SQL: tests/llm/test_pipeline.py compares run() with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's rows are written to shared storage and reread."""
    ship(spark)
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, f"stage-{k}")
    return docs
