"""SimHash near duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import shingles
from ebbtide.llm.common import documents, saved, ship, slices, text_of
from ebbtide.llm.components import components

BATCH_BYTES = 2 << 20
LARGE_BUCKET = 2_000


def fingerprints(texts: pa.Array, size: int = 4) -> np.ndarray:
    """64-bit SimHash of each text's word shingles, repeats included. Fewer words than size: one shingle of all; none: 0."""
    h, n = shingles.hashes(texts, size)
    out = np.zeros(len(texts), np.uint64)
    if not len(h):
        return out
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = n > 0
    at = np.concatenate(([0], np.cumsum(n[full])[:-1]))
    ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * ones > n[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprint(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id and _fp (the fingerprint as a signed long) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(part.column("text"), size).view(np.int64))], ["doc_id", "_fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, _fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2**(radius + 1) - 1 masks such that any radius positions are all outside one of them.

    Position i carries a nonzero vector of radius + 1 bits; mask v holds the positions whose vector has an odd product with v. At
    most radius vectors leave a nonzero v orthogonal to all of them, and its mask avoids those positions.
    """
    vector = [1 + i % ((2 << radius) - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, 2 << radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(m: np.ndarray, radius: int) -> list[tuple[np.ndarray, int]]:
    """The members' components (members, root). Each member is compared with those not reached so far, so a dense group
    costs about its size and nothing is emitted pair by pair."""
    found = []
    while len(m) > 1:
        root, rest, reached, todo = m[0], m[1:], [], [m[0]]
        while todo and len(rest):
            near = np.bitwise_count(rest ^ todo.pop()) <= radius
            new = rest[near]
            if len(new):
                reached.append(new)
                todo.extend(new)
                rest = rest[~near]
        if reached:
            found.append((np.concatenate(reached), root))
        m = rest
    return found


def bucket_links(m: np.ndarray, mask: int, radius: int) -> list[tuple[np.ndarray, int]]:
    """Links that connect, inside one bucket, all that its pairs within the radius connect. In a large bucket, members can differ
    outside the mask only: those positions in radius + 1 blocks leave one block equal for every such pair, so each block buckets anew."""
    if len(m) <= LARGE_BUCKET:
        return _stars(m, radius)
    free = [i for i in range(64) if not mask >> i & 1]
    found = []
    for k in range(radius + 1):
        part = m & np.uint64(sum(1 << i for i in free[k::radius + 1]))
        order = np.argsort(part, kind="stable")
        for group in np.split(m[order], np.flatnonzero(np.diff(part[order])) + 1):
            found += _stars(group, radius)
    return found


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Links a, b between distinct fingerprints (column _fp) that connect exactly what all pairs within the radius connect."""
    masks = covering_masks(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        owner: tuple[int, int] | None = None

        def out(found: list[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
            if found:
                a = np.concatenate([x for x, _ in found])
                b = np.repeat(np.array([r for _, r in found], np.uint64), [len(x) for x, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            v, key, fp = batch.column("v").to_numpy(), batch.column("key").to_numpy(), batch.column("_fp").to_numpy().view(np.uint64)
            edges = np.concatenate(([0], np.flatnonzero((np.diff(v) != 0) | (np.diff(key) != 0)) + 1, [len(v)]))
            found = []
            for i in np.flatnonzero((np.diff(edges) > 1) | (np.arange(len(edges) - 1) == 0) | (np.arange(len(edges) - 1) == len(edges) - 2)):
                a, b = edges[i], edges[i + 1]
                if owner != (v[a], key[a]):
                    if sum(map(len, held)) > 1:
                        found += bucket_links(np.concatenate(held), masks[owner[0]], radius)
                    held, owner = [], (int(v[a]), int(key[a]))
                held.append(fp[a:b])
            yield from out(found)
        if sum(map(len, held)) > 1:
            yield from out(bucket_links(np.concatenate(held), masks[owner[0]], radius))

    tables = F.array(*[F.struct(F.lit(i).alias("v"), F.col("_fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    rows = prints.select("_fp").distinct().select("_fp", F.explode(tables).alias("t")).select("t.v", "t.key", "_fp")
    return rows.repartition("v", "key").sortWithinPartitions("v", "key", "_fp").mapInArrow(run, "a long, b long")


def groups(prints: DataFrame, radius: int = 4) -> DataFrame:
    """_fp, root of every distinct fingerprint: fingerprints linked within the radius, directly or over others, share the root."""
    known = components(links(prints, radius), "simhash")
    return prints.select("_fp").distinct().join(known.withColumnRenamed("node", "_fp"), "_fp", "left").select("_fp", F.coalesce("root", "_fp").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id of all documents it is linked with) of every document.

    Null text: no words, fingerprint zero, linked like any other. A null doc_id keeps its row and names no component (null only if
    nothing else is linked). Repeated rows stay. An empty table gives no rows; other columns are not read. Equal fingerprints are one
    node of the graph, so a large group of copies costs one row in the search.
    """
    ship(docs.sparkSession)
    prints = saved(with_fingerprint(docs, size), "fingerprints")
    first = prints.groupBy("_fp").agg(F.min("doc_id").alias("first"))
    rooted = saved(groups(prints, radius).join(first, "_fp"), "simhash-groups")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.select("_fp", "root").join(named, "root").select("_fp", "component_id")
    return prints.join(by_print, "_fp").select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def alike(marked: DataFrame, size: int, least: float, radius: int) -> DataFrame:
    """_fp, root of every distinct shingle set: sets of texts whose fingerprints (_sim) are linked within the radius, as in ``near_duplicates``, and
    sets with a Jaccard similarity of at least least are linked; those linked directly or over others share the root. Both kinds of links go to one
    search for components, links between fingerprints as links between one set of each: every round of it costs the driver plans and tasks to keep."""
    owners = saved(marked.select("_fp", "_sim").distinct(), "owners")
    first = owners.groupBy("_sim").agg(F.min("_fp").alias("first"))
    by_print = owners.join(first, "_sim").select(F.col("_fp").alias("a"), F.col("first").alias("b"))
    ends = [first.select(F.col("_sim").alias(x), F.col("first").alias(f"_{x}")) for x in "ab"]
    between = links(owners.select(F.col("_sim").alias("_fp")), radius).join(ends[0], "a").join(ends[1], "b").select("_a", "_b")
    known = components(by_print.union(between).union(shingles.links(marked, size, least)), "alike-all").withColumnsRenamed({"node": "_fp", "root": "top"})
    return owners.select("_fp").distinct().join(known, "_fp", "left").select("_fp", F.coalesce("top", "_fp").alias("root"))


def one_of_each(docs: DataFrame, size: int = 5, least: float = 0.8, print_size: int = 4, radius: int = 4) -> DataFrame:
    """The documents, all columns, less all but one of each group of near copies: documents whose fingerprints differ in at most radius bits (the
    covering search of ``near_duplicates``) or whose word shingles have a Jaccard similarity of at least least, directly or over others. The one
    with the least (doc_id, name of its shingle set) stays, of repeated rows any one; a null doc_id counts as larger than all others.

    Null text: no shingles; texts without any are copies of each other. Texts of any length are compared as a whole. Columns of any name pass through
    unchanged. The survivors' keys are different, so the join with the texts has no hot key.
    """
    ship(docs.sparkSession)
    given = docs.columns
    own = [c if c in ("doc_id", "text") else f"own{i}" for i, c in enumerate(given)]
    docs = docs.toDF(*own)
    marked = saved(shingles.with_signatures(docs, size, lambda texts: fingerprints(texts, print_size)), "marked")
    prints = marked.select("doc_id", "_fp")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_fp")
    rooted = saved(alike(marked, size, least, radius), "alike-groups")
    first = prints.groupBy("_fp").agg(F.min(key).alias("key"))
    winners = first.join(rooted, "_fp").groupBy("root").agg(F.min("key").alias("key"))
    same = prints.groupBy("doc_id", "_fp").agg(F.count("*").alias("n"))
    stay = winners.select(F.col("key.doc_id").alias("_id"), F.col("key._fp").alias("_fp")).join(
        same.where("n > 1").select(F.col("doc_id").alias("_id2"), F.col("_fp").alias("_fp2"), "n"), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_fp") == F.col("_fp2")), "left").select("_id", "_fp", F.coalesce("n", F.lit(1)).alias("_n"))
    found = marked.select(*own, "_fp").join(stay.withColumnRenamed("_fp", "_fp2"), (F.col("_fp") == F.col("_fp2")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    once, more = found.where("_n = 1").select(*own), found.where("_n > 1").dropDuplicates(["_fp2", "_id"]).select(*own)
    return once.unionByName(more).toDF(*given)


def op6_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
