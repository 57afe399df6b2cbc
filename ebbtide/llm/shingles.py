"""Texts with like word shingles: bands of minimal hashes find candidates, the exact Jaccard similarity of the shingle sets decides."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.llm import textstats as ts
from ebbtide.llm.common import saved, slices, text_of
from ebbtide.llm.components import components

BATCH_BYTES = 2 << 20
SEED = 42
BANDS, ROWS = 20, 6      # a pair of similarity 0.8 shares no band with probability (1 - 0.8**6)**20 = 0.0023
SLACK = 0.2              # places of the sketch that may agree less often than the similarity asks for: 5.5 deviations at 0.8
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's word shingles, repeats included, and how many each text has. Fewer words than size: one shingle of all."""
    words, offsets = ts.split_words(pc.ascii_lower(texts))
    n = np.diff(offsets) if len(texts) else np.zeros(0, np.int64)
    shingles = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    if not len(words):
        return np.zeros(0, np.uint64), shingles
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_buffer()
    ends = np.cumsum(np.asarray(pc.binary_length(words), dtype=np.int64) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(shingles)[:-1])), shingles) + np.arange(shingles.sum())
    last = np.minimum(first + size, np.repeat(offsets[1:], shingles)) - 1
    view, of = memoryview(joined), xxhash.xxh64_intdigest
    return np.fromiter((of(view[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(first)), shingles


def sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    h, n = hashes(texts, size)
    return [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])] if len(n) else []


def signatures(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: a 64-bit name of its shingle set, the keys of its bands, and one byte of each minimal hash."""
    h, n = hashes(texts, size)
    edges = np.concatenate(([0], np.cumsum(n)))
    name = np.array([xxhash.xxh64_intdigest(np.unique(h[a:b]).tobytes(), SEED) for a, b in zip(edges[:-1], edges[1:], strict=True)], np.uint64)
    low, full = np.zeros((len(n), len(_FACTORS)), np.uint64), n > 0
    if full.any():
        at = edges[:-1][full]
        for k, factor in enumerate(_FACTORS):
            low[full, k] = np.minimum.reduceat(h * factor, at)
    key = np.zeros((len(n), BANDS), np.uint64)
    for j in range(ROWS):
        key = (key ^ low[:, j::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return name, key, low.astype(np.uint8)


def with_signatures(docs: DataFrame, size: int, prints: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """All columns, and _row (a number of the row's own), _fp (name of the shingle set), _bands, _sketch and _sim, what ``prints`` makes of the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                texts = part.column("text").fill_null("")
                name, key, sketch = signatures(texts, size)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS), pa.array(key.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(name.view(np.int64)), keys, pa.array([x.tobytes() for x in sketch], pa.binary()),
                                                  pa.array(prints(texts).view(np.int64))], [*part.schema.names, "_fp", "_bands", "_sketch", "_sim"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_fp", T.LongType()), T.StructField("_bands", T.ArrayType(T.LongType())), T.StructField("_sketch", T.BinaryType()), T.StructField("_sim", T.LongType())])
    return docs.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id())


def stars(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links (member, root) that connect what near(member, others) connects. A member is compared with those not reached so far only."""
    found, rest = [], np.arange(n)
    while len(rest) > 1:
        root, rest = int(rest[0]), rest[1:]
        todo = [root]
        while todo and len(rest):
            is_near = near(todo.pop(), rest)
            new = rest[is_near].tolist()
            found += [(x, root) for x in new]
            todo += new
            rest = rest[~is_near]
    return found


def sketch_links(sketches: list[bytes], least: float) -> list[tuple[int, int]]:
    s = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    return stars(len(s), lambda x, rest: (s[rest] == s[x]).mean(axis=1) >= least - SLACK)


def exact_links(texts: list[str], size: int, least: float) -> list[tuple[int, int]]:
    """Links that connect what pairs with a Jaccard similarity of at least least connect."""
    held = [x for x in sets(pa.array(texts, pa.string()), size)]
    count = np.array([len(x) for x in held])
    code = np.unique(np.concatenate(held), return_inverse=True)[1]
    edges = np.concatenate(([0], np.cumsum(count)))
    own = np.zeros(int(code.max(initial=-1)) + 1, bool)

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        mine = code[edges[x]:edges[x + 1]]
        own[mine] = True
        upto = np.concatenate(([0], np.cumsum(own[code])))
        own[mine] = False
        both = upto[edges[rest + 1]] - upto[edges[rest]]
        return both >= least * (count[rest] + count[x] - both) - 1e-9

    return stars(len(held), near)


def _links(rows: DataFrame, keys: list[str], column: str, linked: Callable[[list], list[tuple[int, int]]]) -> DataFrame:
    """a, b: linked(values of column) inside each group of rows with equal keys, by _fp."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        owner: tuple | None = None

        def out() -> Iterator[pa.RecordBatch]:
            found = linked([x for _, x in held]) if len(held) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([held[i][0] for i, _ in found], pa.int64()), pa.array([held[i][0] for _, i in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for *key, fp, value in zip(*[batch.column(c).to_pylist() for c in (*keys, "_fp", column)], strict=True):
                if owner != tuple(key):
                    yield from out()
                    held, owner = [], tuple(key)
                held.append((fp, value))
        yield from out()

    return rows.select(*keys, "_fp", column).repartition(*keys).sortWithinPartitions(*keys, "_fp").mapInArrow(run, "a long, b long")


def links(marked: DataFrame, size: int, least: float) -> DataFrame:
    """Links a, b between names of shingle sets (_fp) that connect what all pairs with a Jaccard similarity of at least least that share a band connect.

    ``marked`` are written rows (their _row doesn't change). Equal sets are one node, whose text is read from one of their rows, found by its
    number: a large group of copies moves no texts. Texts reach the exact check where the sketch has a neighbour only, once each; a task holds
    the shingles of one group of such neighbours.
    """
    named = marked.groupBy("_fp").agg(F.min("_row").alias("_row"))
    one = saved(marked.join(named.select("_row"), "_row").select("_fp", "_row", "_bands", "_sketch"), "sketches")
    order = Window.partitionBy("v", "key").orderBy("_fp")
    bands = one.select("_fp", F.posexplode("_bands").alias("v", "key"))
    met = bands.withColumn("met", F.lag("_fp").over(order).isNotNull() | F.lead("_fp").over(order).isNotNull()).where("met").select("v", "key", "_fp")
    close = _links(met.join(one.select("_fp", "_sketch"), "_fp"), ["v", "key"], "_sketch", lambda x: sketch_links(x, least))
    known = components(close, "candidates").select(F.col("node").alias("_fp"), F.col("root").alias("near"))
    asked = one.select("_fp", "_row").join(known, "_fp")
    texts = marked.select("_row", text_of().alias("text")).join(asked, "_row").select("_fp", "near", "text")
    return _links(texts, ["near"], "text", lambda x: exact_links(x, size, least))
