"""Benchmark decontamination by latent semantic retrieval.

Passages become TF-IDF vectors over the benchmark's words, a distributed randomised SVD gives the latent space, and windows of all documents
are compared with all benchmark items, long ones in overlapping parts, there by cosine. Candidates are checked by the longest common subsequence of words, which bears
inserted, dropped and replaced words, and by the item's rarest words, those that make up its answer, and its numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ebbtide.llm import textstats as ts
from ebbtide.llm.common import documents, saved, ship, slices, text_of

BATCH_BYTES = 2 << 20
BLOCK = 12                   # words; windows are 2 and 4 blocks
WINDOWS = ((2, 1), (4, 2))   # blocks in a window, blocks from one to the next
PART, PART_STEP = 4 * BLOCK, 2 * BLOCK   # words of a passage and of a long item's parts, and from one part to the next
RANK, OVERSAMPLE = 64, 32
ITEM_WEIGHT, ITEM_TEXTS = 10.0, 4_000   # of an item's row beside a passage's; its square grows with the texts from so many on, so that they don't drown the items
FIT_DOCS: int | None = None  # bounds the different texts that the latent space is fitted on (drawn by their hash); None: all
GRAM_WORDS = 4_096           # words that a task sums the products of at once
PAIRS = 1 << 22              # products summed at once
LEAST_COSINE, LEAST_PART = 0.35, 0.3   # of a candidate: cosine, and the item's squared length that the window's vector covers along it
LEAST_LCS, LEAST_ANSWER = 0.6, 0.5
SHORT_ITEM = 8               # an item with fewer words must be there as a whole
SUM_PARTS = 16
SUM_GROUPS = 32

_FLAT = {"word": np.int32, "times": np.uint8, "begins": np.uint8}
_DIGIT = ts.byte_class("0123456789")
_LETTER = ts.byte_class("abcdefghijklmnopqrstuvwxyz")
_LETTER[0x80:] = True
_TO_WORDS = np.where(_DIGIT | _LETTER, np.arange(256), 0x20).astype(np.uint8)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters and runs of digits, each a word of its own, lower-cased, and where the texts start and end among them."""
    data, offsets = ts.raw(pc.utf8_lower(texts))
    plain = _TO_WORDS[data]
    digit, letter = _DIGIT[plain], _LETTER[plain]
    cut = np.flatnonzero(digit[1:] & letter[:-1] | letter[1:] & digit[:-1]) + 1
    if len(cut):
        plain, offsets = np.insert(plain, cut, 0x20), offsets + np.searchsorted(cut, offsets)
    return ts.split_words(pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(plain.tobytes())]))


@dataclass
class Items:
    """The benchmark as word numbers. Its size bounds all that is sent to executors."""

    ids: list
    words: list[np.ndarray]
    names: pa.Array
    idf: np.ndarray
    n_docs: int
    kind: T.DataType


def numbers(texts: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word of the texts, len(names) for one the benchmark doesn't have, and where the texts start and end."""
    words, offsets = words_of(texts)
    number, known = ts.coded(words)
    place = pc.index_in(known, value_set=names).fill_null(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
    return (place[number] if len(number) else np.zeros(0, np.int64)), offsets


def passages(texts: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different benchmark words of each passage (PART words of a text), passage by passage in the order of their numbers, how often each is
    there, whether a passage begins with it, and where the texts start and end among them."""
    w, at = numbers(texts, names)
    n, m = np.diff(at), max(len(names), 1)
    first = np.concatenate(([0], np.cumsum(-(-n // PART))))
    passage = np.repeat(first[:-1], n) + (np.arange(len(w)) - np.repeat(at[:-1], n)) // PART
    known = w < len(names)
    key, times = np.unique(passage[known] * m + w[known], return_counts=True)
    passage = key // m
    return (key % m).astype(np.int32), times.astype(np.uint8), (np.diff(passage, prepend=-1) != 0).astype(np.uint8), np.searchsorted(passage, first)


def counted(docs: DataFrame, names: pa.Array) -> DataFrame:
    """word, times and begins (``passages`` as bytes) of every different text, and in copies how many documents have it. Texts are told apart by 128
    bits of hashes. Written to shared storage once; all that is counted or fitted reads it instead of the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                *flat, at = passages(part.column("text"), names)
                yield pa.RecordBatch.from_arrays([part.column("h1"), part.column("h2"), *[pa.array([v[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()) for v in flat]],
                                                 ["h1", "h2", *_FLAT])

    text = text_of()
    sent = docs.select(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text")).mapInArrow(run, "h1 long, h2 long, " + ", ".join(f"{c} binary" for c in _FLAT))
    return saved(sent.groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in _FLAT], F.count(F.lit(1)).alias("copies")), "passages")


def _flat(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in _FLAT.items()]


def load(docs: DataFrame, benchmark: DataFrame) -> tuple[Items, DataFrame | None]:
    """The items, and the inverse document frequency of their words over all documents; then the passages of the documents, None without items. Items
    without words are left out; equal items stay, as do items whose item_id is null; an item_id may be of any type."""
    rows = benchmark.select("item_id", text_of().alias("text")).orderBy("item_id", "text").collect()
    words, offsets = words_of(pa.array([r["text"] for r in rows], pa.string()))
    number, names = ts.coded(words)
    each = [(r["item_id"], number[a:b]) for r, a, b in zip(rows, offsets[:-1], offsets[1:], strict=True) if b > a]
    if not each:
        return Items([], [], names, np.zeros(0), 0, benchmark.schema["item_id"].dataType), None
    texts = counted(docs, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names) + 1, np.int64)
        for batch in batches:
            copies = batch.column("copies").to_numpy()
            n = np.array(pc.binary_length(batch.column("times")).to_pylist(), np.int64)   # a byte a word
            key = np.unique(np.repeat(np.arange(batch.num_rows), n) * len(names) + _flat(batch)[0])
            total[:-1] += np.bincount(key % len(names), copies[key // len(names)], len(names)).astype(np.int64)
            total[-1] += copies.sum()   # the last place counts documents
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["word", "n"])

    df = np.zeros(len(names) + 1)
    for r in texts.mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        df[r["word"]] = r["n"]
    idf = np.log((df[-1] + 2) / (df[:-1] + 1)) ** 2   # squared: frequent words would fill the latent space
    return Items([i for i, _ in each], [w for _, w in each], names, idf, int(df[-1]), benchmark.schema["item_id"].dataType), texts


def _matrix(passages: list[np.ndarray], idf: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A @ y for the unit TF-IDF rows A of the passages."""
    out = np.zeros((len(passages), y.shape[1]))
    for i, w in enumerate(passages):
        u, n = np.unique(w, return_counts=True)
        x = n * idf[u]
        out[i] = (x / max(np.linalg.norm(x), 1e-12)) @ y[u]
    return out


def _back(passages: list[np.ndarray], idf: np.ndarray, z: np.ndarray, n_words: int) -> np.ndarray:
    """A.T @ z."""
    out = np.zeros((n_words, z.shape[1]))
    for w, row in zip(passages, z, strict=True):
        u, n = np.unique(w, return_counts=True)
        x = n * idf[u]
        out[u] += np.outer(x / max(np.linalg.norm(x), 1e-12), row)
    return out


class Gram:
    """A.T @ A of passages' unit TF-IDF rows A, as sums over the pairs of words of a passage. ``done`` gets the words and their matrix: once, or where
    the benchmark has more than GRAM_WORDS words, for as many passages at a time as have fewer."""

    def __init__(self, idf: np.ndarray, done: Callable[[np.ndarray, np.ndarray], None]):
        self.idf, self.done = idf, done
        self.every = np.zeros((len(idf), len(idf))) if len(idf) <= GRAM_WORDS else None

    def add(self, word: np.ndarray, times: np.ndarray, begins: np.ndarray) -> None:
        if not len(word):
            return
        passage = np.cumsum(begins, dtype=np.int64) - 1
        x = times * self.idf[word]
        x /= np.maximum(np.sqrt(np.bincount(passage, x * x)), 1e-12)[passage]
        if self.every is not None:
            return _add_pairs(self.every, word, x, begins)
        different, own = np.unique(word, return_inverse=True)
        if len(different) > GRAM_WORDS and passage[-1]:
            half = int(np.searchsorted(passage, (passage[-1] + 1) // 2))
            self.add(word[:half], times[:half], begins[:half])
            return self.add(word[half:], times[half:], begins[half:])
        matrix = np.zeros((len(different), len(different)))
        _add_pairs(matrix, own, x, begins)
        self.done(different, matrix)

    def end(self) -> None:
        if self.every is not None:
            self.done(np.arange(len(self.idf)), self.every)


def _add_pairs(matrix: np.ndarray, word: np.ndarray, x: np.ndarray, begins: np.ndarray) -> None:
    """Adds the products of x by pairs of words of a passage; passages with as many words go together."""
    first, cells, m = np.flatnonzero(begins), matrix.reshape(-1), len(matrix)
    size, at, product, held = np.diff(first, append=len(word)), [], [], 0
    for n in np.unique(size).tolist():
        same, step = first[size == n], max(1, PAIRS // (16 * n * n))
        for a in range(0, len(same), step):
            place = same[a:a + step, None] + np.arange(n)
            w, v = word[place].astype(np.int32), x[place]
            at.append((w[:, :, None] * np.int32(m) + w[:, None, :]).ravel())
            product.append((v[:, :, None] * v[:, None, :]).ravel())
            held += len(at[-1])
            if held >= PAIRS:
                cells += np.bincount(np.concatenate(at), np.concatenate(product), m * m)
                at, product, held = [], [], 0
    if held:
        cells += np.bincount(np.concatenate(at), np.concatenate(product), m * m)


def latent(texts: DataFrame, items: Items, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """Words x rank: the right singular vectors of the passages' TF-IDF matrix, by randomised SVD. Rows are the benchmark items and the passages
    of all different texts (``counted``). Tasks that have a text send Y = A.T A Omega in SUM_GROUPS pieces, which executors add up in two steps;
    Y (Omega.T Y)^-1 Y.T stands for A.T A (Nystrom's form, for which one pass is enough)."""
    n_words = len(items.names)
    if FIT_DOCS is not None:
        texts = texts.where(F.pmod("h1", F.lit(1 << 30)) < int(min(1.0, FIT_DOCS / max(items.n_docs, 1)) * (1 << 30)))
    idf, width = items.idf, min(rank + OVERSAMPLE, n_words)
    weight = ITEM_WEIGHT**2 * max(1.0, texts.count() / ITEM_TEXTS)

    cells = (n_words, width)
    omega, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram = np.zeros(cells), None

        def projected(words: np.ndarray, matrix: np.ndarray) -> None:
            total[words] += matrix @ omega[words]

        for batch in batches:
            gram = gram or Gram(idf, projected)
            gram.add(*_flat(batch))
        if gram:
            gram.end()
        for k, piece in enumerate(np.array_split(total.ravel(), SUM_GROUPS)) if gram else ():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([piece.tobytes()], pa.binary())], ["k", "sums"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([sum(np.frombuffer(x.as_py()) for x in table["sums"]).tobytes()], pa.binary())})

    sent = texts.select(*_FLAT).mapInArrow(run, "k int, sums binary").withColumn("part", F.spark_partition_id() % SUM_PARTS)
    some = sent.groupBy("k", "part").applyInArrow(add, "k int, sums binary")
    got = some.groupBy("k").applyInArrow(add, "k int, sums binary").orderBy("k").collect()
    y = weight * _back(items.words, idf, _matrix(items.words, idf, omega), n_words)
    if got:
        y += np.concatenate([np.frombuffer(r["sums"]) for r in got]).reshape(cells)
    inner = omega.T @ y
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    real = value > 1e-10 * value.max()
    return np.linalg.svd(y @ (vector[:, real] / np.sqrt(value[real])), full_matrices=False)[0][:, :rank]


def parts_of(n: int) -> list[tuple[int, int]]:
    """The places where an item of n words is indexed: as a whole, and a longer one than PART also in overlapping parts, the last one at its end."""
    starts = [*range(0, n - PART, PART_STEP), n - PART] if n > PART else []
    return [(0, n), *[(a, a + PART) for a in starts]]


class Searcher:
    """Finds benchmark items in texts. A window close to any part of an item makes it a candidate; the whole item is checked."""

    def __init__(self, items: Items, space: np.ndarray):
        self.items, n = items, len(items.names)
        self.vectors = np.zeros((n + 1, space.shape[1] + 1), np.float32)   # the last column is the mass
        self.vectors[:n, :-1] = items.idf[:, None] * space
        self.vectors[:n, -1] = items.idf
        parts = [(k, w[a:b]) for k, w in enumerate(items.words) for a, b in parts_of(len(w))]
        self.item = np.array([k for k, _ in parts], np.int64)
        q = np.array([self.vectors[w, :-1].sum(axis=0) for _, w in parts]).reshape(len(parts), space.shape[1])
        self.length = np.maximum(np.linalg.norm(q, axis=1), 1e-9)
        self.q = q / self.length[:, None]
        mass = np.array([items.idf[w].sum() for _, w in parts])
        self.groups = [(g, mass[g].min()) for g in np.array_split(np.argsort(mass), 4) if len(g)]
        self.masks, self.answers, self.numbers = [], [], []
        number = np.asarray(pc.utf8_is_digit(items.names)) if n else np.zeros(0, bool)
        for w in items.words:
            self.numbers.append(frozenset(np.unique(w[number[w]]).tolist()))
            mask: dict[int, int] = {}
            for i, x in enumerate(w.tolist()):
                mask[x] = mask.get(x, 0) | 1 << i
            self.masks.append(mask)
            different = np.unique(w)
            rare = different[np.argsort(-items.idf[different], kind="stable")]
            self.answers.append(frozenset(rare[:max(3, len(rare) // 4)].tolist()))

    def lcs(self, item: int, words: list[int]) -> int:
        """Length of the longest common subsequence, one machine-word operation (or a few) a word."""
        n, mask = len(self.items.words[item]), self.masks[item]
        full = v = (1 << n) - 1
        for w in words:
            m = mask.get(w)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        return n - v.bit_count()

    def candidates(self, w: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """texts, first words, items and cosines of windows close to items, and the words in such a window."""
        n = np.diff(offsets)
        blocks = -(-n // BLOCK)
        doc = np.repeat(np.arange(len(n)), blocks)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK + offsets[doc]
        if not len(start):
            return
        sums = np.zeros((len(start), self.vectors.shape[1]), np.float32)
        for k in range(BLOCK):   # the k-th word of every block
            there = start + k < offsets[doc + 1]
            sums += self.vectors[np.where(there, w[np.minimum(start + k, len(w) - 1)], len(self.vectors) - 1)]
        for size, step in WINDOWS:
            first = np.flatnonzero((start - offsets[doc]) // BLOCK % step == 0)
            total = sums[first].copy()
            for k in range(1, size):
                inside = np.flatnonzero((first + k < len(doc)) & (doc[np.minimum(first + k, len(doc) - 1)] == doc[first]))
                total[inside] += sums[first[inside] + k]
            z, mass = total[:, :-1], total[:, -1]
            norm = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
            for group, least in self.groups:
                near = np.flatnonzero(mass >= LEAST_PART * least)
                for at in range(0, len(near), 1 << 15):
                    rows = near[at:at + (1 << 15)]
                    along = z[rows] @ self.q[group].T
                    i, j = np.nonzero((along >= LEAST_COSINE * norm[rows]) & (along >= LEAST_PART * self.length[group]))
                    yield doc[first[rows[i]]], start[first[rows[i]]], self.item[group[j]], along[i, j] / norm[rows[i], 0], size * BLOCK

    def check(self, item: int, span: list[int]) -> tuple[float, float]:
        """Share of the item in the longest common subsequence and share of its answer words; zeros if the span doesn't have the item."""
        n, mask = len(self.items.words[item]), self.masks[item]
        there = mask.keys() & set(span)
        answer = len(self.answers[item] & there) / len(self.answers[item])
        if self.numbers[item]:   # the same wording with other numbers is another item
            answer = min(answer, len(self.numbers[item] & there) / len(self.numbers[item]))
        if answer < LEAST_ANSWER or sum(mask[x].bit_count() for x in there) < LEAST_LCS * n:
            return 0.0, 0.0
        share = self.lcs(item, span) / n
        return (share, answer) if share >= (LEAST_LCS if n >= SHORT_ITEM else 1.0) else (0.0, 0.0)

    def find(self, texts: pa.Array) -> list[tuple[int, int, float, float, float]]:
        """text, item, cosine, share of the item in the longest common subsequence and share of its answer words, best of each pair."""
        w, offsets = numbers(texts, self.items.names)
        found, checked = {}, {}
        for docs, starts, items, cosines, size in self.candidates(w, offsets):
            for d, s, k, c in zip(docs.tolist(), starts.tolist(), items.tolist(), cosines.tolist(), strict=True):
                n = len(self.items.words[k])
                a, b = max(offsets[d], s - n), min(offsets[d + 1], s + size + n)
                if (k, a, b) not in checked:   # several parts of an item can lead to one span
                    checked[k, a, b] = self.check(k, w[a:b].tolist())
                share, answer = checked[k, a, b]
                if share and (share, answer, c) > found.get((d, k), (0, 0, 0)):
                    found[d, k] = (share, answer, c)
        return [(d, k, c, share, answer) for (d, k), (share, answer, c) in sorted(found.items())]


def prepare(docs: DataFrame, benchmark: DataFrame) -> Searcher | None:
    """The searcher for these documents; None if the benchmark has no words."""
    ship(docs.sparkSession)
    items, texts = load(docs, benchmark)
    return Searcher(items, latent(texts, items)) if texts is not None else None


def leaks(docs: DataFrame, searcher: Searcher | None) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share: one row for each document and benchmark item found in it.

    Null text: nothing found. Repeated documents have their rows repeated, null doc_ids and item_ids theirs with null. Items with equal texts are
    found each. Without documents or items no rows. Other columns are not read. No shuffle. A text of any length is searched as a whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(searcher)
    item = searcher.items.kind if searcher is not None else T.LongType()
    form = to_arrow_type(item)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES) if sent.value is not None else ():
                rows = sent.value.find(part.column("text"))
                d, k, c, share, answer = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d, pa.int64())), pa.array([sent.value.items.ids[x] for x in k], form),
                                                  *[pa.array(x, pa.float64()) for x in (c, share, answer)]], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, item_id {item.simpleString()}, cosine double, lcs_share double, answer_share double")


def without_leaks(docs: DataFrame, searcher: Searcher | None) -> DataFrame:
    """The documents, all columns, in which no item is found. A null text stays."""
    sent = docs.sparkSession.sparkContext.broadcast(searcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                keep = np.ones(part.num_rows, bool)
                if sent.value is not None:
                    keep[list(Counter(r[0] for r in sent.value.find(part.column("text").fill_null(""))))] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op2_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return leaks(docs, prepare(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
