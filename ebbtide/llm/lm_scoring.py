"""LM scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation over the whole training corpus.

The model predicts symbols: the most frequent words and the end have their own, every other word belongs to a class by its last two
bytes. A word of a class has the share (c + 1) / Z of it, with one place for unknown words, so that the probabilities of all words add
up to one. With the two symbols before as context, logits are sums of two table entries and the normalisers of *all* contexts are one
product of two symbol x symbol matrices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import textstats as ts
from ebbtide.llm.common import documents, saved, ship, slices, text_of

BATCH_BYTES, SYMBOL_BYTES = 4 << 20, 1 << 20   # of text and of symbols handled at once
HEAD, CLASSES = 960, 63            # symbols: HEAD words, the end, CLASSES classes
END = HEAD
SYMBOLS = HEAD + 1 + CLASSES
TABLE_WORDS, TABLE_BYTES = 1 << 18, 64   # words with counts sent to every executor: so many of at most so many bytes (16 MB)
DIM, NOISE, BATCH, ROUNDS, RATE = 32, 64, 2048, 2, 0.15
LEAST_STEPS = 200                  # of a task in a round: one with fewer goes through its rows again
BLOCKS = 64


def held_out() -> Column:
    """Documents kept from training: crc32 of the id as text leaves 2 modulo 7."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tail_class(words: pa.Array) -> np.ndarray:
    """The class symbol of each word, by its last two bytes."""
    data, offsets = ts.raw(words)
    ends = offsets[1:]
    last = data[ends - 1].astype(np.int64)
    before = np.where(np.diff(offsets) > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return HEAD + 1 + (last * 31 + before * 7) % CLASSES


@dataclass
class Vocabulary:
    """Counts of the frequent words (by descending count), and the totals."""

    words: pa.Array
    counts: np.ndarray
    n_tokens: int
    n_words: int
    n_docs: int
    class_total: np.ndarray  # Z by class

    @property
    def denominator(self) -> float:
        return self.n_tokens + self.n_words + 1

    def symbol_counts(self) -> np.ndarray:
        """Training tokens of each symbol, plus one."""
        out = np.ones(SYMBOLS)
        out[:min(HEAD, len(self.counts))] += self.counts[:HEAD]
        out[END] += self.n_docs
        out[HEAD + 1:] = self.class_total
        return out


def word_counts(train: DataFrame) -> DataFrame:
    """word, c of all training texts: counted batch by batch, then by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                words, _ = ts.split_words(pc.ascii_lower(part.column("text")))
                found = pc.value_counts(words)
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    return train.select(text_of().alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def vocabulary(counts: DataFrame, n_docs: int) -> Vocabulary:
    """counts: the written table of word_counts. The words sent out are those with the largest counts whose number stays within TABLE_WORDS."""
    level = F.floor(F.log2("c") * 16).cast("int")
    short = F.octet_length("word") <= TABLE_BYTES
    rows = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.count(F.when(short, 1)).alias("short")).orderBy(F.desc("level")).collect()
    upto, least = 0, None
    for r in rows:
        upto += r["short"]
        if upto > TABLE_WORDS:
            break
        least = r["level"]
    top = counts.where(short & (level >= (least if least is not None else 1 << 30))).toArrow()
    top = top.take(pc.sort_indices(top, sort_keys=[("c", "descending"), ("word", "ascending")])).combine_chunks()
    words = pa.concat_arrays(top["word"].chunks) if top.num_rows else pa.array([], pa.string())
    own = words.slice(0, HEAD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS)
        for b in batches:
            part = b.filter(pc.invert(pc.is_in(b.column("word"), value_set=own)))
            if part.num_rows:
                total += np.bincount(tail_class(part.column("word")), part.column("c").to_numpy() + 1.0, SYMBOLS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].astype(np.int64))], ["class", "z"])

    z = np.ones(CLASSES)
    for r in counts.mapInArrow(run, "class int, z long").groupBy("class").agg(F.sum("z").alias("z")).collect():
        z[r["class"] - HEAD - 1] += r["z"]
    return Vocabulary(words, top["c"].to_numpy(), sum(r["c"] for r in rows) + n_docs, sum(r["n"] for r in rows) + bool(n_docs), n_docs, z)


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """One row per document: rid (unique in the table once it is written), doc_id, held_out, symbols (uint16), known (words of the sent
    table and the end, if trained), log_c (sum of their log10(c + 1)) and rare: the words that the table doesn't have."""
    v = docs.sparkSession.sparkContext.broadcast((vocab.words, vocab.counts, vocab.n_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, n_docs = v.value
        log_c = np.concatenate([np.log10(counts + 1.0), [0.0]])
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                flat, offsets = ts.split_words(pc.ascii_lower(part.column("text")))
                number, names = ts.coded(flat)
                place = pc.index_in(names, value_set=words).fill_null(len(words)).to_numpy(zero_copy_only=False)
                symbol = np.where(place < min(HEAD, len(words)), place, tail_class(names) if len(names) else 0).astype(np.uint16)
                n = part.num_rows
                ends = offsets[1:] + np.arange(n)
                out = np.full(len(flat) + n, END, np.uint16)
                keep = np.ones(len(out), bool)
                keep[ends] = False
                out[keep] = symbol[number]
                rare = place[number] == len(words)
                upto = np.concatenate(([0], np.cumsum(log_c[place[number]])))
                doc_end = offsets[1:] + np.arange(1, n + 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array((task << 33) + row + np.arange(n)), part.column("doc_id"), part.column("held_out"),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate(([0], 2 * doc_end)).astype(np.int32)), pa.py_buffer(out)]),
                    pa.array(ts.per_text(~rare, offsets) + (n_docs > 0)), pa.array(upto[offsets[1:]] - upto[offsets[:-1]] + np.log10(n_docs + 1.0)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(rare)))[offsets].astype(np.int32)), flat.filter(pa.array(rare)))],
                    ["rid", "doc_id", "held_out", "symbols", "known", "log_c", "rare"])
                row += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text")).mapInArrow(
        run, f"rid long, doc_id {kind}, held_out boolean, symbols binary, known long, log_c double, rare array<string>")


Params = dict[str, np.ndarray]


def start(symbol_counts: np.ndarray, dim: int = DIM, seed: int = 7) -> Params:
    r = np.random.default_rng(seed)
    n = len(symbol_counts)
    return {"R": r.normal(0, 0.1, (n, dim)).astype(np.float32), "Q": r.normal(0, 0.1, (n, dim)).astype(np.float32),
            "C1": np.eye(dim, dtype=np.float32), "C2": 0.3 * np.eye(dim, dtype=np.float32), "b": np.log(symbol_counts / symbol_counts.sum()).astype(np.float32)}


def _scatter(rows: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(index, kind="stable")
    at = index[order]
    edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[at[edge]] = np.add.reduceat(rows[order], edge, axis=0)
    return out


class Trainer:
    """AdaGrad on the noise-contrastive loss. All rows of a batch share one draw of noise symbols, so both passes are matrix products."""

    def __init__(self, p: Params, noise: np.ndarray, seed: int, rate: float = RATE):
        self.p, self.rate, self.random = {k: v.copy() for k, v in p.items()}, rate, np.random.default_rng(seed)
        self.log_kq, self.upto = np.log(NOISE * noise).astype(np.float32), np.cumsum(noise)
        self.seen = {k: np.full_like(v, 1e-2) for k, v in p.items()}
        self.steps = 0

    def step(self, c2: np.ndarray, c1: np.ndarray, w: np.ndarray) -> None:
        p = self.p
        drawn = np.minimum(np.searchsorted(self.upto, self.random.random(NOISE)), len(self.upto) - 1)
        r1, r2 = p["R"][c1], p["R"][c2]
        q = r1 @ p["C1"] + r2 @ p["C2"]
        target = p["Q"][w]
        data = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, target) + p["b"][w] - self.log_kq[w]))  # 1 - P(data)
        noise = -1 / (1 + np.exp(-(q @ p["Q"][drawn].T + p["b"][drawn] - self.log_kq[drawn])))  # -P(data)
        dq = data[:, None] * target + noise @ p["Q"][drawn]
        n = len(p["b"])
        grad = {"Q": _scatter(data[:, None] * q, w, n), "b": np.bincount(w, data, n).astype(np.float32), "C1": r1.T @ dq, "C2": r2.T @ dq,
                "R": _scatter(dq @ p["C1"].T, c1, n) + _scatter(dq @ p["C2"].T, c2, n)}
        np.add.at(grad["Q"], drawn, noise.T @ q)
        np.add.at(grad["b"], drawn, noise.sum(axis=0))
        for k, g in grad.items():
            g /= len(w)
            self.seen[k] += g * g
            p[k] += self.rate * g / np.sqrt(self.seen[k])
        self.steps += 1


def contexts(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols two before and one before each; before a text stands the end."""
    c1 = np.concatenate(([END], symbols[:-1]))
    c1[starts] = END
    c2 = np.concatenate(([END], c1[:-1]))
    c2[starts] = END
    return c2, c1


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint16)[offsets[0] // 2:offsets[-1] // 2].astype(np.int64), (offsets - offsets[0]) // 2


def train(encoded: DataFrame, symbol_counts: np.ndarray, rounds: int = ROUNDS) -> Params:
    """Every task learns from all its training rows, starting where the round starts; the round ends with the mean of the tasks'
    parameters, weighted by tokens and taken in BLOCKS groups on the executors. The driver holds one set of parameters."""
    spark, p = encoded.sparkSession, start(symbol_counts)
    noise = symbol_counts / symbol_counts.sum()
    shapes = {k: v.shape for k, v in p.items()}
    rows = encoded.where("NOT held_out").select("symbols")
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, k=k) -> Iterator[pa.RecordBatch]:
            model, tokens, held = Trainer(sent.value, noise, 1000 * k + TaskContext.get().partitionId(), RATE / (1 + k)), 0, []

            def learn(c2: np.ndarray, c1: np.ndarray, w: np.ndarray) -> None:
                for at in range(0, len(w), BATCH):
                    model.step(c2[at:at + BATCH], c1[at:at + BATCH], w[at:at + BATCH])

            for b in batches:
                for part in slices(b, "symbols", SYMBOL_BYTES):
                    w, offsets = _symbols(part.column("symbols"))
                    c2, c1 = contexts(w, offsets[:-1])
                    learn(c2, c1, w)
                    tokens += len(w)
                    held = [*held, (c2, c1, w)] if model.steps < LEAST_STEPS else []
            while held and model.steps < LEAST_STEPS:
                for x in held:
                    learn(*x)
            if tokens:
                flat = np.concatenate([model.p[n].ravel() for n in sorted(model.p)]) * np.float64(tokens)
                pieces = np.array_split(flat, BLOCKS)
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([float(tokens)] * BLOCKS), pa.array([x.tobytes() for x in pieces])], ["block", "tokens", "sums"])

        def add(key: tuple, table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py()) for x in table["sums"])
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "mean": pa.array([(total / pc.sum(table["tokens"]).as_py()).tobytes()], pa.binary())})

        got = rows.mapInArrow(run, "block int, tokens double, sums binary").groupBy("block").applyInArrow(add, "block int, mean binary").orderBy("block").collect()
        if got:
            flat, at = np.concatenate([np.frombuffer(r["mean"]) for r in got]).astype(np.float32), 0
            for n in sorted(shapes):
                size = int(np.prod(shapes[n]))
                p[n] = flat[at:at + size].reshape(shapes[n])
                at += size
    return p


class Scorer:
    """log10 P(symbol | two symbols before), normalised over all symbols."""

    def __init__(self, p: Params):
        f = {k: v.astype(np.float64) for k, v in p.items()}
        self.m1, self.m2 = f["R"] @ f["C1"] @ f["Q"].T + f["b"], f["R"] @ f["C2"] @ f["Q"].T
        top1, top2 = self.m1.max(axis=1), self.m2.max(axis=1)
        product = np.exp(self.m2 - top2[:, None]) @ np.exp(self.m1 - top1[:, None]).T  # every context at once
        self.log_z = np.log(np.maximum(product, 1e-300)) + top2[:, None] + top1

    def __call__(self, c2: np.ndarray, c1: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (self.m1[c1, w] + self.m2[c2, w] - self.log_z[c2, c1]) / np.log(10)


@lru_cache(maxsize=2)
def _scorer(digest: str) -> Scorer:
    return Scorer(_SENT.pop(digest))


_SENT: dict[str, Params] = {}


def scorer_of(digest: str, p: Params) -> Scorer:
    """The tables of these parameters, built once in a worker."""
    _SENT[digest] = p
    return _scorer(digest)


def score_symbols(encoded: DataFrame, p: Params, vocab: Vocabulary) -> DataFrame:
    """rid, doc_id, held_out, n_tokens, known, log_c, part: the score without the counts of words in classes; head_log_c: what log_c has of words with own symbols."""
    digest = hashlib.sha256(b"".join(p[k].tobytes() for k in sorted(p))).hexdigest()
    own = np.zeros(SYMBOLS)
    own[:min(HEAD, len(vocab.counts))] = np.log10(vocab.counts[:HEAD] + 1.0)
    own[END] = np.log10(vocab.n_docs + 1.0)
    z = np.zeros(SYMBOLS)
    z[HEAD + 1:] = np.log10(vocab.class_total)
    sent = encoded.sparkSession.sparkContext.broadcast((p, own, z))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, own, z = sent.value
        scorer = scorer_of(digest, params)
        for batch in batches:
            for b in slices(batch, "symbols", SYMBOL_BYTES):
                w, offsets = _symbols(b.column("symbols"))
                each = scorer(*contexts(w, offsets[:-1]), w) - z[w]
                sums = [np.add.reduceat(x, offsets[:-1]) for x in (each, own[w])]
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in ("rid", "doc_id", "held_out")], pa.array(np.diff(offsets)), b.column("known"), b.column("log_c"), *map(pa.array, sums)],
                                                 ["rid", "doc_id", "held_out", "n_tokens", "known", "log_c", "part", "own_log_c"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("rid", "doc_id", "held_out", "symbols", "known", "log_c").mapInArrow(
        run, f"rid long, doc_id {kind}, held_out boolean, n_tokens long, known long, log_c double, part double, own_log_c double")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Null text: empty, the end alone. Null doc_id: in the training part, its row stays. Repeated rows stay. Without training documents all
    words are unknown. An empty table gives no rows; other columns are not read. Words outside the sent table get their counts by a join.
    """
    ship(docs.sparkSession)
    training = docs.where(~held_out())
    counts = saved(word_counts(training), "lm-counts")
    vocab = vocabulary(counts, training.count())
    encoded = saved(encode(docs, vocab), "lm-symbols")
    params = train(encoded, vocab.symbol_counts())
    rare = encoded.select("rid", F.explode("rare").alias("word")).groupBy("rid", "word").agg(F.count("*").alias("n"))
    rest = rare.join(counts, "word").groupBy("rid").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_log_c"))
    log_c = F.col("log_c") + F.coalesce("more_log_c", F.lit(0.0))
    return score_symbols(encoded, params, vocab).join(rest, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(vocab.n_tokens).cast("long").alias("train_tokens"),
        (log_c - F.col("n_tokens") * F.lit(float(np.log10(vocab.denominator)))).alias("base_score"), (F.col("part") + log_c - F.col("own_log_c")).alias("score"))


def op1_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
