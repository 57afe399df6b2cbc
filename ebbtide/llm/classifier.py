"""Quality classifier from weak labels: expectation-maximisation finds how reliable overlapping heuristic labellers are, and their posterior
labels train a hashed linear scorer, which decides alone. Two questions are asked of every document: is it of low quality, is it toxic.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.llm import textstats as ts
from ebbtide.llm.common import documents, saved, ship, slices, text_of

BATCH_BYTES = 1 << 20
BAD, NONE, GOOD = 0, 1, 2
TRAIN_ROWS = 4_000           # different texts that the scorer is fitted on, about; never more than twice as many
LEAST_TEXTS = 5              # a feature needs so many of them
STEMS = (4, 5, 7)            # letters of a stem
PURE = 0.9                   # share of toxic texts among those with a marker

_SYMBOLS, _UPPER = ts.byte_class("#*$%&|<>"), ts.byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARKS = ts.byte_class("!?\"'()[]{}=+_~^@\\/")
_LETTER = ~ts.byte_class("".join(map(chr, range(128)))) | _UPPER | ts.byte_class("abcdefghijklmnopqrstuvwxyz")
_OTHER = ~_LETTER & ~ts.byte_class("0123456789 \t\n\r\x0b\x0c")
_TO_WORDS = bytes(b + 32 if _UPPER[b] else b if _LETTER[b] else 0x20 for b in range(256))

#: Fixed lists: common insults and words of contempt. The lists overlap, so that the labellers do.
INSULTS = "idiot idiots moron morons loser losers scum clown clowns imbecile dumbass jerk fool bastard bitch"
CONTEMPT = "stupid pathetic worthless disgusting trash scum garbage vermin filth filthy subhuman moron idiot loser retarded hate"
BLUNT = "stupid idiot trash pathetic clown worthless moron disgusting loser scum"
LISTS = [sorted(set(x.split())) for x in (INSULTS, CONTEMPT, BLUNT)]

#: Share of a text: at this or more it speaks for low quality, below that for good.
SHARES = {"symbols_a_word": (0.10, 0.03), "upper_share": (0.30, 0.12), "marks_a_word": (0.30, 0.06), "repeat_share": (0.30, 0.10), "echo_share": (0.10, 0.02),
          "other_chars": (0.14, 0.07), "dup_line_share": (0.30, 0.10), "same_words": (0.80, 0.70)}
_STEPS = (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.65, 0.8)


def shares(texts: pa.Array) -> dict[str, np.ndarray]:
    words, offsets = ts.split_words(texts)
    number, names = ts.coded(words)
    n, chars = np.diff(offsets) + 10, ts.word_chars(texts) + 60   # so that short texts don't show large shares
    lines, dup = ts.duplicate_lines(texts)
    data, at = ts.raw(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    echo = np.zeros(len(number), bool)
    echo[1:] = (number[1:] == number[:-1]) & (doc[1:] == doc[:-1])
    different = np.bincount(np.unique(doc * max(len(names), 1) + number) // max(len(names), 1), minlength=len(texts))
    return {"symbols_a_word": ts.per_text(_SYMBOLS[data], at) / n, "upper_share": ts.per_text(_UPPER[data], at) / chars, "marks_a_word": ts.per_text(_MARKS[data], at) / n,
            "repeat_share": ts.repeated_words(number, offsets) / n, "echo_share": ts.per_text(echo, offsets) / n,
            "other_chars": ts.per_text(_OTHER[data], at) / chars, "dup_line_share": dup / (lines + 2), "same_words": (np.diff(offsets) - different) / n}


def letter_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters, A-Z lower-cased, and where the texts start and end among them."""
    data, offsets = ts.raw(texts)
    plain = data.tobytes().translate(_TO_WORDS)
    return ts.split_words(pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(plain)]))


def quality_votes(s: dict[str, np.ndarray]) -> np.ndarray:
    return np.column_stack([np.where(s[k] >= bad, BAD, np.where(s[k] < good, GOOD, NONE)) for k, (bad, good) in SHARES.items()])


def forms(names: pa.Array) -> dict[int, pa.Array]:
    """Each word itself (0) and its stems by length; a word that is not longer than the stem has none ('')."""
    n = pc.utf8_length(names)
    return {0: names} | {k: pc.if_else(pc.greater(n, k), pc.utf8_slice_codeunits(names, 0, k), "") for k in STEMS}


Markers = dict[int, frozenset[str]]


def toxic_votes(words: pa.Array, offsets: np.ndarray, markers: Markers) -> np.ndarray:
    """Each labeller looks for the words of its list or for markers: whole words, stems, any; the last wants two places of the third."""
    number, names = ts.coded(words)
    among = lambda xs, known: np.asarray(pc.is_in(xs, value_set=pa.array(sorted(known), pa.string())), dtype=bool)
    marked = {n: among(xs, markers.get(n, ())) for n, xs in forms(names).items()}
    found = []
    for listed, kinds in zip(LISTS, ((0,), STEMS, (0, *STEMS)), strict=True):
        has = among(names, listed) | np.any([marked[n] for n in kinds], axis=0)
        found.append(ts.per_text(has[number], offsets) if len(number) else np.zeros(len(offsets) - 1, np.int64))
    return np.column_stack([*[np.where(f > 0, BAD, GOOD) for f in found], np.where(found[2] > 1, BAD, np.where(found[2] == 1, NONE, GOOD))])


def _perhaps_labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The documents whose doc_id can be among the known ones, by a table of 16 bits for each of those (one of 16 others passes): so that the join
    doesn't move the texts of all others."""
    if docs.schema["doc_id"].dataType != known.schema["doc_id"].dataType:
        return docs
    size = 16 * max(known.count(), 64)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    places, table = known.select(place.alias("at")).toArrow()["at"].to_numpy(), np.zeros(size // 8, np.uint8)
    np.bitwise_or.at(table, places >> 3, (128 >> (places & 7)).astype(np.uint8))
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_at").to_numpy()
            yield batch.select(["doc_id", "text"]).filter(pa.array((sent.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))

    return docs.withColumn("_at", place).mapInArrow(run, docs.schema)


def find_markers(docs: DataFrame, labels: DataFrame) -> Markers:
    """Words and stems that occur in toxic labelled texts (almost) only, more often than chance gives among all. All labelled documents are
    read; equal texts count once, as toxic if one of them is. Rows with null doc_id or label don't take part."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    texts = _perhaps_labelled(docs.select("doc_id", text_of().alias("text")), known).join(known, "doc_id").groupBy("text").agg(F.max("_toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                words, offsets = letter_words(part.column("text"))
                number, names = ts.coded(words)
                toxic = np.asarray(part.column("toxic")) > 0
                doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([" "]), pa.array([part.num_rows]), pa.array([int(toxic.sum())])], ["n", "stem", "texts", "bad"])
                for n, xs in forms(names).items():
                    code, stems = ts.coded(xs)
                    pairs = np.unique(doc * max(len(stems), 1) + code[number])
                    hit = toxic[pairs // max(len(stems), 1)]
                    texts, bad = (np.bincount((pairs % max(len(stems), 1))[m], minlength=len(stems)) for m in (slice(None), hit))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(stems), n, np.int32)), stems, pa.array(texts), pa.array(bad)], ["n", "stem", "texts", "bad"])

    counted = saved(texts.mapInArrow(run, "n int, stem string, texts long, bad long").where("stem <> ''").groupBy("n", "stem").agg(F.sum("texts").alias("texts"), F.sum("bad").alias("bad")), "stems")
    every = counted.where("n < 0").first()   # all texts
    if every is None or not 0 < every["bad"] < every["texts"]:
        return {}
    share = every["bad"] / every["texts"]
    tested = counted.where("n >= 0").count()
    least = np.log(0.01 / max(tested, 1)) / np.log(share)
    found = counted.where((F.col("n") >= 0) & (F.col("bad") >= float(least)) & (F.col("bad") >= PURE * F.col("texts"))).collect()
    return {n: frozenset(r["stem"] for r in found if r["n"] == n) for n in (0, *STEMS)}


def hashed(names: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in names), np.uint64, len(names))


def word_features(names: pa.Array) -> np.ndarray:
    """Hashes of each word and of its stems; one row for each word."""
    return np.column_stack([ts.hashes(xs, n) for n, xs in forms(names).items()])


def shape_features(s: dict[str, np.ndarray]) -> np.ndarray:
    """A hash of each share's name and step; one row for each text."""
    out = []
    for k in SHARES:
        table = hashed([f"\x1f{k}:{i}" for i in range(len(_STEPS) + 1)])
        out.append(table[np.searchsorted(_STEPS, s[k], side="right")])
    return np.column_stack(out)


@dataclass
class Reliability:
    """P(bad) and, for each labeller, the chances of its votes if the text is bad (row 0) or good (row 1)."""

    bad: float
    votes: np.ndarray  # labeller x 2 x 3

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.log([self.bad, 1 - self.bad])[None, :] + sum(np.log(t[:, votes[:, j]]).T for j, t in enumerate(self.votes))
        return 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -500, 500)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Reliability:
    """EM over the different vote patterns and how often each occurs. It starts from: any vote against a text counts."""
    m = patterns.shape[1]
    p = np.where((patterns == BAD).any(axis=1), 0.9, 0.02)
    known = Reliability(0.5, np.full((m, 2, 3), 1 / 3))
    for _ in range(rounds):
        w = np.column_stack([p, 1 - p]) * counts[:, None]
        total = w.sum(axis=0)
        votes = np.stack([np.stack([np.bincount(patterns[:, j], w[:, c], 3) for c in (0, 1)]) for j in range(m)]) + 0.01
        known = Reliability(float(np.clip((total[0] + 0.1) / (total.sum() + 0.2), 1e-6, 1 - 1e-6)), votes / votes.sum(axis=2, keepdims=True))
        new = known.posterior(patterns)
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return known


@dataclass
class Design:
    """Which feature (column) each text (row) has, of those that LEAST_TEXTS have, and the columns' hashes."""

    row: np.ndarray
    column: np.ndarray
    names: np.ndarray


def design(sets: list[np.ndarray]) -> Design:
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(f) for f in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    names, n = np.unique(flat, return_counts=True)
    names = names[n >= LEAST_TEXTS]
    column = np.searchsorted(names, flat).astype(np.int32)
    keep = names[np.minimum(column, len(names) - 1)] == flat if len(names) else np.zeros(len(flat), bool)
    return Design(row[keep], column[keep], names)


def fit_linear(x: Design, target: np.ndarray, l1: float = 2e-4, rounds: int = 300) -> tuple[dict[int, float], float]:
    """Logistic regression with an L1 penalty (FISTA, full passes) on sets of feature hashes and soft targets: weights by hash, and the bias."""
    row, column, names = x.row, x.column, x.names
    share = float(np.clip(target.mean() if len(target) else 0.5, 1e-4, 1 - 1e-4))
    bias = np.log(share / (1 - share))
    scale = 1 / np.sqrt(np.maximum(np.bincount(column, minlength=len(names)) / max(len(target), 1), 1e-2))   # less frequent features step as far as frequent ones
    value = scale[column]
    v, largest = np.ones(len(names)), 1.0
    for _ in range(20 if len(names) else 0):   # the largest curvature, by power iteration
        v = np.bincount(column, value * np.bincount(row, value * v[column], len(target))[row], len(names))
        largest = float(np.linalg.norm(v))
        v /= largest
    step = 4.0 / (1.1 * largest / max(len(target), 1) + 1.0)
    w = momentum = np.zeros(len(names))
    b = b_momentum = bias
    t = 1.0
    for _ in range(rounds if len(target) else 0):
        z = np.bincount(row, (momentum * scale)[column], len(target)) + b_momentum
        g = (1 / (1 + np.exp(-z)) - target) / len(target)
        new = momentum - step * scale * np.bincount(column, g[row], len(names))
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_b = b_momentum - step * g.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((momentum - new) * (new - w)).sum() > 0:   # restart where the momentum points uphill
            t_new = 1.0
        momentum, b_momentum = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    real = w * scale
    return {int(h): float(x) for h, x in zip(names, real, strict=True) if x}, float(b)


@dataclass
class Model:
    """Weights by feature hash (sorted) for the two questions, their biases, and the labellers' reliability."""

    hashes: np.ndarray
    weights: np.ndarray  # 2 x features
    biases: np.ndarray
    quality: Reliability
    toxic: Reliability

    def probabilities(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """P(low quality) and P(toxic). Every feature counts once in a text."""
        words, offsets = letter_words(texts)
        number, names = ts.coded(words)
        shape = shape_features(shares(texts))
        out = np.repeat(self.biases[:, None], len(texts), axis=1)
        if len(self.hashes):
            def place(h: np.ndarray) -> np.ndarray:
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                return np.where(self.hashes[at] == h, at, -1)
            at = place(word_features(names).ravel()).reshape(-1, 1 + len(STEMS))
            doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
            pairs = np.unique(np.concatenate([doc[hit] * len(self.hashes) + at[number[hit], j] for j in range(1 + len(STEMS)) for hit in [np.flatnonzero(at[number, j] >= 0)]]))
            doc, column = pairs // len(self.hashes), pairs % len(self.hashes)
            by_shape = place(shape.ravel()).reshape(shape.shape)
            for k in (0, 1):
                out[k] += np.bincount(doc, self.weights[k][column], len(texts)) + np.where(by_shape >= 0, self.weights[k][by_shape], 0).sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
        return p[0], p[1]


def votes(docs: DataFrame, markers: Markers) -> DataFrame:
    """q and t, the votes on quality and toxicity as text, with n, how many documents have them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                texts = part.column("text")
                both = [quality_votes(shares(texts)), toxic_votes(*letter_words(texts), markers)]
                yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, r)) for r in v.tolist()], pa.string()) for v in both], ["q", "t"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "q string, t string").groupBy("q", "t").agg(F.count("*").alias("n"))


def _patterns(rows: list, k: str) -> tuple[np.ndarray, np.ndarray]:
    return np.array([[int(c) for c in r[k]] for r in rows], np.int64), np.array([r["n"] for r in rows], float)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The votes of all documents give the labellers' reliability (the driver sees one row per vote pattern); the scorer is fitted on
    about ``rows`` different texts, drawn by their hash."""
    ship(docs.sparkSession)
    markers = find_markers(docs, labels)
    found = votes(docs, markers).collect()
    if not found:
        none = Reliability(0.5, np.full((1, 2, 3), 1 / 3))
        return Model(np.zeros(0, np.uint64), np.zeros((2, 0)), np.array([-1.0, -1.0]), none, none)
    quality, toxic = estimate(*_patterns(found, "q")), estimate(*_patterns(found, "t"))
    different = docs.agg(F.approx_count_distinct(F.xxhash64(text_of()), 0.02)).first()[0]
    share = int(min(1.0, rows / max(different, 1)) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                texts = part.column("text")
                s = shares(texts)
                words, offsets = letter_words(texts)
                number, names = ts.coded(words)
                h, shape = word_features(names), shape_features(s)
                sets = [np.concatenate([np.unique(h[number[a:b]].ravel()), r]).tobytes() for a, b, r in zip(offsets[:-1], offsets[1:], shape, strict=True)]
                p = [quality.posterior(quality_votes(s)), toxic.posterior(toxic_votes(words, offsets, markers))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, p), pa.array(sets, pa.binary())], ["q", "t", "features"])

    drawn = docs.select(text_of().alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share).dropDuplicates(["text"])
    sample = drawn.mapInArrow(run, "q double, t double, features binary").limit(2 * rows).toArrow()
    sets = [np.frombuffer(x, np.uint64) for x in sample["features"].to_pylist()]
    targets = [sample[k].to_numpy() for k in ("q", "t")]
    matrix = design(sets)
    del sets, sample
    heads = [fit_linear(matrix, y) for y in targets]
    pa.default_memory_pool().release_unused()
    hashes = np.array(sorted({h for w, _ in heads for h in w}), np.uint64)
    weights = np.array([[w.get(int(h), 0.0) for h in hashes] for w, _ in heads]).reshape(2, len(hashes))
    return Model(hashes, weights, np.array([b for _, b in heads]), quality, toxic)


ADDED = ["p_low", "p_toxic", "kept"]


def classify(docs: DataFrame, model: Model, threshold: float = 0.5, added: Sequence[str] = ADDED) -> DataFrame:
    """All rows and columns with p_low, p_toxic and kept (both below the threshold) added under the names ``added``; columns of these names
    are replaced.

    Null text: judged as an empty one. Null and repeated doc_ids keep their rows; an empty table gives no rows. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    ship(docs.sparkSession)
    own = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                low, toxic = sent.value.probabilities(part.column("text").fill_null(""))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(low), pa.array(toxic), pa.array((low < threshold) & (toxic < threshold))], [*part.schema.names, *added])

    kept = docs.select(*own)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, k) for n, k in zip(added, (T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True))])
    return kept.mapInArrow(run, schema)


def op8_weak_label_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return classify(docs.select("doc_id", "text"), train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select("doc_id", "p_low", "p_toxic", "kept")
