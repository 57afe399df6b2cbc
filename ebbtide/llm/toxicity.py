"""Toxicity by a counterfactually regularised classifier: a hashed linear scorer whose score may not hang on which group a text speaks of.

In every labelled text that names a group the terms are swapped for others of their kind (and for the kind's neutral word). The fit adds
the squared change of the score between the text and its swapped forms to the logistic loss, so weight that rests on the mere mention of
a group moves to the words that make a text toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import textstats as ts
from ebbtide.llm.classifier import letter_words
from ebbtide.llm.common import documents, drawn, ship, slices, text_of

BATCH_BYTES = 1 << 20
FIT_ROWS = 12_000       # labelled documents that the scorer is fitted on, about; never more than twice as many
LEAST_TEXTS = 4         # a word feature needs so many of them
SWAPS = 4               # swapped forms of a text, the neutral one included
STRENGTH = 4.0          # weight of the squared score changes against the mean loss
PENALTY = 1.5e-3        # L1, per weighted text
PREFIX = 5              # letters of a word's beginning, a feature of its own for longer words

#: Fixed lists: terms of groups by kind, lower-case; the first of each kind is its neutral word.
TERMS = {
    "faith": "believers muslims christians jews hindus buddhists sikhs atheists catholics protestants",
    "faith_one": "believer muslim christian jew hindu buddhist sikh atheist catholic protestant",
    "faith_adjective": "religious islamic jewish",
    "origin": "foreign african american arab asian chinese european german french indian italian japanese mexican polish russian spanish turkish",
    "migration": "residents immigrants refugees migrants foreigners natives",
    "migration_one": "resident immigrant refugee migrant foreigner native",
    "gender": "people women men girls boys",
    "gender_one": "person woman man girl boy",
    "orientation": "dating gay lesbian bisexual straight transgender queer heterosexual",
    "colour": "coloured black white brown",
    "ability": "unwell disabled blind deaf autistic",
    "age": "grown elderly old young",
    "glaube": "gläubige muslime christen juden hindus buddhisten atheisten",
    "herkunft": "bewohner ausländer flüchtlinge einwanderer migranten",
    "geschlecht": "menschen frauen männer mädchen jungen",
    "foi": "croyants musulmans chrétiens juifs hindous bouddhistes athées",
    "origine": "habitants étrangers réfugiés immigrés migrants",
    "genre": "gens femmes hommes filles garçons",
    "fe": "creyentes musulmanes cristianos judíos hindúes budistas ateos",
    "origen": "habitantes extranjeros refugiados inmigrantes migrantes",
    "género": "personas mujeres hombres niñas niños",
}


def kinds(terms: dict[str, str]) -> dict[str, list[str]]:
    """Each term with the others of its kind, the neutral word first, then those that follow it in turn. A word of two kinds is of the first."""
    out: dict[str, list[str]] = {}
    for line in terms.values():
        words = line.split()
        for i, w in enumerate(words):
            if w not in out:
                out[w] = ([words[0]] if i else []) + [x for x in words[i + 1:] + words[1:i] if x != w]
    return out


def hashed(word: str) -> list[int]:
    """The features of a word: itself and, if it is longer than that, its beginning."""
    found = [xxhash.xxh64_intdigest(word)]
    return found + [xxhash.xxh64_intdigest(f"{word[:PREFIX]}\x1f")] if len(word) > PREFIX else found


def features(words: list[str]) -> np.ndarray:
    """Two columns; a short word has its own hash in both."""
    return np.array([(h[0], h[-1]) for h in map(hashed, words)], np.uint64).reshape(len(words), 2)


def swapped(own: list[str], others: dict[str, list[str]], swaps: int = SWAPS) -> list[tuple[set[int], set[int]]]:
    """For a text's different words: the features that each swapped form gains and loses. Every term moves on to the k-th other of its kind."""
    named = [w for w in own if w in others]
    if not named:
        return []
    rest = {h for w in own if w not in others for h in hashed(w)}
    before = {h for w in named for h in hashed(w)} - rest
    forms = []
    for k in range(swaps):
        after = {h for w in named for h in hashed(others[w][k % len(others[w])])} - rest
        if after != before and after not in forms:
            forms.append(after)
    return [(after - before, before - after) for after in forms]


# ---------------------------------------------------------------- the fit
class Sparse:
    """Rows of (column, value); both products by counting."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int):
        self.row, self.column, self.value, self.rows, self.columns = row, column, value, rows, columns

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.rows)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * g[self.row], self.columns)


def sparse(sets: list[np.ndarray], names: np.ndarray, scale: np.ndarray, signs: list[np.ndarray] | None = None) -> Sparse:
    """Rows from sets of feature hashes; those not in names are left out."""
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(names, flat), max(len(names) - 1, 0)).astype(np.int32)
    known = names[at] == flat if len(names) else np.zeros(len(flat), bool)
    del flat
    row, at = row[known], at[known]
    value = scale[at] if signs is None else scale[at] * (np.concatenate(signs)[known] if signs else 1.0)
    return Sparse(row, at, value, len(sets), len(names))


@dataclass
class Scorer:
    """Weights by feature hash (sorted) and a bias; every feature counts once in a text."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def margins(self, number: np.ndarray, names: list[str], offsets: np.ndarray) -> np.ndarray:
        texts = len(offsets) - 1
        if not len(self.hashes) or not len(number):
            return np.full(texts, self.bias)
        found = features(names)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        at = np.where(self.hashes[at] == found, at, -1)
        doc = np.repeat(np.arange(texts), np.diff(offsets))
        pairs = np.unique(np.concatenate([doc[hit] * len(self.hashes) + at[number[hit], j] for j in (0, 1) for hit in [np.flatnonzero(at[number, j] >= 0)]]))
        return self.bias + np.bincount(pairs // len(self.hashes), self.weights[pairs % len(self.hashes)], texts)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """P(toxic) of each text (no nulls)."""
        words, offsets = letter_words(texts)
        number, names = ts.coded(words)
        return 1 / (1 + np.exp(-np.clip(self.margins(number, names.to_pylist(), offsets), -500, 500)))


def fit(sets: list[np.ndarray], target: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray]], strength: float = STRENGTH, l1: float = PENALTY, rounds: int = 200) -> Scorer:
    """Logistic regression on sets of feature hashes with an L1 penalty and strength * mean squared score change (FISTA, full passes).

    changes: for each pair of a text and its swapped form, the features gained and lost. Features of identity terms count from their first
    text on, so that a swap is felt on both sides. Without both classes the scorer is the base rate alone.
    """
    share = float(np.clip(target.mean() if len(target) else 0.0, 1e-4, 1 - 1e-4))
    bias = float(np.log(share / (1 - share)))
    if not len(target) or target.min() == target.max():
        return Scorer(np.zeros(0, np.uint64), np.zeros(0), bias)
    flat, n = np.unique(np.concatenate(sets), return_counts=True)   # each feature of the texts and how many have it
    touched = np.unique(np.concatenate([x for c in changes for x in c])) if changes else np.zeros(0, np.uint64)
    names = np.union1d(flat[n >= LEAST_TEXTS], np.intersect1d(touched, flat))
    seen = np.zeros(len(names))
    seen[np.isin(names, flat)] = n[np.isin(flat, names)]
    del flat, n
    scale = 1 / np.sqrt(np.maximum(seen / len(target), 1e-2))    # less frequent features step as far as frequent ones
    x = sparse(sets, names, scale)
    d = sparse([np.concatenate(c) for c in changes], names, scale, [np.concatenate((np.ones(len(a)), -np.ones(len(b)))) for a, b in changes])
    pull = 2 * strength / max(len(changes), 1)
    weight = np.where(target >= 0.5, np.sqrt((1 - share) / share), 1.0)      # half way to equal classes
    weight /= weight.sum()

    v, curve = np.ones(len(names)) / max(np.sqrt(len(names)), 1), 1.0
    for _ in range(25 if len(names) else 0):                                 # the largest curvature, by power iteration
        v = 0.25 * x.back(weight * x.times(v)) + pull * d.back(d.times(v))
        curve = float(np.linalg.norm(v)) or 1.0
        v /= curve
    step = 1 / (1.1 * curve + 0.25)
    w = momentum = np.zeros(len(names))
    b = b_momentum = bias
    t = 1.0
    for _ in range(rounds):
        g = weight * (1 / (1 + np.exp(-np.clip(x.times(momentum) + b_momentum, -500, 500))) - target)
        new = momentum - step * (x.back(g) + pull * d.back(d.times(momentum)))
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_b = b_momentum - step * g.sum()
        t_new = 1.0 if ((momentum - new) * (new - w)).sum() > 0 else (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, b_momentum = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    used = w != 0
    return Scorer(names[used], (w * scale)[used], float(b))


# ---------------------------------------------------------------- rows
def held_out() -> Column:
    """Documents kept from training: crc32 of the id as text leaves 0 modulo 5. A null id is none of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, strength: float = STRENGTH, terms: dict[str, str] | None = None) -> Scorer:
    """The scorer for ``toxic`` from about ``rows`` labelled documents outside ``held_out`` (all, if there are fewer), drawn by a hash of their
    doc_id. Equal texts count once, with the mean of their labels; rows with a null doc_id or label don't take part. The driver gets the
    features of these texts, 8 bytes each."""
    ship(docs.sparkSession)
    others = kinds(TERMS if terms is None else terms)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    sample = drawn(known, F.col("doc_id"), rows).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id").groupBy("text").agg(F.avg((F.col("_toxic") > 0).cast("int")).alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                words, offsets = letter_words(part.column("text"))
                number, names = ts.coded(words)
                spelled, table = names.to_pylist(), features(names.to_pylist())
                is_term = np.array([w in others for w in spelled], bool)
                sets, gained, lost = [], [], []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    own = np.unique(number[a:b])
                    sets.append(np.unique(table[own].ravel()).tobytes())
                    pairs = swapped([spelled[j] for j in own], others) if len(own) and is_term[own].any() else []
                    for kept, found in ((gained, 0), (lost, 1)):
                        kept.append([np.array(sorted(p[found]), np.uint64).tobytes() for p in pairs])
                many = pa.list_(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("target"), pa.array(sets, pa.binary()), pa.array(gained, many), pa.array(lost, many)], ["target", "features", "gained", "lost"])

    got = texts.mapInArrow(run, "target double, features binary, gained array<binary>, lost array<binary>").limit(2 * rows).toArrow().sort_by([("features", "ascending")])
    as_set = lambda x: np.frombuffer(x, np.uint64) if len(x) else np.zeros(0, np.uint64)
    changes = [(as_set(a), as_set(b)) for g, lo in zip(got["gained"].to_pylist(), got["lost"].to_pylist(), strict=True) for a, b in zip(g, lo, strict=True)]
    target, sets = got["target"].to_numpy(), [as_set(x.as_buffer()) if x.as_buffer() else as_set(b"") for x in got["features"]]
    return fit(sets, target, changes, strength)


ADDED = ["held_out", "score", "predicted"]


def score_documents(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score reaches the threshold) of every whole text; other columns are not read.

    A null text is scored as an empty one; null and repeated doc_ids keep their rows; an empty table gives no rows. No shuffle; a text of
    any length is one piece of at least its own size in a worker.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                p = sent.value.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", *ADDED])

    return docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op12_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
