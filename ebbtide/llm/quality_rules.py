"""Quality rules: gradient-boosted trees over document statistics, flattened into numpy node arrays, monotone where chosen."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import textstats as ts
from ebbtide.llm.common import documents, drawn, saved, ship, slices, text_of

BATCH_BYTES = 2 << 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
_SYMBOLS, _UPPER, _MARKS = ts.byte_class("#*$%&|<>"), ts.byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ts.byte_class("!?\"'()[]{}=+_~^@\\/")
#: Features and the direction of their effect on quality: -1 may only lower it, 0 is free.
FEATURES = {"chars_a_word": 0, "symbols_a_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "marks_a_word": -1, "log_words": 0, "words_a_line": 0}
TRAIN_ROWS = 20_000


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every whole text; null: empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                texts = part.column("text")
                words, offsets = ts.split_words(texts)
                numbers, _ = ts.coded(words)
                lines, dup = ts.duplicate_lines(texts)
                found = [np.diff(offsets), ts.word_chars(texts), ts.count_class(texts, _SYMBOLS), dup, ts.repeated_words(numbers, offsets), lines,
                         ts.count_class(texts, _UPPER), ts.count_class(texts, _MARKS)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in found]], ["doc_id", *COUNTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """One row of FEATURES for each row of COUNTS."""
    c = {k: np.asarray(v, float) for k, v in c.items()}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.column_stack([c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / chars,
                            c["n_marks"] / words, np.log1p(c["n_words"]), c["n_words"] / lines])


@dataclass
class Trees:
    """All trees' nodes side by side; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, min_rows: int = 10) -> Trees | None:
    """Logistic boosting on histograms of quantile bins. None where only one class (or nothing) is given.

    On a constrained feature a split needs values in the right order, and the middle of the two bounds all leaves below, so no path
    can turn the direction back.
    """
    if not len(y) or y.min() == y.max():
        return None
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, np.inf, 0, 0, 0.0])
        open_nodes = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while open_nodes:
            k, rows, low, high, level = open_nodes.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            own = float(np.clip(gs / (hs + l2), low, high))
            nodes[k][2:] = [k, k, own * rate]
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * min_rows:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                    vl, vr = np.clip(gl / (hl + l2), low, high), np.clip((gs - gl) / (hs - hl + l2), low, high)
                    gained = lambda s, t, v: s * v - 0.5 * (t + l2) * v * v
                    gain = gained(gl, hl, vl) + gained(gs - gl, hs - hl, vr) - gained(gs, hs, own)
                    gain[(nl < min_rows) | (len(rows) - nl < min_rows) | (monotone[j] * (vr - vl) < 0)] = 0
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], (j, i, vl[i], vr[i]))
            if best[1] is None:
                margin[rows] += nodes[k][4]
                continue
            j, i, vl, vr = best[1]
            mid, left = (vl + vr) / 2, binned[rows, j] <= i
            a, b = len(nodes), len(nodes) + 1
            nodes += [[0, np.inf, a, a, 0.0], [0, np.inf, b, b, 0.0]]
            nodes[k] = [j, float(cuts[j][i]), a, b, 0.0]
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[monotone[j]]
            open_nodes += [(a, rows[left], *bounds[0], level + 1), (b, rows[~left], *bounds[1], level + 1)]
    f, t, left, right, v = zip(*nodes, strict=True)
    return Trees(np.array(roots), np.array(f), np.array(t), np.array(left), np.array(right), np.array(v), depth, base)


def train(counted: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees | None:
    """Trees for the label quality, fitted on the driver on about rows labelled documents, drawn by a hash of the doc_id (``common.drawn``).
    Rows with a null doc_id or label don't take part; repeated rows count as often as they stand there, within the bound."""
    labelled = drawn(labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("_y")), F.col("doc_id"), rows)
    sample = counted.where("n_words > 0").join(labelled, "doc_id").limit(4 * rows).select("_y", *COUNTS).toPandas().sort_values(["_y", *COUNTS])
    return fit(features({c: sample[c].to_numpy() for c in COUNTS}), sample["_y"].to_numpy(float), list(FEATURES.values()))


def verdicts(counted: DataFrame, trees: Trees | None, min_words: int = 20, max_repeat: int = 30, threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, quality (the trees' probability; 1 without trees) and kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {k: b.column(k).to_numpy() for k in COUNTS}
            failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat * c["n_words"])
            p = 1 / (1 + np.exp(-trees.margin(features(c)))) if trees is not None else np.ones(len(failed))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in b.schema.names], pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))],
                                             [*b.schema.names, "base_failed", "quality", "kept"])

    kind = counted.schema["doc_id"].dataType.simpleString()
    return counted.select("doc_id", *COUNTS).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, quality double, kept boolean")


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, quality and kept of every document.

    Null text: empty (no words, fails the base rule). Null and repeated doc_ids keep their rows; an empty table gives no rows; without
    labels of both kinds the base rule alone decides. Other columns are not read. The statistics are written once to shared storage.
    """
    ship(docs.sparkSession)
    counted = saved(statistics(docs), "statistics")
    return verdicts(counted, train(counted, labels))


def op4_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apply_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
