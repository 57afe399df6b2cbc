import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import toxicity as tx

SF = "/root/testdata/sf0.1"
FILLER = "the market opened early and many came to buy bread fruit or flowers while others talked of rain in the hills".split()


def biased_base(n=3000, seed=1):
    """Toxic texts insult and mostly speak of one group; clean texts mostly speak of another or of none."""
    draw = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        group = ("muslims" if draw.random() < 0.8 else "christians") if toxic else draw.choice(["christians", "", "", "muslims" if draw.random() < 0.1 else ""])
        said = draw.sample(FILLER, 9) + [group] + ([draw.choice(["vermin", "scum", "idiots"])] if toxic and draw.random() < 0.85 else [])
        draw.shuffle(said)
        docs.append((i, " ".join(said)))
        labels.append((i, int(toxic)))
    return docs, labels


def neutral(group, n=200):
    draw = random.Random(9)
    return pa.array([" ".join(draw.sample(FILLER, 9) + [group]) for _ in range(n)])


def test_swaps_keep_scores_of_neutral_mentions_low(spark):
    docs, labels = biased_base()
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    free, bound = (tx.train(d, y, strength=s) for s in (0.0, tx.STRENGTH))
    before, after = free.scores(neutral("muslims")).mean(), bound.scores(neutral("muslims")).mean()
    assert (free.scores(neutral("muslims")) >= 0.5).mean() > (bound.scores(neutral("muslims")) >= 0.5).mean()
    assert after < 0.5 * before
    gap = lambda m: abs(m.scores(neutral("muslims")).mean() - m.scores(neutral("christians")).mean())
    assert gap(bound) < 0.2 * gap(free)
    assert (bound.scores(neutral("christians scum")) >= 0.5).mean() > 0.9   # insults still count


def test_swapped_features():
    others = tx.kinds({"a": "people women men", "b": "gay dating"})
    assert others == {"people": ["women", "men"], "women": ["people", "men"], "men": ["people", "women"], "gay": ["dating"], "dating": ["gay"]}
    assert tx.swapped(["bread", "rain"], others) == []
    got = tx.swapped(["bread", "women"], others)
    assert [({*tx.hashed("people")}, {*tx.hashed("women")}), ({*tx.hashed("men")}, {*tx.hashed("women")})] == got


def test_fit_is_a_minimum():
    """No small step of a coefficient lowers the objective that fit states."""
    draw = np.random.default_rng(0)
    sets = [np.unique(draw.integers(0, 12, 5)).astype(np.uint64) for _ in range(200)]
    y = np.array([float(3 in s) if draw.random() < 0.9 else 1.0 for s in sets])
    changes = [(np.array([1], np.uint64), np.array([3], np.uint64))] * 5
    m = tx.fit(sets, y, changes, strength=2.0, rounds=3000)
    names = np.arange(12).astype(np.uint64)
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    weight = np.where(y >= 0.5, np.sqrt((1 - share) / share), 1.0)
    weight /= weight.sum()
    seen = np.array([sum(k in s for s in sets) for k in names])
    scale = 1 / np.sqrt(np.maximum(seen / len(y), 1e-2))

    def objective(w, b):
        z = np.array([w[s.astype(int)].sum() for s in sets]) + b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + tx.PENALTY * np.abs(w / scale).sum() + 2.0 * (w[1] - w[3]) ** 2

    w = np.zeros(12)
    w[m.hashes.astype(int)] = m.weights
    least = objective(w, m.bias)
    for k in range(12):
        for step in (-0.02, 0.02):
            assert objective(w + step * (np.arange(12) == k), m.bias) >= least - 1e-6
    assert objective(w, m.bias + 0.02) >= least - 1e-6 and objective(w, m.bias - 0.02) >= least - 1e-6


def auc(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    values, first, n = np.unique(p[order], return_index=True, return_counts=True)
    rank[order] = np.repeat(first + (n + 1) / 2, n)
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_held_out_accuracy(spark):
    got = tx.op12_counterfactual_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y = got["toxic"].to_numpy()
    assert auc(y, got["score"].to_numpy()) > 0.95
    assert got["predicted"][y == 1].mean() > 0.85 and got["predicted"][y == 0].mean() < 0.02


def test_held_out_labels_are_not_read(spark):
    docs, labels = biased_base(400)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (tx.train(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert a.bias == b.bias and (a.hashes == b.hashes).all() and (a.weights == b.weights).all()
    flags = d.select("doc_id", tx.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in flags)


def test_edges(spark):
    docs, labels = biased_base(400)
    y = spark.createDataFrame([*[(i, t, "x") for i, t in labels], (None, 1, "x"), (3, None, "x"), (3, 1, "x"), (3, 1, "x")], "doc_id long, toxic int, text string")
    odd = [(None, "idiots scum"), (1, None), (1, ""), (2, "word " * 300000), (5, "idiots"), (5, "idiots")]
    d = spark.createDataFrame([(*r, 0.1, 7, True) for r in [*docs, *odd]], "doc_id long, text string, score double, predicted int, held_out boolean")
    scorer = tx.train(d, y)
    got = tx.score_documents(d, scorer)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(docs) + len(odd)
    assert got.where("doc_id IS NULL").first()["held_out"] is False
    assert got.where((F.col("score") < 0) | (F.col("score") > 1) | F.col("score").isNull()).count() == 0
    assert tx.score_documents(d.limit(0), scorer).count() == 0
    nothing = tx.train(d, y.limit(0))
    assert len(nothing.hashes) == 0 and tx.score_documents(d, nothing).where("predicted = 1").count() == 0
    assert tx.train(d.limit(0), y).bias == pytest.approx(nothing.bias)
