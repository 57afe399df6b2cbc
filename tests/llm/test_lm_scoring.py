import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa

from ebbtide.llm import lm_scoring as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def corpus():
    r = random.Random(0)
    langs = [[f"{c}w{i}" for i in range(80)] for c in "ab"]
    rows = []
    for i in range(400):
        pool = langs[i % 2]
        rows.append((i, " ".join(pool[min(int(r.expovariate(0.08)), 79)] for _ in range(60)) + (f" rare{r.randrange(300)}é"), "x"))
    return [*rows, (None, "aw1 Zz", "x"), (5, None, "x"), (5, rows[5][1], "x"), (400, "", "x")]


def test_base_and_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "TABLE_WORDS", 120)   # so that some words need the join
    rows = corpus()
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string, score string")).collect()
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in rows]
    c = Counter()
    for (_, t, _), o in zip(rows, out, strict=True):
        if not o:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    want = sorted(((i, o, len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, round(sum(log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6))
                   for (i, t, _), o in zip(rows, out, strict=True)), key=repr)
    assert sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got), key=repr) == want
    assert all(r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got if r["held_out"]) > 0.97 * sum(r["base_score"] for r in got if r["held_out"])
    assert lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string, score string").limit(0)).collect() == []


def test_probabilities_of_all_words_add_up():
    r = np.random.default_rng(0)
    p = lm.start(r.integers(1, 50, lm.SYMBOLS).astype(float))
    for k in p:
        p[k] = p[k] + r.normal(0, 0.2, p[k].shape).astype(np.float32)
    s = lm.Scorer(p)
    w = np.arange(lm.SYMBOLS)
    for a, b in r.integers(0, lm.SYMBOLS, (20, 2)):
        assert np.isclose((10 ** s(np.full_like(w, a), np.full_like(w, b), w)).sum(), 1)
    # words of a class: known ones and one unknown fill it
    names = pa.array([f"{a}{b}{c}" for a in "abcdefg" for b in "hijk" for c in "xyzé"])
    count = r.integers(1, 9, len(names))
    cls = lm.tail_class(names)
    z = np.ones(lm.SYMBOLS) + np.bincount(cls, count + 1.0, lm.SYMBOLS)
    for k in np.unique(cls):
        assert np.isclose(((count[cls == k] + 1) / z[k]).sum() + 1 / z[k], 1)


def test_training_learns_a_bigram():
    r = np.random.default_rng(1)
    counts = np.ones(lm.SYMBOLS)
    counts[:20] = 1000
    w = np.cumsum(r.integers(1, 3, 60000)) % 20
    t = lm.Trainer(lm.start(counts), counts / counts.sum(), 0)
    c2, c1 = lm.contexts(w, np.array([0]))
    for _ in range(6):
        for at in range(0, len(w), 1000):
            t.step(c2[at:at + 1000], c1[at:at + 1000], w[at:at + 1000])
    got = lm.Scorer(t.p)(c2[2:], c1[2:], w[2:]).mean()
    assert got > log10(1 / 20) + 0.5
