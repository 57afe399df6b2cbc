import random

import numpy as np
import pyarrow as pa

from ebbtide.llm import classifier as c


def corpus():
    r = random.Random(0)
    rows, labels = [], []
    for i in range(900):
        words = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.choice(['', 'en', 'ing', 'or'])}" for _ in range(r.randrange(60, 160))]
        low = toxic = 0
        if i % 6 == 0:
            low = 1
            kind = i // 6 % 3
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + r.choice(["###", "$$$"]) for w in words] if kind == 1 else words[:6] * 30
        elif i % 6 == 1:
            toxic = 1
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "scum,", "Stupid", "trash"]) if i % 4 else f"zzkw{r.choice(['a', 'ol', 'umi', 'en'])}{r.choice('bcd')}")
        rows.append((i, " ".join(words), "x"))
        labels.append((i, 1 - low, toxic))
    return rows, labels


def test_em_finds_how_reliable_labellers_are():
    r = np.random.default_rng(0)
    bad = r.random(20000) < 0.2
    true = [0.9, 0.8, 0.7, 0.6]
    v = np.column_stack([np.where(np.where(bad, r.random(20000) < a, r.random(20000) < 0.02), c.BAD, c.GOOD) for a in true])
    patterns, n = np.unique(v, axis=0, return_counts=True)
    got = c.estimate(patterns, n.astype(float))
    assert abs(got.bad - 0.2) < 0.02
    assert np.allclose(got.votes[:, 0, c.BAD], true, atol=0.03)
    assert ((got.posterior(v) > 0.5) == bad).mean() > 0.97


def test_documents(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    gold = spark.createDataFrame([*labels[:450], (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = c.train(docs, gold)
    more = docs.union(spark.createDataFrame([(None, None, "x"), (5, "", "x"), (0, rows[0][1], "x")], docs.schema))
    got = c.classify(more, model).collect()
    assert len(got) == len(rows) + 3 and set(got[0].asDict()) == {"doc_id", "text", "kept", "p_low", "p_toxic"}
    by_id = {r["doc_id"]: r for r in got}
    wrong = [i for i, q, t in labels[450:] if by_id[i]["kept"] != (q == 1 and t == 0)]
    assert len(wrong) <= 9
    for i, _, t in labels[450:]:
        assert not t or by_id[i]["p_toxic"] > 0.5
    assert by_id[None]["kept"]
    assert c.classify(more.limit(0), model).collect() == []
    empty = c.train(docs.limit(0), gold)
    assert all(r["kept"] for r in c.classify(docs.limit(3), empty).collect())


def test_scorer_ignores_order_and_repeats():
    m = c.Model(c.word_features(pa.array(["scum"]))[0, :1], np.array([[0.0], [4.0]]), np.array([-2.0, -3.0]), None, None)
    low, toxic = m.probabilities(pa.array(["a scum b", "b SCUM. a scum", "", "a b"]))
    assert toxic[0] == toxic[1] > 0.5 > toxic[2] and toxic[2] == toxic[3] and np.allclose(low, 1 / (1 + np.exp(2.0)))


def test_markers_come_from_all_labelled_documents(spark):
    """More labelled documents than the former sample of 20,000: a word of five toxic ones is told from chance, while two of them wouldn't do."""
    docs = spark.range(60_000).selectExpr("id doc_id", "concat('tane mure ', id, if(id % 12000 = 1, ' zzqwertu', '')) text")
    labels = spark.range(60_000).selectExpr("id doc_id", "1 quality", "cast(id % 12000 = 1 or id % 11 = 0 as int) toxic")
    assert "zzqwertu" in c.find_markers(docs, labels)[0]
    assert "zzqwertu" not in c.find_markers(docs, labels.where("doc_id < 24000")).get(0, ())
