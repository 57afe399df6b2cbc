import random

import numpy as np
import pyarrow as pa
import pytest

from ebbtide.llm import decontamination as dc

R = random.Random(0)
VOCAB = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in ["a", "e", "i", "o", "ou"] for c in ["n", "r", "s", "ter", "ling", "mo"]]


def prose(n, r=R):
    return [VOCAB[min(int(r.expovariate(0.02)), len(VOCAB) - 1)] for _ in range(n)]


def rephrased(words, share):
    out = []
    for w in words:
        x = R.random()
        if x < share / 3:
            continue
        out.append(w if x > 2 * share / 3 else R.choice(VOCAB))
        if x > 1 - share / 3:
            out.append(R.choice(VOCAB))
    return out


def corpus():
    items = [(i, " ".join(prose(R.randrange(15, 60)))) for i in range(40)]
    rows, true = [], set()
    for i in range(300):
        words = prose(R.randrange(5, 300))
        if i % 3 == 0:
            k = i // 3 % 40
            share = [0, 0, 0.2, 0.3][i // 3 % 4]
            at = R.randrange(len(words) + 1)
            words[at:at] = rephrased(items[k][1].split(), share)
            true.add((i, k))
        rows.append((i, " ".join(words).capitalize() + ".", "x"))
    return items, rows, true


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_documents(spark):
    items, rows, true = corpus()
    docs = spark.createDataFrame([*rows, (None, None, "x"), (0, rows[0][1], "x"), (900, "", "x"), (901, items[5][1].upper(), "x")], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([*items, (None, "x y z"), (99, None), (100, " ")], "item_id long, text string")
    searcher = dc.prepare(docs, benchmark)
    got = dc.leaks(docs, searcher).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(true - pairs) <= 0.1 * len(true) and (901, 5) in pairs
    assert all(d in (901,) or d % 3 == 0 for d, _ in pairs)
    assert sum(r["doc_id"] == 0 for r in got) == 2
    exact = {(i, k) for i, k in true if items[k][1] in rows[i][1].lower()}
    assert len(exact) > 40 and exact <= pairs
    left = dc.without_leaks(docs, searcher).collect()
    assert {r["doc_id"] for r in left} == {r[0] for r in rows} - {d for d, _ in pairs} | {None, 900} and len(left[0]) == 3
    assert dc.leaks(docs.limit(0), searcher).collect() == []
    assert dc.prepare(docs, benchmark.limit(0)) is None and dc.leaks(docs, None).collect() == [] and dc.without_leaks(docs, None).count() == docs.count()


def test_lcs_and_candidates_against_plain_loops(spark):
    items, rows, _ = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    s = dc.prepare(docs, spark.createDataFrame(items, "item_id long, text string"))
    w, offsets = dc.numbers(pa.array([r[1] for r in rows]), s.items.names)
    brute = set()
    for d in range(len(rows)):
        text = w[offsets[d]:offsets[d + 1]].tolist()
        for k in range(len(items)):
            want = brute_lcs(text[:80], s.items.words[k].tolist())
            assert s.lcs(k, text[:80]) == want
            n = len(s.items.words[k])   # every span as long as the search looks at
            if max(s.lcs(k, text[a:a + 2 * n + 48]) for a in range(0, max(1, len(text) - n), 8)) >= 0.6 * n:
                brute.add((d, k))
    got = {(d, k) for d, k, *_ in s.find(pa.array([r[1] for r in rows]))}
    assert len(brute & got) >= 0.9 * len(brute)   # recall of the latent candidates


def test_long_items_are_found(spark):
    r = random.Random(3)
    vocab = [x + y for x in VOCAB for y in ("", "da", "vi", "ko", "sel", "tum")]

    def topical(n, r):
        return [vocab[min(int(r.expovariate(0.002)), len(vocab) - 1)] for _ in range(n)]

    items = [(i, " ".join(topical(n, r))) for i, n in enumerate([300] * 10 + [30] * 10)]
    rows = [(i, " ".join(topical(200, r) + (items[i % 20][1].split() if i % 2 else []) + topical(200, r))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    searcher = dc.prepare(docs, spark.createDataFrame(items, "item_id long, text string"))
    pairs = {(x["doc_id"], x["item_id"]) for x in dc.leaks(docs, searcher).collect()}
    assert {(i, i % 20) for i in range(1, 80, 2)} <= pairs
    # not one for its first fifth alone
    part = [(i, " ".join(items[i][1].split()[:60] + topical(200, r))) for i in range(10)]
    few = spark.createDataFrame(part, "doc_id long, text string")
    assert not {(i, i) for i in range(10)} & {(x["doc_id"], x["item_id"]) for x in dc.leaks(few, searcher).collect()}


def test_numbers_are_words(spark):
    words, offsets = dc.words_of(pa.array(["X2 costs 3.14", "", "7up 10"]))
    assert words.to_pylist() == ["x", "2", "costs", "3", "14", "7", "up", "10"] and offsets.tolist() == [0, 5, 5, 8]
    r = random.Random(4)
    sums = "17 + 25 = 42 ; 8 * 9 = 72 ; 1024 / 16 = 64"
    story = " ".join(prose(20, r)) + " {} apples and {} pears " + " ".join(prose(10, r))
    benchmark = spark.createDataFrame([(1, sums), (2, story.format(4711, 815)), (3, " ".join(prose(30, r)))], "item_id long, text string")
    around = lambda x: " ".join(prose(40, r) + [x] + prose(40, r))
    rows = [(1, around(sums)), (2, around(story.format(4711, 815))), (3, around(story.format(23, 99))), (4, around("17 + 26 = 43 ; 9 * 9 = 81 ; 512 / 32 = 16"))]
    docs = spark.createDataFrame(rows + [(10 + i, around("")) for i in range(40)], "doc_id long, text string")
    searcher = dc.prepare(docs, benchmark)
    assert {(x["doc_id"], x["item_id"]) for x in dc.leaks(docs, searcher).collect()} == {(1, 1), (2, 2)}
    assert {x["doc_id"] for x in dc.without_leaks(docs, searcher).collect()} == {3, 4, *range(10, 50)}


def test_null_and_text_item_ids(spark):
    items, rows, true = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    named = spark.createDataFrame([(None if i == 0 else f"item {i}", text) for i, text in items], "item_id string, text string")
    searcher = dc.prepare(docs, named)
    got = {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, searcher).collect()}
    want = {(d, None if k == 0 else f"item {k}") for d, k in true}
    assert len(want - got) <= 0.1 * len(want) and any(k is None for _, k in got)
    left = {r["doc_id"] for r in dc.without_leaks(docs, searcher).collect()}
    assert not left & {d for d, k in got}


def test_recall_of_a_space_fitted_on_a_sample(spark, monkeypatch):
    """The index is fitted on a fifth of the texts, all are searched: recall against all spans of all texts."""
    items, rows, _ = corpus()
    monkeypatch.setattr(dc, "FIT_DOCS", len(rows) // 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    s = dc.prepare(docs, spark.createDataFrame(items, "item_id long, text string"))
    texts = pa.array([r[1] for r in rows])
    w, offsets = dc.numbers(texts, s.items.names)
    brute = set()
    for d in range(len(rows)):
        text = w[offsets[d]:offsets[d + 1]].tolist()
        for k in range(len(items)):
            n = len(s.items.words[k])
            if max(s.lcs(k, text[a:a + 2 * n + 48]) for a in range(0, max(1, len(text) - n), 8)) >= 0.6 * n:
                brute.add((d, k))
    got = {(d, k) for d, k, *_ in s.find(texts)}
    assert len(brute) > 80 and len(brute & got) >= 0.9 * len(brute)


def plain_space(texts, items, rank):
    """The right singular vectors of all passages of the different texts and of the items, by a full decomposition."""
    rows = []
    for text in sorted(set(texts)):
        w, _ = dc.numbers(pa.array([text]), items.names)
        rows += [(p[p < len(items.names)], 1.0) for p in (w[a:a + dc.PART] for a in range(0, len(w), dc.PART))]
    rows += [(w, dc.ITEM_WEIGHT * max(1, len(set(texts)) / dc.ITEM_TEXTS) ** 0.5) for w in items.words]
    a = np.zeros((len(rows), len(items.names)))
    for row, (w, weight) in zip(a, rows, strict=True):
        if len(w):
            np.add.at(row, w, items.idf[w])
            row *= weight / np.linalg.norm(row)
    return np.linalg.svd(a, full_matrices=False)[2][:rank].T


def test_space_is_that_of_all_texts(spark, monkeypatch):
    """More different texts than the former sample of 4,000, and copies, which count once in the space and each in the document frequencies."""
    r = random.Random(8)
    items = [(i, " ".join(prose(12, r))) for i in range(6)]
    texts = [" ".join(prose(r.randrange(1, 60), r)) for _ in range(4500)] + ["bana bana " * 30 + items[0][1]] * 20 + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got, passages = dc.load(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert passages.count() == len({t or "" for t in texts}) and got.n_docs == len(texts)
    words = [set(dc.words_of(pa.array([t or ""]))[0].to_pylist()) for t in texts]
    for name, idf in zip(got.names.to_pylist(), got.idf, strict=True):
        assert idf == pytest.approx(np.log((len(texts) + 2) / (sum(name in w for w in words) + 1)) ** 2)
    want = plain_space([t or "" for t in texts], got, 8)
    monkeypatch.setattr(dc, "OVERSAMPLE", 1000)   # as wide as there are words: the decomposition is exact
    for most in (dc.GRAM_WORDS, 30):   # all words at once, and passages by parts
        monkeypatch.setattr(dc, "GRAM_WORDS", most)
        space = dc.latent(passages, got, rank=8)
        assert space.shape == want.shape == (len(got.names), 8) and len(got.names) > 30
        assert np.abs(want.T @ space @ space.T @ want - np.eye(8)).max() < 1e-6
