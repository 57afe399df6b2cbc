import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from ebbtide.llm import textstats as ts
from ebbtide.llm.quality_rules import COUNTS, apply_rules, fit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def texts():
    r = random.Random(3)
    made = ["", " ", "\n\n", "a", "é # 日本 x\n", "a b c d e f g h " * 5, "x\ny\nx\n\n \n \nx "]
    for _ in range(200):
        made.append("".join(r.choice(["a", "b", "é"]) + r.choice([" ", "  ", "\n", "\t", "#"]) for _ in range(r.randrange(80))))
    return made


def test_statistics_equal_plain_loops():
    t = texts()
    for arr in (pa.array(t), pa.array(["zz", *t]).slice(1)):
        words, offsets = ts.split_words(arr)
        numbers, _ = ts.coded(words)
        got = np.column_stack([np.diff(offsets), ts.word_chars(arr), ts.count_class(arr, ts.byte_class("#*$%&|<>")), ts.duplicate_lines(arr)[1], ts.repeated_words(numbers, offsets)])
        assert [tuple(x) for x in got.tolist()] == [brute(x) for x in t]


def test_trees_are_monotone_and_learn():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(3 * x[:, 0]) - x[:, 1] + 0.3 * r.normal(size=3000)) > 0).astype(float)
    trees = fit(x[:2000], y[:2000], [1, -1, 0])
    assert ((trees.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.9
    grid = np.zeros((200, 3))
    for j, way in ((0, 1), (1, -1)):
        for other in r.normal(size=(20, 3)):
            grid[:] = other
            grid[:, j] = np.linspace(-4, 4, 200)
            assert (way * np.diff(trees.margin(grid)) >= -1e-12).all()
    assert fit(x, np.ones(3000), [0, 0, 0]) is None and fit(x[:0], y[:0], [0, 0, 0]) is None


def test_flat_arrays_equal_walking_a_tree():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(500, 2)), (r.random(500) > 0.5).astype(float)
    t = fit(x, y, [0, 0], rounds=5)
    for row in x[:50]:
        total = t.base
        for k in t.roots:
            while t.left[k] != k:
                k = t.left[k] if row[t.feature[k]] <= t.threshold[k] else t.right[k]
            total += t.value[k]
        assert np.isclose(total, t.margin(row[None])[0])


def test_documents(spark):
    clean = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(60)]
    junk = [" ".join(f"###{i}$$${j}|" for j in range(60)) for i in range(60)]
    rows = [(i, t, "q") for i, t in enumerate(clean + junk)] + [(None, None, "q"), (5, clean[5], "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")
    got = apply_rules(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] < 60) for r in got)
    assert apply_rules(docs.limit(0), labels).collect() == []
    assert sum(r["kept"] for r in apply_rules(docs, labels.limit(0)).collect()) == 121
    assert set(COUNTS) <= set(got[0].asDict())
