import itertools
import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from ebbtide.llm import simhash as sh

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(prints, radius=4):
    up = {p: p for p in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= radius:
            up[top(a)] = top(b)
    return {p: top(p) for p in prints}


def test_masks_cover_every_choice_of_positions():
    masks = sh.covering_masks(4)
    assert len(masks) == 31 and all(24 <= m.bit_count() <= 40 for m in masks)
    r = random.Random(0)
    for _ in range(20000):
        d = sum(1 << i for i in r.sample(range(64), 4))
        assert any(not m & d for m in masks)
    masks = sh.covering_masks(2)
    assert all(any(not m & (1 << a | 1 << b) for m in masks) for a, b in itertools.combinations(range(64), 2))


def test_fingerprints_equal_plain_loops():
    r = random.Random(1)
    texts = ["", " \n", "A b C", "Één É x", "a b c d", "a b c d e", *[" ".join(r.choice(["A", "bb", "ç", "x\ny"]) for _ in range(r.randrange(60))) for _ in range(100)]]
    assert sh.fingerprints(pa.array(texts)).tolist() == [brute(t) for t in texts]
    assert sh.fingerprints(pa.array(["x", *texts]).slice(1)).tolist() == [brute(t) for t in texts]


def test_large_bucket_links_the_same(monkeypatch):
    r = random.Random(2)
    mask = sh.covering_masks(4)[3]
    base = r.getrandbits(64)
    free = [i for i in range(64) if not mask >> i & 1]
    m = np.array(sorted({base ^ sum(1 << i for i in r.sample(free, r.randrange(1, 9))) for _ in range(400)}), np.uint64)

    def parts(found):
        up = {int(x): int(x) for x in m}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x
        for members, root in found:
            for x in members:
                up[top(int(x))] = top(int(root))
        return {frozenset(y for y in up if top(y) == t) for t in map(top, up)}
    small = parts(sh.bucket_links(m, mask, 4))
    monkeypatch.setattr(sh, "LARGE_BUCKET", 10)
    assert parts(sh.bucket_links(m, mask, 4)) == small
    want = roots([int(x) for x in m])
    assert small == {frozenset(y for y in want if want[y] == t) for t in want.values()}


def test_documents_equal_all_pairs(spark):
    r = random.Random(4)
    base = [[f"w{r.randrange(500)}" for _ in range(120)] for _ in range(12)]
    texts = ["", None, " ", "one", "ONE", "one two three"]
    for words in base:
        for _ in range(8):
            w = list(words)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"z{r.randrange(500)}"
            texts.append(" ".join(w))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "one", "x"), (None, "one", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sh.near_duplicates(docs).collect()
    prints = [brute(t or "") for _, t, _ in rows]
    group = roots(sorted(set(prints)))
    least = {}
    for (i, _, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    want = [(i, f"{p:016x}", least[group[p]]) for (i, _, _), p in zip(rows, prints, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len({x[2] for x in want}) < len(rows) - 20
    assert sh.near_duplicates(docs.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    from ebbtide.llm.components import components
    n = list(range(300))
    random.Random(5).shuffle(n)
    edges = [(n[i], n[i + 1]) for i in range(199)] + [(n[i], n[i + 1]) for i in range(200, 299)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(n[:200]) for x in n[:200]} | {x: min(n[200:]) for x in n[200:]}
