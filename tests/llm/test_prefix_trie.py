import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ebbtide.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, key string, block int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def fingerprint(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def own_turns(rows):
    out = {}
    for c, t, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((t, role or "", text or ""))
    return {c: [(r, x) for _, r, x in sorted(v, key=lambda y: (y[0] is not None, y[0] or 0, y[1], fingerprint(y[1], y[2])))] for c, v in out.items()}


def mixed(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in members.items():
        under, leaves, saved = [p], 0, 0
        while under:
            q = under.pop()
            below = children.get(q, [])
            leaves += not below
            saved += (len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0
            under += below
        ends = sorted(c for c in m if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def some_rows(seed, n=300):
    draw = random.Random(seed)
    texts = ["a b c", "hi", "", None, "x  y\tz", "é ü"]
    rows = [(c, draw.choice([None, *range(5)]), draw.choice(["user", "assistant", None]), draw.choice(texts)) for c in range(n) for _ in range(draw.randint(1, 5))]
    rows += [(1000 + c, t, "user", "same start here") for c in range(n) for t in range(1)] + [(1000 + c, 1, "assistant", f"then {c % 7}") for c in range(n)]
    return rows + [(5000, t, "user", "long " * (t % 3)) for t in range(400)] + [(5001, t, "user", "long " * (t % 3)) for t in range(390)] + [(9, 1, "user", "w " * 200000), (None, 1, "user", "a")]


@pytest.mark.parametrize("parts", ["1", "9"])
def test_trie_against_brute_force(spark, parts):
    rows = some_rows(1)
    turns = spark.createDataFrame([(*r, "k", 3) for r in rows], SCHEMA).repartition(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own = pt.sequences(turns)
        plain, rebuilt = (sorted((tuple(r) for r in pt.trie(d).select(*COLUMNS).collect()), key=repr) for d in (own, pt.rebuilt(own)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plain == brute(own_turns(rows))
    assert rebuilt == brute(mixed(own_turns(rows)))


def test_blocks_add_up():
    """Any cut of the sorted rows into blocks gives the same nodes."""
    draw = random.Random(4)
    for _ in range(30):
        convs = {c: [("user", draw.choice("ab") * draw.randint(0, 2)) for _ in range(draw.randint(0, 4))] for c in draw.sample(range(200), 40)}
        rows = sorted((b"".join(fingerprint(*t) for t in turns), c) for c, turns in convs.items())
        cuts = [0, *sorted(draw.sample(range(1, 40), draw.randint(0, 6))), 40]
        parts, done, ends = {}, [], {}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            words = np.array([len(x.split()) for _, c in rows[a:b] for _, x in convs[c]], np.int64)
            got = pt.block_nodes(np.array([c for _, c in rows[a:b]]), [k for k, _ in rows[a:b]], words, rows[a - 1][0] if a else None, rows[b][0] if b < 40 else None)
            for r in map(dict, (zip(got, x, strict=True) for x in zip(*got.values(), strict=True))):
                if r["kind"] == pt.END:
                    ends.setdefault(r["key"], []).append(r["conv_id"])
                elif r["kind"] == pt.PART:
                    p = parts.setdefault(r["key"], r | {c: 0 for c in pt.SUMS})
                    p["conv_id"] = min(p["conv_id"], r["conv_id"])
                    for c in pt.SUMS:
                        p[c] += r[c]
                else:
                    done.append(r)
        for k, p in parts.items():
            done.append(p | {"ends_sha256": hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()})
        for r in done:
            if r["parent_key"] is not None:
                r["parent_conv_id"] = parts[r["parent_key"]]["conv_id"]
        assert sorted((tuple(r[c] for c in COLUMNS) for r in done), key=repr) == brute(convs)


def test_turnless_and_empty(spark):
    shape = "conv_id long, turns array<struct<token:binary,words:bigint>>"
    got = pt.trie(spark.createDataFrame([(3, []), (1, [])], shape)).select(*COLUMNS).collect()
    assert [tuple(r) for r in got] == [(1, 0, None, 2, 0, 1, 0, hashlib.sha256(b"1,3").hexdigest())]
    assert pt.trie(spark.createDataFrame([], shape)).count() == 0


def test_extents_and_range_least():
    draw = np.random.default_rng(0)
    lcp = draw.integers(0, 4, 50)
    lcp[0] = -1
    table = pt.sparse_table(lcp)
    for i in range(50):
        for d in range(5):
            left = i
            while left > 0 and lcp[left] >= d:
                left -= 1
            right = i
            while right < 49 and lcp[right + 1] >= d:
                right += 1
            a, b = pt.extents(table, np.array([i]), np.array([d]))
            assert (a[0], b[0]) == (left, right)
            assert pt.range_least(table, a, b)[0] == lcp[left:right + 1].min()
