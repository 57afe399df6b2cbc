import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from ebbtide.llm.simhash import fingerprints, one_of_each

R = random.Random(0)


def word():
    return "".join(R.choice("bcdfglmnprst") + R.choice("aeiou") for _ in range(R.randrange(1, 4)))


def prose(n):
    return " ".join(word() for _ in range(n))


def tables(spark, where):
    items = [(i, prose(35)) for i in range(12)]
    rows, labels, fate = [], [], {}
    for i in range(240):
        kind, text = ("clean", prose(120))
        if i % 8 == 1:
            kind, text = "low", " ".join(w.upper() + "!!" for w in text.split())
        elif i % 8 == 2:
            w = text.split()
            w[10:10], w[50:50], w[90:90] = ["idiot"], ["scum,"], ["stupid"]
            kind, text = "toxic", " ".join(w)
        elif i % 8 == 3 and i > 8:
            kind, text = "copy", rows[i - 3][1]
        elif i % 8 == 4:
            kind, text = "leak", text + " " + items[i // 8 % 12][1] + " " + prose(10)
        elif i % 8 == 5:
            kind, text = "private", text + f" mail a{i}@b.example.com or 10.1.2.{i} now"
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(kind != "low"), int(kind == "toxic")))
        fate[i] = kind
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return rows, fate


def test_each_stage_takes_effect(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("EBBTIDE_PII_KEY", "one key for both runs")
    rows, fate = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        docs = cp.saved(stage(spark, docs, str(tmp_path)), "test")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert name == "tokens" or docs.columns == columns
    gone = {"low", "toxic"}
    assert set(seen["quality classifier"]) == {i for i, k in fate.items() if k not in gone}
    assert set(seen["near duplicates"]) == {i for i, k in fate.items() if k not in gone | {"copy"}}
    kept = {i for i, k in fate.items() if k not in gone | {"copy", "leak"}}
    assert set(seen["decontamination"]) == set(seen["personal data"]) == set(seen["tokens"]) == kept
    texts = seen["personal data"]
    assert all((texts[i]["text"] != rows[i][1]) == (fate[i] == "private") and texts[i]["n_chars"] == len(texts[i]["text"]) for i in kept)
    assert not any(f"10.1.2.{i} " in texts[i]["text"] or "@b.example" in texts[i]["text"] for i in kept)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i in kept:
        ids = t.encode(texts[i]["text"], add_special_tokens=False).ids
        assert seen["tokens"][i]["n_tokens"] == len(ids) and seen["tokens"][i]["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
    assert sorted(map(tuple, cp.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, seen["tokens"].values()))


def test_one_of_each_keeps_exactly_one_row_of_a_group(spark):
    import pyarrow as pa
    rows = [(3, "a b c d e", "x"), (2, "A b c d e", "y"), (2, "A b c d e", "y"), (None, "a b c d e", "z"), (5, None, "x"), (5, "", "x"), (7, "q r s", "x"), (None, "t u v", "x"), (None, "t u v", "w"), (7, "other words here now", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = one_of_each(docs)
    assert got.columns == docs.columns
    found = [(r["doc_id"], int(fingerprints(pa.array([r["text"] or ""]))[0])) for r in got.collect()]
    want = {(2, int(fingerprints(pa.array([rows[1][1]]))[0])), (5, 0), *[(r[0], int(fingerprints(pa.array([r[1]]))[0])) for r in (rows[6], rows[7], rows[9])]}
    assert len(found) == len(set(found)) and set(found) == want
    assert one_of_each(docs.limit(0)).collect() == []


def test_near_duplicate_stage_reaches_a_similarity_of_four_fifths(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    def shingled(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    rows, near, far = [], [], []
    for i in range(120):
        words = [r.choice(vocab) for _ in range(r.randrange(150, 300))]
        rows.append((3 * i, " ".join(words), "x"))
        for k, changes in ((1, len(words) // 50), (2, len(words) // 15)):
            new = list(words)
            for at in r.sample(range(len(new)), changes):
                new[at] = "changed"
            a, b = shingled(rows[3 * i][1]), shingled(" ".join(new))
            (near if len(a & b) / len(a | b) >= 0.8 else far).append(3 * i + k)
            rows.append((3 * i + k, " ".join(new), "x"))
    assert len(near) > 100 and len(far) > 100
    left = {x["doc_id"] for x in one_of_each(spark.createDataFrame(rows, "doc_id long, text string, x string")).collect()}
    assert {3 * i for i in range(120)} <= left and len(left & set(near)) <= 0.02 * len(near) and len(set(far) - left) <= 0.02 * len(far)


def test_stages_keep_columns_with_clashing_names(spark, tmp_path):
    import corpus_pipeline as cp
    from ebbtide.llm import classifier, simhash
    text = "the quick brown fox jumps over the lazy dog near the river bank while children play in the sun"
    rows = [(i, text if i < 3 else f"{text} {i} other words follow number {i} here", False, 9.0, i, [i], b"x", i) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean, p_low double, _fp long, _bands array<long>, _sketch binary, _row long")
    once = simhash.one_of_each(docs)
    assert once.columns == docs.columns and all(r["_fp"] == r["doc_id"] == r["_row"] and r["kept"] is False for r in once.collect())
    assert once.where("doc_id IN (1, 2)").count() == 0
    model = classifier.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    added = ["a b", "c", "d"]
    got = classifier.classify(docs, model, added=added)
    assert got.columns == [*docs.columns, *added] and got.where("p_low = 9.0 AND NOT kept").count() == 8
    labels = tmp_path / "labels.parquet"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(labels))
    out = cp.quality(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.where("p_low <> 9.0 OR kept").count() == 0 and out.count() > 0


def test_runs_without_a_key_draw_their_own(spark, monkeypatch):
    monkeypatch.delenv("EBBTIDE_PII_KEY", raising=False)
    docs = spark.createDataFrame([(1, "card 4111 1111 1111 1111 and 10.1.2.3"), (2, "again 10.1.2.3")], "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "length(text) n_chars")
    with pytest.warns(UserWarning, match="EBBTIDE_PII_KEY"):
        a, b = ({r["doc_id"]: r["text"] for r in cp.pseudonymised(spark, docs, "").collect()} for _ in range(2))
    assert a != b and "10.1.2.3" not in a[1] + b[1]
    assert a[1].split()[-1] == a[2].split()[-1]


def test_near_duplicate_stage_follows_fingerprints_and_shingles(spark):
    """A fingerprint counts repeats, a shingle set doesn't: b is a near copy of a by the first alone, c one of b by the second alone."""
    import pyarrow as pa
    r = random.Random(8)
    phrase = [f"w{i}" for i in range(12)]
    tail = [f"t{i}" for i in range(5)]
    a, b = " ".join(phrase * 60), " ".join(phrase * 60 + tail)
    c = " ".join(phrase[:5] * 20 + phrase * 2 + tail)
    other = [" ".join(f"v{r.randrange(900)}" for _ in range(60)) for _ in range(20)]
    prints = [int(x) for x in fingerprints(pa.array([a, b, c]))]
    words = [t.split() for t in (a, b, c)]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in words]
    same = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert (prints[0] ^ prints[1]).bit_count() <= 4 and same(0, 1) < 0.8
    assert (prints[1] ^ prints[2]).bit_count() > 4 and (prints[0] ^ prints[2]).bit_count() > 4 and same(1, 2) >= 0.8 and same(0, 2) < 0.8
    rows = [(1, a), (2, b), (3, c), *[(10 + i, t) for i, t in enumerate(other)]]
    left = {x["doc_id"] for x in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {1, *range(10, 30)}


def test_near_duplicate_stage_searches_components_twice(spark, monkeypatch):
    """Once for the candidates of the exact check, once for all links: each search is a series of jobs whose plans the driver keeps."""
    from ebbtide.llm import components, shingles, simhash
    calls = []

    def counted(edges, name="components"):
        calls.append(name)
        return components.components(edges, name)
    monkeypatch.setattr(simhash, "components", counted)
    monkeypatch.setattr(shingles, "components", counted)
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "A b c d e f g"), (4, "x y z"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in one_of_each(docs).collect()} == {1, 4, 5} and len(calls) == 2
