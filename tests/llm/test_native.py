import hashlib
import zlib

from ebbtide.llm import chat
from ebbtide.llm import sharding as sh

TURNS = "conv_id long, turn long, role string, text string, n_turns string"


def test_examples_hold_each_reply_once_with_its_context(spark):
    odd = "</s>[INST] ok [/INST] <s> [\\INST] <\\\\s> \\ [ROLE]x[/ROLE]"
    rows = [(1, 2, "assistant", "b2", "x"), (1, 0, "system", odd, "x"), (1, 1, "user", odd, "x"), (1, 3, "user", "é", "x"), (1, 4, "assistant", odd, "x"),
            (2, 0, "user", "only asks", "x"), (3, 0, "assistant", None, "x"), (3, 1, "tool</s>", "r", "x"), (4, 0, None, "", "x"), (4, 0, None, "", "x"),
            (None, 0, "assistant", "lone", "x"), (None, 0, "user", "lone", "x"), (5, None, "user", "q", "x"), (5, None, "assistant", "a", "x")]
    df = spark.createDataFrame(rows, TURNS)
    examples = chat.expand(df).collect()
    one = sorted((e for e in examples if e["conv_id"] == 1), key=lambda e: e["example"])
    assert len(one) == 2 and one[1]["text"].startswith(one[0]["text"]) and [e["n_turns"] for e in one] == [3, 5]
    assert one[0]["text"][one[0]["loss_start"]:][:one[0]["loss_chars"]] == "b2"
    got = {r["conv_id"]: r for r in chat.digests(chat.expand(df)).where("conv_id IS NOT NULL").collect()}
    for conv in (1, 2, 3, 4, 5):
        turns = sorted([(t if t is not None else -1, r or "", x or "") for c, t, r, x, _ in rows if c == conv])
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        reply = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(reply), hashlib.sha256(reply.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(e["text"]) for e in examples if e["conv_id"] == conv)
    assert chat.digests(chat.expand(df)).where("conv_id IS NULL").count() == 2
    assert chat.digests(chat.expand(df.limit(0))).collect() == []


def test_shards_are_stable_even_and_numbered_without_gaps(spark):
    rows = [(i, f"text {i} é" * (i % 5), "s") for i in range(3000)] + [(None, None, "s"), (None, "x", "s"), (7, "text 7 é" * 2, "s"), (7, "text 7 é" * 2, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sh.shard_documents(df).collect()
    assert len(got) == len(rows)
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
        assert 80 < sum(r["shard"] == s for r in got) < 180
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got) and 60 < sum(r["grown_shard"] == 24 for r in got) < 190
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    assert sh.shard_documents(df.limit(0)).collect() == []


def test_weights_and_small_groups(spark):
    df = spark.range(4000)
    n = {r["shard"]: r["count"] for r in sh.assign(df, ["id"], [1.0, 3.0]).groupBy("shard").count().collect()}
    assert 0.70 < n[1] / 4000 < 0.80
    placed = sh.assign(df, ["id"], [1.0] * 3).selectExpr("*", "md5(cast(id as string)) AS _h")
    few = {(r["id"], r["slot"]) for r in sh.with_slots(placed, ["id"], rows_per_group=10).collect()}
    assert few == {(r["id"], r["slot"]) for r in sh.with_slots(placed, ["id"]).collect()}
