import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from ebbtide.llm import chunked_bpe as cb
from ebbtide.llm import textstats as ts

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    return t


def texts():
    r = random.Random(0)
    made = ["", " ", "a", "A b", "x<|endoftext|>y z", "<|startoftext|> it's DON'T", "日本語テキスト" * 300, "a" * 4000, " é́ ́x á ", "ÀÉ ß\x0bb\x1cc\x85d", "Σίσυφος ΟΔΟΣ", "\n\n\n" * 400]
    shared = " ".join(f"w{r.randrange(999)}" for _ in range(900))
    for i in range(40):
        made.append(" ".join(r.choice(["Foo", "bär,", "x1y22", "<|endoftext|>", "'s", "…", "\t", "é"]) for _ in range(r.randrange(600))) + (shared if i % 2 else ""))
    return made


def want(t, text):
    ids = t.encode(text, add_special_tokens=False).ids
    return np.asarray(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)


def test_any_cut_gives_the_library_s_ids():
    t, r = library(), random.Random(1)
    made = texts()
    parts = []
    for x in made:
        at = sorted(r.sample(range(1, len(x)), min(len(x) - 1, r.randrange(1, 40)))) if len(x) > 1 else []
        parts.append([x[a:b].encode() for a, b in zip([0, *at], [*at, len(x)], strict=True)] if x else [])
    enc = cb.Encoder(PATH)
    for _ in range(2):   # the second time all chunks are known
        assert [(a, b.decode()) for a, b in enc.texts(parts)] == [want(t, x) for x in made]


def test_each_chunk_once_and_shared():
    enc = cb.Encoder(PATH)
    shared = " ".join(f"word{i * 7919 % 5003}" for i in range(3000))
    arr = pa.array([f"{i} start {shared} end {i}" for i in range(20)])
    data, offsets = ts.raw(arr)
    at = cb.cuts(data, offsets)
    full = data.tobytes()
    chunked = []
    for i in range(20):
        edges = [offsets[i], *at[(at > offsets[i]) & (at < offsets[i + 1])], offsets[i + 1]]
        chunked.append([full[x:y] for x, y in zip(edges, edges[1:], strict=False)])
    total = sum(map(len, chunked))
    enc.texts(chunked[:10])
    enc.texts(chunked[10:])
    assert enc.encoded_chunks == len({c for x in chunked for c in x}) < total / 6


def test_disagreement_takes_the_whole_text(monkeypatch):
    t, enc = library(), cb.Encoder(PATH)
    learn = enc._learn

    def wrongly(words):
        learn(words)
        enc.words[b"ab"] = (b"\0\0\0\0", b"!")
    monkeypatch.setattr(enc, "_learn", wrongly)
    assert [(a, b.decode()) for a, b in enc.texts([[b"x a", b"b y"]])] == [want(t, "x ab y")] and enc.disagreed == 1


def test_documents(spark):
    t = library()
    rows = [(i, x, "q") for i, x in enumerate(texts())] + [(None, None, "q"), (3, "A b", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, cb.digests(cb.encode(docs)).collect()), key=repr)
    out = []
    for i, x, _ in rows:
        ids, said = want(t, x or "")
        out.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert got == sorted(out, key=repr)
    assert cb.encode(docs.limit(0)).collect() == []


class Counted:
    """The library, and how many words and texts it was asked for."""

    def __init__(self, library):
        self.library, self.words, self.texts = library, 0, 0

    def __getattr__(self, name):
        return getattr(self.library, name)

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        self.words += sum(w != cb.APART for x in texts for w in x.split(" "))
        return self.library.encode_batch_fast(texts, **how)


def test_words_of_the_last_fill_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(cb, "KEPT_WORDS", 100)
    enc = cb.Encoder(PATH)
    enc.library = Counted(enc.library)
    first, then = ({f"{x}word{i}".encode() for i in range(60)} for x in "ab")
    for words in (first, then, first, then):
        enc._learn(words)
        assert all(enc.words[w][0] == want(enc.library, w.decode())[0] for w in words) and len(enc.words) <= 100
    assert enc.library.words == 120 and enc.library.texts <= 4


def test_words_with_the_separator_are_encoded_alone():
    t, enc = library(), cb.Encoder(PATH)
    odd = ["\x01", "a\x01b", "\x01\x01", "x\x01", "<|endoftext|>", "don't", "\x85", "\u3000", "e\u0301", "\u0301", "Z!"]
    words = [w.encode() for w in [*odd, *(f"w{i}" for i in range(300))]]
    assert len(enc.apart) == 1
    assert [(a, b.decode()) for a, b in enc._each(words)] == [want(t, w.decode()) for w in words]
    plain = words[11:] + ["\x85".encode(), "\u3000".encode(), "\u0301".encode(), b"Z!"]
    assert [(a, b.decode()) for a, b in enc._each(plain)] == [want(t, w.decode()) for w in plain]
