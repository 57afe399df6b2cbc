import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from ebbtide.llm.token_counts import Counter, count_tokens

TEXTS = ["", " ", "  ", "a", "a b", "a  b", "a   b ", " a", "a \nb", "a\n b", "a\n \n b", "\n\n", "a\t b", "a  b", "a  b", "it's 'll don't",
         "x<|endoftext|> y", "x <|endoftext|>y", "x\n <|endoftext|> z", "<|endoftext|><|endoftext|>", "日本語 テキスト 12345", "é" * 5000, "a" * 3000,
         "word " * 4000, "a \x0b b", "a\x1c b", "tab\t\tend ", "é ́x", "  a  ", "!! ?? ..", "\u0085 a", "a \u0085", "1 2  3   4"]


def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation(), t.no_padding()
    return t


def test_counts_equal_the_library():
    t = library()
    got = Counter(public_tokenizers.path("byte_bpe_50k.json")).texts(pa.array(TEXTS, pa.string()))
    assert got.tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in TEXTS]


def test_every_short_mix_of_separators():
    import itertools
    t = library()
    texts = ["".join(x) for x in itertools.product(["a", " ", "\n", "'s", "<|endoftext|>", " "], repeat=5)]
    got = Counter(public_tokenizers.path("byte_bpe_50k.json")).texts(pa.array(texts, pa.string()))
    want = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    assert got.tolist() == want


def test_documents(spark):
    t = library()
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "w " * 2000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r) for r in count_tokens(df).collect()), key=repr)
    want = sorted(((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x, _ in rows), key=repr)
    assert got == want
    assert count_tokens(df.limit(0)).collect() == []
