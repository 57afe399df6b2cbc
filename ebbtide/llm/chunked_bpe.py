"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the bytes before says so, hence equal stretches of different documents give equal chunks.
Documents are routed by their least chunk hash, so those that share chunks meet in one task, which encodes each chunk once. A cut
may fall inside a word: the word over the join is encoded anew together with its neighbours, and where these don't come out
as the chunks have them, the whole text is encoded in one call.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import textstats as ts
from ebbtide.llm.common import documents, ship, slices, text_of

BATCH_BYTES = 2 << 20
WINDOW, MASK = 16, (1 << 10) - 1     # cuts about every 1024 bytes
KEPT_WORDS, KEPT_BYTES = 250_000, 16 << 20
APART, TOGETHER = "\x01", 128         # between words that go to the library in one text, and how many do
_DRAWN = np.random.default_rng(16).integers(1, 1 << 32, 256, np.uint32)
_FACTOR = np.uint32(0x9E3779B1)
_BLANK = b" \t\n\r\x0b\x0c"


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places between code points where the hash of the WINDOW bytes before, all of one text, has its low bits zero."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    h, factor, width = _DRAWN[data], _FACTOR, 1
    while width < WINDOW:   # the hash of 2 * width bytes from two of width bytes
        h = h[:-width] * factor + h[width:]
        factor, width = np.uint32(int(factor) * int(factor) & 0xFFFFFFFF), 2 * width
    h ^= h >> np.uint32(15)
    at = np.flatnonzero((h & np.uint32(MASK)) == 0) + WINDOW
    at = at[at < len(data)]
    at = at[(data[at] & 0xC0) != 0x80]
    doc = np.searchsorted(offsets, at, side="right") - 1
    return at[at - offsets[doc] >= WINDOW]


class Encoder:
    """The tokenizer of one worker, the words it has encoded (the latest, and those before them) and the chunks: all bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = json.dumps(spec.get("pre_tokenizer") or {})
        if spec.get("decoder") or spec["model"].get("end_of_word_suffix") != "</w>" or '"Removed"' not in split or r"\\s" not in split:
            raise ValueError("chunks are joined at white space: a tokenizer that drops it and ends words is needed")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.names = {i: x.encode() for x, i in self.library.get_vocab().items()}
        self.apart = self.library.encode(APART, add_special_tokens=False).ids
        self.words: dict[bytes, tuple[bytes, bytes]] = {}
        self.before: dict[bytes, tuple[bytes, bytes]] = {}
        self.chunks: dict[bytes, tuple[bytes, bytes, bytes, bytes, bytes, bytes]] = {}
        self.held = self.encoded_chunks = self.disagreed = 0

    def release(self) -> None:
        """Forgets the chunks at the end of a task: the next one's are others."""
        self.chunks.clear()
        self.held = 0

    def _packed(self, ids: list[int]) -> tuple[bytes, bytes]:
        return np.asarray(ids, "<u4").tobytes(), b" ".join([self.names[i] for i in ids])

    def _each(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """_packed of each word. TOGETHER words are one text with APART between them; where one of them makes APART's token too, each is encoded alone."""
        groups = [words[at:at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        texts = [f" {APART} ".join([w.decode() for w in g]) for g in groups]
        for group, e in zip(groups, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = e.ids
            packed = np.asarray(ids, "<u4")
            ends = np.flatnonzero(packed == self.apart[0]).tolist() if len(self.apart) == 1 else []
            if len(ends) != len(group) - 1:
                yield from (self._packed(x.ids) for x in self.library.encode_batch_fast([w.decode() for w in group], add_special_tokens=False))
                continue
            raw, said, a = packed.tobytes(), [self.names[i] for i in ids], 0
            for b in [*ends, len(ids)]:
                yield raw[4 * a:4 * b], b" ".join(said[a:b])
                a = b + 1

    def _learn(self, words: set[bytes]) -> None:
        """Words of the last fill are taken over, not encoded anew."""
        new = words.difference(self.words)
        kept = {w: self.before[w] for w in new if w in self.before}
        if self.words and len(self.words) + len(new) > KEPT_WORDS:
            kept |= {w: self.words[w] for w in words if w in self.words}
            self.before, self.words = self.words, {}
        self.words.update(kept)
        new = list(new.difference(kept))
        for at in range(0, len(new), 4096):
            part = new[at:at + 4096]
            self.words.update(zip(part, self._each(part), strict=True))

    def _chunk(self, parts: list[bytes], head: bytes, tail: bytes) -> tuple:
        """head, ids, decoded, tail (head and tail: words that may go on outside), first and last word between them."""
        mid = parts[bool(head):len(parts) - bool(tail)]
        found = list(map(self.words.__getitem__, mid))
        return (head, b"".join([f[0] for f in found]), b" ".join([f[1] for f in found if f[1]]), tail, mid[0] if mid else b"", mid[-1] if mid else b"")

    def texts(self, texts: list[list[bytes]]) -> list[tuple[bytes, bytes]]:
        """ids and decoded text of each text, given as its chunks."""
        if self.held > KEPT_BYTES:
            self.chunks.clear()
            self.held = 0
        fresh = {}
        for chunk in {c for t in texts for c in t if c not in self.chunks}:
            parts = chunk.split()
            head = parts[0] if parts and chunk[0] not in _BLANK else b""
            tail = parts[-1] if parts and chunk[-1] not in _BLANK else b""
            fresh[chunk] = (parts, head, tail)
        inner = set().union(*(parts for parts, _, _ in fresh.values()))
        walks = []
        for t in texts:   # the words over the joins, with the chunks' words beside them
            pending, last, walk = b"", b"", []
            for chunk in t:
                if chunk in fresh:
                    parts, head, tail = fresh[chunk]
                    solid = len(parts) == 1 and head and tail
                    first, end = (parts[bool(head)], parts[-1 - bool(tail)]) if len(parts) > bool(head) + bool(tail) else (b"", b"")
                else:
                    head, ids, _, tail, first, end = self.chunks[chunk]
                    solid = head and head == tail and head == chunk
                if solid:
                    pending += chunk
                    continue
                walk.append((last, pending + head, first, chunk))
                pending, last = tail, end or (pending + head) or last
            walk.append((last, pending, b"", b""))
            walks.append(walk)
        joints = {w for walk in walks for _, w, _, _ in walk if w} | {x for walk in walks for a, _, b, _ in walk for x in (a, b) if x}
        self._learn(inner | joints)
        for chunk, (parts, head, tail) in fresh.items():
            self.chunks[chunk] = self._chunk(parts, head, tail)
            self.held += 4 * len(chunk) + 300
            self.encoded_chunks += 1
        windows = {(a, w, b) for walk in walks for a, w, b, _ in walk if w and (a or b)}
        order = list(windows)
        wrong = set()
        for at in range(0, len(order), 4096):
            part = order[at:at + 4096]
            got = self.library.encode_batch_fast([b" ".join(filter(None, x)).decode() for x in part], add_special_tokens=False)
            wrong |= {x for x, e in zip(part, got, strict=True) if np.asarray(e.ids, "<u4").tobytes() != b"".join(self.words[w][0] for w in x if w)}
        out = []
        for t, walk in zip(texts, walks, strict=True):
            if wrong and any((a, w, b) in wrong for a, w, b, _ in walk):
                self.disagreed += 1
                out.append(self._packed(self.library.encode(b"".join(t).decode(), add_special_tokens=False).ids))
                continue
            ids, said = [], []
            for _, w, _, chunk in walk:
                if w:
                    ids.append(self.words[w][0])
                    said.append(self.words[w][1])
                if chunk:
                    ids.append(self.chunks[chunk][1])
                    said.append(self.chunks[chunk][2])
            out.append((b"".join(ids), b" ".join(filter(None, said))))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def routed(docs: DataFrame) -> DataFrame:
    """doc_id, packed (the text compressed), n_bytes, ends (of its chunks), dealt out by the least chunk hash. The rebalancing exchange
    splits what a third of all rows may share, and each part encodes the chunk once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd", 1)
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                data, offsets = ts.raw(part.column("text"))
                at = cuts(data, offsets)
                doc = np.searchsorted(offsets, at, side="right") - 1
                full = data.tobytes()
                ends = np.split(at, np.searchsorted(doc, np.arange(1, part.num_rows)))
                keys, packed, places = [], [], []
                for i, own in enumerate(ends):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    edges = [a, *own.tolist(), b]
                    keys.append(min(xxhash.xxh3_64_intdigest(full[x:y]) for x, y in zip(edges, edges[1:], strict=False)) - (1 << 63))
                    packed.append(zstd.compress(full[a:b], asbytes=True))
                    places.append([e - a for e in edges[1:]])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed, pa.binary()), pa.array(np.diff(offsets)), pa.array(places, pa.list_(pa.int32())), pa.array(keys, pa.int64())],
                                                 ["doc_id", "packed", "n_bytes", "ends", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, packed binary, n_bytes long, ends array<int>, key long").hint("rebalance", F.col("key"))


def encode(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and decoded of every document, equal to the library's on the whole text.

    Null text: empty, no ids, decoded empty. Null and repeated doc_ids keep their rows; an empty table gives no rows; other columns are not
    read. A text without white space is one word, encoded in one call.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, zstd = encoder(public_tokenizers.path(tokenizer)), pa.Codec("zstd")
        for batch in batches:
            sizes = batch.column("n_bytes").to_pylist()
            at = 0
            while at < batch.num_rows:
                upto, held = at, 0
                while upto < batch.num_rows and (upto == at or held + sizes[upto] <= BATCH_BYTES):
                    held += sizes[upto]
                    upto += 1
                part = batch.slice(at, upto - at)
                texts = []
                for z, n, ends in zip(part.column("packed"), sizes[at:upto], part.column("ends").to_pylist(), strict=True):
                    text = zstd.decompress(z.as_buffer(), n, asbytes=True) if n else b""
                    texts.append([text[x:y] for x, y in zip([0, *ends], ends, strict=False)] if n else [])
                ids, said = zip(*enc.texts(texts), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(said, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])
                at = upto
            pa.default_memory_pool().release_unused()
        enc.release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    ship(docs.sparkSession)
    return routed(docs).select("doc_id", "packed", "n_bytes", "ends").mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(documents(spark, sf_dir)))
