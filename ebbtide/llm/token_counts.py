"""Token counts of whole texts by byte-level BPE: Arrow batches balanced by bytes, texts split at safe boundaries, lengths only."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ebbtide.llm.common import documents, ship, slices, text_of
from ebbtide.llm.textstats import coded

BATCH_BYTES = 2 << 20
CALL_BYTES = 256 << 10
KEPT_PIECES = 200_000
#: Space that another white-space character or the end follows: there the run of white space goes on and must stay whole.
_RUN = r" [\s\pZ\x{85}\x{1c}-\x{1f}\x{0b}]| $|\|>"
#: In such texts, only before a space that follows a printable ASCII character.
_SURE = re.compile(r"(?<=[!-~])(?= )")


class Counter:
    """Counts tokens. The pieces between safe boundaries are encoded apart: no pre-token has white space after other characters, and
    in a run of white space only the last space joins what follows. A bounded table keeps the lengths of pieces already seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        first = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True):
            raise ValueError("safe boundaries are known for byte-level BPE without normalizer and prefix space only")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kept: dict[str, int] = {}

    def pieces(self, found: list[str]) -> np.ndarray:
        """Tokens of each piece."""
        kept = self.kept
        new = [p for p in dict.fromkeys(found) if p not in kept]
        if len(kept) + len(new) > KEPT_PIECES:
            kept.clear()
            new = list(dict.fromkeys(found))
        at = 0
        while at < len(new):
            upto, held = at, 0
            while upto < len(new) and (upto == at or held + 4 * len(new[upto]) <= CALL_BYTES):
                held += 4 * len(new[upto])
                upto += 1
            got = self.library.encode_batch_fast(new[at:upto], add_special_tokens=False)
            kept.update(zip(new[at:upto], map(len, got), strict=True))
            at = upto
        return np.fromiter(map(kept.__getitem__, found), np.int64, len(found))

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; texts: strings without nulls."""
        out = np.zeros(len(texts), np.int64)
        odd = np.asarray(pc.match_substring_regex(texts, _RUN), dtype=bool)
        even = texts.filter(pa.array(~odd))
        if len(even):
            lists = pc.split_pattern(even, " ")
            offsets = np.asarray(lists.offsets, dtype=np.int64)
            offsets = offsets - offsets[0]
            piece, known = coded(lists.flatten())
            code = 2 * piece + 1
            code[offsets[:-1]] -= 1  # the first piece of a text has no space before it
            used = np.zeros(2 * len(known), bool)
            used[code] = True
            codes = np.flatnonzero(used)
            names = known.to_pylist()
            length = np.zeros(len(used), np.int64)
            length[codes] = self.pieces([" " + names[c >> 1] if c & 1 else names[c >> 1] for c in codes.tolist()])
            out[~odd] = np.add.reduceat(length[code], offsets[:-1])
        for i in np.flatnonzero(odd):
            out[i] = self.pieces(_SURE.split(texts[i].as_py())).sum()
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document, equal to the library's count of the whole text.

    Null text: empty, no tokens. Null and repeated doc_ids keep their rows; an empty table gives no rows; other columns are not read.
    A text that never has a safe boundary is encoded in one call.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(public_tokenizers.path(tokenizer))
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                texts = part.column("text")
                n = count.texts(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n), pa.array(n > limit)],
                                                 ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
