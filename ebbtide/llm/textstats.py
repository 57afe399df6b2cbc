"""Exact statistics of a batch of texts, vectorised over the batch. A word is ``[^\\x20\\x09-\\x0D]+``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def byte_class(chars: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars.encode())] = True
    return found


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 places where they start and end. texts: strings without nulls."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many places of each text are set."""
    upto = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, out=upto[1:])
    return (upto[offsets[1:]] - upto[offsets[:-1]]).astype(np.int64)


def count_class(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    data, offsets = raw(texts)
    return per_text(table[data], offsets)


def word_chars(texts: pa.Array) -> np.ndarray:
    """Code points in words: bytes that are neither space nor the continuation of a code point."""
    data, offsets = raw(texts)
    return per_text(~_SPACE[data] & ((data & 0xC0) != 0x80), offsets)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and the n + 1 places where the texts start and end among them."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():
        offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
        flat = flat.filter(pa.array(full))
    return flat, offsets


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, and the value of each number."""
    found = values.dictionary_encode()
    return np.asarray(found.indices, dtype=np.int64), found.dictionary


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string (no nulls): a polynomial of its bytes, mixed with its length and the seed."""
    data, offsets = raw(values)
    n = np.diff(offsets)
    powers = np.full(int(n.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    upto = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(offsets[:-1], n)], out=upto[1:])
    return _mixed(_mixed(upto[offsets[1:]] - upto[offsets[:-1]]) + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


def repeated_words(words: np.ndarray, offsets: np.ndarray, size: int = 8) -> np.ndarray:
    """For each text, its words in windows of size words that it has twice or more (the first included).

    Windows are matched by a 64-bit hash; matches are compared word by word, and a batch with a false one is sorted exactly."""
    texts = len(offsets) - 1
    doc = np.repeat(np.arange(texts), np.diff(offsets))
    starts = np.flatnonzero(offsets[doc + 1] - np.arange(len(words)) >= size) if len(words) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(texts, np.int64)
    drawn = _mixed(words)
    h = _mixed(doc[starts] + 1)
    for j in range(size):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) + drawn[starts + j]
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    a, b = starts[order[same]], starts[order[same + 1]]
    span = np.arange(size)
    if len(same) and not ((words[a[:, None] + span] == words[b[:, None] + span]).all() and (doc[a] == doc[b]).all()):
        keys = np.column_stack([words[starts[:, None] + span], doc[starts]])
        order = np.lexsort(keys.T)
        same = np.flatnonzero((keys[order][1:] == keys[order][:-1]).all(axis=1))
        a, b = starts[order[same]], starts[order[same + 1]]
    twice = np.unique(np.concatenate([a, b]))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + size, -1)
    return per_text(np.cumsum(edge[:-1]) > 0, offsets)


def duplicate_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text, its lines with a word, and those of them that equal an earlier line."""
    lists = pc.split_pattern(texts, "\n")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    line, known = coded(lists.flatten())
    worded = np.asarray(pc.match_substring_regex(known, r"[^\x20\x09-\x0D]"), dtype=bool) if len(known) else np.zeros(0, bool)
    full = worded[line]
    n = per_text(full, offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))[full]
    different = np.unique(doc * max(len(known), 1) + line[full]) // max(len(known), 1)
    return n, n - np.bincount(different, minlength=len(texts))
