"""Words of whole Arrow columns as flat numpy arrays, and hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words `[^\\x20\\x09-\\x0D]+` of a column, and where each row's words begin (one bound more than rows).

    A null text has no words. Only ASCII white space divides; other characters are left unchanged.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    lists = pc.ascii_split_whitespace(texts)
    words, ends = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    ends = ends - ends[0]
    full = np.asarray(pc.binary_length(words)) > 0
    if not full.all():
        words = words.filter(pa.array(full))
        ends = np.concatenate(([0], np.cumsum(full)))[ends]
    return words, ends


def mix(a: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    a = (a ^ (a >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> U64(27))) * U64(0x94D049BB133111EB)
    return a ^ (a >> U64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence (a, b)."""
    return mix(a * U64(0x9E3779B97F4A7C15) + mix(b + U64(0xD1B54A32D192ED03)))


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64 bits for every word; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in distinct), dtype=U64, count=len(distinct))
    return table[np.asarray(coded.indices)] if len(distinct) else np.empty(0, dtype=U64)


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of `length` consecutive entries, by doubling: about log2(length) passes."""
    if len(hashes) < length:
        return np.empty(0, dtype=U64)
    out, at, power, width = None, 0, hashes, 1
    while True:
        if length & width:
            part = power[at:at + len(hashes) - length + 1]
            out = part if out is None else pair(out, part)
            at += width
        width *= 2
        if width > length:
            return out
        power = pair(power[:-(width // 2)], power[width // 2:])


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row each entry belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def room(bounds: np.ndarray) -> np.ndarray:
    """For each entry, how many entries of its row begin there or later."""
    return np.repeat(bounds[1:], np.diff(bounds)) - np.arange(bounds[-1])


def places(bounds: np.ndarray) -> np.ndarray:
    """The number of each entry in its row."""
    return np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))
