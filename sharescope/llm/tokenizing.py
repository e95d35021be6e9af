"""Ids and counts of a public tokenizer for whole Arrow columns, each distinct piece encoded once.

Both kinds of vocabulary split a text at white space before they merge, so a text may be cut before a white space that
follows something else, and its ids are those of the pieces in order. Pieces that are plain words go to the merge
step alone; any other piece goes through the whole library.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa

# A word of letters that lower-case and compose to single letters, with ASCII marks after it.
PLAIN = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")
CACHED = 400_000


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a byte as itself if it is printable, and else as the next letter from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def byte_letters(text: str) -> str:
    return text.encode().decode("latin-1").translate(_LETTERS)


class Encoder:
    """One tokenizer in one worker, with the ids of pieces it met lately."""

    def __init__(self, path: str, lower: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.whole, self.lower = Tokenizer.from_file(path), lower
        self.merge, self.known = self.whole.model, {}

    def ids(self, piece: bytes) -> tuple[int, ...]:
        text = piece.decode()
        plain = PLAIN.fullmatch(text)
        if not plain:
            return tuple(self.whole.encode(text, add_special_tokens=False).ids)
        blank, word, marks = plain.groups()
        if self.lower:
            blank, word = "", word.lower()
        found = [t.id for t in self.merge.tokenize(byte_letters(blank + word))]
        if marks:
            found += [t.id for t in self.merge.tokenize(byte_letters(marks))]
        return tuple(found)

    def lookup(self, pieces: pa.Array) -> tuple[np.ndarray, list[tuple[int, ...]]]:
        """A code for every piece, and the ids behind the codes."""
        coded = pieces.dictionary_encode()
        if len(self.known) > CACHED:
            self.known.clear()
        known, ids = self.known, []
        for piece in coded.dictionary.cast(pa.large_binary()).to_pylist():
            found = known.get(piece)
            if found is None:
                found = known[piece] = self.ids(piece)
            ids.append(found)
        return np.asarray(coded.indices), ids


@functools.lru_cache(maxsize=4)
def encoder(path: str, lower: bool) -> Encoder:
    return Encoder(path, lower)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all rows together, and the bounds of the rows; a null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, bounds - bounds[0]


def stable_cuts(raw: np.ndarray) -> np.ndarray:
    """Positions where every scan of the text starts a new piece, whatever lies before or after.

    A blank, tab or line end directly after a character that is surely no white space: printable ASCII, or a two- or
    three-byte character outside the blocks that hold other white space. No piece, and no special string, spans it.
    """
    blank = (raw == 0x20) | (raw == 0x0A) | (raw == 0x09) | (raw == 0x0D)
    at = np.flatnonzero(blank)
    at = at[at > 0]
    last = raw[at - 1]
    second = np.where(at > 1, raw[at - 2], 0)
    third = np.where(at > 2, raw[at - 3], 0)
    sure = (last > 0x20) & (last < 0x7F)
    sure |= (last >= 0x80) & (second >= 0xC3) & (second <= 0xDF)
    sure |= (last >= 0x80) & (second >= 0x80) & (second < 0xC0) & (third >= 0xE4) & (third <= 0xEE)
    return at[sure]


def pieces_between(raw: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The pieces between consecutive cuts, without copying a byte."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
