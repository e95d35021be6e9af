"""Substring dedup: words that lie in a passage of `window` words which starts anywhere else are removed.

Fixed-block anchors. Every document is cut into non-overlapping reference blocks of half a window. A window holds exactly
one whole block of its own document, and if the window's words also start elsewhere, that block is hit there by
a rolling probe. So

1. the blocks of all documents are the index; every rolling window of block length probes it, and a block is an anchor if
   more than its own probe hits it;
2. hits are extended: only windows around an anchor are compared whole, by 80 bits; of a maximal exact repeat, every
   window finds its twin, and the windows found cover exactly the maximal repeats of at least `window` words.

Both steps are packed questions (see `units`): a probe costs about four bytes, a window around an anchor about eight, a
passage that a third of all documents share is one entry a unit, and no pairs are ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import long_field, store, without
from .units import ask, bucket_count, buckets_of, by_bucket, expand, expand_sorted, one_by_one, pack_units, squeeze, squeeze_sorted, unpack
from .words import U64, places, room, run_hashes, split_words, word_hashes

WINDOW = 35
KEY_BITS = 48


class Probes:
    """The distinct rolling windows of block length of one unit, ascending, and where its reference blocks are."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, block: int):
        keys = run_hashes(hashes, block) >> U64(64 - KEY_BITS)
        self.block, self.place, self.room = block, places(bounds), room(bounds)
        starts = np.flatnonzero(self.room >= block)
        self.keys, inverse, counts = np.unique(keys[starts], return_inverse=True, return_counts=True)
        self.twice = counts > 1
        aligned = self.place[starts] % block == 0
        self.block_starts, self.block_keys = starts[aligned], inverse[aligned]
        self.is_block = np.zeros(len(self.keys), dtype=bool)
        self.is_block[self.block_keys] = True

    def anchors(self, answers: dict[int, bytes], buckets: int) -> np.ndarray:
        """Whether an anchor begins at each word."""
        hit = np.zeros(len(self.keys), dtype=bool)
        edges = buckets_of(self.keys, KEY_BITS, buckets)
        for bucket, load in answers.items():
            part = slice(edges[bucket], edges[bucket + 1])
            own = np.flatnonzero(self.is_block[part])
            hit[part][own] = np.unpackbits(expand(load)[0], count=len(own)).astype(bool)
        found = np.zeros(len(self.place), dtype=bool)
        found[self.block_starts] = hit[self.block_keys]
        return found


class Windows:
    """The windows of one unit around anchors: `starts`, and the distinct ones as (key, check), ascending."""

    def __init__(self, words: pa.Array, hashes: np.ndarray, probes: Probes, anchors: np.ndarray, window: int):
        block = probes.block
        whole = np.flatnonzero(probes.room >= window)
        own = whole + (-probes.place[whole]) % block
        self.starts = whole[anchors[own]]
        if len(self.starts):
            key = run_hashes(hashes, window)[self.starts] >> U64(64 - KEY_BITS)
            check = run_hashes(word_hashes(words, 1), window)[self.starts].astype(np.uint32)
        else:
            key, check = np.empty(0, U64), np.empty(0, np.uint32)
        self.key, self.check, self.twice, self.inverse = distinct_pairs(key, check, np.zeros(len(key), bool))

    def repeated(self, answers: dict[int, bytes], buckets: int) -> np.ndarray:
        """The starts of windows whose words start anywhere else."""
        hit = np.zeros(len(self.key), dtype=bool)
        edges = buckets_of(self.key, KEY_BITS, buckets)
        for bucket, load in answers.items():
            part = slice(edges[bucket], edges[bucket + 1])
            hit[part] = np.unpackbits(expand(load)[0], count=edges[bucket + 1] - edges[bucket]).astype(bool)
        return self.starts[hit[self.inverse]] if len(self.starts) else self.starts


def distinct_pairs(key: np.ndarray, check: np.ndarray, twice: np.ndarray):
    """Distinct (key, check) ascending, whether each occurs more than once, and the place of each input among them."""
    order = np.lexsort((check, key))
    k, c, t = key[order], check[order], twice[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    rank = np.cumsum(new) - 1
    inverse = np.empty(len(k), dtype=np.int64)
    inverse[order] = rank
    first = np.flatnonzero(new)
    more = np.bincount(rank, minlength=len(first)) > 1 if len(k) else np.zeros(0, bool)
    if len(k):
        more |= np.bincount(rank, weights=t, minlength=len(first)) > 0
    return k[first], c[first], more, inverse


def _cut(lengths: list[int]) -> list[slice]:
    ends = np.cumsum([0, *lengths])
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]


def answer_probes(loads: list[bytes]) -> list[bytes | None]:
    """For every unit, which of its blocks are hit by another probe than their own."""
    found = [expand_sorted(x) for x in loads]
    keys = np.concatenate([f[0] for f in found])
    twice = np.concatenate([np.unpackbits(f[1], count=len(f[0])) for f in found])
    _, inverse = np.unique(keys, return_inverse=True)
    hit = np.bincount(inverse, weights=1 + twice) > 1
    replies = []
    for f, part in zip(found, _cut([len(f[0]) for f in found])):
        own = hit[inverse[part]][np.unpackbits(f[2], count=len(f[0])).astype(bool)]
        replies.append(squeeze(np.packbits(own)) if own.any() else None)
    return replies


def answer_windows(loads: list[bytes]) -> list[bytes | None]:
    """For every unit, which of its windows also start elsewhere."""
    found = [expand_sorted(x) for x in loads]
    *_, more, inverse = distinct_pairs(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]),
                                       np.concatenate([np.unpackbits(f[2], count=len(f[0])) for f in found]))
    hits = [more[inverse[part]] for part in _cut([len(f[0]) for f in found])]
    return [squeeze(np.packbits(h)) if h.any() else None for h in hits]


def _shares(keys: np.ndarray, buckets: int, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    edges = buckets_of(keys, KEY_BITS, buckets)
    for bucket in np.flatnonzero(np.diff(edges)):
        part = slice(edges[bucket], edges[bucket + 1])
        yield int(bucket), squeeze_sorted(keys[part], *(np.packbits(a[part]) if a.dtype == bool else a[part] for a in arrays))


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs` with kept (the words left, joined by one space), n_words and n_removed.

    Words are `[^\\x20\\x09-\\x0D]+`; windows lie in one document and are judged on the input, so all copies of a repeat
    go. Null and empty texts have no words: kept is empty, both counts 0. Texts shorter than a window stay whole. Repeated
    rows are occurrences like any other, so both lose what they share. Columns of `docs` named like a result are replaced.
    """
    docs = without(docs, ["kept", "n_words", "n_removed"])
    block = (window + 1) // 2
    units = pack_units(docs, text)

    def tokens(rows: pa.RecordBatch):
        words, bounds = split_words(rows.column(rows.schema.get_field_index(text)))
        return words, bounds, word_hashes(words)

    def ask_probes(rows: pa.RecordBatch, _: dict, buckets: int):
        _, bounds, hashes = tokens(rows)
        probes = Probes(hashes, bounds, block)
        yield from _shares(probes.keys, buckets, probes.twice, probes.is_block)

    def around(rows: pa.RecordBatch, anchored: list[dict], buckets: int):
        words, bounds, hashes = tokens(rows)
        probes = Probes(hashes, bounds, block)
        return words, bounds, Windows(words, hashes, probes, probes.anchors(by_bucket(anchored), buckets), window)

    def ask_windows(rows: pa.RecordBatch, columns: dict, buckets: int):
        if columns["anchored"]:
            *_, windows = around(rows, columns["anchored"], buckets)
            yield from _shares(windows.key, buckets, windows.check, windows.twice)

    anchored = store(ask(units, ask_probes, answer_probes)).withColumnRenamed("answers", "anchored")
    # Merged at every size: whether answers are small enough to be sent around must not depend on the input.
    with_anchors = units.join(anchored.hint("merge"), "unit", "left")
    repeated = store(ask(with_anchors, ask_windows, answer_windows, ["anchored"])).withColumnRenamed("answers", "repeated")
    # One narrow row of answers a unit, so that the units themselves are shuffled once.
    both = anchored.join(repeated, "unit", "left")
    buckets = bucket_count(docs.sparkSession)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                rows = unpack(row["data"])
                if row["repeated"]:
                    words, bounds, windows = around(rows, row["anchored"], buckets)
                    starts = windows.repeated(by_bucket(row["repeated"]), buckets)
                else:
                    words, bounds = split_words(rows.column(rows.schema.get_field_index(text)))
                    starts = np.empty(0, dtype=np.int64)
                change = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + window, minlength=len(words) + 1)[:len(words) + 1]
                gone = np.cumsum(change)[:len(words)] > 0
                before = np.concatenate(([0], np.cumsum(gone)))
                kept = pa.ListArray.from_arrays(pa.array(bounds - before[bounds], pa.int32()), words.filter(pa.array(~gone)))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pc.binary_join(kept, pa.scalar(" ", words.type)).cast(pa.string()), pa.array(np.diff(bounds), pa.int64()), pa.array(np.diff(before[bounds]), pa.int64())],
                    [*rows.schema.names, "kept", "n_words", "n_removed"])

    shape = T.StructType([*docs.schema.fields, T.StructField("kept", T.StringType()), long_field("n_words"), long_field("n_removed")])
    return units.join(both.hint("merge"), "unit", "left").select("data", "anchored", "repeated").mapInArrow(rewrite, shape)


def removal_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of what is kept."""
    done = remove_repeats(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
