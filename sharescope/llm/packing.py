"""Packing into fixed sequences: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

Only lengths travel. Where a document is read it is encoded and cut: into whole sequences as long as it fills them, and one
rest; every piece's checksum is taken there. The rests are dealt to groups at random by hash, so that each group is
a fair sample of the lengths, and each group is packed alone by first-fit decreasing. The tree keeps in every node the
largest capacity left below it, so the first bin that fits is found in log(bins) steps.

Padding is what first fit leaves, mostly in a group's last bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import given_back, long_field, quoted, set_aside, slices, store
from .tokenizing import encoder
from .words import split_words

SEQUENCE = 4096
GROUP_ROWS = 8192
END = 2
PIECE = ["start", "length", "ids_crc32", "doc_tokens"]


class Tournament:
    """Bins of one size in a complete binary tree; `place` gives the first bin with room."""

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [size] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """The first bin that `length` fits into, and where it begins there. The caller provides a bin for each piece."""
        node = 1
        while node < self.leaves:
            node *= 2
            if self.best[node] < length:
                node += 1
        bin_, left = node - self.leaves, self.best[node]
        self.best[node] = left - length
        while node > 1:
            node //= 2
            self.best[node] = max(self.best[2 * node], self.best[2 * node + 1])
        return bin_, left


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length, longest first and equal ones in the given order."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree = Tournament(max(1, len(lengths)), size)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bin_, left = tree.place(int(lengths[i]))
        bins[i], offsets[i] = bin_, size - left
    return bins, offsets


def encoded_rows(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows together, each with the end id, and the bounds of the rows."""
    words, bounds = split_words(texts)
    codes, ids = encoder(path, True).lookup(words)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    table = np.fromiter((i for found in ids for i in found), np.uint32, int(sizes.sum()))
    begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    each = sizes[codes] if len(codes) else np.empty(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(each)))
    flat = table[np.repeat(begins[codes] - ends[:-1], each) + np.arange(ends[-1])] if len(codes) else np.empty(0, np.uint32)
    rows = ends[bounds]
    return np.insert(flat, rows[1:], END).astype("<u4"), rows + np.arange(len(rows))


def pieces(docs: DataFrame, path: str, text: str, keep: list[str], size: int) -> DataFrame:
    """Every document as whole sequences and a rest: `keep`, start, length, ids_crc32, doc_tokens."""
    names = docs.columns
    kept = [names.index(c) for c in keep]
    shape = T.StructType([*(docs.schema.fields[i] for i in kept), *map(long_field, PIECE)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, text):
                ids, bounds = encoded_rows(path, rows.column(names.index(text)))
                tokens = np.diff(bounds)
                count = -(-tokens // size)
                row = np.repeat(np.arange(len(tokens)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size
                length = np.minimum(size, tokens[row] - start)
                begin = bounds[row] + start
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(rows.column(i).take(taken) for i in kept), *(pa.array(x, pa.int64()) for x in (start, length, sums, tokens[row]))],
                                                 [*keep, *PIECE])

    return docs.mapInArrow(cut, shape)


def pack(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, size: int = SEQUENCE,
         group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: the columns `keep` of its document, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is a document of the end id alone. Repeated rows are packed each. Sequence numbers are unique
    and, within a sequence, offsets run from 0 without gaps. An empty table gives no pieces. The groups are as many as keep the
    mean group at `group_rows` rests or fewer, whatever the size of the input. Columns of `docs` named like a result are replaced; all others, of any name, are kept.
    """
    results = {*PIECE, "sequence_id", "offset"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    docs, called = set_aside(docs.select(*[quoted(c) for c in dict.fromkeys([text, *keep])]), [*results, "group"])
    text, keep = called[text], [called[c] for c in keep]
    cut = store(pieces(docs, path, text, keep, size))
    groups = max(1, -(-cut.filter(F.col("length") < size).count() // group_rows))
    # By the row's place in the stored table, which stays as it is, so that equal rows are dealt apart too.
    rest = cut.filter(F.col("length") < size).withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    shape = T.StructType([*rest.schema.fields, long_field("sequence_id"), long_field("offset")])

    def fit(group: pa.Table) -> pa.Table:
        # Rows come in no set order; equal lengths are told apart by what they hold.
        group = group.sort_by([(c, "ascending") for c in ["length", "ids_crc32", *keep] if pa.types.is_primitive(group.schema.field(c).type)])
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), size)
        number = (group["group"].to_numpy() << 32) + bins
        return group.append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    packed = rest.groupBy("group").applyInArrow(fit, shape).drop("group")
    # A whole sequence needs no other piece: negative numbers, so that they meet no group's.
    whole = cut.filter(F.col("length") == size).withColumns({
        "sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return given_back(packed.unionByName(whole), {old: new for old, new in called.items() if new in keep})


def packing_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and where each piece of the document lies."""
    return pack(docs.select("doc_id", "text"), path, keep=["doc_id"])
