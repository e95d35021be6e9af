"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of up to `CHUNK` bytes is encoded where it is read. A longer one becomes chunks that overlap, dealt over all
tasks; each is encoded with the offsets of its token boundaries, and two neighbours are spliced at a boundary both
have inside their overlap. A boundary counts as proven if it is one of `stable_cuts`, where a scan must stop whatever
surrounds it, and if both chunks also agree on the boundary before it and on the tokens in between. Where an overlap
holds no such boundary, the document is encoded again with wider overlaps, until at last one chunk holds all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import given_back, long_field, set_aside, shuffle_width, slices, store, without
from .tokenizing import encoder, flat_bytes, pieces_between, stable_cuts

CHUNK = 1 << 15
OVERLAP = 512
LIMIT = 1024
ENCODED = "row long, chunk long, n long, head_at array<long>, head_n array<long>, tail_at array<long>, tail_n array<long>"


def boundaries(path: str, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sure boundaries of the rows of `raw`, and the tokens before each."""
    cuts = np.union1d(stable_cuts(raw), bounds)
    if len(cuts) < 2:
        return cuts, np.zeros(len(cuts), dtype=np.int64)
    codes, ids = encoder(path, False).lookup(pieces_between(raw, cuts))
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return cuts, np.concatenate(([0], np.cumsum(sizes[codes])))


def character_start(raw: bytes, at: int) -> int:
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunks(raw: bytes, overlap: int, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Begin and end of the overlapping chunks of a text, at characters."""
    start = 0
    while True:
        end = character_start(raw, min(len(raw), start + max(chunk, overlap) + overlap))
        yield start, end
        if end == len(raw):
            return
        start = character_start(raw, start + max(chunk, overlap))


def splice(parts: list[dict]) -> int | None:
    """Tokens of a document from its encoded chunks, or None if two of them have no proven boundary in common."""
    parts = sorted(parts, key=lambda p: p["chunk"])
    total, since = 0, 0
    for left, right in zip(parts, parts[1:]):
        common, of_left, of_right = np.intersect1d(left["tail_at"], right["head_at"], return_indices=True)
        n_left, n_right = np.asarray(left["tail_n"])[of_left], np.asarray(right["head_n"])[of_right]
        agreed = np.flatnonzero(np.diff(n_left) == np.diff(n_right)) if len(common) > 1 else []
        if not len(agreed):
            return None
        at = agreed[-1] + 1
        total += int(n_left[at]) - since
        since = int(n_right[at])
    return total + parts[-1]["n"] - since


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """`docs` (or its columns `keep`) with n_bytes (UTF-8) and n_tokens, as the tokenizer file at `path` gives them without added tokens.

    A null or empty text has 0 of either. Special strings inside a text are one token, the library's default. Repeated rows
    are counted each. Columns of `docs` named like a result are replaced.
    """
    docs, called = set_aside(without(docs, [c for c in ("n_bytes", "n_tokens") if c != text]), ["n_bytes", "n_tokens", "tokens", "_row", "_whole"])
    kept = [list(called).index(c) for c in (called if keep is None else keep)]
    names, text = docs.columns, called[text]
    shape = T.StructType([*(docs.schema.fields[i] for i in kept), long_field("n_bytes"), long_field("n_tokens"), long_field("_row"), T.StructField("_whole", T.BinaryType())])

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, text):
                texts = rows.column(names.index(text))
                raw, bounds = flat_bytes(texts)
                sizes = np.diff(bounds)
                long = sizes > chunk
                # Long rows take no part here: they are empty rows of this encoding.
                some = raw[np.repeat(~long, sizes)] if long.any() else raw
                ends = np.concatenate(([0], np.cumsum(np.where(long, 0, sizes))))
                cuts, before = boundaries(path, some, ends)
                tokens = np.diff(before[np.searchsorted(cuts, ends)])
                whole = [raw[a:b].tobytes() if x else None for a, b, x in zip(bounds, bounds[1:], long)]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(i) for i in kept), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64(), mask=long),
                     pa.array((task << 32) + done + np.arange(len(sizes)), pa.int64()), pa.array(whole, pa.binary())],
                    [*(names[i] for i in kept), "n_bytes", "n_tokens", "_row", "_whole"])
                done += len(sizes)

    first = docs.mapInArrow(direct, shape)
    first = store(first)
    results = first.filter(F.col("n_tokens").isNotNull()).drop("_row", "_whole")
    long = first.filter(F.col("n_tokens").isNull())
    open_, counted, wide = long.select("_row", "_whole"), None, overlap
    while not open_.isEmpty():
        found = store(_spliced(open_, path, chunk, wide))
        solved = found.filter(F.col("tokens").isNotNull())
        counted = solved if counted is None else counted.unionByName(solved)
        open_ = open_.join(found.filter(F.col("tokens").isNull()).select("_row"), "_row", "left_semi")
        wide *= 8
    if counted is None:
        return given_back(results, called)
    extra = long.drop("n_tokens", "_whole").join(counted, "_row").drop("_row").withColumnRenamed("tokens", "n_tokens")
    return given_back(results.unionByName(extra), called)


def _spliced(open_: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(_row, tokens): tokens is null where a joint found no proven boundary."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = raw.as_buffer().to_pybytes()
                for n, (a, b) in enumerate(chunks(raw, overlap, chunk)):
                    yield pa.RecordBatch.from_pydict({
                        "row": pa.array([row], pa.int64()), "chunk": pa.array([n], pa.int64()), "start": pa.array([a], pa.int64()),
                        "last": pa.array([b == len(raw)]), "bytes": pa.array([raw[a:b]], pa.binary())})

    step = max(chunk, overlap)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part in batch.to_pylist():
                raw = np.frombuffer(part["bytes"], np.uint8)
                cuts, before = boundaries(path, raw, np.array([0, len(raw)]))
                cuts, n = cuts + part["start"], int(before[-1])
                # A last boundary at the end of a chunk is one only where the text ends too.
                real = slice(1 if part["chunk"] else 0, None if part["last"] else -1)
                at, count = cuts[real], before[real]
                head, tail = at < part["start"] + overlap + 4, at >= part["start"] + step
                rows.append({"row": part["row"], "chunk": part["chunk"], "n": n,
                             "head_at": at[head].tolist(), "head_n": count[head].tolist(), "tail_at": at[tail].tolist(), "tail_n": count[tail].tolist()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ENCODED)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"_row": batch.column(0), "tokens": pa.array([splice(p) for p in batch.column(1).to_pylist()], pa.int64())})

    parts = open_.mapInArrow(cut, "row long, chunk long, start long, last boolean, bytes binary")
    encoded = parts.repartition(4 * shuffle_width(open_.sparkSession), "row", "chunk").mapInArrow(encode, ENCODED)
    grouped = encoded.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("chunk", "n", "head_at", "head_n", "tail_at", "tail_n")).alias("parts"))
    return grouped.mapInArrow(join, "_row long, tokens long")


_ENCODED = pa.schema([*[(name, pa.int64()) for name in ("row", "chunk", "n")],
                      *[(f"{a}_{b}", pa.list_(pa.int64())) for a in ("head", "tail") for b in ("at", "n")]])


def token_digest(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the tokens exceed `limit`."""
    counted = count_tokens(docs.select("doc_id", "text"), path, keep=["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
