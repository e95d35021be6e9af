"""Units of documents and packed questions about the whole corpus.

A unit is a few megabytes of consecutive documents, written once as a compressed Arrow batch under a number of its
own. A job over the whole corpus is then a question from every unit, dealt by hash to buckets, and an answer from every
bucket: keys travel as sorted packed arrays of a few bytes each instead of rows, each unit sends a key once however
often it holds it (so a hot key is one entry a unit), and answers come back in the order of the question, so neither
row numbers nor texts travel.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_width, slices, store

UNIT_BYTES = 4 << 20
QUESTION = "bucket int, unit long, load binary"
ANSWER = "bucket int, unit long, load binary"


def pack_units(docs: DataFrame, text: str, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """Stored units (unit, data) of all rows and columns of `docs`, in the order they are read."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def unit() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            merged = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, merged.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(merged)
            return pa.RecordBatch.from_pydict({"unit": pa.array([(task << 32) + n], pa.int64()),
                                               "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            for part in slices(batch, text, unit_bytes):
                more = part.nbytes
                if held and size + more > 1.5 * unit_bytes:
                    yield unit()
                    n, held, size = n + 1, [], 0
                held.append(part)
                size += more
        if held:
            yield unit()

    return store(docs.mapInArrow(pack, "unit long, data binary"))


def unpack(data: bytes) -> pa.RecordBatch:
    """The rows of a unit as one batch."""
    with pa.ipc.open_stream(pa.py_buffer(data)) as reader:
        return reader.read_all().combine_chunks().to_batches()[0]


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes."""
    raw = b"".join(struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)) + a.tobytes() for a in arrays)
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def expand(load: bytes) -> list[np.ndarray]:
    raw = pa.decompress(load[8:], struct.unpack("<q", load[:8])[0], codec="zstd", asbytes=True)
    found, at = [], 0
    while at < len(raw):
        kind, n = struct.unpack_from("<2sq", raw, at)
        kind = np.dtype("<" + kind.decode())
        found.append(np.frombuffer(raw, kind, n, at + 10))
        at += 10 + n * kind.itemsize
    return found


def squeeze_sorted(keys: np.ndarray, *arrays: np.ndarray) -> bytes:
    """Ascending 64-bit keys: the upper halves as runs, the lower ones as they are; other arrays after them."""
    high, counts = np.unique((keys >> np.uint64(32)).astype(np.uint32), return_counts=True)
    return squeeze(high, counts.astype(np.uint32), keys.astype(np.uint32), *arrays)


def expand_sorted(load: bytes) -> list[np.ndarray]:
    high, counts, low, *rest = expand(load)
    return [np.repeat(high.astype(np.uint64), counts) << np.uint64(32) | low, *rest]


def buckets_of(keys: np.ndarray, bits: int, count: int) -> np.ndarray:
    """Where each of `count` even ranges of ascending `bits`-bit keys begins and ends: count + 1 positions."""
    edges = [(i << bits) // count for i in range(1, count)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, dtype=np.uint64)), [len(keys)]))


def bucket_count(spark: SparkSession) -> int:
    """Four to a shuffle partition, so that one bucket's share falls as the cluster's setting rises."""
    return 4 * shuffle_width(spark)


def ask(units: DataFrame, question: Callable[[pa.RecordBatch, dict, int], Iterator[tuple[int, bytes]]],
        answer: Callable[[list[bytes]], list[bytes | None]], extra: list[str] | None = None) -> DataFrame:
    """(unit, answers): for every unit, what the buckets answered to its question, as (bucket, load) entries.

    `question(rows, columns, buckets)` yields (bucket, load) for one unit; `columns` has further columns of `units`
    named in `extra`. `answer(loads)` gets all loads of a bucket and returns an answer, or None, for each.
    """
    count, extra = bucket_count(units.sparkSession), extra or []

    def outgoing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                found = list(question(unpack(row["data"]), row, count))
                if found:
                    yield pa.RecordBatch.from_pydict({
                        "bucket": pa.array([b for b, _ in found], pa.int32()),
                        "unit": pa.array([row["unit"]] * len(found), pa.int64()),
                        "load": pa.array([x for _, x in found], pa.binary())})

    def returning(group: pa.Table) -> pa.Table:
        found = answer(group["load"].to_pylist())
        group = group.select(["bucket", "unit"]).append_column("load", pa.array(found, pa.binary()))
        return group.filter(pa.compute.is_valid(group["load"])).cast(
            pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("load", pa.binary())]))

    asked = units.select("unit", "data", *extra).mapInArrow(outgoing, QUESTION)
    replies = asked.groupBy("bucket").applyInArrow(returning, ANSWER)
    return replies.groupBy("unit").agg(F.collect_list(F.struct("bucket", "load")).alias("answers"))


def one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one in Python at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def by_bucket(answers: list[dict] | None) -> dict[int, bytes]:
    return {a["bucket"]: a["load"] for a in answers or []}
