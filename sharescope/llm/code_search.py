"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into four segments of 16 bits, each with an index from value to codes. In round r, every query still open
looks up all values at distance r of its four segments. By the pigeonhole principle a code whose distance is at most
4 (r + 1) - 1 has a segment within r, so after round r all of them were seen, and a query is closed once its k-th
verified distance is within that. Results are exact for any data; only the number of rounds depends on it.

Equal codes are one entry with its k smallest ids, so a vector that very many rows share is found once. Lookups and index entries are
dealt by segment value to buckets, and a value that over a sixty-fourth of an index shares (there are at most 64) is
dealt over several. In a bucket, a query's candidates are verified together, and what leaves is its best k there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, store

SEGMENTS, WIDTH, K, QUERY_STEP = 4, 16, 10, 100
SPREAD = 16


def coded(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, code): the signs of the first 64 numbers, or, of a longer vector, of 64 fixed random projections.

    Null and empty vectors have no code; numbers that are null count as zero.
    """
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(1)
            values = np.nan_to_num(np.asarray(lists.flatten().cast(pa.float64()), dtype=np.float64))
            sizes = np.asarray(pa.compute.list_value_length(lists))
            codes = np.zeros(len(lists), dtype=np.uint64)
            starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            for n in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == n)
                block = values[starts[rows][:, None] + np.arange(n)]
                if n > 64:
                    block = block @ planes.setdefault(n, np.random.default_rng(n).standard_normal((n, 64)))
                codes[rows] = ((block > 0).astype(np.uint64) << np.arange(block.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64), pa.int64())], ["vec_id", "code"])

    known = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e")).filter("vec_id IS NOT NULL AND size(e) > 0")
    return known.mapInArrow(sign, "vec_id long, code long")


def values_of(codes: np.ndarray) -> np.ndarray:
    """Segment number and value, as one number, for the four segments of each code."""
    return np.stack([((codes >> np.uint64(WIDTH * s)) & np.uint64(0xFFFF)) + np.uint64(s << WIDTH) for s in range(SEGMENTS)], axis=1).astype(np.int64)


def masks(radius: int) -> np.ndarray:
    """All values of a segment with `radius` bits set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(WIDTH), radius)], dtype=np.int64)


def deal(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def best(query: np.ndarray, ids: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best distinct ids of every query, by distance and id."""
    if not len(query):
        return np.empty(0, np.int64)
    order = np.lexsort((ids, distance, query))
    q, i, d = query[order], ids[order], distance[order]
    new = np.concatenate(([True], (q[1:] != q[:-1]) | (i[1:] != i[:-1]) | (d[1:] != d[:-1])))
    order, q = order[new], q[new]
    starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(q)]))))
    return order[rank < k]


FOUND = "query_id long, query_code long, vec_id long, distance int"
_FOUND = pa.schema([("query_id", pa.int64()), ("query_code", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.int32())])


def nearest(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, query_step: int = QUERY_STEP) -> DataFrame:
    """(query_id, rank, vec_id, distance): for every row whose id is divisible by `query_step`, the k rows nearest in Hamming distance.

    Ties go to the smaller id. The query itself is a row like any other. With fewer than k rows all are returned. Rows without
    an id or numbers are no rows; a repeated row counts once, and rows that share an id but not a code count as
    the nearest of them. An empty table has no queries.
    """
    spark = vectors.sparkSession
    rows = store(coded(vectors, vec_id, embedding))
    total = rows.select("vec_id").distinct().count()
    enough = min(k, total)
    ranked = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    few = rows.distinct().withColumn("n", ranked).filter(F.col("n") <= k)
    entries = store(few.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    distinct = entries.count()
    queries = store(rows.filter(F.col("vec_id") % query_step == 0).select(F.col("vec_id").alias("query_id"), F.col("code").alias("query_code")).distinct())
    buckets = 2 * shuffle_width(spark)

    segments = F.explode(F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda s: (F.lit(1 << WIDTH) * s + F.call_function("shiftrightunsigned", F.col("code"), s * WIDTH).bitwiseAND(F.lit(0xFFFF))).cast("int")))
    counts = entries.select(segments.alias("value")).groupBy("value").count().filter(F.col("count") > max(distinct // 64, 4096))
    hot = np.array(sorted(r["value"] for r in counts.collect()), dtype=np.int64)  # at most 64 for each segment

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.asarray(batch.column(0)).view(np.uint64)
            values = values_of(codes).ravel()
            part = np.where(np.isin(values, hot), deal(np.repeat(codes.view(np.int64), SEGMENTS), SPREAD), 0)
            taken = pa.array(np.repeat(np.arange(len(codes)), SEGMENTS))
            yield pa.RecordBatch.from_arrays([pa.array(deal(values + (part << 20), buckets), pa.int32()), pa.array(values, pa.int32()), batch.column(0).take(taken), batch.column(1).take(taken)],
                                             ["bucket", "value", "code", "ids"])

    indexed = store(entries.mapInArrow(index, "bucket int, value int, code long, ids array<long>"))

    def lookups(radius: int):
        flips = masks(radius)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    ids, codes = (np.asarray(batch.column(c).slice(at, 64)) for c in (0, 1))
                    values = values_of(codes.view(np.uint64))[:, :, None]
                    values = ((values & ~0xFFFF) + ((values & 0xFFFF) ^ flips)).ravel()
                    query = np.repeat(np.arange(len(ids)), SEGMENTS * len(flips))
                    is_hot = np.isin(values, hot)
                    bucket = np.concatenate([deal(values, buckets), *(deal(values[is_hot] + (p << 20), buckets) for p in range(1, SPREAD))])
                    values, query = (np.concatenate([x, *[x[is_hot]] * (SPREAD - 1)]) for x in (values, query))
                    order = np.argsort(bucket, kind="stable")
                    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                    full = np.flatnonzero(np.diff(ends))
                    parts = [order[ends[b]:ends[b + 1]] for b in full]
                    yield pa.RecordBatch.from_pydict({
                        "bucket": pa.array(full, pa.int32()),
                        "values": pa.array([values[p].astype("<i4").tobytes() for p in parts], pa.binary()), "queries": pa.array([query[p].astype("<i4").tobytes() for p in parts], pa.binary()),
                        "ids": pa.array([ids.tobytes()] * len(parts), pa.binary()), "codes": pa.array([codes.tobytes()] * len(parts), pa.binary())})

        return look

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("value").combine_chunks()
        have, codes = right["value"].to_numpy(), right["code"].to_numpy().view(np.uint64)
        lists = right["ids"].combine_chunks() if right.num_rows else pa.array([], pa.list_(pa.int64()))
        begin, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        found = []
        for row in left.to_pylist():
            values, query = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("values", "queries"))
            ids, own = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["codes"], np.uint64)
            low, high = np.searchsorted(have, values), np.searchsorted(have, values, side="right")
            count = high - low
            ends = np.cumsum(count)
            at = np.repeat(low - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
            who = np.repeat(query, count)
            distance = np.bitwise_count(own[who] ^ codes[at]).astype(np.int32)
            each = begin[at + 1] - begin[at]
            over = np.cumsum(each)
            vec = flat[np.repeat(begin[at] - (over - each), each) + np.arange(over[-1] if len(over) else 0)]
            who, distance = np.repeat(who, each), np.repeat(distance, each)
            top = best(who, vec, distance, k)
            found.append(pa.table([pa.array(ids[who[top]]), pa.array(own[who[top]].view(np.int64)), pa.array(vec[top]), pa.array(distance[top], pa.int32())], schema=_FOUND))
        return pa.concat_tables(found) if found else _FOUND.empty_table()

    order = [F.col("distance"), F.col("vec_id")]
    held, open_, done, radius = None, queries, None, 0
    while not open_.isEmpty():
        asked = open_.mapInArrow(lookups(radius), "bucket int, values binary, queries binary, ids binary, codes binary")
        seen = asked.groupBy("bucket").cogroup(indexed.groupBy("bucket")).applyInArrow(verify, FOUND)
        if held is not None:
            seen = seen.unionByName(held)
        near = seen.groupBy("query_id", "vec_id").agg(F.min(F.struct("distance", "query_code")).alias("m")).select("query_id", "m.query_code", "vec_id", "m.distance")
        held = store(near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k).drop("rank"))
        covered = SEGMENTS * (radius + 1) - 1
        closed = held.filter(F.col("distance") <= covered).groupBy("query_id").count().filter(F.col("count") >= enough).select("query_id")
        finished = store(held.join(closed, "query_id", "left_semi"))
        done = finished if done is None else done.unionByName(finished)
        open_ = store(open_.join(closed, "query_id", "left_anti"))
        held = held.join(closed, "query_id", "left_anti")
        radius += 1
    if done is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance int")
    return done.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("rank"), "vec_id", "distance")
