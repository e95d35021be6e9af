"""Centroid clustering of integer vectors, with N-simplex projection to pass over centroids that can't be nearest.

The distances of a vector to `m` pivots are computed once and kept. They fix the vector as the apex of a simplex above the
pivots: `m - 1` coordinates in the space the pivots span, and the height above it. Centroids are projected alike. For two apexes
the Euclidean distance is at most the true one, and with the second height turned to the other side of the base it is at least the true one.
A centroid whose lower bound is above the smallest upper bound can't be nearest; the others are compared in integers, so the bounds
decide what is computed and never what comes out. Bounds are widened by what floating point may have lost, which is
estimated for every vector from the residuals of its own coordinates.

Bounds are tight where centroids lie near the space of the pivots. So pivots are taken from the centroids themselves, those of a
round and of the one before, whose difference shows where they are moving; after the rounds in `RENEWED` they are
taken anew and distances cached anew.

Every round is one pass over stored rows without any exchange of them: a task sums its vectors for each cluster, and Spark adds up these sums.
What the driver holds is the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
RENEWED = (1, 3, 6)
LIMIT = 1 << 27
FLAT = 0.05
UNIT = float(np.finfo(np.float64).eps)


def integers(lists: pa.Array, dims: int, scale: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a column, and floor(scale * x) of their components, a row each."""
    sizes = np.asarray(pc.list_value_length(lists).fill_null(-1))
    some = lists.filter(pa.array(sizes == dims))
    values = np.asarray(some.flatten().cast(pa.float64()).fill_null(np.nan), dtype=np.float64).reshape(-1, dims)
    with np.errstate(all="ignore"):
        scaled = np.floor(values * scale)
        good = (np.abs(scaled) < limit).all(axis=1)
    return np.flatnonzero(sizes == dims)[good], scaled[good].astype(np.int32)


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as one binary value each."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(rows.tobytes())])


def unpacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The matrix of a column of equally long binary values."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]].view(kind).reshape(len(column), width)


def squared(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every point."""
    wide = vectors.astype(np.int64)
    return np.stack([((wide - p) ** 2).sum(axis=1) for p in points], axis=1)


class Simplex:
    """A base simplex of pivots, and apexes above it from squared distances alone.

    A pivot whose height above those before it is under `FLAT` of its distance to the first adds nothing and is left out.
    """

    def __init__(self, pivots: np.ndarray):
        kept, rows = [pivots[0]], np.zeros((0, 0))
        self._take(kept, rows)
        for pivot in pivots[1:]:
            d2 = squared(pivot[None], np.array(kept)).astype(np.float64)
            apex = self.apexes(d2)[0][0]
            if apex[-1] > FLAT * np.sqrt(d2[0, 0]):
                kept.append(pivot)
                rows = np.pad(rows, ((0, 1), (0, 1)))
                rows[-1] = apex
                self._take(kept, rows)

    def _take(self, kept: list[np.ndarray], rows: np.ndarray) -> None:
        self.pivots, self.rows, self.width = np.array(kept), rows, len(kept)
        gaps = squared(self.pivots, self.pivots).astype(np.float64)
        self.reach = gaps[0, 1:]
        exact = (self.reach[:, None] + self.reach[None] - gaps[1:, 1:]) / 2
        size = np.linalg.norm(rows)
        self.inverse = np.linalg.norm(np.linalg.inv(rows)) if len(rows) else 0.0
        # How far the base itself may be off, from what its own inner products miss.
        missed = np.linalg.norm(rows @ rows.T - exact) + (self.width + 4) * UNIT * size ** 2
        self.off = size * self.inverse ** 2 * missed

    def apexes(self, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates with the height last, and how far they may be from the true ones."""
        goal = (d2[:, :1] - d2[:, 1:] + self.reach) / 2
        x = np.zeros((len(d2), self.width))
        for i in range(self.width - 1):
            x[:, i] = (goal[:, i] - x[:, :i] @ self.rows[i, :i]) / self.rows[i, i]
        flat = x[:, :-1]
        length = np.sqrt((flat ** 2).sum(axis=1))
        rounding = (self.width + 8) * UNIT * (np.abs(flat) @ np.abs(self.rows).T + d2[:, :1] + d2[:, 1:] + self.reach)
        residual = np.sqrt(((np.abs(goal - flat @ self.rows.T) + rounding) ** 2).sum(axis=1))
        slack = 2 * self.inverse * (residual + self.off * length)
        height2 = d2[:, 0] - length ** 2
        x[:, -1] = np.sqrt(np.maximum(height2, 0))
        loose = 2 * length * slack + slack ** 2 + (self.width + 8) * UNIT * (d2[:, 0] + length ** 2) + np.maximum(-height2, 0)
        return x, slack + np.sqrt(loose) if not len(self.rows) else slack + np.where(x[:, -1] > 0, np.minimum(np.sqrt(loose), loose / np.maximum(x[:, -1], 1e-300)), np.sqrt(loose))


def possible(x: np.ndarray, x_slack: np.ndarray, y: np.ndarray, y_slack: np.ndarray) -> np.ndarray:
    """Which centroids `y` may be nearest to which vectors `x`, both as apexes."""
    flat = ((x[:, None, :-1] - y[None, :, :-1]) ** 2).sum(axis=2)
    slack = x_slack[:, None] + y_slack[None]
    lower = np.sqrt(flat + (x[:, None, -1] - y[None, :, -1]) ** 2) * (1 - 64 * UNIT) - slack
    upper = np.sqrt(flat + (x[:, None, -1] + y[None, :, -1]) ** 2) * (1 + 64 * UNIT) + slack
    return lower <= upper.min(axis=1)[:, None]


def assigned(vectors: np.ndarray, may: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact squared distance of the nearest centroid, the smaller number on ties."""
    best = np.full(len(vectors), np.iinfo(np.int64).max)
    nearest = np.zeros(len(vectors), dtype=np.int32)
    for j, centroid in enumerate(centroids):
        rows = np.flatnonzero(may[:, j])
        d2 = squared(vectors[rows], centroid[None])[:, 0]
        better = d2 < best[rows]
        best[rows[better]], nearest[rows[better]] = d2[better], j
    return nearest, best


def prepared(vectors: DataFrame, vec_id: str, embedding: str, dims: int, scale: int, limit: int) -> DataFrame:
    """(vec_id, v): usable vectors in 32-bit integers."""
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = integers(batch.column(1), dims, scale, limit)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), packed(values)], ["vec_id", "v"])

    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).mapInArrow(take, "vec_id long, v binary")


def first_centroids(rows: DataFrame, count: int, seed: int, dims: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes; of equal hashes the smaller vector first, and rows without an id last."""
    ranked = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(count)
    return np.array([np.frombuffer(r["v"], "<i4") for r in ranked.collect()], dtype=np.int64).reshape(-1, dims)


def cached(rows: DataFrame, base: Simplex, dims: int) -> DataFrame:
    """(vec_id, v, apex): the rows with their coordinates above the base, and the slack of these."""
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, slack = base.apexes(squared(unpacked(batch.column(1), "<i4", dims), base.pivots).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed(np.column_stack([x, slack]))], ["vec_id", "v", "apex"])

    return store(rows.select("vec_id", "v").mapInArrow(project, "vec_id long, v binary, apex binary"))


def nearest(batch: pa.RecordBatch, base: Simplex, centroids: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, clusters, squared distances and number of centroids compared, for a batch of (v, apex)."""
    values, apex = unpacked(batch.column(0), "<i4", dims), unpacked(batch.column(1), "<f8", base.width + 1)
    y, y_slack = base.apexes(squared(centroids, base.pivots).astype(np.float64))
    may = possible(apex[:, :-1], apex[:, -1], y, y_slack)
    return values, *assigned(values, may, centroids), may.sum(axis=1)


def moved(rows: DataFrame, base: Simplex, centroids: np.ndarray, dims: int) -> np.ndarray:
    """Centroids after one round: componentwise floor of the mean, and as before where a cluster is empty."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(centroids), dims), dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            values, cluster, _, _ = nearest(batch, base, centroids, dims)
            for j in np.unique(cluster).tolist():
                mine = values[cluster == j]
                sums[j] += mine.sum(axis=0, dtype=np.int64)
                counts[j] += len(mine)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(len(centroids)), pa.int32()), "n": pa.array(counts), "sums": pa.array(sums.tolist(), pa.list_(pa.int64()))})

    parts = rows.select("v", "apex").mapInArrow(add, "cluster int, n long, sums array<long>")
    totals = [F.sum(F.get("sums", i).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    after = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():
        if r["n"]:
            after[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    return after


def clustered(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED,
              scale: int = SCALE, dims: int = DIMS, renewed: tuple[int, ...] = RENEWED) -> DataFrame:
    """(vec_id, cluster, distance, n_compared, cluster_inertia, inertia, centroid_sha256) for every usable vector.

    Used are vectors of exactly `dims` components, none of them null or not finite. A component of 131,072 or more in size
    leaves its vector out too, as squared distances would not fit a long. Every row is a vector: rows that are repeated or share an id count each. A row
    without an id is clustered like others, but starts a centroid only if there are too few others. Fewer vectors than `count` start
    fewer centroids. Further columns are left out. An empty table, or one without usable vectors, gives no rows. `n_compared` tells how many
    centroids the bounds left to compare.
    """
    spark = vectors.sparkSession
    rows = store(prepared(vectors, vec_id, embedding, dims, scale, LIMIT))
    centroids = before = first_centroids(rows, count, seed, dims)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, n_compared int, cluster_inertia long, inertia long, centroid_sha256 string")
    base = Simplex(centroids)
    above = cached(rows, base, dims)
    for number in range(rounds):
        if number in renewed:
            base = Simplex(np.concatenate([centroids, before]))
            above = cached(rows, base, dims)
        before, centroids = centroids, moved(above, base, centroids, dims)
    last = centroids

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cluster, distance, compared = nearest(batch.select(["v", "apex"]), base, last, dims)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(compared, pa.int32())], ["vec_id", "cluster", "distance", "n_compared"])

    settled = store(above.mapInArrow(settle, "vec_id long, cluster int, distance long, n_compared int"))
    return settled.join(F.broadcast(described(spark, settled, last)), "cluster").select(
        "vec_id", "cluster", "distance", "n_compared", "cluster_inertia", "inertia", "centroid_sha256")


def described(spark: SparkSession, settled: DataFrame, centroids: np.ndarray) -> DataFrame:
    """One row a cluster: its inertia, that of all, and its centroid's hash."""
    inertia = {r["cluster"]: int(r["s"]) for r in settled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = sum(inertia.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return spark.createDataFrame([(j, n, whole, names[j]) for j, n in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")


def clustering_digest(vectors: DataFrame) -> DataFrame:
    """What the registered query returns of `clustered`."""
    return clustered(vectors).drop("n_compared")
