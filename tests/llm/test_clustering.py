import hashlib

import numpy as np
import pytest

from sharescope.llm.clustering import Simplex, clustered, possible, squared

from .cases import with_clashes

SHAPE = "vec_id long, embedding array<double>"


def brute(rows, count, rounds, seed, scale, dims):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x * scale) < 1 << 27 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centroids = [v for _, v in order[:count]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        where = [place(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), w in zip(kept, where) if w == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *place(v)) for i, v in kept]
    total = sum(d for _, d, _ in last)
    return sorted(((i, j, d, sum(e for _, e, k in last if k == j), total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in last), key=str)


def answer(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.mark.parametrize("dims,count", [(5, 3), (1, 4), (12, 8)])
def test_same_as_brute_force(spark, dims, count):
    rng = np.random.default_rng(dims)
    middle = rng.standard_normal((4, dims))
    rows = [(i, (middle[i % 4] + rng.standard_normal(dims) * 0.5).tolist()) for i in range(150)]
    rows += [rows[3], rows[3], (3, rows[8][1]), (None, rows[5][1]), (900, None), (901, []), (902, [1.0] * (dims + 1)), (903, [None] + [1.0] * (dims - 1)), (904, [float("nan")] * dims),
             (905, [float("inf")] + [0.0] * (dims - 1)), (906, [1e30] * dims), *((1000 + i, rows[0][1]) for i in range(60))]
    vectors = with_clashes(spark.createDataFrame(rows, SHAPE), "cluster", "v", "apex")
    got = clustered(vectors, count=count, rounds=4, scale=64, dims=dims, renewed=(1, 3))
    assert answer(got) == brute(rows, count, 4, 3, 64, dims)


def test_few_rows_and_none(spark):
    rows = [(1, [0.5, 1.0]), (2, [0.5, 1.0])]
    assert answer(clustered(spark.createDataFrame(rows, SHAPE), dims=2)) == brute(rows, 8, 10, 3, 1024, 2)
    assert clustered(spark.createDataFrame([], SHAPE)).collect() == [] and clustered(spark.createDataFrame([(1, None)], SHAPE)).collect() == []


@pytest.mark.parametrize("size", [10, 1 << 10, 1 << 26])
def test_bounds_hold_at_any_size_and_for_flat_simplexes(size):
    rng = np.random.default_rng(size)
    for dims, pivots in ((2, 8), (16, 5), (64, 16)):
        points = rng.integers(-size, size, (pivots, dims))
        points[-1] = points[0]
        points[-2] = (points[0] + points[1]) // 2
        base = Simplex(points)
        vectors = np.concatenate([rng.integers(-size, size, (200, dims)), points, points + 1])
        centroids = np.concatenate([points[:3], vectors[:5]])
        true = squared(vectors, centroids)
        may = possible(*base.apexes(squared(vectors, base.pivots).astype(float)), *base.apexes(squared(centroids, base.pivots).astype(float)))
        assert may[np.arange(len(vectors)), true.argmin(axis=1)].all() and (true.min(axis=1)[:, None] != true)[~may].all()
        assert base.width < pivots


def test_bounds_pass_over_most_centroids_that_pivots_span():
    rng = np.random.default_rng(1)
    middle = rng.integers(-500, 500, (8, 64))
    vectors = middle[rng.integers(0, 8, 500)] + rng.integers(-150, 150, (500, 64))
    base = Simplex(middle)
    centroids = middle + rng.integers(-10, 10, (8, 64))
    assert possible(*base.apexes(squared(vectors, base.pivots).astype(float)), *base.apexes(squared(centroids, base.pivots).astype(float))).sum(axis=1).mean() < 2
