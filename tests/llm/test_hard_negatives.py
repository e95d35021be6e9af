import numpy as np
import pytest

from sharescope.llm import hard_negatives
from sharescope.llm.hard_negatives import Anchor, encode, mined

from .cases import with_clashes

SHAPE = "vec_id long, embedding array<double>, label int"


def brute(rows, step=100, positives=5, negatives=10):
    dims = max((len(v) for i, v, k in rows if i is not None and k is not None and v is not None), default=0)
    kept = set()
    for i, v, k in rows:
        if i is not None and v is not None and k is not None and all(x is not None and np.isfinite(x) and abs(x) < 1 << 20 for x in v):
            kept.add((i, (k + 1) % 10 if i % 7 == 0 else k, tuple(int(np.floor(256 * x)) for x in v) + (0,) * (dims - len(v))))
    out = set()
    for a, label, v in kept:
        if a % step == 0:
            scored = [(-sum(x * y for x, y in zip(v, w)), i, k) for i, k, w in kept]
            same = sorted({(s, i) for s, i, k in scored if k == label and i != a})[:positives]
            for p, positive in same:
                fits = sorted({(s, i) for s, i, k in scored if k != label and 30 * -p <= 100 * -s <= 90 * -p})[:negatives]
                out |= {(a, positive, r + 1, i, -p, -s) for r, (s, i) in enumerate(fits)}
    return out


def answer(df):
    got = [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(got) == len(set(got))
    return set(got)


def points(seed, n, dims):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((3, dims)) / np.sqrt(dims)
    return [(i, (middle[i % 3] + rng.standard_normal(dims) / np.sqrt(dims) * 0.8).tolist(), int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("dims", [64, 7])
def test_same_as_brute_force(spark, dims, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 6)
    monkeypatch.setattr(hard_negatives, "ROWS", 100)
    rows = points(dims, 400, dims)
    rows += [rows[0], rows[0], (0, rows[5][1], rows[0][2]), (50, rows[7][1], 2), *((2000 + i, rows[1][1], 1) for i in range(150)), *((3000 + i, rows[1][1], 2) for i in range(150)),
             (None, rows[3][1], 1), (450, None, 1), (550, rows[3][1], None), (650, [None] * dims, 1), (750, [float("nan")] * dims, 1), (850, [float("inf")] + [0.0] * (dims - 1), 1),
             (950, [1e300] * dims, 1), (1050, rows[3][1][:3], 1), (1150, [], 2), (1250, [0.0] * dims, 1), (1350, [-x for x in rows[4][1]], 1)]
    vectors = with_clashes(spark.createDataFrame(rows, SHAPE), "anchor", "score", "rank", "cell")
    assert answer(mined(vectors, step=50)) == brute(rows, step=50)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 2), (2, [1.0, 0.2], 1), (3, [0.5, 0.5], 2)]
    assert answer(mined(spark.createDataFrame(rows, SHAPE))) == brute(rows)
    assert answer(mined(spark.createDataFrame(rows[:1], SHAPE))) == set() and answer(mined(spark.createDataFrame([], SHAPE))) == set()


@pytest.mark.parametrize("size", [1, 200, 1 << 27])
def test_intervals_hold_every_score_and_part_with_the_far(size):
    rng = np.random.default_rng(size)
    values = rng.integers(-size, size + 1, (800, 64)) // 2
    values[:100] = values[0] + rng.integers(-1, 2, (100, 64)) * (size // 8)
    values[100] = 0
    codes, facts = encode(values)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    for q in values[[0, 50, 100, 300]]:
        low, high = Anchor(q).interval(np.ascontiguousarray(codes.T), ones, np.ascontiguousarray(facts.T))
        true = values @ q
        assert (low <= true).all() and (true <= high).all()
    low, high = Anchor(values[0]).interval(np.ascontiguousarray(codes.T), ones, np.ascontiguousarray(facts.T))
    if size > 1:
        assert (high[101:] < low[:50].min()).mean() > 0.5
