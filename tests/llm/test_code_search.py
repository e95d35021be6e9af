import numpy as np

from sharescope.llm.code_search import nearest

from .cases import with_clashes


def brute(rows, k, step):
    codes = {}
    for i, v in rows:
        if i is not None and v:
            codes.setdefault(i, set()).add(sum(1 << b for b, x in enumerate(v[:64]) if x is not None and x > 0))
    found = set()
    for q in codes:
        if q % step == 0:
            near = sorted((min((a ^ b).bit_count() for a in codes[q] for b in c), i) for i, c in codes.items())[:k]
            found |= {(q, r + 1, i, d) for r, (d, i) in enumerate(near)}
    return found


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((6, 64))
    rows = [(i, (centre[i % 6] + rng.standard_normal(64) * 0.4).tolist()) for i in range(300)]
    rows += [(1000 + i, centre[0].tolist()) for i in range(120)] + [(5, rows[6][1]), rows[10], (None, rows[0][1]), (400, None), (500, []), (600, [None, 1.0, float("nan")])]
    vectors = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "code", "rank")
    got = [tuple(r) for r in nearest(vectors, k=7, query_step=50).select("query_id", "rank", "vec_id", "distance").collect()]
    assert set(got) == brute(rows, 7, 50) and len(got) == len(set(got))


def test_few_rows_and_none(spark):
    shape = "vec_id long, embedding array<double>"
    rows = [(0, [1.0] * 4), (1, [-1.0] * 4)]
    assert {tuple(r) for r in nearest(spark.createDataFrame(rows, shape)).select("query_id", "rank", "vec_id", "distance").collect()} == {(0, 1, 0, 0), (0, 2, 1, 4)}
    assert nearest(spark.createDataFrame([], shape)).collect() == []
