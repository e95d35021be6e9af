from sharescope.llm.decontamination import contained

from .cases import awkward, frame, prose, with_clashes


def shingles(text):
    w = [x for x in (text or "").lower().replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_same_as_brute_force(spark):
    rows = awkward()
    long = prose(7, 9000).split()
    items = [(0, " ".join(long[4000:4030])), (1, " ".join(long[10:70]).upper()), (2, " ".join([*long[100:140], "other", *prose(9, 6).split()])), (3, ""), (4, None), (5, "one two"),
             (6, prose(1, 60)), (6, prose(1, 60)), (7, prose(99, 20)), (None, prose(2, 34))]
    want = {(r[0], i, len(shingles(r[1]) & shingles(t)), len(shingles(t))) for r in rows for i, t in items if shingles(t) and len(shingles(r[1]) & shingles(t)) >= 0.8 * len(shingles(t))}
    docs = with_clashes(frame(spark, rows), "h", "owner", "n_shared")
    got = contained(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in got} == want and len(got) == len(want)
    assert {0, 1, 2, 5, 6} <= {i for _, i, *_ in want}


def test_any_threshold_and_size(spark):
    texts = [prose(s, 40 + 7 * s) for s in range(12)]
    docs = [(i, texts[i][: len(texts[i]) * 2 // 3] + " " + texts[(i + 1) % 12], None, None, None) for i in range(12)]
    items = [(i, t) for i, t in enumerate(texts)]
    for threshold in (0.3, 0.6, 1.0):
        want = {(r[0], i) for r in docs for i, t in items if len(shingles(r[1]) & shingles(t)) >= threshold * len(shingles(t)) - 1e-9}
        got = contained(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), threshold=threshold).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want


def test_empty(spark):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contained(frame(spark, []), items).collect() == [] and contained(frame(spark, awkward()), items.limit(0)).collect() == []
