import hashlib
from collections import Counter

from sharescope.llm.substring_dedup import removal_digest, remove_repeats

from .cases import awkward, frame, with_clashes, words


def brute(rows, window=35):
    texts = [words(r[1]) for r in rows]
    starts = Counter(tuple(t[i:i + window]) for t in texts for i in range(len(t) - window + 1))
    found = []
    for row, t in zip(rows, texts):
        gone = {j for i in range(len(t) - window + 1) if starts[tuple(t[i:i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(w for i, w in enumerate(t) if i not in gone)
        found.append((row[0], len(t), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(found, key=str)


def test_same_as_brute_force(spark):
    rows = awkward()
    got = [tuple(r) for r in removal_digest(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute(rows)


def test_small_windows_and_clashing_columns(spark):
    rows = [(1, "a b c d e f g"), (2, "x c d e f y"), (3, "c d e"), (4, None)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"), "kept", "N_WORDS")
    got = {r["doc_id"]: (r["kept"], r["n_removed"], r["extra one"]) for r in remove_repeats(docs, window=4).collect()}
    assert got == {1: ("a b g", 4, 1), 2: ("x y", 4, 1), 3: ("c d e", 0, 1), 4: ("", 0, 1)}


def test_empty(spark):
    assert removal_digest(frame(spark, [])).collect() == []
