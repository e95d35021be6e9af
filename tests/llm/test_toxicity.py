import random
import zlib

import pytest

from sharescope.llm.toxicity import score, toxicity_digest, train

from .cases import frame, with_clashes

INSULTS = ["dolthead", "nitwit", "scumbag"]


def corpus(n, seed=0):
    pick = random.Random(seed)
    syllables = ["ba", "ko", "lin", "tra", "mo", "ser", "pal", "du", "fen", "gor"]
    rows, labels = [], []
    for i in range(n):
        text = [pick.choice(syllables) + pick.choice(syllables) + pick.choice(syllables) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            text[pick.randrange(30)] = pick.choice(INSULTS) + pick.choice(["", ".", "!"])
        rows.append((i, " ".join(text), "en", "web", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def machine(spark):
    rows, labels = corpus(600)
    return train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus(600)
    got = toxicity_digest(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {r["doc_id"] for r in got if r["held_out"]} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1}
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] != int(r["doc_id"] % 5 == 0) for r in held) <= len(held) // 50
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_gaps_and_inserted_characters_are_tolerated(spark, machine):
    odd = ["you n.i.t.w.i.t", "you nit-wit", "you nittwit", "you dolthhead", "a s c u m b a g here", "DOLTHEAD"]
    clean = ["", None, "bakolin tramo", "...", "k" * 5000, "bakolin " * 3000]
    rows = [(i, t, None, None, None) for i, t in enumerate(odd + clean)]
    got = {r["doc_id"]: r["predicted"] for r in score(with_clashes(frame(spark, rows), "score"), machine).collect()}
    assert got == {i: int(i < len(odd)) for i in range(len(rows))}


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows, _ = corpus(5)
    assert {r["predicted"] for r in toxicity_digest(frame(spark, rows), none).collect()} == {0}
    assert toxicity_digest(frame(spark, []), none).collect() == []
    only = spark.createDataFrame([(1, None, 1), (None, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity_digest(frame(spark, rows), only).collect()} == {0}
