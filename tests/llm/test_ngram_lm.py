import math
import zlib
from collections import Counter

from sharescope.llm.ngram_lm import scored

from .cases import awkward, frame, prose, with_clashes, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_base_and_counts_are_brute_force_and_the_model_does_better(spark):
    rows = [*awkward(), *((100 + i, prose(i % 40, 80), "en", "web", 0) for i in range(300))]
    tokens = [[*words((r[1] or "").translate(LOWER)), None] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    count = Counter(t for ts, h in zip(tokens, held) if not h for t in ts)
    n, v = sum(count.values()), len(count)
    want = sorted(((r[0], h, len(ts), sum(count[t] > 0 for t in ts), n, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts), 6)) for r, ts, h in zip(rows, tokens, held)), key=str)
    got = scored(with_clashes(frame(spark, rows), "score")).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == want
    test = [r for r in got if r["held_out"] and r["doc_id"] >= 100]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)


def test_empty_and_nothing_to_train(spark):
    assert scored(frame(spark, [])).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = scored(frame(spark, [(only, "a b", None, None, None)])).collect()[0]
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 3, 0, 0, 0.0)
