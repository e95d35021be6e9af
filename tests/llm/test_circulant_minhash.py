import random

import numpy as np
import pyarrow as pa
import pytest

from sharescope.llm import circulant_minhash
from sharescope.llm.circulant_minhash import BANDS, bands_of, near_duplicates, sets, signatures

from .cases import awkward, frame, prose, with_clashes, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, similar=85):
    own = [(r[0], shingles(r[1])) for r in rows]
    distinct = list({frozenset(s) for _, s in own if s})
    part = list(range(len(distinct)))
    for a in range(len(distinct)):
        for b in range(a):
            common = len(distinct[a] & distinct[b])
            if 100 * common >= similar * (len(distinct[a]) + len(distinct[b]) - common) and part[a] != part[b]:
                old, new = part[a], part[b]
                part = [new if p == old else p for p in part]
    where = {s: p for s, p in zip(distinct, part)}
    first = {}
    for i, s in own:
        if s and i is not None:
            p = where[frozenset(s)]
            first[p] = min(first.get(p, i), i)
    out = []
    for i, s in own:
        c = first.get(where[frozenset(s)]) if s else i
        out.append((i, len(s), c, i is not None and i == c))
    return sorted(out, key=str)


def answer(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def changed(text, seed, share):
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(10 ** 6)}" if pick.random() < share else w for w in text.split(" "))


@pytest.mark.parametrize("members", [512, 3])
def test_same_as_brute_force(spark, members, monkeypatch):
    monkeypatch.setattr(circulant_minhash, "MEMBERS", members)
    monkeypatch.setattr(circulant_minhash, "CELL_ROWS", 2 * members)
    base = prose(20, 400)
    rows = awkward() + [(100 + i, changed(base, i, 0.012), "en", "web", 1) for i in range(40)]
    rows += [(200 + i, " ".join(f"c{j}" for j in range(i * 6, i * 6 + 200)), "en", "web", 1) for i in range(12)]  # a chain whose ends share nothing
    rows += [(300 + i, changed(base, 100 + i, 0.03), "en", "web", 1) for i in range(30)]  # close, but most not close enough
    docs = with_clashes(frame(spark, rows), "component_id", "kept", "key", "node", "h")
    assert answer(near_duplicates(docs)) == brute(rows)


def test_large_groups_that_hubs_do_not_reach(spark):
    base = prose(21, 120)
    rows = [(i, changed(base, i, 0.02), "en", "web", 1) for i in range(150)]
    assert answer(near_duplicates(frame(spark, rows))) == brute(rows)


def test_empty_and_single(spark):
    assert answer(near_duplicates(frame(spark, []))) == []
    rows = [(1, None, None, None, None), (2, "", None, None, None), (3, "a b", None, None, None), (4, "A  b", None, None, None)]
    assert answer(near_duplicates(frame(spark, rows))) == brute(rows)


def test_coordinates_agree_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    agree, bands = [], []
    for seed in range(60):
        a = prose(seed + 1000, 300).split()
        b = list(a)
        for at in rng.choice(300, 8, replace=False):
            b[at] = f"x{at}"
        left, right = " ".join(a), " ".join(b)
        hashes, bounds = sets(pa.array([left, right]))
        both = signatures(hashes, bounds)
        one, two = shingles(left), shingles(right)
        assert np.diff(bounds).tolist() == [len(one), len(two)]
        agree.append((both[0] == both[1]).mean() - len(one & two) / len(one | two))
        bands.append((bands_of(both)[0] == bands_of(both)[1]).sum())
    assert abs(np.mean(agree)) < 0.02 and min(bands) > BANDS // 40
