import numpy as np
import xxhash

from sharescope.llm import golay
from sharescope.llm.components import components
from sharescope.llm.simhash import near_duplicates, near_links, one_of_each, run_links, simhash_digest, spread

from .cases import awkward, frame, with_clashes, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_parts(prints):
    part = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 3 and part[a] != part[b]:
                    part[a] = part[b] = min(part[a], part[b])
                    changed = True
    return part


def test_same_as_brute_force(spark):
    rows = awkward()
    prints = [fingerprint(r[1]) for r in rows]
    part = brute_parts(set(prints))
    first = {}
    for row, p in zip(rows, prints):
        if row[0] is not None:
            first[part[p]] = min(first.get(part[p], row[0]), row[0])
    want = sorted(((r[0], f"{p:016x}", first.get(part[p])) for r, p in zip(rows, prints)), key=str)
    assert sorted((tuple(r) for r in simhash_digest(frame(spark, rows)).collect()), key=str) == want


def test_no_link_within_three_bits_is_lost(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 63, 150, dtype=np.uint64)
    prints = list(base)
    for p in base:
        for bits in (1, 2, 3, 4):
            prints.append(p ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, bits, replace=False))))
    prints = [int(p) for p in {*prints}]
    part = brute_parts(set(prints))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    links = near_links(spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long"))
    found = {r["node"]: r["root"] for r in components(links).collect()}
    groups, want = {}, {}
    for p in prints:
        groups.setdefault(found.get(signed(p), signed(p)), set()).add(p)
        want.setdefault(part[p], set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_large_runs_give_the_same_parts(monkeypatch):
    rng = np.random.default_rng(6)
    prints = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)))
    part = brute_parts({int(p) for p in prints})
    a, b = spread(prints, 3)
    assert ((np.bitwise_count(prints[a] ^ prints[b])) <= 3).all() and len(a) == len(prints) - len(set(part.values()))
    key, probe = np.zeros(2 * len(prints), np.int64), np.repeat([False, True], len(prints))
    few = run_links(key, np.concatenate([prints, prints]), probe, 3)
    monkeypatch.setattr("sharescope.llm.simhash.PAIRS", 10)
    many = run_links(key, np.concatenate([prints, prints]), probe, 3)
    assert dict(zip(*few)) == dict(zip(*many))


def test_golay_code_is_perfect():
    index = golay.decode(np.arange(1 << 23))
    assert (np.bincount(index) == 2048).all()
    flat, count = golay.nearby(np.arange(200))
    assert set(count) <= {1, 6} and len(flat) == count.sum()


def test_chains_are_followed(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_one_stays_clashes_and_empty(spark):
    rows = awkward()
    docs = with_clashes(frame(spark, rows), "fingerprint")
    kept = one_of_each(with_clashes(docs, "_row", "_fingerprint", "root", "component_id")).collect()
    assert {(r["fingerprint"], r["_row"], r["_fingerprint"], r["root"], r["component_id"]) for r in kept} == {("mine",) * 5}
    part = brute_parts({fingerprint(r[1]) for r in rows})
    assert sorted(part[fingerprint(r["text"])] for r in kept) == sorted(set(part.values()))
    assert near_duplicates(docs).count() == len(rows)
    assert simhash_digest(frame(spark, [])).collect() == [] and one_of_each(frame(spark, [])).collect() == []
