import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sharescope.llm.packing import first_fit_decreasing, pack, packing_digest

from .cases import awkward, frame, with_clashes

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_hold_every_id_once(spark):
    rows = awkward()
    library = Tokenizer.from_file(PATH)
    want = sorted(np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for r in rows)
    by_doc, bins = defaultdict(list), defaultdict(list)
    for p in packing_digest(frame(spark, rows), PATH).collect():
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append(p)
    for pieces in bins.values():
        ends = np.cumsum([0, *(n for _, n in sorted(pieces))])
        assert [at for at, _ in sorted(pieces)] == ends[:-1].tolist() and ends[-1] <= 4096
    sums = defaultdict(list)
    for raw, row in ((np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4"), r) for r in rows):
        for a in range(0, len(raw), 4096):
            sums[row[0]].append((a, len(raw[a:a + 4096]), zlib.crc32(raw[a:a + 4096].tobytes()), len(raw)))
    assert {d: sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in ps) for d, ps in by_doc.items()} == {d: sorted(s) for d, s in sums.items()}
    assert len(want) == len(rows)


def test_first_fit_decreasing_is_the_plain_rule():
    lengths = np.random.default_rng(3).integers(1, 60, 300)
    bins, offsets = first_fit_decreasing(lengths, 64)
    left = []
    for i in np.argsort(-lengths, kind="stable"):
        at = next((b for b, room in enumerate(left) if room >= lengths[i]), len(left))
        if at == len(left):
            left.append(64)
        assert (bins[i], offsets[i]) == (at, 64 - left[at])
        left[at] -= lengths[i]


def test_many_groups_clashes_and_empty(spark):
    docs = with_clashes(frame(spark, awkward()), "sequence_id", "start", "length")
    got = pack(docs.drop("start", "length", "sequence_id"), PATH, keep=["doc_id", "extra one"], size=16, group_rows=5).collect()
    ends = defaultdict(int)
    for p in got:
        ends[p["sequence_id"]] += p["length"]
    assert max(ends.values()) <= 16 and len({p["sequence_id"] >> 32 for p in got if p["sequence_id"] >= 0}) > 1
    assert packing_digest(frame(spark, []), PATH).collect() == []


def test_columns_named_like_results_are_replaced_and_others_kept(spark):
    plain = pack(frame(spark, awkward()), PATH, size=16, group_rows=5)
    docs = with_clashes(frame(spark, awkward()), "Length", "start", "ids_crc32", "doc_tokens", "sequence_id", "offset", "group", "_group")
    got = pack(docs, PATH, size=16, group_rows=5)
    assert sorted(got.columns) == sorted([*plain.columns, "group", "_group", "extra one"])
    assert {(r["group"], r["_group"], r["extra one"]) for r in got.collect()} == {("mine", "mine", 1)}
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(str, got.select(key).collect())) == sorted(map(str, plain.select(key).collect()))
