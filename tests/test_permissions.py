"""Access evaluation: fixed cases, a bit-level model, decoding, the grid."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sharescope.functions import aces as A
from sharescope.operators import permissions as X
from sharescope.operators import reports as R
from sharescope.sources import descriptors as DS
from tests.fixtures import (ALICE, BOB, EVERYONE, FINANCE, FULL, HR, MODIFY, READ, acls_of, files_of, folders_of, frame,
                            shares_of)

CASES = [
    ("deny first", [(ALICE, "deny", READ, 0), (FINANCE, "allow", MODIFY, 0)], [ALICE, FINANCE], False, None),
    ("deny first, other", [(ALICE, "deny", READ, 0), (FINANCE, "allow", MODIFY, 0)], [BOB, FINANCE], True, None),
    ("allow first", [(FINANCE, "allow", READ, 0), (ALICE, "deny", READ, 0)], [ALICE, FINANCE], True, None),
    ("inherit only", [(ALICE, "allow", FULL, 8)], [ALICE], False, None),
    ("this folder only", [(FINANCE, "allow", READ, 0)], [FINANCE], True, False),
    ("files only", [(FINANCE, "allow", READ, 9)], [FINANCE], False, True),
    ("inherited deny", [(ALICE, "deny", READ, 3), (FINANCE, "allow", MODIFY, 3)], [ALICE, FINANCE], None, False),
    ("inherited deny, other", [(ALICE, "deny", READ, 3), (FINANCE, "allow", MODIFY, 3)], [BOB, FINANCE], None, True),
    ("creator owner", [("S-1-3-0", "allow", FULL, 9)], ["S-1-3-0", ALICE], None, False),
]


@pytest.mark.parametrize("name,entries,token,lists,opens", CASES)
def test_cases(spark, name, entries, token, lists, opens):
    acls = acls_of(spark, [("x", *e) for e in entries])
    row = acls.select(A.can_read(F.col("aces"), token).alias("l"), A.can_open_files(F.col("aces"), token).alias("o")).first()
    assert lists is None or row.l is lists
    assert opens is None or row.o is opens


def test_masks_follow_a_plain_model(spark):
    samples = []
    ace = st.tuples(st.sampled_from("ABC"), st.sampled_from(["allow", "deny"]), st.integers(0, 2 ** 32 - 1), st.sampled_from([0, 3, 8, 9, 16]))

    @settings(max_examples=80, database=None, deadline=None)
    @given(st.lists(ace, min_size=1, max_size=6))
    def gather(entries):
        samples.append(entries)

    gather()

    def model(entries, token):
        decided = {}
        for sid, kind, mask, flags in entries:
            if sid in token and not flags & 8:
                for bit in range(32):
                    if mask >> bit & 1:
                        decided.setdefault(bit, kind)
        return sum(1 << b for b, kind in decided.items() if kind == "allow")

    acls = acls_of(spark, [(str(i), *e) for i, entries in enumerate(samples) for e in entries])
    got = {r.acl_id: r.m for r in acls.select("acl_id", A.effective_mask(F.col("aces"), ["A", "B"]).alias("m")).collect()}
    assert got == {str(i): model(entries, {"A", "B"}) for i, entries in enumerate(samples)}


def test_levels_and_generic_rights(spark):
    df = frame(spark, [(FULL,), (MODIFY,), (READ,), (0,), (2,)], "m bigint")
    assert [r[0] for r in df.select(A.access_level(F.col("m"))).collect()] == ["full", "modify", "read", "none", "write"]
    df = frame(spark, [(0x80000000,), (0x10000000,), (1,)], "m bigint")
    assert [r[0] for r in df.select(A.expand_generic(F.col("m"))).collect()] == [READ, FULL, 1]


def test_null_folder_acl_hides_and_own_acl_decides(spark):
    acls = acls_of(spark, [("all", EVERYONE, "allow", READ, 3), ("hr", HR, "allow", READ, 0), ("nobob", BOB, "deny", READ, 0)], protected=("hr",))
    folders = folders_of(spark, [("", "all"), ("x", None)])
    files = files_of(spark, [(1, "", "a.txt"), (2, "x", "b.txt"), (3, "", "salaries.txt", "hr"), (4, "", "minutes.txt", "nobob"), (5, "x", "c.txt", "nobob")])

    def seen(token):
        return sorted(r.file_id for r in X.visible_files(files, folders, acls, token).collect())

    base = A.baseline()
    assert seen([BOB, *base]) == [1]
    assert seen([ALICE, *base]) == [1, 4]
    assert seen([BOB, HR, *base]) == [1, 3]
    access = X.prepare_access(files, folders, acls, [ALICE, *base])
    assert sorted(r.file_id for r in X.visible_files(files, folders, acls, access).collect()) == [1, 4]


def test_a_deny_never_adds_files(spark):
    folders = folders_of(spark, [("", "a"), ("x", "b")])
    files = files_of(spark, [(i, "x" if i % 2 else "", f"{i}.txt") for i in range(6)])
    entries = [("a", EVERYONE, "allow", READ, 3), ("b", FINANCE, "allow", READ, 3)]
    token = [ALICE, FINANCE, *A.baseline()]
    before = {r.file_id for r in X.visible_files(files, folders, acls_of(spark, entries), token).collect()}
    denied = acls_of(spark, [("b", ALICE, "deny", READ, 3), *entries])
    after = {r.file_id for r in X.visible_files(files, folders, denied, token).collect()}
    assert after < before


def test_many_tokens_agree_with_one(spark):
    acls = acls_of(spark, [("a", EVERYONE, "allow", READ, 3), ("b", ALICE, "deny", READ, 3), ("b", FINANCE, "allow", MODIFY, 3), ("c", HR, "allow", FULL, 0)])
    members = frame(spark, [(FINANCE, ALICE), (FINANCE, BOB), (HR, BOB)], "group_sid string, member_sid string")
    users = frame(spark, [(ALICE,), (BOB,), ("ZOE",)], "user_sid string")
    tokens = X.user_tokens(users, members)
    sparse = {(r.user_sid, r.acl_id): r["mask"] for r in X.evaluate_tokens(tokens, acls).collect()}
    groups = {ALICE: [FINANCE], BOB: [FINANCE, HR], "ZOE": []}
    for user, held in groups.items():
        token = [user, *held, *A.baseline()]
        for r in acls.select("acl_id", A.effective_mask(F.col("aces"), token).alias("m")).collect():
            assert sparse.get((user, r.acl_id), sparse[(None, r.acl_id)]) == r.m, (user, r.acl_id)


def sid_blob(sid):
    parts = [int(p) for p in sid.split("-")[1:]]
    return bytes([parts[0], len(parts) - 2]) + parts[1].to_bytes(6, "big") + struct.pack(f"<{len(parts) - 2}I", *parts[2:])


def descriptor(aces, control=0x8004, owner="S-1-5-21-1-2-3-1001"):
    body = b"".join(struct.pack("<BBHI", k, f, 8 + len(sid_blob(s)), m) + sid_blob(s) for k, f, m, s in aces)
    acl = struct.pack("<BBHHH", 2, 0, 8 + len(body), len(aces), 0) + body
    blob = sid_blob(owner)
    return struct.pack("<BBHIIII", 1, 0, control, 20, 0, 0, 20 + len(blob)) + blob + acl


def test_descriptor_decoding(spark):
    good = descriptor([(0, 3, 0x80000000, EVERYONE), (1, 3, 1, "S-1-5-32-545"), (9, 3, 1, EVERYONE), (10, 0, 2, EVERYONE), (5, 0, 2, EVERYONE)], 0x9004)
    blobs = [good, descriptor([], 0x8000), good[:40], b"short", good]
    df = frame(spark, [(i, bytearray(b)) for i, b in enumerate(blobs)], "i int, sd binary")
    rows = {r.i: r for r in DS.decode(df).collect()}
    assert [(a.sid, a.ace_type, a["mask"], a.flags) for a in rows[0].aces] == [
        (EVERYONE, "allow", READ, 3), ("S-1-5-32-545", "deny", 1, 3), (EVERYONE, "deny", 2, 0)]
    assert rows[0].is_protected and rows[0].owner_sid == "S-1-5-21-1-2-3-1001" and rows[0].error is None
    assert rows[1].is_null_dacl and [(a.sid, a["mask"]) for a in rows[1].aces] == [(EVERYONE, FULL)]
    assert rows[2].error and rows[2].aces is None and rows[3].error == "descriptor too short"
    assert rows[4].aces == rows[0].aces
    kinds = frame(spark, [(0, 3, 0x80000000, EVERYONE)], "k int, f int, m bigint, s string")
    built = kinds.select(DS.descriptor_bytes(F.lit("S-1-5-21-1-2-3-1001"), F.lit(0x8004), [DS.ace_bytes(F.col("k"), F.col("f"), F.col("m"), F.col("s"))])).first()[0]
    assert bytes(built) == descriptor([(0, 3, 0x80000000, EVERYONE)])


def test_grid(spark):
    acls = acls_of(spark, [("fin", FINANCE, "allow", READ, 3), ("hr", HR, "allow", READ, 3)], protected=("fin", "hr"))
    folders = folders_of(spark, [("", "fin"), ("HR", "hr"), ("HR/Deep", None)])
    principals = frame(spark, [(ALICE, "alice", None, "user"), (BOB, "bob", None, "user"), (FINANCE, "finance", None, "group"), (HR, "hr", None, "group")],
                       "sid string, name string, display_name string, kind string")
    members = frame(spark, [(FINANCE, ALICE), (FINANCE, BOB), (HR, BOB)], "group_sid string, member_sid string")
    grid = R.permission_grid(folders, shares_of(spark), acls, principals, members)
    rows = {}
    for r in grid.orderBy(*R.grid_order()).collect():
        rows.setdefault(r.name, {})[r.path] = r.level
    root, hr = r"\\fs01\Docs", r"\\fs01\Docs\HR"
    assert list(rows) == ["All domain users", "alice", "bob"]
    assert rows["All domain users"] == {root: "none", hr: "none"}
    assert rows["alice"] == {root: "read", hr: "none"} and rows["bob"] == {root: "read", hr: "read"}
