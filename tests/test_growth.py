"""Steps whose rows or batches must grow with the input and the result, not faster."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sharescope.operators import indexing as I
from sharescope.operators import liveindex as LI
from sharescope.operators import permissions as X
from sharescope.operators import principals as PR
from sharescope.operators import ranking as RK
from sharescope.operators import reports as R
from sharescope.operators import search as Q
from sharescope.plans import catalogue_queries as CQ
from sharescope.sources import catalogue as K
from sharescope.sources import texts as TX
from sharescope.sources.versions import Store
from tests.fixtures import EVERYONE, FINANCE, FULL, HR, MODIFY, READ, acls_of, files_of, folders_of, frame, shares_of


def test_members_of_a_deep_ring_are_found_without_all_pairs_of_groups(spark, monkeypatch):
    stored, keep = [], PR.materialize

    def counted(df):
        out = keep(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(PR, "materialize", counted)
    ring = [(f"G{n}", f"G{(n + 1) % 40}") for n in range(40)]
    chain = [(f"C{n}", f"C{n + 1}") for n in range(40)] + [(None, "C39"), ("C40", None), (None, "V")]
    edges = frame(spark, ring + ring + chain + [("G7", "U"), ("C40", "V"), ("C3", "W")], "group_sid string, member_sid string")
    got = sorted(map(tuple, PR.transitive_members(edges).collect()), key=str)
    want = [(f"G{n}", "U") for n in range(40)] + [(f"C{n}", m) for n in range(41) for m in ("V", None)] + [(f"C{n}", "W") for n in range(4)] + [(None, "V"), (None, None)]
    assert got == sorted(want, key=str)
    # 126 pairs of a group and one that holds accounts; the paths that are doubled are at most one a group here.
    assert sum(stored) < 1000


def test_classes_that_differ_in_what_only_they_hold_share_their_masks(spark):
    entries = [("a0", "D-513", "allow", READ, 3), ("a0", "U3", "deny", READ, 3), ("a1", "U3", "allow", FULL, 3), ("a1", "D-513", "deny", 1, 3), ("a2", "U4", "allow", READ, 3), ("a2", EVERYONE, "allow", 2, 3)]
    acls = acls_of(spark, entries + [(f"n{i}", "D-513", "allow", READ, 3) for i in range(20)])
    tokens = frame(spark, [(f"U{i}", s) for i in range(30) for s in ("D-513", f"U{i}") if s == "D-513" or i in (3, 4, 5, 6)], "user_sid string, sid string")
    classes = X.account_classes(tokens.select("user_sid").distinct(), tokens)
    masks = X.class_masks(tokens, classes, acls)
    # Before, every class was evaluated on all 22 ACLs of the domain.
    assert masks.cores.select("core").distinct().count() == 1 and masks.shared.count() == 22 and masks.own.count() == 3
    one = classes.groupBy("class").agg({"user_sid": "min"}).withColumnRenamed("min(user_sid)", "user_sid")
    got = X.evaluate_classes(tokens, classes, acls).join(one, "class").select("user_sid", "acl_id", "mask")
    want = X.evaluate_tokens(tokens.join(one, "user_sid").select("user_sid", "sid"), acls).filter("user_sid IS NOT NULL")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_accounts_of_a_class_meet_levels_and_not_masks(spark):
    folders, shares = folders_of(spark, [("", "a"), ("x", "b")]), shares_of(spark)
    acls = acls_of(spark, [("a", HR, "allow", READ, 3), ("b", FINANCE, "allow", MODIFY, 3), ("b", EVERYONE, "allow", READ, 3)])
    people = [(f"U{i}", f"u{i}", None, "user") for i in range(9)] + [(HR, "hr", None, "group"), (FINANCE, "finance", None, "group")]
    principals = frame(spark, people, "sid string, name string, display_name string, kind string")
    members = frame(spark, [(HR if i % 3 else FINANCE, f"U{i}") for i in range(9)], "group_sid string, member_sid string")
    grid = R.permission_grid(folders, shares, acls, principals, members)
    # One join hands levels to the accounts; before, each of their cells was joined with a mask of its class.
    assert "share" in grid._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.sid, r.folder_id): r.level for r in grid.filter("section = 1").collect()}
    assert got == {(f"U{i}", f): level for i in range(9) for f, level in (("1:", "read" if i % 3 else "none"), ("1:x", "read" if i % 3 else "modify"))}


def test_a_worker_hands_on_small_batches():
    text = "x" * 1_000_000
    given = pa.RecordBatch.from_pydict({"file_id": list(range(20)), "extension": ["docx"] * 20, "content": [text] * 20})
    sizes = [b.num_rows for b in CQ._word_file(iter([given]))]
    assert sum(sizes) == 20 and max(sizes) <= 5
    back = list(TX._unzipped(CQ._word_file(iter([given]))))
    assert max(b.nbytes for b in back) < 8 << 20 and sum(b.num_rows for b in back) == 40


def test_contents_of_many_small_files_take_few_tasks(spark, tmp_path):
    for n in range(300):
        place = tmp_path / f"d{n % 7}" / "sub"
        place.mkdir(parents=True, exist_ok=True)
        (place / f"f {n}.txt").write_bytes(b"x" * n)
    (tmp_path / "d0" / "_hidden").write_bytes(b"no")
    (tmp_path / ".hid").mkdir()
    (tmp_path / ".hid" / "f").write_bytes(b"no")
    rows = K.read_contents(spark, str(tmp_path))
    # A reader that reckons four megabytes for opening a file makes a task of each 32 files.
    assert rows.rdd.getNumPartitions() <= 8
    want = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path", "length", "content")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect())) and rows.count() == 299
    with pytest.raises(OSError):
        K.read_contents(spark, str(tmp_path / "missing"))


def test_matching_and_relevance_read_the_texts_once_and_deal_their_hits(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(Q, "HITS_PART", 10)
    keep = Q.posting_hits
    monkeypatch.setattr(Q, "posting_hits", lambda *a: calls.append(a) or keep(*a))
    folders, shares = folders_of(spark, [("", "a")]), shares_of(spark)
    files = files_of(spark, [(i, "", f"n{i}.txt") for i in range(20)])
    documents = frame(spark, [(i, "el plan de obra " + "y " * i + "plan") for i in range(20)], "file_id bigint, content string")
    lib = Q.Library(shares, folders, files, acls_of(spark, [("a", EVERYONE, "allow", READ, 3)]), documents)
    lib.postings = I.postings(files, folders, shares, documents)
    found = Q.matches(lib, [EVERYONE], Q.SearchParams("plan obra"), "postings", False)
    assert found.filter("score > 0").count() == 20 and len(calls) == 1
    assert Q.store_hits(lib, [Q.parse("plan obra")], False).tasks == 60 // 10 + 1


def test_stored_hits_are_not_handed_whole_to_the_driver(spark):
    folders, shares, query = folders_of(spark, [("", "a")]), shares_of(spark), [Q.parse('plan "de obra"')]
    files = files_of(spark, [(i, "", f"n{i}.txt") for i in range(20)])
    documents = frame(spark, [(i, "el plan de obra " + "y " * i + "plan") for i in range(20)] + [(None, "plan de obra")], "file_id bigint, content string")
    lib = Q.Library(shares, folders, files, acls_of(spark, [("a", EVERYONE, "allow", READ, 3)]), documents)
    lib.postings = I.postings(files, folders, shares, documents)
    kept = Q.store_hits(lib, query, False)
    counts = RK.word_counts(files.selectExpr("file_id", "name", "'Docs' AS share", "'' AS folder_path"))
    for tasks in (kept.tasks, None):
        scores = RK.cover_scores(kept.rows, counts, Q.asked_rows(query, False), tasks)
        # Their files are small, as they compress well: before, the driver built a table of all hits and sent it to every task.
        plan = scores._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        got = {r.file_id: r.score for r in scores.collect()}
        # "plan de obra" is near, "de obra y ... plan" ever farther.
        assert got == {i: round(0.2 + 0.2 / (1 + i), 6) for i in range(20)}


def test_splits_and_tasks_of_postings_follow_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LI, "FILE_ROWS", 10)
    monkeypatch.setattr(LI, "POSTINGS_PART", 10)
    store, shares, folders = Store(spark, str(tmp_path / "index")), shares_of(spark), folders_of(spark, [("", "a")])
    files = files_of(spark, [(i, "", f"n{i}.txt") for i in range(40)])
    documents = frame(spark, [(i, "plan " * (i + 1)) for i in range(40)] + [(None, "plan plan"), (7, "plan")], "file_id bigint, content string")
    LI.start_index(store, files, folders, shares, documents, buckets=2)
    renamed = shares.withColumn("name", shares["path"])
    LI.rename_in_index(store, files.filter("file_id < 9"), folders, renamed, buckets=2)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in (tmp_path / "index").glob("data/write=postings-*/*/*.parquet")]
    # A frequent word was one file, whatever its postings, as they compress well.
    assert max(sizes) <= 10 and sum(sizes) == store.read("postings").count()
    dealt = LI.dealt_postings(store)
    assert dealt.rdd.getNumPartitions() == sum(sizes) // 10 + 1
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(dealt) == rows(LI.live_postings(store))
    # Every posting of a word and file is in one task, those of the frequent word are in many.
    places = dealt.selectExpr("word", "file_id", "spark_partition_id() AS task").distinct()
    assert places.count() == places.select("word", "file_id").distinct().count()
    assert places.filter("word = 'plan'").select("task").distinct().count() > 5
