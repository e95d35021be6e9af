"""Reconciliation on a small tree, the duplicate funnel, index states, sinks and extraction."""

import hashlib
import io
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sharescope.operators import audit as U
from sharescope.operators import duplicates as D
from sharescope.operators import indexing as I
from sharescope.operators import principals as PR
from sharescope.operators import reconcile as C
from sharescope.sources import catalogue as K
from sharescope.sources import texts as TX
from tests.fixtures import frame, shares_of

LISTING = "share_id int, path string, name string, is_dir boolean, size bigint, mtime timestamp_ntz, is_reparse_point boolean"
TREE = [("", "Budget", True), ("Budget", "2025.xlsx", False), ("Budget", "copy of 2025.xlsx", False), ("Budget", "Old", True), ("Budget/Old", "2019.xlsx", False),
        ("", "HR", True), ("HR", "contracts.pdf", False), ("", "readme.txt", False), ("", "~$lock.docx", False), ("", "Thumbs.db", False)]


def listing(spark, rows, links=()):
    data = [(1, p, n, d, 0 if d else 10, None, (p, n) in links) for p, n, d in rows]
    return frame(spark, data, LISTING)


def empty_catalogue(spark):
    return frame(spark, [], "share_id int, path string, name string, file_id bigint, size bigint, mtime timestamp_ntz")


def as_catalogue(changes):
    return changes.filter("change <> 'removed'").select("share_id", "path", "name", F.coalesce("file_id", F.xxhash64("path", "name")).alias("file_id"), "size", "mtime")


def tally(changes):
    return {r.change: r["count"] for r in changes.groupBy("change").count().collect()}


@pytest.fixture(scope="module")
def first(spark):
    files = as_catalogue(C.file_changes(listing(spark, TREE), empty_catalogue(spark)))
    roots = frame(spark, [(1, "")], "share_id int, path string")
    folders = C.folder_changes(listing(spark, TREE), roots).select("share_id", "path")
    return files, folders


def test_first_scan(spark, first):
    files, folders = first
    assert files.count() == 5 and sorted(r.path for r in folders.collect()) == ["", "Budget", "Budget/Old", "HR"]


def test_rescan_without_changes(spark, first):
    files, folders = first
    assert tally(C.file_changes(listing(spark, TREE), files)) == {"unchanged": 5}
    assert tally(C.folder_changes(listing(spark, TREE), folders)) == {"unchanged": 4}


def test_changes(spark, first):
    files, folders = first
    later = [r for r in TREE if r[1] not in ("readme.txt", "Old", "2019.xlsx")] + [("Budget", "new.docx", False)]
    now = listing(spark, later).withColumn("size", F.when(F.col("name") == "2025.xlsx", 11).otherwise(F.col("size")))
    changes = C.file_changes(now, files)
    assert tally(changes) == {"added": 1, "updated": 1, "removed": 2, "unchanged": 2}
    assert tally(C.folder_changes(now, folders)) == {"unchanged": 3, "removed": 1}
    docs = files.select("file_id", F.lit("text").alias("status"))
    states = C.next_documents(docs, changes)
    assert sorted(r.status for r in states.collect()) == ["pending", "text", "text"]


def test_failed_listing_keeps_what_was_known(spark, first):
    files, folders = first
    blind = frame(spark, [(1, "Budget")], "share_id int, path string")
    seen = listing(spark, [r for r in TREE if not r[0].startswith("Budget")])
    assert tally(C.file_changes(seen, files, blind)) == {"unchanged": 5}
    assert tally(C.folder_changes(seen, folders, blind)) == {"unchanged": 4}
    errors = frame(spark, [(1, "Budget", "list", "list Budget: denied")], "share_id int, path string, kind string, message string")
    stats = C.run_statistics(shares_of(spark), seen, C.file_changes(seen, files, blind), C.folder_changes(seen, folders, blind), errors).first()
    assert (stats.status, stats.files_removed, stats.files_seen, stats.error_sample) == ("partial", 0, 2, "list Budget: denied")
    root = frame(spark, [(1, "")], "share_id int, path string")
    nothing = listing(spark, TREE).limit(0)
    assert tally(C.file_changes(nothing, files, root)) == {"unchanged": 5}
    broken = errors.withColumn("path", F.lit(""))
    assert C.run_statistics(shares_of(spark), nothing, C.file_changes(nothing, files, root), C.folder_changes(nothing, folders, root), broken).first().status == "failed"


def test_folder_links_are_skipped_file_links_kept(spark):
    rows = TREE + [("", "loop", True), ("loop", "inside.txt", False), ("", "cloud.txt", False)]
    seen = listing(spark, rows, links=[("", "loop"), ("", "cloud.txt")])
    names = {r.name for r in C.accepted_entries(seen).collect()}
    assert "cloud.txt" in names and not names & {"loop", "inside.txt", "Thumbs.db", "~$lock.docx"}
    assert C.skipped_links(seen).first().folders_skipped == 1


def test_duplicate_funnel(spark, tmp_path):
    rows = [(1, b"a" * 2000), (2, b"a" * 2000), (3, b"b" * 2000), (4, b"a" * 1999 + b"z"), (5, b"small"), (6, b"small"), (7, b"x" * 300 + b"m" * 700 + b"y" * 1000),
            (8, b"x" * 300 + b"n" * 700 + b"y" * 1000)]
    contents = frame(spark, [(i, bytearray(b)) for i, b in rows], "file_id bigint, content binary")
    files = frame(spark, [(i, len(b), None, None) for i, b in rows], "file_id bigint, size bigint, quick_hash string, content_hash string")
    once = D.hash_stage(files, contents, chunk=100)
    stats = D.stage_statistics(files, once).first()
    # 7 and 8 differ only in the middle, so both ends agree and the full hash tells them apart.
    assert (stats.quick_hashed, stats.full_hashed, stats.errors) == (6, 4, 0)
    assert [(r["size"], r.copies, r.confidence) for r in D.groups(once).collect()] == [(2000, 2, "exact")]
    places = [(i, str(tmp_path / f"{i}.bin")) for i, _ in rows]
    for (_, blob), (_, place) in zip(rows, places):
        Path(place).write_bytes(blob)
    read = D.hash_stage(files, D.hash_locations(frame(spark, places, "file_id bigint, location string")), chunk=100)  # files read by ranges give the same
    assert sorted(read.collect()) == sorted(once.select(*read.columns).collect())
    again = D.stage_statistics(once, D.hash_stage(once, contents, chunk=100)).first()
    assert (again.quick_hashed, again.full_hashed) == (0, 0)
    blob = b"q" * 150
    expected = hashlib.sha256(b"150" + blob[:100] + blob[100:]).hexdigest()
    one = frame(spark, [(150, bytearray(blob))], "s bigint, c binary")
    assert one.select(D.quick_hash(F.col("s"), F.col("c"), 100)).first()[0] == expected
    three = frame(spark, [(350, bytearray(b"h" * 100 + b"m" * 150 + b"t" * 100))], "s bigint, c binary")
    assert three.select(D.quick_hash(F.col("s"), F.col("c"), 100)).first()[0] == hashlib.sha256(b"350" + b"h" * 100 + b"t" * 100).hexdigest()


def test_probable_until_fully_hashed(spark):
    files = frame(spark, [(1, 5000, "q", None), (2, 5000, "q", None)], "file_id bigint, size bigint, quick_hash string, content_hash string")
    assert D.groups(files).first().confidence == "probable"


def test_extraction_outcome_fails_closed(spark):
    ddl = "file_id bigint, extension string, size bigint, acl_read boolean, new_acl_id int, acl_id int, text string, method string, error string"
    rows = [(1, "txt", 5, True, 9, 1, " hola ", "text", None), (2, "txt", 5, False, 9, 1, "secret", "text", None), (3, "dwg", 5, True, 9, 1, None, None, None),
            (4, "pdf", 99, True, 9, 1, None, None, None), (5, "txt", 5, True, None, 1, "\n ", "text", None), (6, "pdf", 5, True, 9, 1, None, "ocr_unavailable", "no OCR")]
    got = {r.file_id: r for r in I.extraction_outcome(frame(spark, rows, ddl), 50).collect()}
    assert {i: (r.status, r.content, r.acl_id) for i, r in got.items()} == {
        1: ("text", "hola", 9), 2: ("error", None, 1), 3: ("metadata", None, 1), 4: ("too_large", None, 1), 5: ("empty", None, None), 6: ("ocr_unavailable", None, 9)}


def container(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as box:
        for name, body in members.items():
            box.writestr(name, body)
    return bytearray(buffer.getvalue())


def test_container_texts(spark):
    w = 'xmlns:w="urn:w"'
    a = 'xmlns:a="urn:a"'
    files = [
        (1, "docx", container({"word/document.xml": f"<w:d {w}><w:p><w:t>Hola</w:t><w:tab/><w:t>mundo</w:t></w:p><w:p/></w:d>",
                               "word/header1.xml": f"<w:h {w}><w:p><w:t>Cabecera</w:t></w:p></w:h>"})),
        (2, "pptx", container({"ppt/slides/slide10.xml": f"<a:s {a}><a:p><a:t>diez</a:t></a:p></a:s>", "ppt/slides/slide2.xml": f"<a:s {a}><a:p><a:t>dos</a:t></a:p></a:s>",
                               "ppt/notesSlides/notesSlide1.xml": f"<a:s {a}><a:p><a:t>nota</a:t></a:p></a:s>"})),
        (3, "xlsx", container({"xl/workbook.xml": '<w xmlns="urn:x"><sheet name="Hoja1"/></w>', "xl/sharedStrings.xml": '<s xmlns="urn:x"><si><t>uno</t><t>1</t></si><si><t>dos</t></si></s>'})),
        (4, "odt", container({"content.xml": '<o xmlns:t="urn:t"><t:h>Título</t:h><t:p>a<t:s/>b</t:p></o>'})),
        (5, "docx", bytearray(b"not a zip")), (6, "html", bytearray("<style>x{}</style><p>a &amp; b</p>".encode())), (7, "txt", bytearray("año".encode("cp1252"))),
        (8, "txt", bytearray("€uro ñ".encode("cp1252"))), (9, "txt", bytearray("hé".encode("utf-16"))), (10, "pdf", bytearray(b"%PDF"))]
    got = {r.file_id: r for r in TX.extract_texts(frame(spark, files, "file_id bigint, extension string, content binary")).collect()}
    assert got[1].text == "Hola mundo\nCabecera" and got[2].text == "dos\ndiez\nnota" and got[3].text == "Hoja1\nuno1\ndos"
    assert got[4].text == "Título\nab" and got[5].text is None and "cannot be opened" in got[5].error
    assert got[6].text.split() == ["a", "&", "b"] and got[7].text == "año" and got[8].text == "€uro ñ" and got[9].text == "hé"
    assert got[10].text is None and got[10].error


def test_csv_export(spark, tmp_path):
    df = frame(spark, [("=SUM(A1)", 3, ["a", "b"]), ("año; \"x\"", None, [])], "name string, n int, tags array<string>")
    K.export_csv(df.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_bytes().decode("utf-8")
    assert text.startswith("﻿name;n;tags\n") and "'=SUM(A1);3;a, b" in text and '"año; ""x""";;' in text


def test_tables_replace_only_their_partitions(spark, tmp_path):
    rows = lambda *r: frame(spark, r, "share_id int, name string, path string, enabled boolean")
    K.write_table(rows((1, "a", "x", True), (2, "b", "y", True)), str(tmp_path), "shares")
    K.write_table(rows((2, "c", "y", False)), str(tmp_path), "shares")
    assert sorted((r.share_id, r.name) for r in K.read_table(spark, str(tmp_path), "shares").collect()) == [(1, "a"), (2, "c")]


def test_retention_skips_whole_days(spark, tmp_path):
    events = spark.sql("SELECT id AS event_id, timestampadd(HOUR, CAST(id AS INT) * 12, TIMESTAMP_NTZ '2024-01-01 00:00:00') AS at, 'u' AS username, 'view' AS action FROM range(20)")
    K.append_events(events, str(tmp_path))
    K.append_events(events.limit(0), str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/audit_events")
    kept = U.keep_recent(stored, "2024-01-10 12:00:00", 3)
    assert sorted(r.event_id for r in kept.collect()) == [13, 14, 15, 16, 17, 18, 19]
    assert len(kept.inputFiles()) and "PartitionFilters: [isnotnull(day" in kept._jdf.queryExecution().toString()
    assert U.keep_recent(stored, "2024-01-10 12:00:00", 0).count() == 20
    assert U.event_total(stored, username=" U ", since="2024-01-02", until="2024-01-03").first().total == 4


def test_listing_and_contents_of_a_folder(spark, tmp_path):
    (tmp_path / "root" / "a").mkdir(parents=True)
    Path(tmp_path / "root" / "a" / "x.txt").write_bytes(b"hola")
    Path(tmp_path / "root" / "top.bin").write_bytes(b"0123456789")
    rows = {(r.path, r.name): r["size"] for r in K.partitioned_listing(spark, str(tmp_path / "root")).collect()}
    assert rows == {("a", "x.txt"): 4, ("", "top.bin"): 10}
    assert [bytes(r.content) for r in K.read_contents(spark, str(tmp_path / "root"), 5).collect()] == [b"hola"]


def test_nested_groups_and_cycles(spark):
    edges = frame(spark, [("A", "B"), ("B", "C"), ("C", "A"), ("C", "u1"), ("A", "u2"), ("D", "A")], "group_sid string, member_sid string")
    got = {(r.group_sid, r.member_sid) for r in PR.transitive_members(edges).collect()}
    assert got == {(g, u) for g in "ABCD" for u in ("u1", "u2")}


def test_directory_outage_changes_nothing(spark):
    ddl = "sid string, name string, display_name string, kind string, dn string, resolved_at timestamp_ntz"
    known = frame(spark, [("G", "group", None, "group", "CN=g", None), ("X", "gone", "Gone", "user", None, None)], ddl)
    due = known.select("sid")
    answers = frame(spark, [("G", "error", None, None, None, None), ("X", "absent", None, None, None, None)], "sid string, answer string, name string, display_name string, kind string, dn string")
    none = frame(spark, [], "group_sid string, ok boolean")
    got = {r.sid: r for r in PR.upsert(known, due, answers, none, "2024-01-01 00:00:00").collect()}
    assert (got["G"].kind, got["G"].resolved_at, got["G"].outcome) == ("group", None, "error")
    assert (got["X"].kind, got["X"].name, got["X"].outcome) == ("unknown", "gone", "unknown") and got["X"].resolved_at is not None


def test_scans_follow_each_other_in_a_store(spark, tmp_path):
    from sharescope.operators import scanning as SC
    from sharescope.sources.versions import Change, Conflict, Store
    from tests.fixtures import files_of, folders_of
    store = Store(spark, str(tmp_path / "catalogue"))
    files = files_of(spark, [(1, "", "readme.txt"), (2, "Budget", "2025.xlsx"), (3, "Budget/Old", "2019.xlsx")]).withColumns({
        "path": F.regexp_replace("folder_id", "^1:", ""), "ctime": F.col("mtime"), "quick_hash": F.lit("q"), "content_hash": F.lit("c"), "indexed_at": F.lit(None).cast("timestamp_ntz")})
    folders = folders_of(spark, [("", "a"), ("Budget", "a"), ("Budget/Old", "a", "Access denied")]).withColumns({"owner_sid": F.lit("o"), "mtime": F.lit(None).cast("timestamp_ntz")})
    documents = frame(spark, [(1, i, "text") for i in (1, 2, 3)], "share_id int, file_id bigint, status string")
    assert SC.start_catalogue(store, {"folders": folders, "files": files, "documents": documents}) == 1

    def entries(*rows):
        data = [(1, p, n, d, s, None, False) for p, n, d, s in rows]
        return frame(spark, data, LISTING).withColumn("mtime", F.when(F.col("name") == "readme.txt", F.expr("TIMESTAMP_NTZ '2024-01-02 00:00:00.5'")).when(
            F.col("name") == "2025.xlsx", F.expr("TIMESTAMP_NTZ '2024-01-03 00:00:00'"))).withColumn("ctime", F.col("mtime"))

    def failed(*rows):
        return frame(spark, [(1, p, m) for p, m in rows], "share_id int, path string, message string")

    tree = [("", "readme.txt", False, 101), ("", "Budget", True, 0), ("Budget", "2025.xlsx", False, 102)]
    SC.scan_into(store, entries(*tree), failed(("Budget", "x" * 900)), "2024-02-01 00:00:00")
    left = {r.path: r.list_error for r in store.read("folders").collect()}
    assert left == {"": None, "Budget": "x" * 500, "Budget/Old": "Access denied"} and store.read("files").count() == 3
    # Nothing changed but half a second: the time that was stored stays.
    assert {r.file_id: str(r.mtime) for r in store.read("files").collect()}[1] == "2024-01-02 00:00:00"
    changes = SC.scan_into(store, entries(("", "readme.txt", False, 5), *tree[1:], ("Budget", "new.docx", False, 9)), failed(), "2024-02-02 00:00:00")
    assert tally(changes) == {"updated": 1, "unchanged": 1, "added": 1, "removed": 1}
    assert {r.path: r.list_error for r in store.read("folders").collect()} == {"": None, "Budget": None}
    now = {r.name: r for r in store.read("files").collect()}
    assert set(now) == {"readme.txt", "2025.xlsx", "new.docx"} and now["readme.txt"].quick_hash is None and now["2025.xlsx"].quick_hash == "q"
    assert now["new.docx"].file_id > 3 and now["new.docx"].folder_id == "1:Budget"
    assert {r.file_id: r.status for r in store.read("documents").collect()} == {1: "pending", 2: "text"}
    # Older versions stay until they are removed, and two writes of the same version can't both succeed.
    assert store.read("files", 1).count() == 3 and store.manifest().version == 3
    with pytest.raises(Conflict):
        store.commit({"folders": Change(folders, "share_id")}, store.manifest(2))
    assert store.vacuum() > 0 and store.read("files").count() == 3
    with pytest.raises(LookupError):
        store.read("files", 1)
    assert Store(spark, str(tmp_path / "none")).manifest().version == 0 and Store(spark, str(tmp_path / "none")).vacuum() == 0


def test_index_follows_changes_and_compacts_single_buckets(spark, tmp_path):
    from sharescope.operators import liveindex as LI
    from sharescope.sources.versions import Store
    from tests.fixtures import files_of, folders_of
    shares, folders = shares_of(spark), folders_of(spark, [("", None), ("Old", None)])
    texts = {1: "red blue", 2: "blue green", 3: "white"}
    documents = lambda t: frame(spark, list(t.items()), "file_id bigint, content string")
    key = lambda df: sorted(tuple(r) for r in df.select("word", "file_id", "field", "pos").collect())
    store, files = Store(spark, str(tmp_path / "index")), files_of(spark, [(1, "", "a.txt"), (2, "Old", "b.txt"), (3, "", "c.txt")])
    LI.start_index(store, files, folders, shares, documents(texts), buckets=4)
    gone = frame(spark, [(3,)], "file_id bigint")
    moved = files_of(spark, [(1, "Old", "a.txt"), (4, "", "d.txt")])
    LI.update_index(store, gone, moved, documents({2: "green red red", 4: "black"}), folders, shares, buckets=4)
    after = files_of(spark, [(1, "Old", "a.txt"), (2, "Old", "b.txt"), (4, "", "d.txt")])
    want = key(I.postings(after, folders, shares, documents({1: "red blue", 2: "green red red", 4: "black"}), 4))
    assert key(LI.live_postings(store)) == want
    before = {p for p in store.manifest().parts if p[0] == "postings"}
    crowded = LI.crowded_buckets(store, 1)
    assert crowded
    LI.compact_index(store, crowded[:1])
    kept = {p for p in store.manifest().parts if p[0] == "postings"}
    assert {p[1] for p in before - kept} == {p[1] for p in kept - before} == {str(crowded[0])}
    assert key(LI.live_postings(store)) == want and store.read("gone").count() > 0
    LI.compact_index(store, [0, 1, 2, 3])
    assert key(LI.live_postings(store)) == want and store.read("gone").count() == 0
    # A file that comes back under its old number is found by its new words only.
    LI.update_index(store, frame(spark, [], "file_id bigint"), files_of(spark, [(3, "", "c.txt")]), documents({3: "pink"}), folders, shares, buckets=4)
    words = {r.word for r in LI.live_postings(store).filter("file_id = 3").collect()}
    assert words == {"c", "txt", "docs", "pink"}


def test_rows_are_numbered_in_order(spark):
    from sharescope.operators.common import numbered
    rows = frame(spark, [(i, None if i % 7 == 0 else i * 37 % 11) for i in range(200)], "i int, k int")
    got = {r.i: r.position for r in numbered(rows.repartition(5), [F.col("k").desc_nulls_last(), F.asc("i")]).collect()}
    order = sorted(range(200), key=lambda i: (i % 7 == 0, 0 if i % 7 == 0 else -(i * 37 % 11), i))
    assert [got[i] for i in order] == list(range(1, 201))
