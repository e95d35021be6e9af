"""The folder plan on a tree with known totals, lists and edits."""

import pytest
from pyspark.sql import functions as F

from sharescope.operators import folderplan as L
from tests.fixtures import files_of, folders_of, frame, shares_of

PLAN = ("share_id int, path string, path_key string, purpose string, belongs string, not_belongs string, owner string, naming string, "
        "naming_pattern string, examples array<string>, extensions array<string>, keywords array<string>, allow_files boolean, "
        "allow_subfolders boolean, max_files int")
FILES = [(1, "", "readme.txt"), (2, "Contratos", "2025-001 Limpieza.pdf"), (3, "Contratos", "contrato viejo.pdf"), (4, "Contratos", "2025-002 Notas.txt"),
         (5, "Contratos/2024", "2024-007 Obras.docx"), (6, "Personal", "a.txt"), (7, "Personal", "b.txt"), (8, "Varios", "x.txt"), (9, "Varios/Sub", "y.txt")]
TREE = ["", "Contratos", "Contratos/2024", "Personal", "Archivo", "Varios", "Varios/Sub"]


def entry(path, pattern=None, types=(), files=True, subfolders=False, most=None, examples=()):
    return (1, path, path.lower(), "", "", "", "", "", pattern, list(examples), list(types), [], files, subfolders, most)


def plan_of(spark, *extra):
    rows = [entry("", files=False), entry("contratos", "{YYYY}-{N} *", ["pdf", "docx"], subfolders=True), entry("Personal", most=1),
            entry("Archivo"), entry("Actas"), *extra]
    return frame(spark, rows, PLAN)


@pytest.fixture(scope="module")
def case(spark):
    folders = folders_of(spark, [(p, None) for p in TREE])
    files = files_of(spark, FILES)
    plan = plan_of(spark)
    return folders, files, plan, L.folder_facts(folders, files, plan, reused=True)


def test_totals(spark, case):
    folders, files, plan, facts = case
    row = L.totals(facts, files, plan, folders).first().asDict()
    row.pop("share_id")
    assert row == {"files_total": 9, "files_in_plan": 6, "files_checked": 4, "files_misnamed": 1, "files_wrong_type": 1, "folders_planned": 5,
                   "folders_missing": 1, "folders_empty": 1, "folders_overgrown": 1}


def test_lists(spark, case):
    folders, files, plan, facts = case
    rows = L.issues(facts, files, plan, folders, shares_of(spark)).collect()
    found = sorted((r.issue, r.path.removeprefix(r"\\fs01\Docs").lstrip("\\"), r.files) for r in rows)
    assert found == sorted([("outside the plan", "Varios", 2), ("files not allowed here", "", 1), ("naming", r"Contratos\contrato viejo.pdf", 0),
                            ("file type", r"Contratos\2025-002 Notas.txt", 0), ("planned folder missing", "Actas", 0),
                            ("planned folder empty", "Archivo", 0), ("overgrown", "Personal", 2)])
    assert L.overgrown(facts).first()["limit"] == 1


def test_unlisted_folder_is_neither_empty_nor_missing(spark):
    folders = folders_of(spark, [(p, None, "denied" if p == "Archivo" else None) for p in TREE])
    files, plan = files_of(spark, FILES), plan_of(spark, entry("Archivo/2020"))
    row = L.totals(L.folder_facts(folders, files, plan), files, plan, folders).first()
    assert (row.folders_empty, row.folders_missing) == (0, 1)


def test_totals_are_whole(spark, case):
    folders, files, plan, facts = case
    outside = facts.filter((F.col("status") == "outside") | ((F.col("status") == "planned") & ~F.col("allow_files"))).agg(F.sum("direct")).first()[0]
    row = L.totals(facts, files, plan, folders).first()
    assert row.files_in_plan + outside == row.files_total


def test_share_without_plan_has_no_row(spark):
    folders = folders_of(spark, [("", None)], share_id=2)
    assert L.placements(folders, plan_of(spark)).count() == 0


def test_root_without_entry_is_one_branch(spark):
    folders = folders_of(spark, [("", None), ("a", None), ("a/b", None)])
    files = files_of(spark, [(1, "a/b", "x.txt")])
    plan = frame(spark, [entry("zzz")], PLAN)
    rows = L.outside_branches(L.folder_facts(folders, files, plan)).collect()
    assert [(r.path, r.files, r.plan_path) for r in rows] == [("", 1, None)]


def test_capped_lists_keep_the_biggest(spark):
    rows = frame(spark, [(1, "outside the plan", f"p{i}", i, "", None) for i in range(30)] + [(1, "files not allowed here", "q", 99, "", None)],
                 "share_id int, issue string, path string, files bigint, detail string, plan_path string")
    top = L.capped_issues(rows, 2).collect()
    assert sorted(r.path for r in top) == ["p29", "q"] and {r.list_count for r in top} == {31}
    assert L.capped_issues(rows, None).count() == 31 and L.capped_issues(rows, 0).first().list_count == 31
    assert L.capped_issues(rows, 2000).count() == 31


def test_move_takes_the_subtree(spark):
    plan = plan_of(spark, entry("Archivo/2020"), entry("Archivo/2020/Enero"))
    moves = frame(spark, [(1, "archivo", "Personal\\Viejo")], "share_id int, path_key string, new_path string")
    assert {r.path for r in L.move_subtrees(plan, moves).collect()} >= {"Personal/Viejo", "Personal/Viejo/2020", "Personal/Viejo/2020/Enero"}
    bad = frame(spark, [(1, "", "x"), (1, "archivo", "actas"), (1, "archivo", "Archivo/2020/x"), (1, "archivo", "nada/x"), (1, "archivo", "ARCHIVO")],
                "share_id int, path_key string, new_path string")
    got = {(r.path_key, r.new_path): r.problem for r in L.move_problems(plan, bad).collect()}
    assert got[("", "x")] == "the root can't be moved" and got[("archivo", "actas")] == "already in the plan"
    assert got[("archivo", "Archivo/2020/x")] == "can't be moved inside itself"
    assert got[("archivo", "nada/x")] == "add the new parent first" and got[("archivo", "ARCHIVO")] is None


def test_import_needs_every_ancestor(spark):
    folders = folders_of(spark, [(p, None) for p in ["", "A", "a", "A/x", "B", "B/y/z"]])
    plan = frame(spark, [entry("")], PLAN)
    got = {r.path: r.allow_subfolders for r in L.import_folders(plan, folders, shares_of(spark), 3).collect()}
    assert got == {"A": False, "A/x": False, "B": False}


def test_same_day_snapshot_is_replaced(spark):
    ddl = "share_id int, day date, taken_at timestamp_ntz, files_total bigint"
    q = "SELECT 1 AS share_id, DATE '2024-01-01' AS day, TIMESTAMP_NTZ '2024-01-01 {h}:00:00' AS taken_at, CAST({n} AS BIGINT) AS files_total"
    merged = L.upsert_snapshots(spark.sql(q.format(h="02", n=1)), spark.sql(q.format(h="09", n=7))).collect()
    assert ddl and [(r.share_id, r.files_total) for r in merged] == [(1, 7)]
