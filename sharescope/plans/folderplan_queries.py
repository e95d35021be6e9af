"""The folder plan and its compliance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import folderplan as L
from ..operators.permissions import listable_acls
from ..sources.derived import Estate
from . import base_sql as S
from .registry import query


def facts(e: Estate, reused: bool = False) -> DataFrame:
    return L.folder_facts(e.folders, e.files, e.plan, reused)


@query("L1", "SELECT share_id, path, purpose FROM est_plan")
def plan_in_tree_order(e: Estate) -> DataFrame:
    return L.in_tree_order(e.plan).select("share_id", "path", "purpose")


_PROPOSED = r"""SELECT doc_id % 22 AS share_id, CASE doc_id % 6 WHEN 0 THEN '\en\d' || doc_id % 9 || '\' WHEN 1 THEN 'Actas/' || doc_id WHEN 2 THEN 'Nada/' || doc_id
    WHEN 3 THEN '' WHEN 4 THEN 'es/a?' || doc_id ELSE 'FR//x' || doc_id END AS raw, doc_id FROM documents"""


@query("L2 X12", rf"""SELECT share_id::INT AS share_id, path, path <> '' AS default_allow_files, CASE WHEN contains(path, '?') THEN 'name: character'
    WHEN taken THEN 'already in the plan' WHEN path = '' THEN NULL WHEN NOT has_parent AND NOT has_plan THEN 'start with the share''s root' WHEN NOT has_parent THEN 'add its parent first' END AS problem
    FROM (SELECT *, EXISTS (SELECT 1 FROM est_plan p WHERE p.share_id = q.share_id AND p.path_key = lower(q.path)) AS taken,
        EXISTS (SELECT 1 FROM est_plan p WHERE p.share_id = q.share_id AND p.path_key = {S.parent('lower(q.path)')}) AS has_parent,
        q.share_id IN (SELECT share_id FROM est_plan) AS has_plan
        FROM (SELECT share_id, array_to_string(list_filter(string_split(replace(raw, '\', '/'), '/'), lambda x: x <> ''), '/') AS path FROM ({_PROPOSED})) q)""")
def proposal_check(e: Estate) -> DataFrame:
    raw = F.expr(r"""CASE doc_id % 6 WHEN 0 THEN concat('\\en\\d', doc_id % 9, '\\') WHEN 1 THEN concat('Actas/', doc_id) WHEN 2 THEN concat('Nada/', doc_id)
        WHEN 3 THEN '' WHEN 4 THEN concat('es/a?', doc_id) ELSE concat('FR//x', doc_id) END""")
    asked = e.table("documents").select((F.col("doc_id") % 22).cast("int").alias("share_id"), raw.alias("path"))
    return L.proposal_problems(e.plan, asked).select("share_id", "path", "default_allow_files", "problem")


@query("L3", r"""SELECT share_id, path_key, CASE share_id % 3 WHEN 0 THEN purpose WHEN 1 THEN 'Nuevo' ELSE '' END AS purpose,
    CASE WHEN share_id % 3 <> 1 THEN naming_pattern WHEN path_key = 'actas' THEN naming_pattern ELSE 'Acta {N}' END AS naming_pattern,
    array_to_string(CASE WHEN share_id % 3 = 1 THEN ['pdf', 'doc'] ELSE extensions END, ',') AS extensions,
    CASE WHEN share_id % 3 = 1 THEN true ELSE allow_files END AS allow_files,
    CASE WHEN share_id % 3 = 1 AND path_key = 'actas' THEN '{FECHA}' END AS problem FROM est_plan""")
def merge_plan_fields(e: Estate) -> DataFrame:
    changes = e.plan.filter("share_id % 3 <> 0").select(
        "share_id", "path_key", F.expr("CASE share_id % 3 WHEN 1 THEN '  Nuevo ' ELSE '' END").alias("purpose"),
        F.expr("CASE WHEN share_id % 3 = 1 THEN CASE WHEN path_key = 'actas' THEN '{FECHA} *' ELSE ' Acta {N} ' END END").alias("naming_pattern"),
        F.expr("CASE WHEN share_id % 3 = 1 THEN array('.PDF', 'pdf', ' Doc ', '') END").alias("extensions"),
        F.expr("CASE WHEN share_id % 3 = 1 THEN true END").alias("allow_files"))
    return L.merge_fields(e.plan, changes).select(
        "share_id", "path_key", "purpose", "naming_pattern", F.array_join("extensions", ",").alias("extensions"), "allow_files", "problem")


_MOVES = """SELECT share_id, path_key, CASE path_key WHEN 'archivo' THEN 'es/Archivo viejo' WHEN 'actas' THEN 'EN' WHEN 'en' THEN 'en/d0/x' WHEN '' THEN 'raiz'
    WHEN 'es' THEN '' WHEN 'fr' THEN 'Nada/fr' ELSE upper(path_key) END AS new_path FROM est_plan WHERE share_id % 2 = 0"""


@query("L4", f"""SELECT share_id, path_key, new_path, CASE path_key WHEN '' THEN 'the root can''t be moved' WHEN 'es' THEN 'another entry can''t become the root'
    WHEN 'actas' THEN 'already in the plan' WHEN 'en' THEN 'can''t be moved inside itself' WHEN 'fr' THEN 'add the new parent first' END AS problem FROM ({_MOVES})""")
def move_check(e: Estate) -> DataFrame:
    moves = e.plan.filter("share_id % 2 = 0").select("share_id", "path_key", F.expr(
        "CASE path_key WHEN 'archivo' THEN 'es/Archivo viejo' WHEN 'actas' THEN 'EN' WHEN 'en' THEN 'en/d0/x' WHEN '' THEN 'raiz' "
        "WHEN 'es' THEN '' WHEN 'fr' THEN 'Nada/fr' ELSE upper(path_key) END").alias("new_path"))
    return L.move_problems(e.plan, moves).select("share_id", "path_key", "new_path", "problem")


@query("L4", "SELECT share_id, CASE WHEN path_key = 'archivo' OR starts_with(path_key, 'archivo/') THEN 'es/Viejo' || substr(path, 8) ELSE path END AS path FROM est_plan", name="move_subtree")
def move_subtree(e: Estate) -> DataFrame:
    moves = e.plan.filter("path_key = 'archivo'").select("share_id", "path_key", F.lit("es/Viejo").alias("new_path"))
    return L.move_subtrees(e.plan, moves).select("share_id", "path")


@query("L5", """SELECT share_id, path FROM est_plan WHERE NOT (path_key = 'archivo' OR starts_with(path_key, 'archivo/')) AND share_id % 9 <> 0""")
def delete_subtree(e: Estate) -> DataFrame:
    doomed = e.plan.filter("path_key = 'archivo' OR (path_key = '' AND share_id % 9 = 0)").select("share_id", "path_key")
    return L.delete_subtrees(e.plan, doomed).select("share_id", "path")


@query("L6", """WITH near AS (SELECT share_id, lower(path) AS path_key, min(path) AS path, min(depth) AS depth FROM est_folders WHERE depth BETWEEN 1 AND 3 GROUP BY 1, 2),
    fresh AS (SELECT * FROM near n WHERE NOT EXISTS (SELECT 1 FROM est_plan p WHERE p.share_id = n.share_id AND p.path_key = n.path_key))
    SELECT share_id, path, true AS allow_files, depth = 3 AS allow_subfolders FROM fresh
    UNION ALL SELECT share_id, '', false, false FROM est_shares WHERE share_id NOT IN (SELECT share_id FROM est_plan)""")
def import_folders(e: Estate) -> DataFrame:
    return L.import_folders(e.plan, e.folders, e.shares, 3).select("share_id", "path", "allow_files", "allow_subfolders")


@query("L7 X16", f"""SELECT p.share_id, p.path, CASE WHEN p.path = '' THEN s.name ELSE regexp_extract(p.path, '([^/]*)$', 1) END AS name, {S.show('s.path', 'p.path')} AS network_path,
    f.folder_id, f.folder_id IS NOT NULL AS exists, CASE p.path WHEN 'EN/d0' THEN 'mal.pdf: pattern|2021-4 Hoja.xlsx: type' WHEN 'Actas' THEN 'acta 3.pdf: pattern' WHEN 'fr' THEN '' ELSE '' END AS example_problems
    FROM est_plan p JOIN est_shares s USING (share_id) LEFT JOIN est_folders f ON f.share_id = p.share_id AND lower(f.path) = p.path_key""")
def plan_admin_view(e: Estate) -> DataFrame:
    return L.admin_view(e.plan, e.shares, e.folders).select(
        "share_id", "path", "name", "network_path", "folder_id", "exists", F.array_join("example_problems", "|").alias("example_problems"))


_GUIDE = """SELECT p.*, CASE WHEN lower(n.path) = p.path_key THEN n.folder_id END AS folder_id FROM est_plan p JOIN est_shares s ON s.share_id = p.share_id AND s.enabled,
    LATERAL (SELECT * FROM est_folders d WHERE d.share_id = p.share_id AND (d.path = '' OR lower(d.path) = p.path_key OR starts_with(p.path_key, lower(d.path) || '/')) ORDER BY length(d.path) DESC LIMIT 1) n
    WHERE n.acl_id IN (SELECT acl_id FROM listable)"""


def guide_rows(e: Estate) -> DataFrame:
    return L.guide(e.plan, e.shares, e.folders, listable_acls(e.acls, S.TOKEN))


@query("L8", f"SELECT share_id, path, folder_id FROM ({_GUIDE})")
def folder_guide(e: Estate) -> DataFrame:
    return guide_rows(e).select("share_id", "path", "folder_id")


@query("L9", f"""SELECT share_id, path FROM ({_GUIDE}) WHERE list_bool_and(list_transform(['acta', 'reunion'], lambda w: contains({S.fold("concat_ws(' ', path, purpose, array_to_string(keywords, ' '), array_to_string(examples, ' '), array_to_string(extensions, ' '))")}, w)))""")
def guide_search(e: Estate) -> DataFrame:
    return L.guide_text(guide_rows(e), " ACTA  reunión ").select("share_id", "path")


@query("L10 L22", "SELECT share_id, folder_id, status, entry_path FROM placed")
def folder_placement(e: Estate) -> DataFrame:
    return L.placements(e.folders, e.plan).select("share_id", "folder_id", "status", "entry_path")


@query("L11 L12", "SELECT folder_id, direct, subtree, unknown FROM counted")
def subtree_counts(e: Estate) -> DataFrame:
    return L.subtree_counts(e.folders, e.files).select("folder_id", "direct", "subtree", "unknown")


_TOPS = f"""SELECT share_id, folder_id, subtree AS files, 'not_in_plan' AS reason, entry_path AS plan_path, path FROM facts f WHERE status = 'outside'
    AND NOT EXISTS (SELECT 1 FROM placed p WHERE p.share_id = f.share_id AND p.status = 'outside' AND f.path <> '' AND p.path = {S.parent('f.path')})"""
_CLOSED = "SELECT share_id, folder_id, direct AS files, 'no_files_here' AS reason, entry_path AS plan_path, path FROM facts WHERE status = 'planned' AND NOT allow_files AND direct > 0"
_EMPTY = "SELECT share_id, folder_id, path FROM facts WHERE status = 'planned' AND subtree = 0 AND NOT unknown"
_GROWN = """SELECT share_id, folder_id, path, direct AS files, CAST(coalesce(nullif(max_files, 0), {default}) AS BIGINT) AS "limit" FROM facts
    WHERE (status = 'free' OR (status = 'planned' AND allow_files)) AND direct > coalesce(nullif(max_files, 0), {default})"""


@query("L13", f"SELECT * EXCLUDE (path) FROM ({_TOPS})")
def outside_branches(e: Estate) -> DataFrame:
    return L.outside_branches(facts(e)).drop("path")


@query("L14", f"SELECT * EXCLUDE (path) FROM ({_CLOSED})")
def files_not_allowed(e: Estate) -> DataFrame:
    return L.files_not_allowed(facts(e)).drop("path")


@query("L15 L16 X14", "SELECT file_id, entry_path, checked, misnamed, wrong_type FROM governed")
def governed_files(e: Estate) -> DataFrame:
    return L.governed_files(facts(e), e.files).select("file_id", "entry_path", "checked", "misnamed", "wrong_type")


@query("L17", "SELECT share_id, path FROM missing")
def missing_folders(e: Estate) -> DataFrame:
    return L.missing_folders(e.plan, e.folders).select("share_id", "path")


@query("L18", _EMPTY)
def empty_planned_folders(e: Estate) -> DataFrame:
    return L.empty_planned(facts(e))


@query("L19", _GROWN.format(default=4))
def overgrown_folders(e: Estate) -> DataFrame:
    return L.overgrown(facts(e), 4)


_TOTALS = f"""SELECT share_id, (SELECT CAST(sum(direct) AS BIGINT) FROM facts f WHERE f.share_id = p.share_id) AS files_total,
    (SELECT CAST(sum(CASE WHEN status = 'outside' OR (status = 'planned' AND NOT allow_files) THEN 0 ELSE direct END) AS BIGINT) FROM facts f WHERE f.share_id = p.share_id) AS files_in_plan,
    (SELECT count(*) FROM governed g WHERE g.share_id = p.share_id AND checked) AS files_checked,
    (SELECT count(*) FROM governed g WHERE g.share_id = p.share_id AND misnamed) AS files_misnamed,
    (SELECT count(*) FROM governed g WHERE g.share_id = p.share_id AND wrong_type) AS files_wrong_type,
    count(*) AS folders_planned, (SELECT count(*) FROM missing m WHERE m.share_id = p.share_id) AS folders_missing,
    (SELECT count(*) FROM ({_EMPTY}) x WHERE x.share_id = p.share_id) AS folders_empty,
    (SELECT count(*) FROM ({_GROWN.format(default=500)}) x WHERE x.share_id = p.share_id) AS folders_overgrown FROM est_plan p GROUP BY share_id"""


@query("L20", _TOTALS)
def compliance_totals(e: Estate) -> DataFrame:
    return L.totals(facts(e, True), e.files, e.plan, e.folders)


_ISSUES = rf"""SELECT share_id, 'outside the plan' AS issue, path AS folder, NULL AS name, files, files || ' files' AS detail, plan_path FROM ({_TOPS})
    UNION ALL SELECT share_id, 'files not allowed here', path, NULL, files, files || ' files', plan_path FROM ({_CLOSED})
    UNION ALL SELECT share_id, 'naming', path, name, 0, naming_pattern, entry_path FROM governed WHERE misnamed
    UNION ALL SELECT share_id, 'file type', path, name, 0, '.' || extension || ' (expected ' || array_to_string(extensions, ', ') || ')', entry_path FROM governed WHERE wrong_type
    UNION ALL SELECT share_id, 'planned folder missing', path, NULL, 0, '', path FROM missing
    UNION ALL SELECT share_id, 'planned folder empty', path, NULL, 0, '', path FROM ({_EMPTY})
    UNION ALL SELECT share_id, 'overgrown', path, NULL, files, files || ' files (limit ' || "limit" || ')', NULL FROM ({_GROWN.format(default=500)})"""
_SHOWN = rf"""SELECT i.share_id, issue, {S.show('s.path', 'folder')} || coalesce('\' || i.name, '') AS path, files, detail,
    CASE WHEN plan_path IS NOT NULL THEN {S.show('s.path', 'plan_path')} END AS plan_path FROM ({_ISSUES}) i JOIN est_shares s USING (share_id)"""


@query("L13 L14 L15 L16 L17 L18 L19 G13", _SHOWN)
def compliance_issues(e: Estate) -> DataFrame:
    return L.issues(facts(e, True), e.files, e.plan, e.folders, e.shares)


@query("L21", rf"""SELECT * EXCLUDE (rn) FROM (SELECT *, CASE WHEN issue = 'files not allowed here' THEN 'outside the plan' ELSE issue END AS list,
    row_number() OVER (PARTITION BY share_id, CASE WHEN issue = 'files not allowed here' THEN 'outside the plan' ELSE issue END
        ORDER BY files DESC, string_split(lower(replace(path, '\', '/')), '/'), path, detail) AS rn,
    count(*) OVER (PARTITION BY share_id, CASE WHEN issue = 'files not allowed here' THEN 'outside the plan' ELSE issue END) AS list_count FROM ({_SHOWN})) WHERE rn <= 3""")
def capped_issue_lists(e: Estate) -> DataFrame:
    return L.capped_issues(L.issues(facts(e, True), e.files, e.plan, e.folders, e.shares), 3)


@query("L23", f"SELECT t.*, '2024-01-01' AS day, '2024-01-01 03:00:00' AS taken_at FROM ({_TOTALS}) t WHERE share_id IN (SELECT share_id FROM est_shares WHERE enabled)")
def daily_snapshot(e: Estate) -> DataFrame:
    snap = L.snapshot(e.folders, e.files, e.plan, e.shares, "2024-01-01", "2024-01-01 03:00:00")
    return snap.withColumns({"day": F.col("day").cast("string"), "taken_at": F.col("taken_at").cast("string")})


_HISTORY = """SELECT CAST(o_orderkey % 20 AS INT) AS share_id, CAST(o_orderdate AS DATE) AS day, o_orderdate + to_seconds(o_orderkey % 86399) AS taken_at,
    o_orderkey % 900 AS files_total, o_orderkey % 450 AS files_in_plan, o_orderkey % 5 AS files_checked, o_orderkey % 2 AS files_misnamed FROM orders"""
_LATEST = f"SELECT share_id, day, unnest(arg_max(struct_pack(taken_at, files_total, files_in_plan, files_checked, files_misnamed), taken_at)) FROM ({_HISTORY}) GROUP BY 1, 2"


def history(e: Estate) -> DataFrame:
    """Snapshots taken over the years, several on some days, from the dates of orders."""
    key = F.col("o_orderkey")
    return e.table("orders").select(
        (key % 20).cast("int").alias("share_id"), F.to_date("o_orderdate").alias("day"),
        F.expr("timestampadd(SECOND, CAST(o_orderkey % 86399 AS INT), o_orderdate)").alias("taken_at"),
        (key % 900).alias("files_total"), (key % 450).alias("files_in_plan"), (key % 5).alias("files_checked"),
        (key % 2).alias("files_misnamed"))


@query("S9", f"SELECT share_id, CAST(day AS VARCHAR) AS day, CAST(taken_at AS VARCHAR) AS taken_at, files_total, files_in_plan, files_checked, files_misnamed FROM ({_LATEST})")
def snapshot_upsert(e: Estate) -> DataFrame:
    rows = history(e)
    merged = L.upsert_snapshots(rows.filter("files_total < 300"), rows.filter("files_total >= 300"))
    return merged.withColumns({"day": F.col("day").cast("string"), "taken_at": F.col("taken_at").cast("string")})


@query("L24 L25", f"""SELECT share_id, s.name AS share, CAST(day AS VARCHAR) AS day, files_total, CASE WHEN files_total > 0 THEN floor(files_in_plan / files_total * 1000 + 0.5) / 10 END AS in_plan_pct,
    CASE WHEN files_checked > 0 THEN floor((files_checked - files_misnamed) / files_checked * 1000 + 0.5) / 10 END AS well_named_pct
    FROM ({_LATEST}) JOIN est_shares s USING (share_id) WHERE day >= DATE '1998-08-02' - 400""")
def plan_progress(e: Estate) -> DataFrame:
    rows = history(e)
    merged = L.upsert_snapshots(rows.limit(0), rows)
    return L.progress(merged, e.shares, "1998-08-02", 400).select(
        "share_id", "share", F.col("day").cast("string").alias("day"), "files_total",
        F.col("in_plan_pct").cast("double").alias("in_plan_pct"), F.col("well_named_pct").cast("double").alias("well_named_pct"))
