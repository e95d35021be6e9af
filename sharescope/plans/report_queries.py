"""Inventory, hygiene, join shapes and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import duplicates as D
from ..operators import folderplan as L
from ..operators import reports as R
from ..session import materialize
from ..sources.derived import AS_OF, Estate
from . import base_sql as S
from .registry import query


def text(*columns: str) -> list:
    """Times as text, the same in every engine."""
    return [F.col(c).cast("string").alias(c) for c in columns]


# ── Inventory ────────────────────────────────────────────────────────────────

@query("G1 J2 J8", """SELECT s.share_id, s.name AS share, s.path, s.enabled, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes,
    coalesce(folders, 0) AS folders, r.status AS last_scan_status, CAST(r.finished_at AS VARCHAR) AS last_scan_finished
    FROM est_shares s LEFT JOIN (SELECT share_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM est_files GROUP BY 1) f USING (share_id)
    LEFT JOIN (SELECT share_id, count(*) AS folders FROM est_folders GROUP BY 1) d USING (share_id)
    LEFT JOIN est_runs r ON r.run_id = (SELECT max(run_id) FROM est_runs x WHERE x.share_id = s.share_id)""")
def share_summary(e: Estate) -> DataFrame:
    return R.summary(e.shares, e.files, e.folders, e.scan_runs).withColumn(
        "last_scan_finished", F.col("last_scan_finished").cast("string"))


@query("G2", """SELECT CASE WHEN extension = '' THEN '(none)' ELSE extension END AS extension, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes
    FROM est_files GROUP BY 1 ORDER BY bytes DESC, 1 LIMIT 5""")
def heaviest_extensions(e: Estate) -> DataFrame:
    return R.by_extension(e.files, 5)


@query("G3", """SELECT b.ordinal::INT AS ordinal, b.bucket, count(f.file_id) AS files, CAST(coalesce(sum(f.size), 0) AS BIGINT) AS bytes
    FROM (VALUES (0, '< 1 year'), (1, '1-3 years'), (2, '3-5 years'), (3, '5-10 years'), (4, '> 10 years'), (5, 'unknown')) b(ordinal, bucket)
    LEFT JOIN (SELECT *, CASE WHEN mtime IS NULL THEN 5 WHEN mtime >= TIMESTAMP '2024-01-01' - INTERVAL 365 DAY THEN 0
    WHEN mtime >= TIMESTAMP '2024-01-01' - INTERVAL 1095 DAY THEN 1 WHEN mtime >= TIMESTAMP '2024-01-01' - INTERVAL 1825 DAY THEN 2
    WHEN mtime >= TIMESTAMP '2024-01-01' - INTERVAL 3650 DAY THEN 3 ELSE 4 END AS k FROM est_files) f ON f.k = b.ordinal GROUP BY 1, 2""")
def files_by_age(e: Estate) -> DataFrame:
    return R.by_age(e.files, AS_OF)


@query("G4", rf"""SELECT {S.show('s.path', 'f.fpath')} AS folder, count(*) AS stale_files, CAST(sum(f.size) AS BIGINT) AS stale_bytes,
    CAST(max(f.mtime) AS VARCHAR) AS newest_stale FROM est_files f JOIN est_shares s USING (share_id)
    WHERE f.mtime < TIMESTAMP '2024-01-01' - INTERVAL 1825 DAY GROUP BY 1 ORDER BY stale_bytes DESC, folder""")
def stale_folders(e: Estate) -> DataFrame:
    return R.stale_folders(e.files, e.folders, e.shares, AS_OF).withColumn("newest_stale", F.col("newest_stale").cast("string"))


_LONG = rf"""SELECT {S.show('s.path', 'f.fpath', 'f.name')} AS path, length(s.path) + length(f.fpath) + length(f.name) + 2 AS length
    FROM est_files f JOIN est_shares s USING (share_id)"""


@query("G5", f"SELECT * FROM ({_LONG}) WHERE length > 60")
def long_paths(e: Estate) -> DataFrame:
    return R.long_paths(e.files, e.folders, e.shares, longer_than=60)


_DEEP = f"SELECT {S.show('s.path', 'd.path')} AS path, d.depth FROM est_folders d JOIN est_shares s USING (share_id) WHERE d.depth > 8"
_EMPTY = f"""SELECT {S.show('s.path', 'd.path')} AS path FROM est_folders d JOIN est_shares s USING (share_id) WHERE d.path <> '' AND d.list_error IS NULL
    AND NOT EXISTS (SELECT 1 FROM est_files f WHERE f.folder_id = d.folder_id)
    AND NOT EXISTS (SELECT 1 FROM est_folders c WHERE c.share_id = d.share_id AND c.path <> '' AND {S.parent('c.path')} = d.path)"""
_UNLISTED = f"SELECT {S.show('s.path', 'd.path')} AS path, d.list_error AS error FROM est_folders d JOIN est_shares s USING (share_id) WHERE d.list_error IS NOT NULL"


@query("G6 S10", f"SELECT * FROM ({_DEEP})")
def deep_folders(e: Estate) -> DataFrame:
    return R.deep_folders(e.folders, e.shares)


@query("G7 J4", _EMPTY)
def empty_folders(e: Estate) -> DataFrame:
    return R.empty_folders(e.files, e.folders, e.shares)


@query("G8", _UNLISTED)
def unlisted_folders(e: Estate) -> DataFrame:
    return R.unlisted_folders(e.folders, e.shares)


@query("G5 G6 G7 G8", f"""SELECT 'long path' AS issue, count(*) AS count FROM ({_LONG}) WHERE length > 240
    UNION ALL SELECT 'deep folder', count(*) FROM ({_DEEP}) UNION ALL SELECT 'empty folder', count(*) FROM ({_EMPTY})
    UNION ALL SELECT 'could not list', count(*) FROM ({_UNLISTED})""")
def hygiene_counts(e: Estate) -> DataFrame:
    return R.hygiene_counts(e.files, e.folders, e.shares)


@query("G13", f"""SELECT 'long path' AS issue, path, CAST(length AS VARCHAR) AS detail FROM ({_LONG}) WHERE length > 240
    UNION ALL SELECT * FROM (SELECT 'deep folder', path, CAST(depth AS VARCHAR) FROM ({_DEEP}) )
    UNION ALL SELECT * FROM (SELECT 'empty folder', path, '' FROM ({_EMPTY}) )
    UNION ALL SELECT * FROM (SELECT 'could not list', path, error FROM ({_UNLISTED}) )""")
def hygiene_export(e: Estate) -> DataFrame:
    return R.hygiene_rows(e.files, e.folders, e.shares)


@query("G14 S10", "SELECT run_id, share_id, status, CAST(finished_at AS VARCHAR) AS finished_at FROM est_runs")
def scan_history(e: Estate) -> DataFrame:
    return R.scan_history(e.scan_runs).select("run_id", "share_id", "status", *text("finished_at"))


@query("S10", "SELECT file_id, name FROM est_files ORDER BY lower(name), file_id LIMIT 40 OFFSET 120")
def name_page(e: Estate) -> DataFrame:
    return R.page(e.files.select("file_id", "name"), [F.lower("name"), "file_id"], 40, 120)


# ── Duplicates ───────────────────────────────────────────────────────────────

def sized(e: Estate) -> DataFrame:
    """Files with the size of their stored bytes and no hash yet."""
    blob = F.encode("content", "UTF-8")
    return e.files.select("file_id", "share_id", "folder_id", "name", "mtime", F.length(blob).cast("long").alias("size"),
                          F.lit(None).cast("string").alias("quick_hash"), F.lit(None).cast("string").alias("content_hash"))


def contents(e: Estate) -> DataFrame:
    return e.files.select("file_id", F.encode("content", "UTF-8").alias("content"))


def hashed(e: Estate) -> DataFrame:
    return materialize(D.hash_stage(sized(e), contents(e)))


@query("D1", "SELECT file_id, bytes AS size FROM sized WHERE bytes IN (SELECT bytes FROM sized WHERE bytes >= 1024 GROUP BY bytes HAVING count(*) > 1)")
def shared_sizes(e: Estate) -> DataFrame:
    return D.size_candidates(sized(e)).select("file_id", "size")


@query("D2", """SELECT file_id, sha256(encode(CAST(bytes AS VARCHAR)) || array_slice(encode(content), 1, 256)
    || CASE WHEN bytes > 512 THEN array_slice(encode(content), bytes - 255, bytes) WHEN bytes > 256 THEN array_slice(encode(content), 257, bytes) ELSE ''::BLOB END) AS quick_hash FROM sized""")
def quick_hashes(e: Estate) -> DataFrame:
    blob = F.encode("content", "UTF-8")
    return e.files.select("file_id", D.quick_hash(F.length(blob).cast("long"), blob, 256).alias("quick_hash"))


@query("D3", """SELECT file_id FROM sized WHERE file_id % 4 <> 0 AND bytes IN (SELECT bytes FROM sized WHERE bytes >= 1024 GROUP BY bytes HAVING count(*) > 1)""")
def missing_hashes(e: Estate) -> DataFrame:
    known = sized(e).withColumn("quick_hash", F.expr("CASE WHEN file_id % 4 = 0 THEN 'known' END"))
    return D.need_quick_hash(known).select("file_id")


@query("D4 D5 J7", """SELECT file_id, content_hash FROM hashed WHERE (bytes, content_hash) IN
    (SELECT (bytes, content_hash) FROM hashed GROUP BY bytes, content_hash HAVING count(*) > 1)""")
def colliding_files(e: Estate) -> DataFrame:
    return hashed(e).filter("content_hash IS NOT NULL").select("file_id", "content_hash")


_GROUPS = """SELECT bytes AS size, content_hash AS key, count(*) AS copies, CAST(bytes * (count(*) - 1) AS BIGINT) AS wasted_bytes,
    'exact' AS confidence FROM hashed GROUP BY 1, 2 HAVING count(*) > 1"""


@query("D6", f"SELECT * FROM ({_GROUPS}) ORDER BY wasted_bytes DESC, size, key LIMIT 50")
def duplicate_groups(e: Estate) -> DataFrame:
    return D.group_page(hashed(e))


@query("D7", f"SELECT count(*) AS total_groups, CAST(sum(wasted_bytes) AS BIGINT) AS total_wasted_bytes FROM ({_GROUPS})")
def duplicate_totals(e: Estate) -> DataFrame:
    return D.totals(hashed(e))


@query("D8 G13", f"""SELECT g.size, g.key, g.copies, g.wasted_bytes, g.confidence, h.file_id, {S.show('s.path', 'h.fpath', 'h.name')} AS path, CAST(h.mtime AS VARCHAR) AS mtime
    FROM (SELECT * FROM ({_GROUPS}) ORDER BY wasted_bytes DESC, size, key LIMIT 50) g JOIN hashed h ON h.bytes = g.size AND h.content_hash = g.key
    JOIN est_shares s USING (share_id)""")
def duplicate_members(e: Estate) -> DataFrame:
    return D.group_members(hashed(e), e.folders, e.shares, limit=50).withColumn("mtime", F.col("mtime").cast("string"))


@query("D8 G13", f"""SELECT g.size, g.key, g.copies, g.wasted_bytes, g.confidence, h.file_id, {S.show('s.path', 'h.fpath', 'h.name')} AS path, CAST(h.mtime AS VARCHAR) AS mtime
    FROM ({_GROUPS}) g JOIN hashed h ON h.bytes = g.size AND h.content_hash = g.key JOIN est_shares s USING (share_id)""")
def duplicate_members_whole(e: Estate) -> DataFrame:
    """The files of every group; `duplicate_members` has those of the first page."""
    return D.group_members(hashed(e), e.folders, e.shares).withColumn("mtime", F.col("mtime").cast("string"))


@query("D9", """SELECT (SELECT count(*) FROM hashed WHERE file_id % 10 <> 3) AS quick_hashed,
    (SELECT count(*) FROM hashed h WHERE file_id % 10 <> 3 AND (SELECT count(*) FROM hashed o WHERE o.file_id % 10 <> 3 AND o.bytes = h.bytes AND o.content_hash = h.content_hash) > 1) AS full_hashed,
    (SELECT count(*) FROM hashed WHERE file_id % 10 = 3) AS errors""")
def hashing_statistics(e: Estate) -> DataFrame:
    """A run in which one file in ten can't be read: its hash stays missing and it counts as an error."""
    readable = contents(e).filter("file_id % 10 <> 3")
    before = sized(e)
    return D.stage_statistics(before, D.hash_stage(before, readable))


# ── Join shapes ──────────────────────────────────────────────────────────────

@query("J9", """SELECT folder_id, entry_path, status FROM placed""")
def nearest_planned_folder(e: Estate) -> DataFrame:
    return L.placements(e.folders, e.plan).select("folder_id", "entry_path", "status")


@query("J3 I5", f"""SELECT file_id, CASE WHEN extension IN ('dwg', 'zip', '') THEN 'metadata' ELSE 'pending' END AS status
    FROM est_files WHERE file_id NOT IN (SELECT file_id FROM est_some_docs)""")
def files_without_index(e: Estate) -> DataFrame:
    from ..operators import indexing as I
    return I.add_missing(e.files, e.some_documents)
