"""Scans in a row, the index that follows them, and stored versions."""

from __future__ import annotations

import uuid

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import indexing as I
from ..operators import liveindex as LI
from ..operators import scanning as SC
from ..session import materialize, shared_folder
from ..sources.derived import Estate
from ..sources.versions import Change, Store
from . import base_sql as S
from .registry import query

NOW = ["2024-02-01 00:00:00", "2024-02-02 00:00:00", "2024-02-03 00:00:00"]


def new_store(e: Estate) -> Store:
    return Store(e.spark, f"{shared_folder(e.spark)}/store-{uuid.uuid4().hex}")


# ── Three scans ──────────────────────────────────────────────────────────────

def catalogue(e: Estate) -> dict[str, DataFrame]:
    """The catalogue before the first scan, hashed and read throughout."""
    files = e.files.select(
        "file_id", "share_id", "folder_id", F.col("fpath").alias("path"), "name", "extension", "size", "mtime", F.col("mtime").alias("ctime"), F.concat(F.lit("q"), "file_id").alias("quick_hash"),
        F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("timestamp_ntz").alias("indexed_at"), F.col("acl_id").cast("string").alias("acl_id"))
    folders = e.folders.withColumns({"acl_id": F.col("acl_id").cast("string"), "mtime": F.lit(None).cast("timestamp_ntz")})
    states = e.documents.join(e.files.select("file_id", "share_id"), "file_id").select("share_id", "file_id", "status", "error")
    return {"folders": folders, "files": files, "documents": states}


def unlisted(e: Estate, number: int) -> DataFrame:
    """Folders a scan could not list: some in the first, others in the second, none in the third."""
    where = ["(path = 'en' AND share_id % 4 = 1) OR (path = '' AND share_id % 9 = 4)", "path = 'es' AND share_id % 3 = 0", "false"][number]
    return e.folders.filter(where).select("share_id", "path", F.concat(F.lit(f"scan {number}: "), F.lpad("path", 600, ".")).alias("message"))


def listings(e: Estate) -> list[DataFrame]:
    """Three listings: changed, changed back, and changed once more with half a second's difference everywhere."""
    first = e.listing.withColumn("ctime", F.col("mtime"))
    files = e.files.filter("file_id % 23 <> 0").select(
        "share_id", F.col("fpath").alias("path"), "name", F.lit(False).alias("is_dir"), "size", "mtime", F.lit(False).alias("is_reparse_point"), F.col("mtime").alias("ctime"))
    folders = first.filter("is_dir AND name <> 'Nueva'").unionByName(e.folders.filter("path <> '' AND share_id % 5 = 0 AND path LIKE '%/d3%'").select(
        "share_id", F.expr("regexp_extract(path, '^(.*)/[^/]*$', 1)").alias("path"), "name", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"),
        F.lit(None).cast("timestamp_ntz").alias("mtime"), F.lit(False).alias("is_reparse_point"), F.lit(None).cast("timestamp_ntz").alias("ctime")))
    late = first.withColumns({c: F.col(c) + F.expr("INTERVAL '0.5' SECOND") for c in ("mtime", "ctime")})
    return [first, files.unionByName(folders), late]


def with_stored_folders(e: Estate) -> Estate:
    """The estate with its shares and folders computed once, as every listing is made from them."""
    out = Estate(e.spark, e.folder)
    out.shares = materialize(e.shares)
    out.folders = materialize(out.folders)
    return out


def scanned(e: Estate) -> Store:
    e, store = with_stored_folders(e), new_store(e)
    SC.start_catalogue(store, catalogue(e))
    for number, listing in enumerate(listings(e)):
        SC.scan_into(store, listing, unlisted(e, number), NOW[number])
    return store


_OK = """NOT (lower(name) IN ('thumbs.db', 'desktop.ini', '.ds_store', '$recycle.bin', 'system volume information', 'dfsrprivate', '~snapshot')
    OR starts_with(name, '~$') OR (is_dir AND is_reparse_point))"""
_BLIND = """EXISTS (SELECT 1 FROM u{n} u WHERE u.share_id = {t}.share_id AND (u.path = '' OR u.path = {t}.path OR starts_with({t}.path, u.path || '/')))"""
_BELOW = """EXISTS (SELECT 1 FROM u{n} u WHERE u.share_id = {t}.share_id AND {t}.path <> u.path AND (u.path = '' OR starts_with({t}.path, u.path || '/')))"""
_FILES_STEP = """f{n} AS MATERIALIZED (SELECT f.* FROM f{p} f WHERE {blind_f} UNION ALL
  SELECT coalesce(k.file_id, ('0x' || substr(md5(concat_ws('|', s.share_id, s.path, s.name)), 1, 15))::BIGINT), s.share_id, s.path, s.name,
    CASE WHEN same THEN k.size ELSE s.size END, CASE WHEN same THEN k.mtime ELSE s.mtime END, CASE WHEN same THEN k.quick_hash END, CASE WHEN same THEN k.indexed_at ELSE '{now}' END
  FROM (SELECT * FROM l{n} l WHERE NOT is_dir AND NOT {blind_l}) s LEFT JOIN f{p} k USING (share_id, path, name)
  CROSS JOIN LATERAL (SELECT k.file_id IS NOT NULL AND k.size = s.size AND ((k.mtime IS NULL AND s.mtime IS NULL) OR coalesce(abs(epoch_us(k.mtime) - epoch_us(s.mtime)) < 1000000, false)) AS same))"""
_FOLDERS_STEP = """d{n} AS MATERIALIZED (SELECT d.* FROM d{p} d WHERE {below_d} UNION ALL
  SELECT s.share_id, s.path, CASE WHEN u.share_id IS NOT NULL THEN substr('scan {p}: ' || lpad(u.path, 600, '.'), 1, 500) END FROM (
    SELECT share_id, CASE WHEN path = '' THEN name ELSE path || '/' || name END AS path FROM l{n} WHERE is_dir UNION SELECT share_id, '' FROM d0 UNION SELECT share_id, path FROM u{n}) s
  LEFT JOIN u{n} u USING (share_id, path) WHERE NOT {below_s})"""


def _scans(blind: str = "(path = 'en' AND share_id % 4 = 1) OR (path = '' AND share_id % 9 = 4)") -> str:
    """Listings `l1`..`l3`, unlisted folders `u1`..`u3`, and the tables `f0`..`f3` and `d0`..`d3` before and after each scan. `blind`: what the first can't list."""
    parts = [f"l1 AS MATERIALIZED (SELECT share_id, path, name, is_dir, size, mtime FROM est_listing WHERE {_OK})",
             f"""l2 AS MATERIALIZED (SELECT share_id, fpath AS path, name, false AS is_dir, size, mtime FROM est_files WHERE file_id % 23 <> 0
  UNION ALL SELECT share_id, path, name, true, 0, NULL FROM est_listing WHERE is_dir AND name <> 'Nueva' AND {_OK}
  UNION ALL SELECT share_id, {S.parent('path')}, name, true, 0, NULL FROM est_folders WHERE path <> '' AND share_id % 5 = 0 AND path LIKE '%/d3%')""",
             "l3 AS MATERIALIZED (SELECT share_id, path, name, is_dir, size, mtime + INTERVAL 500 MILLISECOND AS mtime FROM l1)",
             f"u1 AS (SELECT share_id, path FROM est_folders WHERE {blind})",
             "u2 AS (SELECT share_id, path FROM est_folders WHERE path = 'es' AND share_id % 3 = 0)", "u3 AS (SELECT share_id, path FROM est_folders WHERE false)",
             "f0 AS (SELECT file_id, share_id, fpath AS path, name, size, mtime, 'q' || file_id AS quick_hash, NULL::VARCHAR AS indexed_at FROM est_files)",
             "d0 AS (SELECT share_id, path, list_error FROM est_folders)"]
    for n in (1, 2, 3):
        parts.append(_FILES_STEP.format(n=n, p=n - 1, now=NOW[n - 1], blind_f=_BLIND.format(n=n, t="f"), blind_l=_BLIND.format(n=n, t="l")))
        parts.append(_FOLDERS_STEP.format(n=n, p=n - 1, below_d=_BELOW.format(n=n, t="d"), below_s=_BELOW.format(n=n, t="s")))
    return ",\n".join(parts)


@query("R3 R4 S6 G8", f"WITH {_scans()} SELECT share_id, share_id || ':' || path AS folder_id, path, CAST({S.depth('path')} AS BIGINT) AS depth, list_error FROM d3")
def folders_after_scans(e: Estate) -> DataFrame:
    """Folders after three scans: markers set, kept below what nobody looked at, and cleared."""
    return scanned(e).read("folders").select("share_id", "folder_id", "path", "depth", "list_error")


@query("R2 R4 R6 S6", f"WITH {_scans()} SELECT file_id, share_id, share_id || ':' || path AS folder_id, name, size, CAST(mtime AS VARCHAR) AS mtime, quick_hash, indexed_at FROM f3")
def files_after_scans(e: Estate) -> DataFrame:
    """Files after three scans, ids of added rows included."""
    return scanned(e).read("files").select(
        "file_id", "share_id", "folder_id", "name", "size", F.col("mtime").cast("string").alias("mtime"), "quick_hash", F.col("indexed_at").cast("string").alias("indexed_at"))


# ── Versions ─────────────────────────────────────────────────────────────────

@query("S5 S6", "SELECT 'before' AS at, file_id, name FROM est_files UNION ALL SELECT 'during', file_id, name FROM est_files "
       "UNION ALL SELECT 'after', file_id, CASE WHEN share_id % 2 = 1 THEN upper(name) ELSE name END FROM est_files WHERE share_id % 4 <> 3")
def versions_of_files(e: Estate) -> DataFrame:
    """A write that breaks off leaves the version before it; the one that succeeds replaces some shares and empties others, and old versions can still be read."""
    store, files = new_store(e), e.files.select("file_id", "share_id", "name")
    first = store.commit({"files": Change(files, "share_id")})
    odd = files.filter("share_id % 4 = 1").withColumn("name", F.upper("name"))
    last = files.agg(F.max("file_id")).first()[0]
    broken = odd.unionByName(files.filter(F.col("file_id") == last).withColumn("name", F.raise_error(F.lit("cut short")).cast("string")))
    try:
        store.commit({"files": Change(broken, "share_id", "own")})
    except SparkRuntimeException:
        pass
    during = store.read("files").select(F.lit("during").alias("at"), "file_id", "name")
    gone = [r[0] for r in e.shares.filter("share_id % 2 = 1").select("share_id").collect()]
    store.commit({"files": Change(odd, "share_id", tuple(gone))})
    tell = lambda name, df: df.select(F.lit(name).alias("at"), "file_id", "name")
    return tell("before", store.read("files", first)).unionByName(during).unionByName(tell("after", store.read("files")))


# ── The index after a scan ───────────────────────────────────────────────────

def indexed_scan(e: Estate, compact: bool) -> Store:
    """The index of the estate, brought up to date after one scan that adds, changes and removes files."""
    e = with_stored_folders(e)
    catalogue_, index = new_store(e), new_store(e)
    tables = catalogue(e)
    SC.start_catalogue(catalogue_, tables)
    LI.start_index(index, e.files, e.folders, e.shares, e.documents)
    before = catalogue_.manifest().version
    changes = SC.scan_into(catalogue_, e.listing, e.folders.filter("false").select("share_id", "path", F.lit("").alias("message")), NOW[0])
    files, folders = catalogue_.read("files"), catalogue_.read("folders")
    added = files.join(catalogue_.read("files", before).select("file_id"), "file_id", "left_anti")
    # What was changed has been read again: its own text, behind a word of its own.
    updated = changes.filter("change = 'updated'").select("file_id").join(e.documents.select("file_id", "content"), "file_id").withColumn("content", F.concat_ws(" ", F.lit("Revisado"), "content"))
    LI.update_index(index, changes.filter("change = 'removed'").select("file_id"), added, updated, folders, e.shares)
    if compact:
        LI.compact_index(index, [b for b in range(I.POSTING_BUCKETS) if b % 3])
    return index


_INDEXED = f"""WITH {_scans("false")},
known AS (SELECT f1.*, e.content, f1.quick_hash IS NULL AS fresh FROM f1 LEFT JOIN est_docs e USING (file_id)),
texts AS (SELECT file_id, 'A' AS field, name AS t FROM known UNION ALL SELECT file_id, 'B', s.name || ' ' || k.path FROM known k JOIN est_shares s USING (share_id)
    UNION ALL SELECT file_id, 'C', CASE WHEN fresh THEN 'Revisado ' ELSE '' END || content FROM known WHERE content IS NOT NULL),
posts AS (SELECT file_id, field, unnest({S.word_list('t')}) AS word, unnest(range(0, len({S.word_list('t')}))) AS pos FROM texts)
SELECT word, field, count(*) AS n, count(DISTINCT file_id) AS files, sum(pos)::BIGINT AS places, sum(file_id % 1000003)::BIGINT AS ids FROM posts GROUP BY ALL"""


def _by_word(rows: DataFrame) -> DataFrame:
    """Postings of a word and field in figures that any lost, stale or doubled one would change."""
    files = rows.groupBy("word", "field", "file_id").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))
    return files.groupBy("word", "field").agg(F.sum("n").alias("n"), F.count("*").alias("files"), F.sum("places").alias("places"), F.sum(F.col("n") * (F.col("file_id") % 1000003)).alias("ids"))


@query("R6 I7 I8", _INDEXED)
def index_after_scan(e: Estate) -> DataFrame:
    """Base, later round and tombstones, merged as they are read, against an index built from scratch."""
    return _by_word(LI.dealt_postings(indexed_scan(e, False)))


@query("R6 I7 I8", _INDEXED)
def index_compacted(e: Estate) -> DataFrame:
    """The same after two thirds of the buckets were compacted."""
    return _by_word(LI.dealt_postings(indexed_scan(e, True)))


@query("I10", f"""WITH texts AS (SELECT file_id, 'A' AS field, name AS t FROM est_files UNION ALL SELECT file_id, 'B', CASE WHEN s.share_id = 3 THEN 'Renombrado' ELSE s.name END || ' ' || f.fpath FROM est_files f JOIN est_shares s USING (share_id)
    UNION ALL SELECT file_id, 'C', content FROM est_docs), posts AS (SELECT file_id, field, unnest({S.word_list('t')}) AS word, unnest(range(0, len({S.word_list('t')}))) AS pos FROM texts)
    SELECT word, field, count(*) AS n, count(DISTINCT file_id) AS files, sum(pos)::BIGINT AS places, sum(file_id % 1000003)::BIGINT AS ids FROM posts GROUP BY ALL""")
def index_after_rename(e: Estate) -> DataFrame:
    """The whole index after a share got a new name, of which only places were written."""
    index = new_store(e)
    LI.start_index(index, e.files, e.folders, e.shares, e.documents)
    renamed = e.shares.withColumn("name", F.when(F.col("share_id") == 3, "Renombrado").otherwise(F.col("name")))
    LI.rename_in_index(index, e.files.filter("share_id = 3"), e.folders, renamed)
    return _by_word(LI.dealt_postings(index))
