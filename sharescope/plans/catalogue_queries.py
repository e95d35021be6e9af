"""Reconciliation of listings, the index life cycle, and text extraction."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import indexing as I
from ..operators import reconcile as C
from ..session import shared_folder
from ..sources import catalogue as K
from ..sources import texts as TX
from ..sources.derived import Estate
from . import base_sql as S
from .registry import query

NOW = "2024-02-01 00:00:00"


def catalogue(e: Estate) -> DataFrame:
    return e.files.select("share_id", F.col("fpath").alias("path"), "name", "file_id", "size", "mtime")


def unlisted(e: Estate) -> DataFrame:
    """Folders this scan could not list."""
    return e.folders.filter("(path = 'en' AND share_id % 4 = 1) OR (path = '' AND share_id % 9 = 4)").select("share_id", "path")


def errors(e: Estate) -> DataFrame:
    lists = unlisted(e).select("share_id", "path", F.lit("list").alias("kind"), F.concat(F.lit("list "), "path").alias("message"))
    acls = e.folders.filter("acl_error IS NOT NULL").select("share_id", "path", F.lit("acl").alias("kind"), F.concat(F.lit("ACL "), "path").alias("message"))
    return lists.unionByName(acls)


_OK = """NOT (lower(name) IN ('thumbs.db', 'desktop.ini', '.ds_store', '$recycle.bin', 'system volume information', 'dfsrprivate', '~snapshot')
    OR starts_with(name, '~$') OR (is_dir AND is_reparse_point))"""
_SEEN = f"SELECT * FROM est_listing WHERE {_OK}"
_CHANGES = f"""SELECT coalesce(k.share_id, s.share_id) AS share_id, coalesce(k.path, s.path) AS path, coalesce(k.name, s.name) AS name, k.file_id,
    CASE WHEN k.share_id IS NULL THEN 'added' WHEN s.share_id IS NULL THEN 'removed' WHEN k.size <> s.size OR NOT ((k.mtime IS NULL AND s.mtime IS NULL)
        OR coalesce(abs(epoch_us(k.mtime) - epoch_us(s.mtime)) < 1000000, false)) THEN 'updated' ELSE 'unchanged' END AS change, s.share_id IS NOT NULL AS seen,
    CASE WHEN s.share_id IS NOT NULL THEN s.size ELSE k.size END AS size, CASE WHEN s.share_id IS NOT NULL THEN s.mtime ELSE k.mtime END AS mtime
    FROM (SELECT share_id, fpath AS path, name, file_id, size, mtime FROM est_files) k FULL JOIN (SELECT * FROM ({_SEEN}) WHERE NOT is_dir) s USING (share_id, path, name)"""
_BLIND = """EXISTS (SELECT 1 FROM est_folders u WHERE ((u.path = 'en' AND u.share_id % 4 = 1) OR (u.path = '' AND u.share_id % 9 = 4)) AND u.share_id = {t}.share_id
    AND (u.path = '' OR u.path = {t}.path OR starts_with({t}.path, u.path || '/')))"""


@query("S1 R1", f"SELECT share_id, path, name, is_dir FROM ({_SEEN})")
def accepted_entries(e: Estate) -> DataFrame:
    return C.accepted_entries(e.listing).select("share_id", "path", "name", "is_dir")


@query("R2 J10 X19", f"SELECT share_id, path, name, file_id, change, size, CAST(mtime AS VARCHAR) AS mtime FROM ({_CHANGES})")
def file_changes(e: Estate) -> DataFrame:
    return C.file_changes(e.listing, catalogue(e)).select(
        "share_id", "path", "name", "file_id", "change", "size", F.col("mtime").cast("string").alias("mtime"))


_PARTIAL = f"""SELECT share_id, path, name, file_id, change, seen FROM ({_CHANGES}) c WHERE NOT {_BLIND.format(t='c')}
    UNION ALL SELECT share_id, fpath, name, file_id, 'unchanged', false FROM (SELECT *, fpath AS path FROM est_files) f WHERE {_BLIND.format(t='f')}"""


@query("R4", f"SELECT share_id, path, name, file_id, change FROM ({_PARTIAL})")
def changes_with_unlisted(e: Estate) -> DataFrame:
    return C.file_changes(e.listing, catalogue(e), unlisted(e)).select("share_id", "path", "name", "file_id", "change")


_TREE = f"""SELECT coalesce(k.share_id, s.share_id) AS share_id, coalesce(k.path, s.path) AS path,
    CASE WHEN k.share_id IS NULL THEN 'added' WHEN s.share_id IS NULL THEN 'removed' ELSE 'unchanged' END AS change
    FROM (SELECT share_id, path FROM est_folders) k FULL JOIN (SELECT share_id, CASE WHEN path = '' THEN name ELSE path || '/' || name END AS path FROM ({_SEEN}) WHERE is_dir
        UNION SELECT share_id, '' FROM est_folders) s USING (share_id, path)"""


@query("R3", f"SELECT share_id, path, change, CAST({S.depth('path')} AS BIGINT) AS depth FROM ({_TREE})")
def folder_changes(e: Estate) -> DataFrame:
    return C.folder_changes(e.listing, e.folders).select("share_id", "path", "change", "depth")


@query("R6 S6", f"""SELECT c.share_id, path, c.name, c.file_id, {S.extension('c.name')} AS extension, c.size, CASE WHEN change = 'unchanged' THEN 'q' || c.file_id END AS quick_hash,
    CASE WHEN change IN ('added', 'updated') THEN '2024-02-01 00:00:00' END AS indexed_at, f.acl_id FROM ({_CHANGES}) c LEFT JOIN est_files f USING (file_id) WHERE change <> 'removed'""")
def next_file_table(e: Estate) -> DataFrame:
    old = e.files.withColumn("quick_hash", F.concat(F.lit("q"), "file_id")).withColumn("indexed_at", F.lit(None).cast("timestamp_ntz"))
    new = C.next_files(old, C.file_changes(e.listing, catalogue(e)), NOW)
    return new.select("share_id", "path", "name", "file_id", "extension", "size", "quick_hash",
                      F.col("indexed_at").cast("string").alias("indexed_at"), "acl_id")


@query("R6 X21", f"""SELECT d.file_id, CASE WHEN c.change = 'updated' THEN CASE WHEN {S.extension('c.name')} IN ('dwg', 'zip', '') THEN 'metadata' ELSE 'pending' END ELSE d.status END AS status, d.error
    FROM est_docs d LEFT JOIN ({_CHANGES}) c USING (file_id) WHERE coalesce(c.change, 'unchanged') <> 'removed'""")
def next_index_states(e: Estate) -> DataFrame:
    return C.next_documents(e.documents.select("file_id", "status", "error"), C.file_changes(e.listing, catalogue(e)))


@query("R5 R9 A3", """SELECT share_id, path, CASE WHEN share_id % 5 = 1 THEN NULL WHEN depth % 3 = 2 THEN NULL ELSE 'new' || depth END AS acl_id,
    CASE WHEN share_id % 5 = 1 THEN NULL WHEN depth % 3 = 2 THEN owner_sid ELSE 'owner' || share_id END AS owner_sid,
    CASE WHEN share_id % 5 <> 1 AND depth % 3 = 2 THEN 'ACL truncated' END AS acl_error FROM est_folders""")
def permission_refresh(e: Estate) -> DataFrame:
    bad = F.col("depth") % 3 == 2
    decoded = e.folders.filter("share_id % 5 <> 1").select(
        "share_id", "path", F.when(~bad, F.concat(F.lit("new"), "depth")).alias("new_acl_id"),
        F.when(~bad, F.concat(F.lit("owner"), "share_id")).alias("new_owner"), F.when(bad, "ACL truncated").alias("error"))
    rows = e.folders.withColumn("acl_id", F.col("acl_id").cast("string"))
    return C.refresh_permissions(rows, decoded).select("share_id", "path", "acl_id", "owner_sid", "acl_error")


_ERRORS = """SELECT share_id, path, 'list' AS kind, 'list ' || path AS message FROM est_folders u WHERE (path = 'en' AND share_id % 4 = 1) OR (path = '' AND share_id % 9 = 4)
    UNION ALL SELECT share_id, path, 'acl', 'ACL ' || path FROM est_folders WHERE acl_error IS NOT NULL"""


@query("R7 R8", f"""SELECT s.share_id, CASE WHEN root_failed THEN 'failed' WHEN error_count > 0 THEN 'partial' ELSE 'success' END AS status, coalesce(files_seen, 0) AS files_seen,
    coalesce(files_added, 0) AS files_added, coalesce(files_updated, 0) AS files_updated, coalesce(files_removed, 0) AS files_removed, coalesce(folders_skipped, 0) AS folders_skipped,
    coalesce(error_count, 0) AS error_count, error_sample FROM est_shares s
    LEFT JOIN (SELECT share_id, count(*) FILTER (seen) AS files_seen, count(*) FILTER (change = 'added') AS files_added, count(*) FILTER (change = 'updated') AS files_updated,
        count(*) FILTER (change = 'removed') AS files_removed FROM ({_PARTIAL}) GROUP BY 1) c USING (share_id)
    LEFT JOIN (SELECT share_id, count(*) AS folders_skipped FROM est_listing WHERE is_dir AND is_reparse_point GROUP BY 1) l USING (share_id)
    LEFT JOIN (SELECT share_id, count(*) AS error_count, bool_or(path = '' AND kind = 'list') AS root_failed,
        array_to_string(list_slice(list(message ORDER BY path, kind, message), 1, 20), chr(10)) AS error_sample FROM ({_ERRORS}) GROUP BY 1) x USING (share_id)""")
def scan_statistics(e: Estate) -> DataFrame:
    blind = unlisted(e)
    changes = C.file_changes(e.listing, catalogue(e), blind)
    tree = C.folder_changes(e.listing, e.folders, blind)
    return C.run_statistics(e.shares, e.listing, changes, tree, errors(e)).drop("folders_seen")


@query("R10", """SELECT 'folders' AS kind, count(*) AS n FROM est_folders WHERE NOT (share_id % 5 = 0 OR path = 'en' OR starts_with(path, 'en/'))
    UNION ALL SELECT 'files', count(*) FROM est_files WHERE NOT (share_id % 5 = 0 OR fpath = 'en' OR starts_with(fpath, 'en/'))
    UNION ALL SELECT 'documents', count(*) FROM est_docs WHERE file_id IN (SELECT file_id FROM est_files WHERE NOT (share_id % 5 = 0 OR fpath = 'en' OR starts_with(fpath, 'en/')))""")
def cascade_delete(e: Estate) -> DataFrame:
    doomed = e.folders.filter("path = 'en' OR (path = '' AND share_id % 5 = 0)").select("share_id", "path")
    left = C.cascade_delete(doomed, e.folders, e.files.drop("content"), e.documents.select("file_id"))
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in left.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# ── Index life cycle ─────────────────────────────────────────────────────────

@query("I6", "SELECT d.file_id FROM est_docs d JOIN est_files f USING (file_id) JOIN est_shares s USING (share_id) WHERE d.status = 'pending' AND s.enabled")
def pending_files(e: Estate) -> DataFrame:
    return I.pending(e.documents, e.files, e.shares).select("file_id")


_OUT = """SELECT file_id, CASE WHEN extension IN ('dwg', 'zip', '') THEN 'metadata' WHEN size > 4000 THEN 'too_large' WHEN file_id % 7 = 0 THEN 'error' WHEN file_id % 5 = 0 AND extension = 'pdf' THEN 'ocr_unavailable'
    WHEN file_id % 5 = 0 THEN 'error' WHEN file_id % 6 = 1 THEN 'empty' ELSE 'text' END AS status FROM est_files"""


def attempts(e: Estate) -> DataFrame:
    """One reading attempt per file: some without permissions, some failing, some without text."""
    failed = F.expr("file_id % 5 = 0")
    return e.files.select(
        "file_id", "extension", "size", F.expr("file_id % 7 <> 0").alias("acl_read"), F.lit(99).alias("new_acl_id"), "acl_id",
        F.when(~failed, F.expr("CASE WHEN file_id % 6 = 1 THEN ' \n\t ' ELSE content END")).alias("text"),
        F.when(failed & (F.col("extension") == "pdf"), "ocr_unavailable").otherwise("text").alias("method"),
        F.when(failed, "unreadable").alias("error"))


@query("I4 R6", f"""SELECT o.file_id, o.status, CASE WHEN o.status = 'text' THEN length(regexp_replace(content, '[ \\t\\r\\f\\x0B]+', ' ', 'g')) > 0 END AS has_text,
    CASE WHEN o.status IN ('metadata', 'too_large') OR o.file_id % 7 = 0 THEN f.acl_id ELSE 99 END AS acl_id FROM ({_OUT}) o JOIN est_files f USING (file_id)""")
def extraction_outcome(e: Estate) -> DataFrame:
    return I.extraction_outcome(attempts(e), 4000).select("file_id", "status", (F.length("content") > 0).alias("has_text"), "acl_id")


_OUT_WHOLE = _OUT.replace(" WHEN size > 4000 THEN 'too_large'", "")
_SP = r"\t-\r\x1c-\x20\x85\p{Z}"


@query("I4 R6", rf"""SELECT file_id, status, length(clean) AS chars, md5(clean) AS digest, acl_id FROM (SELECT o.file_id, o.status,
    CASE WHEN o.status = 'text' THEN regexp_replace(regexp_replace(regexp_replace(content, '[ \t\r\f\x0B]+', ' ', 'g'), '\n[{_SP}]*\n+', E'\n\n', 'g'), '^[{_SP}]+|[{_SP}]+$', '', 'g') END AS clean,
    CASE WHEN o.status = 'metadata' OR o.file_id % 7 = 0 THEN f.acl_id ELSE 99 END AS acl_id FROM ({_OUT_WHOLE}) o JOIN est_files f USING (file_id))""")
def extraction_whole(e: Estate) -> DataFrame:
    """Whole texts of files of every size."""
    return I.extraction_outcome(attempts(e)).select(
        "file_id", "status", F.length("content").cast("long").alias("chars"), F.md5("content").alias("digest"), "acl_id")


@query("I11", "SELECT file_id, CASE WHEN status IN ('error', 'ocr_unavailable') THEN 'pending' ELSE status END AS status FROM est_docs")
def retry_failed(e: Estate) -> DataFrame:
    return I.retry_failed(e.documents).select("file_id", "status")


@query("I12", "SELECT file_id, CASE WHEN status = 'extracting' THEN 'error' ELSE status END AS status, coalesce(error, CASE WHEN status = 'extracting' THEN 'x' END) IS NOT NULL AS has_error FROM est_docs")
def interrupted(e: Estate) -> DataFrame:
    return I.fail_interrupted(e.documents).select("file_id", "status", F.col("error").isNotNull().alias("has_error"))


@query("I13", "SELECT status, count(*) AS n FROM est_some_docs GROUP BY 1 UNION ALL SELECT 'not_indexed', (SELECT count(*) FROM est_files) - (SELECT count(*) FROM est_some_docs)")
def index_states(e: Estate) -> DataFrame:
    return I.status_counts(e.some_documents, e.files)


@query("I14", f"""SELECT (SELECT count(*) FROM est_files) - (SELECT count(*) FROM est_some_docs) AS added, count(*) FILTER (status = 'text') AS extracted, 0::BIGINT AS ocr,
    count(*) FILTER (status = 'empty') AS "empty", count(*) FILTER (status = 'error') AS failed, (SELECT count(*) FROM est_some_docs WHERE status = 'extracting') AS interrupted,
    (SELECT count(*) FROM est_some_docs d JOIN est_files f USING (file_id) JOIN est_shares s USING (share_id) WHERE d.status = 'pending' AND s.enabled) AS pending FROM ({_OUT})""")
def round_statistics(e: Estate) -> DataFrame:
    new = I.add_missing(e.files, e.some_documents)
    return I.round_statistics(e.some_documents, I.extraction_outcome(attempts(e), 4000), new, e.some_documents, e.files, e.shares)


@query("I14", f"""SELECT (SELECT count(*) FROM est_files) - (SELECT count(*) FROM est_some_docs) AS added, count(*) FILTER (status = 'text') AS extracted, 0::BIGINT AS ocr,
    count(*) FILTER (status = 'empty') AS "empty", count(*) FILTER (status = 'error') AS failed, (SELECT count(*) FROM est_some_docs WHERE status = 'extracting') AS interrupted,
    (SELECT count(*) FROM est_some_docs d JOIN est_files f USING (file_id) JOIN est_shares s USING (share_id) WHERE d.status = 'pending' AND s.enabled) AS pending FROM ({_OUT_WHOLE})""")
def round_statistics_whole(e: Estate) -> DataFrame:
    """Files of every size."""
    new = I.add_missing(e.files, e.some_documents)
    return I.round_statistics(e.some_documents, I.extraction_outcome(attempts(e)), new, e.some_documents, e.files, e.shares)


_POST = f"""SELECT file_id, 'A' AS field, unnest({S.word_list('name')}) AS word, unnest(range(0, len({S.word_list('name')}))) AS pos FROM est_files WHERE file_id IN (SELECT file_id FROM est_docs)
    UNION ALL SELECT file_id, 'B', unnest({S.word_list("s.name || ' ' || fpath")}), unnest(range(0, len({S.word_list("s.name || ' ' || fpath")}))) FROM (SELECT f.*, s.name AS sn FROM est_files f JOIN est_shares s USING (share_id)) f JOIN est_shares s USING (share_id) WHERE file_id IN (SELECT file_id FROM est_docs)
    UNION ALL SELECT file_id, 'C', unnest({S.word_list('content')}), unnest(range(0, len({S.word_list('content')}))) FROM est_docs"""


@query("I7", f"SELECT file_id, field, word, CAST(pos AS INT) AS pos FROM ({_POST})")
def weighted_postings(e: Estate) -> DataFrame:
    return I.postings(e.files, e.folders, e.shares, e.documents).select("file_id", "field", "word", "pos")


@query("I8", f"SELECT file_id, field, word, CAST(pos AS INT) AS pos FROM ({_POST}) WHERE field IN ('A', 'B')")
def title_postings(e: Estate) -> DataFrame:
    return I.title_postings(e.files, e.folders, e.shares, e.documents).select("file_id", "field", "word", "pos")


@query("I9")
def stem_dictionary(e: Estate) -> DataFrame:
    words = I.vocabulary(I.postings(e.files, e.folders, e.shares, e.documents))
    return I.dictionary(words).select("lexeme", "config", "word")


@query("I10", f"SELECT file_id, field, word, count(*) AS n FROM (SELECT file_id, field, CASE WHEN field = 'B' AND word = 'src3' AND pos = 0 THEN 'renombrado' ELSE word END AS word FROM ({_POST}) WHERE field <> 'C') GROUP BY ALL")
def share_rename(e: Estate) -> DataFrame:
    renamed = e.shares.withColumn("name", F.when(F.col("share_id") == 3, "Renombrado").otherwise(F.col("name")))
    current = I.title_postings(e.files, e.folders, e.shares, e.documents).withColumn("bucket", F.lit(0))
    out = I.rename_share(current, e.files, e.folders, renamed, e.documents, 3)
    return out.groupBy("file_id", "field", "word").agg(F.count("*").alias("n"))


# ── Stored tables and exports ────────────────────────────────────────────────

@query("S5 S6", """SELECT file_id, share_id, folder_id, name, extension, size, CAST(mtime AS VARCHAR) AS mtime, CAST(acl_id AS VARCHAR) AS acl_id FROM est_files""")
def catalogue_round_trip(e: Estate) -> DataFrame:
    """Files written by share and read back with the declared schema."""
    folder = f"{shared_folder(e.spark)}/catalogue-{uuid.uuid4().hex}"
    K.write_table(e.files.drop("content", "fpath").withColumn("acl_id", F.col("acl_id").cast("string")), folder, "files")
    return K.read_table(e.spark, folder, "files").select(
        "file_id", "share_id", "folder_id", "name", "extension", "size", F.col("mtime").cast("string").alias("mtime"), "acl_id")


@query("S6 R10", """SELECT file_id, share_id, name || CASE WHEN share_id % 3 = 1 THEN ' v2' ELSE '' END AS name FROM est_files WHERE share_id % 3 <> 2""")
def catalogue_replaced(e: Estate) -> DataFrame:
    """Written twice: some shares anew, some left alone, and of some all files are gone."""
    folder = f"{shared_folder(e.spark)}/catalogue-{uuid.uuid4().hex}"
    files = e.files.select("file_id", "share_id", "name")
    K.write_table(files, folder, "files")
    again = files.filter("share_id % 3 = 1").withColumn("name", F.concat("name", F.lit(" v2")))
    K.write_table(again, folder, "files", processed=e.shares.select("share_id").filter("share_id % 3 <> 0"))
    return e.spark.read.parquet(f"{folder}/files").select("file_id", "share_id", "name")


@query("S9", """SELECT share_id, day, max(n) AS n FROM (SELECT CAST(o_orderkey % 20 AS INT) AS share_id, CAST(o_orderdate AS DATE)::VARCHAR AS day, CASE WHEN o_orderkey % 20 < 10 THEN 3 ELSE 2 END AS n FROM orders) GROUP BY 1, 2""")
def snapshots_stored(e: Estate) -> DataFrame:
    """A day written for half the shares, then for the others, then again for the first half."""
    folder = f"{shared_folder(e.spark)}/snapshots-{uuid.uuid4().hex}"
    rows = e.table("orders").select((F.col("o_orderkey") % 20).cast("int").alias("share_id"), F.to_date("o_orderdate").alias("day")).distinct()
    for n, half in ((1, "share_id < 10"), (2, "share_id >= 10"), (3, "share_id < 10")):
        K.write_snapshots(rows.filter(half).withColumn("n", F.lit(n)), folder)
    return e.spark.read.parquet(f"{folder}/plan_snapshots").select("share_id", F.col("day").cast("string").alias("day"), "n")


@query("S8 T2", """SELECT event_id, CAST("at" AS VARCHAR) AS "at" FROM est_audit WHERE "at" >= TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 14 DAY""")
def audit_purged(e: Estate) -> DataFrame:
    """Events appended in two goes, then purged where they are stored."""
    folder = f"{shared_folder(e.spark)}/audit-{uuid.uuid4().hex}"
    for part in (0, 1):
        K.append_events(e.audit.filter(F.col("event_id") % 2 == part), folder)
    K.purge_events(e.spark, folder, "2024-01-31 12:00:00", 14)
    return e.spark.read.parquet(f"{folder}/audit_events").select("event_id", F.col("at").cast("string").alias("at"))


@query("X9", r"""SELECT event_id, strftime("at", '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us("at") % 1000000 = 0 THEN '' ELSE strftime("at", '.%f') END AS "at",
    CASE WHEN event_id % 3 = 0 THEN chr(39) || '=' || username ELSE username END AS username, username || ', ' || action AS tags FROM est_audit""")
def csv_cells(e: Estate) -> DataFrame:
    rows = e.audit.select(
        "event_id", "at", F.expr("CASE WHEN event_id % 3 = 0 THEN concat('=', username) ELSE username END").alias("username"),
        F.array("username", "action").alias("tags"))
    return K.csv_cells(rows)


@query("S7 X9", r"""SELECT CAST(event_id AS VARCHAR) AS event_id, strftime("at", '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us("at") % 1000000 = 0 THEN '' ELSE strftime("at", '.%f') END AS "at",
    CASE WHEN event_id % 3 = 0 THEN chr(39) || '=' || username ELSE 'a;"' || username || '"' || chr(10) END AS username, username || ', ' || action AS tags FROM est_audit""")
def csv_exported(e: Estate) -> DataFrame:
    """Every audit event exported as CSV files, whose cells hold separators, quotes, line ends and formulas, and read back."""
    folder = f"{shared_folder(e.spark)}/export-{uuid.uuid4().hex}"
    K.export_csv(e.audit.select("event_id", "at", F.expr("CASE WHEN event_id % 3 = 0 THEN concat('=', username) ELSE concat('a;\"', username, '\"', char(10)) END").alias("username"),
                                F.array("username", "action").alias("tags")), folder)
    shape = "event_id string, at string, username string, tags string"
    return e.spark.read.schema(shape).csv(folder, sep=";", header=True, quote='"', escape='"', multiLine=True)


# ── Texts from bytes ─────────────────────────────────────────────────────────

@query("I1", """SELECT doc_id, CASE WHEN doc_id % 16 = 2 THEN text || chr(65533) WHEN doc_id % 16 = 6 THEN text || chr(65533) || 'x' WHEN doc_id % 16 = 10 THEN chr(65533) || text ELSE text END AS text
    FROM documents""")
def decode_bytes(e: Estate) -> DataFrame:
    """Texts encoded four ways come back as they were; where UTF-16 is broken, a sign stands for what is lost."""
    blob = (F.when(F.col("doc_id") % 4 == 0, F.encode("text", "UTF-8"))
            .when(F.col("doc_id") % 4 == 1, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("text", "UTF-8")))
            .when(F.col("doc_id") % 16 == 2, F.concat(F.encode("text", "UTF-16"), F.lit(b"\x00")))
            .when(F.col("doc_id") % 16 == 6, F.concat(F.encode("text", "UTF-16"), F.lit(b"\xd8\x01\x00x")))
            .when(F.col("doc_id") % 16 == 10, F.concat(F.lit(b"\xfe\xff\xdc\x01"), F.encode("text", "UTF-16BE")))
            .when(F.col("doc_id") % 4 == 2, F.encode("text", "UTF-16"))
            .otherwise(F.encode("text", "ISO-8859-1")))
    return e.table("documents").select("doc_id", TX.decode_text(blob).alias("text"))


@query("I2", """SELECT page_id, replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
    '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&') AS text FROM pages""")
def markup_to_text(e: Estate) -> DataFrame:
    return e.table("pages").select("page_id", TX.markup_text(F.col("html")).alias("text"))


def _word_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A minimal Word file per text, one paragraph per line."""
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def rows() -> Iterator[tuple]:
        for file_id, extension, text in TX.arrow_rows(batches, "file_id", "extension", "content"):
            lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as box:
                box.writestr("word/document.xml", f"<w:document {space}><w:body>{lines}</w:body></w:document>")
            yield file_id, extension, buffer.getvalue()

    return TX.in_small_batches(rows(), pa.schema([("file_id", pa.int64()), ("extension", pa.string()), ("content", pa.binary())]), lambda r: len(r[2]))


@query("I3", """SELECT file_id, array_to_string(list_filter(string_split(content, chr(10)), lambda l: l <> ''), chr(10)) AS text FROM est_files""")
def office_text(e: Estate) -> DataFrame:
    """Every text packed into a Word container and read back."""
    packed = e.files.select("file_id", F.lit("docx").alias("extension"), "content").mapInArrow(
        _word_file, "file_id bigint, extension string, content binary")
    return TX.extract_texts(packed).select("file_id", "text")
