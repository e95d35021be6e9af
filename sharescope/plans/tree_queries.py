"""The estate as real files: written to the shared folder, listed in shards and read by ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import duplicates as D
from ..operators import reconcile as C
from ..session import materialize, shared_folder
from ..sources import catalogue as K
from ..sources import listing as G
from ..sources.derived import Estate
from . import base_sql as S
from .registry import query
from .report_queries import sized

CHUNK = 256


def placed(e: Estate, root: str) -> DataFrame:
    """Where each file's text belongs below `root`."""
    return e.files.select(
        "file_id", F.concat_ws("/", F.lit(root), F.col("share_id").cast("string"), F.when(F.col("fpath") != "", F.col("fpath")), "name").alias("location"),
        F.encode("content", "UTF-8").alias("content"), "mtime")


def tree(e: Estate) -> str:
    """Every file written below a new root, in a folder for each share; the root."""
    root = f"{shared_folder(e.spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
    G.write_tree(placed(e, root)).agg(F.sum("size")).collect()
    return root


def listed(e: Estate, root: str) -> tuple[DataFrame, DataFrame]:
    # As many rows as shares.
    return G.list_shares(e.spark, {r.share_id: f"{root}/{r.share_id}" for r in e.shares.select("share_id").collect()})


@query("S1", rf"""SELECT share_id, fpath AS path, name, false AS is_dir, bytes AS size, CAST(mtime AS VARCHAR) AS mtime, true AS has_ctime, false AS is_reparse_point FROM sized
    UNION ALL SELECT share_id, {S.parent('path')}, regexp_extract(path, '([^/]*)$', 1), true, 0, NULL, true, false FROM est_folders
    WHERE path <> '' AND path <> 'Archivo' AND NOT starts_with(path, 'Archivo/')""")
def tree_listed(e: Estate) -> DataFrame:
    """A tree of all files, listed: times are compared where the estate has one."""
    entries, _ = listed(e, tree(e))
    known = F.when(F.col("mtime") < F.lit("2024-01-02").cast("timestamp_ntz"), F.col("mtime"))
    return entries.select("share_id", "path", "name", "is_dir", "size", known.cast("string").alias("mtime"),
                          F.col("ctime").isNotNull().alias("has_ctime"), "is_reparse_point")


@query("S1 R1 R2", """SELECT share_id, fpath AS path, name, CASE WHEN file_id % 29 = 0 THEN NULL ELSE file_id END AS file_id,
    CASE WHEN file_id % 29 = 0 THEN 'added' WHEN mtime IS NULL OR file_id % 31 = 0 THEN 'updated' ELSE 'unchanged' END AS change FROM est_files
    UNION ALL SELECT share_id, fpath, 'gone ' || name, -file_id, 'removed' FROM est_files WHERE file_id % 37 = 0""")
def tree_changes(e: Estate) -> DataFrame:
    """A listed tree against a catalogue with files it lacks, files of other sizes, and files that are gone."""
    entries, unlisted = listed(e, tree(e))
    known = e.files.select("share_id", F.col("fpath").alias("path"), "name", "file_id", F.octet_length("content").cast("long").alias("size"), "mtime")
    gone = known.filter("file_id % 37 = 0").withColumns({"name": F.concat(F.lit("gone "), "name"), "file_id": -F.col("file_id")})
    other = known.filter("file_id % 29 <> 0").withColumn("size", F.col("size") + F.when(F.col("file_id") % 31 == 0, 7).otherwise(0))
    changes = C.file_changes(entries, other.unionByName(gone), unlisted.select("share_id", "path"))
    return changes.select("share_id", "path", "name", "file_id", "change")


@query("S3", "SELECT share_id, fpath AS path, name, bytes AS length, md5(content) AS digest FROM sized")
def tree_contents(e: Estate) -> DataFrame:
    """Every file of a tree read whole."""
    root = tree(e)
    below = F.substring_index("path", root.rsplit("/", 1)[1] + "/", -1)
    share, rest = F.substring_index(below, "/", 1), F.regexp_extract(below, r"\A[^/]*/(?s:(.*))\z", 1)
    return K.read_contents(e.spark, root).select(
        share.cast("int").alias("share_id"), F.regexp_extract(rest, r"\A(?s:(?:(.*)/)?[^/]*)\z", 1).alias("path"),
        F.regexp_extract(rest, r"([^/]*)\z", 1).alias("name"), "length", F.md5("content").alias("digest"))


_QUICK = f"""sha256(encode(CAST(bytes AS VARCHAR)) || array_slice(encode(content), 1, {CHUNK}) || CASE WHEN bytes > {2 * CHUNK} THEN array_slice(encode(content), bytes - {CHUNK - 1}, bytes)
    WHEN bytes > {CHUNK} THEN array_slice(encode(content), {CHUNK + 1}, bytes) ELSE ''::BLOB END)"""


@query("D2 S3", f"SELECT file_id, {_QUICK} AS hash, least(bytes, {2 * CHUNK}) AS bytes_read, NULL::VARCHAR AS error FROM sized")
def ranged_hashes(e: Estate) -> DataFrame:
    """Of each file of a tree, no byte but those that are hashed is read."""
    return G.hash_files(placed(e, tree(e)).select("file_id", "location"), CHUNK)


@query("D1 D2 D3 D4 D5 S3", f"""SELECT file_id, quick_hash, CASE WHEN count(*) OVER (PARTITION BY bytes, quick_hash) > 1 THEN content_hash END AS content_hash
    FROM (SELECT file_id, bytes, content_hash, {_QUICK} AS quick_hash FROM hashed)""")
def tree_duplicates(e: Estate) -> DataFrame:
    """The funnel over a tree: only files whose size is shared are opened, and read whole only if their ends agree."""
    located = placed(e, tree(e)).select("file_id", "location")
    return materialize(D.hash_stage(sized(e), D.hash_locations(located), chunk=CHUNK)).filter("quick_hash IS NOT NULL").select("file_id", "quick_hash", "content_hash")
