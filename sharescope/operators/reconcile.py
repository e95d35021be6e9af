"""Comparing a fresh listing with the stored catalogue.

All shares and folders are compared at once by full outer joins on natural keys. A folder that
could not be listed keeps what the catalogue knew of it and of everything below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import paths as P
from ..functions import values as V
from ..schema import MAX_ERROR_SAMPLE
from .common import top_per_group

KEY = ["share_id", "path", "name"]


# ── Listings ─────────────────────────────────────────────────────────────────

def _refused(entry_name: Column, is_dir: Column, is_link: Column) -> Column:
    return N.is_ignored(entry_name) | (is_dir & is_link)


def accepted_entries(listing: DataFrame) -> DataFrame:
    """Entries worth cataloguing: no ignored names, no folder links, nothing below either."""
    refused = _refused(F.col("name"), F.col("is_dir"), F.col("is_reparse_point"))
    blocked = (listing.filter("is_dir").filter(refused)
               .select("share_id", P.child(F.col("path"), F.col("name")).alias("above")))
    below = (listing.select("share_id", "path").distinct()
             .select("share_id", "path", F.explode(P.ancestors(F.col("path"))).alias("above"))
             .join(blocked, ["share_id", "above"], "left_semi").select("share_id", "path").distinct())
    return listing.filter(~refused).join(below, ["share_id", "path"], "left_anti")


def skipped_links(listing: DataFrame) -> DataFrame:
    """Folder links per share, which are counted and not followed."""
    return (listing.filter("is_dir AND is_reparse_point").filter(~N.is_ignored(F.col("name")))
            .groupBy("share_id").agg(F.count("*").alias("folders_skipped")))


def _under(rows: DataFrame, roots: DataFrame, how: str) -> DataFrame:
    """Rows whose `path` lies (left_semi) or does not lie (left_anti) in a subtree of `roots`."""
    paths = rows.select("share_id", "path").distinct()
    inside = (paths.select("share_id", "path", F.explode(P.ancestors(F.col("path"))).alias("above"))
              .join(roots.select("share_id", F.col("path").alias("above")), ["share_id", "above"], "left_semi")
              .select("share_id", "path").distinct())
    return rows.join(inside, ["share_id", "path"], how)


# ── Files ────────────────────────────────────────────────────────────────────

def file_changes(listing: DataFrame, catalogue: DataFrame, unlisted: DataFrame | None = None, accepted: bool = False) -> DataFrame:
    """added / updated / removed / unchanged per file.

    `catalogue`: (share_id, path, name, size, mtime, file_id), `path` being the folder's. `unlisted`:
    (share_id, path) of folders whose listing failed; files at or below them are `unchanged`. `accepted` says that
    `accepted_entries` has been applied to the listing.
    """
    entries = listing if accepted else accepted_entries(listing)
    times = ["ctime"] if "ctime" in listing.columns and "ctime" in catalogue.columns else []
    seen = entries.filter("NOT is_dir").select(
        *KEY, F.col("size").alias("new_size"), *[F.col(c).alias(f"new_{c}") for c in ("mtime", *times)], F.lit(True).alias("seen"))
    known = catalogue.select(*KEY, "file_id", "size", "mtime", *times, F.lit(True).alias("known"))
    kept = None
    if unlisted is not None:
        kept = _under(known, unlisted, "left_semi")
        known = _under(known, unlisted, "left_anti")
        seen = _under(seen, unlisted, "left_anti")
    joined = known.join(seen, KEY, "full")
    moved = (F.col("size") != F.col("new_size")) | ~V.same_time(F.col("mtime"), F.col("new_mtime"))
    change = (F.when(F.col("known").isNull(), "added").when(F.col("seen").isNull(), "removed")
              .when(moved, "updated").otherwise("unchanged"))
    out = joined.select(*KEY, "file_id", change.alias("change"),
                        F.coalesce("seen", F.lit(False)).alias("seen"),
                        *[F.when(F.col("seen"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("size", "mtime", *times)])
    if kept is not None:
        out = out.unionByName(kept.select(*KEY, "file_id", F.lit("unchanged").alias("change"),
                                          F.lit(False).alias("seen"), "size", "mtime", *times))
    return out


def next_files(files: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """The file table after the changes: changed files lose their hashes and are marked for reading."""
    changed = F.col("change").isin("added", "updated")
    old = files.select("file_id", *[c for c in ("quick_hash", "content_hash", "indexed_at", "acl_id") if c in files.columns])
    alive = changes.filter("change <> 'removed'").join(old, "file_id", "left")
    fresh = lambda c: F.when(~changed, F.col(c)).alias(c)
    return alive.select(
        "file_id", *KEY, N.extension(F.col("name")).alias("extension"), "size", "mtime", "change",
        *[fresh(c) for c in ("quick_hash", "content_hash") if c in old.columns],
        *([F.when(changed, V.at(as_of)).otherwise(F.col("indexed_at")).alias("indexed_at")] if "indexed_at" in old.columns else []),
        *(["acl_id"] if "acl_id" in old.columns else []))


def next_documents(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Index rows after the changes: a changed file waits again, its old text stays findable meanwhile."""
    told = changes.filter(F.col("file_id").isNotNull()).select(
        "file_id", "change", N.initial_status(N.extension(F.col("name")), F.col("size")).alias("fresh"))
    joined = documents.join(told, "file_id", "left")
    alive = joined.filter(F.coalesce("change", F.lit("unchanged")) != "removed")
    status = F.when(F.col("change") == "updated", F.col("fresh")).otherwise(F.col("status"))
    return alive.withColumn("status", status).select(*documents.columns)


# ── Folders ──────────────────────────────────────────────────────────────────

def folder_changes(listing: DataFrame, catalogue: DataFrame, unlisted: DataFrame | None = None, accepted: bool = False) -> DataFrame:
    """added / removed / unchanged per folder; a vanished folder takes its whole subtree along.

    `seen` is false for folders below one that could not be listed: nobody looked at them.
    """
    roots = catalogue.select("share_id").distinct().select("share_id", F.lit("").alias("path"))
    entries = listing if accepted else accepted_entries(listing)
    seen = entries.filter("is_dir").select(
        "share_id", P.child(F.col("path"), F.col("name")).alias("path")).union(roots).distinct()
    known = catalogue.select("share_id", "path")
    kept = None
    if unlisted is not None:
        below = _under(known, unlisted, "left_semi")
        # The unlisted folder itself was seen in its parent; what is below it wasn't looked at.
        kept = below.join(unlisted.select("share_id", "path"), ["share_id", "path"], "left_anti")
        known = known.join(kept, ["share_id", "path"], "left_anti")
        seen = seen.join(kept, ["share_id", "path"], "left_anti").union(
            unlisted.select("share_id", "path")).distinct()
    joined = known.withColumn("known", F.lit(True)).join(seen.withColumn("seen", F.lit(True)), ["share_id", "path"], "full")
    change = F.when(F.col("known").isNull(), "added").when(F.col("seen").isNull(), "removed").otherwise("unchanged")
    out = joined.select("share_id", "path", P.base_name(F.col("path")).alias("name"),
                        P.depth(F.col("path")).alias("depth"), change.alias("change"), F.coalesce("seen", F.lit(False)).alias("seen"))
    if kept is not None:
        out = out.unionByName(kept.select("share_id", "path", P.base_name(F.col("path")).alias("name"),
                                          P.depth(F.col("path")).alias("depth"), F.lit("unchanged").alias("change"), F.lit(False).alias("seen")))
    return out


def refresh_permissions(folders: DataFrame, decoded: DataFrame) -> DataFrame:
    """Folders with the ACL and owner read by this scan.

    `decoded`: (share_id, path, new_acl_id, new_owner, error), one row per folder that has a descriptor.
    An unreadable one leaves the folder without ACL (nobody sees it) and keeps the owner.
    """
    joined = folders.join(decoded.withColumn("read", F.lit(True)), ["share_id", "path"], "left")
    failed = F.col("error").isNotNull()
    return joined.withColumns({
        "acl_id": F.when(~failed, F.col("new_acl_id")),
        "owner_sid": F.when(failed, F.col("owner_sid")).otherwise(F.col("new_owner")),
        "acl_error": F.when(failed, F.substring("error", 1, 500)),
    }).select(*folders.columns)


# ── Runs ─────────────────────────────────────────────────────────────────────

def run_statistics(shares: DataFrame, listing: DataFrame, changes: DataFrame, folder_rows: DataFrame,
                   errors: DataFrame, sample: int = MAX_ERROR_SAMPLE) -> DataFrame:
    """One row per share about a scan, with its status.

    `errors`: (share_id, path, kind, message), kind "list" or "acl". `folder_rows` is the output of
    `folder_changes`. The sample holds at most `sample` messages per share.
    """
    counted = changes.groupBy("share_id").agg(
        F.count_if("seen").alias("files_seen"),
        F.count_if(F.col("change") == "added").alias("files_added"),
        F.count_if(F.col("change") == "updated").alias("files_updated"),
        F.count_if(F.col("change") == "removed").alias("files_removed"))
    trees = folder_rows.groupBy("share_id").agg(F.count_if(F.col("change") != "removed").alias("folders_seen"))
    bad = errors.groupBy("share_id").agg(
        F.count("*").alias("error_count"),
        F.bool_or((F.col("path") == "") & (F.col("kind") == "list")).alias("root_failed"))
    first = (top_per_group(errors, ["share_id"], [F.asc("path"), F.asc("kind"), F.asc("message")], sample)
             .groupBy("share_id").agg(F.array_join(F.transform(
                 F.array_sort(F.collect_list(F.struct("rank", "message"))), lambda e: e["message"]), "\n").alias("error_sample")))
    out = (shares.select("share_id").join(counted, "share_id", "left").join(trees, "share_id", "left")
           .join(skipped_links(listing), "share_id", "left").join(bad, "share_id", "left").join(first, "share_id", "left"))
    numbers = ["files_seen", "files_added", "files_updated", "files_removed", "folders_seen", "folders_skipped", "error_count"]
    status = (F.when(F.coalesce("root_failed", F.lit(False)), "failed")
              .when(F.coalesce("error_count", F.lit(0)) > 0, "partial").otherwise("success"))
    return out.select("share_id", status.alias("status"),
                      *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], "error_sample")


def cascade_delete(doomed: DataFrame, folders: DataFrame, files: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """Tables without the given folders (share_id, path), everything below them, and what hangs on it."""
    left_folders = _under(folders, doomed, "left_anti")
    gone = _under(folders, doomed, "left_semi").select("folder_id")
    left_files = files.join(gone, "folder_id", "left_anti")
    lost = files.join(gone, "folder_id", "left_semi").select("file_id")
    return {"folders": left_folders, "files": left_files, "documents": documents.join(lost, "file_id", "left_anti")}
