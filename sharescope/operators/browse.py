"""What one account sees when it walks the shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aces as A
from ..functions import paths as P
from ..functions.text import excerpt
from ..schema import MAX_FILES_LISTED
from .common import top_per_group
from .folderplan import placements
from .permissions import listable_acls, opening_acls, visible_files

# Formats a browser shows by itself.
PREVIEW_TYPES = ["pdf", "png", "jpg", "jpeg", "gif", "bmp", "webp"]


def browsable_shares(shares: DataFrame, folders: DataFrame, acls: DataFrame, token: A.Token) -> DataFrame:
    roots = (folders.filter("path = ''").join(listable_acls(acls, token), "acl_id", "left_semi")
             .select("share_id", F.col("folder_id").alias("root_folder_id")))
    return shares.filter("enabled").join(roots, "share_id").select("share_id", "name", "path", "root_folder_id")


def listable_folders(folders: DataFrame, shares: DataFrame, acls: DataFrame, token: A.Token) -> DataFrame:
    """Folders the account can open in a file browser, in enabled shares."""
    enabled = shares.filter("enabled").select("share_id")
    return folders.join(listable_acls(acls, token), "acl_id", "left_semi").join(enabled, "share_id", "left_semi")


def child_folders(folders: DataFrame, shares: DataFrame, acls: DataFrame, token: A.Token) -> DataFrame:
    """(parent_id, folder_id, name) for every listable folder inside a listable one."""
    seen = listable_folders(folders, shares, acls, token).select("share_id", "folder_id", "path", "name")
    parents = seen.select("share_id", F.col("path").alias("parent_path"), F.col("folder_id").alias("parent_id"))
    return (seen.filter("path <> ''").withColumn("parent_path", P.parent(F.col("path")))
            .join(parents, ["share_id", "parent_path"]).select("parent_id", "folder_id", "name"))


def folder_files(files: DataFrame, folders: DataFrame, shares: DataFrame, acls: DataFrame, token: A.Token,
                 limit: int = MAX_FILES_LISTED) -> DataFrame:
    """First `limit` visible files of every listable folder by name, and whether there were more."""
    seen = visible_files(files, folders, acls, token)
    inside = seen.join(listable_folders(folders, shares, acls, token).select("folder_id"), "folder_id", "left_semi")
    rows = inside.select("folder_id", "file_id", "name", "extension", "size", "mtime")
    counts = rows.groupBy("folder_id").agg((F.count("*") > limit).alias("files_truncated"))
    return top_per_group(rows, ["folder_id"], [F.lower("name").asc(), F.asc("file_id")], limit).join(counts, "folder_id")


def hidden_files_flag(files: DataFrame, folders: DataFrame, shares: DataFrame, acls: DataFrame, token: A.Token) -> DataFrame:
    """Listable folders whose files stay closed: none is visible and the folder's ACL opens none."""
    shown = visible_files(files, folders, acls, token).select("folder_id").distinct().withColumn("shown", F.lit(True))
    opens = opening_acls(acls, token).withColumn("opens", F.lit(True))
    return (listable_folders(folders, shares, acls, token).join(shown, "folder_id", "left").join(opens, "acl_id", "left")
            .select("folder_id", (F.col("shown").isNull() & F.col("opens").isNull()).alias("files_hidden")))


def breadcrumbs(folders: DataFrame, shares: DataFrame, acls: DataFrame, token: A.Token) -> DataFrame:
    """Ancestors of every listable folder from the root, linked only where listable themselves."""
    seen = listable_folders(folders, shares, acls, token)
    links = seen.select("share_id", F.col("path").alias("above"), F.col("folder_id").alias("link_id"))
    roots = shares.select("share_id", F.col("name").alias("share"))
    crumbs = seen.select("share_id", "folder_id", F.posexplode(P.ancestors(F.col("path"))).alias("ordinal", "above"))
    name = F.when(F.col("above") == "", F.col("share")).otherwise(P.base_name(F.col("above")))
    return (crumbs.join(links, ["share_id", "above"], "left").join(roots, "share_id")
            .select("folder_id", "ordinal", "link_id", name.alias("name")))


def folder_placements(folders: DataFrame, shares: DataFrame, acls: DataFrame, plan: DataFrame, token: A.Token) -> DataFrame:
    """Plan placement of every listable folder; an entry above it stays hidden if its folder can't be listed."""
    seen = listable_folders(folders, shares, acls, token)
    placed = placements(seen, plan)
    # The real folder at the entry's level, spelled as on disk.
    level = P.depth(F.col("entry_path")).cast("int")
    above = F.array_join(F.slice(F.split("path", "/"), F.lit(1), level), "/")
    open_above = seen.select("share_id", F.col("path").alias("above"), F.lit(True).alias("open"))
    joined = placed.withColumn("above", F.when(F.col("entry_path").isNotNull(), above)).join(
        open_above, ["share_id", "above"], "left")
    shown = (F.col("status") == "planned") | F.col("open").isNotNull()
    return joined.select("share_id", "folder_id", "status", F.when(shown, F.col("entry_path")).alias("entry_path"))


def document_details(files: DataFrame, folders: DataFrame, shares: DataFrame, acls: DataFrame, documents: DataFrame,
                     token: A.Token) -> DataFrame:
    """Everything the document page shows, for every file the account may open."""
    seen = visible_files(files, folders, acls, token).withColumnRenamed("path", "folder_path")
    roots = shares.filter("enabled").select("share_id", F.col("name").alias("share"), F.col("path").alias("share_path"))
    first, cut = excerpt(F.col("content"))
    # The excerpt is taken before the join, so whole texts are not shuffled.
    texts = documents.select("file_id", F.col("status").alias("index_status"),
                             F.when(F.col("content") != "", first).alias("text_excerpt"),
                             F.coalesce(cut, F.lit(False)).alias("text_truncated"))
    preview = F.when(F.col("extension").isin(PREVIEW_TYPES), F.when(F.col("extension") == "pdf", "pdf").otherwise("image"))
    return (seen.join(roots, "share_id").join(texts, "file_id", "left").select(
        "file_id", "name", "extension", "size", "mtime", "share_id", "share", "folder_id", "folder_path",
        P.display_path(F.col("share_path"), F.col("folder_path"), F.col("name")).alias("path"),
        "index_status", "text_excerpt", F.coalesce("text_truncated", F.lit(False)).alias("text_truncated"),
        preview.alias("preview")))
