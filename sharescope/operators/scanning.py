"""Scan after scan: the next version of the catalogue's tables from the last one and a fresh listing.

Each table is a state transition by joins on natural keys. The new tables are committed together, share by share, so that a scan of
some shares leaves the partitions of others where they are, and readers see either the catalogue before a scan or the one after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import paths as P
from ..functions import values as V
from ..session import materialize
from ..sources.versions import Change, Store
from . import reconcile as C

# Fixed value: how much of an error message a row keeps.
MESSAGE_CHARS = 500
PLACE = ["share_id", "path"]


def stable_id(*parts: Column) -> Column:
    """A positive 60-bit number that depends on the parts alone, for rows that are new to a table."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def next_folders(folders: DataFrame, listing: DataFrame, unlisted: DataFrame) -> DataFrame:
    """The folder table after a scan. `listing` holds accepted entries (see `reconcile.accepted_entries`).

    `unlisted`: (share_id, path, message) of folders whose listing failed. These get the message, folders that were listed lose theirs, and what lies
    below an unlisted one stays as it was, marker included. Vanished folders go with all they hold; new ones have an id, but no ACL until it is read.
    """
    changes = C.folder_changes(listing, folders, unlisted, True).filter("change <> 'removed'")
    times = listing.filter("is_dir").select("share_id", P.child(F.col("path"), F.col("name")).alias("path"), F.col("mtime").alias("new_mtime"))
    times = times.groupBy(*PLACE).agg(F.max("new_mtime").alias("new_mtime"))
    held = ["folder_id", "acl_id", "owner_sid", "mtime", "acl_error", "list_error"]
    old = folders.select(*PLACE, *[c if c in folders.columns else F.lit(None).cast("timestamp_ntz").alias(c) for c in held])
    told = unlisted.select(*PLACE, F.substring("message", 1, MESSAGE_CHARS).alias("message"))
    joined = changes.join(old, PLACE, "left").join(times, PLACE, "left").join(told, PLACE, "left")
    return joined.select(
        "share_id", F.coalesce("folder_id", F.concat_ws(":", "share_id", "path")).alias("folder_id"), "path", "name", "depth", "acl_id", "owner_sid",
        F.when(F.col("seen") & (F.col("path") != ""), F.col("new_mtime")).otherwise(F.col("mtime")).alias("mtime"), "acl_error",
        F.when(F.col("message").isNotNull(), F.col("message")).when(~F.col("seen"), F.col("list_error")).alias("list_error"))


def next_files(files: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """The file table after a scan.

    An unchanged file keeps all it had, also a time that differs by less than the tolerance, so that small differences don't add up. Changed ones lose
    their hashes and are marked for reading; new ones get an id and their folder's.
    """
    own = ["size", "mtime", "ctime", "quick_hash", "content_hash", "indexed_at", "acl_id"]
    kinds = {"size": "long", "mtime": "timestamp_ntz", "ctime": "timestamp_ntz", "quick_hash": "string", "content_hash": "string", "indexed_at": "timestamp_ntz", "acl_id": "string"}
    have = lambda c: F.col(c) if c in files.columns else F.lit(None).cast(kinds[c])
    old = files.select("file_id", *[have(c).alias(f"old_{c}") for c in own])
    changed = F.col("change").isin("added", "updated")
    seen = lambda c: F.col(c) if c in changes.columns else F.lit(None).cast(kinds[c])
    return changes.filter("change <> 'removed'").join(old, "file_id", "left").select(
        F.coalesce("file_id", stable_id(F.col("share_id"), F.col("path"), F.col("name"))).alias("file_id"), "share_id",
        F.concat_ws(":", "share_id", "path").alias("folder_id"), "path", "name", N.extension(F.col("name")).alias("extension"),
        *[F.when(changed, seen(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in ("size", "mtime", "ctime")],
        *[F.when(~changed, F.col(f"old_{c}")).alias(c) for c in ("quick_hash", "content_hash")],
        F.when(changed, V.at(as_of)).otherwise(F.col("old_indexed_at")).alias("indexed_at"), F.col("old_acl_id").alias("acl_id"))


def scan(state: dict[str, DataFrame], listing: DataFrame, unlisted: DataFrame, as_of: str, decoded: DataFrame | None = None) -> dict[str, DataFrame]:
    """folders, files and documents after a scan, and the `changes` of files that led there.

    `state`: the tables before it. `decoded` are the descriptors the scan read, as `reconcile.refresh_permissions` takes them.
    """
    files = state["files"]
    # All are read by several tables: computed once.
    entries, blind = materialize(C.accepted_entries(materialize(listing))), materialize(unlisted)
    changes = materialize(C.file_changes(entries, files, blind, True))
    folders = materialize(next_folders(state["folders"], entries, blind))
    return {"folders": folders if decoded is None else C.refresh_permissions(folders, decoded), "files": next_files(files, changes, as_of),
            "documents": C.next_documents(state["documents"], changes), "changes": changes}


def start_catalogue(store: Store, tables: dict[str, DataFrame]) -> int:
    """The first version of a catalogue: tables with a share_id, one partition a share."""
    return store.commit({name: Change(df, "share_id") for name, df in tables.items()})


def scan_into(store: Store, listing: DataFrame, unlisted: DataFrame, as_of: str, decoded: DataFrame | None = None, shares: list[int] | None = None) -> DataFrame:
    """Scan `shares` (by default all of the catalogue) into the store's next version; the changes of files."""
    base = store.manifest()
    state = {name: store.read(name, base.version, shares) for name in ("folders", "files", "documents")}
    mine = (lambda df: df) if shares is None else (lambda df: df.filter(F.col("share_id").isin(shares)))
    after = scan(state, mine(listing), mine(unlisted), as_of, decoded)
    replaced = "all" if shares is None else tuple(shares)
    store.commit({name: Change(after[name].select(*state[name].columns), "share_id", replaced) for name in ("folders", "files", "documents")}, base)
    return after["changes"]
