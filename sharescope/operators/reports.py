"""Estate reports: inventory, age, staleness, hygiene, permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aces as A
from ..functions import paths as P
from ..functions import values as V
from ..schema import (AGE_CLASSES, AGE_OLDER, AGE_UNKNOWN, DEEP_FOLDER_LIMIT, DOMAIN_USERS_RID, INHERIT_ONLY,
                      INHERITED, LONG_PATH_LIMIT)
from ..session import materialize
from .common import constant_table
from .permissions import account_classes, evaluate_classes, named_tokens

# Columns of the permission grid that a row meets in one join key.
GRID_PART = 1_000
# Accounts of a class that meet its columns in one join key.
CLASS_SHARE = 2_000


def page(df: DataFrame, order: list, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One page of an ordered result; negative sizes are refused."""
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("limit and offset can't be negative")
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


# ── Inventory ────────────────────────────────────────────────────────────────

def latest_runs(scan_runs: DataFrame) -> DataFrame:
    """The last run of each share."""
    picked = scan_runs.groupBy("share_id").agg(
        F.max_by(F.struct("run_id", "status", "finished_at"), "run_id").alias("run"))
    return picked.select("share_id", "run.*")


def summary(shares: DataFrame, files: DataFrame, folders: DataFrame, scan_runs: DataFrame) -> DataFrame:
    """Size and last scan of every share; shares without data show zeros."""
    sizes = files.groupBy("share_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    trees = folders.groupBy("share_id").agg(F.count("*").alias("folders"))
    runs = latest_runs(scan_runs).select("share_id", F.col("status").alias("last_scan_status"),
                                         F.col("finished_at").alias("last_scan_finished"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (shares.join(sizes, "share_id", "left").join(trees, "share_id", "left").join(runs, "share_id", "left")
            .select("share_id", F.col("name").alias("share"), "path", "enabled", zero("files"), zero("bytes"),
                    zero("folders"), "last_scan_status", "last_scan_finished"))


def by_extension(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Heaviest extensions."""
    ext = F.when(F.col("extension") == "", "(none)").otherwise(F.col("extension"))
    grouped = files.groupBy(ext.alias("extension")).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return page(grouped, [F.desc("bytes"), F.asc("extension")], limit)


def by_age(files: DataFrame, as_of: str) -> DataFrame:
    """Files per age class; all classes are present, in a fixed order."""
    found = files.groupBy(V.age_class(F.col("mtime"), as_of).alias("bucket")).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"))
    labels = [label for label, _ in AGE_CLASSES] + [AGE_OLDER, AGE_UNKNOWN]
    classes = constant_table(files, [(label, i) for i, label in enumerate(labels)], ["bucket", "ordinal"])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (classes.join(found, "bucket", "left").select("ordinal", "bucket", zero("files"), zero("bytes"))
            .orderBy("ordinal"))


def stale_folders(files: DataFrame, folders: DataFrame, shares: DataFrame, as_of: str, years: int = 5,
                  limit: int | None = None) -> DataFrame:
    """Folders with the most bytes untouched for `years` 365-day years."""
    old = (files.filter(F.col("mtime") < V.days_before(as_of, 365 * years)).groupBy("folder_id").agg(
        F.count("*").alias("stale_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("stale_bytes"),
        F.max("mtime").alias("newest_stale")))
    named = _with_place(old, folders, shares).select(
        P.display_path(F.col("share_path"), F.col("path")).alias("folder"),
        "stale_files", "stale_bytes", "newest_stale")
    return page(named, [F.desc("stale_bytes"), F.asc("folder")], limit)


def _with_place(df: DataFrame, folders: DataFrame, shares: DataFrame) -> DataFrame:
    where = folders.select("folder_id", "share_id", "path")
    roots = shares.select("share_id", F.col("path").alias("share_path"))
    return df.join(where, "folder_id").join(roots, "share_id")


# ── Hygiene ──────────────────────────────────────────────────────────────────

def long_paths(files: DataFrame, folders: DataFrame, shares: DataFrame, limit: int | None = None,
               longer_than: int = LONG_PATH_LIMIT) -> DataFrame:
    """Paths too long for common programs; separators count even at a share's root."""
    length = (F.length("share_path") + F.length("path") + F.length("name") + 2).cast("long")
    placed = (_with_place(files.select("folder_id", "name"), folders, shares)
              .withColumn("length", length).filter(F.col("length") > longer_than))
    shown = placed.select(P.display_path(F.col("share_path"), F.col("path"), F.col("name")).alias("path"), "length")
    return page(shown, [F.desc("length"), F.asc("path")], limit)


def deep_folders(folders: DataFrame, shares: DataFrame, limit: int | None = None,
                 deeper_than: int = DEEP_FOLDER_LIMIT) -> DataFrame:
    deep = folders.filter(F.col("depth") > deeper_than).select("share_id", "path", "depth")
    shown = deep.join(shares.select("share_id", F.col("path").alias("share_path")), "share_id").select(
        P.display_path(F.col("share_path"), F.col("path")).alias("path"), "depth")
    return page(shown, [F.desc("depth"), F.asc("path")], limit)


def empty_folders(files: DataFrame, folders: DataFrame, shares: DataFrame) -> DataFrame:
    """Listed folders, other than roots, with neither files nor subfolders."""
    parents = (folders.filter(F.col("path") != "")
               .select("share_id", P.parent(F.col("path")).alias("path")).distinct())
    candidates = folders.filter((F.col("path") != "") & F.col("list_error").isNull())
    bare = (candidates.join(files.select("folder_id"), "folder_id", "left_anti")
            .join(parents, ["share_id", "path"], "left_anti"))
    return bare.join(shares.select("share_id", F.col("path").alias("share_path")), "share_id").select(
        P.display_path(F.col("share_path"), F.col("path")).alias("path"))


def unlisted_folders(folders: DataFrame, shares: DataFrame) -> DataFrame:
    broken = folders.filter(F.col("list_error").isNotNull())
    return broken.join(shares.select("share_id", F.col("path").alias("share_path")), "share_id").select(
        P.display_path(F.col("share_path"), F.col("path")).alias("path"), F.col("list_error").alias("error"))


def hygiene_counts(files: DataFrame, folders: DataFrame, shares: DataFrame) -> DataFrame:
    """How many of each issue there are, whatever the lists show."""
    parts = {
        "long path": long_paths(files, folders, shares, None),
        "deep folder": deep_folders(folders, shares, None),
        "empty folder": empty_folders(files, folders, shares),
        "could not list": unlisted_folders(folders, shares),
    }
    out = None
    for issue, df in parts.items():
        row = df.agg(F.count("*").alias("count")).select(F.lit(issue).alias("issue"), "count")
        out = row if out is None else out.unionByName(row)
    return out


def hygiene_rows(files: DataFrame, folders: DataFrame, shares: DataFrame, limit: int | None = None) -> DataFrame:
    """The four lists as one table of issues for export."""
    text = lambda c: F.col(c).cast("string").alias("detail")
    issue = lambda label: F.lit(label).alias("issue")
    return (long_paths(files, folders, shares, limit).select(issue("long path"), "path", text("length"))
            .unionByName(deep_folders(folders, shares, limit).select(issue("deep folder"), "path", text("depth")))
            .unionByName(page(empty_folders(files, folders, shares), ["path"], limit)
                         .select(issue("empty folder"), "path", F.lit("").alias("detail")))
            .unionByName(page(unlisted_folders(folders, shares), ["path"], limit)
                         .select(issue("could not list"), "path", text("error"))))


# ── Permissions ──────────────────────────────────────────────────────────────

def describe(df: DataFrame, principals: DataFrame, sid: str = "sid") -> DataFrame:
    """Names for SIDs: unresolved ones show as themselves."""
    known = principals.select(F.col("sid").alias(sid), F.col("name").alias("p_name"),
                              F.col("display_name").alias("p_display"), F.col("kind").alias("p_kind"))
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return (df.join(known, sid, "left")
            .withColumn("name", F.coalesce(blank("p_name"), F.col(sid)))
            .withColumn("display_name", blank("p_display"))
            .withColumn("kind", F.coalesce("p_kind", F.lit("unknown")))
            .drop("p_name", "p_display", "p_kind"))


def exception_folders(folders: DataFrame, shares: DataFrame, acls: DataFrame, limit: int | None = None) -> DataFrame:
    """Folders with explicit, protected, missing or unreadable permissions."""
    flags = acls.select("acl_id", "has_explicit", "is_protected", "is_null_dacl", "aces")
    flagged = folders.join(flags, "acl_id", "left").filter(
        F.coalesce("has_explicit", F.lit(False)) | F.coalesce("is_protected", F.lit(False))
        | F.coalesce("is_null_dacl", F.lit(False)) | F.col("acl_error").isNotNull()
        | (F.col("acl_id").isNull() & (F.col("path") == "")))
    placed = flagged.join(shares.select("share_id", F.col("path").alias("share_path")), "share_id")
    return page(placed.select(
        "folder_id", F.col("share_path"), F.col("path").alias("folder_path"),
        P.display_path(F.col("share_path"), F.col("path")).alias("path"),
        (F.col("path") == "").alias("is_share_root"),
        F.coalesce("is_protected", F.lit(False)).alias("inheritance_disabled"),
        F.coalesce("is_null_dacl", F.lit(False)).alias("null_dacl"),
        F.coalesce(F.col("acl_error"), F.when(F.col("aces").isNull(), "No ACL recorded")).alias("acl_error"),
        "aces"), ["share_path", "folder_path"], limit)


def acl_exceptions(folders: DataFrame, shares: DataFrame, acls: DataFrame, principals: DataFrame,
                   limit: int | None = None) -> DataFrame:
    """One row per exception and entry that applies to the folder itself (or one empty entry)."""
    rows = exception_folders(folders, shares, acls, limit).withColumn(
        "aces", F.filter("aces", lambda a: ~A.has(a["flags"], INHERIT_ONLY)))
    flat = rows.select("folder_id", "path", "is_share_root", "inheritance_disabled", "null_dacl", "acl_error",
                       F.explode_outer("aces").alias("ace")).select(
        "*", F.col("ace.position").alias("position"), F.col("ace.sid").alias("sid"),
        F.col("ace.ace_type").alias("type"), A.access_level(F.col("ace.mask")).alias("level"),
        A.has(F.col("ace.flags"), INHERITED).alias("inherited")).drop("ace")
    named = describe(flat, principals)
    has_entry = F.col("sid").isNotNull()
    return named.withColumns({c: F.when(has_entry, F.col(c)) for c in ("name", "display_name", "kind", "level")})


def grid_columns(folders: DataFrame, shares: DataFrame, acls: DataFrame, max_depth: int = 2,
                 max_columns: int | None = None) -> DataFrame:
    """Share roots and folders near them with permissions of their own, all or the first `max_columns`."""
    flags = acls.select("acl_id", "has_explicit", "is_protected", "aces")
    near = folders.join(flags, "acl_id").filter(
        (F.col("path") == "")
        | ((F.col("depth") <= max_depth) & (F.col("has_explicit") | F.col("is_protected"))))
    placed = near.join(shares.select("share_id", F.col("path").alias("share_path")), "share_id")
    first = page(placed.select("share_path", F.col("path").alias("folder_path"), "folder_id", "acl_id", "aces"),
                 ["share_path", "folder_path"], max_columns)
    return first.select(
        "folder_id", "acl_id", P.display_path(F.col("share_path"), F.col("folder_path")).alias("path"),
        F.filter("aces", lambda a: ~A.has(a["flags"], INHERIT_ONLY)).alias("aces"))


def grid_accounts(columns: DataFrame, principals: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of the grid, (section, sid): all domain users, accounts an ACL of the columns names or that are in a group it names, and unresolved identities."""
    direct = columns.select(F.explode("aces.sid").alias("sid")).distinct()
    kinds = direct.join(principals.select("sid", "kind"), "sid", "left")
    groups = kinds.filter("kind = 'group'").select(F.col("sid").alias("group_sid"))
    users = kinds.filter("kind = 'user'").select("sid").union(members.join(groups, "group_sid", "left_semi").select("member_sid")).distinct()
    unknown = kinds.filter(F.col("kind").isNull() | (F.col("kind") == "unknown")).select("sid")
    everyone = constant_table(columns, [(0, None)], ["section", "sid"]).select("section", F.col("sid").cast("string").alias("sid"))
    return everyone.unionByName(users.select(F.lit(1).alias("section"), "sid")).unionByName(unknown.select(F.lit(2).alias("section"), "sid"))


def grid_rows(columns: DataFrame, principals: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of the grid as people read them: (section, sid, name, display_name, kind)."""
    rows = grid_accounts(columns, principals, members)
    fixed = {"name": "All domain users", "display_name": "Everyone with a domain account", "kind": "everyone"}
    everyone = rows.filter("section = 0").select("section", "sid", *[F.lit(v).alias(k) for k, v in fixed.items()])
    return everyone.unionByName(describe(rows.filter("section > 0"), principals).select("section", "sid", "name", "display_name", "kind"))


def permission_grid(folders: DataFrame, shares: DataFrame, acls: DataFrame, principals: DataFrame,
                    members: DataFrame, max_depth: int = 2, max_columns: int | None = None) -> DataFrame:
    """Effective access of every account that matters, in long form (one row per account and column).

    All columns, or a page of the first `max_columns`. Masks are evaluated per class of accounts and distinct ACL, and only where an entry names something the
    class holds; the rest falls back to what every account gets. Accounts get their levels last.
    """
    # Read by every branch below: computed once.
    columns = materialize(grid_columns(folders, shares, acls, max_depth, max_columns))
    parts = -(-columns.count() // GRID_PART) or 1
    used = columns.select("acl_id", "aces").dropDuplicates(["acl_id"])
    rows = materialize(grid_rows(columns, principals, members))
    account = ["section", "sid", "name", "display_name", "kind"]

    users = rows.filter("section = 1").select(F.col("sid").alias("user_sid"))
    tokens = materialize(named_tokens(users, members, used))
    classes = materialize(account_classes(users, tokens))
    masks = materialize(evaluate_classes(tokens, classes, used))
    fallback = masks.filter(F.col("class").isNull()).select("acl_id", F.col("mask").alias("generic_mask"))
    special = masks.filter(F.col("class").isNotNull())

    # A row meets the columns by an equi-join on their parts; no column is numbered.
    part = F.pmod(F.xxhash64("folder_id"), F.lit(parts)).alias("part")
    slots = columns.select("folder_id", "acl_id", "path", part).join(fallback, "acl_id")
    spread = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    # Levels are worked out for a class and column, of which there are few, and then handed to the accounts of the class: what is large is
    # not joined again. A class of many accounts is dealt over shares, each with the levels.
    sizes = materialize(classes.groupBy("class").agg(F.ceil(F.count("*") / CLASS_SHARE).cast("long").alias("shares")))
    levels = (spread(sizes).join(slots, "part").join(special, ["class", "acl_id"], "left")
              .select("class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"),
                      "folder_id", "path", A.access_level(F.coalesce("mask", "generic_mask")).alias("level")))
    share = F.pmod(F.xxhash64("sid"), F.col("shares")).alias("share")
    of_class = rows.filter("section = 1").join(classes.withColumnRenamed("user_sid", "sid"), "sid").join(sizes, "class").select(*account, "class", share)
    user_cells = of_class.join(levels, ["class", "share"]).select(*account, "folder_id", "path", "level")

    domain_groups = F.filter("aces.sid", lambda s: s.endswith("-" + DOMAIN_USERS_RID))
    with_aces = columns.select("folder_id", "path", "aces", part)
    everyone = spread(rows.filter("section = 0")).join(with_aces, "part").select(
        *account, "folder_id", "path", A.effective_mask(F.col("aces"), F.concat(A.sid_array(A.baseline()), domain_groups)).alias("mask"))
    unknown_cells = spread(rows.filter("section = 2")).join(with_aces, "part").select(
        *account, "folder_id", "path", A.effective_mask(F.col("aces"), F.array("sid")).alias("mask"))

    others = everyone.unionByName(unknown_cells).select(*account, "folder_id", "path", A.access_level(F.col("mask")).alias("level"))
    return user_cells.unionByName(others)


def grid_order() -> list[Column]:
    """Everyone first, then users by name, then unresolved identities by SID."""
    shown = F.lower(F.coalesce("display_name", "name"))
    return [F.asc("section"), F.when(F.col("section") == 1, shown).asc_nulls_last(), F.asc_nulls_first("sid"), F.asc("path")]


def grid_wide(grid: DataFrame, paths: list[str]) -> DataFrame:
    """The grid as people read it: one column per folder (a bounded, explicit pivot)."""
    account = F.coalesce("display_name", "name").alias("user")
    return (grid.groupBy("section", "sid", account, F.col("name").alias("account"), "kind")
            .pivot("path", paths).agg(F.first("level")))


def scan_history(scan_runs: DataFrame, share_id: int | None = None, limit: int | None = None) -> DataFrame:
    rows = scan_runs if share_id is None else scan_runs.filter(F.col("share_id") == share_id)
    return page(rows, [F.desc("run_id")], limit)
