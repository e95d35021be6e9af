"""The folder plan: agreed structure of each share, and how far the real tree follows it.

All shares are evaluated together. Tree questions become equi-joins on ancestor paths, so no
step walks a tree and no share is handled in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import paths as P
from ..functions import values as V
from ..functions.text import fold
from ..schema import DEFAULT_MAX_FILES, HISTORY_DAYS
from ..session import materialize
from .common import top_per_group

TOTALS = ["files_total", "files_in_plan", "files_checked", "files_misnamed", "files_wrong_type",
          "folders_planned", "folders_missing", "folders_empty", "folders_overgrown"]
TEXT_FIELDS = ["purpose", "belongs", "not_belongs", "owner", "naming"]
LIST_FIELDS = ["examples", "extensions", "keywords"]


# ── Editing ──────────────────────────────────────────────────────────────────

def in_tree_order(plan: DataFrame) -> DataFrame:
    return plan.orderBy("share_id", P.tree_order(F.col("path_key")))


def proposal_problems(plan: DataFrame, proposals: DataFrame) -> DataFrame:
    """Why each proposed (share_id, path) can't be added: conflict, missing parent, bad name, or NULL."""
    path = P.normalize_path(F.col("path"))
    asked = proposals.withColumn("path", path).withColumn("path_key", P.path_key(path))
    asked = asked.withColumn("parent_key", P.parent(F.col("path_key")))
    keys = plan.select("share_id", F.col("path_key"))
    taken = keys.withColumn("taken", F.lit(True))
    parents = keys.select("share_id", F.col("path_key").alias("parent_key")).withColumn("has_parent", F.lit(True))
    planned = keys.select("share_id").distinct().withColumn("has_plan", F.lit(True))
    joined = (asked.join(taken, ["share_id", "path_key"], "left").join(parents, ["share_id", "parent_key"], "left")
              .join(planned, "share_id", "left"))
    reasons = P.path_problems(F.col("path"))
    problem = (F.when(F.size(reasons) > 0, F.concat(F.lit("name: "), F.array_join(reasons, ", ")))
               .when(F.col("taken"), "already in the plan")
               .when(F.col("path_key") == "", F.lit(None))
               .when(F.col("has_parent").isNull() & F.col("has_plan").isNull(), "start with the share's root")
               .when(F.col("has_parent").isNull(), "add its parent first"))
    return joined.select("share_id", "path", "path_key", (F.col("path_key") != "").alias("default_allow_files"),
                         problem.alias("problem"))


def merge_fields(plan: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply changed fields by (share_id, path_key): NULL means not sent, "" clears a text or pattern.

    `changes` may hold any of the plan's columns. A pattern with an unknown placeholder is not
    applied; it is reported in `problem`.
    """
    sent = [c for c in changes.columns if c not in ("share_id", "path_key")]
    renamed = changes.select("share_id", "path_key", *[F.col(c).alias(f"new_{c}") for c in sent])
    joined = plan.join(renamed, ["share_id", "path_key"], "left")
    out = {}
    for c in sent:
        new, old = F.col(f"new_{c}"), F.col(c)
        if c in TEXT_FIELDS:
            out[c] = F.coalesce(F.trim(new), old)
        elif c in LIST_FIELDS:
            out[c] = F.coalesce(V.clean_list(new, extensions=c == "extensions"), old)
        elif c == "naming_pattern":
            tidy = F.trim(new)
            out[c] = (F.when(new.isNull() | N.pattern_problem(tidy).isNotNull(), old)
                      .when(tidy != "", tidy))
        else:
            out[c] = F.coalesce(new, old)
    problem = N.pattern_problem(F.col("new_naming_pattern")) if "naming_pattern" in sent else F.lit(None).cast("string")
    return joined.select(*[out[c].alias(c) if c in out else c for c in plan.columns], problem.alias("problem"))


def move_problems(plan: DataFrame, moves: DataFrame) -> DataFrame:
    """`moves` is (share_id, path_key, new_path); adds `problem` (NULL: it can be done)."""
    new_path = P.normalize_path(F.col("new_path"))
    asked = (moves.withColumn("new_path", new_path).withColumn("new_key", P.path_key(new_path))
             .withColumn("new_parent", P.parent(P.path_key(new_path))))
    keys = plan.select("share_id", F.col("path_key"))
    joined = (asked.join(keys.withColumnRenamed("path_key", "new_key").withColumn("taken", F.lit(True)),
                         ["share_id", "new_key"], "left")
              .join(keys.withColumnRenamed("path_key", "new_parent").withColumn("has_parent", F.lit(True)),
                    ["share_id", "new_parent"], "left"))
    problem = (F.when(F.col("path_key") == "", "the root can't be moved")
               .when(F.col("new_key") == "", "another entry can't become the root")
               .when((F.col("new_key") != F.col("path_key")) & F.col("taken").isNotNull(), "already in the plan")
               .when(F.startswith("new_key", F.concat("path_key", F.lit("/"))), "can't be moved inside itself")
               .when(F.col("has_parent").isNull(), "add the new parent first"))
    return joined.select("share_id", "path_key", "new_path", "new_key", problem.alias("problem"))


def move_subtrees(plan: DataFrame, moves: DataFrame) -> DataFrame:
    """The plan after the possible moves: an entry moves with everything planned below it."""
    doable = (move_problems(plan, moves).filter(F.col("problem").isNull())
              .select("share_id", F.col("path_key").alias("moved_key"), "new_path"))
    above = plan.select("share_id", "path_key", F.explode(P.ancestors(F.col("path_key"))).alias("moved_key"))
    nearest = (above.join(doable, ["share_id", "moved_key"]).groupBy("share_id", "path_key")
               .agg(F.max_by(F.struct("moved_key", "new_path"), P.depth(F.col("moved_key"))).alias("m")))
    moved = plan.join(nearest, ["share_id", "path_key"], "left")
    path = F.when(F.col("m").isNotNull(), F.concat(
        F.col("m.new_path"), F.substr(F.col("path"), F.length(F.col("m.moved_key")) + 1))).otherwise(F.col("path"))
    return moved.withColumn("path", path).withColumn("path_key", P.path_key(F.col("path"))).select(*plan.columns)


def delete_subtrees(plan: DataFrame, doomed: DataFrame) -> DataFrame:
    """The plan without the given (share_id, path_key) entries and all below; a root takes everything."""
    above = plan.select("share_id", "path_key", F.explode(P.ancestors(F.col("path_key"))).alias("root_key"))
    gone = (above.join(doomed.select("share_id", F.col("path_key").alias("root_key")), ["share_id", "root_key"],
                       "left_semi").select("share_id", "path_key").distinct())
    return plan.join(gone, ["share_id", "path_key"], "left_anti")


def import_folders(plan: DataFrame, folders: DataFrame, shares: DataFrame, depth: int) -> DataFrame:
    """Entries to add so the plan covers the real folders down to `depth` levels.

    A folder joins only when all its ancestors are planned or join too; the deepest level allows
    subfolders. Of folders whose paths differ only in case the first one (by depth, then path) joins.
    """
    key = P.path_key(F.col("path"))
    keys = plan.select("share_id", "path_key")
    near = folders.filter((F.col("depth") >= 1) & (F.col("depth") <= depth)).select(
        "share_id", "path", "depth", key.alias("path_key"))
    # min() keeps one spelling per key with a map-side combine, where a window would sort whole shares.
    first = near.groupBy("share_id", "path_key").agg(F.min("path").alias("path"), F.min("depth").alias("depth"))
    new = first.join(keys, ["share_id", "path_key"], "left_anti")
    roots = shares.select("share_id", F.lit("").alias("path"), F.lit("").alias("path_key"),
                          F.lit(0).cast("long").alias("depth")).join(keys, ["share_id", "path_key"], "left_anti")
    # Ancestors have lower depth, so "every proper ancestor is planned or imported" needs no recursion.
    available = keys.unionByName(new.select("share_id", "path_key")).unionByName(
        roots.select("share_id", "path_key")).distinct().select("share_id", F.col("path_key").alias("above"))
    needs = new.select("share_id", "path_key", F.explode(P.ancestors(F.col("path_key"))).alias("above"))
    orphans = (needs.join(available, ["share_id", "above"], "left_anti").select("share_id", "path_key").distinct())
    kept = new.join(orphans, ["share_id", "path_key"], "left_anti").unionByName(roots.select(*new.columns))
    return kept.select("share_id", "path", "path_key", (F.col("path_key") != "").alias("allow_files"),
                       ((F.col("depth") == depth) & (F.col("path_key") != "")).alias("allow_subfolders"))


def example_problems(plan: DataFrame) -> DataFrame:
    """Examples their own entry would reject, as (share_id, path_key, example, problem)."""
    flat = plan.select("share_id", "path_key", "extensions", N.pattern_regex(F.col("naming_pattern")).alias("regex"),
                       F.posexplode("examples").alias("ordinal", "example"))
    misnamed = F.col("regex").isNotNull() & ~N.matches_pattern(F.col("example"), F.col("regex"))
    odd = (F.size("extensions") > 0) & ~F.array_contains("extensions", N.extension(F.col("example"), None))
    problem = F.when(misnamed, "pattern").when(odd, "type")
    return flat.select("share_id", "path_key", "ordinal", "example", problem.alias("problem")).filter("problem IS NOT NULL")


# ── Views of the plan ────────────────────────────────────────────────────────

def entry_rows(plan: DataFrame, shares: DataFrame) -> DataFrame:
    """Entries as shown: with share, own name, depth and the path people paste."""
    roots = shares.select("share_id", F.col("name").alias("share"), F.col("path").alias("share_path"), "enabled")
    joined = plan.join(roots, "share_id")
    name = F.when(F.col("path") == "", F.col("share")).otherwise(P.base_name(F.col("path")))
    return joined.select("*", name.alias("name"), P.depth(F.col("path")).alias("depth"),
                         P.display_path(F.col("share_path"), F.col("path")).alias("network_path"))


def admin_view(plan: DataFrame, shares: DataFrame, folders: DataFrame) -> DataFrame:
    """Every entry with its folder, if it exists, and the examples it would reject."""
    real = (folders.groupBy("share_id", P.path_key(F.col("path")).alias("path_key"))
            .agg(F.min("folder_id").alias("folder_id")))
    # Examples are a short list typed by a person, so one array per entry stays small.
    problems = example_problems(plan).groupBy("share_id", "path_key").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "example", "problem"))).alias("p"))
    return (entry_rows(plan, shares).join(real, ["share_id", "path_key"], "left")
            .join(problems, ["share_id", "path_key"], "left")
            .withColumn("exists", F.col("folder_id").isNotNull())
            .withColumn("example_problems", F.coalesce(
                F.transform("p", lambda x: F.concat(x["example"], F.lit(": "), x["problem"])),
                F.array().cast("array<string>"))).drop("p"))


def guide(plan: DataFrame, shares: DataFrame, folders: DataFrame, listable: DataFrame) -> DataFrame:
    """Entries one account may see: their folder, or the nearest one above that exists, can be listed."""
    real = folders.select("share_id", P.path_key(F.col("path")).alias("above"), "folder_id", "acl_id")
    above = plan.select("share_id", "path_key", F.explode(P.ancestors(F.col("path_key"))).alias("above"))
    nearest = (above.join(real, ["share_id", "above"]).groupBy("share_id", "path_key")
               .agg(F.max_by(F.struct("above", "folder_id", "acl_id"), P.depth(F.col("above"))).alias("n"))
               .select("share_id", "path_key", F.col("n.acl_id").alias("acl_id"),
                       F.when(F.col("n.above") == F.col("path_key"), F.col("n.folder_id")).alias("folder_id")))
    allowed = nearest.join(listable, "acl_id", "left_semi").select("share_id", "path_key", "folder_id")
    return entry_rows(plan, shares).filter("enabled").join(allowed, ["share_id", "path_key"])


def guide_text(entry: DataFrame, query: str) -> DataFrame:
    """Entries in which every typed word appears somewhere."""
    text = fold(F.concat_ws(" ", "path", "purpose", "belongs", "naming", "owner", "keywords", "examples", "extensions"))
    typed = F.filter(F.split(fold(F.lit(query)), r"\s+"), lambda w: w != "")
    return entry.filter(F.forall(typed, lambda w: F.contains(text, w)))


# ── Where folders stand ──────────────────────────────────────────────────────

def placements(folders: DataFrame, plan: DataFrame) -> DataFrame:
    """Folders of planned shares as planned, free or outside, with the nearest entry at or above them.

    Each folder's ancestors meet the plan by an equi-join; the partial `max_by` collapses them
    again before anything is shuffled by folder.
    """
    rules = plan.select("share_id", F.col("path_key").alias("entry_key"), F.struct(
        F.col("path_key").alias("entry_key"), F.col("path").alias("entry_path"), "allow_files", "allow_subfolders",
        N.pattern_regex(F.col("naming_pattern")).alias("regex"), "naming_pattern", "extensions",
        "max_files").alias("entry"))
    key = P.path_key(F.col("path"))
    above = folders.select("folder_id", "share_id", F.explode(P.ancestors(key)).alias("entry_key"))
    nearest = (above.join(rules, ["share_id", "entry_key"]).groupBy("folder_id")
               .agg(F.max_by("entry", P.depth(F.col("entry_key"))).alias("entry")))
    planned_shares = plan.select("share_id").distinct()
    status = (F.when(F.col("entry.entry_key") == key, "planned")
              .when(F.col("entry.allow_subfolders"), "free").otherwise("outside"))
    return (folders.join(planned_shares, "share_id", "left_semi").join(nearest, "folder_id", "left")
            .select("share_id", "folder_id", "path", "list_error", status.alias("status"), "entry.*"))


def subtree_counts(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Direct and subtree file counts, and whether anything at or below could not be listed.

    Files are counted per folder first, so ancestors are expanded per folder and not per file.
    """
    direct = files.groupBy("folder_id").agg(F.count("*").alias("direct"))
    base = folders.select("share_id", "folder_id", "path", F.col("list_error").isNotNull().alias("unlisted"))
    counted = base.join(direct, "folder_id", "left").withColumn("direct", F.coalesce("direct", F.lit(0)))
    # Nothing to add above folders that are empty and listed.
    rolled = (counted.filter((F.col("direct") > 0) | F.col("unlisted"))
              .select("share_id", F.explode(P.ancestors(F.col("path"))).alias("path"), "direct", "unlisted")
              .groupBy("share_id", "path").agg(F.sum("direct").alias("subtree"), F.bool_or("unlisted").alias("unknown")))
    return (counted.join(rolled, ["share_id", "path"], "left")
            .select("share_id", "folder_id", "path", "direct", F.coalesce("subtree", F.lit(0)).alias("subtree"),
                    F.coalesce("unknown", F.lit(False)).alias("unknown")))


def folder_facts(folders: DataFrame, files: DataFrame, plan: DataFrame, reused: bool = False) -> DataFrame:
    """Placement and counts side by side: what every compliance rule looks at.

    With `reused` the result, one narrow row per folder, is checkpointed: a full report reads it
    several times.
    """
    counts = subtree_counts(folders, files).select("folder_id", "direct", "subtree", "unknown")
    facts = placements(folders, plan).join(counts, "folder_id")
    return materialize(facts) if reused else facts


def _is_branch_top() -> Column:
    """An outside folder whose parent is not outside.

    Folders between an entry and this one share its nearest entry, hence its status; so the parent
    differs only when it is the entry's own folder (or there is no parent).
    """
    below_entry = P.depth(F.col("path")) == P.depth(F.col("entry_path")) + 1
    return F.when(F.col("entry_path").isNull(), F.col("path") == "").otherwise(below_entry)


def _is_closed() -> Column:
    """Planned, but only to group other folders."""
    return (F.col("status") == "planned") & ~F.col("allow_files")


def _is_empty() -> Column:
    return (F.col("status") == "planned") & (F.col("subtree") == 0) & ~F.col("unknown")


def _file_limit(default_limit: int) -> Column:
    return F.when(F.coalesce("max_files", F.lit(0)) > 0, F.col("max_files")).otherwise(F.lit(default_limit)).cast("long")


def _is_overgrown(default_limit: int) -> Column:
    takes = (F.col("status") == "free") | ((F.col("status") == "planned") & F.col("allow_files"))
    return takes & (F.col("direct") > _file_limit(default_limit))


def outside_branches(facts: DataFrame) -> DataFrame:
    """Tops of unplanned branches, with everything below them."""
    return facts.filter((F.col("status") == "outside") & _is_branch_top()).select(
        "share_id", "folder_id", "path", F.col("subtree").alias("files"),
        F.lit("not_in_plan").alias("reason"), F.col("entry_path").alias("plan_path"))


def files_not_allowed(facts: DataFrame) -> DataFrame:
    """Planned folders that only group others, yet hold files."""
    return facts.filter(_is_closed() & (F.col("direct") > 0)).select(
        "share_id", "folder_id", "path", F.col("direct").alias("files"),
        F.lit("no_files_here").alias("reason"), F.col("entry_path").alias("plan_path"))


def governed_files(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Files in folders whose entry has naming or type rules, checked against both."""
    governed = facts.filter("(status = 'free' OR (status = 'planned' AND allow_files)) "
                            "AND (regex IS NOT NULL OR size(extensions) > 0)").select(
        "folder_id", "share_id", "path", "entry_path", "regex", "naming_pattern", "extensions")
    inside = files.select("file_id", "folder_id", "name", "extension").join(governed, "folder_id")
    return inside.withColumns({
        "checked": F.col("regex").isNotNull(),
        "misnamed": F.coalesce(~N.matches_pattern(F.col("name"), F.col("regex")), F.lit(False)),
        "wrong_type": (F.size("extensions") > 0) & ~F.array_contains("extensions", F.col("extension"))})


def missing_folders(plan: DataFrame, folders: DataFrame) -> DataFrame:
    """Planned folders not on disk, unless the folder that would hold them could not be listed."""
    real = folders.select("share_id", P.path_key(F.col("path")).alias("above"), "list_error")
    absent = plan.select("share_id", "path", "path_key").join(
        real.select("share_id", F.col("above").alias("path_key")), ["share_id", "path_key"], "left_anti")
    above = absent.select("share_id", "path_key", F.explode(P.ancestors(F.col("path_key"))).alias("above"))
    hidden = (above.join(real, ["share_id", "above"]).groupBy("share_id", "path_key")
              .agg(F.max_by(F.struct("list_error"), P.depth(F.col("above"))).alias("n"))
              .filter("n.list_error IS NOT NULL").select("share_id", "path_key"))
    return absent.join(hidden, ["share_id", "path_key"], "left_anti")


def empty_planned(facts: DataFrame) -> DataFrame:
    """Planned folders known to hold nothing at any depth."""
    return facts.filter(_is_empty()).select("share_id", "folder_id", "path")


def overgrown(facts: DataFrame, default_limit: int = DEFAULT_MAX_FILES) -> DataFrame:
    """Folders with more direct files than their entry allows."""
    return facts.filter(_is_overgrown(default_limit)).select(
        "share_id", "folder_id", "path", F.col("direct").alias("files"), _file_limit(default_limit).alias("limit"))


def totals(facts: DataFrame, files: DataFrame, plan: DataFrame, folders: DataFrame) -> DataFrame:
    """The nine totals of every planned share: one pass over folders, one over governed files."""
    off_plan = (F.col("status") == "outside") | _is_closed()
    tree = facts.groupBy("share_id").agg(
        F.sum("direct").alias("files_total"),
        F.sum(F.when(off_plan, 0).otherwise(F.col("direct"))).alias("files_in_plan"),
        F.count_if(_is_empty()).alias("folders_empty"),
        F.count_if(_is_overgrown(DEFAULT_MAX_FILES)).alias("folders_overgrown"))
    named = governed_files(facts, files).groupBy("share_id").agg(
        F.count_if("checked").alias("files_checked"), F.count_if("misnamed").alias("files_misnamed"),
        F.count_if("wrong_type").alias("files_wrong_type"))
    planned = plan.groupBy("share_id").agg(F.count("*").alias("folders_planned"))
    absent = missing_folders(plan, folders).groupBy("share_id").agg(F.count("*").alias("folders_missing"))
    joined = reduce(lambda left, right: left.join(right, "share_id", "left"), [planned, tree, named, absent])
    return joined.select("share_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in TOTALS])


# ── Lists ────────────────────────────────────────────────────────────────────

def _issue(label: str, files: Column, detail: Column, plan_folder: Column) -> Column:
    return F.struct(F.lit(label).alias("issue"), files.cast("long").alias("files"), detail.alias("detail"),
                    plan_folder.alias("plan_folder"))


def _present(*issues_found: Column) -> Column:
    """Zero or more issues of one row."""
    return F.filter(F.array(*issues_found), lambda i: i.isNotNull())


def issues(facts: DataFrame, files: DataFrame, plan: DataFrame, folders: DataFrame, shares: DataFrame) -> DataFrame:
    """All violations in one shape: (share_id, issue, path, files, detail, plan_path).

    Three passes whatever the number of rules: folders, governed files, and planned folders not there.
    """
    none, zero, blank = F.lit(None).cast("string"), F.lit(0), F.lit("")
    entry = F.col("entry_path")
    count = lambda c: F.concat(F.col(c).cast("string"), F.lit(" files"))
    cap = _file_limit(DEFAULT_MAX_FILES).cast("string")
    of_folder = _present(
        F.when((F.col("status") == "outside") & _is_branch_top(),
               _issue("outside the plan", F.col("subtree"), count("subtree"), entry)),
        F.when(_is_closed() & (F.col("direct") > 0),
               _issue("files not allowed here", F.col("direct"), count("direct"), entry)),
        F.when(_is_empty(), _issue("planned folder empty", zero, blank, F.col("path"))),
        F.when(_is_overgrown(DEFAULT_MAX_FILES), _issue(
            "overgrown", F.col("direct"), F.concat(count("direct"), F.lit(" (limit "), cap, F.lit(")")), none)))
    wrong = F.concat(F.lit("."), F.col("extension"), F.lit(" (expected "), F.array_join("extensions", ", "), F.lit(")"))
    of_file = _present(F.when(F.col("misnamed"), _issue("naming", zero, F.col("naming_pattern"), entry)),
                       F.when(F.col("wrong_type"), _issue("file type", zero, wrong, entry)))
    flat = (facts.select("share_id", F.col("path").alias("folder"), blank.alias("name"), F.explode(of_folder).alias("i"))
            .unionByName(governed_files(facts, files).select(
                "share_id", F.col("path").alias("folder"), "name", F.explode(of_file).alias("i")))
            .unionByName(missing_folders(plan, folders).select(
                "share_id", F.col("path").alias("folder"), blank.alias("name"),
                _issue("planned folder missing", zero, blank, F.col("path")).alias("i"))))
    shown = flat.join(shares.select("share_id", F.col("path").alias("share_path")), "share_id").select("*", "i.*")
    return shown.select(
        "share_id", "issue", P.display_path(F.col("share_path"), F.col("folder"), F.col("name")).alias("path"),
        "files", "detail",
        F.when(F.col("plan_folder").isNotNull(), P.display_path(F.col("share_path"), F.col("plan_folder"))).alias("plan_path"))


def issue_order() -> list[Column]:
    """Biggest folders first, then tree order."""
    return [F.desc("files"), F.asc(F.split(F.lower(F.translate("path", "\\", "/")), "/")), F.asc("path"), F.asc("detail")]


def capped_issues(rows: DataFrame, limit: int | None = 200) -> DataFrame:
    """The first `limit` rows of each share's list, with the full count of that list.

    "Outside the plan" and "files not allowed here" are one list. Counting is a separate
    aggregate, so the ranking keeps only `limit` rows per task before its shuffle.
    """
    kind = F.when(F.col("issue") == "files not allowed here", "outside the plan").otherwise(F.col("issue"))
    rows = rows.withColumn("list", kind)
    counts = rows.groupBy("share_id", "list").agg(F.count("*").alias("list_count"))
    if limit == 0:
        return counts
    if limit is not None:
        rows = top_per_group(rows, ["share_id", "list"], issue_order(), limit).drop("rank")
    return rows.join(counts, ["share_id", "list"])


# ── Progress ─────────────────────────────────────────────────────────────────

def snapshot(folders: DataFrame, files: DataFrame, plan: DataFrame, shares: DataFrame, day: str,
             taken_at: str) -> DataFrame:
    """Today's totals of every enabled share with a plan."""
    enabled = shares.filter("enabled").select("share_id")
    facts = folder_facts(folders, files, plan, reused=True)
    return (totals(facts, files, plan, folders).join(enabled, "share_id", "left_semi")
            .select("share_id", F.lit(day).cast("date").alias("day"), V.at(taken_at).alias("taken_at"), *TOTALS))


def upsert_snapshots(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row per share and day: a rerun on the same day replaces its row."""
    cols = [c for c in fresh.columns if c not in ("share_id", "day")]
    both = history.select(*fresh.columns).unionByName(fresh)
    latest = both.groupBy("share_id", "day").agg(F.max_by(F.struct(*cols), "taken_at").alias("s"))
    return latest.select("share_id", "day", *[F.col(f"s.{c}").alias(c) for c in cols])


def progress(history: DataFrame, shares: DataFrame, today: str, days: int = HISTORY_DAYS) -> DataFrame:
    """Snapshots of the last `days` days with their share's name, and the two plotted percentages."""
    recent = history.filter(F.col("day") >= F.date_sub(F.lit(today).cast("date"), days))
    named = recent.join(shares.select("share_id", F.col("name").alias("share")), "share_id")
    return with_percentages(named).orderBy("share", "day")


def with_percentages(totals_rows: DataFrame) -> DataFrame:
    return totals_rows.withColumns({
        "in_plan_pct": V.percentage(F.col("files_in_plan"), F.col("files_total")),
        "well_named_pct": V.percentage(F.col("files_checked") - F.col("files_misnamed"), F.col("files_checked"))})
