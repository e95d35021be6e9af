"""Who may list which folder and open which file.

The estate's size never enters the evaluation: masks are computed once per distinct ACL (or
per distinct pair of file ACL and folder ACL) and files are then filtered by equi-joins on ACL
ids. A NULL ACL joins nothing, so unknown permissions hide a file.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aces as A
from ..functions import paths as P
from ..schema import CONTAINER_INHERIT, FILE_READ, INHERITED, OBJECT_INHERIT
from ..session import materialize

# Masks a core and part of the ACLs may have before ACLs are dealt over more parts, and the most parts.
MASK_PART, MASK_PARTS = 10_000, 64


# ── ACL dimension ────────────────────────────────────────────────────────────

def acl_arrays(entries: DataFrame) -> DataFrame:
    """Entry rows as one ordered array per ACL. A DACL is at most 64 KiB, so each array is small."""
    packed = F.collect_list(F.struct("position", "sid", "ace_type", "mask", "flags"))
    return entries.groupBy("acl_id").agg(A.ordered(packed).alias("aces"))


def distinct_acls(descriptors: DataFrame) -> DataFrame:
    """The ACL dimension of decoded descriptors (is_protected, is_null_dacl, aces): one row per content hash."""
    hashed = descriptors.select(
        A.acl_hash(F.col("aces"), F.col("is_protected"), F.col("is_null_dacl")).alias("acl_id"),
        "is_protected", "is_null_dacl", "aces")
    return (hashed.dropDuplicates(["acl_id"])
            .withColumn("has_explicit", F.exists("aces", lambda a: ~A.has(a["flags"], INHERITED))))


def own_acl(descriptors: DataFrame) -> DataFrame:
    """A file's own permissions: NULL `own_acl_id` when it only inherits, which is the norm.

    Only explicit entries are kept, and a missing DACL counts as protected: whatever the folder
    says, everyone has everything.
    """
    explicit = A.explicit_only(F.col("aces"))
    has_own = F.col("is_protected") | F.col("is_null_dacl") | (F.size(explicit) > 0)
    renumbered = F.transform(explicit, lambda a, i: F.struct(
        i.alias("position"), a["sid"].alias("sid"), a["ace_type"].alias("ace_type"),
        a["mask"].alias("mask"), a["flags"].alias("flags")))
    closed = F.col("is_protected") | F.col("is_null_dacl")
    return descriptors.withColumns({
        "own_protected": F.when(has_own, closed),
        "own_aces": F.when(has_own, renumbered),
        "own_acl_id": F.when(has_own, A.acl_hash(renumbered, closed, F.col("is_null_dacl"))),
    })


# ── One token ────────────────────────────────────────────────────────────────

def listable_acls(acls: DataFrame, token: A.Token) -> DataFrame:
    """ACLs whose folders this token may list."""
    return acls.filter(A.can_read(F.col("aces"), token)).select("acl_id")


def opening_acls(acls: DataFrame, token: A.Token) -> DataFrame:
    """Folder ACLs whose inheriting files this token may open."""
    return acls.filter(A.can_open_files(F.col("aces"), token)).select("acl_id")


def acl_pairs(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Distinct (file ACL, folder ACL, share) of files with permissions of their own."""
    own = files.filter(F.col("acl_id").isNotNull()).select(F.col("acl_id").alias("file_acl"), "folder_id", "share_id")
    # Collapse to one row per folder before joining: many files of a folder share an ACL.
    per_folder = own.distinct()
    where = folders.filter(F.col("acl_id").isNotNull()).select("folder_id", F.col("acl_id").alias("folder_acl"))
    return per_folder.join(where, "folder_id").select("file_acl", "folder_acl", "share_id").distinct()


def pair_aces(pairs: DataFrame, acls: DataFrame) -> DataFrame:
    """Each pair with the entries that decide it, in Windows' order."""
    own = acls.select(F.col("acl_id").alias("file_acl"), F.col("aces").alias("own"),
                      F.col("is_protected").alias("own_protected"))
    inherited = acls.select(F.col("acl_id").alias("folder_acl"), F.col("aces").alias("above"))
    empty = F.array().cast("array<struct<position:int,sid:string,ace_type:string,mask:bigint,flags:int>>")
    return (pairs.join(own, "file_acl", "left").join(inherited, "folder_acl", "left")
            .select("file_acl", "folder_acl", "share_id", A.own_then_inherited(
                F.coalesce("own", empty), F.coalesce("own_protected", F.lit(False)),
                F.coalesce("above", empty)).alias("aces")))


def opening_pairs(files: DataFrame, folders: DataFrame, acls: DataFrame, token: A.Token) -> DataFrame:
    """The pairs this token may open, per share."""
    return (pair_aces(acl_pairs(files, folders), acls)
            .filter(A.can_read(F.col("aces"), token)).select("file_acl", "folder_acl", "share_id"))


@dataclass(frozen=True)
class Access:
    """What one token opens, evaluated: folder ACLs for inheriting files, and (file ACL, folder ACL) pairs."""

    opens: DataFrame
    pairs: DataFrame


def prepare_access(files: DataFrame, folders: DataFrame, acls: DataFrame, token: A.Token) -> Access:
    """Evaluate a token once for many queries; both tables hold ACL ids only and are checkpointed."""
    return Access(materialize(opening_acls(acls, token)), materialize(opening_pairs(files, folders, acls, token)))


def visible_files(files: DataFrame, folders: DataFrame, acls: DataFrame, token: A.Token | Access) -> DataFrame:
    """Files this token may open, with their folder's `path` and `folder_acl`.

    Two disjoint branches instead of an OR-join: inheriting files need only an ACL id in a set,
    and files with their own ACL (rare, pushed down to the scan) need a pair in a set.
    """
    where = folders.select("folder_id", "path", F.col("acl_id").alias("folder_acl"))
    access = token if isinstance(token, Access) else Access(
        opening_acls(acls, token), opening_pairs(files, folders, acls, token))
    opens = access.opens.select(F.col("acl_id").alias("folder_acl"))
    open_folders = where.join(opens, "folder_acl", "left_semi")
    inheriting = files.filter(F.col("acl_id").isNull()).join(open_folders, "folder_id")
    pairs = access.pairs.select(F.col("file_acl").alias("acl_id"), "folder_acl")
    own = (files.filter(F.col("acl_id").isNotNull()).join(where, "folder_id")
           .join(pairs, ["acl_id", "folder_acl"], "left_semi"))
    return inheriting.unionByName(own)


def visible_shares(shares: DataFrame, files: DataFrame, folders: DataFrame, acls: DataFrame,
                   token: A.Token) -> DataFrame:
    """Enabled shares with a folder whose ACL opens files, or a file open by its own ACL."""
    by_folder = folders.join(opening_acls(acls, token), "acl_id", "left_semi").select("share_id")
    by_file = opening_pairs(files, folders, acls, token).select("share_id")
    return shares.filter("enabled").join(by_folder.union(by_file).distinct(), "share_id", "left_semi")


# ── Tokens ───────────────────────────────────────────────────────────────────

def user_tokens(users: DataFrame, members: DataFrame, acl_entries: DataFrame | None = None) -> DataFrame:
    """(user_sid, sid) rows of each user's token, in long form so no token is gathered in one row.

    With `acl_entries` only groups named in some ACL are kept, which is all evaluation needs.
    """
    groups = members.select(F.col("group_sid").alias("sid"), F.col("member_sid").alias("user_sid"))
    if acl_entries is not None:
        groups = groups.join(acl_entries.select("sid").distinct(), "sid", "left_semi")
    groups = groups.join(users.select("user_sid"), "user_sid", "left_semi").select("user_sid", "sid")
    fixed = users.select("user_sid", F.explode(A.token_from_groups(
        F.col("user_sid"), F.array().cast("array<string>"))).alias("sid"))
    return fixed.union(groups).distinct()


# ── Many tokens at once ──────────────────────────────────────────────────────

def evaluate_tokens(tokens: DataFrame, acls: DataFrame, as_files: bool = False) -> DataFrame:
    """Masks of many tokens on many ACLs, as (user_sid, acl_id, mask), sparse.

    `user_sid` NULL holds what an account with only the baseline gets on each ACL. A user has a
    row of its own only where an entry names something else in its token; everywhere else the
    baseline row is its answer. So the output is what differs, not users x ACLs, and the join
    never runs on the identities every token carries.
    """
    entries = A.inherited_by_files(F.col("aces")) if as_files else F.col("aces")
    dimension = acls.select("acl_id", entries.alias("aces"))
    generic = dimension.select(F.lit(None).cast("string").alias("user_sid"), "acl_id",
                               A.effective_mask(F.col("aces"), A.baseline()).alias("mask"))
    named = dimension.select("acl_id", F.explode("aces").alias("ace")).select(
        "acl_id", F.col("ace.sid").alias("sid"), F.col("ace.position").alias("position"))
    special = named.filter(~F.col("sid").isin(A.baseline()))
    personal = tokens.filter(~F.col("sid").isin(A.baseline()))
    # At most one position per entry of the ACL: bounded by the ACL, not by the user count.
    hits = (personal.join(special, "sid").groupBy("user_sid", "acl_id")
            .agg(F.collect_set("position").alias("positions")))
    baseline = A.sid_array(A.baseline())
    own = hits.join(dimension, "acl_id").select("user_sid", "acl_id", A.fold_mask(
        F.col("aces"), lambda a: F.array_contains(F.col("positions"), a["position"])
        | F.array_contains(baseline, a["sid"])).alias("mask"))
    return generic.unionByName(own)


# ── Classes of accounts ──────────────────────────────────────────────────────

def named_tokens(users: DataFrame, members: DataFrame, acls: DataFrame) -> DataFrame:
    """(user_sid, sid): what of each account's token the ACLs name beyond the baseline: groups, the account itself, its domain's users."""
    named = acls.select(F.explode("aces.sid").alias("sid")).distinct().filter(~F.col("sid").isin(A.baseline()))
    mine = users.select("user_sid")
    held = (members.select(F.col("member_sid").alias("user_sid"), F.col("group_sid").alias("sid")).join(mine, "user_sid", "left_semi")
            .unionByName(mine.select("user_sid", F.col("user_sid").alias("sid")))
            .unionByName(mine.select("user_sid", A.domain_users_sid(F.col("user_sid")).alias("sid")).dropna()))
    return held.join(named, "sid", "left_semi").select("user_sid", "sid").distinct()


def account_classes(users: DataFrame, tokens: DataFrame) -> DataFrame:
    """(user_sid, class): accounts with the same named identities share a class. One without any has the class "".

    `tokens` are distinct (user_sid, sid). The identities are never gathered: their number and two 64-bit sums name a class.
    """
    sums = [F.hex(F.bit_xor(F.xxhash64(F.lit(seed), "sid"))) for seed in (1, 2)]
    keyed = tokens.groupBy("user_sid").agg(F.concat_ws("-", F.count("*").cast("string"), *sums).alias("class"))
    return users.select("user_sid").join(keyed, "user_sid", "left").select("user_sid", F.coalesce("class", F.lit("")).alias("class"))


def class_tokens(tokens: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, sid): the identities of each class, read off one of its accounts."""
    one = classes.filter("class <> ''").groupBy("class").agg(F.min("user_sid").alias("user_sid"))
    return tokens.join(one, "user_sid").select("class", "sid")


@dataclass(frozen=True)
class ClassMasks:
    """Masks of classes in parts whose rows grow with the entries, and not with classes x ACLs.

    `generic` (acl_id, mask): what the baseline gets. `cores` (class, core): classes that differ only in identities no other class holds share a core.
    `shared` (core, acl_id, mask): where an entry names what a core holds. `own` (class, acl_id, mask): where one names what this class holds alone, instead of `shared`.
    """

    generic: DataFrame
    cores: DataFrame
    shared: DataFrame
    own: DataFrame


def class_masks(tokens: DataFrame, classes: DataFrame, acls: DataFrame, as_files: bool = False) -> ClassMasks:
    asked = materialize(class_tokens(tokens, classes).withColumnRenamed("class", "user_sid"))
    alone = asked.groupBy("sid").agg(F.min("user_sid").alias("class"), F.count("*").alias("n")).filter("n = 1").select("class", "sid")
    common = asked.join(alone.select("sid"), "sid", "left_anti").select("user_sid", "sid")
    cores = materialize(account_classes(asked.select("user_sid").distinct(), common).select(F.col("user_sid").alias("class"), F.col("class").alias("core")))
    of_core = class_tokens(common, cores.select(F.col("class").alias("user_sid"), F.col("core").alias("class")))
    both = materialize(evaluate_tokens(of_core.withColumnRenamed("class", "user_sid"), acls, as_files))

    entries = A.inherited_by_files(F.col("aces")) if as_files else F.col("aces")
    dimension = acls.select("acl_id", entries.alias("aces"))
    named = dimension.select("acl_id", F.explode("aces.sid").alias("sid")).distinct()
    # Of a class and an ACL that names it, all that both have; an ACL's entries are few.
    pairs = alone.join(named, "sid").select("class", "acl_id").distinct()
    held = (pairs.join(named, "acl_id").join(asked.withColumnRenamed("user_sid", "class"), ["class", "sid"])
            .groupBy("class", "acl_id").agg(F.collect_set("sid").alias("sids")))
    own = held.join(dimension, "acl_id").select("class", "acl_id", A.effective_mask(F.col("aces"), F.concat("sids", A.sid_array(A.baseline()))).alias("mask"))
    return ClassMasks(both.filter("user_sid IS NULL").select("acl_id", "mask"), cores,
                      both.filter("user_sid IS NOT NULL").select(F.col("user_sid").alias("core"), "acl_id", "mask"), materialize(own))


def spread_masks(masks: ClassMasks, about: DataFrame) -> DataFrame:
    """(acl_id, mask) of every class of `about` wherever an entry names something it holds, with the columns of `about`, where `class` is distinct.

    The result may have as many rows as classes x ACLs. It is not shuffled: each class and the masks of its core are dealt over parts of the ACLs and meet there,
    the few ACLs a class has a mask of its own for are left out as they meet, and these masks are added.
    """
    parts = min(MASK_PARTS, masks.shared.count() // MASK_PART + 1)
    part = F.pmod(F.xxhash64("acl_id"), F.lit(parts)).alias("part")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
    but = masks.own.groupBy("class", part).agg(F.collect_list("acl_id").alias("but"))
    dealt = (about.join(masks.cores.filter("core <> ''"), "class").select("*", every).join(but, ["class", "part"], "left")
             .repartition(4 * parts, "core", "part"))
    left = F.coalesce(~F.array_contains("but", F.col("acl_id")), F.lit(True))
    columns = [*about.columns, "acl_id", "mask"]
    shared = dealt.join(masks.shared.select("*", part), ["core", "part"]).filter(left).select(*columns)
    return shared.unionByName(about.join(masks.own, "class").select(*columns))


def evaluate_classes(tokens: DataFrame, classes: DataFrame, acls: DataFrame, as_files: bool = False) -> DataFrame:
    """(class, acl_id, mask), sparse as `evaluate_tokens`: class NULL is what the baseline gets, also class "" and wherever a class has no row.

    Rows grow with the classes, not with the accounts: if only a domain's users are named, all of a domain are one class.
    """
    masks = class_masks(tokens, classes, acls, as_files)
    generic = masks.generic.select(F.lit(None).cast("string").alias("class"), "acl_id", "mask")
    return generic.unionByName(spread_masks(masks, masks.cores.select("class")))


# ── Drift between the index and the file server ──────────────────────────────

def live_access_drift(files: DataFrame, indexed_visible: DataFrame, live: DataFrame, token: A.Token) -> DataFrame:
    """Index decision against a fresh full file DACL.

    `live` has (file_id, aces, readable): aces NULL means no descriptor (denied), readable false
    means the server could not answer.
    """
    verdict = (F.when(~F.coalesce("readable", F.lit(False)), "unavailable")
               .when(F.col("aces").isNotNull() & A.can_read(F.col("aces"), token), "allow")
               .otherwise("deny"))
    seen = indexed_visible.select("file_id").withColumn("indexed", F.lit(True))
    return (files.select("file_id").join(live, "file_id", "left").join(seen, "file_id", "left")
            .select("file_id", F.coalesce("indexed", F.lit(False)).alias("indexed_visible"), verdict.alias("live")))


# ── Permissions from rules ───────────────────────────────────────────────────

def _grants(names: Column, kind: str, flags: int) -> Column:
    return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.struct(
        A.demo_sid(n).alias("sid"), F.lit(kind).alias("ace_type"),
        F.lit(FILE_READ).cast("long").alias("mask"), F.lit(flags).alias("flags")))


def _rule_aces(read: Column, deny: Column, only_list: Column, broken: Column) -> Column:
    """Deny first, then read, both inherited by everything below; `list` reaches this folder only."""
    inherit = OBJECT_INHERIT | CONTAINER_INHERIT
    every = F.concat(_grants(deny, "deny", inherit), _grants(read, "allow", inherit), _grants(only_list, "allow", 0))
    return F.when(broken, F.filter(every, lambda _: F.lit(False))).otherwise(every)


def _passed_on(aces: Column, flag: int) -> Column:
    return F.transform(F.filter(aces, lambda a: A.has(a["flags"], flag)), lambda a: F.struct(
        a["sid"].alias("sid"), a["ace_type"].alias("ace_type"), a["mask"].alias("mask"),
        a["flags"].bitwiseOR(F.lit(INHERITED)).alias("flags")))


def _numbered(aces: Column) -> Column:
    return F.transform(aces, lambda a, i: F.struct(
        i.alias("position"), a["sid"].alias("sid"), a["ace_type"].alias("ace_type"),
        a["mask"].alias("mask"), a["flags"].alias("flags")))


def nearest_rules(folders: DataFrame, rules: DataFrame) -> DataFrame:
    """For every folder the rule at or above it: (folder_id, rule_path, rule_aces).

    `rules` has (share_id, path, read, deny, list, broken). Without any, everyone reads.
    """
    prepared = rules.select(
        "share_id", F.col("path").alias("rule_path"),
        _rule_aces(F.col("read"), F.col("deny"), F.col("list"), F.col("broken")).alias("rule_aces"))
    above = folders.select("folder_id", "share_id", F.explode(P.ancestors(F.col("path"))).alias("rule_path"))
    found = (above.join(prepared, ["share_id", "rule_path"])
             .groupBy("folder_id").agg(F.max_by(F.struct("rule_path", "rule_aces"), P.depth(F.col("rule_path"))).alias("r"))
             .select("folder_id", "r.rule_path", "r.rule_aces"))
    default = _rule_aces(F.array(F.lit("everyone")), F.lit(None).cast("array<string>"),
                         F.lit(None).cast("array<string>"), F.lit(False))
    return (folders.join(found, "folder_id", "left")
            .withColumn("rule_path", F.coalesce("rule_path", F.lit("")))
            .withColumn("rule_aces", F.coalesce("rule_aces", default)))


def derive_folder_acls(folders: DataFrame, rules: DataFrame) -> DataFrame:
    """The ACL each folder would have: protected where the rule is set, inherited below it."""
    at_rule = F.col("rule_path") == F.col("path")
    return nearest_rules(folders, rules).select(
        "share_id", "folder_id", "path", at_rule.alias("is_protected"),
        _numbered(F.when(at_rule, F.col("rule_aces"))
                  .otherwise(_passed_on(F.col("rule_aces"), CONTAINER_INHERIT))).alias("aces"))


def derive_file_acls(files: DataFrame, folders: DataFrame, rules: DataFrame, file_rules: DataFrame) -> DataFrame:
    """The full ACL each file would have. `file_rules`: (folder_id, name, read, deny, list, inherit)."""
    inherited = nearest_rules(folders, rules).select(
        "folder_id", _passed_on(F.col("rule_aces"), OBJECT_INHERIT).alias("inherited"))
    own = file_rules.select(
        "folder_id", "name", "inherit",
        F.transform(_rule_aces(F.col("read"), F.col("deny"), F.col("list"), F.lit(False)), lambda a: F.struct(
            a["sid"].alias("sid"), a["ace_type"].alias("ace_type"), a["mask"].alias("mask"),
            F.lit(0).alias("flags"))).alias("explicit"))
    combined = (F.when(F.col("explicit").isNull(), F.col("inherited"))
                .when(F.coalesce("inherit", F.lit(False)), F.concat("explicit", "inherited"))
                .otherwise(F.col("explicit")))
    return (files.join(inherited, "folder_id").join(own, ["folder_id", "name"], "left")
            .select("file_id", "share_id", "folder_id", "name",
                    (F.col("explicit").isNotNull() & ~F.coalesce("inherit", F.lit(False))).alias("is_protected"),
                    _numbered(combined).alias("aces")))


def tokens_for(sid: str, groups: Iterable[str]) -> list[str]:
    """The token of one signed-in account as plain SIDs, for single-user queries."""
    domain, _, rid = sid.rpartition("-")
    primary = [f"{domain}-513"] if domain.startswith("S-1-5-21-") and rid.isdigit() else []
    return sorted({sid, *groups, *A.baseline(), *primary})
