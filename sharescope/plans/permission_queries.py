"""Permissions: decoding, evaluation for one and for many tokens, derived ACLs, the grid."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aces as A
from ..operators import permissions as X
from ..operators import reports as R
from ..operators.common import numbered
from ..session import materialize
from ..sources import descriptors as DS
from ..sources.derived import Estate
from . import base_sql as S
from .registry import query


def ace_text(aces) -> F.Column:
    return F.array_join(F.transform(aces, lambda a: F.concat_ws(
        ":", a["ace_type"], a["sid"], a["mask"].cast("string"), a["flags"].cast("string"))), " ")


# ── Descriptors ──────────────────────────────────────────────────────────────

def raw_descriptors(e: Estate) -> DataFrame:
    """One binary descriptor per file: owners and groups by arithmetic, some without DACL, some cut short."""
    owner = F.expr("concat('S-1-5-21-1-2-3-', 1000 + file_id % 40)")
    group = F.expr("concat('S-1-5-32-', 544 + file_id % 6)")
    control = F.expr("CASE file_id % 5 WHEN 0 THEN 36868 WHEN 1 THEN 32768 ELSE 32772 END")
    kind = F.expr("CASE file_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 9 WHEN 2 THEN 10 ELSE 0 END")
    blob = DS.descriptor_bytes(owner, control, [
        DS.ace_bytes(kind, F.lit(3), F.lit(1179785), group),
        DS.ace_bytes(F.lit(0), F.expr("CASE WHEN file_id % 3 = 0 THEN 16 ELSE 19 END"), F.expr("CASE WHEN file_id % 2 = 0 THEN 2147483648 ELSE 268435456 END"), F.lit("S-1-1-0"))])
    return e.files.select("file_id", F.when(F.col("file_id") % 11 == 0, F.substring(blob, 1, 60)).otherwise(blob).alias("sd"))


_ACES = """CASE WHEN cut THEN NULL WHEN file_id % 5 = 1 THEN 'allow:S-1-1-0:2032127:0' ELSE
    CASE file_id % 4 WHEN 1 THEN '' WHEN 3 THEN 'allow' ELSE 'deny' END || CASE WHEN file_id % 4 = 1 THEN '' ELSE ':S-1-5-32-' || (544 + file_id % 6) || ':1179785:3 ' END
    || 'allow:S-1-1-0:' || CASE WHEN file_id % 2 = 0 THEN 1179785 ELSE 2032127 END || ':' || CASE WHEN file_id % 3 = 0 THEN 16 ELSE 19 END END"""
_DECODED = f"""SELECT file_id, CASE WHEN NOT cut THEN 'S-1-5-21-1-2-3-' || (1000 + file_id % 40) END AS owner_sid, CASE WHEN NOT cut THEN file_id % 5 = 0 END AS is_protected,
    CASE WHEN NOT cut THEN file_id % 5 = 1 END AS is_null_dacl, {_ACES} AS aces, CASE WHEN cut THEN 'ACL truncated' END AS error
    FROM (SELECT file_id, file_id % 11 = 0 AND file_id % 5 <> 1 AS cut FROM est_files)"""


@query("S2 A1 A2 A14 R5", _DECODED)
def decode_descriptors(e: Estate) -> DataFrame:
    return DS.decode(raw_descriptors(e)).select("file_id", "owner_sid", "is_protected", "is_null_dacl",
                                                ace_text(F.col("aces")).alias("aces"), "error")


@query("A2", """SELECT o_orderkey, ((m & 268435455) | CASE WHEN m & 2147483648 <> 0 THEN 1179785 ELSE 0 END | CASE WHEN m & 1073741824 <> 0 THEN 1179926 ELSE 0 END
    | CASE WHEN m & 536870912 <> 0 THEN 1179808 ELSE 0 END | CASE WHEN m & 268435456 <> 0 THEN 2032127 ELSE 0 END) AS mask
    FROM (SELECT o_orderkey, ((o_orderkey % 16) << 28) | (o_orderkey % 512) AS m FROM orders)""")
def generic_rights(e: Estate) -> DataFrame:
    raw = F.expr("shiftleft(o_orderkey % 16, 28) | (o_orderkey % 512)")
    return e.table("orders").select("o_orderkey", A.expand_generic(raw).alias("mask"))


@query("A3", f"""SELECT DISTINCT sha256(CASE WHEN is_protected THEN 'P' ELSE '-' END || CASE WHEN is_null_dacl THEN 'N' ELSE '-' END ||
    array_to_string(list_transform(string_split(aces, ' '), lambda a: '|' || string_split(a, ':')[1] || ':' || string_split(a, ':')[2] || ':' || printf('%08x', string_split(a, ':')[3]::BIGINT) || ':' || printf('%02x', string_split(a, ':')[4]::BIGINT)), '')) AS acl_id,
    is_protected, is_null_dacl, aces, list_bool_or(list_transform(string_split(aces, ' '), lambda a: (string_split(a, ':')[4]::BIGINT & 16) = 0)) AS has_explicit
    FROM ({_DECODED}) WHERE error IS NULL""")
def distinct_acls(e: Estate) -> DataFrame:
    good = DS.decode_distinct(raw_descriptors(e)).filter("error IS NULL")
    return X.distinct_acls(good).withColumn("aces", ace_text(F.col("aces")))


@query("A4", f"""SELECT file_id, CASE WHEN has_own THEN own END AS own_aces, CASE WHEN has_own THEN is_protected OR is_null_dacl END AS own_protected FROM (SELECT *, is_protected OR is_null_dacl OR own <> '' AS has_own FROM
    (SELECT *, array_to_string(list_filter(string_split(aces, ' '), lambda a: (string_split(a, ':')[4]::BIGINT & 16) = 0), ' ') AS own FROM ({_DECODED}) WHERE error IS NULL))""")
def own_permissions(e: Estate) -> DataFrame:
    good = DS.decode(raw_descriptors(e)).filter("error IS NULL")
    return X.own_acl(good).select("file_id", ace_text(F.col("own_aces")).alias("own_aces"), "own_protected")


# ── Evaluation for one token ─────────────────────────────────────────────────

@query("A5 A6 A13", f"SELECT d.folder_id, coalesce(m.mask, 0) AS mask, {S.level('coalesce(m.mask, 0)')} AS level, coalesce(m.mask, 0) & 1 = 1 AS can_list FROM est_folders d "
       f"LEFT JOIN ({S.masks('est_acl_entries', 'acl_id', 'sid IN ' + S.sids(S.TOKEN))}) m USING (acl_id) WHERE d.acl_id IS NOT NULL")
def folder_access(e: Estate) -> DataFrame:
    masks = e.acls.select("acl_id", A.effective_mask(F.col("aces"), S.TOKEN).alias("mask"))
    return e.folders.join(masks, "acl_id").select(
        "folder_id", "mask", A.access_level(F.col("mask")).alias("level"), A.has(F.col("mask"), 1).alias("can_list"))


@query("A7", """SELECT d.folder_id, e.position, e.sid, e.ace_type, e.mask, (e.flags & ~8) | 16 AS flags FROM est_folders d JOIN est_acl_entries e USING (acl_id)
    WHERE (e.flags & 1) = 1 AND e.sid NOT IN ('S-1-3-0', 'S-1-3-1')""")
def inherited_entries(e: Estate) -> DataFrame:
    passed = e.acls.select("acl_id", F.explode(A.inherited_by_files(F.col("aces"))).alias("a"))
    return e.folders.select("folder_id", "acl_id").join(passed, "acl_id").select("folder_id", "a.*")


@query("A8 J5", "SELECT file_id FROM est_files f JOIN est_folders d USING (folder_id) WHERE f.acl_id IS NULL AND d.acl_id IN (SELECT acl_id FROM opening)")
def inheriting_files(e: Estate) -> DataFrame:
    opens = X.opening_acls(e.acls, S.TOKEN)
    folders = e.folders.join(opens, "acl_id", "left_semi").select("folder_id")
    return e.files.filter("acl_id IS NULL").join(folders, "folder_id", "left_semi").select("file_id")


@query("A9", f"SELECT p.share_id, p.file_acl, p.folder_acl, (p.file_acl, p.folder_acl) IN (SELECT (file_acl, folder_acl) FROM open_pairs) AS opens FROM pairs p")
def file_acl_pairs(e: Estate) -> DataFrame:
    pairs = X.pair_aces(X.acl_pairs(e.files, e.folders), e.acls)
    return pairs.select("share_id", "file_acl", "folder_acl", A.can_read(F.col("aces"), S.TOKEN).alias("opens"))


@query("A10", "SELECT file_id, folder_path AS path FROM visible")
def visible_files(e: Estate) -> DataFrame:
    return X.visible_files(e.files.drop("content"), e.folders, e.acls, S.TOKEN).select("file_id", "path")


@query("A10", "SELECT share_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM visible GROUP BY share_id", name="visible_size_by_share")
def visible_size_by_share(e: Estate) -> DataFrame:
    return X.visible_files(e.files, e.folders, e.acls, S.TOKEN).groupBy("share_id").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("J6 Q16", """SELECT share_id, name FROM est_shares WHERE enabled AND (share_id IN (SELECT share_id FROM est_folders WHERE acl_id IN (SELECT acl_id FROM opening))
    OR share_id IN (SELECT share_id FROM pairs WHERE (file_acl, folder_acl) IN (SELECT (file_acl, folder_acl) FROM open_pairs)))""")
def visible_shares(e: Estate) -> DataFrame:
    return X.visible_shares(e.shares, e.files, e.folders, e.acls, S.TOKEN).select("share_id", "name")


# ── Tokens ───────────────────────────────────────────────────────────────────

@query("A11", f"""SELECT DISTINCT user_sid, sid FROM (SELECT sid AS user_sid, sid FROM est_principals WHERE kind = 'user'
    UNION ALL SELECT p.sid, b.sid FROM est_principals p, (VALUES {S.values([(s,) for s in S.BASELINE])}) b(sid) WHERE kind = 'user'
    UNION ALL SELECT member_sid, group_sid FROM est_members WHERE group_sid IN (SELECT sid FROM est_acl_entries))""")
def user_tokens(e: Estate) -> DataFrame:
    users = e.principals.filter("kind = 'user'").select(F.col("sid").alias("user_sid"))
    return X.user_tokens(users, e.members, e.acl_entries)


@query("A12", f"""SELECT c_custkey, array_to_string(list_sort(list_distinct(list_concat([u, 'G' || c_nationkey], {list(S.BASELINE)!r},
    CASE WHEN c_custkey % 2 = 0 THEN ['S-1-5-21-7-8-' || c_nationkey || '-513'] ELSE [] END))), ' ') AS token
    FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'S-1-5-21-7-8-' || c_nationkey || '-' || c_custkey ELSE 'U' || c_custkey END AS u FROM customer)""")
def session_tokens(e: Estate) -> DataFrame:
    sid = F.expr("CASE WHEN c_custkey % 2 = 0 THEN concat('S-1-5-21-7-8-', c_nationkey, '-', c_custkey) ELSE concat('U', c_custkey) END")
    groups = F.array(F.expr("concat('G', c_nationkey)"))
    return e.table("customer").select("c_custkey", F.array_join(A.token_from_groups(sid, groups), " ").alias("token"))


_HELD = f"""SELECT DISTINCT u.user_sid, e.acl_id, e.position, e.ace_type, e.mask, e.flags, e.sid FROM
    (SELECT sid AS user_sid, sid FROM est_principals WHERE kind = 'user' UNION ALL SELECT member_sid, group_sid FROM est_members
     UNION ALL SELECT p.sid, b.sid FROM est_principals p, (VALUES {S.values([(s,) for s in S.BASELINE])}) b(sid) WHERE kind = 'user') u JOIN est_acl_entries e USING (sid)"""


@query("A17", f"""WITH held AS ({_HELD}), named AS (SELECT DISTINCT user_sid, acl_id FROM held WHERE sid NOT IN {S.sids(S.BASELINE)})
    SELECT n.user_sid, n.acl_id, coalesce(mask, 0) AS mask FROM named n LEFT JOIN ({S.masks('held', 'user_sid, acl_id')}) m USING (user_sid, acl_id)
    UNION ALL SELECT NULL, a.acl_id, coalesce(mask, 0) FROM est_acls a LEFT JOIN ({S.masks('est_acl_entries', 'acl_id', 'sid IN ' + S.sids(S.BASELINE))}) g USING (acl_id)""")
def many_tokens(e: Estate) -> DataFrame:
    users = e.principals.filter("kind = 'user'").select(F.col("sid").alias("user_sid"))
    return X.evaluate_tokens(X.user_tokens(users, e.members, e.acl_entries), e.acls)


def domain_estate(e: Estate) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accounts of three domains from customers, their groups from nations, and an ACL for every supplier; some name only a domain's users."""
    domain = lambda key: F.concat(F.lit("S-1-5-21-10-20-"), (key % 3).cast("string"), F.lit("-"))
    customer = e.table("customer")
    user = F.concat(domain(F.col("c_custkey")), (1000 + F.col("c_custkey")).cast("string"))
    group = lambda key: F.concat(F.lit("G"), (2000 + key).cast("string"))
    users = customer.select(user.alias("user_sid"))
    members = customer.filter("c_custkey % 2 = 0").select(group(F.col("c_nationkey")).alias("group_sid"), user.alias("member_sid"))
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    entry = lambda at, sid, kind, mask: F.struct(F.lit(at).alias("position"), sid.alias("sid"), kind.alias("ace_type"), F.lit(mask).cast("long").alias("mask"), F.lit(3).alias("flags"))
    acls = e.table("supplier").select(key.cast("int").alias("acl_id"), F.array_compact(F.array(
        F.when(key % 4 == 0, entry(0, group(nation), F.lit("deny"), 2)), F.when(key % 5 == 0, entry(1, F.concat(domain(key), (1000 + key).cast("string")), F.lit("allow"), 2032127)),
        F.when(key % 6 != 0, entry(2, F.concat(domain(key), F.lit("513")), F.lit("allow"), 1179785)), F.when(key % 7 == 0, entry(3, F.lit("S-1-1-0"), F.lit("allow"), 131241)))).alias("aces"))
    # Stored, as a catalogue's ACLs are: evaluation reads the entries many times.
    return users, members, materialize(acls)


_USER = "'S-1-5-21-10-20-' || (c_custkey % 3) || '-' || (1000 + c_custkey)"
_DOMAINS = f"""WITH ent AS (SELECT * FROM (SELECT s_suppkey::INT AS acl_id, 0 AS position, 'G' || (2000 + s_nationkey) AS sid, 'deny' AS ace_type, 2::BIGINT AS mask, 3 AS flags FROM supplier WHERE s_suppkey % 4 = 0
    UNION ALL SELECT s_suppkey::INT, 1, 'S-1-5-21-10-20-' || (s_suppkey % 3) || '-' || (1000 + s_suppkey), 'allow', 2032127, 3 FROM supplier WHERE s_suppkey % 5 = 0
    UNION ALL SELECT s_suppkey::INT, 2, 'S-1-5-21-10-20-' || (s_suppkey % 3) || '-513', 'allow', 1179785, 3 FROM supplier WHERE s_suppkey % 6 <> 0
    UNION ALL SELECT s_suppkey::INT, 3, 'S-1-1-0', 'allow', 131241, 3 FROM supplier WHERE s_suppkey % 7 = 0)),
    tok AS (SELECT {_USER} AS who, {_USER} AS sid FROM customer UNION SELECT {_USER}, 'S-1-5-21-10-20-' || (c_custkey % 3) || '-513' FROM customer
        UNION SELECT {_USER}, 'G' || (2000 + c_nationkey) FROM customer WHERE c_custkey % 2 = 0),
    named AS (SELECT who, sid FROM tok WHERE sid IN (SELECT sid FROM ent) AND sid NOT IN {S.sids(S.BASELINE)}),
    lab AS (SELECT who, coalesce(string_agg(sid, ' ' ORDER BY sid), '') AS label FROM (SELECT DISTINCT {_USER} AS who FROM customer) LEFT JOIN named USING (who) GROUP BY who)"""


def _labels(tokens: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, label): the identities of a class, spelt out."""
    held = X.class_tokens(tokens, classes).groupBy("class").agg(F.array_join(F.sort_array(F.collect_list("sid")), " ").alias("label"))
    return classes.select("class").distinct().join(held, "class", "left").select("class", F.coalesce("label", F.lit("")).alias("label"))


@query("A11 A17", f"{_DOMAINS} SELECT who AS user_sid, label FROM lab")
def account_classes(e: Estate) -> DataFrame:
    """Which class every account is of; a class is named here by what it holds."""
    users, members, acls = domain_estate(e)
    tokens = X.named_tokens(users, members, acls)
    classes = X.account_classes(users, tokens)
    return classes.join(_labels(tokens, classes), "class").select("user_sid", "label")


@query("A17", f"""{_DOMAINS}, one AS (SELECT label, min(who) AS who FROM lab GROUP BY label), base AS (SELECT b.sid, o.label FROM one o, (VALUES {S.values([(s,) for s in S.BASELINE])}) b(sid)),
    held AS (SELECT o.label, e.* FROM one o JOIN named n USING (who) JOIN ent e USING (sid) UNION ALL SELECT b.label, e.* FROM base b JOIN ent e USING (sid)),
    m AS ({S.masks('held', 'label, acl_id')}), n AS (SELECT label, count(*) AS accounts FROM lab GROUP BY label)
    SELECT label, accounts, a.acl_id, coalesce(m.mask, 0) AS mask FROM one JOIN n USING (label) CROSS JOIN (SELECT s_suppkey::INT AS acl_id FROM supplier) a LEFT JOIN m USING (label, acl_id)
    WHERE EXISTS (SELECT 1 FROM named x JOIN ent y USING (sid) WHERE x.who = one.who AND y.acl_id = a.acl_id)""")
def class_masks(e: Estate) -> DataFrame:
    """Masks of classes where an ACL names something they hold; all accounts of a domain are one class unless more is named."""
    users, members, acls = domain_estate(e)
    tokens = materialize(X.named_tokens(users, members, acls))
    classes = materialize(X.account_classes(users, tokens))
    sizes = classes.groupBy("class").agg(F.count("*").alias("accounts"))
    about = _labels(tokens, classes).join(sizes, "class")
    return X.spread_masks(X.class_masks(tokens, classes, acls), about).select("label", "accounts", "acl_id", "mask")


# ── Drift and rules ──────────────────────────────────────────────────────────

@query("A15", f"""SELECT f.file_id, f.file_id IN (SELECT file_id FROM visible) AS indexed_visible,
    CASE WHEN f.file_id % 9 = 0 THEN 'unavailable' WHEN f.file_id % 7 = 0 THEN 'deny' WHEN f.file_id % 2 = 0 THEN 'allow' ELSE 'deny' END AS live FROM est_files f""")
def live_access_drift(e: Estate) -> DataFrame:
    ace = F.struct(F.lit(0).alias("position"), F.expr("CASE WHEN file_id % 2 = 0 THEN 'S-1-1-0' ELSE 'S-1-5-18' END").alias("sid"),
                   F.lit("allow").alias("ace_type"), F.lit(1179785).cast("long").alias("mask"), F.lit(16).alias("flags"))
    live = e.files.filter("file_id % 27 <> 0").select(
        "file_id", F.when(F.col("file_id") % 7 != 0, F.array(ace)).alias("aces"), (F.col("file_id") % 9 != 0).alias("readable"))
    seen = X.visible_files(e.files, e.folders, e.acls, S.TOKEN)
    return X.live_access_drift(e.files, seen, live, S.TOKEN)


def _sid(name: str) -> str:
    return "S-1-1-0" if name == "everyone" else f"S-1-5-21-999-999-999-{1000 + zlib.crc32(name.encode()) % 1_000_000}"


def rules(e: Estate) -> DataFrame:
    """Rules on some folders: hr only, everyone but bob, list only, and a broken one."""
    names = lambda *n: F.array(*[F.lit(x) for x in n]).cast("array<string>")
    base = e.folders.filter("path IN ('en', 'en/d1', 'fr', 'de/d3', 'Archivo') AND share_id % 3 <> 2")
    p = F.col("path")
    return base.select("share_id", "path",
                       F.when(p == "en", names("HR")).when(p == "en/d1", names("everyone")).alias("read"),
                       F.when(p == "en/d1", names("bob")).alias("deny"), F.when(p == "fr", names("everyone")).alias("list"),
                       (p == "de/d3").alias("broken"))


_R = "allow:%s:1179785:%d"
_RULE_SQL = f"""SELECT folder_id, share_id, path, (SELECT r FROM (VALUES ('en'), ('en/d1'), ('fr'), ('de/d3'), ('Archivo')) v(r)
    WHERE share_id % 3 <> 2 AND (path = r OR starts_with(path, r || '/')) AND EXISTS (SELECT 1 FROM est_folders x WHERE x.share_id = d.share_id AND x.path = r)
    ORDER BY length(r) DESC LIMIT 1) AS rule FROM est_folders d"""


def _aces_sql(flag: int, extra: int) -> str:
    """ACEs a rule gives: on the folder itself (extra 0) or passed on with the inherited bit."""
    f = 3 | extra
    own_list = f"WHEN 'fr' THEN '{_R % ('S-1-1-0', 0)}'" if extra == 0 else "WHEN 'fr' THEN ''"
    return (f"CASE rule WHEN 'en' THEN '{_R % (_sid('hr'), f)}' WHEN 'en/d1' THEN 'deny:{_sid('bob')}:1179785:{f} {_R % ('S-1-1-0', f)}' "
            f"{own_list} WHEN 'de/d3' THEN '' WHEN 'Archivo' THEN '' ELSE '{_R % ('S-1-1-0', f)}' END")


@query("A16", f"""SELECT folder_id, coalesce(rule, '') = path AS is_protected, CASE WHEN coalesce(rule, '') = path THEN {_aces_sql(2, 0)} ELSE {_aces_sql(2, 16)} END AS aces FROM ({_RULE_SQL})""")
def rules_on_folders(e: Estate) -> DataFrame:
    return X.derive_folder_acls(e.folders, rules(e)).select("folder_id", "is_protected", ace_text(F.col("aces")).alias("aces"))


@query("A16", f"""SELECT file_id, file_id % 10 = 0 AND file_id % 20 <> 0 AS is_protected, CASE WHEN file_id % 20 = 0 THEN rtrim('deny:{_sid('bob')}:1179785:0 ' || inh)
    WHEN file_id % 10 = 0 THEN '{_R % (_sid('hr'), 0)}' ELSE inh END AS aces FROM (SELECT f.file_id, {_aces_sql(1, 16)} AS inh FROM est_files f JOIN ({_RULE_SQL}) r USING (folder_id))""")
def rules_on_files(e: Estate) -> DataFrame:
    names = lambda n: F.array(F.lit(n)).cast("array<string>")
    twenty = F.col("file_id") % 20 == 0
    none = F.lit(None).cast("array<string>")
    own = e.files.filter("file_id % 10 = 0").select(
        "folder_id", "name", F.when(~twenty, names("hr")).alias("read"), F.when(twenty, names("Bob ")).alias("deny"),
        none.alias("list"), twenty.alias("inherit"))
    out = X.derive_file_acls(e.files, e.folders, rules(e), own)
    return out.select("file_id", "is_protected", ace_text(F.col("aces")).alias("aces"))


# ── Reports ──────────────────────────────────────────────────────────────────

_LISTED = rf"""SELECT d.folder_id, s.path AS share_path, d.path AS folder_path, {S.show('s.path', 'd.path')} AS path, d.path = '' AS is_share_root,
    coalesce(a.is_protected, false) AS inheritance_disabled, d.acl_id, coalesce(d.acl_error, CASE WHEN a.acl_id IS NULL THEN 'No ACL recorded' END) AS acl_error
    FROM est_folders d JOIN est_shares s USING (share_id) LEFT JOIN est_acls a ON a.acl_id = d.acl_id
    WHERE coalesce(a.has_explicit, false) OR coalesce(a.is_protected, false) OR d.acl_error IS NOT NULL OR (d.acl_id IS NULL AND d.path = '')
    ORDER BY s.path, d.path"""


@query("G9 G12 G13", f"""SELECT x.folder_id, x.path, x.is_share_root, x.inheritance_disabled, x.acl_error, e.position, e.sid, e.ace_type AS type,
    CASE WHEN e.sid IS NOT NULL THEN {S.level('e.mask')} END AS level, (e.flags & 16) <> 0 AS inherited,
    CASE WHEN e.sid IS NOT NULL THEN coalesce(p.name, e.sid) END AS name, p.display_name, CASE WHEN e.sid IS NOT NULL THEN coalesce(p.kind, 'unknown') END AS kind
    FROM ({_LISTED}) x LEFT JOIN (SELECT * FROM est_acl_entries WHERE (flags & 8) = 0) e USING (acl_id) LEFT JOIN est_principals p ON p.sid = e.sid""")
def acl_exceptions(e: Estate) -> DataFrame:
    return R.acl_exceptions(e.folders, e.shares, e.acls, e.principals).select(
        "folder_id", "path", "is_share_root", "inheritance_disabled", "acl_error", "position", "sid", "type", "level", "inherited",
        "name", "display_name", "kind")


@query("G12", """SELECT r.sid, coalesce(p.name, r.sid) AS name, p.display_name, coalesce(p.kind, 'unknown') AS kind
    FROM (SELECT sid FROM est_acl_entries UNION SELECT owner_sid FROM est_folders) r LEFT JOIN est_principals p USING (sid)""")
def described_identities(e: Estate) -> DataFrame:
    from ..operators import principals as PR
    return R.describe(PR.referenced_sids(e.acl_entries, e.folders), e.principals)


_COLS = rf"""SELECT d.folder_id, {S.show('s.path', 'd.path')} AS path, d.acl_id FROM est_folders d JOIN est_shares s USING (share_id) JOIN est_acls a USING (acl_id)
    WHERE d.path = '' OR (d.depth <= 2 AND (a.has_explicit OR a.is_protected))"""
_GRID = f"""WITH cols AS ({_COLS}), ent AS (SELECT * FROM est_acl_entries WHERE (flags & 8) = 0 AND acl_id IN (SELECT acl_id FROM cols)),
    users AS (SELECT DISTINCT sid FROM (SELECT e.sid FROM ent e JOIN est_principals p USING (sid) WHERE p.kind = 'user'
        UNION ALL SELECT m.member_sid FROM est_members m WHERE m.group_sid IN (SELECT sid FROM ent) AND m.group_sid IN (SELECT sid FROM est_principals WHERE kind = 'group'))),
    tok AS (SELECT sid AS who, sid FROM users UNION ALL SELECT member_sid, group_sid FROM est_members WHERE member_sid IN (SELECT sid FROM users)
        UNION ALL SELECT u.sid, b.sid FROM users u, (VALUES {S.values([(s,) for s in S.BASELINE])}) b(sid)),
    held AS (SELECT DISTINCT t.who, e.* FROM tok t JOIN ent e USING (sid)),
    m AS ({S.masks('held', 'who, acl_id')}), g AS ({S.masks('ent', 'acl_id', 'sid IN ' + S.sids(S.BASELINE))}), u AS ({S.masks('ent', 'sid, acl_id')})
    SELECT 1 AS section, w.sid, p.name, p.display_name, p.kind, c.folder_id, c.path, {S.level('coalesce(m.mask, 0)')} AS level
    FROM users w CROSS JOIN cols c LEFT JOIN m ON m.who = w.sid AND m.acl_id = c.acl_id JOIN est_principals p ON p.sid = w.sid
    UNION ALL SELECT 0, NULL, 'All domain users', 'Everyone with a domain account', 'everyone', c.folder_id, c.path, {S.level('coalesce(g.mask, 0)')} FROM cols c LEFT JOIN g USING (acl_id)
    UNION ALL SELECT 2, s.sid, s.sid, NULL, 'unknown', c.folder_id, c.path, {S.level('coalesce(u.mask, 0)')} FROM (SELECT DISTINCT sid FROM ent WHERE sid NOT IN (SELECT sid FROM est_principals)) s
    CROSS JOIN cols c LEFT JOIN u ON u.sid = s.sid AND u.acl_id = c.acl_id"""


def grid(e: Estate) -> DataFrame:
    return R.permission_grid(e.folders, e.shares, e.acls, e.principals, e.members)


@query("G10 A17 J11", _GRID)
def permission_grid(e: Estate) -> DataFrame:
    return grid(e)


@query("G10 A17 J11", _GRID)
def permission_grid_whole(e: Estate) -> DataFrame:
    """The same under the name it had while `permission_grid` was a page of 60 columns."""
    return grid(e)


@query("G11", f"SELECT DISTINCT section, sid, name, coalesce(display_name, name) AS shown FROM ({_GRID})")
def grid_row_order(e: Estate) -> DataFrame:
    rows = grid(e).orderBy(*R.grid_order())
    return rows.select("section", "sid", "name", F.coalesce("display_name", "name").alias("shown")).distinct()


@query("G11", f"""SELECT section, sid, name, shown, row_number() OVER (ORDER BY section, CASE WHEN section = 1 THEN lower(shown) END NULLS LAST, sid NULLS FIRST) AS position
    FROM (SELECT DISTINCT section, sid, name, coalesce(display_name, name) AS shown FROM ({_GRID}))""")
def grid_row_positions(e: Estate) -> DataFrame:
    """Every row of the whole grid with its place in the order people read it in."""
    columns = R.grid_columns(e.folders, e.shares, e.acls, 2, None)
    return numbered(R.grid_rows(columns, e.principals, e.members), R.grid_order()[:-1]).select("section", "sid", "name", F.coalesce("display_name", "name").alias("shown"), "position")


@query("G13", rf"""WITH g AS (SELECT * FROM ({_GRID})) SELECT section, sid, coalesce(display_name, name) AS user, name AS account, kind,
    max(level) FILTER (path = '\\fs01\src0') AS "\\fs01\src0", max(level) FILTER (path = '\\fs01\src1') AS "\\fs01\src1", max(level) FILTER (path = '\\fs01\src1\en') AS "\\fs01\src1\en" FROM g GROUP BY ALL""")
def permission_grid_wide(e: Estate) -> DataFrame:
    return R.grid_wide(grid(e), [r"\\fs01\src0", r"\\fs01\src1", r"\\fs01\src1\en"])
