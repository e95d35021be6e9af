"""Access-control entries as columns: an ACL is an array of entries in evaluation order.

A Windows DACL is at most 64 KiB, so these arrays are small whatever the estate's size, and
they are evaluated once per distinct ACL (or pair of ACLs), never per file.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (BASELINE_SIDS, CREATOR_SIDS, DELETE, DOMAIN_USERS_RID, EVERYONE, EXTRA_BASELINE_SIDS,
                      FILE_EXECUTE, FILE_READ, FILE_WRITE, FULL_ACCESS, GENERIC_ALL, GENERIC_EXECUTE,
                      GENERIC_READ, GENERIC_WRITE, INHERIT_ONLY, INHERITED, OBJECT_INHERIT, READ_DATA, WRITE_DATA)

Token = Iterable[str] | Column


def has(mask: Column, bits: int) -> Column:
    return mask.bitwiseAND(F.lit(bits)) != 0


def has_all(mask: Column, bits: int) -> Column:
    return mask.bitwiseAND(F.lit(bits)) == bits


def baseline() -> list[str]:
    return BASELINE_SIDS + EXTRA_BASELINE_SIDS


def sid_array(token: Token) -> Column:
    """A token given as SIDs becomes a constant array; a column is used as it is."""
    if isinstance(token, Column):
        return token
    return F.array(*[F.lit(s) for s in sorted(set(token))]).cast("array<string>")


def expand_generic(mask: Column) -> Column:
    """Generic rights replaced by the file rights they stand for."""
    out = mask.cast("long")
    for generic, rights in ((GENERIC_READ, FILE_READ), (GENERIC_WRITE, FILE_WRITE),
                            (GENERIC_EXECUTE, FILE_EXECUTE), (GENERIC_ALL, FULL_ACCESS)):
        out = F.when(has(mask, generic), out.bitwiseOR(F.lit(rights))).otherwise(out)
    keep = 0xFFFFFFFF & ~(GENERIC_READ | GENERIC_WRITE | GENERIC_EXECUTE | GENERIC_ALL)
    return out.bitwiseAND(F.lit(keep))


def ordered(aces: Column) -> Column:
    """Entries sorted by position (the first struct field)."""
    return F.array_sort(aces)


def fold_mask(aces: Column, applies=None) -> Column:
    """Rights granted by the entries, in order: the first entry to decide a right wins."""
    zero = F.struct(F.lit(0).cast("long").alias("granted"), F.lit(0).cast("long").alias("denied"))

    def step(acc: Column, ace: Column) -> Column:
        allow = ace["ace_type"] != "deny"
        fresh = ace["mask"].bitwiseAND(F.bitwise_not(acc["granted"].bitwiseOR(acc["denied"])))
        return F.struct(
            F.when(allow, acc["granted"].bitwiseOR(fresh)).otherwise(acc["granted"]).alias("granted"),
            F.when(allow, acc["denied"]).otherwise(acc["denied"].bitwiseOR(fresh)).alias("denied"))

    relevant = F.filter(aces, lambda a: ~has(a["flags"], INHERIT_ONLY) & (applies(a) if applies else F.lit(True)))
    return F.aggregate(relevant, zero, step)["granted"]


def effective_mask(aces: Column, token: Token) -> Column:
    """Rights of a token on an object with these entries."""
    sids = sid_array(token)
    return fold_mask(aces, lambda a: F.array_contains(sids, a["sid"]))


def can_read(aces: Column, token: Token) -> Column:
    """On a folder's own entries: may list it. On a file's: may open it."""
    return F.coalesce(has(effective_mask(aces, token), READ_DATA), F.lit(False))


def inherited_by_files(aces: Column) -> Column:
    """The part of a folder's entries that reaches the files in it, as those files carry it."""
    kept = F.filter(aces, lambda a: has(a["flags"], OBJECT_INHERIT) & ~a["sid"].isin(CREATOR_SIDS))
    return F.transform(kept, lambda a: F.struct(
        a["position"].alias("position"), a["sid"].alias("sid"), a["ace_type"].alias("ace_type"),
        a["mask"].alias("mask"),
        a["flags"].bitwiseAND(F.lit(~INHERIT_ONLY)).bitwiseOR(F.lit(INHERITED)).alias("flags")))


def can_open_files(folder_aces: Column, token: Token) -> Column:
    """May open the inheriting files directly inside a folder with these entries."""
    return can_read(inherited_by_files(folder_aces), token)


def own_then_inherited(own: Column, own_protected: Column, folder_aces: Column) -> Column:
    """Entries of a file with permissions of its own: explicit first, then the folder's unless protected."""
    none = F.filter(own, lambda _: F.lit(False))
    return F.concat(own, F.when(own_protected, none).otherwise(inherited_by_files(folder_aces)))


def explicit_only(aces: Column) -> Column:
    return F.filter(aces, lambda a: ~has(a["flags"], INHERITED))


def everyone_full() -> Column:
    """What an object without a DACL grants."""
    return F.array(F.struct(
        F.lit(0).alias("position"), F.lit(EVERYONE).alias("sid"), F.lit("allow").alias("ace_type"),
        F.lit(FULL_ACCESS).cast("long").alias("mask"), F.lit(0).alias("flags")))


def or_null_dacl(aces: Column) -> Column:
    return F.coalesce(aces, everyone_full())


def access_level(mask: Column) -> Column:
    """The mask as a security tab would sum it up."""
    return (F.when(has_all(mask, FULL_ACCESS), "full")
            .when(has_all(mask, READ_DATA | WRITE_DATA | DELETE), "modify")
            .when(has(mask, WRITE_DATA), "write")
            .when(has(mask, READ_DATA), "read")
            .otherwise("none"))


def acl_hash(aces: Column, is_protected: Column, is_null_dacl: Column) -> Column:
    """Content hash that identifies one distinct ACL; the owner is not part of it."""
    entries = F.transform(aces, lambda a: F.concat(
        F.lit("|"), a["ace_type"], F.lit(":"), a["sid"],
        F.lit(":"), F.lower(F.lpad(F.hex(a["mask"]), 8, "0")),
        F.lit(":"), F.lower(F.lpad(F.hex(a["flags"].cast("long")), 2, "0"))))
    text = F.concat(F.when(is_protected, "P").otherwise("-"), F.when(is_null_dacl, "N").otherwise("-"),
                    F.array_join(entries, ""))
    return F.sha2(text, 256)


def domain_users_sid(sid: Column) -> Column:
    """The primary group of a domain account; NULL for other identities."""
    domain = F.regexp_extract(sid, r"\A(S-1-5-21-.*)-[0-9]+\z", 1)
    return F.when(domain != "", F.concat(domain, F.lit("-" + DOMAIN_USERS_RID)))


def token_from_groups(user_sid: Column, groups: Column) -> Column:
    """Everything a signed-in account carries: itself, its groups and what every account has."""
    fixed = F.array(*[F.lit(s) for s in baseline()])
    primary = F.filter(F.array(domain_users_sid(user_sid)), lambda s: s.isNotNull())
    groups = F.coalesce(groups, F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(F.array(user_sid), fixed, primary, groups)))


def demo_sid(name: Column) -> Column:
    """Stable made-up SID of an account or group name; "everyone" is the real one."""
    from ..schema import DEMO_DOMAIN

    key = F.lower(F.trim(name))
    rid = F.crc32(F.encode(key, "UTF-8")) % 1_000_000 + 1000
    return F.when(key == "everyone", EVERYONE).otherwise(
        F.concat(F.lit(DEMO_DOMAIN + "-"), rid.cast("string")))
