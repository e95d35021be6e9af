"""Names behind SIDs, and transitive group membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..schema import PRINCIPAL_REFRESH_DAYS, WELL_KNOWN
from ..session import materialize
from .common import constant_table

FIELDS = ["name", "display_name", "kind", "dn"]


def referenced_sids(acl_entries: DataFrame, folders: DataFrame) -> DataFrame:
    owners = folders.filter(F.col("owner_sid").isNotNull()).select(F.col("owner_sid").alias("sid"))
    return acl_entries.select("sid").union(owners).distinct()


def well_known(any_table: DataFrame) -> DataFrame:
    return constant_table(any_table, list(WELL_KNOWN.items()), ["sid", "name"])


def due_for_refresh(sids: DataFrame, principals: DataFrame, as_of: str, force: bool = False,
                    days: int = PRINCIPAL_REFRESH_DAYS) -> DataFrame:
    """SIDs never resolved, or resolved at least `days` ago."""
    known = principals.select("sid", "resolved_at")
    joined = sids.join(known, "sid", "left")
    if force:
        return joined.select("sid")
    stale = F.col("resolved_at").isNull() | (F.col("resolved_at") <= V.days_before(as_of, days))
    return joined.filter(stale).select("sid")


def upsert(principals: DataFrame, due: DataFrame, lookups: DataFrame, expansions: DataFrame, as_of: str) -> DataFrame:
    """The principal table after one resolution round, with each row's `outcome`.

    `lookups`: (sid, answer, name, display_name, kind, dn), answer "found", "absent" or "error".
    `expansions`: (group_sid, ok). Absent SIDs become unknown and keep what was known of them;
    an error changes nothing; a failed expansion keeps `resolved_at` so the group is retried.
    """
    fixed = well_known(due).select("sid", F.lit("found").alias("answer"), "name", F.col("name").alias("display_name"),
                                   F.lit("wellknown").alias("kind"), F.lit(None).cast("string").alias("dn"))
    answers = (lookups.join(fixed.select("sid"), "sid", "left_anti").unionByName(fixed)
               .join(due.select("sid"), "sid", "left_semi"))
    renamed = answers.select("sid", "answer", *[F.col(c).alias(f"new_{c}") for c in FIELDS])
    failed = expansions.filter("NOT ok").select(F.col("group_sid").alias("sid"), F.lit(True).alias("retry"))
    joined = (principals.withColumn("known", F.lit(True)).join(renamed, "sid", "full").join(failed, "sid", "left"))
    found, absent = F.col("answer") == "found", F.col("answer") == "absent"
    updated = {c: F.when(found, F.col(f"new_{c}")).otherwise(F.col(c)) for c in FIELDS}
    updated["kind"] = F.when(found, F.col("new_kind")).when(absent, "unknown").otherwise(F.col("kind"))
    settled = (found | absent) & ~F.coalesce("retry", F.lit(False))
    updated["resolved_at"] = F.when(settled, V.at(as_of)).otherwise(F.col("resolved_at"))
    outcome = (F.when(F.col("answer") == "error", "error").when(found & (F.col("new_kind") != "unknown"), "resolved")
               .when(found | absent, "unknown"))
    return (joined.filter(F.col("known").isNotNull() | found | absent)
            .select("sid", *[updated[c].alias(c) for c in FIELDS + ["resolved_at"]], outcome.alias("outcome")))


def add_members(principals: DataFrame, member_users: DataFrame, as_of: str) -> DataFrame:
    """Users found by group expansion get, or refresh, a row of their own."""
    fresh = member_users.select("sid", *FIELDS).dropDuplicates(["sid"]).withColumn("resolved_at", V.at(as_of))
    return principals.join(fresh.select("sid"), "sid", "left_anti").unionByName(fresh, allowMissingColumns=True)


def replace_members(members: DataFrame, expansions: DataFrame, new_members: DataFrame) -> DataFrame:
    """Membership after a round: groups expanded without error are replaced, all others kept."""
    fine = expansions.filter("ok").select("group_sid")
    return (members.join(fine, "group_sid", "left_anti")
            .unionByName(new_members.join(fine, "group_sid", "left_semi").select("group_sid", "member_sid")).distinct())


def resolution_statistics(upserted: DataFrame, expansions: DataFrame) -> DataFrame:
    done = upserted.agg(F.count_if(F.col("outcome") == "resolved").alias("resolved"),
                        F.count_if(F.col("outcome") == "unknown").alias("unknown"),
                        F.count_if(F.col("outcome") == "error").alias("lookup_errors"))
    grown = expansions.agg(F.count_if("ok").alias("groups_expanded"), F.count_if(~F.col("ok")).alias("failed"))
    k = F.lit(1)
    return (done.withColumn("k", k).join(grown.withColumn("k", k), "k")
            .select("resolved", "unknown", "groups_expanded", (F.col("lookup_errors") + F.col("failed")).alias("errors")))


def transitive_members(edges: DataFrame) -> DataFrame:
    """(group_sid, member_sid) for every user a group holds at any depth; cycles are harmless.

    Only group-in-group edges are iterated, and of what they reach only groups that hold users are kept; the users join once at the end. Before each round
    `reached` holds what is at most so many edges away as the paths in `step` are long. A round puts one of these paths before what is reached, so its
    rows grow with the result, and doubles them: a chain of any depth is closed after the logarithm of its length. What a round adds is cut with a reliable checkpoint.
    """
    groups = edges.select(F.col("group_sid").alias("member_sid")).distinct()
    direct = edges.join(groups, "member_sid", "left_anti").select(F.col("group_sid").alias("inner"), "member_sid")
    holders = direct.select("inner").dropna().distinct()
    nested = edges.join(groups, "member_sid", "left_semi").select(F.col("group_sid").alias("top"), F.col("member_sid").alias("inner"))
    step = materialize(nested.distinct())
    reached = materialize(step.join(holders, "inner", "left_semi").select("top", "inner").union(holders.select(F.col("inner").alias("top"), "inner")).distinct())
    growing = True
    while growing:
        path = step.select("top", F.col("inner").alias("via"))
        longer = path.join(reached.withColumnRenamed("top", "via"), "via").select("top", "inner")
        known = reached.select(F.col("top").alias("from"), F.col("inner").alias("to"))
        fresh = materialize(longer.join(known, F.col("top").eqNullSafe(F.col("from")) & (F.col("inner") == F.col("to")), "left_anti").distinct())
        growing = not fresh.isEmpty()
        if growing:
            reached = reached.unionByName(fresh)
            step = materialize(path.join(step.withColumnRenamed("top", "via"), "via").select("top", "inner").distinct())
    return reached.join(direct, "inner").select(F.col("top").alias("group_sid"), "member_sid").distinct()
