"""Identities, the audit log, retention and sign-in throttling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import audit as U
from ..operators import principals as PR
from ..sources.derived import Estate
from ..session import shared_folder
from ..streaming.audit_log import append_audit_stream
from ..streaming.throttle import throttle_batch, throttle_stream
from . import base_sql as S
from ..schema import WELL_KNOWN
from .registry import query

NOW = "2024-01-10 00:00:00"


@query("P1", "SELECT sid FROM est_acl_entries UNION SELECT owner_sid FROM est_folders WHERE owner_sid IS NOT NULL")
def referenced_sids(e: Estate) -> DataFrame:
    return PR.referenced_sids(e.acl_entries, e.folders)


@query("P2", f"SELECT e.acl_id, e.position, e.sid, w.name FROM est_acl_entries e JOIN (VALUES {S.values(WELL_KNOWN.items())}) w(sid, name) USING (sid) "
       "JOIN (SELECT DISTINCT acl_id FROM est_folders) d USING (acl_id)")
def well_known_names(e: Estate) -> DataFrame:
    used = e.folders.select("acl_id").distinct()
    return (e.acl_entries.join(used, "acl_id", "left_semi").join(PR.well_known(e.acl_entries), "sid")
            .select("acl_id", "position", "sid", "name"))


_KNOWN = """SELECT sid, name, display_name, kind, NULL AS dn, CASE WHEN hash3 = 0 THEN NULL WHEN hash3 = 1 THEN TIMESTAMP '2024-01-09 12:00:00' ELSE TIMESTAMP '2024-01-09 00:00:00' END AS resolved_at
    FROM (SELECT *, length(name) % 2 + CAST(substr(sid, length(sid), 1) AS INT) % 2 AS hash3 FROM est_principals)"""


def known(e: Estate) -> DataFrame:
    state = F.length("name") % 2 + F.substring("sid", -1, 1).cast("int") % 2
    return e.principals.select(
        "sid", "name", "display_name", "kind", F.lit(None).cast("string").alias("dn"),
        F.when(state == 0, F.lit(None)).when(state == 1, V.at("2024-01-09 12:00:00")).otherwise(V.at("2024-01-09 00:00:00")).alias("resolved_at"))


def everyone(e: Estate) -> DataFrame:
    """All SIDs in sight: users, groups, and those named by ACLs."""
    return e.principals.select("sid").union(PR.referenced_sids(e.acl_entries, e.folders)).distinct()


_ALL = "SELECT sid FROM est_principals UNION SELECT sid FROM est_acl_entries UNION SELECT owner_sid FROM est_folders"
_DUE = f"SELECT a.sid FROM ({_ALL}) a LEFT JOIN ({_KNOWN}) k USING (sid) WHERE k.resolved_at IS NULL OR k.resolved_at <= TIMESTAMP '2024-01-09 00:00:00'"


@query("P3", _DUE)
def due_identities(e: Estate) -> DataFrame:
    return PR.due_for_refresh(everyone(e), known(e), NOW)


def lookups(e: Estate) -> DataFrame:
    """A directory extract in which some SIDs are absent and some lookups fail."""
    digit = F.substring("sid", -1, 1).cast("int")
    answer = F.when(digit == 3, "error").when(digit == 7, "absent").otherwise("found")
    text = lambda c: F.when(answer == "found", c)
    return e.principals.select("sid", answer.alias("answer"), text(F.upper("name")).alias("name"), text(F.col("name")).alias("display_name"),
                               text(F.col("kind")).alias("kind"), text(F.concat(F.lit("CN="), "name")).alias("dn"))


def expansions(e: Estate) -> DataFrame:
    groups = e.principals.filter("kind = 'group'").select(F.col("sid").alias("group_sid"))
    return groups.withColumn("ok", F.substring("group_sid", -1, 1).cast("int") % 2 == 0)


_WK = S.values((k, v) for k, v in WELL_KNOWN.items())
_UPSERT = f"""SELECT *, CASE WHEN answer = 'error' THEN 'error' WHEN answer = 'found' THEN 'resolved' WHEN answer = 'absent' THEN 'unknown' END AS outcome FROM (
    SELECT coalesce(k.sid, l.sid) AS sid, CASE WHEN answer = 'found' THEN l.name ELSE k.name END AS name, CASE WHEN answer = 'found' THEN l.display_name ELSE k.display_name END AS display_name,
    CASE WHEN answer = 'found' THEN l.kind WHEN answer = 'absent' THEN 'unknown' ELSE k.kind END AS kind,
    CASE WHEN answer IN ('found', 'absent') AND NOT (coalesce(k.sid, l.sid) LIKE 'G%' AND CAST(right(coalesce(k.sid, l.sid), 1) AS INT) % 2 = 1 AND coalesce(k.sid, l.sid) <> 'G2004') THEN TIMESTAMP '2024-01-10' ELSE k.resolved_at END AS resolved_at, answer
    FROM ({_KNOWN}) k FULL JOIN (SELECT sid, CASE right(sid, 1) WHEN '3' THEN 'error' WHEN '7' THEN 'absent' ELSE 'found' END AS answer, upper(name) AS name, name AS display_name, kind FROM est_principals WHERE sid IN ({_DUE})
        UNION ALL SELECT sid, 'found', name, name, 'wellknown' FROM (VALUES {_WK}) w(sid, name) WHERE sid IN ({_DUE})) l USING (sid))"""


@query("S4 P4", f"SELECT sid, name, display_name, kind, CAST(resolved_at AS VARCHAR) AS resolved_at, outcome FROM ({_UPSERT})")
def principal_upsert(e: Estate) -> DataFrame:
    due = PR.due_for_refresh(everyone(e), known(e), NOW)
    return PR.upsert(known(e), due, lookups(e), expansions(e), NOW).select(
        "sid", "name", "display_name", "kind", F.col("resolved_at").cast("string").alias("resolved_at"), "outcome")


@query("P5", """SELECT group_sid, member_sid FROM est_members WHERE group_sid NOT IN (SELECT sid FROM est_principals WHERE kind = 'group' AND CAST(right(sid, 1) AS INT) % 2 = 0)
    UNION SELECT group_sid, member_sid FROM est_members WHERE group_sid IN (SELECT sid FROM est_principals WHERE kind = 'group' AND CAST(right(sid, 1) AS INT) % 2 = 0) AND right(member_sid, 1) <> '5'""")
def member_replace(e: Estate) -> DataFrame:
    fresh = e.members.filter(~F.col("member_sid").endswith("5"))
    return PR.replace_members(e.members, expansions(e), fresh)


@query("P6 J12", """WITH RECURSIVE reach(top, inner_sid) AS (SELECT group_sid, member_sid FROM est_edges UNION SELECT r.top, d.member_sid FROM reach r JOIN est_edges d ON d.group_sid = r.inner_sid)
    SELECT top AS group_sid, inner_sid AS member_sid FROM reach WHERE inner_sid NOT IN (SELECT group_sid FROM est_edges)""")
def transitive_members(e: Estate) -> DataFrame:
    return PR.transitive_members(e.edges)


def nested_groups(e: Estate) -> DataFrame:
    """Chains of 200 groups, each in the one before it, closed to a ring every third time; every tenth group of a chain, the last included, holds an account."""
    key, at = F.col("c_custkey"), F.col("at")
    links = e.table("customer").filter("c_custkey % 50 = 0").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("at"))
    name = lambda n: F.concat(F.lit("C"), key, F.lit("-"), n)
    down = links.filter((at < 199) | (key % 3 == 0)).select(name(at).alias("group_sid"), name((at + 1) % 200).alias("member_sid"))
    return down.unionByName(links.filter("at % 10 = 9").select(name(at).alias("group_sid"), F.concat(F.lit("U"), key + at).alias("member_sid")))


@query("P6 J12", """WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 50 = 0), g AS (SELECT k, unnest(range(200)) AS at FROM c), u AS (SELECT k, unnest(range(9, 200, 10)) AS at FROM c)
    SELECT 'C' || g.k || '-' || g.at AS group_sid, 'U' || (u.k + u.at) AS member_sid FROM g JOIN u ON u.k = g.k AND (u.at >= g.at OR g.k % 3 = 0)""")
def deep_members(e: Estate) -> DataFrame:
    """Groups nested two hundred deep."""
    return PR.transitive_members(nested_groups(e))


@query("P7", f"""SELECT CAST(count_if(outcome = 'resolved') AS BIGINT) AS resolved, CAST(count_if(outcome = 'unknown') AS BIGINT) AS "unknown",
    (SELECT count(*) FROM est_principals WHERE kind = 'group' AND CAST(right(sid, 1) AS INT) % 2 = 0) AS groups_expanded,
    CAST(count_if(outcome = 'error') + (SELECT count(*) FROM est_principals WHERE kind = 'group' AND CAST(right(sid, 1) AS INT) % 2 = 1) AS BIGINT) AS errors FROM ({_UPSERT})""")
def resolution_statistics(e: Estate) -> DataFrame:
    due = PR.due_for_refresh(everyone(e), known(e), NOW)
    return PR.resolution_statistics(PR.upsert(known(e), due, lookups(e), expansions(e), NOW), expansions(e))


# ── Audit and retention ──────────────────────────────────────────────────────

_FILTER = "username = 'user7' AND \"at\" >= TIMESTAMP '2024-01-05' AND \"at\" < TIMESTAMP '2024-01-21'"


@query("T1 X18 S10", f'SELECT event_id, CAST("at" AS VARCHAR) AS "at", action FROM est_audit WHERE {_FILTER} ORDER BY event_id DESC LIMIT 20 OFFSET 5')
def audit_page(e: Estate) -> DataFrame:
    return U.event_page(e.audit, 20, 5, username=" User7 ", since="2024-01-05", until="2024-01-20").select(
        "event_id", F.col("at").cast("string").alias("at"), "action")


@query("T1", f"SELECT count(*) AS total FROM est_audit WHERE {_FILTER} AND action = 'search'")
def audit_total(e: Estate) -> DataFrame:
    return U.event_total(e.audit, username="user7", action="search", since="2024-01-05", until="2024-01-20")


@query("G13 X23", """SELECT event_id, CAST("at" AS VARCHAR) AS "at", coalesce(username, '') AS user, action, coalesce(path, '') AS path, coalesce(CAST(detail AS JSON) ->> '$.q', '') AS query,
    coalesce(CAST(detail AS JSON) ->> '$.results', '') AS results, coalesce(client_ip, '') AS ip FROM est_audit""")
def audit_export(e: Estate) -> DataFrame:
    return U.flatten_events(e.audit).drop("detail").withColumn("at", F.col("at").cast("string"))


@query("T2", "SELECT event_id FROM est_audit WHERE \"at\" >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY")
def audit_retention(e: Estate) -> DataFrame:
    return U.keep_recent(e.audit, "2024-01-31 00:00:00", 14).select("event_id")


_USERS = "SELECT c_custkey AS user_id, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last_login FROM customer"
_SESSIONS = "SELECT o_orderkey AS session_id, o_custkey AS user_id, o_orderdate + INTERVAL 10 DAY AS expires_at FROM orders WHERE o_orderkey % 7 = 0"


def accounts(e: Estate) -> DataFrame:
    last = e.table("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderdate").alias("last_login"))
    return e.table("customer").select(F.col("c_custkey").alias("user_id")).join(last, "user_id", "left")


def sessions(e: Estate) -> DataFrame:
    return e.table("orders").filter("o_orderkey % 7 = 0").select(
        F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"),
        F.expr("o_orderdate + INTERVAL '10' DAY").alias("expires_at"))


@query("T3", f"SELECT user_id FROM ({_USERS}) WHERE (last_login IS NULL OR last_login < TIMESTAMP '1998-12-31' - INTERVAL 365 DAY) AND user_id NOT IN (SELECT user_id FROM ({_SESSIONS}))")
def idle_accounts(e: Estate) -> DataFrame:
    return U.idle_accounts(accounts(e), sessions(e), "1998-12-31 00:00:00").select("user_id")


@query("T4", f"SELECT session_id FROM ({_SESSIONS}) WHERE expires_at < TIMESTAMP '1995-06-17'")
def expired_sessions(e: Estate) -> DataFrame:
    return U.expired_sessions(sessions(e), "1995-06-17 00:00:00").select("session_id")


@query("T5", """SELECT event_id AS request_id, CASE event_id % 4 WHEN 0 THEN 'informe' ELSE '' END AS q, CASE WHEN event_id % 6 = 1 THEN CAST(user_id % 20 AS INT) END AS share_id
    FROM events WHERE event_id % 3 = 0 AND (event_id % 4 = 0 OR event_id % 6 = 1 OR event_id % 5 = 3)""")
def search_events(e: Estate) -> DataFrame:
    requests = e.table("events").select(
        F.col("event_id").alias("request_id"), F.expr("concat('user', user_id)").alias("username"), F.col("ts").alias("at"),
        F.expr("CASE event_id % 4 WHEN 0 THEN ' informe ' ELSE ' ' END").alias("q"), (F.col("event_id") % 3 * 20).alias("offset"),
        (F.col("event_id") % 100).alias("results"), F.expr("CASE WHEN event_id % 6 = 1 THEN CAST(user_id % 20 AS INT) END").alias("share_id"),
        F.expr("CASE WHEN event_id % 5 = 3 THEN 'pdf' END").alias("type"), F.lit(None).cast("string").alias("modified_from"),
        F.lit(None).cast("string").alias("modified_to"))
    found = U.search_events(requests)
    return found.select("request_id", V.json_field(F.col("detail"), "q").alias("q"),
                        V.json_field(F.col("detail"), "share_id").cast("int").alias("share_id"))


_GATE = """WITH RECURSIVE a AS (SELECT event_id, user_id % 6 AS u, ts, event_type = 'signup' AS ok, row_number() OVER (PARTITION BY user_id % 6 ORDER BY ts, event_id) AS rn
        FROM events WHERE event_type IN ('error', 'signup')),
    step(event_id, u, ts, rn, fails, outcome, wait) AS (
        SELECT event_id, u, ts, rn, CASE WHEN ok THEN [] ELSE [ts] END, CASE WHEN ok THEN 'signed_in' ELSE 'failed' END, NULL::BIGINT FROM a WHERE rn = 1
        UNION ALL SELECT a.event_id, a.u, a.ts, a.rn, CASE WHEN len(r) >= 3 THEN r WHEN a.ok THEN [] ELSE list_append(r, a.ts) END,
            CASE WHEN len(r) >= 3 THEN 'throttled' WHEN a.ok THEN 'signed_in' ELSE 'failed' END,
            CASE WHEN len(r) >= 3 THEN CAST(floor((epoch_us(r[1]) + 1800000000 - epoch_us(a.ts)) / 1000000.0) AS BIGINT) END
        FROM (SELECT s.u, s.rn, s.fails, b.event_id AS eid, list_filter(s.fails, lambda f: epoch_us(b.ts) - epoch_us(f) < 1800000000) AS r FROM step s JOIN a b ON b.u = s.u AND b.rn = s.rn + 1) x
        JOIN a ON a.event_id = x.eid)
    SELECT event_id AS attempt_id, 'user' || u AS username, outcome, wait AS retry_seconds, CASE WHEN wait IS NOT NULL THEN greatest(1, CAST(ceil(wait / 60.0) AS BIGINT)) END AS retry_minutes FROM step"""


@query("T6 T7", _GATE)
def sign_in_throttle(e: Estate) -> DataFrame:
    """Errors as failed and sign-ups as good sign-ins, folded onto few accounts so that some get blocked."""
    attempts = e.table("events").filter("event_type IN ('error', 'signup')").select(
        F.col("event_id").alias("attempt_id"), F.expr("concat('user', user_id % 6)").alias("username"), F.col("ts").alias("at"),
        (F.col("event_type") == "signup").alias("ok"))
    return throttle_batch(attempts).select("attempt_id", "username", "outcome", "retry_seconds", F.when(
        F.col("retry_seconds").isNotNull(), V.retry_minutes(F.col("retry_seconds"))).alias("retry_minutes"))


def _attempts(e: Estate) -> DataFrame:
    return e.table("events").filter("event_type IN ('error', 'signup')").select(
        F.col("event_id").alias("attempt_id"), F.expr("concat('user', user_id % 6)").alias("username"), F.col("ts").alias("at"), (F.col("event_type") == "signup").alias("ok"))


@query("T6 T7", _GATE)
def sign_in_throttle_stream(e: Estate) -> DataFrame:
    """The same attempts as a stream, in two arrivals: what is remembered of an account carries over."""
    folder = f"{shared_folder(e.spark)}/throttle-{uuid.uuid4().hex}"
    e.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = _attempts(e).withColumn("at", F.col("at").cast("timestamp"))
    middle = rows.agg(F.percentile_approx("at", 0.5)).first()[0]
    for early in (True, False):
        rows.filter(F.coalesce((F.col("at") < F.lit(middle)) == F.lit(early), F.lit(early))).write.mode("append").parquet(f"{folder}/in")
        stream = e.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        throttle_stream(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start().awaitTermination()
    out = e.spark.read.schema("attempt_id bigint, username string, outcome string, retry_seconds bigint").parquet(f"{folder}/out")
    return out.select("attempt_id", "username", "outcome", "retry_seconds", F.when(F.col("retry_seconds").isNotNull(), V.retry_minutes(F.col("retry_seconds"))).alias("retry_minutes"))


@query("S8", """SELECT event_id, username, action, CAST("at" AS VARCHAR) AS "at", CAST(CAST("at" AS DATE) AS VARCHAR) AS day FROM est_audit""")
def audit_stream(e: Estate) -> DataFrame:
    """Audit events that arrive as files, appended by a stream and read back by day."""
    folder = f"{shared_folder(e.spark)}/audit-stream-{uuid.uuid4().hex}"
    events = e.audit.select("event_id", "at", "username", "action")
    for part in (0, 1):
        events.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{folder}/in")
        append_audit_stream(e.spark.readStream.schema(events.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/mark").awaitTermination()
    return e.spark.read.parquet(f"{folder}/out").select("event_id", "username", "action", F.col("at").cast("string").alias("at"), F.col("day").cast("string").alias("day"))
