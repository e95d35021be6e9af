"""The audit log, retention and account housekeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..schema import AUDIT_RETENTION_DAYS
from .reports import page


def _in_day_folders(events: DataFrame, first=None, last=None) -> DataFrame:
    """Stored logs are partitioned by `day`: the same bounds on it skip whole folders."""
    if "day" not in events.columns:
        return events
    if first is not None:
        events = events.filter(F.col("day") >= F.to_date(first))
    return events if last is None else events.filter(F.col("day") <= F.to_date(last))


def select_events(events: DataFrame, username: str | None = None, action: str | None = None,
                  since: str | None = None, until: str | None = None) -> DataFrame:
    at = lambda d: None if d is None else V.at(d)
    out = _in_day_folders(events, at(since), at(until)).filter(V.in_days(F.col("at"), since, until))
    if username:
        out = out.filter(F.col("username") == username.strip().lower())
    if action:
        out = out.filter(F.col("action") == action)
    return out


def event_page(events: DataFrame, limit: int = 200, offset: int = 0, **filters) -> DataFrame:
    """Newest first."""
    return page(select_events(events, **filters), [F.desc("event_id")], limit, offset)


def event_total(events: DataFrame, **filters) -> DataFrame:
    return select_events(events, **filters).agg(F.count("*").alias("total"))


def flatten_events(events: DataFrame) -> DataFrame:
    """Export shape, with the query text and result count of searches."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return events.select("event_id", "at", blank("username").alias("user"), "action", blank("path").alias("path"),
                         blank(V.json_field(F.col("detail"), "q")).alias("query"),
                         blank(V.json_field(F.col("detail"), "results")).alias("results"),
                         blank("client_ip").alias("ip"), "detail")


def keep_recent(events: DataFrame, as_of: str, days: int = AUDIT_RETENTION_DAYS) -> DataFrame:
    """Events within the retention period; a period of zero or less keeps everything."""
    if days <= 0:
        return events
    oldest = V.days_before(as_of, days)
    return _in_day_folders(events, oldest).filter(F.col("at") >= oldest)


def idle_accounts(users: DataFrame, sessions: DataFrame, as_of: str, days: int = AUDIT_RETENTION_DAYS) -> DataFrame:
    """Accounts unused for the retention period and without a session."""
    if days <= 0:
        return users.limit(0)
    idle = F.col("last_login").isNull() | (F.col("last_login") < V.days_before(as_of, days))
    return users.filter(idle).join(sessions.select("user_id"), "user_id", "left_anti")


def expired_sessions(sessions: DataFrame, as_of: str) -> DataFrame:
    return sessions.filter(F.col("expires_at") < V.at(as_of))


def search_events(requests: DataFrame) -> DataFrame:
    """One audit event per search: first page only, and only if something was asked.

    `requests`: (request_id, username, at, q, offset, results, share_id, type, modified_from, modified_to).
    """
    q = F.trim(F.coalesce("q", F.lit("")))
    asked = (q != "") | F.coalesce(*[F.col(c).cast("string") for c in ("share_id", "type", "modified_from", "modified_to")]).isNotNull()
    detail = F.to_json(F.struct(q.alias("q"), "results", "share_id", "type", "modified_from", "modified_to"))
    return requests.filter((F.col("offset") == 0) & asked).select(
        "request_id", "username", "at", F.lit("search").alias("action"), detail.alias("detail"))


def read_events(requests: DataFrame) -> DataFrame:
    """Reading the log leaves a trace too, with or without filters; first page only."""
    detail = F.to_json(F.struct("about_user", "about_action", "since", "until", "format"))
    return requests.filter("offset = 0").select(
        "request_id", "username", "at", F.lit("audit_read").alias("action"), detail.alias("detail"))
