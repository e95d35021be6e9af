"""Date, list, JSON and display columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import AGE_CLASSES, AGE_OLDER, AGE_UNKNOWN
from .text import strip_space


def at(moment: dt.datetime | dt.date | str) -> Column:
    """A UTC instant as a constant."""
    if isinstance(moment, dt.datetime):
        moment = moment.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(moment)).cast("timestamp_ntz")


def days_before(as_of: dt.datetime | str, days: int) -> Column:
    return at(as_of) - F.expr(f"INTERVAL '{int(days)}' DAY")


def age_class(mtime: Column, as_of: dt.datetime | str) -> Column:
    """Age label in 365-day years; a NULL time is unknown."""
    chosen = F.when(mtime.isNull(), AGE_UNKNOWN)
    for label, years in AGE_CLASSES:
        chosen = chosen.when(mtime >= days_before(as_of, 365 * years), label)
    return chosen.otherwise(AGE_OLDER)


def in_days(moment: Column, first: dt.date | str | None, last: dt.date | str | None) -> Column:
    """Between two UTC days, both included; a NULL time never matches a bound."""
    out = F.lit(True)
    if first is not None:
        out = out & (moment >= at(first))
    if last is not None:
        out = out & (moment < at(last) + F.expr("INTERVAL '1' DAY"))
    return out


def same_time(a: Column, b: Column) -> Column:
    """Both unknown, or less than a second apart."""
    near = F.abs(F.timestamp_diff("MICROSECOND", a, b)) < 1_000_000
    return a.eqNullSafe(b) | F.coalesce(near, F.lit(False))


def clean_list(values: Column, extensions: bool = False) -> Column:
    """Trimmed, without empties, first of each spelling kept; extensions lose dots and case."""
    def tidy(value: Column) -> Column:
        value = strip_space(value)
        return F.lower(F.regexp_replace(value, r"^\.+", "")) if extensions else value

    kept = F.filter(F.transform(values, tidy), lambda v: v != "")
    # One-element arrays bind the intermediate lists, or every lambda call would rebuild them.
    both = F.transform(F.array(kept), lambda k: F.struct(k.alias("kept"), F.transform(k, F.lower).alias("lowered")))
    first = F.transform(both, lambda b: F.filter(
        b["kept"], lambda v, i: F.array_position(b["lowered"], F.lower(v)) == (i + 1).cast("long")))
    return F.element_at(first, 1)


def normalize_username(typed: Column, domain: str) -> Column:
    """DOMAIN\\user, user@domain and User are one account; other domains keep their suffix."""
    name = strip_space(typed)
    after = F.substring_index(name, "@", -1)
    before = F.regexp_extract(name, r"(?s)\A(.*)@[^@]*\z", 1)
    return F.lower(
        F.when(F.instr(name, "\\") > 0, F.regexp_extract(name, r"(?s)\A[^\\]*\\(.*)\z", 1))
        .when((F.instr(name, "@") > 0) & (F.lower(after) == domain.lower()), before)
        .otherwise(name))


def formula_safe(cell: Column) -> Column:
    """Text a spreadsheet would run as a formula, quoted."""
    return F.when(F.regexp_like(cell, F.lit(r"\A[=+\-@\t\r]")), F.concat(F.lit("'"), cell)).otherwise(cell)


def json_field(detail: Column, name: str) -> Column:
    return F.get_json_object(detail, f"$.{name}")


def percentage(part: Column, whole: Column) -> Column:
    """One-decimal percentage, rounded half up; NULL when there is nothing to divide by."""
    return F.floor(F.try_divide(part, whole) * 1000 + 0.5) / 10


def human_size(size: Column) -> Column:
    """Size as people read it; nothing or zero is a dash."""
    def scaled(unit: int, label: str) -> Column:
        return F.concat(F.format_string("%.1f", size / F.lit(float(unit))), F.lit(" " + label))

    return (F.when(F.coalesce(size, F.lit(0)) == 0, "—")
            .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
            .when(size < 1024 ** 2, scaled(1024, "KB"))
            .when(size < 1024 ** 3, scaled(1024 ** 2, "MB"))
            .otherwise(scaled(1024 ** 3, "GB")))


def retry_minutes(seconds: Column) -> Column:
    """Whole minutes to wait, at least one; fractions of a second don't count."""
    return F.greatest(F.lit(1), F.ceil(F.floor(seconds) / 60)).cast("long")
