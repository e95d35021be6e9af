"""File-name columns: extensions, type groups, ignore rules and naming patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (EXTENSION_LENGTH, EXTRACTABLE, IGNORED_NAMES, IGNORED_PREFIXES,
                      TYPE_GROUPS)
from .text import fold, strip_space

_LAST_DOT = r"(?s)\A(.+)\.([^.]*)\z"


def extension(name: Column, max_length: int | None = EXTENSION_LENGTH) -> Column:
    """Lower-case text after the last dot; empty without a dot or with nothing before it."""
    ext = F.lower(F.regexp_extract(name, _LAST_DOT, 2))
    return F.substring(ext, 1, max_length) if max_length else ext


def stem(name: Column) -> Column:
    """The name without its extension."""
    return F.when(F.regexp_like(name, F.lit(_LAST_DOT)), F.regexp_extract(name, _LAST_DOT, 1)).otherwise(name)


def is_ignored(name: Column, names: list[str] | None = None, prefixes: list[str] | None = None) -> Column:
    lowered = F.lower(name)
    hit = lowered.isin([n.lower() for n in (IGNORED_NAMES if names is None else names)])
    for prefix in IGNORED_PREFIXES if prefixes is None else prefixes:
        hit = hit | lowered.startswith(prefix.lower())
    return hit


def type_group(ext: Column) -> Column:
    """Key of the type filter a file belongs to; anything not listed is "other"."""
    chosen = None
    for key, (_, extensions) in TYPE_GROUPS.items():
        member = ext.isin(extensions)
        chosen = F.when(member, key) if chosen is None else chosen.when(member, key)
    return chosen.otherwise("other")


def in_type(ext: Column, key: str | None) -> Column:
    """Filter for one type key; an unknown key filters nothing."""
    if key == "other":
        return ~ext.isin([e for _, listed in TYPE_GROUPS.values() for e in listed])
    if key in TYPE_GROUPS:
        return ext.isin(TYPE_GROUPS[key][1])
    return F.lit(True)


def initial_status(ext: Column, size: Column, max_size: int | None = None) -> Column:
    """Indexing state of a new or changed file; above `max_size`, if given, its text is left out."""
    return (F.when(~ext.isin(EXTRACTABLE), "metadata")
            .when(F.lit(False) if max_size is None else size > max_size, "too_large")
            .otherwise("pending"))


# Placeholders of the naming mini-language and the text they stand for.
PATTERN_TOKENS = {
    "yyyy": r"(?:19|20)\p{Nd}\p{Nd}",
    "yy": r"\p{Nd}\p{Nd}",
    "mm": r"(?:0[1-9]|1[0-2])",
    "dd": r"(?:0[1-9]|[12]\p{Nd}|3[01])",
    "n": r"\p{Nd}+?",
}
_KNOWN = "|".join(PATTERN_TOKENS)


def pattern_problem(pattern: Column) -> Column:
    """The first placeholder that means nothing, or NULL."""
    unknown = F.regexp_extract(pattern, rf"(?i)(\{{(?!\s*(?:{_KNOWN})\s*\}})[^{{}}]*\}})", 1)
    return F.when(unknown != "", unknown)


def pattern_regex(pattern: Column) -> Column:
    """The whole-string Java regex of a naming pattern, built once per plan entry.

    Stars cut the pattern into parts. Each inner part is an atomic group that takes its
    earliest match, which keeps matching linear however many stars there are.
    """
    def part(piece: Column) -> Column:
        out = F.concat(F.lit(r"\Q"), fold(piece), F.lit(r"\E"))
        for token, regex in PATTERN_TOKENS.items():
            replacement = (r"\E" + regex + r"\Q").replace("\\", "\\\\").replace("$", "\\$")
            out = F.regexp_replace(out, rf"\{{\s*{token}\s*\}}", replacement)
        return F.replace(out, F.lit("?#"), F.lit(r"\E.\Q"))

    # "?" inside a placeholder's own regex must survive: mark the typed ones first.
    marked = F.replace(strip_space(pattern), F.lit("?"), F.lit("?#"))
    pieces = F.transform(F.split(marked, r"\*"), part)
    inner = F.filter(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0))),
                     lambda p: p != r"\Q\E")
    starred = F.concat(
        F.element_at(pieces, 1),
        F.array_join(F.transform(inner, lambda p: F.concat(F.lit("(?>.*?"), p, F.lit(")"))), ""),
        F.lit(".*"), F.element_at(pieces, -1))
    body = F.when(F.size(pieces) > 1, starred).otherwise(F.element_at(pieces, 1))
    return F.concat(F.lit(r"(?s)\A(?:"), body, F.lit(r")\z"))


def matches_pattern(name: Column, regex: Column) -> Column:
    """Whether a file name follows a compiled pattern, ignoring case, accents and extension."""
    return F.regexp_like(fold(stem(name)), regex)
