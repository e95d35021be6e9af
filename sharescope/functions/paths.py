"""Folder-path columns. A path is "/"-separated and relative to its share; "" is the share's root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_space

# Characters Windows refuses in names, and the longest name.
REFUSED_CHARS = r'[<>:"|?*\x00-\x1f]'
MAX_NAME = 255


def depth(path: Column) -> Column:
    """Levels below the root: "" is 0, "a/b" is 2."""
    return F.when(path == "", F.lit(0)).otherwise(
        F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) + 1).cast("long")


def path_key(path: Column) -> Column:
    return F.lower(path)


def parent(path: Column) -> Column:
    """Path of the containing folder; NULL for the root."""
    return F.when(path != "", F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def child(path: Column, name: Column) -> Column:
    return F.when(path == "", name).otherwise(F.concat(path, F.lit("/"), name))


def ancestors(path: Column) -> Column:
    """Every folder from the root down to the path itself, as an array without repeats."""
    parts = F.split(path, "/")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)),
                        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), below))


def tree_order(path: Column) -> Column:
    """Sort key that puts a folder right before what it holds."""
    return F.split(F.lower(path), "/")


def display_path(share_path: Column, folder_path: Column, name: Column | None = None) -> Column:
    """What people paste into a file browser; POSIX shares keep "/", all others use "\\"."""
    sep = F.when(share_path.startswith("/") & ~share_path.startswith("//"), "/").otherwise("\\")
    out = F.concat(
        F.regexp_replace(share_path, r"[\\/]+\z", ""),
        F.when(folder_path == "", "").otherwise(F.concat(sep, F.replace(folder_path, F.lit("/"), sep))))
    if name is None:
        return out
    return F.concat(out, F.when(name == "", "").otherwise(F.concat(sep, name)))


def normalize_path(raw: Column) -> Column:
    """A typed path with either slash, blanks and empty parts removed."""
    parts = F.transform(F.split(F.translate(raw, "\\", "/"), "/"), strip_space)
    return F.array_join(F.filter(parts, lambda p: p != ""), "/")


def path_problems(path: Column) -> Column:
    """Why the parts of a normalised path can't be Windows folder names (empty array: they can)."""
    def why(part: Column) -> Column:
        return F.filter(F.array(
            F.when(part.isin(".", ".."), "dots"),
            F.when(F.regexp_like(part, F.lit(REFUSED_CHARS)), "character"),
            F.when(~part.isin(".", "..") & part.endswith("."), "trailing dot"),
            F.when(F.length(part) > MAX_NAME, "too long"),
        ), lambda reason: reason.isNotNull())

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(path, "/"), why))))
