"""Copies of the same content, found by a funnel that reads as little as possible.

Size first (catalogue only), then a hash of both ends, then a hash of everything for what still
collides. Groups are only ever aggregated, never gathered: the members of a group come back as
rows, since one group may hold a large part of the estate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..schema import DEDUPE_MIN_SIZE, FULL_HASH_MAX_SIZE, HASH_CHUNK
from ..session import materialize
from ..sources.listing import hash_files
from .reports import page

# Rows of 64 bits that say which ids are wanted: some 6 MB at most, whatever their number.
MARKS = 1 << 18
# Bytes a task reads from files.
TASK_BYTES = 1 << 30

# Wanted files (file_id, size) and the chunk read at both ends, or None for everything, give (file_id, hash).
Hasher = Callable[[DataFrame, int | None], DataFrame]


def quick_hash(size: Column, content: Column, chunk: int = HASH_CHUNK) -> Column:
    """Hash of the size, the first chunk, and the last chunk (or all the rest of a shorter file)."""
    head = F.substring(content, 1, chunk)
    tail = F.when(size > 2 * chunk, F.substring(content, (size - chunk + 1).cast("int"), F.lit(chunk)))
    rest = F.when(size > chunk, F.substring(content, F.lit(chunk + 1), F.lit(chunk)))
    nothing = F.lit(b"")
    return F.sha2(F.concat(F.encode(size.cast("string"), "UTF-8"), head, F.coalesce(tail, rest, nothing)), 256)


def full_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def shared_sizes(files: DataFrame, min_size: int = DEDUPE_MIN_SIZE) -> DataFrame:
    """Sizes at least two files have."""
    return (files.filter(F.col("size") >= min_size).groupBy("size").agg(F.count("*").alias("n"))
            .filter("n > 1").select("size"))


def size_candidates(files: DataFrame, min_size: int = DEDUPE_MIN_SIZE) -> DataFrame:
    return files.join(shared_sizes(files, min_size), "size", "left_semi")


def need_quick_hash(files: DataFrame, min_size: int = DEDUPE_MIN_SIZE) -> DataFrame:
    """Candidates not hashed on an earlier run."""
    return files.filter(F.col("quick_hash").isNull()).join(shared_sizes(files, min_size), "size", "left_semi")


def colliding(files: DataFrame) -> DataFrame:
    """(size, quick_hash) pairs at least two files have."""
    return (files.filter(F.col("quick_hash").isNotNull()).groupBy("size", "quick_hash")
            .agg(F.count("*").alias("n")).filter("n > 1").select("size", "quick_hash"))


def need_full_hash(files: DataFrame, max_size: int = FULL_HASH_MAX_SIZE) -> DataFrame:
    """Files still alike by both ends, not fully hashed yet and not too big for it."""
    todo = files.filter(F.col("content_hash").isNull() & (F.col("size") <= max_size))
    return todo.join(colliding(files), ["size", "quick_hash"], "left_semi")


def hash_contents(contents: DataFrame) -> Hasher:
    """Hashes of contents that are rows, (file_id, content), never moving one between machines.

    Which ids are wanted travels to the contents as a table of bits of bounded size, and what it passes is hashed where it is read. It
    passes some that are not wanted, more of them the more are; the join of ids and hashes behind it is exact.
    """
    def run(wanted: DataFrame, chunk: int | None) -> DataFrame:
        ids, code = wanted.select("file_id").distinct(), F.xxhash64("file_id")
        place = F.pmod(F.shiftright(code, 6), F.lit(MARKS)).alias("_place")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), code.bitwiseAND(F.lit(63)).cast("int"))
        marks = ids.groupBy(place).agg(F.bit_or(bit).alias("_bits"))
        passed = (contents.select("file_id", "content", place).join(F.broadcast(marks), "_place")
                  .filter(F.col("_bits").bitwiseAND(bit) != 0))
        content = F.col("content")
        hashed = full_hash(content) if chunk is None else quick_hash(F.length(content).cast("long"), content, chunk)
        return passed.select("file_id", hashed.alias("hash")).join(ids, "file_id", "left_semi")

    return run


def hash_locations(located: DataFrame) -> Hasher:
    """Hashes of files in a file system, (file_id, location): only wanted files are opened, and of those only the bytes that are hashed are read.

    Tasks are as many as the bytes to read ask for.
    """
    def run(wanted: DataFrame, chunk: int | None) -> DataFrame:
        todo = materialize(located.select("file_id", "location").join(wanted.select("file_id", "size"), "file_id"))
        count = F.col("size") if chunk is None else F.least("size", F.lit(2 * chunk))
        parts = (todo.agg(F.sum(count)).first()[0] or 0) // TASK_BYTES + 1
        parts = max(parts, int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return hash_files(todo.repartition(parts, "file_id"), chunk).filter("hash IS NOT NULL").select("file_id", "hash")

    return run


def hash_stage(files: DataFrame, contents: DataFrame | Hasher, min_size: int = DEDUPE_MIN_SIZE,
               max_size: int = FULL_HASH_MAX_SIZE, chunk: int = HASH_CHUNK) -> DataFrame:
    """The funnel: `files` (file_id, size, quick_hash, content_hash) with missing hashes filled in.

    `contents` is (file_id, content), or a `Hasher` such as `hash_locations` gives. A file whose content is missing keeps its NULL hash and
    counts as an error. The candidates of each stage come from the catalogue alone.
    """
    read = hash_contents(contents) if isinstance(contents, DataFrame) else contents
    quick = read(need_quick_hash(files, min_size), chunk)
    # Catalogue columns only; read three times below, so the hashing is not repeated.
    with_quick = materialize(files.join(quick, "file_id", "left").select(
        *[c for c in files.columns if c != "quick_hash"], F.coalesce("quick_hash", "hash").alias("quick_hash")))
    full = read(need_full_hash(with_quick, max_size), None)
    return with_quick.join(full, "file_id", "left").select(
        *[c for c in with_quick.columns if c != "content_hash"], F.coalesce("content_hash", "hash").alias("content_hash"))


def stage_statistics(before: DataFrame, after: DataFrame, min_size: int = DEDUPE_MIN_SIZE,
                     max_size: int = FULL_HASH_MAX_SIZE) -> DataFrame:
    """How many hashes a run computed and how many files it could not read."""
    old = before.select("file_id", F.col("quick_hash").alias("old_quick"), F.col("content_hash").alias("old_full"))
    changed = after.join(old, "file_id").agg(
        F.count_if(F.col("old_quick").isNull() & F.col("quick_hash").isNotNull()).alias("quick_hashed"),
        F.count_if(F.col("old_full").isNull() & F.col("content_hash").isNotNull()).alias("full_hashed"))
    unread = (need_quick_hash(after, min_size).select("file_id")
              .unionByName(need_full_hash(after, max_size).select("file_id"))
              .agg(F.count("*").alias("errors")))
    # Two one-row tables side by side.
    return changed.withColumn("k", F.lit(1)).join(unread.withColumn("k", F.lit(1)), "k").drop("k")


def groups(files: DataFrame) -> DataFrame:
    """Groups of copies: exact once any member is fully hashed, else probable."""
    key = F.coalesce("content_hash", "quick_hash").alias("key")
    grouped = files.filter(F.col("quick_hash").isNotNull()).groupBy("size", key).agg(
        F.count("*").alias("copies"), F.count("content_hash").alias("hashed")).filter("copies > 1")
    return grouped.select(
        "size", "key", "copies", (F.col("size") * (F.col("copies") - 1)).alias("wasted_bytes"),
        F.when(F.col("hashed") > 0, "exact").otherwise("probable").alias("confidence"))


def group_page(files: DataFrame, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Groups that waste most."""
    return page(groups(files), [F.desc("wasted_bytes"), F.asc("size"), F.asc("key")], limit, offset)


def totals(files: DataFrame) -> DataFrame:
    return groups(files).agg(F.count("*").alias("total_groups"),
                             F.coalesce(F.sum("wasted_bytes"), F.lit(0)).alias("total_wasted_bytes"))


def group_members(files: DataFrame, folders: DataFrame, shares: DataFrame, limit: int | None = None,
                  offset: int = 0) -> DataFrame:
    """The files of all groups, or of one page of them, one row each."""
    chosen = groups(files) if limit is None and not offset else group_page(files, limit, offset)
    members = files.withColumn("key", F.coalesce("content_hash", "quick_hash")).join(chosen, ["size", "key"])
    where = folders.select("folder_id", F.col("path").alias("folder_path"))
    roots = shares.select("share_id", F.col("path").alias("share_path"))
    return (members.join(where, "folder_id").join(roots, "share_id").select(
        "size", "key", "copies", "wasted_bytes", "confidence", "file_id",
        P.display_path(F.col("share_path"), F.col("folder_path"), F.col("name")).alias("path"), "mtime"))
