"""An index that follows the catalogue: base and later postings by bucket, tombstones for what they replace, compaction of single buckets.

Postings carry the round they were written in. A tombstone (file_id, field, round) hides the postings of that file and field from earlier
rounds, so nothing is read or rewritten when a file changes: its new words are added, and its old ones are passed over when they are read. Compaction writes the live postings of
chosen buckets as one part each and leaves all other buckets where they are; tombstones go when no part is older than they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.versions import Change, Store, written_in
from .indexing import POSTING_BUCKETS, _bucket, content_postings, title_postings

ORDER = ("word", "file_id", "field", "pos")
TITLE, CONTENT = ("A", "B"), ("C",)
# Sorted postings shrink to a few bytes each, so that a split of many megabytes would be tens of millions of rows: files end by their number.
FILE_ROWS = 200_000
# Postings that a task groups.
POSTINGS_PART = 500_000


def _laid_out(rows: DataFrame, number: int, buckets: int) -> DataFrame:
    return rows.select("word", "file_id", "field", "pos", F.lit(number).cast("long").alias("round"), _bucket(F.col("word"), buckets).alias("bucket"))


def _change(rows: DataFrame, replaces: str | tuple = "all") -> Change:
    return Change(rows, "bucket", replaces, ORDER, FILE_ROWS)


def _hidden(store: Store, version: int) -> DataFrame:
    """The last round each file and field was replaced in."""
    return store.read("gone", version).groupBy("file_id", "field").agg(F.max("round").alias("until"))


def start_index(store: Store, files: DataFrame, folders: DataFrame, shares: DataFrame, documents: DataFrame, buckets: int = POSTING_BUCKETS) -> int:
    """Index every file with an index row, from scratch."""
    number = store.manifest().version + 1
    rows = title_postings(files, folders, shares, documents).unionByName(content_postings(documents))
    none = store.spark.createDataFrame([], "file_id long, field string, round long")
    return store.commit({"postings": _change(_laid_out(rows, number, buckets)), "gone": Change(none)})


def update_index(store: Store, gone: DataFrame, titled: DataFrame, read: DataFrame, folders: DataFrame, shares: DataFrame, buckets: int = POSTING_BUCKETS) -> int:
    """Add a round: `gone` files (file_id) vanish, `titled` files (rows of the file table) get their names and places anew, `read` documents (file_id, content) their contents.

    A file may be in several of them. Nothing stored is read.
    """
    base = store.manifest()
    number = base.version + 1
    fields = lambda df, names: df.select("file_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("field"))
    dead = fields(gone, TITLE + CONTENT).unionByName(fields(titled, TITLE)).unionByName(fields(read, CONTENT)).distinct()
    left = lambda df: df.join(gone.select("file_id"), "file_id", "left_anti")
    titles = left(titled)
    rows = title_postings(titles, folders, shares, titles.select("file_id")).unionByName(content_postings(left(read)))
    return store.commit({"postings": _change(_laid_out(rows, number, buckets), "nothing"),
                         "gone": Change(dead.withColumn("round", F.lit(number).cast("long")), replaces="nothing")}, base)


def rename_in_index(store: Store, files: DataFrame, folders: DataFrame, shares: DataFrame, buckets: int = POSTING_BUCKETS) -> int:
    """Add a round after a share got a new name: the places of its `files` (rows of the file table) anew. Nothing stored is read, names and contents stay."""
    base = store.manifest()
    number = base.version + 1
    rows = title_postings(files, folders, shares, files.select("file_id")).filter("field = 'B'")
    dead = files.select("file_id", F.lit("B").alias("field"), F.lit(number).cast("long").alias("round"))
    return store.commit({"postings": _change(_laid_out(rows, number, buckets), "nothing"), "gone": Change(dead, replaces="nothing")}, base)


def live_postings(store: Store, version: int | None = None, values: list[int] | None = None) -> DataFrame:
    """(word, file_id, field, pos, bucket) that are in force, of all buckets or of some."""
    at = store.manifest(version).version
    rows = store.read("postings", at, values).join(_hidden(store, at), ["file_id", "field"], "left")
    return rows.filter("until IS NULL OR round >= until").select("word", "file_id", "field", "pos", "bucket")


def dealt_postings(store: Store, version: int | None = None) -> DataFrame:
    """The same of all buckets, dealt over tasks by their number; a word of a file stays in one task, but a frequent word is spread."""
    at = store.manifest(version).version
    count = store.read("postings", at).count()
    return live_postings(store, at).repartition(count // POSTINGS_PART + 1, "word", "file_id")


def crowded_buckets(store: Store, parts: int = 4) -> list[int]:
    """Buckets that consist of more than `parts` writes, from the manifest alone."""
    counts: dict[str, int] = {}
    for name, value, _ in store.manifest().parts:
        if name == "postings":
            counts[value] = counts.get(value, 0) + 1
    return sorted(int(v) for v, n in counts.items() if n > parts)


def compact_index(store: Store, values: list[int]) -> int:
    """Write the live postings of some buckets as one part each; other buckets' files stay as they are."""
    base = store.manifest()
    number = base.version + 1
    rows = live_postings(store, base.version, values).withColumn("round", F.lit(number).cast("long")).select("word", "file_id", "field", "pos", "round", "bucket")
    chosen = {str(v) for v in values}
    # The oldest round any other part may have: tombstones up to it hide nothing any more.
    rest = [written_in(path) for name, value, path in base.parts if name == "postings" and value not in chosen]
    oldest = min(rest, default=number)
    gone = store.read("gone", base.version).filter(F.col("round") > oldest)
    return store.commit({"postings": _change(rows, tuple(values)), "gone": Change(gone)}, base)
