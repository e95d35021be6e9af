"""Reading and writing the catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import days_before, formula_safe
from ..schema import TABLES
from ..session import materialize
from .listing import list_shares, local_path, mounted, read_files

BOM = "﻿"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A catalogue table with its declared schema; nothing is inferred."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def _folder(spark: SparkSession, path: str):
    """A folder and its file system, whichever that is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def stored_partitions(spark: SparkSession, folder: str, name: str, partition: str) -> list[str]:
    """Values a stored table is partitioned by, from the names of its folders."""
    place, system = _folder(spark, f"{folder}/{name}")
    if not system.exists(place):
        return []
    found = (s.getPath().getName() for s in system.listStatus(place) if s.isDirectory())
    return sorted(n.split("=", 1)[1] for n in found if n.startswith(f"{partition}="))


def drop_partitions(spark: SparkSession, folder: str, name: str, partition: str, values: list) -> None:
    for value in values:
        place, system = _folder(spark, f"{folder}/{name}/{partition}={value}")
        system.delete(place, True)


def write_table(df: DataFrame, folder: str, name: str, partition: str | None = "share_id", processed: DataFrame | None = None) -> None:
    """A new version of a table. Partitioned tables replace only the partitions present in `df`.

    `processed` has the partition values this version speaks for: those of them without a row lose what was stored, so
    that a share whose files are all gone ends up without files. The rebalance spreads a dominant share over several
    files instead of one writer per share.
    """
    if partition is None:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return
    (df.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(f"{folder}/{name}"))
    if processed is not None:
        # As many values as the table has folders, which the driver lists for every read.
        empty = processed.select(partition).distinct().join(df.select(partition).distinct(), partition, "left_anti")
        drop_partitions(df.sparkSession, folder, name, partition, [r[0] for r in empty.collect()])


def append_events(events: DataFrame, folder: str, name: str = "audit_events") -> None:
    """Append audit events, partitioned by day so that retention drops whole folders."""
    day = events.withColumn("day", F.to_date("at"))
    day.write.mode("append").partitionBy("day").parquet(f"{folder}/{name}")


def purge_events(spark: SparkSession, folder: str, as_of: str, days: int, name: str = "audit_events") -> None:
    """Remove stored events older than the retention period; zero or less removes nothing.

    Whole days go as folders, unread. Only the day the period begins on is written again.
    """
    stored = stored_partitions(spark, folder, name, "day")
    if days <= 0 or not stored:
        return
    oldest = spark.range(1).select(days_before(as_of, days).alias("t")).first().t
    first = oldest.date().isoformat()
    if first in stored:
        kept = materialize(spark.read.parquet(f"{folder}/{name}").filter((F.col("day") == first) & (F.col("at") >= F.lit(oldest))))
        write_table(kept, folder, name, "day", spark.range(1).select(F.lit(first).cast("date").alias("day")))
    drop_partitions(spark, folder, name, "day", [d for d in stored if d < first])


def write_snapshots(rows: DataFrame, folder: str, name: str = "plan_snapshots") -> None:
    """Replace the (share, day) rows present in `rows`; other shares of those days stay as they are."""
    spark = rows.sparkSession
    if stored_partitions(spark, folder, name, "day"):
        days = rows.select("day").distinct()
        stored = spark.read.parquet(f"{folder}/{name}").select(*rows.columns).join(days, "day", "left_semi")
        # Read before its folders are replaced.
        rows = materialize(stored.join(rows.select("share_id", "day"), ["share_id", "day"], "left_anti").select(*rows.columns).unionByName(rows))
    write_table(rows, folder, name, "day")


def csv_cells(df: DataFrame) -> DataFrame:
    """Every column as it goes into a spreadsheet: ISO times, no live formulas, lists in one cell."""
    cells = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "string":
            c = formula_safe(c)
        elif kind.startswith("timestamp"):
            c = F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000\z", "")
        elif kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), ", ")
        cells.append(c.alias(name))
    return df.select(*cells)


def export_csv(df: DataFrame, target: str) -> None:
    """Spreadsheet export: ";" between cells, header, byte-order mark.

    Every part file is complete by itself (mark and header), so a large export stays distributed
    and a page of a few rows is one file.
    """
    out = csv_cells(df)
    if out.columns:
        out = out.withColumnRenamed(out.columns[0], BOM + out.columns[0])
    (out.write.mode("overwrite").option("sep", ";").option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("encoding", "UTF-8").option("emptyValue", "").csv(target))


def partitioned_listing(spark: SparkSession, root: str) -> DataFrame:
    """One row per file under `root`: folder path, name, size and time, without opening any content."""
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
           .select("path", "length", "modificationTime"))
    clean = F.regexp_replace("path", r"\A[a-z0-9]+:/*", "/")
    base = root.rstrip("/").split("://", 1)[-1]
    relative = F.substring_index(clean, base.lstrip("/") + "/", -1)
    return raw.select(
        F.regexp_extract(relative, r"\A(?:(.*)/)?[^/]*\z", 1).alias("path"),
        F.regexp_extract(relative, r"([^/]*)\z", 1).alias("name"), F.lit(False).alias("is_dir"),
        F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime"),
        F.lit(False).alias("is_reparse_point"))


def read_contents(spark: SparkSession, root: str, max_size: int | None = None) -> DataFrame:
    """(path, length, content) of all files, or of those not above `max_size`; the size filter runs before any read.

    What executors mount is listed in shards and opened by tasks of many files each. Elsewhere Spark's own reader lists, which takes the driver's time and memory for every file.
    Links to folders are not followed there. Either way empty files and names that begin with "." or "_" are passed over, as Spark does.
    """
    if not mounted(root):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        return (files if max_size is None else files.filter(F.col("length") <= max_size)).select("path", "length", "content")
    place = local_path(root).rstrip("/")
    entries, unlisted = list_shares(spark, {0: place})
    broken = unlisted.first()
    if broken is not None:
        raise OSError(f"{place}/{broken['path']}: {broken['list_error']}")
    whole = F.concat_ws("/", F.when(F.col("path") != "", F.col("path")), "name")
    hidden = F.exists(F.split(whole, "/"), lambda n: (n.startswith(".") | (n.startswith("_") & ~n.contains("=")) | n.endswith("._COPYING_")) & ~n.isin("_metadata", "_common_metadata"))
    files = entries.filter(~F.col("is_dir") & (F.col("size") > 0)).filter(~hidden)
    if max_size is not None:
        files = files.filter(F.col("size") <= max_size)
    return read_files(files.select(F.concat(F.lit(f"file:{place}/"), whole).alias("path")).repartition("path"))
