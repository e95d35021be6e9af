"""Stored tables in versions.

A store is a folder with `data/`, which only grows, and `manifests/`, one for each version. A write first stores its rows under a name of
its own and then adds the next manifest, a single row that lists the data folders of every table. So several tables change together or not at all: a write that breaks off leaves folders
nobody lists, and readers of a version are never disturbed by later ones. A manifest holds one entry a partition and write, never a row's data.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART = "array<struct<name: string, value: string, path: string>>"
_MANIFEST = f"version long, tables map<string, string>, parts {_PART}"


class Conflict(RuntimeError):
    """Another write has added the version this one was about to add."""


@dataclass(frozen=True)
class Change:
    """New rows of a table, and what they stand instead of.

    `replaces` is "all", "own" (the partitions the rows lie in), "nothing" (rows are added), or a list of partition values, which go
    whether or not rows take their place. `order` sorts the rows of each file, `file_rows` is the most rows of a file (0: any number).
    """

    rows: DataFrame
    partition: str | None = None
    replaces: str | tuple = "all"
    order: tuple[str, ...] = ()
    file_rows: int = 0


@dataclass(frozen=True)
class Manifest:
    version: int
    tables: dict[str, str]
    parts: tuple[tuple[str, str | None, str], ...]


def written_in(path: str) -> int:
    """The version that added a part."""
    return int(path.split("-")[1])


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_MANIFEST).json(f"{self.folder}/manifests/*")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def manifest(self, version: int | None = None) -> Manifest:
        """The latest version, or an older one; version 0 is a store without tables."""
        known = self._manifests()
        if known is not None:
            chosen = known.filter("version IS NOT NULL") if version is None else known.filter(F.col("version") == version)
            row = chosen.orderBy(F.desc("version")).limit(1).collect()
            if row:
                return Manifest(row[0]["version"], dict(row[0]["tables"]), tuple(tuple(p) for p in row[0]["parts"]))
        if version:
            raise LookupError(f"{self.folder} has no version {version}")
        return Manifest(0, {}, ())

    def read(self, name: str, version: int | None = None, values: list | None = None) -> DataFrame:
        """A table as of a version, or only its partitions of some values."""
        found = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(found.tables[name]))
        wanted = None if values is None else {str(v) for v in values}
        paths = [f"{self.folder}/{path}" for table, value, path in found.parts if table == name and (wanted is None or value in wanted)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/data").parquet(*paths).select(*[f"`{c}`" for c in schema.names])

    def commit(self, changes: dict[str, Change], base: Manifest | None = None) -> int:
        """Store the changes of all tables as the next version of `base` (by default the latest); other tables stay as they are."""
        base = base or self.manifest()
        number, tables, parts = base.version + 1, dict(base.tables), list(base.parts)
        for name, change in changes.items():
            written = self._write(name, change, number)
            tables[name] = change.rows.schema.json()
            own = {value for _, value, _ in written}
            gone = {str(v) for v in change.replaces} if not isinstance(change.replaces, str) else own
            parts = [p for p in parts if p[0] != name or (change.replaces != "all" and (change.replaces == "nothing" or p[1] not in gone))] + written
        row = self.spark.createDataFrame([(number, tables, parts)], _MANIFEST)
        try:
            row.coalesce(1).write.mode("error").json(f"{self.folder}/manifests/{number:012d}")
        except AnalysisException as taken:
            raise Conflict(f"version {number} of {self.folder} is there already") from taken
        return number

    def _write(self, name: str, change: Change, number: int) -> list[tuple[str, str | None, str]]:
        place = f"data/write={name}-{number}-{uuid.uuid4().hex}"
        rows, column = change.rows, change.partition
        # The rebalance spreads a partition that is larger than others over several files.
        dealt = rows.hint("rebalance", column) if column else rows
        if change.order:
            dealt = dealt.sortWithinPartitions(*([column] if column else []), *change.order)
        writer = dealt.write.mode("error").option("maxRecordsPerFile", change.file_rows)
        (writer.partitionBy(column) if column else writer).parquet(f"{self.folder}/{place}")
        if column is None:
            return [(name, None, place)]
        # Values come from the names of folders; no row is read.
        try:
            stored = self.spark.read.parquet(f"{self.folder}/{place}").select(F.col(column).cast("string")).distinct().collect()
        except AnalysisException as empty:
            if empty.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return []
        return [(name, value, f"{place}/{column}={value}") for (value,) in sorted(stored, key=str)]

    def vacuum(self, keep: int = 1) -> int:
        """Remove manifests but the last `keep` and the data none of these lists; how many data folders went."""
        manifests = self._manifests()
        if manifests is None:
            return 0
        newest = manifests.filter("version IS NOT NULL").orderBy(F.desc("version")).limit(keep).collect()
        used = {p["path"].split("/")[1] for row in newest for p in row["parts"]}
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        system = hadoop(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in system.listStatus(hadoop(f"{self.folder}/manifests")):
            if int(status.getPath().getName()) < min(row["version"] for row in newest):
                system.delete(status.getPath(), True)
        doomed = [s.getPath() for s in system.listStatus(hadoop(f"{self.folder}/data")) if s.getPath().getName() not in used]
        for path in doomed:
            system.delete(path, True)
        return len(doomed)

