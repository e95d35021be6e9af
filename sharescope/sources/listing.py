"""Directory trees on file systems that executors mount: listed in shards, and read by ranges of bytes.

A listing is a Spark data source with one input partition for each shard of the trees. Directories down to `LEVEL` are dealt to
shards by a checksum of their path, and what lies below a directory of that level stays with it; so every entry comes from
one shard, whichever executor reads it, and the driver lists nothing. Each shard passes through the directories above the
level without asking for their entries' times and sizes. File systems change while they are listed, so a listing is stored
once and everything after it works on that.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import materialize
from .texts import arrow_rows, in_small_batches

LEVEL, SHARDS = 2, 32
BLOCK = 1 << 20
ENTRY = ("share_id int, path string, name string, is_dir boolean, size bigint, mtime timestamp_ntz, ctime timestamp_ntz, "
         "is_reparse_point boolean, list_error string")
_EPOCH = datetime(1970, 1, 1)


def local_path(location: str) -> str:
    """A location without its `file:` scheme."""
    return "/" + location.split(":", 1)[1].lstrip("/") if location.startswith("file:") else location


def mounted(location: str) -> bool:
    """Whether a location is a path on a file system that executors mount."""
    return location.startswith(("/", "file:"))


def moment(nanoseconds: int) -> datetime:
    return _EPOCH + timedelta(microseconds=nanoseconds // 1000)


class Shard(InputPartition):
    def __init__(self, number: int):
        self.number = number


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        self.shards = int(options.get("shards", SHARDS))

    def partitions(self) -> list[Shard]:
        return [Shard(n) for n in range(self.shards)]

    def read(self, shard: Shard) -> Iterator[tuple]:
        for share_id, root in self.roots.items():
            yield from self.share(int(share_id), root, shard.number)

    def share(self, share_id: int, root: str, number: int) -> Iterator[tuple]:
        todo = [("", 0)]
        while todo:
            path, level = todo.pop()
            # Below the level, whatever this shard comes to is its own.
            mine = level > LEVEL or zlib.crc32(f"{share_id}:{path}".encode("utf-8", "surrogateescape")) % self.shards == number
            if not mine and level == LEVEL:
                continue
            try:
                with os.scandir(os.path.join(root, path)) as entries:
                    for entry in entries:
                        link = entry.is_symlink()
                        folder = entry.is_dir()
                        if folder and not link:
                            todo.append((f"{path}/{entry.name}" if path else entry.name, level + 1))
                        if mine:
                            yield self.row(share_id, path, entry, folder, link)
            except OSError as problem:
                if mine:
                    yield (share_id, shown(path), None, True, 0, None, None, False, f"{type(problem).__name__}: {problem.strerror}")

    @staticmethod
    def row(share_id: int, path: str, entry: os.DirEntry, folder: bool, link: bool) -> tuple:
        try:
            about = entry.stat(follow_symlinks=not link)
        except OSError:  # gone since, or not ours to see: listed all the same, with nothing known about it
            return share_id, shown(path), shown(entry.name), folder, 0, None, None, link, None
        size = 0 if folder else about.st_size
        return share_id, shown(path), shown(entry.name), folder, size, moment(about.st_mtime_ns), moment(about.st_ctime_ns), link, None


def shown(name: str) -> str:
    """A name as text; bytes that are not UTF-8 become the replacement sign."""
    return name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "share_listing"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def list_shares(spark: SparkSession, roots: dict[int, str], shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """What lies below the root of each share: (entries, folders that could not be listed).

    Entries are (share_id, path of the folder, name, is_dir, size, mtime, ctime, is_reparse_point), times in UTC; a folder has size 0. Links are listed
    and not followed. A folder that can't be listed, the root itself included, is (share_id, path, list_error), as `reconcile` takes it.
    An empty root gives no rows. There are as many roots as shares, each given by the caller.
    """
    spark.dataSource.register(Listing)
    places = json.dumps({str(k): local_path(v) for k, v in roots.items()})
    rows = materialize(spark.read.format("share_listing").option("roots", places).option("shards", shards).load())
    return (rows.filter("list_error IS NULL").drop("list_error"),
            rows.filter("list_error IS NOT NULL").select("share_id", "path", "list_error"))


def ends_hash(location: str, chunk: int) -> tuple[int, str, int]:
    """(size, hash of size, first and last chunk, bytes read) of a file of which only its ends are read."""
    with open(location, "rb", buffering=0) as file:
        size = os.fstat(file.fileno()).st_size
        parts = [exactly(file, min(size, chunk))]
        if size > chunk:
            rest = min(size - chunk, chunk)
            file.seek(size - rest)
            parts.append(exactly(file, rest))
    return size, hashlib.sha256(str(size).encode() + b"".join(parts)).hexdigest(), sum(map(len, parts))


def exactly(file, count: int) -> bytes:
    held = bytearray()
    while len(held) < count and (part := file.read(count - len(held))):
        held += part
    return bytes(held)


def whole_hash(location: str) -> tuple[int, str, int]:
    """(size, hash, bytes read) of a whole file, a block at a time."""
    digest, size = hashlib.sha256(), 0
    with open(location, "rb", buffering=0) as file:
        while block := file.read(BLOCK):
            digest.update(block)
            size += len(block)
    return size, digest.hexdigest(), size


def hash_files(located: DataFrame, chunk: int | None) -> DataFrame:
    """(file_id, hash, bytes_read, error) of files at `location`: of their ends, or of everything if `chunk` is None.

    A task holds two chunks or one block at a time, however large the file. A file that can't be read has an error and no hash.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, location in zip(batch["file_id"], batch["location"]):
                try:
                    place = local_path(location)
                    _, digest, count = whole_hash(place) if chunk is None else ends_hash(place, chunk)
                    rows.append((file_id, digest, count, None))
                except (OSError, TypeError, AttributeError) as problem:
                    rows.append((file_id, None, 0, f"{type(problem).__name__}: {getattr(problem, 'strerror', None) or problem}"))
            yield pd.DataFrame(rows, columns=["file_id", "hash", "bytes_read", "error"])

    kind = dict(located.dtypes)["file_id"]
    return located.select("file_id", "location").mapInPandas(read, f"file_id {kind}, hash string, bytes_read bigint, error string")


_WHOLE = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])


def read_files(located: DataFrame) -> DataFrame:
    """(path, length, content) of the files at `path`, read whole. A file that can't be read fails the job."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (path,) in arrow_rows(batches, "path"):
                with open(local_path(path), "rb") as file:
                    content = file.read()
                yield path, len(content), content

        return in_small_batches(rows(), _WHOLE, lambda r: r[1])

    return located.select("path").mapInArrow(read, "path string, length bigint, content binary")


def write_tree(files: DataFrame) -> DataFrame:
    """Files (location, content, mtime) put where they belong; (location, size) of each.

    Written under another name and then renamed, so a task that is run again leaves the same file. Two rows of one location overwrite each other.
    """
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: set[str] = set()
        for batch in batches:
            for location, content, mtime in zip(batch["location"], batch["content"], batch["mtime"]):
                place = local_path(location)
                folder = os.path.dirname(place)
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                passing = f"{place}.{os.getpid()}.part"
                with open(passing, "wb") as file:
                    file.write(content)
                if not pd.isna(mtime):
                    seconds = pd.Timestamp(mtime).tz_localize(UTC).value
                    os.utime(passing, ns=(seconds, seconds))
                os.replace(passing, place)
            yield pd.DataFrame({"location": batch["location"], "size": [len(c) for c in batch["content"]]})

    return (files.select("location", F.coalesce("content", F.lit(b"")).alias("content"), F.col("mtime").cast("timestamp_ntz").alias("mtime"))
            .mapInPandas(put, "location string, size bigint"))
