"""What the operators of this subpackage share: tables, stored intermediates, row keys and Arrow schemas."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder, ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """Write once to the folder all executors share and read it back.

    Cuts the lineage and survives lost executors; unlike a checkpoint it is columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/sharescope-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """`df` less every column of these names, whatever their case or number."""
    taken = {n.lower() for n in names}
    keep = [c for c in df.columns if c.lower() not in taken]
    return df if len(keep) == len(df.columns) else df.select(*[quoted(c) for c in keep])


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns of these names, whatever their case, under names nothing else has, and what each column is called now."""
    private, used = {n.lower() for n in names}, {c.lower() for c in df.columns}
    called = {}
    for c in df.columns:
        new = c
        while new.lower() in private or (new != c and new.lower() in used):
            new = f"_{new}"
        used.add(new.lower())
        called[c] = new
    return (df.toDF(*called.values()) if any(a != b for a, b in called.items()) else df), called


def given_back(df: DataFrame, called: dict[str, str]) -> DataFrame:
    """`df` with its columns called as they were before `set_aside`."""
    names = {new: old for old, new in called.items()}
    return df.toDF(*[names.get(c, c) for c in df.columns]) if any(names.get(c, c) != c for c in df.columns) else df


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batch: pa.RecordBatch, text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `most` bytes of text each, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    start, held = 0, 0
    for row, size in enumerate(pa.compute.binary_length(column).fill_null(0).to_pylist()):
        if held and held + size > most:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def long_field(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())
