"""Patterns several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Up to this many rows Spark prunes each task's rows before the ranking shuffle by itself.
PRUNED_RANK = 1_000


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, salts: int = 64) -> DataFrame:
    """The first `n` rows of every group, exactly, with `rank`.

    A group may hold most of the table. For small `n` the optimizer's group limit drops rows
    before the shuffle; beyond it, each group is ranked in `salts` slices first, and only the
    first `n` of every slice meet in one task.
    """
    if n > PRUNED_RANK:
        slice_ = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
        within = F.row_number().over(Window.partitionBy(*keys, "slice").orderBy(*order))
        df = df.withColumn("slice", slice_).withColumn("rank", within).filter(F.col("rank") <= n).drop("slice", "rank")
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", ranked).filter(F.col("rank") <= n)


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """`df` with each row's place in an order, from 1, without bringing all rows into one task.

    Rows are sorted in ranges; how many rows the ranges before it have is added to a row's place in its own.
    """
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # one row a range
    return placed.withColumn("_part", part).join(before, "_part").withColumn(name, F.col("_before") + place + 1).drop("_id", "_part", "_before")


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def inline_rows(rows: list[tuple], names: list[str]) -> str:
    """A constant table as the argument of `inline`."""
    structs = ["named_struct(" + ", ".join(f"'{n}', {_literal(v)}" for n, v in zip(names, row)) + ")" for row in rows]
    return "inline(array(" + ", ".join(structs) + "))"


def constant_table(df: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small fixed table in the session of `df`, built inside the JVM."""
    return df.sparkSession.sql("SELECT " + inline_rows(rows, names))
