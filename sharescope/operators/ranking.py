"""Relevance by cover density: how close together, and where, the things a query asks for stand.

A file's words are numbered through name, place and content. A cover is a shortest stretch that holds one alternative of the query whole; it counts the
harmonic mean of the weights of the query's words in it, divided by one more than the number of other words between them. A file's relevance is
the sum over its covers, so near words count more than far ones, names more than contents, and repeated ones add up.

Covers come from window functions over a file's hits in order: the last start of every item that was seen so far, the earliest of these for each
alternative, and the latest of those. A cover ends where that start moves on. Nothing of a file is gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_array
from .indexing import WEIGHTS

FILE = ["query_no", "file_id"]


def word_counts(files: DataFrame, share: str = "share", place: str = "folder_path") -> DataFrame:
    """(file_id, name_words, place_words): how many words stand before a file's place and before its content."""
    return files.select("file_id", F.size(word_array(F.col("name"))).alias("name_words"), F.size(word_array(F.concat_ws(" ", share, place))).alias("place_words"))


def slots_of(rows: list[tuple]) -> dict[int, dict[tuple, list[int]]]:
    """For every query its alternatives (config, clause) with the numbers of their items; `rows` are (query_no, unit, config, clause, item, ...)."""
    slots: dict[int, dict[tuple, list[int]]] = {}
    for number, unit, config, clause, item, *_ in rows:
        if unit == 0:
            items = slots.setdefault(number, {}).setdefault((config, clause), [])
            if item not in items:
                items.append(item)
    out: dict[int, dict[tuple, list[int]]] = {}
    for number, alternatives in slots.items():
        taken = 0
        for key, items in alternatives.items():
            out.setdefault(number, {})[key] = list(range(taken, taken + len(items)))
            taken += len(items)
    return out


def _slot(slots: dict[int, dict[tuple, list[int]]], rows: list[tuple]) -> Column:
    """The number of a hit's item among all items of its query."""
    chosen, seen = F.lit(None).cast("int"), {}
    for number, unit, config, clause, item, *_ in rows:
        if unit == 0:
            place = seen.setdefault((number, config, clause), {})
            at = slots[number][(config, clause)][place.setdefault(item, len(place))]
            same = (F.col("query_no") == number) & (F.col("config") == config) & (F.col("clause") == clause) & (F.col("item") == item)
            chosen = F.when(same, at).otherwise(chosen)
    return chosen


def cover_scores(hits: DataFrame, counts: DataFrame, rows: list[tuple], tasks: int | None = None) -> DataFrame:
    """(query_no, file_id, score) for files with a cover.

    `hits` as `search.posting_hits` gives them, for files in `counts` (see `word_counts`); `rows` are the query's items it was asked with. Files are dealt
    over `tasks` tasks, which sort their hits; by default over as many as Spark is set to.
    """
    slots = slots_of(rows)
    if not slots:
        return hits.sparkSession.createDataFrame([], "query_no int, file_id long, score double")
    inverse = reduce(lambda c, kv: F.when(F.col("field") == kv[0], round(10 / kv[1])).otherwise(c), WEIGHTS.items(), F.lit(0))
    before = F.when(F.col("field") == "C", F.col("name_words") + F.col("place_words")).when(F.col("field") == "B", F.col("name_words")).otherwise(0)
    asked = hits.filter("unit = 0").withColumn("slot", _slot(slots, rows)).filter("slot IS NOT NULL").select(*FILE, "slot", "offset", "word_count", "field", "pos")
    if tasks:
        asked = asked.repartition(tasks, "file_id")
    # Stored hits compress so well that by their files' size the driver would build and send a table of all of them: they are merged with the counts instead.
    placed = asked.join(counts.hint("merge"), "file_id").select(
        *FILE, "slot", "offset", "word_count", "field", (F.col("pos") + before).cast("long").alias("at"), inverse.alias("inverse"))
    # A word that several items ask for is one word: only its first row counts.
    order = Window.partitionBy(*FILE).orderBy("at")
    first = F.coalesce(F.lag("at").over(order) != F.col("at"), F.lit(True)).cast("int")
    counted = placed.withColumn("first", first).withColumns({
        "n": F.sum("first").over(order), "sum": F.sum(F.col("first") * F.col("inverse")).over(order)})
    mark = F.struct("n", "at", (F.col("sum") - F.col("inverse")).alias("sum"))
    alone = counted.filter("word_count = 1").select(*FILE, "slot", mark.alias("start"), "at", "n", "sum")
    runs = (counted.filter("word_count > 1").groupBy(*FILE, "slot", "word_count", "field", (F.col("at") - F.col("offset")).alias("run"))
            .agg(F.count_distinct("offset").alias("have"), F.min(mark).alias("start"), F.max("at").alias("at"), F.max("n").alias("n"), F.max("sum").alias("sum"))
            .filter("have = word_count").select(*FILE, "slot", "start", "at", "n", "sum"))
    ends = alone.unionByName(runs)
    width = max(s for alternatives in slots.values() for items in alternatives.values() for s in items) + 1
    seen = ends.withColumns({f"s{i}": F.max(F.when(F.col("slot") == i, F.col("start"))).over(order) for i in range(width)})
    best = F.lit(None)
    for number, alternatives in slots.items():
        starts = [F.when(reduce(lambda a, b: a & b, [F.col(f"s{i}").isNotNull() for i in items]), _least([F.col(f"s{i}") for i in items])) for items in alternatives.values()]
        best = F.when(F.col("query_no") == number, starts[0] if len(starts) == 1 else F.greatest(*starts)).otherwise(best)
    covers = (seen.withColumn("best", best).filter("best IS NOT NULL").groupBy(*FILE, "at").agg(F.max("best").alias("best"), F.max("n").alias("n"), F.max("sum").alias("sum"))
              .withColumn("last", F.lag("best.at").over(order)).filter("last IS NULL OR best.at > last"))
    words, others = F.col("n") - F.col("best.n") + 1, F.col("at") - F.col("best.at") - (F.col("n") - F.col("best.n"))
    weight = words * 10 / (F.col("sum") - F.col("best.sum")) / (1 + others)
    return covers.groupBy(*FILE).agg(F.round(F.sum(weight), 6).alias("score"))


def _least(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)
