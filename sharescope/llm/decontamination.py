"""Benchmark decontamination: MinHash containment search, partitioned by size, in DataFrame functions only.

Test items are short and documents may be long, so the similarity that counts is containment: the share of an item's
shingles that a document has. Items are partitioned by their number of shingles, in powers of two, and in each
partition an item's MinHash sketch is its `k` smallest shingle hashes, with `k` one more than an item of that partition may
lack. A document above the threshold lacks too few shingles to miss the whole sketch: it has at least `k` less those an item
may lack. So candidates, the pairs with that many sketch hits, hold every true pair at any document length, and
few others. The shingles themselves decide: candidates are verified by exact containment.

A bitmap of `BITS` bits, of the hashes that items have at all, travels with the plan whatever the number of items. It drops
nearly all shingles of a document inside its row, before a row is made of them; with very many items it drops fewer, and
the joins below decide all the same. Join sides are left to their measured size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

SHINGLE, CONTAINMENT = 5, 0.8
BITS = 1 << 18


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space; none for a null."""
    return F.coalesce(F.array_remove(F.split(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+"), ""), F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for each row, also where `body` uses it for each element of an array."""
    return F.get(F.transform(F.array(value), body), 0)


def shingle_hashes(words: Column, size: int) -> Column:
    """A hash for every run of `size` words; fewer words are one run, none is none."""
    last = F.greatest(F.size(words) - size, F.lit(0))
    runs = let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(hashes, i, size))))
    return F.when(F.size(words) > 0, runs).otherwise(F.array().cast("array<long>"))


def item_shingles(items: DataFrame, item_id: str, text: str, size: int, threshold: float) -> DataFrame:
    """(item_id, version, n, need, h, shingle, sketched): every distinct shingle of every item.

    `version` tells items apart, also those without an id. `n` counts the item's shingles, `need` is how many of its sketched ones a document must have.
    """
    listed = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).distinct()
    told = listed.withColumn("s", F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - size, F.lit(0)) + 1), lambda i: F.concat_ws(" ", F.slice("w", i, size)))))
    told = told.filter(F.size("w") > 0).withColumn("n", F.size("s")).withColumn("version", F.xxhash64("item_id", "w"))
    # The largest number of shingles in the item's partition, and what an item of that size may lack.
    widest = (F.pow(F.lit(2), F.ceil(F.log2("n")))).cast("int")
    lacks = lambda n: F.floor(F.round((1 - threshold) * n, 9)).cast("int")
    told = told.withColumn("k", F.least(lacks(widest) + 1, "n")).withColumn("need", F.greatest(F.col("k") - lacks(F.col("n")), F.lit(1)))
    hashed = F.transform("s", lambda x: F.struct(shingle_hashes(F.split(x, " "), size)[0].alias("h"), x.alias("shingle")))
    told = told.withColumn("pairs", F.array_sort(hashed))
    return told.select("item_id", "version", "n", "k", "need", F.posexplode("pairs").alias("at", "pair")).select(
        "item_id", "version", "n", "need", "pair.h", "pair.shingle", (F.col("at") < F.col("k")).alias("sketched"))


def bitmap(hashes: DataFrame, bits: int = BITS) -> list[int]:
    """`bits` bits, as longs, with those of all `h` set: of one size whatever the number of hashes."""
    place = F.pmod("h", F.lit(bits))
    rows = hashes.groupBy(F.shiftright(place, 6).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {bits}) & 63 as int))")).alias("set")).collect()
    found = [0] * (bits >> 6)
    for row in rows:
        found[row["at"]] = row["set"]
    return found


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
              size: int = SHINGLE, threshold: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment): documents with at least `threshold` of an item's shingles.

    Shingles are distinct runs of `size` lower-cased words; a text of fewer words is one shingle. Null and empty texts have
    none and match nothing. Repeated rows of documents or items give one row; rows that share an id but not a
    text are judged each, and the fullest containment of a pair is returned. Either table may be empty.
    """
    known = store(item_shingles(items, item_id, text, size, threshold))
    mask, place = F.lit(bitmap(known.select("h").distinct())), lambda h: F.pmod(h, F.lit(BITS))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), place(h).bitwiseAND(F.lit(63)).cast("int"))
    may = lambda h: F.get(mask, F.shiftright(place(h), 6).cast("int")).bitwiseAND(bit(h)) != 0
    numbered = lambda w: F.transform(shingle_hashes(w, size), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    spelt = lambda w, p: F.struct(p["h"].alias("h"), F.concat_ws(" ", F.slice(w, p["i"] + 1, size)).alias("shingle"))
    told = let(words(F.col(text)), lambda w: F.transform(F.filter(numbered(w), lambda p: may(p["h"])), lambda p: spelt(w, p)))
    # A row for each shingle that some item may have; `owner` tells documents apart, also those without an id.
    shared = store(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("owner"), F.explode(F.array_distinct(told)).alias("t"))
                   .select("doc_id", "owner", "t.h", "t.shingle"))
    shared = shared.distinct()

    sketch = known.filter("sketched").select("version", "need", "h")
    candidates = shared.join(sketch, "h").groupBy("owner", "version", "need").agg(F.count("*").alias("hits")).filter("hits >= need").select("owner", "version")
    candidates = store(candidates)
    # Candidates meet the items first, and only their own shingles meet the document's: pairs that share a frequent shingle and nothing else make no row.
    asked = candidates.join(known.select("item_id", "version", "n", "shingle"), "version")
    held = shared.select("doc_id", "owner", "shingle")
    counted = asked.join(held, ["owner", "shingle"]).groupBy("doc_id", "owner", "item_id", "version", "n").agg(F.count("*").alias("n_shared"))
    verified = counted.filter(F.col("n_shared") >= F.col("n") * threshold - 1e-9)
    fullest = F.max(F.struct((F.col("n_shared") / F.col("n")).alias("containment"), "n_shared", F.col("n").cast("long").alias("n_shingles")))
    return verified.groupBy("doc_id", "item_id").agg(fullest.alias("m")).select("doc_id", "item_id", "m.n_shared", "m.n_shingles", "m.containment")
