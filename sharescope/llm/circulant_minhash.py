"""MinHash near-duplicates by circulant permutations, confirmed on the words of the whole sets.

A document's set is its distinct five-word shingles. One permutation deals shingles to the places of a circle, a second numbers the places;
coordinate i of the signature is the smallest number on the set's places when the second permutation is turned by i. So two permutations give all `BANDS * ROWS` coordinates, and what
a shingle contributes to them is one run of consecutive numbers. Two sets with a Jaccard similarity of 0.85 agree in a band with probability 0.85^6, so
that all 40 bands miss such a pair with probability 6e-9.

Documents with equal sets are one class, and classes are what is banded and linked. A band's members are never expanded into pairs: each
is compared with one of them, by turns that differ between bands. Where a band holds several components after that, most members are ruled out at once: a set that is linked with another shares 85 % of
its own shingles with it, so one of whose shingles fewer occur in other components has no link to them. What is left meets in cells of
bounded size, where common shingles are counted by an index. So components are exactly those of all pairs that share a band.

A comparison counts the common shingles themselves. Texts travel to their comparisons dealt by hub, and a hub with very many members
is dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, slices, store
from .components import components
from .words import mix, places, room, rows_of, run_hashes, split_words, word_hashes

SHINGLE, SIMILAR = 5, 85
BANDS, ROWS = 40, 6
PLACES = 22
MEMBERS = 512
CELL_ROWS, CELL_BYTES = 1024, 16 << 20
TURNS = (0, 0x5DEECE66D1B54A3, 0x2545F4914F6CDD1D)


@lru_cache(maxsize=1)
def circle() -> np.ndarray:
    """Row p: the numbers of the places p, p + 1, ... as far as there are coordinates, on a circle of 2^PLACES places."""
    numbers = np.random.default_rng(11).permutation(1 << PLACES).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([numbers, numbers[:BANDS * ROWS]]), BANDS * ROWS)


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The coordinates of every set, a row each; every set has a shingle at least."""
    place = (mix(hashes ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACES)).astype(np.int64)
    out = np.full((len(bounds) - 1, BANDS * ROWS), np.iinfo(np.int32).max, dtype=np.int32)
    runs = circle()
    for at in range(0, len(place), 8192):
        some = runs[place[at:at + 8192]]
        first = np.searchsorted(bounds, at, side="right") - 1
        last = np.searchsorted(bounds, at + len(some), side="left")
        low = np.minimum.reduceat(some, np.maximum(bounds[first:last], at) - at, axis=0)
        np.minimum(out[first:last], low, out=out[first:last])
    return out


def sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles of every text, and where each text's begin."""
    words, bounds = split_words(texts)
    hashes = word_hashes(pc.ascii_lower(words))
    runs = run_hashes(hashes, shingle)
    whole = room(bounds) >= shingle
    owner, found = rows_of(bounds)[whole], runs[whole[:len(runs)]]
    # With fewer words the whole sequence is one shingle.
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < shingle))
    few = np.array([xxhash.xxh3_64_intdigest(hashes[bounds[r]:bounds[r + 1]].tobytes(), 5) for r in short], dtype=np.uint64)
    owner, found = np.concatenate([owner, short]), np.concatenate([found, few])
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])))[:len(owner)]
    return found[new], np.searchsorted(owner[new], np.arange(len(bounds)))


def bands_of(coordinates: np.ndarray) -> np.ndarray:
    """A hash of every band of every signature, its number included."""
    wide = coordinates.reshape(len(coordinates), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(coordinates), BANDS))
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, i])
    return key.view(np.int64)


def marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, h, n_shingles, key, bands) for every row: hash of the text, size, identity of the set, and hashes of its bands.

    A row without words has a null key and null bands.
    """
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", 2 << 20):
                hashes, bounds = sets(rows.column(2))
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                begins = np.concatenate((bounds[:-1][full], bounds[-1:]))
                keys = [None] * len(n)
                for r in full.tolist():
                    keys[r] = xxhash.xxh3_128_digest(hashes[bounds[r]:bounds[r + 1]].tobytes())
                bands = np.zeros((len(n), BANDS), dtype=np.int64)
                if len(full):
                    bands[full] = bands_of(signatures(hashes, begins))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()), mask=pa.array(n == 0))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n.astype(np.int64)), pa.array(keys, pa.binary()), lists], ["doc_id", "h", "n_shingles", "key", "bands"])

    taken = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    kind = taken.schema["doc_id"].dataType.simpleString()
    return store(taken.mapInArrow(mark, f"doc_id {kind}, h long, n_shingles long, key binary, bands array<long>"))


def shingles_of(text: bytes | None, shingle: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """The distinct shingles of a text, as words."""
    words = (text or b"").lower().split()
    return set(zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else {tuple(words)} if words else set()


def confirmed(pairs: DataFrame, texts: DataFrame, similar: int) -> DataFrame:
    """The distinct `pairs` (a, b) of nodes whose sets' similarity is `similar` per cent at least; `texts` are (node, text)."""
    width = shuffle_width(pairs.sparkSession)
    large = pairs.groupBy("a").count().filter(F.col("count") > MEMBERS).select("a", F.ceil(F.col("count") / MEMBERS).cast("int").alias("parts"))
    dealt = pairs.join(large, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int"))
    members = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", F.lit(1).alias("kind"), "b", "text")
    hubs = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("b"), "text")
    streams = hubs.unionByName(members).repartition(width, "a", "part").sortWithinPartitions("a", "part", "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: set = set()
        for batch in batches:
            a, b = [], []
            kinds, words = batch.column(2).to_pylist(), batch.column(4).cast(pa.binary())
            for i, kind in enumerate(kinds):
                found = shingles_of(words[i].as_py())
                if kind == 0:
                    hub = found
                    continue
                small, large = sorted((len(hub), len(found)))
                # Sets of too different sizes can't be similar.
                if 100 * small < similar * large:
                    continue
                common = len(hub & found)
                if 100 * common >= similar * (small + large - common):
                    a.append(batch.column(0)[i].as_py())
                    b.append(batch.column(3)[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return streams.mapInArrow(compare, "a long, b long")


def grouped(classes: DataFrame, docs: DataFrame, doc_id: str, text: str, similar: int) -> DataFrame:
    """(node, root) for the classes that are linked with others. `classes` are stored (node, doc_id, h, bands)."""
    keyed = classes.select("node", F.explode("bands").alias("key"))
    # A hub is the node that is smallest after a turn of its bits, which is undone; a band's hash says which turn.
    turn = F.element_at(F.array(*[F.lit(t) for t in TURNS]), (F.pmod("key", F.lit(len(TURNS))) + 1).cast("int"))
    hubs = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("node").bitwiseXOR(turn)).alias("turned")).filter("n > 1")
    hubs = hubs.select("key", F.col("turned").bitwiseXOR(turn).alias("hub"))
    members = store(keyed.select("key", "node").join(hubs, "key"))
    involved = members.select("node").distinct().join(classes.select("node", "doc_id", "h"), "node")
    named = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_h"), F.col(text).alias("text"))
    texts = store(involved.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("node", "text").dropDuplicates(["node"]))

    first = store(members.filter("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    links = store(confirmed(first, texts, similar))
    rooted = members.select("key", "node").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = store(_mixed(rooted))
    left = apart.count()
    tokens = store(spelt(texts.join(apart.select("node").distinct(), "node", "left_semi")))
    # Most members of bands with several components can't be linked with another one at all.
    while left:
        before, apart = left, store(_mixed(apart.join(foreign(apart.select("node", "root").distinct(), tokens, similar), "node", "left_semi")))
        left = apart.count()
        if left > before * 0.9:
            break
    return components(store(links.unionByName(met(apart, texts, similar))))


def _mixed(rooted: DataFrame) -> DataFrame:
    """The rows (key, node, root) whose key has several roots."""
    keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    return rooted.select("key", "node", "root").join(keys, "key", "left_semi")


def spelt(texts: DataFrame) -> DataFrame:
    """(node, token): the hash of every distinct shingle of each text."""
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", 1 << 20):
                hashes, bounds = sets(rows.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(rows.column(0)), np.diff(bounds))), pa.array(hashes.view(np.int64))], ["node", "token"])

    return texts.select("node", "text").mapInArrow(spell, "node long, token long")


def foreign(nodes: DataFrame, tokens: DataFrame, similar: int) -> DataFrame:
    """The nodes (node, root) that may be linked with one of another root: those of whose shingles enough occur in other components.

    A set shares `similar` per cent of its own shingles at least with any set it is linked with, so none that is left out has such a link.
    """
    own = tokens.join(nodes, "node")
    shared = own.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).select("token", (F.col("low") != F.col("high")).alias("common"))
    return own.select("node", "token").join(shared, "token").groupBy("node").agg(
        F.count("*").alias("n"), F.count_if("common").alias("common")).filter(F.col("common") * 100 >= F.col("n") * similar).select("node")


def met(apart: DataFrame, texts: DataFrame, similar: int) -> DataFrame:
    """Links (a, b) that join the components in `apart` (key, node, root) as all pairs of nodes that share a key do.

    Nodes that keys connect are dealt to slices of a bounded number of rows and bytes, and each two slices meet in a task. There the numbers of common shingles are
    counted by an index of them, a node at a time against all others, and pairs that are similar enough to join two components are confirmed on their words.
    """
    stars = apart.join(apart.groupBy("key").agg(F.min("node").alias("hub")), "key").filter("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    groups = components(stars).withColumnRenamed("root", "part")
    rows = store(apart.select("node", "root").distinct().join(groups, "node").join(texts, "node"))
    size = rows.groupBy("part").agg(F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum(F.octet_length("text").cast("long")) / CELL_BYTES)).cast("int").alias("slices"))
    dealt = rows.join(size, "part").withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cells = dealt.select("part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "root", "text")

    def meet(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        nodes, roots, own = (cell[c].to_numpy() for c in ("node", "root", "own"))
        words = cell["text"].chunk(0)
        hashes, bounds = sets(words)
        _, token, count = np.unique(hashes, return_inverse=True, return_counts=True)
        n, owner = np.diff(bounds), rows_of(bounds)
        order = np.argsort(token, kind="stable")
        holders, begin = owner[order], np.concatenate(([0], np.cumsum(count)))
        joined = {r: r for r in np.unique(roots).tolist()}

        def top(r: int) -> int:
            while joined[r] != r:
                joined[r] = r = joined[joined[r]]
            return r

        a, b = [], []
        apart_ = own[:, None] != own[None] if own.min() != own.max() else None
        for i in range(len(nodes)):
            mine = token[bounds[i]:bounds[i + 1]]
            mine = mine[count[mine] > 1]
            if not len(mine):
                continue
            common = np.bincount(np.concatenate([holders[begin[t]:begin[t + 1]] for t in mine.tolist()]), minlength=len(nodes))
            good = (100 * common >= similar * (n + n[i] - common)) & (roots != roots[i]) & (np.arange(len(nodes)) > i)
            for j in np.flatnonzero(good if apart_ is None else good & apart_[i]).tolist():
                x, y = top(int(roots[i])), top(int(roots[j]))
                if x != y:
                    one, two = (shingles_of(words[k].as_buffer().to_pybytes()) for k in (i, j))
                    if 100 * len(one & two) >= similar * len(one | two):
                        joined[x] = y
                        a.append(int(nodes[i]))
                        b.append(int(nodes[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("part", "low", "high").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: size of its set, the smallest id reachable over links, and whether that is its own.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a set is the distinct runs of five words, or with fewer words the whole sequence.
    Rows without words, null or empty, have an empty set and are linked with nothing, not even each other. Repeated rows and equal sets are one class. Rows that share an
    id but not a set are judged each. A null id joins components like others but names none: of a component without another id the component_id is null, and a null id is never kept. Texts of
    any length are read whole. Further columns are left out. An empty table gives no rows.
    """
    rows = marked(docs, doc_id, text)
    sets_ = rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "h")).alias("one"), F.first("bands").alias("bands"))
    classes = store(sets_.withColumn("node", F.monotonically_increasing_id()))
    label = grouped(classes.select("node", "one.doc_id", "one.h", "bands"), docs, doc_id, text, similar)
    rooted = classes.select("key", "first", "node").join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("key", "component_id")
    linked = rows.filter("key IS NOT NULL").select("doc_id", "n_shingles", "key").join(named, "key").select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
