"""SimHash near-duplicates through Golay-code fuzzy hashing.

A fingerprint is cut into three segments of 22, 21 and 21 bits. A Golay code maps a segment to the index of the one codeword near it, and
two segments one bit apart share an index if one of them also offers the indices of all words one bit away (one or six
in all). Of two fingerprints within three bits, by the pigeonhole principle either

* some segment is equal, and one of the other two differs in at most one bit: six kinds of key, an equal segment with
  an index, or
* every segment differs in exactly one bit: one kind of key, three indices, of which one side spells out the first
  segment's and the other side the other two's.

So each distinct fingerprint gives some 70 keys, and whatever its neighbours, no link is missed. Keys are joined by
sorting, candidates verified by their bits. Equal fingerprints are one entry. A key's members are never expanded into
pairs that leave the task: what leaves is each member with the smallest one of its part, at most a row for every member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import given_back, long_field, quoted, set_aside, shuffle_width, slices, store, without
from .components import components
from .golay import decode, nearby
from .words import split_words

DISTANCE, SHINGLE, SEED = 3, 3, 42
SEGMENTS = [(0, 22), (22, 21), (43, 21)]
LANES, MOST = 0x0001000100010001, 60_000
PAIRS = 1 << 21


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For every row of hashes, the bits set in over half of them; 0 for a row without."""
    out = np.zeros(len(bounds) - 1, dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    # Four counters of 16 bits are summed at a time, over parts too short to overflow one.
    parts = np.union1d(bounds[full], np.arange(0, len(hashes), MOST))
    first = np.searchsorted(parts, bounds[full])
    half = np.diff(bounds)[full]
    for k in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(LANES), parts)
        for lane in range(4):
            counts = np.add.reduceat(((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64), first)
            out[full] |= (counts * 2 > half).astype(np.uint64) << np.uint64(16 * lane + k)
    return out


def simhashes(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of every text."""
    words, bounds = split_words(texts)
    words = pc.ascii_lower(words)
    lengths = np.asarray(pc.binary_length(words), dtype=np.int64)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words)
    joined = pc.binary_join(whole, pa.scalar(" ", words.type))[0].as_py().encode()
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    begins = np.concatenate(([0], np.cumsum(count)))
    first = np.repeat(bounds[:-1], count) + np.arange(begins[-1]) - np.repeat(begins[:-1], count)
    last = np.minimum(first + shingle - 1, np.repeat(bounds[1:], count) - 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist())), np.uint64, len(first))
    return majority(hashes, begins)


def fingerprinted(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with the fingerprint as a signed long. A text without words, null or empty, has 0."""
    docs = without(docs, ["fingerprint"])
    names = docs.columns
    kept = [names.index(c) for c in (names if keep is None else keep)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, text, 4 << 20):
                found = simhashes(rows.column(names.index(text)))
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in kept), pa.array(found.view(np.int64), pa.int64())], [*(names[i] for i in kept), "fingerprint"])

    return docs.mapInArrow(mark, T.StructType([*(docs.schema.fields[i] for i in kept), long_field("fingerprint")]))


def keys(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(key, number of the fingerprint, is it a probe) for the seven kinds of key."""
    number = np.arange(len(prints))
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    index = [decode(p) for p in parts]
    around = [nearby(p, bits) for p, (_, bits) in zip(parts, SEGMENTS)]
    kind = 0
    for same in range(3):
        for near in range(3):
            if near != same:
                head = (kind << 22 | parts[same]) << 12
                yield head | index[near], number, False
                yield np.repeat(head, around[near][1]) | around[near][0], np.repeat(number, around[near][1]), True
                kind += 1
    head = kind << 36
    found, count = around[0]
    yield head | found << 24 | np.repeat(index[1] << 12 | index[2], count), np.repeat(number, count), False
    found, count = around[1]
    stem, owner = np.repeat(index[0], count) << 24 | found << 12, np.repeat(number, count)
    found, count = around[2]
    begins = np.concatenate(([0], np.cumsum(count)))[:-1]
    each = count[owner]
    ends = np.cumsum(each)
    inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - each, each)
    yield head | np.repeat(stem, each) | found[np.repeat(begins[owner], each) + inner], np.repeat(owner, each), True


def parts_of(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of `nodes` that each is connected to, by links between places in it."""
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def linked(left: np.ndarray, right: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(left ^ right) <= distance


def spread(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within `distance` in one large group, each member found once from another.

    A member that is reached is compared only with members nobody has reached yet, so a dense group is left after a few
    comparisons each and memory stays in proportion to the group.
    """
    left, a, b = np.arange(len(prints)), [], []
    while len(left):
        queue, left = left[:1], left[1:]
        while len(queue) and len(left):
            some, queue = queue[:256], queue[256:]
            reached = np.full(len(left), -1)
            for node in some:
                hit = linked(prints[left], prints[node], distance) & (reached < 0)
                reached[hit] = node
            hit = reached >= 0
            a.append(reached[hit])
            b.append(left[hit])
            queue, left = np.concatenate([queue, left[hit]]), left[~hit]
    return np.concatenate([*a, np.empty(0, np.int64)]), np.concatenate([*b, np.empty(0, np.int64)])


def run_links(key: np.ndarray, prints: np.ndarray, probe: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (a, b) of whole runs of equal keys: every member with the smallest of its part."""
    order = np.lexsort((probe, key))
    key, prints, probe = key[order], prints[order], probe[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((starts, [len(key)])))
    own = np.add.reduceat((~probe).astype(np.int64), starts)
    cost = own * (size - own)
    nodes, place = np.unique(prints, return_inverse=True)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for run in np.flatnonzero(cost > PAIRS).tolist():
        members = np.unique(place[starts[run]:starts[run] + size[run]])
        x, y = spread(nodes[members], distance)
        a.append(members[x])
        b.append(members[y])
    runs = np.flatnonzero((cost > 0) & (cost <= PAIRS))
    for some in np.split(runs, np.searchsorted(np.cumsum(cost[runs]), np.arange(PAIRS, cost[runs].sum(), PAIRS))) if len(runs) else []:
        each = np.repeat(some, size[some] - own[some])
        probes = np.repeat(starts[some] + own[some], size[some] - own[some]) + _counting(size[some] - own[some])
        first = np.repeat(probes, own[each])
        second = np.repeat(starts[each], own[each]) + _counting(own[each])
        good = linked(prints[first], prints[second], distance) & (place[first] != place[second])
        a.append(place[first[good]])
        b.append(place[second[good]])
    a, b = np.concatenate(a), np.concatenate(b)
    label = parts_of(nodes, a, b)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _counting(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for every count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def near_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints of `prints` exactly as all pairs within `distance` bits do."""
    if not 0 <= distance <= 3:
        raise ValueError("the keys cover up to three differing bits")

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = np.asarray(batch.column(0).slice(at, 4096))
                for key, number, probe in keys(some.view(np.uint64)):
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(some[number], pa.int64()), pa.array(np.full(len(key), probe))], ["key", "fingerprint", "probe"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                rows = [np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64), np.asarray(batch.column(2).cast(pa.int8())).astype(bool)]
                held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
                # The last key may go on in the next batch.
                ready = int(np.searchsorted(held[0], held[0][-1]))
                if ready < 1 << 18:
                    continue
            else:
                ready = len(held[0]) if held is not None else 0
            if ready:
                a, b = run_links(*(x[:ready] for x in held), distance)
                held = [x[ready:] for x in held]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    offered = prints.select("fingerprint").mapInArrow(offer, "key long, fingerprint long, probe boolean")
    dealt = offered.repartition(2 * shuffle_width(prints.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(link, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


def named(marked: DataFrame, doc_id: str, distance: int = DISTANCE) -> DataFrame:
    """(fingerprint, root, component_id) for each distinct fingerprint of stored rows; `root` tells components apart."""
    distinct = store(marked.groupBy("fingerprint").agg(F.min(doc_id).alias("_first")))
    parts = components(near_links(distinct, distance))
    rooted = distinct.join(parts.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    return store(rooted.join(smallest, "root").select("fingerprint", "root", "component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, distance: int = DISTANCE) -> DataFrame:
    """`docs` (or its columns `keep`) with fingerprint (long) and component_id, the smallest id reachable over links.

    All texts without words share fingerprint 0. Repeated rows share a fingerprint. Null ids join components like
    others, but name one only if no id is there: then component_id is null.
    """
    marked = store(fingerprinted(without(docs, ["component_id"]), text, keep))
    return marked.join(named(marked, doc_id, distance).drop("root"), "fingerprint")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """The row with the smallest id of every component; of repeated rows one stays, and ids come before nulls.

    Columns of any name keep their values.
    """
    docs, called = set_aside(docs, ["fingerprint", "_row", "_id", "root", "component_id"])
    text, doc_id = called[text], called[doc_id]
    marked = store(fingerprinted(docs.withColumn("_row", F.monotonically_increasing_id()), text))
    rows = marked.select("fingerprint", F.col(doc_id).alias("_id"), "_row").join(named(marked, doc_id, distance), "fingerprint")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("m")).select(F.col("m._row").alias("_row"))
    return given_back(marked.join(first, "_row", "left_semi").select(*[quoted(c) for c in docs.columns]), called)


def simhash_digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hexadecimal digits, component_id."""
    found = near_duplicates(docs.select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
