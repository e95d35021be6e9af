"""URL filter: a blocked Bloom filter lets possible hits through to an exact hash join with the listed URLs.

A listed URL is a canonical host and path. It fits a URL of its host or any subdomain whose path begins with the listed
path, so what a URL may hit are its host's suffixes with its path's prefixes. The filter is one array of a fixed
size, whatever the list: each key sets one bit in each of the eight words of one block, so that a probe touches one cache line.
A second array of fixed size says which lengths listed paths have. With a longer list more keys pass; the join removes what
is not listed, and of the rest the longest wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import given_back, set_aside, store, without

BLOCKS, WORDS = 1 << 12, 8
LENGTHS = 1 << 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first `://`, A-Z lower-cased, and the path after it; both empty without `://` or for a null."""
    begin = F.instr(url, "://")
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _bits(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block of every hash, and its bit in each word of the block."""
    mixed = hashed * np.uint64(0x9E3779B97F4A7C15)
    return (hashed >> np.uint64(52)).astype(np.int64), (mixed[:, None] >> (np.arange(WORDS, dtype=np.uint64) * np.uint64(6))) & np.uint64(63)


def bloom(listed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The filter of all `key`s and the lengths of all `path`s, built per task and combined word by word."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lengths = np.zeros(BLOCKS * WORDS, np.uint64), np.zeros(LENGTHS, np.uint64)
        for batch in batches:
            if batch.num_rows:
                block, bit = _bits(np.asarray(batch.column(0)).view(np.uint64))
                np.bitwise_or.at(words, (block[:, None] * WORDS + np.arange(WORDS)).ravel(), (np.uint64(1) << bit).ravel())
                lengths[np.minimum(np.asarray(batch.column(1)), LENGTHS - 1)] = 1
        both = np.concatenate([words, lengths])
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(both[at].view(np.int64), pa.int64())], ["at", "bits"])

    rows = (listed.select(F.xxhash64("key"), F.length("path").cast("int")).mapInArrow(fill, "at int, bits long")
            .groupBy("at").agg(F.bit_or("bits").alias("bits")).collect())
    both = np.zeros(BLOCKS * WORDS + LENGTHS, np.uint64)
    for row in rows:
        both[row["at"]] = np.uint64(row["bits"] & 0xFFFFFFFFFFFFFFFF)
    return both[:BLOCKS * WORDS].reshape(BLOCKS, WORDS), both[BLOCKS * WORDS:] > 0


def suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def possible_hits(urls: DataFrame, words: np.ndarray, lengths: np.ndarray) -> DataFrame:
    """(url, key): keys of each URL that pass the filter."""
    short, longer = np.flatnonzero(lengths[:-1]).tolist(), bool(lengths[-1])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows, keys = [], []
                for row, (host, path) in enumerate(zip(batch.column(1).slice(at, 4096).to_pylist(), batch.column(2).slice(at, 4096).to_pylist())):
                    ends = [n for n in short if n <= len(path)] + (list(range(LENGTHS - 1, len(path) + 1)) if longer else [])
                    found = [s + path[:n] for s in suffixes(host) for n in ends]
                    keys += found
                    rows += [row] * len(found)
                if not keys:
                    continue
                hashed = np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys))
                block, bit = _bits(hashed)
                passed = np.flatnonzero(((words[block] >> bit) & np.uint64(1)).all(axis=1))
                taken = batch.column(0).slice(at, 4096).take(pa.array([rows[i] for i in passed], pa.int64()))
                yield pa.RecordBatch.from_arrays([taken, pa.array([keys[i] for i in passed], pa.string())], ["url", "key"])

    return urls.select("url", *[c.alias(n) for c, n in zip(host_and_path(F.col("url")), ("host", "path"))]).mapInArrow(probe, "url string, key string")


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule (null if none fits) and verdict.

    `listed` has host, path and verdict. The longest rule, host and path together, wins; of equally long ones the last in
    order of text. A null URL or one without `://` has empty host and path, and fits no rule of a host. An unlisted URL
    gets `default`. Repeated URLs are judged once, repeated rules count once (the last verdict in order of text holds).
    Columns of `pages` named like a result are replaced.
    """
    pages, called = set_aside(without(pages, [c for c in ("host", "path", "rule", "verdict") if c != url]), ["host", "path", "rule", "verdict", "_url"])
    url, replaced = called[url], url.lower() in ("host", "path", "rule", "verdict")
    listed = listed.dropna().groupBy(F.concat("host", "path").alias("key"), "path").agg(F.max("verdict").alias("verdict"))
    listed = store(listed)
    words, lengths = bloom(listed)
    urls = pages.select(F.col(url).alias("url")).filter("url IS NOT NULL").distinct()
    hits = possible_hits(urls, words, lengths).join(listed.select("key", "verdict"), "key")
    best = hits.groupBy("url").agg(F.max(F.struct(F.length("key").alias("n"), "key", "verdict")).alias("best"))
    best = best.select(F.col("url").alias("_url"), F.col("best.key").alias("rule"), F.col("best.verdict").alias("verdict"))
    host, path = host_and_path(F.col(url))
    judged = (pages.withColumns({"host": host, "path": path}).join(best, F.col(url) == F.col("_url"), "left").drop("_url")
              .withColumn("verdict", F.coalesce("verdict", F.lit(default))))
    return given_back(judged.drop(url) if replaced else judged, called)
