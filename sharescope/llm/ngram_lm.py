"""Language-model scores by deleted interpolation of n-gram counts of the whole training corpus.

A token's probability mixes its maximum-likelihood estimates after the token before it, by itself, and over
all known tokens and one more. The mixture depends on how often the context was seen: contexts are put into buckets by
powers of two of their frequency, and each bucket's three weights are learned by expectation-maximisation on tokens of held-out
training documents, with those documents' own counts deleted from the estimates.

Counts come as packed answers (see `units`): every unit asks once for each distinct token and pair of tokens it holds,
sending along its own counts of them, and gets the corpus's. Tokens are told apart by 64 bits, pairs by 48. What
expectation-maximisation needs is a histogram of a fixed size: of a token only the context's bucket and the ratios of its
three estimates matter, which are kept to a quarter of a natural logarithm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store
from .units import ask, bucket_count, buckets_of, by_bucket, expand, expand_sorted, one_by_one, pack_units, squeeze, squeeze_sorted, unpack
from .words import U64, mix, pair, split_words, word_hashes

FOLDS, HELD_OUT, TUNE = 7, 2, 8
TOKEN_BITS, PAIR_BITS = 64, 48
BUCKETS, STEP, BINS = 18, 0.25, 128
ROUNDS = 60
START, END = mix(np.array([1, 2], dtype=U64))


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0))


class Tokens:
    """The tokens of one unit, with the numbers of their distinct keys."""

    def __init__(self, rows: pa.RecordBatch):
        words, bounds = split_words(rows.column(rows.schema.get_field_index("text")))
        hashes = word_hashes(pc.ascii_lower(words))
        self.token = np.insert(hashes, bounds[1:], END)
        self.bounds = bounds + np.arange(len(bounds))
        before = np.concatenate(([START], self.token[:-1])) if len(self.token) else self.token
        before[self.bounds[:-1]] = START
        self.tokens, self.token_at = np.unique(self.token, return_inverse=True)
        self.pairs, self.pair_at = np.unique(pair(before, self.token) >> U64(64 - PAIR_BITS), return_inverse=True)
        # A context is counted as often as it is a token; the start of documents as often as their end.
        self.context_at = np.concatenate(([0], self.token_at[:-1])) if len(self.token) else self.token_at
        self.context_at[self.bounds[:-1]] = np.searchsorted(self.tokens, END)
        crc = [zlib.crc32(str(i).encode()) if i is not None else 0 for i in rows.column(rows.schema.get_field_index("doc_id")).to_pylist()]
        self.held_out = np.array([c % FOLDS == HELD_OUT for c in crc], dtype=bool)
        self.learned = np.repeat(~self.held_out, np.diff(self.bounds))

    def kinds(self, buckets: int):
        """Keys, bits, places and first bucket of tokens, then of pairs."""
        return (self.tokens, TOKEN_BITS, self.token_at, 0), (self.pairs, PAIR_BITS, self.pair_at, buckets)

    def counts(self, answers: list[dict] | None, buckets: int) -> list[np.ndarray]:
        """Training and tuning counts of each token's token, its pair and its context."""
        known, found = by_bucket(answers), []
        for keys, bits, _, first in self.kinds(buckets):
            edges = buckets_of(keys, bits, buckets)
            both = np.zeros((2, len(keys)))
            for b in np.flatnonzero(np.diff(edges)):
                both[:, edges[b]:edges[b + 1]] = expand(known[first + b][16:])
            found.append(both)
        return [found[0][:, self.token_at], found[1][:, self.pair_at], found[0][:, self.context_at]]


def ask_counts(rows: pa.RecordBatch, columns: dict, buckets: int) -> Iterator[tuple[int, bytes]]:
    tokens = Tokens(rows)
    for keys, bits, places, first in tokens.kinds(buckets):
        trained = np.bincount(places[tokens.learned], minlength=len(keys)).astype(np.uint32)
        tuned = trained if columns["unit"] & 1 else np.zeros(len(keys), np.uint32)
        edges = buckets_of(keys, bits, buckets)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[b], edges[b + 1])
            yield first + b, squeeze_sorted(keys[part], trained[part], tuned[part])


def answer_counts(loads: list[bytes]) -> list[bytes]:
    """Every unit's keys with the counts of all units; first, in 16 bytes, how many keys are trained and how often."""
    found = [expand_sorted(x) for x in loads]
    keys, inverse = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    totals = [np.bincount(inverse, weights=np.concatenate([f[i] for f in found]), minlength=len(keys)).astype(np.uint64) for i in (1, 2)]
    head = np.array([(totals[0] > 0).sum(), totals[0].sum()], dtype=np.int64).tobytes()
    ends = np.cumsum([0, *(len(f[0]) for f in found)])
    return [head + squeeze(*(t[inverse[a:b]] for t in totals)) for a, b in zip(ends[:-1], ends[1:])]


def totals(answers: DataFrame, buckets: int) -> tuple[int, int]:
    """Distinct and all training tokens, from what each bucket of tokens says of itself."""
    said = answers.select(F.explode("answers").alias("a")).filter(F.col("a.bucket") < buckets).select("a.bucket", F.hex(F.substring("a.load", 1, 16)).alias("h")).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [np.frombuffer(bytes.fromhex(h), np.int64) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"v": pa.array([p[0] for p in pairs], pa.int64()), "n": pa.array([p[1] for p in pairs], pa.int64())})

    row = said.mapInArrow(read, "v long, n long").agg(F.sum("v"), F.sum("n")).first()
    return int(row[0] or 0), int(row[1] or 0)


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, and else by powers of two."""
    return np.where(count > 0, np.minimum(1 + np.log2(np.maximum(count, 1)).astype(np.int64), BUCKETS - 1), 0)


def estimates(token: np.ndarray, couple: np.ndarray, context: np.ndarray, n: int, v: int) -> list[np.ndarray]:
    """Of each token, maximum likelihood in its context and alone, and evenly over known tokens and one more."""
    return [couple / np.maximum(context, 1), token / max(n, 1), np.full(len(token), 1 / (v + 1))]


def learn(joined: DataFrame, buckets: int, v: int, n: int) -> np.ndarray:
    """Weights by context bucket, from the units that hold tuning documents."""
    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                tokens = Tokens(unpack(row["data"]))
                kept = [a - b for a, b in tokens.counts(row["answers"], buckets)]
                two, one, flat = estimates(*kept, n, v)
                code = context_bucket(kept[2])
                for p in (two, one):
                    level = np.clip(np.round(np.log(np.maximum(p, 1e-300) / flat) / STEP) + BINS // 4, 1, BINS - 1)
                    code = code * BINS + np.where(p > 0, level, 0).astype(np.int64)
                codes, times = np.unique(code[tokens.learned], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(times)], ["code", "times"])

    rows = joined.mapInArrow(bins, "code long, times long").groupBy("code").agg(F.sum("times").alias("times")).toPandas()
    code, times = rows["code"].to_numpy(np.int64), rows["times"].to_numpy(np.float64)
    level = np.stack([code // BINS % BINS, code % BINS, np.full(len(code), BINS // 4)])
    ratio = np.where(level > 0, np.exp((level - BINS // 4) * STEP), 0.0)
    bucket = code // BINS ** 2
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = [0, 0.5, 0.5]
    for _ in range(ROUNDS):
        share = weights[bucket] * ratio.T
        share *= (times / share.sum(axis=1))[:, None]
        # A little of each keeps a bucket that no tuning document shows from ruling anything out.
        total = np.stack([np.bincount(bucket, weights=share[:, i], minlength=BUCKETS) for i in range(3)], axis=1) + 0.1 * np.where(weights > 0, 1, 0)
        weights = total / total.sum(axis=1, keepdims=True)
    return weights


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Documents are trained on unless their id's checksum leaves `HELD_OUT` modulo `FOLDS`; one in `TUNE` of those tunes the
    weights. A null or empty text is one token, its end. A null id is trained on. Repeated rows count and are scored each.
    Without any training document both scores are those of the even distribution.
    """
    docs = docs.select("doc_id", "text")
    checksum = fold(F.col("doc_id"))
    tuning = (checksum % FOLDS != HELD_OUT) & (F.floor(checksum / FOLDS) % TUNE == 0)
    # Odd units hold tuning documents only, so that learning reads nothing else.
    units = None
    for odd, part in ((0, docs.filter(~tuning)), (1, docs.filter(tuning))):
        some = pack_units(part, "text").withColumn("unit", F.col("unit") * 2 + odd)
        units = some if units is None else units.unionByName(some)
    answers = store(ask(units, ask_counts, answer_counts))
    buckets = bucket_count(docs.sparkSession)
    v, n = totals(answers, buckets)
    tuned = units.filter("unit % 2 = 1").join(answers.filter("unit % 2 = 1").hint("merge"), "unit", "left")
    weights = learn(tuned, buckets, v, n)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                rows = unpack(row["data"])
                tokens = Tokens(rows)
                counts = [c[0] for c in tokens.counts(row["answers"], buckets)]
                parts = np.stack(estimates(*counts, n, v), axis=1)
                mixed = (weights[context_bucket(counts[2])] * parts).sum(axis=1) if n else parts[:, 2]
                starts = tokens.bounds[:-1]
                sums = [np.add.reduceat(x, starts) for x in ((counts[0] > 0).astype(np.int64), np.log10((counts[0] + 1) / (n + v + 1)), np.log10(mixed))]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(tokens.held_out), pa.array(np.diff(tokens.bounds), pa.int64()), pa.array(sums[0].astype(np.int64)),
                     pa.array(np.full(len(starts), n), pa.int64()), pa.array(sums[1]), pa.array(sums[2])],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return units.join(answers.hint("merge"), "unit", "left").mapInArrow(judge, shape)
