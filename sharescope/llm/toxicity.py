"""Toxicity: a support vector machine over gapped subsequences, through Nyström landmarks.

Strings are the words of sentences. The kernel of two words counts the three-letter subsequences they share, letters
up to `SPAN` apart, each weighted by `DECAY` for every letter it skips, and divides by what words of their lengths have; a word with
letters inserted or left out keeps most of its subsequences. Word ends are letters of their own.

A document's label belongs to its sentences, of which only some carry the insult. So a sentence is judged by its most
toxic word and a document by its most toxic sentence: all words of clean documents are clean, and of a toxic document
one witness is learned, chosen again by the machine of the round before. Witnesses and clean words are mapped to `LANDMARKS`
dimensions (Nyström: kernel with the landmarks, whitened), where a linear machine is fitted. Because
kernel values are inner products over subsequences, the fitted machine folds into one weight for each subsequence, so that scoring
costs a few lookups a word, without touching landmarks.

Learning takes a bounded sample: up to `SAMPLE` labelled documents of each class, of at most `SAMPLE_BYTES` each.
Scoring covers every whole text, where it is read, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, without
from .words import split_words

SPAN, DECAY, WIDEST = 6, 0.6, 30
LANDMARKS, SAMPLE, SAMPLE_BYTES = 256, 1500, 20_000
THRESHOLD, FOLDS, HELD_OUT = 0.7, 3, 1
LETTERS = 64
GAPS = [(a, b, DECAY ** (a + b - 2)) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…–—“”‘’«»¡¿"


def letter_codes() -> np.ndarray:
    """A code below `LETTERS` for each of the first 65,536 characters; 0 is none, 1 a word's end."""
    codes = 2 + np.arange(1 << 16) % (LETTERS - 2)
    codes[ord("a"):ord("z") + 1] = np.arange(2, 28)
    codes[0] = 0
    return codes


_CODES = letter_codes()


def spelled(words: list[str]) -> np.ndarray:
    """Words as rows of letter codes between end marks, padded with 0."""
    wide = max(map(len, words), default=0)
    raw = np.array(words, dtype=f"<U{max(1, wide)}").view(np.uint32).reshape(len(words), -1)
    rows = np.zeros((len(words), raw.shape[1] + 2), dtype=np.int32)
    rows[:, 1:-1] = _CODES[np.minimum(raw, (1 << 16) - 1)]
    length = (rows != 0).sum(axis=1)
    rows[:, 0] = 1
    rows[np.arange(len(words)), length + 1] = 1
    return rows


def subsequences(rows: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Number and weight of the three-letter subsequences of each word, one gap pattern at a time; 0 is none."""
    for a, b, weight in GAPS:
        n = rows.shape[1] - a - b
        if n > 0:
            x, y, z = rows[:, :n], rows[:, a:a + n], rows[:, a + b:a + b + n]
            yield np.where(z > 0, (x * LETTERS + y) * LETTERS + z, 0), weight


def sizes(rows: np.ndarray) -> np.ndarray:
    """The length by which a word's kernel values are divided: that of a word of as many different letters."""
    letters = (rows > 0).sum(axis=1)
    return np.sqrt(np.maximum(sum(w * w * np.maximum(letters - a - b, 0) for a, b, w in GAPS), 1e-9))


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of words with landmarks, over the subsequences that landmarks have."""
    own, table = landmark_table(landmarks)
    out = np.empty((len(words), len(landmarks)), dtype=np.float32)
    for at in range(0, len(words), 256):
        part = words[at:at + 256]
        out[at:at + 256] = counted(part, own) @ table
    return out


def counted(words: list[str], own: np.ndarray) -> np.ndarray:
    """Weights of the subsequences `own`, ascending, in each word."""
    rows, out = spelled(words), np.zeros(len(words) * (len(own) + 1), dtype=np.float64)
    for ids, weight in subsequences(rows):
        place = np.minimum(np.searchsorted(own, ids), len(own) - 1)
        place = np.where(own[place] == ids, place, len(own)) + np.arange(len(words))[:, None] * (len(own) + 1)
        out += np.bincount(place.ravel(), minlength=len(out)) * weight
    return (out.reshape(len(words), -1)[:, :-1] / sizes(rows)[:, None]).astype(np.float32)


def landmark_table(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All subsequences of the landmarks, ascending, and each landmark's weights for them in a column."""
    own = np.unique(np.concatenate([ids.ravel() for ids, _ in subsequences(spelled(landmarks))]))
    own = own[own > 0]
    return own, counted(landmarks, own).T


@dataclass(frozen=True)
class Machine:
    weights: np.ndarray
    bias: float
    slope: float
    middle: float

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words), dtype=np.float64)
        order = np.argsort([len(w) for w in words], kind="stable")
        for part in np.array_split(order, max(1, len(words) // 4096)):
            if len(part):
                rows = spelled([words[i] for i in part])
                total = sum((self.weights[ids].sum(axis=1) * weight for ids, weight in subsequences(rows)), np.zeros(len(part)))
                out[part] = total / sizes(rows) + self.bias
        return out

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margins - self.middle), -30, 30)))


def document_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words to judge, their codes for all rows one after the other, and the bounds of the rows.

    Words are lower-cased and stripped of marks; a word with marks inside is also read without them, letters that
    stand alone in a row are also read together, and words over `WIDEST` letters are read in overlapping parts.
    """
    words, bounds = split_words(texts)
    plain = pc.utf8_lower(pc.utf8_trim(words, characters=_MARKS))
    coded = plain.dictionary_encode()
    codes, distinct = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
    known = {w: i for i, w in enumerate(distinct)}
    more: list[tuple[int, int]] = []

    def also(place: int, word: str) -> None:
        code = known.setdefault(word, len(distinct))
        if code == len(distinct):
            distinct.append(word)
        more.append((place, code))

    lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
    unusual = np.array([n > WIDEST or (n > 2 and not w.isalpha()) for w, n in zip(distinct, lengths)], dtype=bool)
    if len(codes):
        for place in np.flatnonzero(unusual[codes]).tolist():
            word = distinct[codes[place]]
            bare = "".join(filter(str.isalpha, word))
            if 2 < len(bare) <= WIDEST:
                also(place, bare)
            for at in range(0, len(word) if len(word) > WIDEST else 0, WIDEST // 2):
                also(place, word[at:at + WIDEST])
        single = lengths[codes] == 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], single.astype(np.int8), [0]))))
        row_of = np.searchsorted(bounds, np.arange(len(codes)), side="right")
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a > 2:
                for start in np.concatenate(([a], a + 1 + np.flatnonzero(np.diff(row_of[a:b])))).tolist():
                    end = min(b, int(bounds[row_of[start]]))
                    joined = "".join(distinct[c] for c in codes[start:end])
                    for at in range(0, len(joined) if len(joined) > 2 else 0, WIDEST // 2):
                        also(start, joined[at:at + WIDEST])
    if more:
        place, code = np.array(more, dtype=np.int64).T
        codes = np.insert(codes, place, code)
        bounds = bounds + np.searchsorted(np.sort(place), bounds)
    return [w[:WIDEST] for w in distinct], codes, bounds


def best(values: np.ndarray, bounds: np.ndarray, none: float) -> np.ndarray:
    """The largest value of each row."""
    out = np.full(len(bounds) - 1, float(none))
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.maximum.reduceat(values, bounds[full])
    return out


def linear_machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by Newton steps on the points within the margin; cost is each point's weight."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        part, weight = x[inside], cost[inside]
        step = np.linalg.solve(np.eye(len(w)) * 1.0 + (part.T * weight) @ part, (part.T * weight) @ y[inside])
        if np.allclose(step, w, atol=1e-6):
            break
        w = step
    return w[:-1], float(w[-1])


def covering(row: np.ndarray, code: np.ndarray, in_clean: np.ndarray, rows: int) -> np.ndarray:
    """Words that explain the toxic documents, given as pairs of row and word, the most telling first.

    A document counts for half as much with every word that explains it already, and a clean document with the word
    counts ten times against it. So insults that come together are all found, while a chance word that copies of one
    toxic document share yields to the insults in it. Rarer words are then taken for documents that nothing explains
    yet: those that explain three at least, and one in 200.
    """
    share, found, toxic = np.ones(rows), [], len(np.unique(row))
    for least in (0.03 * toxic, max(3, 0.005 * toxic)):
        while True:
            gain = np.bincount(code, weights=share[row], minlength=len(in_clean)) - 10 * in_clean
            gain[found] = 0
            word = int(np.argmax(gain))
            if gain[word] < (least if found else 1):
                break
            found.append(word)
            share[row[code == word]] /= 2
        share[share < 1] = 0
    return np.array(found, dtype=np.int64)


def fit(texts: list[str], toxic: np.ndarray, seed: int = 7) -> Machine:
    """A machine from labelled texts. Without examples of both classes, one that gives every text 0."""
    words, codes, bounds = document_words(pa.array(texts, pa.string()))
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    if not len(codes) or toxic.all() or not toxic.any():
        return Machine(np.zeros(LETTERS ** 3), -1.0, 60.0, 0.0)
    seen = np.unique(row * len(words) + codes)
    row, code = seen // len(words), seen % len(words)
    in_clean = np.bincount(code, weights=~toxic[row], minlength=len(words))
    first = covering(row[toxic[row]], code[toxic[row]], in_clean, len(texts))
    clean = np.flatnonzero(in_clean > 0)
    begins = np.searchsorted(row, np.arange(len(texts) + 1))
    if not len(first):
        return Machine(np.zeros(LETTERS ** 3), -1.0, 60.0, 0.0)
    rng = np.random.default_rng(seed)
    hard, value, machine = rng.choice(clean, min(3000, len(clean)), replace=False), None, None
    for _ in range(4):
        witness = first
        if value is not None:
            top = best(value[code], begins, -np.inf)
            witness = np.union1d(first, code[(value[code] >= top[row]) & (value[code] > 0.5) & toxic[row] & (in_clean[code] == 0)])
        negative = np.setdiff1d(hard, witness)
        marks = np.concatenate([first[:LANDMARKS // 2], rng.permutation(negative)])[:LANDMARKS]
        landmarks = [words[i] for i in marks]
        values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
        good = values > 1e-6 * values[-1]
        white = vectors[:, good] / np.sqrt(values[good])
        used = np.concatenate([witness, negative])
        mapped = kernel([words[i] for i in used], landmarks).astype(np.float64) @ white
        y = np.concatenate([np.ones(len(witness)), -np.ones(len(negative))])
        cost = np.concatenate([np.full(len(witness), max(1.0, len(negative) / 20 / len(witness))), np.ones(len(negative))]) * 10
        w, bias = linear_machine(mapped, y, cost)
        own, table = landmark_table(landmarks)
        weights = np.zeros(LETTERS ** 3)
        weights[own] = table @ (white @ w)
        machine = Machine(weights, bias, 1.0, 0.0)
        value = machine.margins(words)
        worst = clean[np.argsort(-value[clean])[:3000]]
        hard = np.union1d(hard, worst)
    top = best(value[code], begins, -2.0)
    # A third of the way from clean documents to explained toxic ones is 0.5; labels no word explains don't move it.
    explained = best(np.isin(code, first).astype(float), begins, 0) > 0
    high, low = np.quantile(top[toxic & explained], 0.02), np.quantile(top[~toxic], 0.97)
    middle, width = low + (high - low) / 3, max(abs(high - low), 0.1)
    return Machine(machine.weights, machine.bias, 6 / width, middle)


def learnable(doc_id: Column) -> Column:
    """Rows that labels may be learned from: all but one fold of three, by checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS != HELD_OUT, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Machine:
    """Learn from labelled rows outside the held-out fold. Rows with a null id, label or text teach nothing."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().filter(F.col("toxic").isin(0, 1)).filter(learnable(F.col("doc_id")))
    # At most two classes' worth of ids, so the side that is sent around is bounded.
    chosen = None
    for label in (0, 1):
        some = known.filter(F.col("toxic") == label).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= sample_bytes)
    # One text for each id, so that rows which repeat an id neither crowd out others nor make the sample larger.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "toxic").collect()
    taken: dict[int, list[str]] = {0: [], 1: []}
    for r in rows:
        if len(taken[r["toxic"]]) < sample:
            taken[r["toxic"]].append(r["text"])
    return fit(taken[0] + taken[1], np.array([False] * len(taken[0]) + [True] * len(taken[1])))


def score(docs: DataFrame, machine: Machine, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` (or its columns `keep`) with score (0 to 1) and predicted (1 from `threshold` on).

    A text without words, null or empty, gets the score of the least toxic word. Repeated rows score alike. Columns of
    `docs` named like a result are replaced.
    """
    docs = without(docs, ["score", "predicted"])
    names = docs.columns
    kept = [names.index(c) for c in (names if keep is None else keep)]
    shape = T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, text):
                words, codes, bounds = document_words(rows.column(names.index(text)))
                margins = machine.margins(words)
                found = machine.score(best(margins[codes] if len(codes) else margins, bounds, -1e3))
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in kept), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32), pa.int32())],
                                                 [*(names[i] for i in kept), "score", "predicted"])

    return docs.mapInArrow(judge, shape)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", "predicted")
