"""Language identification by error-correcting output codes.

Each learned language has a codeword of bits; every bit is a binary classifier
(logistic regression over hashed character n-grams) that tells the languages
whose codeword has the bit from the others. A text's language is the codeword
with the least logistic loss summed over the bits, so one wrong bit is outvoted.
Up to EXHAUSTIVE languages the code has every way to split them, beyond that it
is the best of some drawn codes by the least distance of two codewords.

A result is flagged as ambiguous if its bits, taken alone, lie further from the
chosen codeword than the code can correct, or if its score is below AMBIGUOUS.
The score is the softmax of the losses over half the least distance.

Features: roots of the shares of hashed letters, pairs and triples, lower-cased,
with runs of anything but letters and marks as one boundary; whole texts, in
slices that hand on their last two characters. Language, source and id are never
inputs.

The fit uses a bounded sample: at most ``train_rows`` labelled texts in all,
equally many of each language, the smallest by hash of the distinct texts, each as
a whole and as a short passage of it. Everything else reads all rows once.

Defined results: ``und`` with score 0 where the text is null or has no letter,
and everywhere if nothing is labelled; with one learned language all other texts
get it with score 1; rows without doc_id are learned from and are never held out;
repeated rows are predicted alike; equal losses go to the language that is first
by code points; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

TRAIN_ROWS = 4000
#: Buckets of letters, pairs and triples.
BUCKETS = (64, 512, 2048)
N_FEATURES = sum(BUCKETS)
RIDGE, STEPS = 1e-4, 400
EXHAUSTIVE, DRAWS = 5, 200
AMBIGUOUS = 0.6
UNKNOWN = "und"
#: Characters read at once, and texts scored at once.
CHARS_AT_ONCE, TEXTS_AT_ONCE = 1 << 20, 256
#: Lengths in characters of the passages that are learned from beside whole texts.
PASSAGES = (24, 48, 96, 192)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Per code point: 2 for letters, 1 for marks, 0 for all else."""
    return np.array([(2 if (c := chr(i)).isalpha() else unicodedata.category(c)[0] == "M") for i in range(0x110000)], np.uint8)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text, or None if it has no letter."""
    counts, letters = np.zeros(N_FEATURES), False
    one, two, three = BUCKETS
    before = np.zeros(1, np.uint32)  # the last characters so far; 0 is a boundary
    text = text or ""
    for at in range(0, len(text) + 1, CHARS_AT_ONCE):
        part = np.frombuffer(text[at : at + CHARS_AT_ONCE].lower().replace("ς", "σ").encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _classes()[part]
        letters = letters or bool((kind == 2).any())
        code = np.where(kind > 0, part, np.uint32(0))
        code = code[(code > 0) | (np.r_[before[-1:], code[:-1]] > 0)]  # runs of boundaries are one
        if at + CHARS_AT_ONCE > len(text) and (code[-1] if len(code) else before[-1]):
            code = np.r_[code, np.uint32(0)]
        line = np.r_[before, code]
        some = code[code > 0]
        counts[:one] += np.bincount((some * np.uint32(0x9E3779B1)) >> 26, minlength=one)
        pair = line[len(before) - 1 :]
        counts[one : one + two] += np.bincount((pair[:-1] * np.uint32(0x85EBCA6B) + pair[1:] * np.uint32(0xC2B2AE35)) >> 23, minlength=two)
        counts[one + two :] += np.bincount((line[:-2] * np.uint32(0x27D4EB2F) + line[1:-1] * np.uint32(0x165667B1) + line[2:] * np.uint32(0x9E3779B1)) >> 21, minlength=three)
        before = line[-2:]
    return counts if letters else None


def features(text: str | None) -> np.ndarray | None:
    """Roots of the shares of each order's n-grams; None without letters."""
    counts = ngram_counts(text)
    if counts is None:
        return None
    at = 0
    for n in BUCKETS:
        part = counts[at : at + n]
        part /= max(part.sum(), 1)
        at += n
    return np.sqrt(counts, dtype=np.float32, casting="same_kind")


def codewords(n: int, seed: int = 12) -> np.ndarray:
    """``n`` codewords of +1 and -1, one a row; no column is constant, repeated or another's complement."""
    if n < 2:
        return np.ones((n, 0))
    if n <= EXHAUSTIVE:
        splits = np.arange(2 ** (n - 1) - 1)  # the first language is always +1, and never all are
        return np.stack([np.ones(len(splits)), *(np.where(splits >> k & 1, 1.0, -1.0) for k in range(n - 1))])
    rng, best, most = np.random.default_rng(seed), None, -1.0
    bits = 8 * math.ceil(math.log2(n))
    for _ in range(DRAWS):
        code = rng.integers(0, 2, (n, bits)) * 2.0 - 1
        code = np.unique(code * code[0], axis=1)
        code = code[:, (code == 1).any(0) & (code == -1).any(0)]
        if (least := _least_distance(code)) > most:
            best, most = code, least
    return best


def _least_distance(code: np.ndarray) -> float:
    same = code @ code.T - 2 * code.shape[1] * np.eye(len(code))
    return float((code.shape[1] - same.max()) / 2) if len(code) > 1 else 0.0


@dataclass
class Model:
    """Languages by code points, their codewords, and weights with a bias in the last row."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row of features: the place of the chosen language, the score, and whether it is ambiguous."""
        margin = (x @ self.weights[:-1] + self.weights[-1]).astype(np.float64)
        loss = np.stack([np.logaddexp(0, -margin * c).sum(1) for c in self.code], 1)
        best = loss.argmin(1)
        least = _least_distance(self.code)
        odds = np.exp((loss.min(1, keepdims=True) - loss) / max(least / 2, 1))
        score = 1 / odds.sum(1)
        wrong = (np.where(margin >= 0, 1.0, -1.0) != self.code[best]).sum(1)
        return best, score, (wrong > max(least - 1, 0) // 2) | (score < AMBIGUOUS)


def fit(langs: np.ndarray, x: np.ndarray) -> Model:
    """All bits at once by accelerated gradient steps; every language has the same weight."""
    known = sorted(set(langs))
    code = codewords(len(known))
    own = np.searchsorted(known, langs)
    y = code[own].astype(np.float32)
    share = (1 / (len(known) * np.bincount(own)))[own].astype(np.float32)[:, None]
    x = np.c_[x, np.ones(len(x), np.float32)]
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    ahead, t = w, 1.0
    step = 1 / (0.25 * (len(BUCKETS) + 1) + RIDGE)  # a row's squared length is the number of orders and the bias
    for _ in range(STEPS if code.shape[1] else 0):
        slope = x.T @ (-share * y / (1 + np.exp(np.clip(y * (x @ ahead), -60, 60)))) + RIDGE * ahead
        new, after = ahead - step * slope, (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / after * (new - w), new, after
    return Model(known, code, w)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model of the languages of the labelled rows that aren't held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"), F.xxhash64("text").alias("hash"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()  # a row per language, as the model has
    if not sizes:
        return Model([], np.ones((0, 0)), np.zeros((N_FEATURES + 1, 0), np.float32))
    each = max(1, train_rows // len(sizes))
    # twice the share that would do by estimate, as texts may lack letters and the count is approximate
    below = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 2 * each / r.n)) for r in sizes], "lang string, below double")
    near = known.join(F.broadcast(below), "lang").where(F.col("hash") / F.lit(2.0**64) + 0.5 <= F.col("below"))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text, hash in zip(*(c.to_pylist() for c in batch.columns)):
                if (whole := features(text)) is not None:
                    size = PASSAGES[hash % len(PASSAGES)]
                    at = crc32(str(hash).encode()) % max(1, len(text) - size)
                    part = features(text[at : at + size])
                    rows.append((lang, hash, whole.astype(np.float16).tobytes(), (whole if part is None else part).astype(np.float16).tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "hash", "whole", "part"), r)) for r in rows], schema=pa.schema([("lang", pa.string()), ("hash", pa.int64()), ("whole", pa.binary()), ("part", pa.binary())]))

    made = near.select("lang", "text", "hash").mapInArrow(examples, "lang string, hash long, whole binary, part binary").dropDuplicates(["lang", "hash"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    sample = made.withColumn("nth", nth).where(F.col("nth") <= each).orderBy("lang", "hash").collect()  # at most train_rows
    if not sample:
        return Model([], np.ones((0, 0)), np.zeros((N_FEATURES + 1, 0), np.float32))
    x = np.stack([np.frombuffer(v, np.float16) for k in ("whole", "part") for v in (r[k] for r in sample)]).astype(np.float32)
    return fit(np.array([r.lang for r in sample] * 2), x)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, ambiguous)`` of every row, in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = sent.value
        for batch in batches:
            texts = batch.column(2)
            n = len(texts)
            lang, score, unsure = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            for at in range(0, n if use.langs else 0, TEXTS_AT_ONCE):
                found = [(i, f) for i in range(at, min(n, at + TEXTS_AT_ONCE)) if (f := features(texts[i].as_py())) is not None]
                if found:
                    rows = [i for i, _ in found]
                    best, score[rows], unsure[rows] = use.decode(np.stack([f for _, f in found]))
                    for i, b in zip(rows, best):
                        lang[i] = use.langs[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Learn from the labelled rows that aren't held out, and predict all rows."""
    return predict(docs, learn(docs, train_rows))
