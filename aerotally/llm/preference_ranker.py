"""Quality scores by Bradley-Terry pairwise ranking.

Labelled documents give preference pairs (a good one is preferred to a bad one).
The chance that i beats j is the logistic function of s(i) - s(j); with linear
scores that is a logistic regression without intercept on feature differences,
fitted here by Newton's method with conjugate gradients. A document is accepted
if its score is at or above a quantile of the scores: the share of bad documents
among all labelled ones (or ``reject_share``). Reported scores are moved along
the logistic curve so that this quantile is reported as ``CUT`` = 0.3.

Features are shares and means of the surface (symbols, capitals, repeats, word
lengths) and hashed character trigrams and words, as roots of their shares, so
texts of any length compare; never lang, source, id or length. How strongly the
weights are held back, and whether the n-grams take part, is chosen by
cross-validation inside the training rows; held-out rows choose nothing.

The fit uses a bounded sample, at most ``per_class`` labelled documents of each
class by hash of their id, so its pairs and the driver's share of the work don't
grow. The share of bad ones and the quantile are taken over all labelled
documents that are not held out (a document whose labels disagree is bad by
their share). :func:`rank` scores every text in one pass without a shuffle and
takes the quantile from those scores.

Defined results: null and empty texts and texts without words get the score of
a text that shows nothing, good or bad, but the learned weight of having no
words; texts of any length are read whole; a null doc_id counts as a training
row's id, never as held out; repeated rows are scored alike; equal scores are on
the same side of the cut; without labels of both classes every score is 0.5; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from aerotally.plans.storage import materialise

PER_CLASS, PAIRS_PER_DOCUMENT = 6000, 4
#: Cross-validation: candidates, folds, and documents of each class in it.
RIDGES, FOLDS, CV_PER_CLASS = (1e-4, 1e-3, 1e-2), 4, 800
CUT, BUCKETS = 0.3, 4096
#: Buckets of hashed character trigrams and of hashed words.
TRIGRAMS, WORDS = 256, 256
FEATURES = ("symbols", "marks", "upper", "single", "adjacent", "windows", "lines", "digits", "length", "spread", "stops", "no_letters", "no_words")
_SYMBOLS, _MARKS, _STOPS, _DIGITS = b"#*$%&|<>", b"!?", b".,;:", b"0123456789"
_LETTERS = re.compile(r"[^\W\d_]+")
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]+")
_LETTER_BYTE = re.compile(rb"[A-Za-z\x80-\xff]")


def features(text: bytes | None) -> list[float]:
    """The values of :data:`FEATURES` over the whole UTF-8 text; each is bounded."""
    text = text or b""
    words = text.split()
    if not words:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    n, size = len(words), len(text)
    count = lambda some: size - len(text.translate(None, some))
    string = text.decode("utf-8", "replace")
    letters = sum(map(len, _LETTERS.findall(string)))
    upper = len(string) - len(_UPPER.sub("", string))
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    windows = len(set(zip(words, words[1:], words[2:])))
    lines = text.split(b"\n")
    lengths = np.fromiter(map(len, words), np.float64, n)
    return [
        min(3.0, count(_SYMBOLS) / n),
        min(2.0, count(_MARKS) / n),
        upper / letters if letters else 0.0,
        sum(len(w) == 1 and w in _SYMBOLS for w in words) / n,
        adjacent / n,
        1 - windows / (n - 2) if n > 2 else 0.0,
        1 - len(set(lines)) / len(lines),
        count(_DIGITS) / size,
        min(3.0, lengths.mean() / 10),
        min(3.0, lengths.std() / 10),
        min(2.0, count(_STOPS) / n),
        sum(not _LETTER_BYTE.search(w) for w in set(words)) / len(set(words)),
        0.0,
    ]


N_SURFACE = len(FEATURES)
N_FEATURES = N_SURFACE + TRIGRAMS + WORDS
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are hashed at once.
_BYTES_AT_ONCE = 1 << 20


def _after_space(raw: np.ndarray, at: int) -> int:
    """The first place from ``at`` on that follows white space, or the end: no word is cut there."""
    while at < len(raw):
        space = np.flatnonzero(_IS_SPACE[raw[at - 1 : at - 1 + _BYTES_AT_ONCE]])
        if len(space):
            return at + int(space[0])
        at += _BYTES_AT_ONCE
    return len(raw)


def ngrams(text: bytes | None) -> np.ndarray:
    """Roots of the shares of the hash buckets, first of character trigrams and then of words, lower-cased."""
    raw = np.frombuffer((text or b"").lower(), np.uint8)
    tri, word = np.zeros(TRIGRAMS), np.zeros(WORDS)
    at = 0
    while at < len(raw):
        end = _after_space(raw, at + _BYTES_AT_ONCE)
        part = raw[max(0, at - 2) : end].astype(np.uint32)  # trigrams go on from the slice before
        if len(part) > 2:
            tri += np.bincount(((part[:-2] * 0x1F123BB5 + part[1:-1] * 0x5B9CA8F7 + part[2:] * 0x2545F491) >> 16) % TRIGRAMS, minlength=TRIGRAMS)
        part = part[at - max(0, at - 2) :]
        at = end
        gap = _IS_SPACE[part]
        starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
        if len(starts):
            # a word's hash: the sum of its bytes' values, each by the place in the word (places repeat after 64)
            number = np.cumsum(np.r_[True, gap[:-1]] & ~gap) - 1
            place = np.arange(len(part)) - starts[np.maximum(number, 0)]
            value = np.where(gap, 0, (part.astype(np.uint64) + 1) * _POWERS[place & 63])
            word += np.bincount(((np.add.reduceat(value, starts) >> np.uint64(40)) % np.uint64(WORDS)).astype(np.int64), minlength=WORDS)
    out = np.concatenate([tri / max(tri.sum(), 1), word / max(word.sum(), 1)])
    return np.sqrt(out)


def all_features(text: bytes | None) -> np.ndarray:
    return np.concatenate([features(text), ngrams(text)])


@dataclass
class Ranker:
    """Linear scores, and the score that is reported as :data:`CUT`."""

    weights: np.ndarray
    threshold: float
    chosen: tuple = ()

    def raw(self, text: bytes | None) -> float:
        if len(self.weights) == N_SURFACE:
            return float(np.dot(features(text), self.weights))
        return float(np.dot(all_features(text), self.weights))

    def score(self, raw: np.ndarray) -> np.ndarray:
        z = np.clip(raw - self.threshold, -500, 500) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z))


def pairs(n_good: int, n_bad: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Winners and losers of preference pairs; every row takes part in at least ``PAIRS_PER_DOCUMENT``."""
    rng = np.random.default_rng(seed)
    n = PAIRS_PER_DOCUMENT * max(n_good, n_bad)
    wins = np.concatenate([rng.permutation(n_good) for _ in range(-(-n // n_good))])[:n]
    loses = np.concatenate([rng.permutation(n_bad) for _ in range(-(-n // n_bad))])[:n]
    return wins, loses


def fit(good: np.ndarray, bad: np.ndarray, ridge: float, *, seed: int = 5, start: np.ndarray | None = None, rounds: int = 40) -> np.ndarray:
    """Bradley-Terry weights from pairs of the rows of ``good`` and ``bad``.

    Differences are never stored: sums over pairs are sums over rows, weighted
    by how the pairs of each row turned out.
    """
    wins, loses = pairs(len(good), len(bad), seed)
    n = len(wins)

    def back(of_pair: np.ndarray) -> np.ndarray:
        return (good.T @ np.bincount(wins, of_pair, len(good)) - bad.T @ np.bincount(loses, of_pair, len(bad))) / n

    def margin(v: np.ndarray) -> np.ndarray:
        return (good @ v)[wins] - (bad @ v)[loses]

    w = np.zeros(good.shape[1]) if start is None else start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(margin(w), -500, 500)))  # that the better one wins
        slope = back(1 - p) - ridge * w
        curve = p * (1 - p)
        step, rest = np.zeros_like(w), slope.copy()
        along, size = rest.copy(), rest @ rest
        enough = size * 1e-6
        for _ in range(40):  # conjugate gradients
            if size <= enough or not size:
                break
            bent = back(curve * margin(along)) + ridge * along
            length = size / (along @ bent)
            step, rest = step + length * along, rest - length * bent
            size, before = rest @ rest, size
            along = rest + size / before * along
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def loss(good: np.ndarray, bad: np.ndarray, w: np.ndarray, seed: int = 6) -> float:
    """Mean logistic loss over pairs."""
    wins, loses = pairs(len(good), len(bad), seed)
    return float(np.logaddexp(0, (bad @ w)[loses] - (good @ w)[wins]).mean())


def choose(good: np.ndarray, bad: np.ndarray, good_fold: np.ndarray, bad_fold: np.ndarray) -> tuple[int, float]:
    """(number of features, ridge) of the least loss on left-out folds of the training rows."""
    found = []
    for n in (N_SURFACE, N_FEATURES):
        total = dict.fromkeys(RIDGES, 0.0)
        for fold in range(FOLDS):
            g, b = good_fold == fold, bad_fold == fold
            if not (g.any() and b.any() and (~g).any() and (~b).any()):
                continue
            w = None
            for ridge in sorted(RIDGES, reverse=True):
                w = fit(good[~g][:, :n], bad[~b][:, :n], ridge, start=w, rounds=8)
                total[ridge] += loss(good[g][:, :n], bad[b][:, :n], w)
        found += [(v, n, -r) for r, v in total.items()]
    _, n, ridge = min(found)  # of equal losses the simpler
    return n, -ridge


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame, *, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """``(id, mean)``: the mean label of every labelled id that isn't held out."""
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    return known.where(~held_out(F.col("id"))).groupBy("id").agg(F.avg("label").alias("mean"))


def fit_weights(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> Ranker | None:
    """Weights from a bounded sample of the labelled rows that are not held out (labels that disagree about a document are left out); None without both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_features(t.as_py()).astype(np.float32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "x"])

    known = materialise(known_labels(labels, doc_id=doc_id, label=label), "rank-labels")
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).where("id is not null")
    there = known.join(texts.select("id").distinct(), "id", "left_semi")
    drawn = [there.where(F.col("mean") == v).orderBy(F.xxhash64("id"), "id").limit(per_class) for v in (0, 1)]
    drawn = materialise(drawn[0].unionByName(drawn[1]).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS)).cast("int")), "rank-drawn")
    x = texts.join(F.broadcast(drawn.select("id")), "id", "left_semi").mapInArrow(run, "id long, x binary")  # 2 * per_class ids at most
    rows = x.groupBy("id").agg(F.min("x").alias("x")).join(drawn, "id").orderBy("id").collect()  # at most per_class rows of each class
    side = lambda v: [r for r in rows if r["mean"] == v]
    matrix = lambda some: np.frombuffer(b"".join(r["x"] for r in some), np.float32).reshape(-1, N_FEATURES)
    fold = lambda some: np.array([r["fold"] for r in some])
    good, bad = side(1), side(0)
    if not good or not bad:
        return None
    few = lambda some: sorted(some, key=lambda r: crc32(str(r["id"]).encode()))[:CV_PER_CLASS]
    n, ridge = choose(matrix(few(good)), matrix(few(bad)), fold(few(good)), fold(few(bad)))
    return Ranker(fit(matrix(good)[:, :n].astype(np.float64), matrix(bad)[:, :n].astype(np.float64), ridge), 0.0, (n, ridge))


def raw_scores(docs: DataFrame, ranker: Ranker | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, z)`` per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.fromiter((ranker.raw(t.as_py()) if ranker else 0.0 for t in batch.column(2)), np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z)], names=["doc_id", "held_out", "z"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id).cast("long")).alias("held_out"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, z double")


def threshold(scored: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", label: str = "quality", reject_share: float | None = None) -> float:
    """The quantile of the ``z`` of all labelled rows that aren't held out, halfway to the next score."""
    known = known_labels(labels, doc_id=doc_id, label=label).withColumnRenamed("id", "doc_id")
    z = materialise(scored.join(known, "doc_id").select("z", "mean"), "rank-labelled")
    total = z.agg(F.count("*").alias("n"), F.avg(1 - F.col("mean")).alias("share")).first()
    if total["n"] < 2:
        return 0.0
    share = reject_share if reject_share is not None else total["share"]
    at = max(0, min(math.ceil(share * total["n"] - 1e-9) - 1, total["n"] - 2))
    return (nth(z, at) + nth(z, at + 1)) / 2


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS, reject_share: float | None = None) -> Ranker | None:
    """A ranker for :func:`score`, fitted and cut on the labelled documents of ``docs``."""
    ranker = fit_weights(docs, labels, doc_id=doc_id, text=text, label=label, per_class=per_class)
    if ranker:
        ids = known_labels(labels, doc_id=doc_id, label=label).select(F.col("id").alias("_rank_id"))
        some = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(ids, F.col("doc_id") == F.col("_rank_id"), "left_semi")
        ranker.threshold = threshold(materialise(raw_scores(some, ranker), "rank-scores"), labels, doc_id=doc_id, label=label, reject_share=reject_share)
    return ranker


def nth(values: DataFrame, n: int) -> float:
    """The exact ``n``-th smallest (from 0) of the column ``z``, by counts in ever narrower buckets."""
    one = values.agg(F.min("z").alias("low"), F.max("z").alias("high")).first()
    low, high = one["low"], one["high"]
    while low < high:
        some = values.where(F.col("z").between(low, high))
        bucket = F.least(F.floor((F.col("z") - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1))
        counts = some.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))
        for r in sorted(counts.collect(), key=lambda r: r["bucket"]):  # at most BUCKETS rows
            if n < r["n"]:
                low, high = r["low"], r["high"]
                break
            n -= r["n"]
    return low


def reported(scored: DataFrame, ranker: Ranker | None) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` from raw scores."""
    if ranker is None:
        score_ = F.lit(0.5)
    else:
        z = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("z") - F.lit(ranker.threshold))) + F.lit(math.log(CUT / (1 - CUT)))
        score_ = 1 / (1 + F.exp(-z))
    accepted = F.lit(True) if ranker is None else F.col("z") >= F.lit(ranker.threshold)
    # exactly at the cut, rounding may report a hair below 0.3
    score_ = F.when(accepted, F.greatest(score_, F.lit(CUT))).otherwise(F.least(score_, F.lit(math.nextafter(CUT, 0))))
    return scored.select("doc_id", "held_out", score_.alias("score"), accepted.cast("int").alias("predicted"))


def score(docs: DataFrame, ranker: Ranker | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row."""
    return reported(raw_scores(docs, ranker, doc_id=doc_id, text=text), ranker)


def rank(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS, reject_share: float | None = None) -> DataFrame:
    """:func:`train` and :func:`score` of the same documents, with one pass over all texts."""
    ranker = fit_weights(docs, labels, doc_id=doc_id, text=text, label=label, per_class=per_class)
    scored = materialise(raw_scores(docs, ranker, doc_id=doc_id, text=text), "rank-scores")
    if ranker:
        ranker.threshold = threshold(scored, labels, doc_id=doc_id, label=label, reject_share=reject_share)
    return reported(scored, ranker)
