"""Quality rules judged by host: shrunken failure rates decide how strict the rules are.

Every whole text is measured once. Soft rules (symbol density, repeated 3-word
windows, capitals, word length) give each document a *severity*: the largest
measure as a multiple of its limit; above 1 it fails. Failures are counted by
host with map-side combining; an empirical beta prior, fitted to the hosts' rates
by moments, shrinks the rate of each host, so that a host of three pages isn't
condemned by two. The host's verdict compares its shrunken rate with the
corpus's: the *tolerance* is the squared ratio of their odds, between a half and
1.5, and a document goes if its severity is above its host's tolerance. So a
borderline document stays on a host that is better than the corpus (*trusted*)
and goes on a worse one (*doubted*). All documents of a host whose odds are
``BLOCK_ODDS`` times the corpus's go (*blocked*). Where hosts differ no more than
chance explains, shrinking leaves all of them near the corpus's rate and the
limits near their plain values.

Only counts by host are shuffled for the verdict, and the join back carries the
measures, not the texts; a hot host is one row on the verdict side, and its
documents may be split over tasks.

Defined results: a null text has no words; an empty text or one without words
fails the base rule; texts of any length are measured whole; a null host is a
host of its own; equal severity and tolerance keep the document; repeated rows
are each judged; an empty table gives an empty result; extra columns are ignored
by :func:`judge` and kept by :func:`keep_good`, unless their names begin with
``_host_rules_``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from aerotally.plans.storage import materialise

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Soft limits: symbols and repeated words per word, capitals per letter, shortest and longest mean word.
SYMBOLS, REPEATED, CAPITALS, WORD_LENGTH = 0.1, 0.3, 0.5, (2.0, 20.0)
LEAST_TOLERANCE, MOST_TOLERANCE, BLOCK_ODDS = 0.5, 1.5, 4.0
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper")
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_NOT_SYMBOL = bytes(set(range(256)) - set(_SYMBOLS))
_NOT_CODE_POINT = bytes([*range(0x80, 0xC0), *_SPACE])  # UTF-8 continuation bytes and the six spaces

_LETTERS = re.compile(r"[^\W\d_]+")
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]+")


def measures(text: bytes | None) -> tuple[int, ...]:
    """The counts of :data:`MEASURES` over the whole UTF-8 text."""
    text = text or b""
    words = text.split()  # bytes: x20 and x09-x0D only
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    windows = list(zip(ids, ids[1:], ids[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: set[tuple] = set()
        twice = {w for w in windows if w in seen or seen.add(w)}
        end = 0  # words before it are counted
        for at, w in enumerate(windows):
            if w in twice:
                repeated += at + 3 - max(at, end)
                end = at + 3
    string = text.decode("utf-8", "replace")
    letters = sum(map(len, _LETTERS.findall(string)))
    upper = len(string) - len(_UPPER.sub("", string)) if letters else 0
    return (len(words), len(text.translate(None, _NOT_CODE_POINT)), len(text.translate(None, _NOT_SYMBOL)), len(lines) - len(set(lines)), repeated, letters, upper)


def measured(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``(doc_id, host, *MEASURES)`` per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures(t.as_py()) for t in batch.column(2)]
            columns = zip(*found) if found else [[] for _ in MEASURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "host", *MEASURES])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def base_failed(measure: Callable[[str], Column] = F.col, min_words: int = MIN_WORDS) -> Column:
    """Fewer than ``min_words`` words, or more than half of the words in repeated 3-word windows."""
    return (measure("n_words") < min_words) | (100 * measure("n_repeat_words") > MAX_REPEATED_PERCENT * measure("n_words"))


def severity(measure: Callable[[str], Column] = F.col) -> Column:
    """The largest soft measure as a multiple of its limit: symbols, repeated words, capitals, and word lengths that prose doesn't have."""
    words = F.greatest(measure("n_words"), F.lit(1)).cast("double")
    chars, letters = F.greatest(measure("word_chars"), F.lit(1)).cast("double"), F.greatest(measure("n_letters"), F.lit(1)).cast("double")
    return F.greatest(
        measure("n_symbols") / (words * SYMBOLS),
        measure("n_repeat_words") / (words * REPEATED),
        measure("n_upper") / (letters * CAPITALS),
        F.when((chars < words * WORD_LENGTH[0]) | (chars > words * WORD_LENGTH[1]), 2.0).otherwise(0.0),  # on every host: usual lengths differ by language
    )


def host_verdicts(judged: DataFrame, *, block_odds: float = BLOCK_ODDS) -> DataFrame:
    """``(host, n_docs, n_failed, rate, tolerance, verdict)`` from rows of ``(host, failed)``.

    The beta prior has the mean and variance of the hosts' rates, weighted by
    documents and with the binomial share of the variance taken out; where hosts
    differ no more than chance explains, the prior is as strong as all documents.
    """
    by_host = materialise(judged.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")), "host-counts")
    total = by_host.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("k"), F.sum(F.col("n_docs") * F.col("n_docs")).alias("nn"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("ff")).first()
    alpha, beta = beta_prior(total.n or 0, total.f or 0, total.k, total.nn or 0, total.ff or 0.0)
    rated = by_host.withColumn("rate", (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta)))
    corpus = alpha / beta
    times = rated.withColumn("_odds", F.col("rate") / (1 - F.col("rate")) / F.lit(corpus))
    tolerance = F.least(F.lit(MOST_TOLERANCE), F.greatest(F.lit(LEAST_TOLERANCE), 1 / (F.col("_odds") * F.col("_odds"))))
    verdict = F.when(F.col("_odds") > block_odds, "blocked").when(F.col("_odds") > 1, "doubted").otherwise("trusted")
    return times.withColumn("tolerance", tolerance).withColumn("verdict", verdict).drop("_odds")


def beta_prior(n: float, failed: float, hosts: float, n_squared: float, failed_squared_over_n: float) -> tuple[float, float]:
    """(alpha, beta) by moments from sums over hosts; (1, 1) without documents."""
    if not n:
        return 1.0, 1.0
    mean = min(max(failed / n, 0.5 / (n + 1)), 1 - 0.5 / (n + 1))
    spread = mean * (1 - mean)
    between = (failed_squared_over_n - n * mean * mean - (hosts - 1) * spread) / max(n - n_squared / n, 1e-9) if hosts > 1 else 0.0
    strength = n if between <= spread / (n + 1) else max(spread / between - 1, 1e-3)
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_words: int = MIN_WORDS, block_odds: float = BLOCK_ODDS) -> DataFrame:
    """Measures, base verdict, severity, host verdict and ``kept`` of every row; ``flipped`` says whether plain limits alone would have decided otherwise."""
    rows = measured(docs, doc_id=doc_id, text=text, host=host).withColumn("base_failed", base_failed(min_words=min_words)).withColumn("severity", severity())
    rows = materialise(rows, "host-measures")
    failed = F.col("base_failed") | (F.col("severity") > 1)
    hosts = host_verdicts(rows.withColumn("failed", failed), block_odds=block_odds).select(F.col("host").alias("_host"), "rate", "tolerance", "verdict")
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    stays = (F.col("verdict") != "blocked") & (F.col("severity") <= F.col("tolerance"))
    return joined.withColumn("kept", ~F.col("base_failed") & stays).withColumn("flipped", F.col("kept") == failed)


def keep_good(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_words: int = MIN_WORDS, block_odds: float = BLOCK_ODDS) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps.

    The measured rows are written once to the shared folder, so no text is
    measured twice, and none is shuffled: verdicts, a row for each host, are
    joined to the rows.
    """
    schema = ", ".join(f"{m} long" for m in MEASURES)

    @F.pandas_udf(schema)
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measures(t) for t in texts], columns=list(MEASURES))

    mine = [F.col(f"`{c}`") for c in docs.columns]
    source = F.col(f"`{host}`").cast("string")
    of = lambda m: F.col(f"_host_rules_measures.{m}")
    marked = docs.withColumn("_host_rules_measures", measure(F.col(f"`{text}`").cast("binary")))
    marked = materialise(marked.select(*mine, base_failed(of, min_words).alias("_host_rules_base"), severity(of).alias("_host_rules_severity")), "host-marked")
    failed = F.col("_host_rules_base") | (F.col("_host_rules_severity") > 1)
    verdicts = host_verdicts(marked.select(source.alias("host"), failed.alias("failed")), block_odds=block_odds)
    tolerance = F.when(F.col("verdict") == "blocked", -1.0).otherwise(F.col("tolerance"))
    verdicts = verdicts.select(F.col("host").alias("_host_rules_host"), tolerance.alias("_host_rules_tolerance"))
    joined = marked.where("not _host_rules_base").join(verdicts, source.eqNullSafe(F.col("_host_rules_host")))
    return joined.where("_host_rules_severity <= _host_rules_tolerance").select(*mine)
