"""A training corpus from ``documents`` in five stages, each an operator of the llm subpackage.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor
kept, and returns the columns of documents (the last returns token ids instead
of the text). A stage's result is written as Parquet to the shared folder and
read again as the next one's input, so a lost executor repeats tasks of one stage.
What a stage has written beside its result is deleted when the next one begins,
and so is the last stage's when a pipeline begins: write a stage's result before
the next is called.

Every stage takes nulls in any column, empty and very long texts, repeated rows,
an empty table, and extra columns of any name but those that begin with
``_host_rules_``, ``_near_``, ``_secret_`` or ``_mix_``; extra columns are kept.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aerotally.llm import host_rules, pivotal_mix, secret_forest, sentencepiece_codec, simhash
from aerotally.plans.storage import discard, materialise, recorded, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


_left: dict[str, list[str]] = {}


def _tidy(stage: Stage) -> Stage:
    """The stage, which first deletes what the stage before it left in this application's shared folder."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _left.pop(spark.sparkContext.applicationId, []))
        with recorded() as written:
            out = stage(spark, docs, sf_dir)
        _left[spark.sparkContext.applicationId] = written
        return out

    return run_stage


@_tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or their host's verdict rejects go.

    Texts without words go; short texts are judged by the rules like any other,
    as being short is no fault in a corpus. A null source is a host of its own.
    Repeated rows are judged alike.
    """
    return host_rules.keep_good(docs, min_words=1)


@_tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays, that with the smallest doc_id.

    Documents are linked if any of five SimHashes of their five-word shingles
    differ in at most four bits. That catches copies with few changed words: of
    pairs at a shingle similarity of 0.95 nearly all, at 0.9 two of three, at
    0.8 about one of seven. Of rows that repeat the kept doc_id one stays; rows
    with a null doc_id stay only where their component has no doc_id. Null and
    empty texts are copies of each other.
    """
    return simhash.keep_one_per_component(docs, shingle_words=5, tables=5)


@_tidy
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked and n_chars follows; every document stays, null and empty texts as they are."""
    return secret_forest.redact(docs)


@_tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights; a null source is one of its own, texts without words are left out or kept by their source's whole share."""
    return pivotal_mix.mix(docs)


@_tidy
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids; null and empty texts have none."""
    return sentencepiece_codec.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: None: hashes of shingles, forests and token ids are beyond SQL; tests/llm/test_corpus_pipeline.py holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        with recorded() as written:
            docs = materialise(out, f"pipeline-{name}")
        discard(spark, before)  # the stage's input has been read
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
