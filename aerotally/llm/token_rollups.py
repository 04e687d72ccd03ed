"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch is a set of changes: documents inserted, deleted, or counted anew. It
becomes signed rows: +n for an insert, -n for a delete, new minus old for a
revised count. Totals are additive, so a batch is folded into its own table of
sums by (source, lang, tokenizer), and the totals are the sum over all committed
batches. Old totals are never read to write new ones.

Commits are idempotent. A batch has a number; its ledger (signed rows by
document, from which deletes and revisions take the old counts) and its sums are
written to folders named by that number, the sums last, and Spark's own success
mark of the sums makes it committed. A batch that is already committed is left
alone; one that broke off is written again from the ledgers of smaller numbers
only, so it comes out the same. :func:`compact` folds old batches into one.

Counting uses Arrow batches and a public byte-level BPE vocabulary, whole texts;
sums are combined before the shuffle, so a hot source costs one row per task.

Defined results: null and empty texts have 0 tokens and count as documents; a
null source or lang is a key of its own; a document inserted twice in a batch or
over batches counts twice (deletes take all of it away); deletes and revisions
of unknown documents change nothing; a null doc_id can be inserted, not changed;
an empty batch commits with no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from aerotally.plans.storage import fresh_dir, materialise

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary cuts text before its merges: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEY = ("source", "lang", "tokenizer")
LEDGER = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"
SUMS = "source string, lang string, tokenizer string, docs long, tokens long"


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    parsed = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=parsed, special_tokens={})


def counted(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", ranks_path: str = DEFAULT_RANKS, version: str = "byte_bpe_50k/1", also: dict[str, Callable[[str], str]] | None = None) -> DataFrame:
    """``(doc_id, source, lang, tokenizer, tokens)`` per row, over whole texts.

    ``also`` names further counts of the text rewritten by a function, made in
    the same pass, so that a revision needs no second reading of the texts.
    """
    also = also or {}
    with open(ranks_path, "rb") as f:
        ranks = f.read()  # under a megabyte; sent with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks).encode_ordinary
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            counts = [pa.array([len(encode(t)) for t in texts], pa.int64())]
            counts += [pa.array([len(encode(f(t))) for t in texts], pa.int64()) for f in also.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([version] * len(texts), pa.string()), *counts], names=["doc_id", *KEY, "tokens", *also])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long" + "".join(f", {c} long" for c in also))


class Rollups:
    """The state of a rollup below one folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or fresh_dir(spark, "token-rollups")

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}/batch={batch:012d}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def batches(self) -> list[int]:
        """Numbers of the committed batches."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/sums")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted(n for n in (int(x.split("=")[1]) for x in names if x.startswith("batch=")) if self._exists(f"{self._path('sums', n)}/_SUCCESS"))

    def _read(self, kind: str, batches: list[int], schema: str) -> DataFrame:
        paths = [self._path(kind, b) for b in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self, before: int | None = None) -> DataFrame:
        """What the ledger says of each document: ``(doc_id, source, lang, tokenizer, docs, tokens)``, by committed batches (below ``before``)."""
        ledger = self._read("ledger", [b for b in self.batches() if before is None or b < before], LEDGER)
        return ledger.groupBy("doc_id", *KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def commit(self, batch: int, *, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revised: DataFrame | None = None) -> bool:
        """Apply a batch once; False if it was committed before.

        ``inserts`` and ``revised`` are rows of :func:`counted`, ``deletes`` has
        ``doc_id``. A revision replaces the count of a (document, tokenizer) and
        leaves its source and language; of several in a batch the largest holds.
        Deletes and revisions see the state before the batch.
        """
        done = self.batches()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after {done[-1]} was committed")
        parts = [self.spark.createDataFrame([], LEDGER)]
        if inserts is not None:
            parts.append(inserts.select("doc_id", *KEY, F.lit(1).cast("long").alias("docs"), "tokens"))
        if deletes is not None:
            gone = deletes.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
            parts.append(self.current(batch).join(gone, "doc_id", "left_semi").select("doc_id", *KEY, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        if revised is not None:
            new = revised.where("doc_id is not null").groupBy("doc_id", "tokenizer").agg(F.max("tokens").alias("new"))
            if deletes is not None:
                new = new.join(gone, "doc_id", "left_anti")
            old = self.current(batch).join(new, ["doc_id", "tokenizer"])
            parts.append(old.select("doc_id", *KEY, F.lit(0).cast("long").alias("docs"), (F.col("docs") * F.col("new") - F.col("tokens")).alias("tokens")))
        signed = parts[0]
        for p in parts[1:]:
            signed = signed.unionByName(p)
        signed.write.mode("overwrite").parquet(self._path("ledger", batch))
        ledger = self._read("ledger", [batch], LEDGER)
        ledger.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(self._path("sums", batch))
        return True

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, docs, tokens)`` over all committed batches; keys without documents are gone."""
        sums = self._read("sums", self.batches(), SUMS)
        return sums.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self, folder: str | None = None) -> Rollups:
        """The same state in a new folder as a single batch with the number of the last one."""
        new = Rollups(self.spark, folder)
        if done := self.batches():
            self.current().write.mode("overwrite").parquet(new._path("ledger", done[-1]))
            self.totals().write.mode("overwrite").parquet(new._path("sums", done[-1]))
        return new


def maintain(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals of a corpus after four batches: all documents in, toxic ones out, and quality-0 ones counted anew.

    Batch 1 inserts every document; batch 2 deletes those labelled toxic; batch
    3 revises those labelled quality 0 to the count of their text with runs of
    white space made one space. Batch 1 is then delivered again, to no effect.
    """
    state = Rollups(docs.sparkSession)
    counts = materialise(counted(docs, also={"squeezed": squeeze}), "token-counts")
    inserts = counts.select("doc_id", *KEY, "tokens")
    state.commit(1, inserts=inserts)
    state.commit(2, deletes=labels.where("toxic = 1"))
    poor = labels.where("quality = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    state.commit(3, revised=counts.join(poor, "doc_id", "left_semi").select("doc_id", *KEY, F.col("squeezed").alias("tokens")))
    state.commit(1, inserts=inserts)
    return state.totals()


def squeeze(text: str) -> str:
    """Runs of white space made one space, none at the ends."""
    return " ".join(text.split())
