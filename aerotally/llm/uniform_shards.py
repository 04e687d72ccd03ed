"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Parallel permutation in three steps. Rows are permuted inside their partition;
how many rows each partition sends to each shard is drawn beforehand, exactly:
the matrix has the partitions' row counts and the shards' sizes as margins, and
each of its rows is a multivariate hypergeometric draw from the places that are
left. Partition i sends its first a[i,0] rows to shard 0, the next a[i,1] to
shard 1 and so on; after the exchange the rows of a shard are permuted again.
Every assignment with those shard sizes is equally likely, and no shard is off
by a single row.

The rows' path is DataFrame operations only. The matrix has a row for each input
partition and a column for each shard; the driver gets one count per partition
(at most ``MAX_CELLS`` over the number of shards) and sends the matrix back. The second permutation is
a rank by random key, dealt over buckets of about ``ROWS_PER_BUCKET`` rows, so no
task holds a shard. Keys are hashes of the seed and the row, and partition
numbers are written to the shared folder before they are used, so a task that
runs again makes the same rows.

Defined results: null and empty texts are rows like any other (size 1); repeated
rows each get a place, and which of them comes first makes no difference; texts
of any length are rows like any other; an empty table gives an empty result; with
more shards than rows the last shards stay empty; extra columns are kept, unless
their names begin with ``_shuffle_``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from aerotally.plans.storage import materialise

#: Numbers in the matrix, which the driver holds (16 MB); with 16 shards that is 131,072 partitions.
MAX_CELLS, ROWS_PER_BUCKET = 1 << 21, 4096


def communication_matrix(partition_rows: list[int], shard_rows: list[int], seed: int) -> np.ndarray:
    """Random counts with these row and column sums, as a uniform shuffle gives them."""
    rng = np.random.default_rng(seed)
    left = np.array(shard_rows, np.int64)
    out = np.zeros((len(partition_rows), len(shard_rows)), np.int64)
    for i, n in enumerate(partition_rows):
        out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        left -= out[i]
    return out


def shard_sizes(n_rows: int, n_shards: int) -> list[int]:
    """Sizes at most one apart."""
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def uniform_shards(rows: DataFrame, n_shards: int = 16, *, seed: int = 29) -> DataFrame:
    """``rows`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 within the shard).

    Columns of those names in ``rows`` are replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    mine = [c for c in rows.columns if c not in ("shard", "slot")]
    columns = [F.col(f"`{c}`") for c in mine]
    keyed = rows.select(*columns).coalesce(max(1, MAX_CELLS // n_shards)).withColumn("_shuffle_key", F.xxhash64(F.lit(seed), *columns))
    local = keyed.sortWithinPartitions("_shuffle_key").select(
        *columns, "_shuffle_key", F.spark_partition_id().alias("_shuffle_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_shuffle_pos")
    )
    local = materialise(local, "shuffle-local")
    counts = sorted((r["_shuffle_part"], r["n"]) for r in local.groupBy("_shuffle_part").agg(F.count("*").alias("n")).collect())  # one row per partition
    n_rows = sum(n for _, n in counts)
    matrix = communication_matrix([n for _, n in counts], shard_sizes(n_rows, n_shards), seed)
    sends = [(part, [int(x) for x in np.cumsum(cells)]) for (part, _), cells in zip(counts, matrix)]
    bounds = F.broadcast(rows.sparkSession.createDataFrame(sends, "_shuffle_part int, _shuffle_bounds array<long>"))  # at most MAX_CELLS numbers
    shard = F.size(F.filter("_shuffle_bounds", lambda b: b <= F.col("_shuffle_pos")))
    n_buckets = max(1, -(-n_rows // (n_shards * ROWS_PER_BUCKET)))
    again = F.xxhash64(F.lit(seed + 1), "_shuffle_key", "_shuffle_part", "_shuffle_pos")
    place = [again.alias("_shuffle_again"), F.pmod(again, F.lit(n_buckets)).alias("_shuffle_bucket"), "_shuffle_part", "_shuffle_pos"]
    sent = local.join(bounds, "_shuffle_part").select(*columns, shard.alias("shard"), *place)
    sizes = sent.groupBy("shard", "_shuffle_bucket").agg(F.count("*").alias("_shuffle_n"))
    before = F.sum("_shuffle_n").over(Window.partitionBy("shard").orderBy("_shuffle_bucket")) - F.col("_shuffle_n")  # one row per bucket
    offsets = sizes.select("shard", "_shuffle_bucket", before.alias("_shuffle_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "_shuffle_bucket").orderBy("_shuffle_again", "_shuffle_part", "_shuffle_pos")) - 1
    placed = sent.withColumn("_shuffle_rank", rank).join(offsets, ["shard", "_shuffle_bucket"])
    return placed.select(*columns, "shard", (F.col("_shuffle_before") + F.col("_shuffle_rank")).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 16, *, doc_id: str = "doc_id", text: str = "text", seed: int = 29) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``; the law is ``rows``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).cast("long").alias("text_crc32"))
    placed = uniform_shards(narrow, n_shards, seed=seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
