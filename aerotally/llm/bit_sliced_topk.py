"""Exact top-k inner-product search on a bit-sliced index.

Each block of rows keeps every quantised attribute as bit slices: bitmap b of
attribute d holds bit b of that attribute for all rows of the block. A query's
scores come from bitmap arithmetic alone: the slices that its weights select are
added by carry-save adders into slices of the score. Top rows are then selected
from the most significant score slice downward; rows that still tie after the
last slice are the boundary, and are resolved exactly by the smaller id.

Slices may have any width. Rows with a component of 2**62 or more once quantised
are dealt to blocks of their own, whose slices are cut from Python integers, so
the usual blocks stay narrow.

Spark deals rows into blocks by a hash of the id, replicates index blocks over
query blocks (a grid, so that neither side is ever sent whole to a task) and
merges the k rows that each cell gives. Memory of a task is one index block and
one query block.

Defined results: rows whose id is null, or whose vector is null, empty, or holds
a null or a non-finite value take no part; vectors of different lengths do not
meet; a query's own id is no candidate in any row; rows repeated whole are each
a candidate, repeated whole query rows are answered once; a result whose score
does not fit a long raises, as does a component that passes a double once
scaled; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from aerotally.plans.storage import materialise

ROWS_PER_BLOCK, QUERIES_PER_BLOCK, FEWEST_QUERIES = 8192, 4096, 128
#: Quantised components from here on are wide; below it, differences fit 64 bits.
_WIDE = 2.0**62
_ONES = np.uint64(2**64 - 1)


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, integers as array<double> (exact: a double of 2**53 or more is one already)."""

    def floor(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, floor)


def usable(vector: Column) -> Column:
    """Whether every component is there and finite."""
    good = lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, good), F.lit(False))


def integers(matrix: np.ndarray) -> np.ndarray:
    """Integral doubles as int64, or as Python integers where one of them is wide."""
    if not np.isfinite(matrix).all():
        raise OverflowError("a component passes a double once it is scaled")
    if (np.abs(matrix) < _WIDE).all():
        return matrix.astype(np.int64)
    return np.array([[int(x) for x in row] for row in matrix.tolist()], object).reshape(matrix.shape)


def slice_block(matrix: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """(slices, base, valid): slices[d, b] is the bitmap of bit b of ``matrix[:, d] - base[d]``."""
    n, dims = matrix.shape
    words = -(-n // 64)
    base = matrix.min(0)
    offset = (matrix - base).T
    bits = max(1, int(offset.max()).bit_length())
    if offset.dtype != object:
        offset = offset.astype(np.uint64)
    slices = np.empty((dims, bits, words), np.uint64)
    for b in range(bits):
        bit = np.zeros((dims, words * 64), np.uint8)
        bit[:, :n] = (offset >> (np.uint64(b) if offset.dtype != object else b)) & (np.uint64(1) if offset.dtype != object else 1)
        slices[:, b] = np.packbits(bit, axis=1, bitorder="little").view(np.uint64)
    valid = np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)
    return slices, [int(x) for x in base], valid


def add_slices(both: np.ndarray, base: list[int], query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Score slices (least significant first) and the constant to add to them.

    ``both`` holds the attributes' slices and, after them, their complements. A
    negative weight takes the complement, so only non-negative numbers are
    added: -w*u = w*(2**B - 1 - u) - w*(2**B - 1).
    """
    bits = both.shape[1]
    weight = np.abs(query)
    negative = query < 0
    attribute = np.arange(len(query)) + len(query) * negative
    most = (1 << bits) - 1
    constant = sum(w * b - (most * -w if w < 0 else 0) for w, b in zip(query.tolist(), base))
    chosen = [attribute[(weight >> j & 1).astype(bool)] for j in range(max(1, int(weight.max()).bit_length()))]
    out: list[np.ndarray] = []
    carry: list[np.ndarray] = []
    p = 0
    while p < len(chosen) + bits - 1 or carry:
        parts = carry + [both[rows, p - j] for j, rows in enumerate(chosen) if 0 <= p - j < bits and len(rows)]
        carry = []
        x = np.concatenate(parts) if parts else np.zeros((1, both.shape[2]), np.uint64)
        while len(x) > 1:
            if m := len(x) // 3:
                a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
                t = a ^ b
                carry.append(a & b | t & c)
                x = np.concatenate([t ^ c, x[3 * m :]])
            else:
                carry.append(x[:1] & x[1:])
                x = x[:1] ^ x[1:]
        out.append(x[0])
        p += 1
    return out, constant


def select_top(score: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, boundary ties to lower positions; unordered."""
    sure, open_ = np.zeros_like(allowed), allowed
    for s in reversed(score):
        with_bit = sure | open_ & s
        n = int(np.bitwise_count(with_bit).sum())
        if n > k:
            open_ = open_ & s
        else:
            sure, open_ = with_bit, open_ & ~s
            if n == k:
                return _positions(sure)
    return np.concatenate([_positions(sure), _positions(open_)[: k - int(np.bitwise_count(sure).sum())]])


def _positions(bitmap: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].view(np.uint8), bitorder="little").reshape(len(words), 64)
    at, bit = np.nonzero(bits)
    return words[at] * 64 + bit


def block_top(both: np.ndarray, base: list[int], valid: np.ndarray, ids: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
    """(ids, scores) of a block's k best rows for one query; ids ascend in the block."""
    allowed = valid.copy()
    for at in range(np.searchsorted(ids, query_id), np.searchsorted(ids, query_id, "right")):
        allowed[at >> 6] &= ~np.uint64(1 << (at & 63))
    score, constant = add_slices(both, base, query)
    found = select_top(score, allowed, k)
    value = [constant] * len(found)
    for p, s in enumerate(score):
        bits = s[found >> 6] >> (found & 63).astype(np.uint64) & np.uint64(1)
        value = [v + (b << p) for v, b in zip(value, bits.tolist())]
    return ids[found], value


def top_k(rows: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """``(query_id, rank, <key>, score)``: each query's k highest integer inner products, exact."""

    def dense(df: DataFrame) -> DataFrame:
        some = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x")).where(F.col("id").isNotNull() & usable(F.col("x")))
        some = some.select("id", quantised(F.col("x"), scale).alias("v")).withColumn("dims", F.size("v"))
        return some.withColumn("wide", F.exists("v", lambda y: F.abs(y) >= _WIDE))

    index_rows = dense(rows)
    asked = dense(queries).dropDuplicates(["id", "v"])
    n_rows, n_queries = index_rows.count(), asked.count()
    n_blocks = max(1, -(-n_rows // ROWS_PER_BLOCK))
    # few queries are cut finer, so that there are cells for all cores; each index block is sent once per query block
    parallel = 4 * rows.sparkSession.sparkContext.defaultParallelism
    n_asked = max(1, -(-n_queries // QUERIES_PER_BLOCK), min(-(-n_queries // FEWEST_QUERIES), -(-parallel // n_blocks)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        slices, base, valid = slice_block(integers(np.stack(pdf["v"].to_numpy())))
        one = {"dims": pdf["dims"].iloc[0], "block": pdf["block"].iloc[0], "bits": slices.shape[1], "ids": pdf["id"].to_numpy(np.int64).tobytes(), "base": [str(b) for b in base], "valid": valid.tobytes(), "slices": slices.tobytes()}
        return pd.DataFrame([one])

    def dealt(df: DataFrame, n: int) -> DataFrame:
        number = F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
        return df.withColumn("block", F.when(F.col("wide"), -1 - number).otherwise(number))  # wide rows apart

    index = dealt(index_rows, n_blocks).groupBy("dims", "block").applyInPandas(build, "dims int, block int, bits int, ids binary, base array<string>, valid binary, slices binary")
    index = materialise(index, "bsi-index")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        matrix = np.stack(pdf["v"].to_numpy())
        return pd.DataFrame([{"dims": pdf["dims"].iloc[0], "asked": pdf["block"].iloc[0], "query_ids": pdf["id"].to_numpy(np.int64).tobytes(), "queries": matrix.tobytes()}])

    packed = dealt(asked, n_asked).groupBy("dims", "block").applyInPandas(pack, "dims int, asked int, query_ids binary, queries binary")
    packed = materialise(packed, "bsi-queries")

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "query_row": [], "id": [], "score": []}
        if len(left) and len(right):
            b, q = left.iloc[0], right.iloc[0]
            ids, valid, base = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["valid"], np.uint64), [int(x) for x in b["base"]]
            slices = np.frombuffer(b["slices"], np.uint64).reshape(len(base), int(b["bits"]), len(valid))
            both = np.concatenate([slices, ~slices])
            query_ids = np.frombuffer(q["query_ids"], np.int64)
            for n, (query_id, query) in enumerate(zip(query_ids, integers(np.frombuffer(q["queries"], np.float64).reshape(len(query_ids), -1)))):
                found, score = block_top(both, base, valid, ids, query_id, query, k)
                if any(not -(2**63) <= x < 2**63 for x in score):
                    raise OverflowError(f"a score of query {query_id} does not fit a long")
                out["query_id"] += [query_id] * len(score)
                out["query_row"] += [int(q["asked"]) << 32 | n] * len(score)
                out["id"] += found.tolist()
                out["score"] += score
        return pd.DataFrame({c: pd.Series(v, dtype="int64") for c, v in out.items()})

    # the cells are the blocks that exist, so a block of wide rows meets every query block too
    blocks, parts = index.select("dims", "block"), packed.select("dims", "asked")
    cells = blocks.join(parts, "dims")
    afresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  (columns that the other side hasn't)
    on_grid_rows, on_grid_asked = afresh(index.join(cells, ["dims", "block"])), afresh(packed.join(cells, ["dims", "asked"]))
    best = on_grid_rows.groupBy("dims", "block", "asked").cogroup(on_grid_asked.groupBy("dims", "block", "asked")).applyInPandas(cell, "query_id long, query_row long, id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
