"""SP8: for every row the first of the others within a radius, in an order, without a list of near pairs.

Space is cut into small cells, of which each shows its first few rows in the
order and where the rest begin. A row goes through what the cells around it show
until something lies within the radius: a row ends its search, the rest of a cell
sends it to the next round, in which cells show more. Python gets flat rows, what
the cells around a block show and then the block's rows, so a task holds the former
and a batch of the latter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from aerotally.plans.storage import materialise

#: Cells in a radius, rows that a cell shows at first and how many times more in each round, rows of a block that one task searches for.
CELLS, SHOWN, MORE, TOGETHER = 4, 8, 8, 20_000
#: Kind of the rows that go to Python: a row that a cell shows, the rest of a cell, a row to search for.
ITEM, REST, ROW = 0, 1, 2
#: Rows that leave Python together.
RETURNED = 20_000


def first_hits(qx: np.ndarray, qy: np.ndarray, items: dict[str, np.ndarray], r: float) -> np.ndarray:
    """For every point the first item, in their order, that comes within r of it; -1 where none does."""
    found, open_ = np.full(len(qx), -1), np.arange(len(qx))
    limit = np.where(items["rest"], r * r * (1 + 1e-9), r * r)
    for start in range(0, len(limit), 64):
        x1, x2, y1, y2, most = (a[None, start : start + 64] for a in (items["x1"], items["x2"], items["y1"], items["y2"], limit))
        px, py = qx[open_][:, None], qy[open_][:, None]
        dx, dy = np.maximum(np.maximum(x1 - px, px - x2), 0), np.maximum(np.maximum(y1 - py, py - y2), 0)
        near = dx * dx + dy * dy <= most
        hit = near.any(1)
        found[open_[hit]] = start + near[hit].argmax(1)
        open_ = open_[~hit]
        if not len(open_):
            break
    return found


def _lists(items: list[pa.RecordBatch]) -> list[tuple[pa.Scalar, int, dict[str, np.ndarray]]]:
    """What cells show, in its order, by group and side."""
    if not items:
        return []
    table = pa.Table.from_batches(items).combine_chunks()
    groups = table["g"].combine_chunks().dictionary_encode()
    code, side = groups.indices.to_numpy(), table["side"].to_numpy()
    all_ = {k: table[c].to_numpy() for k, c in (("x1", "a"), ("x2", "b"), ("y1", "c"), ("y2", "d"), ("v", "v"), ("o", "n"))} | {"rest": table["kind"].to_numpy() == REST}
    place = np.lexsort((all_["o"], -all_["v"], side, code))
    ends = np.flatnonzero((np.diff(code[place], append=-1) != 0) | (np.diff(side[place], append=-9) != 0)) + 1
    found = []
    for at in np.split(place, ends[:-1]):
        found.append((groups.dictionary[int(code[at[0]])], int(side[at[0]]), {k: v[at] for k, v in all_.items()}))
    return found


def searcher(r: float, on: Sequence[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over flat rows that are sorted by ``on``, ``_part`` and ``kind``, for :func:`first_within`."""
    by = [*on, "_part"]

    def hits(rows: pa.RecordBatch, lists: list) -> Iterator[pa.RecordBatch]:
        for g, side, items in lists:
            others = rows.filter(pc.not_equal(rows["e"], g))
            hit = first_hits(others["a"].to_numpy(), others["b"].to_numpy(), items, r)
            some = np.flatnonzero(hit >= 0)
            rest, hit, of = items["rest"][hit[some]], hit[some], others.take(pa.array(some))
            columns = {"q": of["n"], "e": of["e"], "x": of["a"], "y": of["b"], "h": of["c"], "bx": of["bx"], "by": of["by"]}
            columns |= {"g": pa.repeat(g, len(some)), "side": pa.array(np.full(len(some), side, "int32"))}
            columns |= {"o": pa.array(np.where(rest, -1, items["o"][hit])), "v": pa.array(items["v"][hit], mask=rest)}  # o is never read where v is null
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items, lists, out = None, [], None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch["kind"].to_numpy() == ROW
            keys = [batch[c].to_numpy(zero_copy_only=False) for c in by]
            new = np.diff(row, prepend=not row[0])
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            starts = np.flatnonzero(new).tolist()
            for start, end in zip(starts, [*starts[1:], len(row)]):
                here = tuple(k[start] for k in keys)
                if here != key:
                    key, items, lists = here, [], None
                if not row[start]:
                    items.append(batch.slice(start, end - start))
                    continue
                if lists is None:
                    lists, items = _lists(items), []
                for found in hits(batch.slice(start, end - start), lists):
                    out.append(found)
                    if sum(o.num_rows for o in out) >= RETURNED:
                        yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                        out = []
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []

    return search


def first_within(rows: DataFrame, others: DataFrame, r: float, *, shown: int = SHOWN) -> DataFrame:
    """``(q, h, g, side, o, v)``: for each row (q, e, x, y, h) and each side of each group g other than e, the first of the others (g, side, v, o, x, y) within r, by v descending, then o.

    ``q`` and ``o`` are longs that tell rows apart. Rows without a finite point take no part.
    """
    finite = "abs(x) < double('infinity') and abs(y) < double('infinity')"
    small, block, reach = float(r) / CELLS, 2 * float(r) * (1 + 1e-6), float(r) * (1 + 1e-6)
    at = lambda c, side: F.floor(c / F.lit(side)).cast("long")
    here, kind = ["bx", "by"], others.schema["g"].dataType.simpleString()
    others = others.where(finite).withColumns({"mx": at(F.col("x"), small), "my": at(F.col("y"), small)})
    others = materialise(others, "first-others")
    open_ = rows.where(finite).withColumns({"bx": at(F.col("x"), block), "by": at(F.col("y"), block)})
    open_ = open_.withColumns({"e": F.col("e").cast(kind), "g": F.lit(None).cast(kind), "side": F.lit(None).cast("int")})
    on, done = here, None
    order = Window.partitionBy("g", "side", "mx", "my").orderBy(F.desc("v"), "o")
    none = lambda t: F.lit(None).cast(t)
    returned = f"q bigint, e {kind}, x double, y double, h double, bx bigint, by bigint, g {kind}, side int, o bigint, v double"

    while True:
        listed = others.withColumn("n", F.row_number().over(order)).where(F.col("n") <= shown + 1).withColumn("rest", F.col("n") > shown)
        low = lambda c, m: F.when(F.col("rest"), F.col(m) * small).otherwise(F.col(c))
        high = lambda c, m: F.when(F.col("rest"), (F.col(m) + 1) * small).otherwise(F.col(c))
        span = lambda a, b: F.explode(F.sequence(at(F.col(a) - reach, block), at(F.col(b) + reach, block)))
        items = listed.select("g", "side", "v", "o", "rest", low("x", "mx").alias("x1"), high("x", "mx").alias("x2"), low("y", "my").alias("y1"), high("y", "my").alias("y2"))
        items = items.withColumn("bx", span("x1", "x2")).withColumn("by", span("y1", "y2"))
        # a block of many rows is dealt into parts, each with what the cells around it show
        parts = open_.groupBy(*on).agg(F.ceil(F.count("*") / TOGETHER).cast("long").alias("_parts"))
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
        told = items.join(parts, on).withColumn("_part", each).select(*here, "g", "side", "_part", F.when(F.col("rest"), REST).otherwise(ITEM).alias("kind"), none(kind).alias("e"), F.col("o").alias("n"), F.col("x1").alias("a"), F.col("x2").alias("b"), F.col("y1").alias("c"), F.col("y2").alias("d"), "v")
        asked = open_.join(parts, on).select(*here, "g", "side", F.pmod(F.xxhash64("q"), F.col("_parts")).alias("_part"), F.lit(ROW).alias("kind"), "e", F.col("q").alias("n"), F.col("x").alias("a"), F.col("y").alias("b"), F.col("h").alias("c"), none("double").alias("d"), none("double").alias("v"))
        flat = told.unionByName(asked).repartition(*on, "_part").sortWithinPartitions(*on, "_part", "kind")
        each = materialise(flat.mapInArrow(searcher(float(r), on), returned), "first-round")
        now = each.where("v is not null").select("q", "h", "g", "side", "o", "v")
        done = now if done is None else done.unionByName(now)
        on = [*here, "g", "side"]
        open_ = each.where("v is null").select("q", "e", "x", "y", "h", *on)
        if open_.isEmpty():
            return done
        shown *= MORE


def first_by(rows: DataFrame, id: str, group: str, value: str, side: int) -> DataFrame:
    """Rows for :func:`first_within`: by value descending (1), ascending (-1) or by id alone (0, also those without a value)."""
    v: Column = F.lit(0.0) if side == 0 else F.col(value).cast("double") * side
    return rows.select(F.col(group).alias("g"), F.lit(side).alias("side"), v.alias("v"), F.col(id).cast("long").alias("o"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("g is not null and v is not null")
