"""Row numbers over a whole table or its groups, without a window that puts a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerotally.plans.storage import materialise


def row_numbers(rows: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """``rows`` with ``name``: the row's number from 0 in the order of the whole table.

    Rows are dealt by ranges of the order and sorted within them; a row's number
    is its place there plus the rows of the ranges before, one count per range.
    ``order`` should tell all rows apart: rows that it doesn't are numbered in
    any order. Names that begin with ``_number_`` are reserved.
    """
    mine = [F.col(f"`{c}`") for c in rows.columns if c != name]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        *mine, F.spark_partition_id().alias("_number_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_number_at")
    )
    placed = materialise(placed, "row-numbers")  # so that a task that runs again gives the same places
    sizes = placed.groupBy("_number_part").agg(F.count("*").alias("n")).collect()  # one row per range
    before, starts = 0, []
    for part, n in sorted((r["_number_part"], r["n"]) for r in sizes):
        starts.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "_number_part int, _number_before long")
    numbered = placed.join(F.broadcast(offsets), "_number_part")  # one row per range
    return numbered.select(*mine, (F.col("_number_before") + F.col("_number_at")).alias(name))


def numbers_within(rows: DataFrame, group: list[str], order: list[Column], name: str = "n", size: str | None = None) -> DataFrame:
    """``rows`` with ``name``: the row's number from 0 within its group, and ``size``, the group's rows, if named.

    The table is numbered as a whole with its groups one after another, so a
    large group is spread over tasks. Null groups are groups.
    """
    numbered = row_numbers(rows, [*[F.col(f"`{g}`") for g in group], *order], "_number_all")
    first = numbered.groupBy(*[F.col(f"`{g}`") for g in group]).agg(F.min("_number_all").alias("_number_first"), F.count("*").alias("_number_size"))
    first = materialise(first.select(*[F.col(f"`{g}`").alias(f"_number_key{i}") for i, g in enumerate(group)], "_number_first", "_number_size"), "group-starts")
    same = [F.col(f"`{g}`").eqNullSafe(F.col(f"_number_key{i}")) for i, g in enumerate(group)]
    found = numbered.join(first, same)
    mine = [F.col(f"`{c}`") for c in rows.columns if c not in (name, size)]
    extra = [F.col("_number_size").alias(size)] if size else []
    return found.select(*mine, (F.col("_number_all") - F.col("_number_first")).alias(name), *extra)


def running_sums(rows: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each of ``sums``, the expression's sum from the group's first row to this one.

    Sums are taken on two levels: rows are dealt by ranges of group and order,
    each range sums its own rows of a group, and a group that goes on from an
    earlier range gets what it has summed up to there. A range has one such group
    at most, so those offsets are one row per range and the rows of a large group
    stay spread. A sum over no values is null, null values add nothing, null
    groups are groups; rows that ``order`` doesn't tell apart come in any order.
    Names that begin with ``_run_`` are reserved.
    """
    mine = [F.col(f"`{c}`") for c in rows.columns if c not in sums]
    by = [F.col(f"`{g}`") for g in group]
    values = [value.alias(f"_run_value{i}") for i, value in enumerate(sums.values())]
    placed = rows.select("*", *values).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).select(
        *mine, *[f"_run_value{i}" for i in range(len(sums))], F.spark_partition_id().alias("_run_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_run_at")
    )
    placed = materialise(placed, "running-sums")  # so that a task that runs again gives the same places
    blocks = placed.groupBy(*by, "_run_part").agg(*[F.sum(f"_run_value{i}").alias(f"_run_sum{i}") for i in range(len(sums))])
    parts = Window.partitionBy(*by).orderBy("_run_part")  # a row per range and group
    before = blocks.select("*", F.row_number().over(parts).alias("_run_nth"), *[F.sum(f"_run_sum{i}").over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_run_before{i}") for i in range(len(sums))])
    before = before.where("_run_nth > 1").select(F.col("_run_part").alias("_run_from"), *[g.alias(f"_run_key{i}") for i, g in enumerate(by)], *[f"_run_before{i}" for i in range(len(sums))])
    here = Window.partitionBy("_run_part", *by).orderBy("_run_at").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(f"_run_value{i}").over(here).alias(f"_run_local{i}") for i in range(len(sums))])
    same = [F.col("_run_part") == F.col("_run_from"), *[g.eqNullSafe(F.col(f"_run_key{i}")) for i, g in enumerate(by)]]
    found = local.join(F.broadcast(before), same, "left")  # one row per range at most
    some = lambda i: F.when(F.col(f"_run_local{i}").isNull(), F.col(f"_run_before{i}")).otherwise(F.col(f"_run_local{i}") + F.coalesce(f"_run_before{i}", F.lit(0)))
    return found.select(*mine, *[some(i).alias(name) for i, name in enumerate(sums)])


def dense_ids(rows: DataFrame, column: str, name: str, start: int = 1) -> DataFrame:
    """``(column, name)``: each distinct value that isn't null with its number in ascending order, from ``start``."""
    values = rows.select(F.col(f"`{column}`").alias(column)).where(F.col(f"`{column}`").isNotNull()).distinct()
    numbered = row_numbers(values, [F.col(f"`{column}`")], "_number_id")
    return numbered.select(F.col(f"`{column}`"), (F.col("_number_id") + start).alias(name))
