"""Exact quantiles of groups of any size, all groups at once.

Values are counted before anything else, counts are summed along the groups in
the order of values (by ranges, so a group is spread over tasks), and a quantile
is read off where the sum passes its place. No group is held in a buffer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from aerotally.operators.ranking import running_sums
from aerotally.plans.storage import materialise


def grouped_quantiles(rows: DataFrame, keys: Sequence[str], value: Column, wanted: Mapping[str, float]) -> DataFrame:
    """``(*keys, *wanted)``: interpolated quantiles of ``value``, as ``percentile`` gives them; null values don't count.

    A group without values has no row; without keys there is one row, or none.
    Null keys are groups.
    """
    keys = list(keys)
    counts = rows.select(*keys, value.cast("double").alias("_q_value")).where("_q_value is not null").groupBy(*keys, "_q_value").agg(F.count("*").alias("_q_n"))
    counts = materialise(counts, "quantile-counts")
    summed = running_sums(counts, keys, [F.col("_q_value")], {"_q_to": F.col("_q_n")})
    totals = counts.groupBy(*keys).agg(F.sum("_q_n").alias("_q_total"))
    if keys:
        named = totals.select(*[F.col(k).alias(f"_q_key{i}") for i, k in enumerate(keys)], "_q_total")
        placed = summed.join(named, [F.col(k).eqNullSafe(F.col(f"_q_key{i}")) for i, k in enumerate(keys)])
    else:
        placed = summed.crossJoin(F.broadcast(totals))  # one row
    at = {name: (F.col("_q_total") - 1) * F.lit(float(q)) for name, q in wanted.items()}
    ends = [F.min(F.when(F.col("_q_to") > f(p), F.col("_q_value"))).alias(f"_q_{end}_{name}") for name, p in at.items() for end, f in (("low", F.floor), ("high", F.ceil))]
    found = placed.groupBy(*keys).agg(F.max("_q_total").alias("_q_total"), *ends)

    def between(name: str) -> Column:
        p, low, high = at[name], F.col(f"_q_low_{name}"), F.col(f"_q_high_{name}")
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high).alias(name)

    return found.where("_q_total > 0").select(*keys, *[between(name) for name in wanted])
