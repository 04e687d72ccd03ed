"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a word budget from its weight (a water-filling that stops at
``max_repeats`` times the source). A document's expected number of copies is
budget / source size; its whole part is certain, its fraction is rounded by the
pivotal method: two fractional documents exchange probability, weighted by their
sizes so that the expected words stay put, until one of them is 0 or 1. Each
task rounds one block of a source and is left with at most one fractional
document; these residuals meet in the blocks of the next level (a reduction tree
with a fan-in of ``BLOCK``) until one per source is left, which a coin decides.
So the words taken of a source differ from its target by at most the size of one
document, and each document's expected copies are exact.

Only (id, size, probability) rows are shuffled. Coins are hashes of the seed and
the document, rows are ordered by hash, so reruns agree. Rows that are alike are
counted, and the counted ones get numbers again, which their hashes include: so a
block has about ``BLOCK`` rows even where one row makes up a third of the table.

Defined results: null texts and texts without words have size 0 and are taken
whole parts only (0 words); texts of any length are counted whole; a null source
is a source of its own and sorts last; repeated rows are rounded apart; equal
hashes are ordered by the rows' values; an empty table gives an empty result;
extra columns are ignored by :func:`mix_plan` and kept by :func:`mix`, unless
their names begin with ``_mix_``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from aerotally.operators.ranking import row_numbers
from aerotally.plans.storage import materialise

BLOCK = 1024
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MAX_REPEATS = 1.5, 2
_EPS = 1e-9


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """``(source, n_docs, source_size, target)`` from rows of ``(source, size)``.

    Targets divide ``share`` of all sizes by weight; one that passes
    ``max_repeats`` times its source stops there and the rest is shared again by
    weight, until none passes. The loop runs on two sums per round; it ends
    because every round but the last stops at least one more source.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    per = row_numbers(per, [F.col("source").asc_nulls_last()], "_turn")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_turn") % len(weights) + 1).cast("int"))
    per = materialise(per.withColumn("weight", weight).drop("_turn").withColumn("cap", max_repeats * F.col("source_size").cast("double")), "mix-sources")
    budget = share * float(per.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        now = per.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("capped"), F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).alias("open"), F.sum(full.cast("int")).alias("n")).first()
        if not now.open or now.n == stopped:
            break
        level, stopped = (budget - now.capped) / now.open, now.n
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return per.withColumn("target", target).drop("weight", "cap")


def round_block(p: np.ndarray, size: np.ndarray, coins: np.ndarray) -> int:
    """Pivotal rounding in place: every p but at most one becomes 0 or 1. Returns that one's position, or -1.

    The pair (i, j) moves along the line where ``size_i p_i + size_j p_j`` is
    constant, to one of its two ends, with the odds that keep both expectations.
    """
    held = -1
    for j in range(len(p)):
        if p[j] <= _EPS or p[j] >= 1 - _EPS:
            p[j] = round(p[j])
            continue
        if held < 0:
            held = j
            continue
        i = held
        up = min((1 - p[i]) * size[i], p[j] * size[j])  # words that can go from j to i
        down = min(p[i] * size[i], (1 - p[j]) * size[j])
        move = up if coins[j] * (up + down) < down else -down
        p[i] += move / size[i]
        p[j] -= move / size[j]
        loose = []
        for x in (i, j):
            if p[x] <= _EPS or p[x] >= 1 - _EPS:
                p[x] = round(p[x])
            else:
                loose.append(x)
        held = loose[0] if loose else -1
    return held


def numbered(rows: DataFrame, times: str, name: str) -> DataFrame:
    """Every row ``times`` times, with ``name`` from 0; a large number is dealt over tasks, ``BLOCK`` at once."""
    count = F.col(times)
    chunks = rows.withColumn("_mix_chunk", F.explode(F.sequence(F.lit(0), F.floor((count - 1) / BLOCK))))
    keys = [F.col(f"`{c}`") for c in rows.columns if c != times]
    large = chunks.where(count > BLOCK)
    spread = large.repartition(F.xxhash64("_mix_chunk", *keys))
    first = F.col("_mix_chunk") * BLOCK
    number = F.explode(F.sequence(first, F.least(first + BLOCK, count) - 1))
    one = lambda df: df.withColumn(name, number).drop(times, "_mix_chunk")
    return one(chunks.where(count <= BLOCK)).unionByName(one(spread))


def mix_plan(rows: DataFrame, *, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """``(row_id, source, size, n_docs, source_size, target, copies)`` from ``(row_id, source, size)``.

    ``row_id`` is any string that names the row; rows with equal ones are rounded apart.
    """
    alike = rows.select("row_id", "source", F.col("size").cast("long").alias("size")).groupBy("row_id", "source", "size").agg(F.count("*").alias("_mix_times"))
    rows = materialise(numbered(alike, "_mix_times", "_mix_number"), "mix-rows")
    targets = materialise(source_targets(rows, weights=weights, share=share, max_repeats=max_repeats), "mix-targets")
    named = targets.select(F.col("source").alias("_source"), "n_docs", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("expected"))
    joined = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor(F.col("expected") + _EPS)
    fraction = F.greatest(F.lit(0.0), F.col("expected") - whole)
    n_blocks = F.ceil(F.col("n_docs") / F.lit(BLOCK))
    state = joined.select(
        "row_id", "source", "size", "n_docs", "source_size", "target", whole.cast("int").alias("whole"),
        F.when(F.col("size") > 0, fraction).otherwise(0.0).alias("p"),
        F.xxhash64(F.lit(seed), "row_id", "source", "size", "_mix_number").alias("draw"), n_blocks.alias("n_blocks"),
    )
    blocks = state.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "draw"), "n_blocks"))
    most = targets.agg(F.max(F.ceil(F.col("n_docs") / F.lit(BLOCK)))).first()[0] or 1
    schema = "row_id string, source string, size long, n_docs long, source_size long, target double, whole int, p double, draw long, n_blocks long, block long, done boolean"

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "row_id", "size"], kind="stable").reset_index(drop=True)
        p, last = pdf["p"].to_numpy(np.float64).copy(), int(pdf["n_blocks"].iloc[0]) <= 1
        rng = np.random.default_rng([seed, int(pdf["draw"].iloc[0]) & (2**63 - 1), int(pdf["n_blocks"].iloc[0])])
        held = round_block(p, pdf["size"].to_numpy(np.float64), rng.random(len(p)))
        if last and held >= 0:
            p[held] = float(rng.random() < p[held])
            held = -1
        pdf["p"] = p
        pdf["done"] = np.arange(len(p)) != held
        return pdf[[c.split()[0] for c in schema.split(", ")]]

    settled = None
    while True:
        level = materialise(blocks.groupBy("source", "block").applyInPandas(settle, schema), "mix-level")
        settled = level.where("done") if settled is None else settled.unionByName(level.where("done"))
        if most <= 1:
            break
        most = -(-most // BLOCK)
        fewer = F.ceil(F.col("n_blocks") / F.lit(BLOCK)).cast("long")
        blocks = level.where("not done").withColumn("n_blocks", fewer).withColumn("block", F.floor(F.col("block") / F.lit(BLOCK)).cast("long")).drop("done")
    return settled.select("row_id", "source", "size", "n_docs", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", **parameters) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it.

    A row is named by a hash of all its columns, so rows repeated whole share
    their names; they get the copies of their group, dealt out evenly.
    """
    name = F.concat_ws("-", F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])), F.hex(F.hash(*[F.col(f"`{c}`") for c in docs.columns])))
    rows = docs.select(name.alias("row_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"))
    plan = mix_plan(rows, **parameters).groupBy("row_id").agg(F.sum("copies").alias("_mix_copies"), F.count("*").alias("_mix_rows"))
    plan = materialise(plan.where("_mix_copies > 0"), "mix-copies").withColumnRenamed("row_id", "_mix_id")
    named = docs.withColumn("_mix_name", name)
    mine = [F.col(f"`{c}`") for c in docs.columns]
    single = named.join(plan.where("_mix_rows = 1"), F.col("_mix_name") == F.col("_mix_id"))
    taken = single.withColumn("_mix_turn", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
    out = taken.select(*mine)
    twins = plan.where("_mix_rows > 1")
    if twins.isEmpty():
        return out
    # rows repeated whole are alike, so one of them may stand for all copies of its group
    one_each = named.join(twins, F.col("_mix_name") == F.col("_mix_id"), "left_semi").dropDuplicates(["_mix_name"])
    again = one_each.join(twins.drop("_mix_rows"), F.col("_mix_name") == F.col("_mix_id")).drop("_mix_id")
    return out.unionByName(numbered(again, "_mix_copies", "_mix_turn").select(*mine))
