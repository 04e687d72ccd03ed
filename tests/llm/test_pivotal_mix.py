import re
from collections import Counter

import numpy as np

from aerotally.llm import pivotal_mix as pm
from pyspark.sql import functions as F


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            return full
        rest = (budget - sum(full.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] >= 2 * sizes[s]]
        if not over:
            return full | {s: rest * weight[s] for s in open_}
        full |= {s: 2 * sizes[s] for s in over}


def corpus():
    docs = [(i, "word " * (i * 7 % 90), ["a", "b", "É", "z", None][min(4, i % 11)]) for i in range(3000)]
    return docs + [(5, "same words here", "b")] * 40 + [(9001, None, "a"), (9002, " \n", "q"), (None, "x y", "a")]


def plan(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = df.select(F.col("doc_id").cast("string").alias("row_id"), "source", pm.n_words(F.col("text")).alias("size"))
    return pm.mix_plan(rows, **kw).collect()


def test_targets_copies_and_reruns(spark, monkeypatch):
    monkeypatch.setattr(pm, "BLOCK", 16)
    docs = corpus()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += size(t)
    want = slow_targets(dict(sizes))
    got = plan(spark, docs)
    assert Counter((r.row_id, r.source, r["size"]) for r in got) == Counter((None if d is None else str(d), s, size(t)) for d, t, s in docs)
    taken = Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r["size"]
    assert all(abs(taken[s] - want[s]) <= 90 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, plan(spark, docs)))


def test_rounding_keeps_expectations_and_words():
    rng = np.random.default_rng(4)
    size = np.array([5.0, 1, 8, 3, 2, 40])
    p0 = np.array([0.3, 0.5, 0.25, 0.9, 0.4, 0.2])
    total = np.zeros(6)
    for _ in range(4000):
        p = p0.copy()
        held = pm.round_block(p, size, rng.random(6))
        assert abs(size @ p - size @ p0) < 1e-6
        assert all(x in (0, 1) for i, x in enumerate(p) if i != held)
        if held >= 0:
            p[held] = rng.random() < p[held]
        total += p
    assert abs(total / 4000 - p0).max() < 0.03


def test_mix_repeats_rows(spark):
    docs = [(i, "word " * (1 + i % 40), "ab"[i % 2], 0.5, "t") for i in range(400)] + [(1, "same", "a", 0.5, "t")] * 9
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, copies double, row_id string")
    out = pm.mix(df)
    assert out.columns == df.columns
    seen = Counter(map(tuple, out.collect()))
    assert all(n <= 2 for row, n in seen.items() if row[1] != "same") and seen[docs[-1]] <= 18
    words = sum(n * len(row[1].split()) for row, n in seen.items())
    assert abs(words - 1.5 * sum(len(d[1].split()) for d in docs)) <= 80


def test_a_hot_row_is_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(pm, "BLOCK", 16)
    alike = spark.createDataFrame([("hot", 100), ("one", 1), ("sixteen", 16), ("seventeen", 17)], "id string, times long")
    got = Counter((r.id, r.n) for r in pm.numbered(alike, "times", "n").collect())
    assert got == Counter((i, n) for i, t in (("hot", 100), ("one", 1), ("sixteen", 16), ("seventeen", 17)) for n in range(t))
    seen = []
    keep = pm.round_block
    monkeypatch.setattr(pm, "round_block", lambda p, size, coins: seen.append(len(p)) or keep(p, size, coins))
    docs = [(None, "same words here", "b")] * 900 + [(i, "w " * (i % 9), "a") for i in range(60)]
    got = plan(spark, docs)
    assert len(got) == len(docs) and abs(sum(r.copies * r["size"] for r in got) - sum({r.source: r.target for r in got}.values())) < 20


def test_very_long_text_and_extra_columns(spark):
    docs = [(i, "word " * (200_000 if i == 3 else 4), "a", "x", "y") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, _turn string, `a.b` string")
    out = pm.mix(df)
    assert out.columns == df.columns and all(tuple(r)[3:] == ("x", "y") for r in out.collect())


def test_empty(spark):
    assert plan(spark, []) == []
    assert pm.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
