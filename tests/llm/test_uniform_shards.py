import zlib
from collections import Counter

import numpy as np

from aerotally.llm import uniform_shards as us


def test_matrix_margins_and_law():
    m = us.communication_matrix([5, 0, 7, 3], us.shard_sizes(15, 4), 1)
    assert m.sum(1).tolist() == [5, 0, 7, 3] and m.sum(0).tolist() == [4, 4, 4, 3]
    draws = Counter(int(us.communication_matrix([2, 2], [2, 2], s)[0, 0]) for s in range(3000))
    want = {0: 1 / 6, 1: 4 / 6, 2: 1 / 6}  # of the six ways to choose two places of four
    assert all(abs(draws[k] / 3000 - p) < 0.04 for k, p in want.items())


def test_exact_sizes_and_gapless_slots(spark):
    docs = [(i, f"text {i}" * (i % 5)) for i in range(1003)] + [(7, "text 7" * 2)] * 200 + [(None, None)] * 50
    df = spark.createDataFrame([(*d, 99, "s") for d in docs], "doc_id long, text string, shard int, slot string").repartition(5)
    got = us.shard_documents(df, 16).collect()
    assert len(got) == len(docs)
    per = Counter(r.shard for r in got)
    assert set(per) == set(range(16)) and max(per.values()) - min(per.values()) <= 1
    for s, n in per.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_places_are_uniform(spark):
    df = spark.range(4000).repartition(3)
    seen = np.zeros((4, 4))
    for seed in range(4):
        for r in us.uniform_shards(df, 4, seed=seed).collect():
            seen[r.id * 4 // 4000, r.shard] += 1
    assert abs(seen / 4000 - 0.25 * 4 / 4).max() < 0.05
    got = us.uniform_shards(df, 1, seed=3).orderBy("slot").collect()
    order = np.array([r.id for r in got])
    assert abs(np.corrcoef(order, np.arange(4000))[0, 1]) < 0.08 and abs(np.corrcoef(order[1:], order[:-1])[0, 1]) < 0.08


def test_empty_and_fewer_rows_than_shards(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert us.shard_documents(empty).count() == 0
    few = us.uniform_shards(spark.range(3), 16).collect()
    assert sorted(r.shard for r in few) == [0, 1, 2] and {r.slot for r in few} == {0}


def test_native_plan(spark):
    plan = us.shard_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_extra_columns_of_any_name(spark):
    names = ["_rank", "_part", "_pos", "_again", "_bucket", "_before", "_bounds", "_n", "a.b"]
    df = spark.createDataFrame([(i, *[f"{n}{i}" for n in names]) for i in range(200)], ["id", *names]).repartition(3)
    got = us.uniform_shards(df, 3)
    assert got.columns == ["id", *names, "shard", "slot"]
    assert all(tuple(r)[1:-2] == tuple(f"{n}{r.id}" for n in names) for r in got.collect())
