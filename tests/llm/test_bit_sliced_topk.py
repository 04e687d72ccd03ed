import math
import random

import numpy as np
import pytest

from aerotally.llm import bit_sliced_topk as bsi


def brute(rows, queries, k):
    ok = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v)
    quant = lambda v: [math.floor(256 * x) for x in v]
    out, seen = [], set()
    for q, qv in queries:
        if q is None or not ok(qv) or (q, tuple(quant(qv))) in seen:
            continue
        seen.add((q, tuple(quant(qv))))
        a = quant(qv)
        scored = [(-sum(x * y for x, y in zip(a, quant(v))), i) for i, v in rows if i is not None and ok(v) and len(v) == len(qv) and i != q]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def run(spark, rows, queries, k=5):
    schema = "vec_id long, embedding array<float>, rank string, score string"
    df = lambda x: spark.createDataFrame([(i, v, "r", "s") for i, v in x], schema)
    return sorted(tuple(r) for r in bsi.top_k(df(rows), df(queries), k=k).collect())


def test_matches_brute_force_with_ties_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(bsi, "ROWS_PER_BLOCK", 70)
    monkeypatch.setattr(bsi, "QUERIES_PER_BLOCK", 3)
    r = random.Random(5)
    vec = lambda: [float(np.float32(r.choice([r.uniform(-1, 1), 0.25, -0.25]))) for _ in range(6)]
    rows = [(i, vec()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(20)] + [(7, rows[7][1])]
    rows += [(2001, None), (2002, [1.0, None]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (2005, []), (None, vec()), (2006, [0.5, -3.0]), (2007, [0.0, 1.0])]
    queries = [x for x in rows if x[0] is not None and x[0] % 25 in (0, 7)]
    assert run(spark, rows, queries) == brute(rows, queries, 5)


def test_fewer_rows_than_k_and_empty(spark):
    rows = [(1, [0.5, 0.5]), (2, [-0.5, 1.0]), (3, [0.0, 0.0])]
    assert run(spark, rows, rows) == brute(rows, rows, 5)
    assert run(spark, [], []) == []


def test_slices_add_exactly():
    r = np.random.default_rng(0)
    for scale in (3, 200, 10**6):
        m = r.integers(-scale, scale, (130, 9))
        q = r.integers(-scale, scale, 9)
        slices, base, valid = bsi.slice_block(m)
        ids, score = bsi.block_top(np.concatenate([slices, ~slices]), base, valid, np.arange(130), -1, q, 130)
        assert (score == (m @ q)[ids]).all() and len(ids) == 130


def test_large_components_take_part(spark, monkeypatch):
    monkeypatch.setattr(bsi, "ROWS_PER_BLOCK", 4)
    rows = [(i, [float(i), 1.0]) for i in range(1, 12)] + [(50, [1.0, 2.0]), (60, [600000.0, 1.0])]
    assert run(spark, rows, rows, k=3) == brute(rows, rows, 3)
    rows += [(61, [-(2.0**54), 3.0]), (62, [2.0**54, -4.0]), (63, [0.0, 2.0**54]), (64, [2.0**54 + 2.0**31, 0.0])]
    queries = [(62, [2.0**-8, 0.0]), (97, [0.0, 2.0**-8]), (98, [-(2.0**-8), 0.0]), (99, [2.0**-8, 0.0])]
    assert run(spark, rows, queries, k=3) == brute(rows, queries, 3)


def test_score_beyond_a_long_raises(spark):
    rows = [(1, [1e18, 0.0]), (2, [1e18, 1.0])]
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, rows, rows)
