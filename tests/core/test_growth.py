"""What queries do where tables have grown: no broadcasts by file sizes, no group per key and chunk, no list of all pairs."""

import datetime as dt
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerotally.functions import polygons as P
from aerotally.operators import flights, matching, spatial, tiling
from aerotally.operators.spatial import range_join
from aerotally.sources import writers

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_range_join_broadcasts_no_side(spark):
    left = spark.createDataFrame([(1, 1.0, 2.0)], "a long, l_x double, l_y double")
    right = spark.createDataFrame([(7, 1.5, 2.0), (8, 30.0, 2.0)], "b long, r_x double, r_y double")
    found = range_join(left, right, 1.0)
    assert "Broadcast" not in plan(found)
    assert [(r.a, r.b) for r in found.collect()] == [(1, 7)]


def test_expert_matching_broadcasts_the_experts_only(spark):
    import __spark_entry__ as entry

    text = plan(entry.queries()["EV7"](spark, SF))
    assert "BroadcastHashJoin" not in text  # the few experts are a nested loop
    assert "SortMergeJoin" in text


def test_expert_matching_repeats_no_mark_for_the_experts(spark, tmp_path):
    """300 experts, one mark each, and 300 marks of role gt: the counts are the SQL's and no 90,000 rows are made."""
    import duckdb

    import __spark_entry__ as entry

    day = dt.datetime(1998, 1, 1)
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    rows = [(2 * k + j, 7 + k + j, 1 + k % 3, 1, 1.0, float(3 * k + j), 0.0, 0.0, f"e{k % 150}" if j else "A", "F" if j else "O", day) for k in range(300) for j in (0, 1)]
    rows += [(9000 + k, 7 + k, 1 + k % 3, 1, 1.0, float(3 * k + k % 2), 0.0, 0.0, f"e{k + 150}", "F", day) for k in range(150)]
    spark.createDataFrame(rows, line).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = entry.queries()["EV7"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()["EV7"])
    got = found.select(*want.columns).collect()
    assert len(got) == 300 and sum(r.tp for r in got) > 0
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
    assert plan(found).count("BroadcastNestedLoopJoin") == 1  # the number of gt


def test_jn2_measures_along_x_as_its_sql_does(spark, tmp_path):
    """Orders of a million places get added labels that are known ones, with another y."""
    import duckdb

    import __spark_entry__ as entry

    day = dt.datetime(1998, 1, 1)
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    rows = [(k, 7, 1 + k % 3, 1, 1.0, 1.0, 0.0, 0.0, "A", "O", day) for k in (4, 1000004, 9, 1000009, 25, 1000025, 12, 1000012)]
    spark.createDataFrame(rows, line).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame([(r[0], 1, "O", 1.0, day, "5-LOW") for r in rows], orders).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted((r.label, r.distance) for r in entry.queries()["JN2"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(entry.oracle_sql()["JN2"]).fetchall())


def test_shares_of_a_stratum_are_decimal(spark):
    """0.7 * 10 * k and 0.2 * 5 * k fall short of whole numbers as doubles for some k."""
    wrong = [n for n in range(1, 3000) if int(n * 0.7) != n * 7 // 10 or int(n * 0.2) != n * 2 // 10]
    n = wrong[0]
    items = spark.range(n).select(F.col("id"), F.lit("a").alias("stratum"))
    got = {r.part: r["count"] for r in tiling.three_way_split(items, "stratum", "id", 0.7, 0.2).groupBy("part").count().collect()}
    assert (got["train"], got["val"]) == (n * 7 // 10, n * 2 // 10)


def test_hulls_of_small_groups_share_batches(spark):
    rows = [(k, float(x), float(y)) for k in range(300) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3), (2, 1))]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    found = flights.hull_area(df, ["k"])
    assert "FlatMapGroupsInPandas" not in plan(found)
    assert {(r.hull_area, r.centre_x, r.centre_y, r.corners) for r in found.collect()} == {(12.0, 2.0, 1.5, 4)}
    parted = flights.hull_area(df.withColumn("k", F.lit(None).cast("long")).withColumn("x", F.col("x") + F.rand(1)), ["k"], most=100)
    assert parted.count() == 1  # chunks of a group come together again, a null one too


def test_ridges_are_not_split(monkeypatch):
    calls = []
    real = P._distance
    monkeypatch.setattr(P, "_distance", lambda p, ring: calls.append(len(p)) or real(p, ring))
    ring = np.array([(0, 0), (50, 0), (50, 400), (0, 400)], float)
    x, y = P.pole(ring)
    assert real(np.array([(x, y)]), ring)[0] == pytest.approx(25, abs=0.01)
    assert sum(calls) < 500
    rng = np.random.default_rng(4)
    for _ in range(30):
        turn = np.sort(rng.random(rng.integers(3, 9))) * 2 * np.pi
        ring = np.column_stack([np.cos(turn), np.sin(turn)]) * rng.uniform(5, 60, len(turn))[:, None]
        grid = np.stack(np.meshgrid(*[np.linspace(ring[:, i].min(), ring[:, i].max(), 120) for i in (0, 1)]), -1).reshape(-1, 2)
        assert real(np.array([P.pole(ring)]), ring)[0] >= real(grid, ring).max() - 0.0101


def test_an_image_of_few_features_is_one_document(spark, tmp_path):
    df = spark.range(400).select((F.col("id") % 20).alias("image"), F.col("id"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    writers.write_feature_collections(df, f"{tmp_path}/out", ["id"], "image", per_document=50)
    files = [f for _, _, names in os.walk(f"{tmp_path}/out") for f in names if f.endswith(".json")]
    assert len(files) == 20


@pytest.mark.parametrize("missing", [False, True])
def test_height_contrast_writes_no_pairs(spark, monkeypatch, missing):
    """Cells show a row at first, so that rows are searched for again; as by brute force."""
    from aerotally.operators import extremes

    rng = np.random.default_rng(3)
    rows = [(i, "ABC"[i % 3], None if missing and i % 4 else float(rng.integers(0, 6)), float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 9, (240, 2)))]
    rows += [(1000, "A", 2.0, 500.0, 500.0), (1001, "B", 9.0, 503.0, 504.0), (1002, None, 1.0, 1.0, 1.0), (1003, "C", 1.0, None, 1.0)]
    monkeypatch.setattr(spatial, "range_join", None)
    monkeypatch.setattr(extremes, "MORE", 3)
    monkeypatch.setattr(extremes.first_within, "__kwdefaults__", {"shown": 1})
    got = {(r.s, r.e1): (r.o, r["diff"]) for r in spatial.height_contrast(spark.createDataFrame(rows, "shot long, expedition string, height double, x double, y double"), 5.0).collect()}
    want = {}
    for s, e0, h0, x0, y0 in rows:
        for o, e1, h1, x1, y1 in rows:
            if None not in (x0, x1, e0, e1) and e0 != e1 and (x0 - x1) ** 2 + (y0 - y1) ** 2 <= 25:
                diff = None if h0 is None or h1 is None else abs(h0 - h1)
                want.setdefault((s, e1), []).append((-1 if diff is None else diff, -o, diff))
    assert got == {k: (-max(v)[1], max(v)[2]) for k, v in want.items()}


def _copies(spark):
    boxes = [(i, 10.0 * (i % 3), 0.0, 10.0 * (i % 3) + 11, 5.0, "tv"[i % 2]) for i in range(60)]
    return spark.createDataFrame([*boxes, (90, 3.0, 3.0, 1.0, 1.0, "t"), (91, 3.0, 3.0, 1.0, 1.0, "v"), (92, None, 3.0, 1.0, 1.0, "v")], "id long, x1 double, y1 double, x2 double, y2 double, part string")


def _counted(monkeypatch):
    found, real = [], spatial.rectangle_pairs
    monkeypatch.setattr(spatial, "rectangle_pairs", lambda *a, **k: found.append(real(*a, **k)) or found[-1])
    return found


def test_copies_of_boxes_overlap_by_their_number(spark, monkeypatch):
    pairs = _counted(monkeypatch)
    got = spatial.overlaps_between(_copies(spark), "part", 8.0).collect()
    by = {(p, c): sum(1 for i in range(60) if i % 3 == c and "tv"[i % 2] == p) for p in "tv" for c in range(3)}
    same = sum(by["t", c] * by["v", c] for c in range(3))
    beside = sum(by["t", a] * by["v", b] for a in range(3) for b in range(3) if abs(a - b) == 1)
    assert [(r.part_a, r.part_b, r.pairs, r.area) for r in got] == [("t", "v", same + beside, 55.0 * same + 5.0 * beside)]
    assert pairs[0].count() < 20


def test_copies_of_boxes_are_one_component(spark, monkeypatch):
    pairs = _counted(monkeypatch)
    got = {r.id: r.component for r in spatial.rectangle_groups(_copies(spark), 8.0, 0.5).collect()}
    assert got == {**{i: 0 for i in range(60)}, 90: 90, 91: 91, 92: 92}
    assert pairs[0].count() < 5


def test_one_image_of_many_equal_marks_matches_by_spots(spark, monkeypatch):
    rng = np.random.default_rng(8)
    def side(n):
        return spark.createDataFrame([(1, int(i), float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 6, (n, 2)))], "image long, id long, x double, y double")
    gt, pred = side(300), side(280)
    want = {tuple(r) for r in matching.match_greedy(gt, pred, 2.0).collect()}
    made, real = [], matching.candidates
    monkeypatch.setattr(matching, "candidates", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    assert {tuple(r) for r in matching.match_greedy(gt, pred, 2.0, crowded=True).collect()} == want
    assert made[0].count() <= 36 * 13


def test_points_meet_the_cells_within_eps_in_one_block(spark):
    from aerotally.operators import density

    rng = np.random.default_rng(5)
    at = rng.uniform(-20, 20, (150, 2)).tolist()
    rows = spark.createDataFrame([(i, 2.25, x, x, y, y) for i, (x, y) in enumerate(at)], "i long, eps2 double, a_x1 double, a_x2 double, a_y1 double, a_y2 double")
    cells = rows.select("eps2", F.col("i").alias("j"), *[F.col(f"a_{c}").alias(f"b_{c}") for c in density._BOX])
    got = sorted((r.i, r.j) for r in density._meet(rows, cells, []).select("i", "j").collect())
    assert got == sorted((i, j) for i, a in enumerate(at) for j, b in enumerate(at) if (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= 2.25)


def test_views_are_dealt_by_the_size_of_their_tables(spark, monkeypatch):
    """Tasks sort no more rows than ROWS_PER_PART on the average, whatever the number of shuffle partitions; results stay."""
    import __spark_entry__ as entry
    from aerotally.plans import views

    names = ["SET6", "AGG11", "AGG17", "FIL8", "AGG14", "SET8", "JN3", "SET10", "FIL10_random"]
    run = lambda name: sorted(map(str, entry.queries()[name](spark, SF).collect()))
    want = {name: run(name) for name in names}
    monkeypatch.setattr(views, "ROWS_PER_PART", 500)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert f"hashpartitioning(l_orderkey#0, {-(-lines // 500)})" in re.sub(r"#\d+L?", "#0", plan(views.Views(spark, SF).annotations))
    assert {name: run(name) for name in names} == want


def test_a_large_sample_of_images_is_not_taken_by_a_limit(spark, monkeypatch):
    from aerotally.operators import annotations

    images = spark.range(500).select(F.col("id").alias("image"), (F.col("id") % 7).alias("n_labels"))
    run = lambda n, mode: annotations.sample_images(images, n, mode)
    want = {(n, mode): sorted(map(tuple, run(n, mode).collect())) for n, mode in ((0.3, "percentage"), (40, "ordered_desc"))}
    monkeypatch.setattr(annotations, "MOST_TAKEN", 20)
    for (n, mode), rows in want.items():
        assert "Limit" not in plan(run(n, mode)) and "TakeOrdered" not in plan(run(n, mode))
        assert sorted(map(tuple, run(n, mode).collect())) == rows


def test_products_of_two_blocks_stay_small(spark):
    """A worker holds a block's rows (two ids and a cosine) some five times."""
    from aerotally.operators import clustering

    assert clustering.ROWS_PER_BLOCK**2 * 24 * 5 < 50e6
    rng = np.random.default_rng(9)
    v = rng.normal(size=(1300, 4))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r.a, r.b): r.cosine for r in clustering.similarity(rows, rows.where("vec_id % 50 = 0")).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    assert len(got) == 1300 * 26
    assert all(abs(c - unit[a] @ unit[b]) < 1e-9 for (a, b), c in got.items())


def test_only_rings_across_an_edge_are_cut_in_python(spark):
    rng = np.random.default_rng(12)
    rings = [rng.uniform(-30, 130, 2) + rng.uniform(-40, 40, (rng.integers(3, 7), 2)) for _ in range(300)]
    rings += [np.zeros((0, 2)), np.full((2, 2), 50.0), np.array([(0, 0), (100, 0), (100, 80), (0, 80)], float), np.array([(np.nan, 5), (50, 6), (70, 7), (60, 30)], float)]
    df = spark.createDataFrame([(i, [tuple(p) for p in ring.tolist()]) for i, ring in enumerate(rings)] + [(-1, None)], "i int, ring array<struct<x:double,y:double>>")
    got = {r.i: r.c for r in df.select("i", P.clipped(F.col("ring"), F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(80.0)).alias("c")).collect()}
    assert got.pop(-1) is None
    for i, c in got.items():
        want = P.clip_ring(rings[i], 0.0, 0.0, 100.0, 80.0)
        assert (c is None and len(want) < 3) or np.array_equal(np.array([tuple(p) for p in c], float), want, equal_nan=True)
    ring = rings[0] * 0 + 50
    decided = spark.createDataFrame([(0, [tuple(p) for p in ring.tolist()]), (1, [tuple(p) for p in (ring + 500).tolist()])], "i int, ring array<struct<x:double,y:double>>")
    text = P.clipped(F.col("ring"), F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(80.0))._jc.toString()
    assert "forall" in text and [r.c is None for r in decided.select(P.clipped(F.col("ring"), F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(80.0)).alias("c")).collect()] == [False, True]


def test_rings_are_cut_once_after_they_are_dealt(spark):
    import __spark_entry__ as entry

    text = plan(entry.queries()["FN20"](spark, SF))
    assert text.count("ArrowEvalPython") == 1
    assert text.index("ArrowEvalPython") < text.index("Exchange")  # plans are written from the result down


def test_a_curve_by_species_joins_pairs_to_nothing(spark):
    """Pairs bring scores and species along; ties, null species and images without ground truth as by brute force."""
    rng = np.random.default_rng(11)
    kinds = ["A", "B", None]
    g = [(int(rng.integers(0, 3)), i, float(rng.uniform(0, 40)), float(rng.uniform(0, 40)), kinds[i % 3]) for i in range(60)]
    p = [(int(rng.integers(0, 4)), i, float(rng.uniform(0, 40)), float(rng.uniform(0, 40)), kinds[i % 3], float(rng.integers(0, 10)) / 10) for i in range(80)]
    gt = spark.createDataFrame(g, "image long, id long, x double, y double, species string")
    pred = spark.createDataFrame(p, "image long, id long, x double, y double, species string, score double")
    levels = [0.0, 0.35, 0.6]
    curve = matching.pr_curve(gt, pred, 6.0, levels, by=["species"])
    joins = re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[[^\]]*", plan(curve))
    assert not any("pred_id" in j or "gt_id" in j for j in joins) and sum("_cx" in j for j in joins) == 1
    got = {(r.species, r.threshold): r.tp for r in curve.where("species is not null").collect()}
    for kind in "AB":
        for t in levels:
            claims = {}
            for image, i, x, y, s in g:
                near = [((int(x) - int(u)) ** 2 + (int(y) - int(v)) ** 2, j) for im, j, u, v, k, c in p if im == image and k == s == kind and c >= t]
                if near and min(near)[0] <= 36:
                    claims[image, min(near)[1]] = 1
            assert got[kind, t] == len(claims)


def test_distances_of_an_image_are_taken_once_for_all_numbers_of_clusters(monkeypatch):
    from aerotally.operators import clustering

    class Counted:
        calls = 0

        def __getattr__(self, name):
            return getattr(np, name)

        def sqrt(self, v):
            self.calls += 1
            return np.sqrt(v)

    class Points:
        schema = {"image": type("Field", (), {"dataType": type("Long", (), {"simpleString": staticmethod(lambda: "long")})})}
        groupBy = lambda self, key: self
        applyInPandas = lambda self, run, schema: run

    counted = Counted()
    monkeypatch.setattr(clustering, "np", counted)
    rng = np.random.default_rng(2)
    run, centres = clustering.best_k(Points(), "image"), np.array([(0, 0), (900, 900)])
    import pandas as pd

    spots = centres[np.arange(600) % 2] + rng.uniform(0, 30, (600, 2))
    got = run(pd.DataFrame({"image": 7, "x": spots[:, 0], "y": spots[:, 1]}))
    assert got.to_dict("records") == [{"image": 7, "k": 2, "marks": 600}]
    assert counted.calls == 2  # blocks of 512 points
    assert run(pd.DataFrame({"image": 8, "x": [1.0, 2.0], "y": 1.0}))["k"].isna().all()


def test_components_share_batches_and_go_on_in_the_next(spark):
    rng = np.random.default_rng(6)
    points = [(i // 2 % 2, i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 30, (160, 2)))]
    gt, pred = (spark.createDataFrame(points[i::2], "image long, id long, x double, y double") for i in (0, 1))
    name, found = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    try:
        for size in (10000, 2):
            spark.conf.set(name, size)
            matched = matching.match_optimal(gt, pred, 3.0)
            assert "FlatMapGroupsInPandas" not in plan(matched)
            found.append(sorted((r.image, r.gt_id, r.pred_id) for r in matched.collect()))
    finally:
        spark.conf.set(name, before)
    assert found[0] == found[1] and len({m[1] for m in found[0]}) == len(found[0]) > 20


def test_rows_are_searched_for_in_flat_batches(spark, monkeypatch):
    """A task of the search holds what a block's cells show and a batch of rows, not lists of thousands; as by brute force in any batches."""
    from aerotally.operators import extremes

    plans, real = {}, extremes.materialise
    monkeypatch.setattr(extremes, "materialise", lambda df, label: plans.setdefault(label, plan(df)) and real(df, label))
    monkeypatch.setattr(extremes, "TOGETHER", 7)
    rng = np.random.default_rng(5)
    rows = [(i, "AB"[i % 2], float(rng.integers(0, 9)), float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 20, (150, 2)))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {r.s: (r.o, r["diff"]) for r in spatial.height_contrast(spark.createDataFrame(rows, "shot long, expedition string, height double, x double, y double"), 4.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {s: max((abs(h - k), -o) for o, f, k, u, v in rows if f != e and (x - u) ** 2 + (y - v) ** 2 <= 16) for s, e, h, x, y in rows if any(f != e and (x - u) ** 2 + (y - v) ** 2 <= 16 for _, f, _, u, v in rows)}
    assert got == {s: (-o, d) for s, (d, o) in want.items()}
    assert "MapInArrow" in plans["first-round"] and "collect_list" not in plans["first-round"] and "ArrowEvalPython" not in plans["first-round"]
