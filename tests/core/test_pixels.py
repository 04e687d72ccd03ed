import numpy as np

from aerotally.operators import pixels as P


def test_metrics_of_flat_ramp_and_edge():
    assert P.cell_metrics(np.full((5, 5), 7.0)) == (0, 0, 0, 0)
    lap, grad, _, ten = P.cell_metrics(np.tile(np.arange(6.0), (6, 1)))
    assert (lap, grad, ten) == (0, 1, 64)
    assert P.cell_metrics(np.zeros((2, 9))) == (0, 0, 0, 0)


def test_files_to_cells(spark, tmp_path):
    r = np.random.default_rng(1)
    for n in ("a", "b"):
        (tmp_path / f"{n}.pgm").write_bytes(b"P5\n8 6\n255\n" + r.integers(0, 255, 48, np.uint8).tobytes())
    (tmp_path / "c.pgm").write_bytes(b"not an image")
    got = P.grid_metrics(P.grey_netpbm(spark, str(tmp_path)), 2, 2).collect()
    assert sorted((x.image_id, x.cell) for x in got) == [(n, c) for n in ("a.pgm", "b.pgm") for c in range(4)]
    assert all(x.laplacian_variance > 0 for x in got)
    bad = spark.createDataFrame([("x", 3, None), ("y", 3, [1.0, 2.0])], "image_id string, width int, pixels array<double>")
    assert P.grid_metrics(bad, 1, 1).count() == 0
