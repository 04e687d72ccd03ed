"""PIX1: sharpness, gradient, contrast and Tenengrad per grid cell of images, as an Arrow-batched job over decoded pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

METRICS = ("laplacian_variance", "gradient_magnitude", "local_contrast", "tenengrad")


def _shifted(p: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The inner pixels' neighbours at an offset."""
    return p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx]


def cell_metrics(p: np.ndarray) -> tuple[float, float, float, float]:
    """The values of :data:`METRICS` of one cell; zeros where it is smaller than 3 x 3."""
    if min(p.shape) < 3:
        return 0.0, 0.0, 0.0, 0.0
    s = lambda dy, dx: _shifted(p, dy, dx)
    laplace = s(-1, 0) + s(1, 0) + s(0, -1) + s(0, 1) - 4 * s(0, 0)
    gx, gy = (s(0, 1) - s(0, -1)) / 2, (s(1, 0) - s(-1, 0)) / 2
    sx = s(-1, 1) + 2 * s(0, 1) + s(1, 1) - s(-1, -1) - 2 * s(0, -1) - s(1, -1)
    sy = s(1, -1) + 2 * s(1, 0) + s(1, 1) - s(-1, -1) - 2 * s(-1, 0) - s(-1, 1)
    return float(laplace.var()), float(np.sqrt(gx * gx + gy * gy).mean()), float(p.std()), float((sx * sx + sy * sy).mean())


def grid_metrics(images: DataFrame, rows: int, cols: int, *, id: str = "image_id", width: str = "width", pixels: str = "pixels") -> DataFrame:
    """One row per (image, cell) from row-major grey pixels; the last row and column of cells take the rest.

    A null image or one whose pixels don't fill its width gives no cells.
    """
    kind = images.schema[id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, w, px in pdf.itertuples(index=False):
                if px is None or not w or len(px) % w or not len(px):
                    continue
                p = np.asarray(px, np.float64).reshape(-1, int(w))
                ys, xs = (np.linspace(0, n, k + 1).astype(int) for n, k in ((p.shape[0], rows), (p.shape[1], cols)))
                out += [(i, r * cols + c, *cell_metrics(p[ys[r] : ys[r + 1], xs[c] : xs[c + 1]])) for r in range(rows) for c in range(cols)]
            yield pd.DataFrame(out, columns=[id, "cell", *METRICS])

    return images.select(id, width, pixels).mapInPandas(run, f"{id} {kind}, cell long, " + ", ".join(f"{m} double" for m in METRICS))


def grey_netpbm(spark: SparkSession, folder: str) -> DataFrame:
    """``(image_id, width, pixels)`` of binary 8-bit greymaps (P5), the one raster format that needs no codec; others give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, data in pdf.itertuples(index=False):
                head = data.split(None, 4)[:4] if data[:2] == b"P5" else []
                if len(head) == 4 and head[3].startswith(b"255"):
                    w, h = int(head[1]), int(head[2])
                    out.append((path, w, np.frombuffer(data[len(data) - w * h :], np.uint8).astype(np.float64)))
            yield pd.DataFrame(out, columns=["image_id", "width", "pixels"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pgm").load(folder)
    return files.select("path", "content").mapInPandas(run, "image_id string, width long, pixels array<double>").withColumn("image_id", F.element_at(F.split("image_id", "/"), -1))
