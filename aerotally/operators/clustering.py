"""CL3-CL9: standardised points for density clustering, k-means, PCA and similarity of feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

#: Vectors of each side that are multiplied at once; a Python worker holds their products several times.
ROWS_PER_BLOCK = 512


def standardised(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """CL3: x and y as z-scores (population deviation) of their group; a deviation of 0 counts as 1."""
    w = Window.partitionBy(*keys)
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / F.when(F.stddev_pop(c).over(w) > 0, F.stddev_pop(c).over(w)).otherwise(1.0)
    return points.withColumn("_zx", z("x")).withColumn("_zy", z("y")).withColumn("x", F.col("_zx")).withColumn("y", F.col("_zy")).drop("_zx", "_zy")


def _k_means(x: np.ndarray, y: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Each point's cluster after seeded k-means of 50 rounds at most; a cluster without points stays where it is."""
    first = np.random.default_rng(seed).choice(len(x), k, replace=False)
    cx, cy = x[first], y[first]
    for _ in range(50):
        dx, dy = x[:, None] - cx, y[:, None] - cy
        own = (dx * dx + dy * dy).argmin(1)
        n = np.bincount(own, minlength=k)
        mean = lambda v, c: np.where(n > 0, np.bincount(own, v, k) / np.maximum(n, 1), c)
        nx, ny = mean(x, cx), mean(y, cy)
        if all((np.abs(new - old) <= 1e-8 + 1e-5 * np.abs(old)).all() for new, old in ((nx, cx), (ny, cy))):
            break
        cx, cy = nx, ny
    return own


def best_k(points: DataFrame, key: str, max_count: int = 8, *, seed: int = 0) -> DataFrame:
    """CL4: per image the number of clusters of seeded k-means with the best silhouette; an image's marks are one group; distances are held for 512 of them at once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.unique(pdf[["x", "y"]].to_numpy(float), axis=0)
        x, y = p.T.copy()
        tried = range(2, min(len(p), max_count + 2))
        found = {k: _k_means(x, y, k, seed) for k in tried}
        sums = {k: np.empty((len(p), k)) for k in tried}  # of distances to each cluster, in blocks of rows
        for at in range(0, len(p), 512) if found else ():
            dx, dy = x[at : at + 512, None] - x, y[at : at + 512, None] - y
            d = np.sqrt(dx * dx + dy * dy)
            for k, own in found.items():
                sums[k][at : at + 512] = np.stack([d[:, own == i].sum(1) for i in range(k)], 1)
        best, top = None, -2.0
        for k, own in found.items():
            sizes = np.bincount(own, minlength=k)
            a = sums[k][np.arange(len(p)), own] / np.maximum(sizes[own] - 1, 1)
            other = np.where(np.arange(k)[None] == own[:, None], np.inf, sums[k] / np.maximum(sizes, 1))
            other[:, sizes == 0] = np.inf
            b = other.min(1)
            s = np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0).mean()
            if s > top:
                best, top = k, s
        return pd.DataFrame({key: [pdf[key].iloc[0]], "k": pd.array([best], "Int64"), "marks": [len(pdf)]})

    return points.groupBy(key).applyInPandas(run, f"{key} {points.schema[key].dataType.simpleString()}, k long, marks long")


def embedding_clusters(items: DataFrame, k: int, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", seed: int = 1) -> DataFrame:
    """CL5: k-means cluster, its majority class (ties to the smaller), whether the item agrees, and the cluster's confidence."""
    x = items.select(id, label, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    found = KMeans(k=k, seed=seed, maxIter=20).fit(x).transform(x).select(id, label, F.col("prediction").alias("cluster"))
    n = found.groupBy("cluster", label).agg(F.count("*").alias("n"))
    top = n.groupBy("cluster").agg(F.max_by(label, F.struct("n", -F.col(label))).alias("majority"), (F.max("n") / F.sum("n")).alias("confidence"))
    return found.join(top, "cluster").withColumn("correct", F.col(label) == F.col("majority"))


def misclassified(clusters: DataFrame, id: str = "vec_id") -> DataFrame:
    """CL6: items that disagree with their cluster, surest first."""
    return clusters.where("not correct").orderBy(F.desc("confidence"), id)


def components(items: DataFrame, k: int, *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """CL7: the first k principal components of each item."""
    x = items.select(id, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="pca").fit(x).transform(x).select(id, vector_to_array("pca").alias("pca"))


def contributions(items: DataFrame, k: int, *, vector: str = "embedding") -> DataFrame:
    """CL7: of each principal component, from 0, its share of the variance and the dimension that contributes most, with its loading's size; ties to the first dimension.

    The components come from one distributed covariance; a row per component is
    all that the driver holds.
    """
    x = items.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="pca").fit(x)
    loadings = np.abs(model.pc.toArray())
    top = loadings.argmax(0)
    rows = [(i, float(share), int(top[i]), float(loadings[top[i], i])) for i, share in enumerate(model.explainedVariance.toArray())]
    return items.sparkSession.createDataFrame(rows, "component int, explained double, dimension int, loading double")


def similarity(left: DataFrame, right: DataFrame, *, id: str = "vec_id", vector: str = "embedding", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """CL9: cosine similarity of each of ``left`` with each of ``right``, as ``(a, b, cosine)``; null where a vector is all zero.

    Both sides are dealt into blocks, and a task multiplies one block of each at
    a time, so neither side is sent whole. Null ids and vectors take no part, vectors of
    different lengths don't meet.
    """
    blocks = {}
    for side, rows in (("a", left), ("b", right)):
        some = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null").withColumn("dims", F.size("v"))
        n = max(1, -(-some.count() // rows_per_block))
        blocks[side] = n, some.withColumn(f"{side}_block", F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int"))
    (n_a, a), (n_b, b) = blocks["a"], blocks["b"]
    a = a.withColumn("b_block", F.explode(F.sequence(F.lit(0), F.lit(n_b - 1))))
    b = b.withColumn("a_block", F.explode(F.sequence(F.lit(0), F.lit(n_a - 1))))

    def multiply(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        u, v = np.stack(x["v"].to_numpy()).astype(float), np.stack(y["v"].to_numpy()).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = u @ v.T / np.outer(np.sqrt((u * u).sum(1)), np.sqrt((v * v).sum(1)))
        return pd.DataFrame({"a": np.repeat(x["id"].to_numpy(), len(y)), "b": np.tile(y["id"].to_numpy(), len(x)), "cosine": cosine.ravel()})

    keys = ["dims", "a_block", "b_block"]
    found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(multiply, "a long, b long, cosine double")
    return found.withColumn("cosine", F.when(~F.isnan("cosine"), F.col("cosine")))
