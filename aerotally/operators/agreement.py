"""AG4-AG9, CF*, AGG18-AGG22: what annotators agree on, and count corrections from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from aerotally.operators.quantiles import grouped_quantiles
from aerotally.operators.ranking import numbers_within, row_numbers, running_sums


def dense_counts(marks: DataFrame, image: str = "image", user: str = "user_name") -> DataFrame:
    """Every (image, user) pair with its count, 0 where a user has none. Users are few: their list is what is broadcast."""
    n = marks.groupBy(image, user).agg(F.count("*").alias("n"))
    pairs = marks.select(image).distinct().crossJoin(marks.select(user).distinct())
    return pairs.join(n, [image, user], "left").fillna(0, ["n"])


def exact_agreement(counts: DataFrame, threshold: int) -> DataFrame:
    """AG4: images where at least ``threshold`` users give the same count: the modal count (ties to the smaller) and its frequency."""
    f = counts.groupBy("image", "n").agg(F.count("*").alias("users"))
    top = f.groupBy("image").agg(F.max_by("n", F.struct("users", -F.col("n"))).alias("count"), F.max("users").alias("users"))
    return top.where(F.col("users") >= threshold)


def tolerance_agreement(counts: DataFrame, tolerance: int, threshold: int) -> DataFrame:
    """AG5: the observed count that most users lie within the tolerance of (the smallest such)."""
    f = counts.groupBy("image", "n").agg(F.count("*").alias("users"))
    near = f.select("image", F.col("n").alias("centre")).join(f, "image").where(F.abs(F.col("n") - F.col("centre")) <= tolerance)
    total = near.groupBy("image", "centre").agg(F.sum("users").alias("users"))
    best = total.groupBy("image").agg(F.max_by("centre", F.struct("users", -F.col("centre"))).alias("centre"), F.max("users").alias("users"))
    return best.where(F.col("users") >= threshold)


def majority_agreement(counts: DataFrame) -> DataFrame:
    """AG6: the modal count, its frequency, and whether more than half of the users gave it."""
    all_users = counts.groupBy("image").agg(F.count("*").alias("n_users"))
    return exact_agreement(counts, 1).join(all_users, "image").withColumn("true_majority", F.col("users") * 2 > F.col("n_users"))


def pairwise(counts: DataFrame) -> DataFrame:
    """AG8: MAE and share of exact agreement of every pair of users."""
    a, b = counts.toDF("image", "user_a", "na"), counts.toDF("image", "user_b", "nb")
    d = F.abs(F.col("na") - F.col("nb"))
    return a.join(b, "image").where("user_a < user_b").groupBy("user_a", "user_b").agg(F.avg(d).alias("mae"), (F.avg((d == 0).cast("int")) * 100).alias("exact_pct"))


def disagreement(counts: DataFrame) -> DataFrame:
    """AG9: population deviation and range per image, in three classes."""
    s = counts.groupBy("image").agg(F.stddev_pop("n").alias("std"), (F.max("n") - F.min("n")).alias("spread"))
    return s.withColumn("level", F.when(F.col("spread") == 0, "none").when(F.col("spread") <= 2, "low").otherwise("high"))


def corrections(pairs: DataFrame) -> DataFrame:
    """CF5: per user the count ratio, OLS slope and intercept, median-ratio slope and four range ratios.

    ``pairs`` has (user_name, image, n, ref). Slopes use images with n > 0 and
    need two of them; otherwise they are the ratio.
    """
    n, c = F.col("n").cast("double"), F.col("ref").cast("double")
    some = F.col("n") > 0
    ratio = F.when(F.sum("n") > 0, F.sum("ref") / F.sum("n")).otherwise(1.0)
    enough = F.count(F.when(some, 1)) >= 2
    slope, intercept = F.regr_slope(F.when(some, c), F.when(some, n)), F.regr_intercept(F.when(some, c), F.when(some, n))

    def in_range(lo: int, hi: int) -> Column:
        rule = some & (F.col("n") >= lo) & (F.col("n") <= hi)
        return F.when(F.sum(F.when(rule, F.col("n"))) > 0, F.sum(F.when(rule, F.col("ref"))) / F.sum(F.when(rule, F.col("n")))).otherwise(ratio)

    ranges = [in_range(lo, hi).alias(f"ratio_{lo}") for lo, hi in ((0, 2), (3, 5), (6, 10), (11, 1000))]
    fitted = pairs.groupBy("user_name").agg(ratio.alias("ratio"), F.when(enough, F.coalesce(slope, ratio)).otherwise(ratio).alias("slope"), F.when(enough, F.coalesce(intercept, F.lit(0.0))).otherwise(0.0).alias("intercept"), enough.alias("_enough"), *ranges)
    medians = grouped_quantiles(pairs, ["user_name"], F.when(some, c / n), {"_median": 0.5}).withColumnRenamed("user_name", "_user")
    found = fitted.join(medians, F.col("user_name").eqNullSafe(F.col("_user")), "left")
    median = F.when(F.col("_enough"), F.col("_median")).otherwise(F.col("ratio"))
    return found.select("user_name", "ratio", "slope", "intercept", median.alias("median_ratio"), *[c for c in fitted.columns if c.startswith("ratio_")])


def corrected(pairs: DataFrame, factors: DataFrame) -> DataFrame:
    """CF6, CF10: counts corrected by four methods, long form ``(user_name, image, ref, method, value)``; linear ones floored at 0."""
    j = pairs.join(factors, "user_name")
    n = F.col("n")
    by_range = F.when(n == 0, 0.0).when(n <= 2, n * F.col("ratio_0")).when(n <= 5, n * F.col("ratio_3")).when(n <= 10, n * F.col("ratio_6")).when(n <= 1000, n * F.col("ratio_11")).otherwise(n.cast("double"))
    values = {"ratio": n * F.col("ratio"), "linear": F.greatest(F.lit(0.0), n * F.col("slope") + F.col("intercept")), "median": n * F.col("median_ratio"), "range": by_range}
    methods = F.explode(F.array(*[F.struct(F.lit(k).alias("method"), v.cast("double").alias("value")) for k, v in values.items()]))
    return j.select("user_name", "image", "ref", methods.alias("m")).select("user_name", "image", "ref", "m.method", "m.value")


def fit_errors(df: DataFrame, keys: Sequence[str], value: str = "value", ref: str = "ref") -> DataFrame:
    """CF6, CF11: MAE, RMSE and R2 (0 without variance) of a value against the reference."""
    e = F.col(value) - F.col(ref)
    sst = F.var_pop(ref) * F.count("*")
    return df.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(sst > 0, 1 - F.sum(e * e) / sst).otherwise(0.0).alias("r2"))


def pair_agreement(counts: DataFrame, user_a: str, user_b: str, within: Sequence[int] = (0, 1, 2, 5)) -> DataFrame:
    """CF13: how the counts of two users differ over the images that both have, in one row: errors, their median and 95 % quantile, directions, and the share within some tolerances."""
    both = counts.where(F.col("user_name").isin(user_a, user_b)).groupBy("image").agg(*[F.sum(F.when(F.col("user_name") == u, F.col("n"))).alias(name) for name, u in (("_a", user_a), ("_b", user_b))])
    both = both.withColumn("_e", F.col("_a") - F.col("_b"))
    e = F.col("_e")
    shares = [F.avg((F.abs(e) <= k).cast("double")).alias(f"within_{k}") for k in within]
    sums = both.agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.max(F.abs(e)).alias("max"),
        F.count(F.when(e > 0, 1)).alias("over"), F.count(F.when(e < 0, 1)).alias("under"), F.count(F.when(e == 0, 1)).alias("exact"), *shares,
    )
    median, p95 = grouped_quantiles(both, [], e, {"median": 0.5}), grouped_quantiles(both, [], F.abs(e), {"p95": 0.95})
    return sums.join(F.broadcast(median), how="left").join(F.broadcast(p95), how="left")  # one row each


def error_distribution(pairs: DataFrame) -> DataFrame:
    """CF16: mean, sample deviation, median and kurtosis of each user's errors."""
    e = (F.col("n") - F.col("ref")).cast("double")
    moments = pairs.groupBy("user_name").agg(F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"), F.kurtosis(e).alias("kurtosis"))
    return moments.join(grouped_quantiles(pairs, ["user_name"], e, {"median": 0.5}), "user_name", "left")


def cumulative_error(pairs: DataFrame, key: str = "user_name", order: str = "image") -> DataFrame:
    """WN10: ``(key, order, running)``, the sum of errors from a user's first image to this one."""
    e = pairs.select(key, order, (F.col("n") - F.col("ref")).alias("_e"))
    return running_sums(e, [key], [F.col(order)], {"running": F.col("_e")}).select(key, order, "running")


def error_percentiles(pairs: DataFrame, shares: Sequence[int] = (50, 80, 95), key: str = "user_name", order: str = "image") -> DataFrame:
    """WN11: the absolute error that the given percentages of a user's images don't exceed."""
    e = pairs.select(key, order, F.abs(F.col("n") - F.col("ref")).alias("_e"))
    ranked = numbers_within(e, [key], [F.col("_e"), F.col(order)], "_n", "_size").withColumn("_pct", (F.col("_n") + 1) * 100 / F.col("_size"))
    return ranked.groupBy(key).agg(*[F.min(F.when(F.col("_pct") >= p, F.col("_e"))).alias(f"p{p}") for p in shares])


def compensation(pairs: DataFrame, keys: Sequence[str] = ("user_name",)) -> DataFrame:
    """CF17: over- and undercounts, their compensation (smaller over larger), and the correlation of error and reference."""
    e = F.col("n") - F.col("ref")
    over, under = F.sum(F.greatest(e, F.lit(0))), F.sum(F.greatest(-e, F.lit(0)))
    top = F.greatest(over, under)
    return pairs.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum("ref").alias("ref_total"), over.alias("over"), under.alias("under"), F.when(top > 0, F.least(over, under) / top).otherwise(0.0).alias("compensation"), F.corr(e.cast("double"), F.col("ref").cast("double")).alias("correlation"))


def count_level(c: Column) -> Column:
    """Levels 0-2, 3-5, 6-10, 11+."""
    return F.when(c <= 2, "0-2").when(c <= 5, "3-5").when(c <= 10, "6-10").otherwise("11+")


def compacted(rows: DataFrame, key: str, order: str, values: str, per_list: int) -> DataFrame:
    """AGG21, AGG33: the arrays of a key's rows one after another in order, as ``(key, page, all)`` with ``per_list`` rows in each list."""
    numbered = numbers_within(rows, [key], [F.col(order)], "_n").withColumn("page", F.floor(F.col("_n") / per_list))
    return numbered.groupBy(key, "page").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_n", values))), lambda s: s[values])).alias("all"))


def method_ranks(errors: DataFrame, names: Sequence[str] = ("user_name", "method")) -> DataFrame:
    """CF9: places of the methods by MAE, RMSE and R2 (ties by name); errors are a row per user and method."""
    by = {"by_mae": F.col("mae"), "by_rmse": F.col("rmse"), "by_r2": F.desc("r2")}
    out = errors.select(*names, "mae", "rmse", "r2")
    for place, order in by.items():
        out = row_numbers(out, [order, *[F.col(n) for n in names]], place).withColumn(place, F.col(place) + 1)
    return out.select(*names, *by)


def expert_forest(pairs: DataFrame, users: Sequence[str], *, trees: int = 20, depth: int = 5, seed: int = 7) -> DataFrame:
    """CF8: ``(image, ref, prediction)``, the reference count by a random forest on the users' counts; a user without a count has 0."""
    wide = pairs.groupBy("image", "ref").pivot("user_name", list(users)).agg(F.first("n")).fillna(0)
    x = VectorAssembler(inputCols=list(users), outputCol="features").transform(wide.withColumn("label", F.col("ref").cast("double")))
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed).fit(x).transform(x).select("image", "ref", "prediction")


def scaled_to_totals(counts: DataFrame, pred: str = "pred", ref: str = "ref") -> DataFrame:
    """CF1: ``factor`` that makes the predicted total meet the reference's, and ``calibrated`` counts; null without predictions."""
    total = counts.agg(F.sum(pred).alias("_p"), F.sum(ref).alias("_r"))
    factor = F.when(F.col("_p") > 0, F.col("_r") / F.col("_p"))
    out = counts.crossJoin(F.broadcast(total))  # one row
    return out.withColumn("factor", factor).withColumn("calibrated", F.col(pred) * F.col("factor")).drop("_p", "_r")


def ensembles(corrected_counts: DataFrame) -> DataFrame:
    """CF7: per image the mean, the mean weighted by R2, the median, and the count of the user with the least MAE; from one method's rows of :func:`corrected`."""
    e = fit_errors(corrected_counts, ["user_name"]).withColumn("_w", F.greatest("r2", F.lit(0.0)))
    total = e.agg(F.sum("_w").alias("_all"), F.count("*").alias("_k"), F.min(F.struct(F.round("mae", 9).alias("mae"), "user_name")).alias("_best"))
    weight = F.when(F.col("_all") > 0, F.col("_w") / F.col("_all")).otherwise(1 / F.col("_k"))
    w = e.crossJoin(F.broadcast(total)).select("user_name", weight.alias("_w"), (F.col("user_name") == F.col("_best.user_name")).alias("_is_best"))  # one row
    j = corrected_counts.join(w, "user_name")
    return j.groupBy("image").agg(F.avg("value").alias("mean"), F.sum(F.col("value") * F.col("_w")).alias("weighted"), F.percentile("value", F.lit(0.5)).alias("median"), F.max(F.when(F.col("_is_best"), F.col("value"))).alias("best"))  # a row per user in each image


def pair_totals(counts: DataFrame, user_a: str, user_b: str) -> DataFrame:
    """CF12: totals of two users, the first one's share and ratio, and the images in which both count something."""
    both = counts.where(F.col("user_name").isin(user_a, user_b)).groupBy("image").agg(*[F.sum(F.when(F.col("user_name") == u, F.col("n"))).alias(name) for name, u in (("_a", user_a), ("_b", user_b))])
    a, b = F.sum("_a"), F.sum("_b")
    return both.agg(a.alias("total_a"), b.alias("total_b"), (a * 100 / (a + b)).alias("pct_a"), F.when(b > 0, a / b).alias("ratio"), F.count(F.when((F.col("_a") > 0) & (F.col("_b") > 0), 1)).alias("both"))


def difficult_images(pairs: DataFrame, error: int = 3, share: float = 0.7) -> DataFrame:
    """CF19: images in which at least that share of users is off by ``error`` or more."""
    bad = F.avg((F.abs(F.col("n") - F.col("ref")) >= error).cast("double"))
    return pairs.groupBy("image").agg(bad.alias("share")).where(F.round("share", 6) >= share)
