"""Metrics, model comparison and cross-validation summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, y: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("truth"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def binary_scores(df: DataFrame, y: str, prediction: str) -> DataFrame:
    """One row: n, accuracy, balanced_accuracy, f1 (class 1 is positive)."""
    def n(t: int, p: int):  # noqa: ANN202
        return F.sum(F.when((F.col(y) == t) & (F.col(prediction) == p), 1).otherwise(0))

    c = df.agg(F.count(F.lit(1)).alias("n"), n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))
    return c.select(
        "n", ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"),
        ((F.try_divide("tp", F.col("tp") + F.col("fn")) + F.try_divide("tn", F.col("tn") + F.col("fp"))) / 2).alias("balanced_accuracy"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def regression_scores(df: DataFrame, y: str, prediction: str) -> DataFrame:
    """One row: n, mse, mae, r2."""
    e = F.col(y) - F.col(prediction)
    c = df.agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("v"))
    return c.select("n", "mse", "mae", (1 - F.try_divide("mse", "v")).alias("r2"))


def roc_points(leaves: DataFrame) -> DataFrame:
    """leaf, p, n -> r, tpr, fpr of the leaves by falling share of positives, ties by leaf, and where they came from.
    Leaves are few: one row each of a model."""
    order = Window.orderBy(F.desc(F.col("p") / (F.col("p") + F.col("n"))), "leaf")
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    points = leaves.select(
        F.row_number().over(order).alias("r"), (F.sum("p").over(up) / F.sum("p").over(everything)).alias("tpr"), (F.sum("n").over(up) / F.sum("n").over(everything)).alias("fpr")
    )
    before = Window.orderBy("r")
    return points.withColumns({"tpr0": F.coalesce(F.lag("tpr").over(before), F.lit(0.0)), "fpr0": F.coalesce(F.lag("fpr").over(before), F.lit(0.0))})


def auc(leaves: DataFrame, up_to: float = 1.0) -> DataFrame:
    """One row: auc, the area below the convex curve of the leaves, for false positive rates up to a bound."""
    x1 = F.least("fpr", F.lit(up_to))
    slope = F.try_divide(F.col("tpr") - F.col("tpr0"), F.col("fpr") - F.col("fpr0"))
    y1 = F.when(F.col("fpr") <= up_to, F.col("tpr")).otherwise(F.col("tpr0") + slope * (x1 - F.col("fpr0")))
    area = F.when(F.col("fpr0") < up_to, (x1 - F.col("fpr0")) * (F.col("tpr0") + y1) / 2).otherwise(F.lit(0.0))
    return roc_points(leaves).agg(F.sum(area).alias("auc"))


def summary(results: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """keys, n_runs and the mean, sample deviation, minimum and maximum of each metric."""
    aggs = [f(m).alias(f"{m}_{k}") for m in metrics for k, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs"), *aggs)


def best_per_group(results: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    return results.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def pivot_by_algorithm(results: DataFrame, grid: DataFrame, algorithms: Sequence[str], metric: str) -> DataFrame:
    """dataset, depth and a column for each algorithm: its mean metric; every point of the grid is there."""
    wide = results.groupBy("dataset", "depth").pivot("algorithm", list(algorithms)).agg(F.avg(metric))
    return grid.join(wide, ["dataset", "depth"], "left")


def cross_validation_summary(results: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """keys, mean, std (population) and rank: highest mean, then lowest keys."""
    per = results.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("mean", 9)), *keys)))


def any_label_accuracy(df: DataFrame, labels: str, prediction: str) -> DataFrame:
    """One row: share of rows whose prediction is among their labels."""
    return df.agg(F.avg(F.array_contains(F.col(labels), F.col(prediction)).cast("int")).alias("accuracy"))


def one_row_per_label(df: DataFrame, labels: str, out: str) -> DataFrame:
    return df.withColumn(out, F.explode(labels))


def error_weights(df: DataFrame, errors: str) -> DataFrame:
    """A row for each branch of the array of errors: branch, rank from the least, weight = largest error - error."""
    top = df.withColumn("_top", F.array_max(errors)).withColumn("_order", F.array_sort(F.transform(errors, lambda e, i: F.struct(e.alias("e"), i.alias("i")))))
    out = top.select("*", F.posexplode("_order").alias("rank", "_s"))
    return out.select(*[c for c in df.columns if c != errors], F.col("_s.i").alias("branch"), "rank", (F.col("_top") - F.col("_s.e")).alias("weight"))
