"""Trees on streams: an extension, as batch prediction is a projection and histograms add up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.operators.binning import long_form
from coppice.plans.trees import Tree, expression


def predict(stream: DataFrame, tree: Tree, out: str = "predicted") -> DataFrame:
    return stream.withColumn(out, expression(tree))


def windowed_histogram(stream: DataFrame, time: str, features: Sequence[str], y: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, feature, bin, y, n by event-time window; rows later than ``late`` are dropped by the watermark."""
    rows = stream.withWatermark(time, late).select(F.window(time, width).alias("w"), *features, F.col(y).alias("y"))
    return long_form(rows, features, ["w", "y"], "bin").groupBy("w", "feature", "bin", "y").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "feature", "bin", "y", "n")
