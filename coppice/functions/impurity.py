"""Impurities, gains and losses as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def gini_mass(*weights: Column) -> Column:
    """Total minus sum of squares over the total; 0 for an empty node."""
    total = reduce(lambda a, b: a + b, weights)
    squares = reduce(lambda a, b: a + b, (w * w for w in weights))
    return F.when(total > 0, total - squares / total).otherwise(F.lit(0.0))


def gini(*weights: Column) -> Column:
    total = reduce(lambda a, b: a + b, weights)
    return F.when(total > 0, 1 - reduce(lambda a, b: a + b, (w * w for w in weights)) / (total * total)).otherwise(F.lit(0.0))


def entropy(*weights: Column) -> Column:
    """In bits."""
    total = reduce(lambda a, b: a + b, weights)
    terms = (F.when(w > 0, -(w / total) * F.log2(w / total)).otherwise(F.lit(0.0)) for w in weights)
    return reduce(lambda a, b: a + b, terms)


def leaf_loss(*weights: Column) -> Column:
    """Total minus the largest class."""
    return reduce(lambda a, b: a + b, weights) - F.greatest(*weights)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softmax(xs: Column) -> Column:
    """Of an array of logits, shifted by the largest."""
    e = F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the score interval of k of n."""
    p = k / n
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half
