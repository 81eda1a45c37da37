"""Aggregates that tree searches consume: class histograms, leaf statistics, split scores and bounds.

Every solver takes these, never rows. All are group-bys with map-side combine whose result is bounded by features,
bins, classes and nodes, or by distinct patterns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions.impurity import entropy, gini_mass, leaf_loss
from coppice.operators.binning import long_form
from coppice.operators.prep import bounded


def class_histogram(df: DataFrame, features: Sequence[str], y: str, w: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by, feature, bin, y, n, weight."""
    rows = df.select(*by, *features, F.col(y).alias("y"), (F.col(w) if w else F.lit(1)).alias("w"))
    long = long_form(rows, features, [*by, "y", "w"], "bin")
    return long.groupBy(*by, "feature", "bin", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"))


def binary_histogram(df: DataFrame, features: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """by, feature, bin, n0, n1."""
    long = long_form(df.select(*by, *features, F.col(y).alias("y")), features, [*by, "y"], "bin")
    return long.groupBy(*by, "feature", "bin").agg(F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("n0"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("n1"))


def prefix_sums(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds c0, c1 (counts up to and with the bin) and t0, t1 (of the feature) to a binary histogram."""
    w = Window.partitionBy(*by, "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*by, "feature")
    return hist.withColumns({"c0": F.sum("n0").over(w), "c1": F.sum("n1").over(w), "t0": F.sum("n0").over(all_), "t1": F.sum("n1").over(all_)})


def node_statistics(df: DataFrame, node: Sequence[str], y: str, w: str, regularisation: float = 0.0) -> DataFrame:
    """node, n, weight, weight2, n_classes, prediction, loss (share of all weight), objective, effective_unit.

    The prediction of a tie is the first class in order; effective_unit is the sum of squared weights over the square
    of their sum.
    """
    classes = df.groupBy(*node, F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(F.col(w) * F.col(w)).alias("w2"))
    best = F.min_by("y", F.struct(-F.col("w"), F.col("y")))
    nodes = classes.groupBy(*node).agg(F.sum("n").alias("n"), F.sum("w").alias("weight"), F.sum("w2").alias("weight2"), F.count(F.lit(1)).alias("n_classes"), best.alias("prediction"), F.max("w").alias("top"))
    total = F.broadcast(nodes.agg(F.sum("weight").alias("_all")))
    loss = (F.col("weight") - F.col("top")) / F.col("_all")
    return nodes.crossJoin(total).select(*node, "n", "weight", "weight2", "n_classes", "prediction", loss.alias("loss"), (loss + regularisation).alias("objective"), (F.col("weight2") / (F.col("weight") * F.col("weight"))).alias("effective_unit"))


def bin_impurities(hist: DataFrame) -> DataFrame:
    """feature, bin, gini_mass, loss of a binary histogram."""
    return hist.select("feature", "bin", gini_mass(F.col("n0"), F.col("n1")).alias("gini_mass"), leaf_loss(F.col("n0"), F.col("n1")).alias("loss"))


def _sides() -> tuple[Column, Column, Column, Column]:
    return F.col("c0"), F.col("c1"), F.col("t0") - F.col("c0"), F.col("t1") - F.col("c1")


def threshold_splits(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, feature, bin, gini, gain, loss of every two-way split after a bin that leaves rows on either side."""
    l0, l1, r0, r1 = _sides()
    n = F.col("t0") + F.col("t1")
    gain = entropy(F.col("t0"), F.col("t1")) - (l0 + l1) / n * entropy(l0, l1) - (r0 + r1) / n * entropy(r0, r1)
    scored = prefix_sums(hist, by).where((r0 + r1) > 0)
    return scored.select(*by, "feature", "bin", (gini_mass(l0, l1) + gini_mass(r0, r1)).alias("gini"), gain.alias("gain"), (leaf_loss(l0, l1) + leaf_loss(r0, r1)).alias("loss"))


def best_threshold(hist: DataFrame, by: Sequence[str] = (), decimals: int = 9) -> DataFrame:
    """For each node the split of the highest gain; ties: first feature, lowest bin."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("gain", decimals)), "feature", "bin") if by else Window.orderBy(F.desc(F.round("gain", decimals)), "feature", "bin")
    return threshold_splits(hist, by).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def contiguous_partitions(hist: DataFrame, groups: int) -> DataFrame:
    """feature, cut1[, cut2], loss, gini of every partition into 2 or 3 runs of bins, by self-join of the prefix table."""
    p = prefix_sums(hist).select("feature", "bin", "c0", "c1", "t0", "t1")
    if groups == 2:
        l0, l1, r0, r1 = _sides()
        return p.where((r0 + r1) > 0).select("feature", F.col("bin").alias("cut1"), (leaf_loss(l0, l1) + leaf_loss(r0, r1)).alias("loss"), (gini_mass(l0, l1) + gini_mass(r0, r1)).alias("gini"))
    a, b = p.alias("a"), p.alias("b")
    m0, m1 = F.col("b.c0") - F.col("a.c0"), F.col("b.c1") - F.col("a.c1")
    r0, r1 = F.col("b.t0") - F.col("b.c0"), F.col("b.t1") - F.col("b.c1")
    parts = ((F.col("a.c0"), F.col("a.c1")), (m0, m1), (r0, r1))
    return a.join(b, (F.col("a.feature") == F.col("b.feature")) & (F.col("a.bin") < F.col("b.bin")) & ((r0 + r1) > 0)).select(
        F.col("a.feature").alias("feature"), F.col("a.bin").alias("cut1"), F.col("b.bin").alias("cut2"),
        sum((leaf_loss(*x) for x in parts[1:]), leaf_loss(*parts[0])).alias("loss"), sum((gini_mass(*x) for x in parts[1:]), gini_mass(*parts[0])).alias("gini"),
    )


def best_partition(hist: DataFrame, groups: int) -> DataFrame:
    """For each feature the partition of the lowest loss, then gini, then cuts."""
    cuts = ["cut1", "cut2"][: groups - 1]
    order = Window.partitionBy("feature").orderBy("loss", F.round("gini", 6), *cuts)
    return contiguous_partitions(hist, groups).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def patterns(df: DataFrame, features: Sequence[str], y: str, w: str | None = None) -> DataFrame:
    """features, y, n, weight: rows collapsed to distinct patterns, the data reduction before any exact search."""
    return df.groupBy(*features, F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(w) if w else F.lit(1)).alias("weight"))


def pattern_ids(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """features, n, pattern: dense numbers of the distinct patterns in lexicographic order.

    Patterns are numbered within each value of the first feature, from where the values before it end: only those
    values, which are bins, are ordered in one task.
    """
    found = df.groupBy(*features).agg(F.count(F.lit(1)).alias("n"))
    first = features[0]
    sizes = found.groupBy(F.col(first).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    base = bounded(sizes.withColumn("_base", F.sum("_c").over(Window.orderBy("_v")) - F.col("_c")).drop("_c"))
    local = F.row_number().over(Window.partitionBy(first).orderBy(*features)) - 1
    numbered = found.withColumn("_at", local).join(base, F.col(first).eqNullSafe(F.col("_v")))
    return numbered.select(*features, "n", (F.col("_base") + F.col("_at")).cast("int").alias("pattern"))


def signature_bound(df: DataFrame, features: Sequence[str], y: str, regularisation: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """by, n, minority, bound: rows that no tree on these features can get right, as a share, plus the leaf's cost."""
    per = patterns(df, [*by, *features], y).groupBy(*by, *features).agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    grouped = per.groupBy(*by) if by else per.groupBy()
    out = grouped.agg(F.sum("n").alias("n"), F.sum(F.col("n") - F.col("top")).alias("minority"))
    return out.withColumn("bound", F.col("minority") / F.col("n") + regularisation)


def majority_labels(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """features, label, n, errors: the majority class of each pattern, ties to the first class in order."""
    per = patterns(df, features, y)
    order = Window.partitionBy(*features).orderBy(F.desc("n"), "y")
    best = per.withColumn("_r", F.row_number().over(order)).withColumn("_all", F.sum("n").over(Window.partitionBy(*features)))
    return best.where("_r = 1").select(*features, F.col("y").alias("label"), F.col("_all").alias("n"), (F.col("_all") - F.col("n")).alias("errors"))


def balanced_costs(df: DataFrame, y: str) -> DataFrame:
    """prediction, truth, cost: 0 on the diagonal, else 1 / (rows of the true class * classes)."""
    counts = df.groupBy(F.col(y).alias("truth")).agg(F.count(F.lit(1)).alias("n"))
    k = F.broadcast(counts.agg(F.count(F.lit(1)).alias("k")))  # one row
    predicted = bounded(counts.select(F.col("truth").alias("prediction")))
    return predicted.crossJoin(counts).crossJoin(k).select("prediction", "truth", F.when(F.col("prediction") == F.col("truth"), 0.0).otherwise(1 / (F.col("n") * F.col("k"))).alias("cost"))


def cost_sensitive_leaf(df: DataFrame, node: Sequence[str], y: str, costs: DataFrame) -> DataFrame:
    """node, prediction, cost: the class of the least cost, ties to the first in order."""
    counts = df.groupBy(*node, F.col(y).alias("truth")).agg(F.count(F.lit(1)).alias("n"))
    each = counts.join(F.broadcast(costs), "truth").groupBy(*node, "prediction").agg(F.sum(F.col("n") * F.col("cost")).alias("cost"))
    order = Window.partitionBy(*node).orderBy(F.round("cost", 9), "prediction")
    return each.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def feature_distances(df: DataFrame, features: Sequence[str], w: str | None = None) -> DataFrame:
    """a, b, distance: weight on which two boolean features differ, or agree, whichever is less, in one scan."""
    weight = F.col(w) if w else F.lit(1)
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    sums = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.sum(F.when(F.col(a) != F.col(b), weight).otherwise(0)).alias("d"), F.sum(weight).alias("t")) for a, b in pairs]
    rows = df.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return rows.select("a", "b", F.least("d", F.col("t") - F.col("d")).alias("distance"))


def pairwise_partition_impurity(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """joint, single_a, single_b, gain: gini shares of the cells of two branchings and what the pair wins over the better."""
    def share(keys: list[str], name: str) -> DataFrame:
        cells = df.groupBy(*keys).agg(F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("n0"), F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("n1"))
        return cells.agg((F.sum(gini_mass(F.col("n0"), F.col("n1"))) / F.sum(F.col("n0") + F.col("n1"))).alias(name))

    one = share([a, b], "joint").crossJoin(share([a], "single_a")).crossJoin(share([b], "single_b"))
    return one.withColumn("gain", F.least("single_a", "single_b") - F.col("joint"))


def partition_variance(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, within, between: law of total variance over the groups."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    agg = g.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    mean = F.col("s") / F.col("n")
    return agg.select("n", mean.alias("mean"), ((F.col("q") - F.col("b")) / F.col("n")).alias("within"), (F.col("b") / F.col("n") - mean * mean).alias("between"))
