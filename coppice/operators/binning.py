"""Discretisation: thresholds, bins, spans and compression of neighbouring bins."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions.impurity import wilson
from coppice.operators import ranks


def long_form(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), value: str = "v") -> DataFrame:
    """feature, value and the columns kept: a row for each row and feature, in one scan."""
    s = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias(value)) for f in features)))
    return df.select(*keep, s.alias("_s")).select(*keep, "_s.feature", f"_s.{value}")


def midpoints(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, threshold: halfway between each two neighbouring distinct values; the lower of two with no number between."""
    values = long_form(df.select(*(F.col(f).cast("double").alias(f) for f in features)), features).where("v is not null").distinct()
    nxt = F.lead("v").over(Window.partitionBy("feature").orderBy("v"))
    half = (F.col("v") + F.col("n")) / 2
    return values.withColumn("n", nxt).where("n is not null").select("feature", F.when(half < F.col("n"), half).otherwise(F.col("v")).alias("threshold"))


def thresholds_of(df: DataFrame, features: Sequence[str], limit: int = 10_000) -> dict[str, list[float]]:
    """Thresholds on the driver; refuses more than ``limit``."""
    rows = midpoints(df, features).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} thresholds; use quantile edges")
    return {f: sorted(r["threshold"] for r in rows if r["feature"] == f) for f in features}


def number(x: float) -> str:
    """The shortest text that reads back as the same number, whole ones without a point: two numbers never share one."""
    return repr(float(x)).removesuffix(".0")


def column_of(feature: str, threshold: float) -> str:
    """The name of a binarised column."""
    return f"{feature}<={number(threshold)}"


def feature_map(thresholds: Mapping[str, Sequence[float]]) -> dict[str, tuple[str, float]]:
    """Source and threshold of each binarised column."""
    return {column_of(f, t): (f, float(t)) for f, ts in thresholds.items() for t in ts}


def binarise(df: DataFrame, thresholds: Mapping[str, Sequence[float]]) -> DataFrame:
    """Adds a 0/1 column ``feature<=threshold`` for each, null where the value is; however near two thresholds lie, each
    has a column of its own (see ``feature_map``)."""
    return df.withColumns({name: (F.col(f) <= t).cast("int") for name, (f, t) in feature_map(thresholds).items()})


def unbinarise(df: DataFrame, feature: str, values: Sequence[float], thresholds: Sequence[float], out: str) -> DataFrame:
    """The value again: that below the first threshold that holds, else the largest. Exact, as one value lies between
    each two thresholds."""
    c = F.lit(float(values[-1]))
    for v, t in reversed(list(zip(values, thresholds, strict=False))):
        c = F.when(F.col(f"`{column_of(feature, t)}`") == 1, F.lit(float(v))).otherwise(c)
    return df.withColumn(out, c)


def encoder_predicates(values: Sequence, kind: str) -> list[str]:
    """Predicates that encode a column: ``>= v`` for whole numbers, ``>= midpoint`` for others, ``= v`` for categories."""
    if kind == "integral":
        return [f">= {v}" for v in values]
    if kind == "rational":
        return [f">= {number((a + b) / 2)}" for a, b in zip(values, values[1:], strict=False)]
    return [f"= '{v}'" for v in values]


def digits(c: Column, places: Sequence[int]) -> list[Column]:
    """Decimal digits of a number at 10^place."""
    return [(F.floor(c / F.lit(10.0**p)) % 10).cast("int") for p in places]


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int, decimals: int = 6, exact: bool = True) -> DataFrame:
    """feature, edges: distinct interpolated quantiles strictly inside the range, rounded; of two values the midpoint.

    Exact quantiles are found by counting in pieces of the range, a few scans in all (see ranks.py); ``exact`` false takes
    sketches of bounded size instead, in one scan.
    """
    ps = [i / bins for i in range(1, bins)]
    columns = {f: F.col(f) for f in features}
    if exact:
        got = ranks.order_statistics(df, columns, lambda n: sorted({0, n - 1, *ranks.quantile_ranks(n, ps)}) if n else [])
        rows = [(f, s.low, s.high, s.between, [s.quantile(p) for p in ps]) for f, s in got.items()]
        found = df.sparkSession.createDataFrame(rows, "feature string, lo double, hi double, between boolean, q array<double>")
    else:
        ends = df.agg(*(f(c).cast("double").alias(f"_{k}{i}") for i, c in enumerate(features) for k, f in (("lo", F.min), ("hi", F.max))))
        each = df.select(*(F.col(f).cast("double").alias(f"_v{i}") for i, f in enumerate(features))).crossJoin(F.broadcast(ends))  # one row
        aggs = []
        for i, f in enumerate(features):
            v, lo, hi = (F.col(f"_{k}{i}") for k in ("v", "lo", "hi"))
            some = F.count_if(((v > lo) & (v < hi)) | F.isnan(v)) > 0
            q = F.percentile_approx(v, F.array(*(F.lit(p) for p in ps)), 10_000)
            aggs.append(F.struct(F.lit(f).alias("feature"), F.min(lo).alias("lo"), F.max(hi).alias("hi"), some.alias("between"), q.alias("q")))
        found = each.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    inside = F.array_sort(F.array_distinct(F.filter(F.transform("q", lambda x: F.round(x, decimals)), lambda x: (x > F.col("lo")) & (x < F.col("hi")))))
    two = ~F.col("between") & (F.col("lo") < F.col("hi"))
    return found.select("feature", F.when(two, F.array((F.col("lo") + F.col("hi")) / 2)).otherwise(inside).alias("edges"))


def edges_of(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    return {r["feature"]: list(r["edges"] or []) for r in quantile_edges(df, features, bins).collect()}  # one row a feature


def digitise(df: DataFrame, edges: Mapping[str, Sequence[float]], suffix: str = "_bin") -> DataFrame:
    """Adds bins: how many edges are at or below the value. A value on an edge is above it, NaN above all; null has no bin."""
    def bin_of(f: str, es: Sequence[float]) -> Column:
        below = F.size(F.filter(F.array(*(F.lit(float(e)) for e in es)), lambda e: e <= F.col(f))) if es else F.lit(0)
        return F.when(F.col(f).isNotNull(), below)

    return df.withColumns({f"{f}{suffix}": bin_of(f, es).cast("int") for f, es in edges.items()})


def representatives(df: DataFrame, feature: str, bin_column: str, edges: Sequence[float]) -> DataFrame:
    """bin, representative: the mean of the bin's values; of an empty bin the midpoint of its edges, or the edge at the rim."""
    spark = df.sparkSession
    n = len(edges) + 1
    empty = [(b, float(edges[0] if b == 0 else edges[-1] if b == n - 1 else (edges[b - 1] + edges[b]) / 2) if edges else 0.0) for b in range(n)]
    every = F.broadcast(spark.createDataFrame(empty, "bin int, e double"))
    means = df.groupBy(F.col(bin_column).alias("bin")).agg(F.avg(feature).alias("m"))
    return every.join(means, "bin", "left").select("bin", F.coalesce("m", "e").alias("representative"))


def nearest_boundary(values: DataFrame, edges: DataFrame) -> DataFrame:
    """feature, v -> adds boundary: the index of the nearest edge of the feature (feature, edges), ties to the lower.

    Edges ride along as one array a feature, so rows are neither multiplied nor sorted.
    """
    gap = F.transform("edges", lambda e: F.abs(e - F.col("v")))
    return values.join(edges, "feature").withColumn("boundary", (F.array_position(gap, F.array_min(gap)) - 1).cast("int")).drop("edges")


def spans(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, bin -> keys, lo, hi: runs of consecutive bins."""
    island = F.col("bin") - F.row_number().over(Window.partitionBy(*keys).orderBy("bin"))
    return bins.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).drop("_i")


def merge_pure_runs(hist: DataFrame) -> DataFrame:
    """feature, bin, n0, n1 -> feature, atom, lo, hi, n0, n1: neighbouring bins that hold one and the same class merge."""
    pure = F.when(F.col("n1") == 0, 0).when(F.col("n0") == 0, 1)
    w = Window.partitionBy("feature").orderBy("bin")
    marked = hist.withColumn("_p", pure).withColumn("_new", F.when(F.lag("_p").over(w) == F.col("_p"), 0).otherwise(1))
    atoms = marked.withColumn("atom", F.sum("_new").over(w) - 1)
    return atoms.groupBy("feature", "atom").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def wilson_neighbours(hist: DataFrame) -> DataFrame:
    """feature, bin, n0, n1 -> feature, bin, overlap with the next bin's score interval of the share of class 1, tv: the
    total variation between the two."""
    lo, hi = wilson(F.col("n1"), F.col("n0") + F.col("n1"))
    w = Window.partitionBy("feature").orderBy("bin")
    rated = hist.withColumns({"lo": lo, "hi": hi, "p": F.col("n1") / (F.col("n0") + F.col("n1"))})
    pairs = rated.withColumns({"lo2": F.lead("lo").over(w), "hi2": F.lead("hi").over(w), "p2": F.lead("p").over(w)}).where("lo2 is not null")
    overlap = (F.col("lo") <= F.col("hi2")) & (F.col("lo2") <= F.col("hi"))
    return pairs.select("feature", "bin", overlap.cast("int").alias("overlap"), F.abs(F.col("p") - F.col("p2")).alias("tv"))


def merge_by_bic(counts: Sequence[Sequence[float]]) -> list[tuple[int, int]]:
    """Bins (class counts in order) merged greedily while that does not raise the Bayesian information criterion of the two
    neighbours and more than two are left; spans.

    Sequential by nature and small: for the driver or a grouped function.
    """
    def loglik(c: Sequence[float]) -> float:
        t = sum(c)
        return sum(x * math.log(x / t) for x in c if x > 0)

    def gain(a: Sequence[float], b: Sequence[float]) -> float | None:
        both = [x + y for x, y in zip(a, b, strict=True)]
        g = (len(both) - 1) * math.log(max(sum(both), 2)) - 2 * (loglik(a) + loglik(b) - loglik(both))
        return g if g >= 0 else None

    return _merged_greedily(counts, gain)


def _merged_greedily(counts: Sequence[Sequence[float]], gain: Callable[[Sequence[float], Sequence[float]], float | None]) -> list[tuple[int, int]]:
    """Neighbours of the highest gain (ties: the first; None: apart) merge until two spans are left or none may."""
    atoms = [(i, i, list(map(float, c))) for i, c in enumerate(counts)]
    while len(atoms) > 2:
        gains = [(g, -i) for i, (a, b) in enumerate(zip(atoms, atoms[1:], strict=False)) if (g := gain(a[2], b[2])) is not None]
        if not gains:
            break
        i = -max(gains)[1]
        atoms[i : i + 2] = [(atoms[i][0], atoms[i + 1][1], [x + y for x, y in zip(atoms[i][2], atoms[i + 1][2], strict=True)])]
    return [(a, b) for a, b, _ in atoms]


def _overlap(a: Sequence[float], b: Sequence[float], z: float = 1.959963984540054) -> bool:
    """Whether the score intervals of every class's share overlap."""
    def interval(k: float, n: float) -> tuple[float, float]:
        p = k / n
        half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
        return (p + z * z / (2 * n) - half) / (1 + z * z / n), (p + z * z / (2 * n) + half) / (1 + z * z / n)

    na, nb = sum(a), sum(b)
    if na <= 0 or nb <= 0:
        return False
    pairs = [(interval(x, na), interval(y, nb)) for x, y in zip(a, b, strict=True)]
    return all(p[0] <= q[1] and q[0] <= p[1] for p, q in pairs)


def merge_by_plateau(counts: Sequence[Sequence[float]]) -> list[tuple[int, int]]:
    """Neighbours whose score intervals overlap merge, those of the least total variation first, down to two spans."""
    def gain(a: Sequence[float], b: Sequence[float]) -> float | None:
        return -sum(abs(x / sum(a) - y / sum(b)) for x, y in zip(a, b, strict=True)) / 2 if _overlap(a, b) else None

    return _merged_greedily(counts, gain)


def merge_by_confidence(counts: Sequence[Sequence[float]]) -> list[tuple[int, int]]:
    """From the first bin on a bin joins the span before it where their score intervals overlap."""
    out: list[tuple[int, int, list[float]]] = []
    for i, c in enumerate(counts):
        if out and _overlap(out[-1][2], c):
            out[-1] = out[-1][0], i, [x + y for x, y in zip(out[-1][2], c, strict=True)]
        else:
            out.append((i, i, list(map(float, c))))
    return [(a, b) for a, b, _ in out]


def merged_by(rule: Callable[[Sequence[Sequence[float]]], list[tuple[int, int]]], hist: DataFrame) -> DataFrame:
    """feature, bin, n0, n1 -> feature, atom, lo, hi, n0, n1 by merge_by_bic, merge_by_plateau or merge_by_confidence: a
    feature's occupied bins are one group, which the number of bins bounds."""
    import pandas as pd

    def merge(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("bin")
        counts, bins = own[["n0", "n1"]].to_numpy(), own["bin"].tolist()
        out = [(own["feature"].iloc[0], k, bins[i], bins[j], *map(int, counts[i : j + 1].sum(0))) for k, (i, j) in enumerate(rule(counts.tolist()))]
        return pd.DataFrame(out, columns=["feature", "atom", "lo", "hi", "n0", "n1"])

    return hist.groupBy("feature").applyInPandas(merge, "feature string, atom long, lo int, hi int, n0 long, n1 long")


def merge_proportional(hist: DataFrame) -> DataFrame:
    """feature, bin, n0, n1 -> feature, atom, lo, hi, n0, n1: neighbouring bins of the same shares merge."""
    w = Window.partitionBy("feature").orderBy("bin")
    same = F.lag("n0").over(w) * F.col("n1") == F.lag("n1").over(w) * F.col("n0")
    marked = hist.withColumn("_new", F.when(same, 0).otherwise(1))
    atoms = marked.withColumn("atom", F.sum("_new").over(w) - 1)
    return atoms.groupBy("feature", "atom").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def line_projections(df: DataFrame, a: str, b: str, angles: int) -> DataFrame:
    """Adds cos * a + sin * b for ``angles`` directions over half a turn but those along an axis."""
    turns = [180 * i / angles for i in range(angles)]
    return df.withColumns({f"{a}:{b}@{t:g}": F.round(F.lit(math.cos(math.radians(t))), 3) * F.col(a) + F.round(F.lit(math.sin(math.radians(t))), 3) * F.col(b) for t in turns if t % 90})
