"""A boosted teacher from Spark ML: logits, thresholds and boundary strengths that guide binning and search."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coppice.operators.prep import distinct_values


@dataclass
class Teacher:
    models: list  # one for two classes, else one for each class against the rest
    features: list[str]
    classes: list

    def logits(self, df: DataFrame, out: str = "teacher_logit") -> DataFrame:
        """Adds the margin of class 1 (two classes) or an array of margins. The booster's raw score is half the logit."""
        from pyspark.ml.functions import vector_to_array

        ready = _assembled(df, self.features)
        for i, m in enumerate(self.models):
            scored = m.setRawPredictionCol(f"_r{i}").setProbabilityCol(f"_p{i}").setPredictionCol(f"_q{i}").transform(ready)
            ready = scored.withColumn(f"_m{i}", 2 * vector_to_array(f"_r{i}")[1]).drop(f"_r{i}", f"_p{i}", f"_q{i}")
        margins = [F.col(f"_m{i}") for i in range(len(self.models))]
        return ready.withColumn(out, margins[0] if len(margins) == 1 else F.array(*margins)).drop("_x", *(f"_m{i}" for i in range(len(margins))))

    def thresholds(self) -> list[tuple[str, float, float, float, float]]:
        """(feature, threshold, gain, |left - right| of the mean leaf value, rows) of every split of every tree."""
        return [x for m in self.models for t in m.trees for x in _splits(t._call_java("rootNode"), self.features)]


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)


def _splits(node, features: Sequence[str]) -> list[tuple[str, float, float, float, float]]:  # noqa: ANN001
    if node.subtreeDepth() == 0:
        return []
    left, right = node.leftChild(), node.rightChild()
    own = (features[node.split().featureIndex()], float(node.split().threshold()), max(float(node.gain()), 1e-12), abs(float(left.prediction()) - float(right.prediction())), float(node.impurityStats().rawCount()))
    return [own, *_splits(left, features), *_splits(right, features)]


def fit(df: DataFrame, features: Sequence[str], y: str, trees: int = 20, depth: int = 3, bins: int = 64, seed: int = 0) -> Teacher:
    from pyspark.ml.classification import GBTClassifier

    classes = distinct_values(df, y)
    if len(classes) < 2:
        raise ValueError("two or more classes are needed")
    ready = _assembled(df, features)
    positives = classes[1:] if len(classes) == 2 else classes
    gbt = GBTClassifier(featuresCol="_x", labelCol="_label", maxIter=trees, maxDepth=depth, maxBins=bins, seed=seed)
    return Teacher([gbt.fit(ready.withColumn("_label", (F.col(y) == c).cast("double"))) for c in positives], list(features), classes)


def guided_edges(teacher: Teacher, ranges: dict[str, tuple[float, float]], bins: int, epsilon: float = 1e-9) -> dict[str, list[float]]:
    """For each feature the ``bins`` - 1 thresholds of the highest summed gain strictly inside its range, none within
    epsilon of one chosen before."""
    score: dict[tuple[str, float], float] = {}
    for f, t, gain, *_ in teacher.thresholds():
        score[f, t] = score.get((f, t), 0.0) + gain
    out: dict[str, list[float]] = {f: [] for f in ranges}
    for (f, t), _ in sorted(score.items(), key=lambda x: (-x[1], x[0][1])):
        lo, hi = ranges[f]
        if lo < t < hi and len(out[f]) < bins - 1 and all(abs(t - e) > epsilon for e in out[f]):
            out[f].append(t)
    return {f: sorted(e) for f, e in out.items()}


def boundary_strengths(teacher: Teacher, edges: dict[str, list[float]]) -> list[tuple[str, int, float, float]]:
    """(feature, boundary, gain, jump): summed over the thresholds nearest to each edge, ties to the lower."""
    total: dict[tuple[str, int], list[float]] = {}
    for f, t, gain, jump, _ in teacher.thresholds():
        if edges.get(f):
            k = min(range(len(edges[f])), key=lambda i: (abs(edges[f][i] - t), i))
            s = total.setdefault((f, k), [0.0, 0.0])
            s[0] += gain
            s[1] += gain * jump
    return [(f, k, g, j) for (f, k), (g, j) in sorted(total.items())]


def boundary_priors(teacher: Teacher, edges: dict[str, list[float]]) -> list[tuple[str, int, float, float, float]]:
    """(feature, boundary, gain, cover, jump) of every edge: gains, rows and jumps of the thresholds nearest to it, summed."""
    total = {(f, k): [0.0, 0.0, 0.0] for f, es in edges.items() for k in range(len(es))}
    for f, t, gain, jump, cover in teacher.thresholds():
        if edges.get(f):
            s = total[f, min(range(len(edges[f])), key=lambda i: (abs(edges[f][i] - t), i))]
            s[0], s[1], s[2] = s[0] + gain, s[1] + cover, s[2] + jump
    return [(f, k, *s) for (f, k), s in total.items()]


def relative_strengths(priors: DataFrame, measures: Sequence[str] = ("gain", "cover", "jump"), feature: str = "feature") -> DataFrame:
    """Adds strength: the mean of the measures' log1p, each over its greatest of the feature (0 where that is 0)."""
    by = Window.partitionBy(feature)
    logs = {f"_{m}": F.log1p(F.greatest(F.lit(0.0), F.col(m).cast("double"))) for m in measures}
    shares = [F.when(F.max(m).over(by) > 1e-12, F.col(m) / F.max(m).over(by)).otherwise(0.0) for m in logs]
    return priors.withColumns(logs).withColumn("strength", sum(shares[1:], shares[0]) / len(shares)).drop(*logs)


def boundary_tensors(teacher: Teacher, df: DataFrame, bins: Mapping[str, str], representatives: Mapping[str, Sequence[float]]) -> DataFrame:
    """Adds, for each feature f, f_left_delta and f_right_delta: how the margin rises from the bin below to the row's own
    and from that to the bin above, the feature standing at the bins' representatives; and f_left_conf and f_right_conf:
    the mean size of the two margins. 0 where there is no such bin, or the row has none. Two classes only.

    bins: the column that holds each feature's bin. Three projections a feature, no row moves.
    """
    if len(teacher.models) != 1:
        raise ValueError("boundary tensors need a teacher of two classes")
    out = df
    for f, b in bins.items():
        reps = [float(x) for x in representatives[f]]
        at = F.col(b)
        if len(reps) < 2:
            out = out.withColumns({f"{f}_{k}": F.lit(0.0) for k in ("left_delta", "right_delta", "left_conf", "right_conf")})
            continue
        last = F.lit(len(reps) - 1)
        held, valid = "_held", at.between(0, len(reps) - 1)
        out = out.withColumn(held, F.col(f))
        for name, to in (("_mid", at), ("_low", at - 1), ("_high", at + 1)):
            near = F.least(F.greatest(F.coalesce(to, F.lit(0)), F.lit(0)), last).cast("int")
            out = teacher.logits(out.withColumn(f, F.element_at(F.array(*map(F.lit, reps)), near + 1)), name)
        mid, low, high = F.col("_mid"), F.col("_low"), F.col("_high")
        below, above = valid & (at > 0), valid & (at < len(reps) - 1)
        out = out.withColumns({
            f"{f}_left_delta": F.when(below, mid - low).otherwise(0.0), f"{f}_left_conf": F.when(below, (F.abs(mid) + F.abs(low)) / 2).otherwise(0.0),
            f"{f}_right_delta": F.when(above, high - mid).otherwise(0.0), f"{f}_right_conf": F.when(above, (F.abs(high) + F.abs(mid)) / 2).otherwise(0.0),
            f: F.col(held),
        }).drop(held, "_mid", "_low", "_high")
    return out


def guess_thresholds(df: DataFrame, features: Sequence[str], y: str, trees: int = 10, depth: int = 1, seed: int = 0) -> dict[str, list[float]]:
    """Distinct thresholds that a small booster uses."""
    found = sorted({(f, t) for f, t, *_ in fit(df, features, y, trees, depth, seed=seed).thresholds()})
    return {f: [t for _, t in g] for f, g in itertools.groupby(found, key=lambda x: x[0])}


def eliminate_columns(df: DataFrame, features: Sequence[str], y: str, trees: int = 10, depth: int = 1, seed: int = 0) -> tuple[list[str], float]:
    """(columns, accuracy): columns that a small booster does not use go at once, then the least used one after another,
    as long as a booster on the rest tells no fewer rows right than that on all. A job for each column tried."""
    def told(columns: list[str]) -> tuple[float, dict[str, float]]:
        t = fit(df, columns, y, trees, depth, seed=seed)
        margin = t.logits(df)
        best = F.when(F.col("teacher_logit") > 0, F.lit(t.classes[1])).otherwise(F.lit(t.classes[0])) if len(t.classes) == 2 else F.element_at(
            F.array(*map(F.lit, t.classes)), F.array_position("teacher_logit", F.array_max("teacher_logit")).cast("int"))
        gains = dict.fromkeys(columns, 0.0)
        for f, _, gain, *_ in t.thresholds():
            gains[f] += gain
        return margin.agg(F.avg((best == F.col(y)).cast("int"))).first()[0] or 0.0, gains

    kept = list(features)
    start, gains = told(kept)
    used = [f for f in kept if gains[f] > 0]
    if used and len(used) < len(kept):
        score, found = told(used)
        if score >= start:
            kept, gains = used, found
    while len(kept) > 1:
        rest = sorted(kept, key=lambda f: (gains[f], f))[1:]
        score, found = told([f for f in kept if f in rest])
        if score < start:
            break
        kept, gains = [f for f in kept if f in rest], found
    return kept, start
