"""A boosted teacher that grows its trees leaf by leaf on binned columns, with weights and a stop by validation rows.

A tree splits the leaf of the highest gain wherever it is. Histograms of gradients come from Spark: those of the smaller
child of every open leaf that can be split, in one job, and of the larger child by subtraction; so a tree takes about as
many jobs as it has levels, not leaves. Gradients are whole numbers (parts of 2^20), whose sums do not depend on the
order of rows: a lost executor, or another number of partitions, changes no split. A histogram has leaves times features
times bins rows at most. Margins are columns; their lineage is cut by a checkpoint every few trees.
"""

from __future__ import annotations

import heapq
import math
import random
import tempfile
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.operators import binning, prep
from coppice.plans.teacher import guided_edges
from coppice.plans.trees import Leaf, Split, Tree, below, expression

PARTS = 2**20


@dataclass(frozen=True)
class Settings:
    trees: int = 100  # rounds; with more than two classes a tree a class in each
    leaves: int = 31
    depth: int | None = None
    rate: float = 0.05
    min_rows: int = 10
    min_hessian: float = 1e-3
    ridge: float = 0.0
    bins: int = 64
    patience: int = 100  # rounds without a lower loss of the validation rows; 0: no stop
    feature_share: float = 1.0  # of the features, drawn for each tree
    row_share: float = 1.0  # of the rows, drawn for each round by a hash of features, label and weight
    seed: int = 0
    cut_every: int = 4  # rounds between checkpoints of the margins


@dataclass
class Booster:
    """Trees of margins by class (one set for two classes), and how raw columns become bins."""

    trees: list[list[Tree]]
    start: list[float]
    features: list[str]
    classes: list
    edges: dict[str, list[float]]
    fill: dict[str, float]
    rate: float
    splits: list[list[list[tuple[str, float, float, float, float]]]] = field(default_factory=list)  # by class and tree
    losses: list[float] = field(default_factory=list)  # of the validation rows, a round each

    def thresholds(self) -> list[tuple[str, float, float, float, float]]:
        """(feature, threshold, gain, |left - right| of the mean leaf value, rows) of every split of every tree."""
        return [x for c in self.splits for t in c for x in t]

    def logits(self, df: DataFrame, out: str = "teacher_logit") -> DataFrame:
        """Adds the margin of the second class (two classes) or an array of margins."""
        ready = _binned(df, self.edges, self.fill)
        margins = [sum((expression(_prefixed(t)) for t in ts), F.lit(s)) for ts, s in zip(self.trees, self.start, strict=True)]
        return ready.withColumn(out, margins[0] if len(margins) == 1 else F.array(*margins)).drop(*(f"_b_{f}" for f in self.features))


def _prefixed(t: Tree) -> Tree:
    return t if isinstance(t, Leaf) else replace(t, feature=f"_b_{t.feature}", children=[_prefixed(c) for c in t.children])


def _filled(f: str, fill: dict[str, float]) -> Column:
    return F.coalesce(prep.finite(F.col(f).cast("double")), F.lit(fill[f]))


def _binned(df: DataFrame, edges: dict[str, list[float]], fill: dict[str, float]) -> DataFrame:
    """Adds the bin of each feature as _b_ and its name; missing and non-finite values are filled."""
    ready = df.withColumns({f"_b_{f}": _filled(f, fill) for f in edges})
    return binning.digitise(ready, {f"_b_{f}": e for f, e in edges.items()}, suffix="")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, read back from the shared folder of checkpoints: that of the session, or a new one on a local master."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="coppice-"))
    return df.checkpoint()


def fit(df: DataFrame, features: Sequence[str], y: str, settings: Settings = Settings(), weight: str | None = None, valid: str | None = None) -> Booster:
    """Fits the booster on the rows whose ``valid`` is not true; the loss of those where it is decides when to stop.

    Missing and non-finite values become the median of the fit rows, edges are their quantiles. Rows without a label are
    left out, as are labels that only validation rows have; a missing weight counts as 0. Weights count in gradients and
    losses, rows in ``min_rows``. Of equal gains the feature first in order and its lowest edge are taken, of equal leaves
    the one opened first. Two or more classes are needed.
    """
    s = settings
    held = F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(False)
    rows = df.where(F.col(y).isNotNull())
    train = rows.where(~held)
    classes = prep.distinct_values(train, y)
    if len(classes) < 2:
        raise ValueError("two or more classes are needed")
    found = prep.medians(train, features).first()
    fill = {f: float(found[i] or 0.0) for i, f in enumerate(features)}
    edges = binning.edges_of(train.select(*(_filled(f, fill).alias(f) for f in features)), features, s.bins)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    code = F.array_position(F.array(*map(F.lit, classes)), F.col(y)).cast("int") - 1
    names = [f"_b_{f}" for f in features]
    binned = _binned(rows, edges, fill)
    mix = F.xxhash64(F.lit(s.seed), F.col(y).cast("string"), w, *(_filled(f, fill) for f in features))
    state = binned.select(*names, code.alias("_k"), w.alias("_w"), held.alias("_held"), *([mix.alias("_mix")] if s.row_share < 1 else [])).where("_k >= 0")
    state = checkpointed(state)
    shares = {r["_k"]: r["w"] for r in state.where("not _held").groupBy("_k").agg(F.sum("_w").alias("w")).collect()}
    total = sum(shares.values())
    prior = [min(max(shares.get(k, 0.0) / total if total else 0.0, 1e-15), 1 - 1e-15) for k in range(len(classes))]
    start = [math.log(prior[1] / prior[0])] if len(classes) == 2 else [math.log(p) for p in prior]
    booster = Booster([[] for _ in start], start, list(features), classes, edges, fill, s.rate, [[] for _ in start])
    state = state.withColumns({f"_m{c}": F.lit(m) for c, m in enumerate(start)})
    best, draw = (math.inf, 0), random.Random(s.seed)
    for round_ in range(1, s.trees + 1):
        grown = []
        fit_rows = state.where(~F.col("_held"))
        if s.row_share < 1:
            fit_rows = fit_rows.where(F.pmod(F.xxhash64("_mix", F.lit(round_)), F.lit(PARTS)) < int(s.row_share * PARTS))
        for c in range(len(start)):
            some = sorted(draw.sample(range(len(features)), max(1, round(s.feature_share * len(features))))) if s.feature_share < 1 else range(len(features))
            g, h = _gradients(c, len(classes))
            used = [features[i] for i in some]
            grown.append(_grow(fit_rows.withColumns({"_g": g, "_h": h}), used, edges, s))
        if all(not splits for _, splits in grown) and s.row_share == s.feature_share == 1:
            break
        for c, (tree, splits) in enumerate(grown):
            booster.trees[c].append(tree)
            booster.splits[c].append(splits)
        state = state.withColumns({f"_m{c}": F.col(f"_m{c}") + expression(_prefixed(t)) for c, (t, _) in enumerate(grown)})
        if round_ % s.cut_every == 0:
            state = checkpointed(state)
        if valid and s.patience:
            loss = state.where("_held").agg(F.sum(F.floor(_loss(len(classes)) * F.col("_w") * PARTS + 0.5)), F.sum("_w")).first()
            if loss[1]:
                booster.losses.append(loss[0] / PARTS / loss[1])
                if booster.losses[-1] < best[0]:
                    best = booster.losses[-1], round_
                elif round_ - best[1] >= s.patience:
                    break
    if booster.losses:
        booster.trees = [t[: best[1]] for t in booster.trees]
        booster.splits = [t[: best[1]] for t in booster.splits]
    return booster


def _gradients(c: int, classes: int) -> tuple[Column, Column]:
    if classes == 2:
        p, hit = 1 / (1 + F.exp(-F.col("_m0"))), F.col("_k") == 1
    else:
        p, hit = F.exp(F.col(f"_m{c}") - _log_sum(classes)), F.col("_k") == c
    w = F.col("_w") * PARTS
    return F.floor((p - F.when(hit, 1.0).otherwise(0.0)) * w + 0.5), F.floor(p * (1 - p) * w + 0.5)


def _log_sum(classes: int) -> Column:
    ms = [F.col(f"_m{c}") for c in range(classes)]
    top = F.greatest(*ms)
    return top + F.log(sum((F.exp(m - top) for m in ms[1:]), F.exp(ms[0] - top)))


def _loss(classes: int) -> Column:
    if classes == 2:
        signed = F.when(F.col("_k") == 1, -F.col("_m0")).otherwise(F.col("_m0"))
        return F.greatest(signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs(signed)))
    return _log_sum(classes) - F.element_at(F.array(*(F.col(f"_m{c}") for c in range(classes))), F.col("_k") + 1)


@dataclass
class _Open:
    """A leaf that may be split: its histogram (features, bins, 3), and the best cut."""

    path: str
    depth: int
    hist: np.ndarray
    gain: float = -math.inf
    feature: int = -1
    cut: int = -1

    def totals(self) -> np.ndarray:
        return self.hist[0].sum(0)

    def low(self) -> np.ndarray:
        return self.hist[self.feature, : self.cut + 1].sum(0)


def _score(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    g, h = g / PARTS, h / PARTS + ridge
    return np.divide(g * g, h, out=np.zeros_like(g), where=h > 0)


def _best_cut(leaf: _Open, cuts: Sequence[int], s: Settings) -> _Open:
    low = leaf.hist.cumsum(1)[:, :-1]
    high = leaf.totals() - low
    ok = (np.minimum(low[..., 2], high[..., 2]) >= s.min_rows) & (np.minimum(low[..., 1], high[..., 1]) >= s.min_hessian * PARTS)
    ok &= np.arange(low.shape[1])[None] < np.asarray(cuts)[:, None]
    own = leaf.totals()
    gain = _score(low[..., 0], low[..., 1], s.ridge) + _score(high[..., 0], high[..., 1], s.ridge) - _score(own[0], own[1], s.ridge)
    gain = np.where(ok, gain, -np.inf)
    if gain.size and gain.max() > 1e-12:
        f, cut = divmod(int(gain.argmax()), gain.shape[1])  # the first feature, then the lowest edge
        leaf.gain, leaf.feature, leaf.cut = float(gain[f, cut]), f, cut
    return leaf


def _histograms(rows: DataFrame, tree: Tree, paths: Sequence[str], features: Sequence[str], bins: int) -> dict[str, np.ndarray]:
    """Of each path the sums of gradients, hessians and rows by feature and bin, whole numbers all: one job."""
    at = rows.withColumn("_path", expression(_prefixed(tree), "path")).where(F.col("_path").isin(list(paths)))
    long = binning.long_form(at, [f"_b_{f}" for f in features], ["_path", "_g", "_h"], "_bin")
    out = {p: np.zeros((len(features), bins, 3), np.int64) for p in paths}
    place = {f"_b_{f}": i for i, f in enumerate(features)}
    for p, f, b, g, h, n in long.groupBy("_path", "feature", "_bin").agg(F.sum("_g"), F.sum("_h"), F.count(F.lit(1))).collect():  # bounded
        out[p][place[f], b] = g, h, n
    return out


def _grow(rows: DataFrame, features: Sequence[str], edges: dict[str, list[float]], s: Settings) -> tuple[Tree, list[tuple[str, float, float, float, float]]]:
    """(tree of margins, splits) on columns _b_feature, _g and _h."""
    cuts = [len(edges[f]) for f in features]
    bins = max(cuts) + 1
    tree: Tree = Leaf(0.0)
    root = _best_cut(_Open("", 0, _histograms(rows, tree, [""], features, bins)[""]), cuts, s)
    nodes, order, splits = {"": root}, 0, []
    heap = [(-root.gain, order, root)] if root.feature >= 0 and s.depth != 0 else []
    known: dict[str, np.ndarray] = {}
    while heap and len(splits) + 1 < s.leaves:
        _, _, leaf = heapq.heappop(heap)
        children = [below(leaf.path, k) for k in (0, 1)]
        if children[0] not in known:
            waiting = [o for o in (leaf, *(x[2] for x in heap)) if below(o.path, 0) not in known]
            ahead, smaller = tree, {}
            for o in waiting:
                ahead = _put(ahead, o.path, Split(features[o.feature], [[(0, o.cut)], [(o.cut + 1, bins)]], [Leaf(0.0), Leaf(0.0)], 0.0))
                smaller[below(o.path, int(2 * o.low()[2] > o.totals()[2]))] = o
            for p, hist in _histograms(rows, ahead, list(smaller), features, bins).items():
                o, k = smaller[p], int(p.rpartition(".")[2])
                known[p], known[below(o.path, 1 - k)] = hist, o.hist - hist
        tree = _put(tree, leaf.path, Split(features[leaf.feature], [[(0, leaf.cut)], [(leaf.cut + 1, bins)]], [Leaf(0.0), Leaf(0.0)], 0.0))
        splits.append(leaf)
        for p in children:
            order += 1
            nodes[p] = child = _best_cut(_Open(p, leaf.depth + 1, known[p]), cuts, s)
            if child.feature >= 0 and (s.depth is None or child.depth < s.depth):
                heapq.heappush(heap, (-child.gain, order, child))
    means: dict[str, float] = {}

    def valued(t: Tree, path: str) -> Tree:
        g, h, n = (float(x) for x in nodes[path].totals())
        if isinstance(t, Leaf):
            value = -s.rate * (g / PARTS) / (h / PARTS + s.ridge) if h / PARTS + s.ridge > 0 else 0.0
            means[path] = value
            return Leaf(value, 0.0, {"n": n})
        t = replace(t, children=[valued(c, below(path, k)) for k, c in enumerate(t.children)])
        ns = [float(nodes[below(path, k)].totals()[2]) for k in (0, 1)]
        means[path] = sum(means[below(path, k)] * x for k, x in enumerate(ns)) / sum(ns)
        return replace(t, prediction=means[path], counts={"n": n})

    tree = valued(tree, "")
    done = [
        (features[o.feature], edges[features[o.feature]][o.cut], o.gain, abs(means[below(o.path, 0)] - means[below(o.path, 1)]), float(o.totals()[2]))
        for o in splits
    ]
    return tree, done


def _put(tree: Tree, path: str, new: Tree) -> Tree:
    if not path:
        return new
    k, _, rest = path.partition(".")
    return replace(tree, children=[_put(c, rest, new) if i == int(k) else c for i, c in enumerate(tree.children)])


@dataclass
class Ensemble:
    """Boosters of several seeds: thresholds of all, margins averaged."""

    boosters: list[Booster]

    def thresholds(self) -> list[tuple[str, float, float, float, float]]:
        return [x for b in self.boosters for x in b.thresholds()]

    def logits(self, df: DataFrame, out: str = "teacher_logit") -> DataFrame:
        n = len(self.boosters)
        for i, b in enumerate(self.boosters):
            df = b.logits(df, f"_logit{i}")
        each = [F.col(f"_logit{i}") for i in range(n)]
        if len(self.boosters[0].start) == 1:
            mean = sum(each[1:], each[0]) / n
        else:
            mean = F.array(*(sum((e[c] for e in each[1:]), each[0][c]) / n for c in range(len(self.boosters[0].start))))
        return df.withColumn(out, mean).drop(*(f"_logit{i}" for i in range(n)))


def fit_several(df: DataFrame, features: Sequence[str], y: str, runs: int, settings: Settings = Settings(feature_share=0.8, row_share=0.8), weight: str | None = None, valid: str | None = None) -> Ensemble:
    return Ensemble([fit(df, features, y, replace(settings, seed=settings.seed + i), weight, valid) for i in range(runs)])


def told_right(booster: Booster, df: DataFrame, y: str) -> float:
    """The share of the labelled rows whose label has the highest margin; 0 without rows."""
    scored = booster.logits(df.where(F.col(y).isNotNull()), "_logit")
    if len(booster.start) == 1:
        best = F.when(F.col("_logit") > 0, F.lit(booster.classes[1])).otherwise(F.lit(booster.classes[0]))
    else:
        best = F.element_at(F.array(*map(F.lit, booster.classes)), F.array_position("_logit", F.array_max("_logit")).cast("int"))
    return scored.agg(F.avg((best == F.col(y)).cast("int"))).first()[0] or 0.0


def eliminate_columns(df: DataFrame, features: Sequence[str], y: str, settings: Settings = Settings(trees=10, leaves=4), weight: str | None = None, valid: str | None = None) -> tuple[list[str], float]:
    """(columns, share told right): the least used columns go, as many as can without telling fewer rows right than a
    booster on all columns; one stays. ``valid`` rows judge where there are any named, else the fit rows.

    Columns are ordered by their gain in the booster on all; those it does not use go without a fit, and how many of the
    others go is found by halving, a fit each. Halving takes it that dropping more columns tells no more rows right; the
    columns returned were fitted and judged, or differ from such by unused ones only.
    """
    judged = df.where(F.col(valid)) if valid else df
    first = fit(df, features, y, settings, weight, valid)
    start = told_right(first, judged, y)
    gains = dict.fromkeys(features, 0.0)
    for f, _, gain, *_ in first.thresholds():
        gains[f] += gain
    order = sorted(features, key=lambda f: (gains[f], f))
    unused = sum(g == 0 for g in gains.values())
    if unused == len(features):
        return list(features), start
    low, high, reached = unused if settings.feature_share == 1 and settings.row_share == 1 else 0, len(features) - 1, start
    while low < high:
        mid = (low + high + 1) // 2
        score = told_right(fit(df, [f for f in features if f not in order[:mid]], y, settings, weight, valid), judged, y)
        if score >= start:
            low, reached = mid, score
        else:
            high = mid - 1
    return [f for f in features if f not in order[:low]], reached


def teacher_edges(teacher: Booster | Ensemble, df: DataFrame, features: Sequence[str], bins: int, epsilon: float = 1e-9) -> dict[str, list[float]]:
    """Edges of each feature: the teacher's thresholds of the highest summed gain; quantiles where it has none, the midpoint
    where there are two values, none where there is one."""
    fallback = binning.edges_of(df, features, bins)
    aggs = [a for f in features for a in (F.min(F.col(f).cast("double")), F.max(F.col(f).cast("double")))]
    ends = df.select(*(prep.finite(F.col(f).cast("double")).alias(f) for f in features)).agg(*aggs).first()
    ranges = {f: (ends[2 * i], ends[2 * i + 1]) for i, f in enumerate(features) if ends[2 * i] is not None and ends[2 * i] < ends[2 * i + 1]}
    if not ranges:
        return {f: [] for f in features}
    more = df.agg(*(F.max((F.col(f) > lo) & (F.col(f) < hi)).alias(f"_{i}") for i, (f, (lo, hi)) in enumerate(ranges.items()))).first()
    wide = {f: r for i, (f, r) in enumerate(ranges.items()) if more[i]}
    score = [x for x in teacher.thresholds() if x[0] in wide]
    guided = guided_edges(_Scores(score), wide, bins, epsilon)
    return {f: guided.get(f) or (fallback.get(f, []) if f in ranges else []) for f in features}


@dataclass
class _Scores:
    found: list

    def thresholds(self) -> list:
        return self.found
