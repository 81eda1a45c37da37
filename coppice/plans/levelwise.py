"""Trees grown a level at a time by distributed histograms: for data whose patterns do not fit the driver.

The binned table keeps a path column that is a CASE over the tree so far; one group-by a level gives the histograms of
all active nodes, bounded by nodes, features, bins and classes. The driver picks each node's split from them.

Splits: threshold (binary), multiway (interval groups), kmeans (groups of bins of like means), shape: bins regrouped into
k branches by coordinate descent, wherever they lie, from cuts of the bins sorted by class share or mean, or the best
runs of the sorted bins, or inner: the
leaves of a small tree over the feature's bins mapped to branches. Targets are classes or numbers (variance).
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.operators.binning import long_form
from coppice.operators.prep import distinct_values
from coppice.plans.trees import Leaf, Split, Tree, below, expression, to_spans

EPS = 1e-12

@dataclass(frozen=True)
class Settings:
    depth: int = 3
    kind: str = "threshold"  # threshold, multiway, kmeans, shape or inner
    branches: int = 2
    min_child: int = 1
    penalty: float = 0.0  # per branch beyond the first, in impurity shares of all rows
    criterion: str = "gini"  # gini, entropy or variance
    inner_depth: int = 3  # of an inner tree
    inner_min: int = 1  # rows of a leaf of an inner tree


def impurity(a: np.ndarray, criterion: str) -> np.ndarray:
    """Impurity mass of rows of statistics: class counts, or (n, then sum and sum of squares of each target)."""
    if criterion == "variance":
        n, s, q = a[..., 0], a[..., 1::2], a[..., 2::2]
        return q.sum(-1) - np.divide((s * s).sum(-1), n, out=np.zeros_like(n), where=n > 0)
    t = a.sum(-1)
    if criterion == "gini":
        return t - np.divide((a * a).sum(-1), t, out=np.zeros_like(t), where=t > 0)
    p = np.divide(a, t[..., None], out=np.zeros_like(a), where=t[..., None] > 0)
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(-1) * t


def rows_of(a: np.ndarray, criterion: str) -> np.ndarray:
    return a[..., 0] if criterion == "variance" else a.sum(-1)


def descend(stats: np.ndarray, k: int, s: Settings, order: np.ndarray) -> tuple[float, np.ndarray]:
    """Branch of each bin: from cuts of ``order`` into k runs of like size, single bins move while the mass falls."""
    m = len(stats)
    group = np.zeros(m, int)
    edges = np.searchsorted(np.cumsum(rows_of(stats[order], s.criterion)), np.linspace(0, rows_of(stats, s.criterion).sum(), k + 1)[1:-1], side="right")
    for g, e in enumerate(edges, 1):
        group[order[min(e, m - (k - g)) :]] = g
    total = np.zeros((k, stats.shape[1]))
    np.add.at(total, group, stats)
    for _ in range(50):
        moved = False
        for i in range(m):
            a = group[i]
            if (group == a).sum() == 1:
                continue
            without = total.copy()
            without[a] -= stats[i]
            base = impurity(without, s.criterion)
            with_ = impurity(without + stats[i], s.criterion)
            cost = with_ - base
            b = int(cost.argmin())
            if b != a and cost[b] < cost[a] - EPS:
                total[a] -= stats[i]
                total[b] += stats[i]
                group[i], moved = b, True
        if not moved:
            break
    if (rows_of(total, s.criterion) < s.min_child).any():
        return np.inf, group
    return float(impurity(total, s.criterion).sum()), group


def intervals(stats: np.ndarray, k: int, s: Settings) -> tuple[float, np.ndarray]:
    from coppice.plans.multiway import interval_partitions

    c = np.concatenate([np.zeros((1, stats.shape[1])), stats.cumsum(0)])
    seg = c[None] - c[:, None]
    ok = (rows_of(seg, s.criterion) >= s.min_child) & (np.arange(len(c))[None] > np.arange(len(c))[:, None])
    found = interval_partitions(np.where(ok, impurity(np.where(ok[..., None], seg, 0), s.criterion), 0), ok, k)
    return (found[k][0], np.array(found[k][1])) if k in found else (np.inf, np.zeros(len(stats), int))


def by_means(stats: np.ndarray, k: int, s: Settings) -> tuple[float, np.ndarray]:
    """Bins grouped by their means (of the targets, or shares of the classes), rows weighing: k-means of the bins.

    Along one direction groups are runs of the sorted means, so the program over runs is exact for one target; for more
    the direction of largest spread orders the bins, and each bin then goes to the nearest centre while any moves.
    """
    n = np.maximum(rows_of(stats, s.criterion), EPS)
    means = (stats[:, 1::2] if s.criterion == "variance" else stats) / n[:, None]
    centred = means - np.average(means, axis=0, weights=n)
    line = means[:, 0] if means.shape[1] == 1 else centred @ np.linalg.svd(centred * np.sqrt(n)[:, None], full_matrices=False)[2][0]
    order = np.argsort(line, kind="stable")
    cost, group = intervals(stats[order], k, s)
    if not np.isfinite(cost):
        return cost, group
    own = np.empty(len(stats), int)
    own[order] = group
    if means.shape[1] > 1:
        for _ in range(50):
            centres = np.stack([np.average(means[own == g], axis=0, weights=n[own == g]) for g in range(k)])
            new = ((means[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            if (new == own).all() or len(np.unique(new)) < k:
                break
            own = new
    total = np.zeros((k, stats.shape[1]))
    np.add.at(total, own, stats)
    if (rows_of(total, s.criterion) < s.min_child).any():
        return np.inf, own
    return float(impurity(total, s.criterion).sum()), own


def inner_leaves(at: np.ndarray, stats: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell its leaf in a greedy tree over the cells' places (a column an axis), and the side of its root cut.

    A cut parts the places of one axis at a value; it must lower the impurity and leave inner_min rows on either side. Of
    equal cuts the first axis and lowest value. Leaves are numbered from left to right."""
    leaf, side, n = np.zeros(len(at), int), np.zeros(len(at), int), 0

    def grow(own: np.ndarray, depth: int) -> None:
        nonlocal n
        best = (float(impurity(stats[own].sum(0), s.criterion)) - EPS, -1, 0)
        for axis in range(at.shape[1]) if depth else ():
            values, place = np.unique(at[own, axis], return_inverse=True)
            by_value = np.zeros((len(values), stats.shape[1]))
            np.add.at(by_value, place, stats[own])
            low = by_value.cumsum(0)[:-1]
            high = by_value.sum(0) - low
            ok = np.minimum(rows_of(low, s.criterion), rows_of(high, s.criterion)) >= max(s.inner_min, EPS)
            cost = np.where(ok, impurity(low, s.criterion) + impurity(high, s.criterion), np.inf)
            if len(cost) and cost.min() < best[0] - (EPS if best[1] >= 0 else 0):
                best = (float(cost.min()), axis, values[int(cost.argmin())])
        if best[1] < 0:
            leaf[own] = n
            n += 1
            return
        low = at[own, best[1]] <= best[2]
        if depth == s.inner_depth:
            side[own[~low]] = 1
        grow(own[low], depth - 1)
        grow(own[~low], depth - 1)

    grow(np.arange(len(at)), s.inner_depth)
    return leaf, side


def mapped(stats: np.ndarray, side: np.ndarray, k: int, s: Settings) -> tuple[float, np.ndarray]:
    """Branch of each leaf of an inner tree: the best of runs of the leaves sorted by class share or mean (for two classes or
    one number no mapping is better), of descents from like runs and from the sides of the root, and of means."""
    n = np.maximum(rows_of(stats, s.criterion), EPS)
    order = np.argsort(stats[:, 1] / n, kind="stable")
    cost, runs = intervals(stats[order], k, s)
    own = np.empty(len(stats), int)
    own[order] = runs
    found = [(cost, own), descend(stats, k, s, order), by_means(stats, k, s)]
    if k == 2:
        found.append(descend(stats, k, s, np.argsort(side, kind="stable")))
    return min(found, key=lambda x: x[0])


def best_split(bins: np.ndarray, stats: np.ndarray, s: Settings, unit: float, places: np.ndarray | None = None) -> tuple[float, list[list[int]]] | None:
    """(penalised impurity mass, bins of each branch) of the best split of one feature in one node.

    places: for inner trees the place of each bin on several axes, where bins are cells of several features."""
    best = None
    if s.kind == "inner":
        if not len(bins):
            return None
        leaf, sides = inner_leaves(bins[:, None] if places is None else places, stats, s)
        by_leaf = np.zeros((leaf.max() + 1, stats.shape[1]))
        np.add.at(by_leaf, leaf, stats)
        side = np.zeros(len(by_leaf), int)
        side[leaf] = sides
        for k in range(2, min(len(by_leaf), s.branches) + 1):
            found = mapped(by_leaf, side, k, s)
            cost = found[0] + s.penalty * unit * (k - 1)
            if np.isfinite(cost) and (best is None or cost < best[0] - EPS):
                best = cost, [[int(b) for b in bins[found[1][leaf] == g]] for g in range(k)]
        return best
    for k in range(2, min(len(bins), 2 if s.kind == "threshold" else s.branches) + 1):
        if s.kind == "shape":
            n = np.maximum(rows_of(stats, s.criterion), EPS)
            level = stats[:, 1] / n
            found = min((descend(stats, k, s, o) for o in (np.argsort(level, kind="stable"), np.arange(len(bins)))), key=lambda x: x[0])
            found = min(found, intervals(stats, k, s), key=lambda x: x[0])
            order = np.argsort(level, kind="stable")  # for two classes or one number no grouping is better than runs of these
            cost, runs = intervals(stats[order], k, s)
            own = np.empty(len(stats), int)
            own[order] = runs
            found = min(found, (cost, own), key=lambda x: x[0])
        elif s.kind == "kmeans":
            found = by_means(stats, k, s)
        else:
            found = intervals(stats, k, s)
        cost = found[0] + s.penalty * unit * (k - 1)
        if np.isfinite(cost) and (best is None or cost < best[0] - EPS):
            best = cost, [[int(b) for b in bins[found[1] == g]] for g in range(k)]
    return best


@dataclass
class Target:
    """What the leaves predict: classes, a number, or several numbers (then by the sum of their variances)."""

    y: str | list[str]
    classes: list | None

    def names(self) -> list[str]:
        return [self.y] if isinstance(self.y, str) else list(self.y)

    def aggregates(self) -> list:
        if self.classes is not None:
            return [F.sum(F.when(F.col("_y0") == c, 1.0).otherwise(0.0)) for c in self.classes]
        sums = [f(F.col(f"_y{i}")).cast("double") for i in range(len(self.names())) for f in (F.sum, lambda c: F.sum(c * c))]
        return [F.count("_y0").cast("double"), *sums]


@dataclass
class Candidate:
    """The best split of a node: impurity mass it takes away, feature, bins of each branch, and leaves for them."""

    gain: float
    feature: str
    groups: list[list[int]]
    children: list[Leaf]
    leaf: Leaf


def _target(df: DataFrame, y: str | Sequence[str], s: Settings) -> Target:
    if s.criterion == "variance":
        return Target(y if isinstance(y, str) else list(y), None)
    if not isinstance(y, str):
        raise ValueError("several targets need the criterion variance")
    return Target(y, distinct_values(df, y))


def _histograms(df: DataFrame, tree: Tree | None, paths: Sequence[str], features: Sequence[str], target: Target):  # noqa: ANN202
    """Statistics by path, feature and bin of the rows that reach the paths: one job, nodes times features times bins rows."""
    path = expression(tree, "path") if tree is not None else F.lit("")
    ys = [F.col(c).alias(f"_y{i}") for i, c in enumerate(target.names())]
    rows = df.select(*features, *ys).withColumn("_path", path).where(F.col("_path").isin(sorted(paths)))
    if target.classes is None:
        rows = rows.dropna("any", subset=[f"_y{i}" for i in range(len(ys))])
    long = long_form(rows, features, ["_path", *(f"_y{i}" for i in range(len(ys)))], "_bin")
    aggs = target.aggregates()
    return long.groupBy("_path", "feature", "_bin").agg(*(a.alias(f"s{i}") for i, a in enumerate(aggs))).toPandas(), [f"s{i}" for i in range(len(aggs))]


def _candidates(got, names: list[str], features: Sequence[str], target: Target, s: Settings, total: float) -> dict[str, Candidate | Leaf]:  # noqa: ANN001
    """For each path its best split, or its leaf where none lowers the impurity."""
    out: dict[str, Candidate | Leaf] = {}
    for name, node in got.groupby("_path"):
        own = node[node["feature"] == features[0]][names].to_numpy(float).sum(0)
        leaf, options = _leaf(own, target.classes, s), []
        for i, f in enumerate(features):
            part = node[(node["feature"] == f) & node["_bin"].notna()].sort_values("_bin")
            found = best_split(part["_bin"].to_numpy(int), part[names].to_numpy(float), s, total)
            if found:
                options.append((found[0], i, found[1], part))
        mass = float(impurity(own, s.criterion))
        if not options or min(options, key=lambda x: x[:2])[0] >= mass - EPS:
            out[name] = leaf
            continue
        cost, i, groups, part = min(options, key=lambda x: x[:2])
        children = [_leaf(part[part["_bin"].isin(g)][names].to_numpy(float).sum(0), target.classes, s) for g in groups]
        out[name] = Candidate(mass - cost, features[i], groups, children, leaf)
    return out


def _split(c: Candidate) -> Split:
    return Split(c.feature, [to_spans(g) for g in c.groups], c.children, c.leaf.prediction, c.leaf.loss, c.leaf.counts)


def _checked(s: Settings) -> None:
    if s.branches < 2 or s.depth < 0:
        raise ValueError("a split has two branches at least, and a depth is not negative")


def grow(df: DataFrame, features: Sequence[str], y: str | Sequence[str], settings: Settings = Settings()) -> Tree:
    """Grows a tree on binned columns; at most one job a level. Several targets are predicted as an array."""
    s = settings
    _checked(s)
    target = _target(df, y, s)
    tree: Tree | None = None
    open_, total = {""}, 0.0
    for level in range(s.depth + 1):
        if level == s.depth and tree is not None:
            break
        got, names = _histograms(df, tree, sorted(open_), features, target)
        if tree is None:
            root = got[got["feature"] == features[0]][names].to_numpy(float).sum(0) if len(got) else np.zeros(len(names))
            tree = _leaf(root, target.classes, s)
            total = float(rows_of(root, s.criterion))
        if level == s.depth or not len(got):
            break
        open_ = set()
        for name, c in _candidates(got, names, features, target, s, total).items():
            if isinstance(c, Candidate):
                tree = _replaced(tree, name, _split(c))
                open_ |= {below(name, k) for k in range(len(c.groups))}
        if not open_:
            break
    return tree


def grow_best_first(df: DataFrame, features: Sequence[str], y: str | Sequence[str], settings: Settings = Settings(), leaves: int = 8) -> Tree:
    """Grows by the split that takes away the most impurity, wherever it is, until there are ``leaves`` leaves, no split
    lowers the impurity, or ``settings.depth`` is reached; ties go to the node that was opened first. A job a split,
    over the rows of the new children only."""
    s = settings
    _checked(s)
    target = _target(df, y, s)
    got, names = _histograms(df, None, [""], features, target)
    root = got[got["feature"] == features[0]][names].to_numpy(float).sum(0) if len(got) else np.zeros(len(names))
    tree, total, n, opened = _leaf(root, target.classes, s), float(rows_of(root, s.criterion)), 1, 0
    heap: list[tuple[float, int, str, Candidate]] = []

    def push(paths: list[str]) -> None:
        nonlocal opened
        found = _candidates(got, names, features, target, s, total)
        for p in paths:
            c = found.get(p)
            if isinstance(c, Candidate):
                heapq.heappush(heap, (-c.gain, opened, p, c))
            opened += 1

    if s.depth > 0 and len(got):
        push([""])
    while heap:
        _, _, path, c = heapq.heappop(heap)
        if n + len(c.groups) - 1 > leaves:
            continue
        tree, n = _replaced(tree, path, _split(c)), n + len(c.groups) - 1
        paths = [below(path, k) for k in range(len(c.groups))]
        if n < leaves and paths[0].count(".") + 1 < s.depth:
            got, names = _histograms(df, tree, paths, features, target)
            if len(got):
                push(paths)
    return tree


def _leaf(a: np.ndarray, classes: list | None, s: Settings) -> Leaf:
    if classes is None:
        means = [float(x / a[0]) if a[0] else 0.0 for x in a[1::2]]
        return Leaf(means[0] if len(means) == 1 else means, float(impurity(a, s.criterion)), {"n": float(a[0])})
    return Leaf(classes[int(a.argmax())], float(a.sum() - a.max()), {str(c): float(x) for c, x in zip(classes, a, strict=True)})


def _replaced(tree: Tree, path: str, new: Tree) -> Tree:
    if not path:
        return new
    k, _, rest = path.partition(".")
    children = [_replaced(c, rest, new) if i == int(k) else c for i, c in enumerate(tree.children)]
    return Split(tree.feature, tree.branches, children, tree.prediction, tree.loss, tree.counts)


def with_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], sizes: dict[str, int]) -> tuple[DataFrame, list[str]]:
    """Adds a column ``a_x_b`` for each pair of binned features: the number of their joint cell. As a feature of a shape
    tree it branches on both at once; a histogram holds sizes[a] * sizes[b] cells."""
    joint = {f"{a}_x_{b}": (F.col(a) * sizes[b] + F.col(b)).cast("int") for a, b in pairs}
    return df.withColumns(joint), list(joint)


def alternate(df: DataFrame, tree: Tree, features: Sequence[str], y: str, settings: Settings, rounds: int = 1) -> Tree:
    """Alternating optimisation, bottom up: each split is refitted on the rows that only one of its branches gets right,
    and kept if that lowers the training errors. A job a node and round."""
    s = replace(settings, depth=1)
    errors = _errors(df, tree, y)
    for _ in range(rounds):
        for path in sorted(_paths(tree), key=lambda p: p.count(".") + bool(p), reverse=True):
            node = _at(tree, path)
            within = df.withColumn("_path", expression(tree, "path")).where((F.col("_path") == path) | F.col("_path").startswith(f"{path}." if path else "")).drop("_path")
            right = [expression(c).eqNullSafe(F.col(y)).cast("int") for c in node.children]
            n_right = sum(right[1:], right[0])
            care = within.where((n_right > 0) & (n_right < len(right))).withColumn("_best", F.array_position(F.array(*right), 1).cast("int") - 1)
            new = grow(care, features, "_best", s)
            if not isinstance(new, Split):
                continue
            branches: list[list[int]] = [[] for _ in node.children]
            for spans, c in zip(new.branches, new.children, strict=True):
                branches[c.prediction] += [b for lo, hi in spans for b in range(lo, hi + 1)]
            used = [i for i, b in enumerate(branches) if b]
            if len(used) < 2:
                continue
            other = _replaced(tree, path, Split(new.feature, [to_spans(branches[i]) for i in used], [node.children[i] for i in used], node.prediction, node.loss, node.counts))
            got = _errors(df, other, y)
            if got < errors:
                tree, errors = other, got
                break
    return tree


def _errors(df: DataFrame, tree: Tree, y: str) -> int:
    return df.where(~expression(tree).eqNullSafe(F.col(y))).count()


def _paths(t: Tree, at: str = "") -> list[str]:
    return [] if isinstance(t, Leaf) else [at, *(p for k, c in enumerate(t.children) for p in _paths(c, below(at, k)))]


def _at(t: Tree, path: str) -> Tree:
    for k in path.split(".") if path else ():
        t = t.children[int(k)]
    return t
