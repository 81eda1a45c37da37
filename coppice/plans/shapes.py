"""Splits by inner trees over the bins of one feature or the cells of two, pairs of features asked for by priority, and
refits of a whole level from one aggregation.

All three read bounded histograms of Spark jobs: an inner tree, and the mapping of its leaves to branches, see class
counts (or moments) of bins only; a pair's joint histogram is asked for while it may still win; and the rows that a
level's nodes should care for are counted by node, by the children that tell them right, and by bin.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.operators.binning import long_form
from coppice.plans import levelwise
from coppice.plans.levelwise import EPS, Settings, Target, best_split, impurity, rows_of
from coppice.plans.trees import Leaf, Split, Tree, expression, route, to_spans

# --- pairs of features


@dataclass
class PairSplit:
    cost: float  # impurity of the branches and penalties, in rows
    features: tuple[str, ...]  # one feature, or two
    groups: list[list[int]]  # bins, or cells a * size_b + b, of each branch
    asked: int  # joint histograms asked for
    sizes: dict[str, int]  # of the features: those given, or the span of the bins and 0 where that is wider


def pair_bound(a: np.ndarray, b: np.ndarray, rows: float, s: Settings) -> float:
    """No split by the cells of two features has an impurity below this, by the histograms of each alone.

    Rows outside the fullest bin of one feature are all that can leave the bins of the other. Taking such a row out lowers
    a bin's impurity mass, at best as a part of what taking out its whole minority does (two classes: the mass is concave),
    or by at most 2 (gini). For more classes and entropy the other feature's entropy bounds what it adds, where no row
    lacks a bin. Numbers (variance) have no such bound: 0.
    """
    if s.criterion == "variance" or not len(a) or not len(b):
        return 0.0
    return max(0.0, *(_refined_bound(x, y, rows, s) for x, y in ((a, b), (b, a))))


def _refined_bound(a: np.ndarray, b: np.ndarray, rows: float, s: Settings) -> float:
    mass = impurity(a, s.criterion)
    free = rows - b.sum(1).max()
    if a.shape[1] == 2:
        minority = a.min(1)
        saved = 0.0
        for i in np.argsort(-np.divide(mass, minority, out=np.zeros_like(mass), where=minority > 0), kind="stable"):
            if free <= 0 or minority[i] <= 0:
                break
            part = min(free, minority[i])
            saved, free = saved + mass[i] * part / minority[i], free - part
    elif s.criterion == "gini":
        saved = min(mass.sum(), 2 * free)
    elif a.sum() == rows == b.sum():
        saved = float(impurity(b.sum(1)[None], "entropy")[0])
    else:
        return 0.0
    return float(mass.sum() - saved)


def cut_of_shares(bins: np.ndarray, stats: np.ndarray, s: Settings) -> tuple[float, list[list[int]]] | None:
    """(impurity mass, bins of each branch) of the best cut in two of the bins sorted by class share or mean: for two classes
    or one number no other grouping in two is better. It may lower nothing; of equal cuts the first."""
    n = rows_of(stats, s.criterion)
    order = np.argsort(stats[:, min(1, stats.shape[1] - 1)] / np.maximum(n, EPS), kind="stable")
    low = stats[order].cumsum(0)[:-1]
    high = stats.sum(0) - low
    ok = np.minimum(rows_of(low, s.criterion), rows_of(high, s.criterion)) >= max(s.min_child, EPS)
    if not ok.any():
        return None
    cost = np.where(ok, impurity(low, s.criterion) + impurity(high, s.criterion), np.inf)
    at = int(cost.argmin()) + 1
    return float(cost[at - 1]), [sorted(bins[order[:at]].tolist()), sorted(bins[order[at:]].tolist())]


def best_pair(df: DataFrame, features: Sequence[str], y: str, sizes: Mapping[str, int], settings: Settings = Settings(1, "inner"), pair_penalty: float = 0.0, batch: int = 4, gain: bool = True) -> PairSplit | None:
    """The best split by one feature or the joint cells of two; None if none lowers the impurity.

    sizes: the number of bins of each feature. A pair's penalty is a share of all rows. Pairs wait in a queue by their
    bound; ``batch`` joint histograms at a time come from one job, until the next bound is no better than the best split.
    The result is that of all pairs: of equal costs a single feature, then the pair first in the order of features.
    Class targets are told apart up to 10,000; rows without a bin of either feature count for no cell of a pair.

    gain: whether a split, penalties included, and every cut of an inner tree must lower the impurity. If not, all
    groupings of single bins or cells in two compete (two classes or one number), whatever the kind and depth of trees, and
    there is a split wherever there are two bins. Penalties are then shares of the rows that have the bins, and that of the branch, which every split in two has, does
    not decide.
    """
    s = settings
    target = levelwise._target(df, y, s)
    if not gain and (s.branches != 2 or len(target.classes or ()) > 2):
        raise ValueError("without a gain there are splits in two only, of two classes or a number")
    got, names = levelwise._histograms(df, None, [""], features, target)
    if not len(got):
        return None
    parts = {f: got[(got["feature"] == f) & got["_bin"].notna()].sort_values("_bin") for f in features}
    own = got[got["feature"] == features[0]][names].to_numpy(float).sum(0)
    rows = float(rows_of(own, s.criterion))
    first = {f: min(0, int(p["_bin"].min())) if len(p) else 0 for f, p in parts.items()}
    sizes = {f: max(sizes[f], int(p["_bin"].max()) - first[f] + 1 if len(p) else 0) for f, p in parts.items()}

    def price(part: pd.DataFrame, share: float, places: np.ndarray | None = None) -> tuple[float, float, list[list[int]]] | None:
        """What decides, cost and groups of the best split by a histogram."""
        at, stats = part["_bin"].to_numpy(int), part[names].to_numpy(float)
        if gain:
            found = best_split(at, stats, s, rows, places)
            return (found[0] + share * rows, found[0] + share * rows, found[1]) if found else None
        found, n = cut_of_shares(at, stats, s), float(rows_of(stats, s.criterion).sum())
        return (found[0] + share * n, found[0] + s.penalty * n + share * n, found[1]) if found else None

    def least(a: str, b: str) -> float:
        """The penalties that a pair's splits have at least."""
        if gain:
            return (s.penalty + pair_penalty) * rows
        return pair_penalty * max(0.0, sum(float(rows_of(parts[f][names].to_numpy(float), s.criterion).sum()) for f in (a, b)) - rows)

    # bounds are rounded in another order than costs: without a gain, where rounding may decide, pairs as near as that are asked for too
    margin, near = (EPS, EPS) if gain else (0.0, 1e-9 * rows)
    best, asked = (float(impurity(own, s.criterion)) if gain else np.inf, -1, 0.0, (), []), 0
    for i, f in enumerate(features):
        found = price(parts[f], 0.0)
        if found and found[0] < best[0] - margin:
            best = (found[0], i, found[1], (f,), found[2])
    queue = [
        (pair_bound(parts[a][names].to_numpy(float), parts[b][names].to_numpy(float), rows, s) + least(a, b), k, (a, b))
        for k, (a, b) in enumerate(itertools.combinations(features, 2))
    ]
    heapq.heapify(queue)
    pairs: tuple[float, int, float, tuple, list] | None = None
    while queue and queue[0][0] < min(best[0], pairs[0] if pairs else np.inf) + near:
        now = [heapq.heappop(queue)[1:] for _ in range(min(batch, len(queue)))]
        asked += len(now)
        joint, columns = levelwise.with_pairs(df, [p for _, p in now], sizes)
        cells, _ = levelwise._histograms(joint, None, [""], columns, target)
        for (k, p), c in zip(now, columns, strict=True):
            part = cells[(cells["feature"] == c) & cells["_bin"].notna()].sort_values("_bin")
            at = part["_bin"].to_numpy(int)
            b = (at - first[p[1]]) % sizes[p[1]] + first[p[1]]
            found = price(part, pair_penalty, np.stack([(at - b) // sizes[p[1]], b], 1))
            if found and (pairs is None or (found[0], k) < pairs[:2]):
                pairs = found[0], k, found[1], p, found[2]
    if pairs and pairs[0] < best[0] - margin:
        best = pairs
    return PairSplit(best[2], best[3], best[4], asked, sizes) if best[3] else None


# --- refits of a level


def alternate_levels(df: DataFrame, tree: Tree, features: Sequence[str], y: str, settings: Settings, most: int = 1000) -> tuple[Tree, int]:
    """(tree, aggregations): alternating optimisation, bottom up, until no node's refit lowers the training errors.

    A split is refitted on the rows that some but not all of its branches get right. All nodes of a level come from one
    aggregation: rows are counted by node, by the set of children that are right (and whether the node's own prediction
    is, which a row without a bin gets) and by bin; from it follow the refit and its errors. Nodes below a changed one,
    it and those above it are looked at again; at most ``most`` aggregations. Up to 20 branches.
    """
    s, settled, passes = replace(settings, depth=1), set(), 0
    while passes < most:
        open_ = [p for p in levelwise._paths(tree) if p not in settled]
        if not open_:
            break
        deepest = max(map(_depth, open_))
        level = [p for p in open_ if _depth(p) == deepest]
        passes += 1
        changed = _refits(df, tree, level, features, y, s)
        settled |= set(level)
        for path, new in changed.items():
            tree = levelwise._replaced(tree, path, new)
            settled = {p for p in settled if p != path and not (path == "" or p.startswith(path + ".")) and not (p == "" or path.startswith(p + "."))}
    return tree, passes


def _depth(path: str) -> int:
    return path.count(".") + bool(path)


def _refits(df: DataFrame, tree: Tree, paths: Sequence[str], features: Sequence[str], y: str, s: Settings) -> dict[str, Split]:
    """The better splits of nodes of one level, by one aggregation."""
    nodes = {p: levelwise._at(tree, p) for p in paths}
    if max(len(n.children) for n in nodes.values()) > 20:
        raise ValueError("more than 20 branches")
    at, mask = F.col("_path"), None
    for p, n in nodes.items():
        bits = [F.when(expression(c).eqNullSafe(F.col(y)), 1 << k).otherwise(0) for k, c in enumerate(n.children)]
        bits.append(F.when(F.lit(n.prediction).eqNullSafe(F.col(y)), 1 << len(n.children)).otherwise(0))
        own = sum(bits[1:], bits[0])
        mask = F.when(at == p, own) if mask is None else mask.when(at == p, own)
    every = list(dict.fromkeys([*features, *(n.feature for n in nodes.values())]))
    rows = df.withColumn("_path", expression(tree, "path", _depth(paths[0]))).where(at.isin(list(paths))).withColumn("_mask", mask).select(*every, "_path", "_mask")
    got = long_form(rows, every, ["_path", "_mask"], "_bin").groupBy("_path", "_mask", "feature", "_bin").count().toPandas()
    out = {}
    for p, part in got.groupby("_path"):
        new = _refit(part, nodes[p], features, s)
        if new is not None:
            out[p] = new
    return out


def _refit(counts: pd.DataFrame, node: Split, features: Sequence[str], s: Settings) -> Split | None:
    k = len(node.children)
    children = counts["_mask"].to_numpy() & ((1 << k) - 1)
    care = counts[(children > 0) & (children < (1 << k) - 1) & counts["feature"].isin(list(features))].copy()
    if not len(care):
        return None
    care["_best"] = [(m & -m).bit_length() - 1 for m in (care["_mask"] & ((1 << k) - 1)).tolist()]
    classes = sorted(care["_best"].unique().tolist())
    names = [f"s{i}" for i in range(len(classes))]
    got = _by_class(care, classes, names)
    total = float(got[got["feature"] == features[0]][names].to_numpy(float).sum())
    found = levelwise._candidates(got, names, features, Target("_best", classes), s, total)
    new = next(iter(found.values()))
    if isinstance(new, Leaf):
        return None
    branches: list[list[int]] = [[] for _ in node.children]
    for group, leaf in zip(new.groups, new.children, strict=True):
        branches[leaf.prediction] += group
    used = [i for i, b in enumerate(branches) if b]
    if len(used) < 2:
        return None
    other = Split(new.feature, [to_spans(branches[i]) for i in used], [node.children[i] for i in used], node.prediction, node.loss, node.counts)
    return other if _right(counts, other, used, k) > _right(counts, node, range(k), k) else None


def _by_class(care: pd.DataFrame, classes: Sequence[int], names: Sequence[str]) -> pd.DataFrame:
    """_path, feature, _bin and the rows of each class; rows without a bin stay, with a null one."""
    wide = pd.DataFrame({n: care["count"].where(care["_best"] == c, 0) for c, n in zip(classes, names, strict=True)})
    keys = care[["_path", "feature", "_bin"]]
    return pd.concat([keys, wide], axis=1).groupby(["_path", "feature", "_bin"], dropna=False, as_index=False).sum()


def _right(counts: pd.DataFrame, node: Split, children: Sequence[int], k: int) -> int:
    """Rows told right if they go on by this split; children: the bit of each branch."""
    part = counts[counts["feature"] == node.feature]
    bits = [k if pd.isna(b) else children[route(node, int(b))] for b in part["_bin"]]
    return int((part["count"].to_numpy() * (part["_mask"].to_numpy() >> np.array(bits, int) & 1)).sum())
