"""Provably optimal sparse trees on boolean columns, and their lookahead variants.

Spark collapses rows to distinct patterns with class weights (the equivalent-points reduction); a memoised search over
sets of patterns, as bit masks, returns the tree of the least loss + regularisation per leaf. Bounds: a set costs at
least its minority weight plus a leaf, two leaves if it is split. A tree of depth d has d levels of splits.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.plans.trees import Leaf, Split, Tree, boolean

EPS = 1e-12


@dataclass(frozen=True)
class Settings:
    depth: int = 3
    regularisation: float = 0.01
    allow_small: bool = False  # else regularisation is at least one row's share
    min_rows: int = 1
    rule_list: bool = False
    proposals: int | None = None  # splits tried at a node: those of the most gain; then the best tree over proposals
    feature_exchange: bool = False  # leave out splits that a split with a side inside theirs is proven to equal or beat
    seconds: float = 60.0
    max_patterns: int = 50_000


@dataclass
class Cases:
    """Patterns (x: patterns by features, 0/1), rows n, and the cost of predicting each class for each pattern."""

    features: list[str]
    classes: list
    x: np.ndarray
    n: np.ndarray
    w: np.ndarray  # class weights, all together 1
    cost: np.ndarray  # (patterns, classes)


def collapse(df: DataFrame, features: Sequence[str], y: str, costs: dict | None = None, balance: bool = False, most: int = 50_000) -> Cases:
    """costs: {(predicted, true): cost of a row}; balance: classes weigh alike whatever their rows."""
    bad = df.where(" OR ".join(f"`{f}` NOT IN (0, 1)" for f in features)).limit(1).count()
    if bad:
        raise ValueError("features must be 0 or 1")
    got = df.groupBy(*features, F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_n")).limit(most + 1).toPandas()
    if len(got) > most:
        raise ValueError(f"more than {most} distinct patterns: use fewer features or the level-wise trees")
    classes = sorted(got["_y"].dropna().unique().tolist(), key=str)
    x, at = np.unique(got[list(features)].to_numpy(int), axis=0, return_inverse=True)
    rows = np.zeros((len(x), len(classes)))
    for i, label, n in zip(at.ravel(), got["_y"], got["_n"], strict=True):
        if label in classes:
            rows[i, classes.index(label)] += n
    total = rows.sum()
    if balance:
        w = rows / (rows.sum(0) * len(classes))
    else:
        w = rows / total
    c = np.array([[0.0 if p == t else (costs or {}).get((p, t), 1.0) for t in classes] for p in classes])
    return Cases(list(features), classes, x, rows.sum(1).astype(int), w, w @ c.T)


class Search:
    def __init__(self, cases: Cases, s: Settings):
        self.c, self.s = cases, s
        self.reg = s.regularisation if s.allow_small else max(s.regularisation, 1 / max(1, cases.n.sum()))
        self.memo: dict = {}
        self.until, self.timed_out = time.monotonic() + s.seconds, False

    def leaf(self, rows: np.ndarray) -> tuple[float, Leaf]:
        cost = self.c.cost[rows].sum(0)
        k = int((cost < cost.min() + EPS).argmax())
        w = self.c.w[rows].sum(0)
        return float(cost[k]) + self.reg, Leaf(self.c.classes[k], float(cost[k]), {str(a): float(b) for a, b in zip(self.c.classes, w, strict=True)})

    def minority(self, rows: np.ndarray) -> float:
        return float(self.c.cost[rows].min(1).sum())

    def halves(self, rows: np.ndarray, f: int) -> tuple[np.ndarray, np.ndarray]:
        on = self.c.x[rows, f] == 1
        return rows[on], rows[~on]

    def gains(self, rows: np.ndarray) -> np.ndarray:
        """Information gain of each feature in bits; -inf where a side has too few rows."""
        x, w, n = self.c.x[rows], self.c.w[rows], self.c.n[rows]
        on = x.T @ w
        both = w.sum(0)

        def bits(a: np.ndarray) -> np.ndarray:
            t = a.sum(-1, keepdims=True)
            p = np.divide(a, t, out=np.zeros_like(a), where=t > 0)
            return -(p * np.log2(np.where(p > 0, p, 1))).sum(-1) * t[..., 0]

        gain = bits(both) - bits(on) - bits(both - on)
        rows_on = x.T @ n
        fit = (rows_on >= self.s.min_rows) & (n.sum() - rows_on >= self.s.min_rows)
        return np.where(fit, gain, -np.inf)

    def greedy(self, rows: np.ndarray, depth: int) -> tuple[float, Tree]:
        """The tree of the best gains (ties: the last feature), cut back where a leaf costs no more."""
        best, leaf = self.leaf(rows)
        gain = self.gains(rows) if depth > 0 and len(rows) > 1 else np.array([-np.inf])
        top = gain.max() if len(gain) else -np.inf
        if top <= EPS:
            return best, leaf
        f = int(np.flatnonzero(gain >= top - EPS)[-1])
        a, b = (self.greedy(x, depth - 1) for x in self.halves(rows, f))
        if a[0] + b[0] < best - EPS:
            return a[0] + b[0], boolean(self.c.features[f], a[1], b[1], prediction=leaf.prediction, loss=leaf.loss, counts=leaf.counts)
        return best, leaf

    def solve(self, rows: np.ndarray, depth: int, frontier: int = 0) -> tuple[float, Tree]:
        """The optimum; with frontier > 0 sets at depth 0 cost what a greedy tree of that depth costs (their leaf is kept)."""
        key = rows.tobytes(), depth
        if key in self.memo:
            return self.memo[key]
        best, tree = self.leaf(rows)
        own = tree
        self.timed_out |= time.monotonic() > self.until
        least = self.minority(rows)
        if depth <= 0 and frontier:
            best = min(best, self.greedy(rows, frontier)[0])
        elif depth > 0 and least + 2 * self.reg < best - EPS and not self.timed_out:
            gain = self.gains(rows)
            out = self.exchanged(rows, np.flatnonzero(gain > -np.inf), depth - 1) if self.s.feature_exchange and not frontier else set()
            for f in np.argsort(-gain, kind="stable")[: self.s.proposals]:
                if gain[f] == -np.inf:
                    break
                if f in out:
                    continue
                a, b = self.halves(rows, int(f))
                low = self.minority(b) + self.reg
                if self.minority(a) + self.reg + low >= best - EPS:
                    continue
                if self.s.rule_list:
                    found = min(((self.leaf(a), self.solve(b, depth - 1, frontier)), (self.solve(a, depth - 1, frontier), self.leaf(b))), key=lambda p: p[0][0] + p[1][0])
                else:
                    one = self.solve(a, depth - 1, frontier)
                    if one[0] + low >= best - EPS:
                        continue
                    found = one, self.solve(b, depth - 1, frontier)
                total = found[0][0] + found[1][0]
                if total < best - EPS:
                    best = total
                    tree = boolean(self.c.features[int(f)], found[0][1], found[1][1], prediction=own.prediction, loss=own.loss, counts=own.counts)
        self.memo[key] = best, tree
        return best, tree

    def exchanged(self, rows: np.ndarray, features: np.ndarray, depth: int) -> set[int]:
        """Features not worth a split. Where a side of i lies inside a side of j, that side of i costs no more; if the other
        side of i has an upper bound no higher than the lower bound of the other side of j, i is as good as j. Neighbouring
        thresholds of one column are such features. Fewest rows a leaf may have would break the first claim: then none goes."""
        if self.s.min_rows > 1 or len(features) < 2:
            return set()
        on = self.c.x[rows][:, features].astype(np.int64)
        sides = np.stack([1 - on, on], 2)  # rows, features, side
        upper, lower = np.empty(sides.shape[1:]), np.empty(sides.shape[1:])
        for k, f in enumerate(features):
            for side, part in enumerate(self.halves(rows, int(f))[::-1]):
                known = self.memo.get((part.tobytes(), depth))
                upper[k, side] = known[0] if known else self.leaf(part)[0]
                lower[k, side] = known[0] if known and not self.timed_out else min(upper[k, side], self.minority(part) + self.reg)
        flat = sides.reshape(len(rows), -1)
        inside = (flat.T @ (1 - flat) == 0).reshape(len(features), 2, len(features), 2)
        gone: set[int] = set()
        for i in range(len(features)):
            if i not in gone:
                ok = inside[i] & (upper[i, ::-1, None, None] <= lower[None, :, ::-1])
                gone |= {int(j) for j in np.flatnonzero(ok.any((0, 2))) if j != i}
        return {int(features[j]) for j in gone}

    def objective(self, rows: np.ndarray, tree: Tree) -> float:
        if isinstance(tree, Leaf):
            return float(self.c.cost[rows][:, self.c.classes.index(tree.prediction)].sum()) + self.reg
        a, b = self.halves(rows, self.c.features.index(tree.feature))
        return self.objective(a, tree.children[0]) + self.objective(b, tree.children[1])

    def fill(self, rows: np.ndarray, tree: Tree, make) -> Tree:  # noqa: ANN001
        """The tree with each leaf replaced by make(its rows)."""
        if isinstance(tree, Leaf):
            return make(rows) if len(rows) else tree
        parts = self.halves(rows, self.c.features.index(tree.feature))
        children = [self.fill(r, c, make) for r, c in zip(parts, tree.children, strict=True)]
        return Split(tree.feature, tree.branches, children, tree.prediction, tree.loss, tree.counts)


@dataclass
class Fitted:
    tree: Tree
    objective: float
    lower: float
    status: str
    more: dict = field(default_factory=dict)


def optimal(cases: Cases, settings: Settings = Settings()) -> Fitted:
    s, rows = Search(cases, settings), np.arange(len(cases.x))
    objective, tree = s.solve(rows, settings.depth)
    proven = not s.timed_out and settings.proposals is None
    lower = objective if proven else min(objective, s.minority(rows) + s.reg)
    return Fitted(tree, objective, lower, "timeout" if s.timed_out else "optimal" if proven else "proposals")


def lookahead(cases: Cases, settings: Settings, steps: int = 2, fill: str = "optimal") -> Fitted:
    """An optimal prefix of ``steps`` levels whose frontier is priced by greedy trees; then each leaf of the prefix is
    completed by an ``optimal`` or ``greedy`` tree of the levels left."""
    s, rows = Search(cases, settings), np.arange(len(cases.x))
    steps = min(steps, settings.depth)
    left = settings.depth - steps
    _, prefix = s.solve(rows, steps, frontier=left)
    rest = Search(cases, settings)
    rest.until = s.until
    make = (lambda r: rest.solve(r, left)[1]) if fill == "optimal" else (lambda r: rest.greedy(r, left)[1])
    tree = s.fill(rows, prefix, make) if left else prefix
    return Fitted(tree, s.objective(rows, tree), s.minority(rows) + s.reg, "timeout" if s.timed_out or rest.timed_out else "done")


def recursive_lookahead(cases: Cases, settings: Settings, steps: int = 1) -> Fitted:
    """Lookahead again in each leaf of the prefix until the depth is used up: fast, and near the optimum."""
    s, rows = Search(cases, settings), np.arange(len(cases.x))

    def grow(r: np.ndarray, depth: int) -> Tree:
        if depth <= 0:
            return s.leaf(r)[1]
        k = min(steps, depth)
        search = Search(cases, settings)
        search.until = s.until  # one deadline for all
        prefix = search.solve(r, k, frontier=depth - k)[1]
        s.timed_out |= search.timed_out
        return prefix if isinstance(prefix, Leaf) else s.fill(r, prefix, lambda x: grow(x, depth - k))

    tree = grow(rows, settings.depth)
    return Fitted(tree, s.objective(rows, tree), s.minority(rows) + s.reg, "timeout" if s.timed_out else "done")


def greedy(cases: Cases, settings: Settings = Settings()) -> Fitted:
    s, rows = Search(cases, settings), np.arange(len(cases.x))
    objective, tree = s.greedy(rows, settings.depth)
    return Fitted(tree, objective, s.minority(rows) + s.reg, "done")


def over_proposals(cases: Cases, settings: Settings = Settings()) -> Fitted:
    """The best tree whose splits at every node are among those of the greedy tree grown there: a decision process over
    proposals, solved backwards. Between the greedy tree and the optimum, at far fewer states than the latter."""
    s, rows = Search(cases, settings), np.arange(len(cases.x))
    memo: dict = {}

    def best(r: np.ndarray, depth: int) -> tuple[float, Tree]:
        key = r.tobytes(), depth
        if key in memo:
            return memo[key]
        cost, leaf = s.leaf(r)
        out: tuple[float, Tree] = cost, leaf
        if depth > 0 and len(r) > 1:
            free = Search(cases, replace(settings, regularisation=0.0, allow_small=True))
            for f in sorted(_used(free.greedy(r, depth)[1], cases.features)):
                halves = s.halves(r, f)
                if min(len(h) and int(cases.n[h].sum()) for h in halves) < max(1, settings.min_rows):
                    continue
                a, b = (best(h, depth - 1) for h in halves)
                if a[0] + b[0] < out[0] - EPS:
                    out = a[0] + b[0], boolean(cases.features[f], a[1], b[1], prediction=leaf.prediction, loss=leaf.loss, counts=leaf.counts)
        memo[key] = out
        return out

    objective, tree = best(rows, settings.depth)
    return Fitted(tree, objective, min(objective, s.minority(rows) + s.reg), "proposals", {"states": len(memo)})


def _used(tree: Tree, features: list[str]) -> set[int]:
    return set() if isinstance(tree, Leaf) else {features.index(tree.feature)}.union(*(_used(c, features) for c in tree.children))


def pareto(cases: Cases, settings: Settings, penalties: Sequence[float], solve=over_proposals) -> list[tuple[int, float, Tree]]:  # noqa: ANN001
    """(leaves, loss, tree) of the trees found under the penalties that no other one beats in both, by leaves."""
    found: dict[int, tuple[float, Tree]] = {}
    for p in penalties:
        tree = solve(cases, replace(settings, regularisation=p, allow_small=True)).tree
        bare = Search(cases, replace(settings, regularisation=0.0, allow_small=True))
        loss, leaves = bare.objective(np.arange(len(cases.x)), tree), _leaves(tree)
        if leaves not in found or loss < found[leaves][0]:
            found[leaves] = loss, tree
    out: list[tuple[int, float, Tree]] = []
    for leaves, (loss, tree) in sorted(found.items()):
        if not out or loss < out[-1][1] - EPS:
            out.append((leaves, loss, tree))
    return out


def _leaves(tree: Tree) -> int:
    return 1 if isinstance(tree, Leaf) else sum(map(_leaves, tree.children))
