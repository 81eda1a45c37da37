"""Optimal trees for objectives of two classes that accuracy does not serve: balanced or weighted accuracy, F1, and the
area under the curve of the leaves, or under its first part.

Balanced accuracy, weighted accuracy and F1 fall with false positives and with false negatives whatever the totals, so
the best tree is among those that no other tree beats in (false positives, false negatives, leaves). That frontier is
built from the frontiers of the two sides, with leaves of either class, and is exact.

The area under the curve depends on how leaves rank together, but a tree's curve is the sum of those of its sides, in the
sense that their leaves are put in one order by slope. So a side whose curve lies nowhere above that of another, and that has
no fewer leaves, is in no better tree than the other. The sides left are joined, whatever they are joined with: the best
tree of all is found without a list of trees, for the whole area and for that up to a share of false positives.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from coppice.plans.exact import EPS, Cases, Search, Settings
from coppice.plans.rashomon import ModelSet
from coppice.plans.trees import Leaf, Tree, boolean

#: Losses from shares of false positives and false negatives and the shares of both classes.
LOSSES: dict[str, Callable[[float, float, float, float], float]] = {
    "acc": lambda fp, fn, p, n: fp + fn,
    "bacc": lambda fp, fn, p, n: (fn / p + fp / n) / 2,
    "f1": lambda fp, fn, p, n: (fp + fn) / (2 * p + fp - fn) if 2 * p + fp - fn else 1.0,
}


def weighted(w: float) -> Callable[[float, float, float, float], float]:
    """Loss where a missed positive costs w times a false alarm."""
    return lambda fp, fn, p, n: (w * fn + fp) / (w * p + n)


Point = tuple[float, float, int, object]


def _best(points: list[Point]) -> list[Point]:
    """Those that no other beats in all three."""
    out: list[Point] = []
    for q in sorted(points, key=lambda q: q[:3]):
        if not any(o[0] <= q[0] + EPS and o[1] <= q[1] + EPS and o[2] <= q[2] for o in out):
            out.append(q)
    return out


def frontier(cases: Cases, settings: Settings) -> list[Point]:
    """(false positives, false negatives, leaves, way) of the trees that none beats; class 1 is positive."""
    if len(cases.classes) != 2:
        raise ValueError("two classes are needed")
    s, memo = Search(cases, settings), {}

    def of(rows: np.ndarray, depth: int) -> list[Point]:
        key = rows.tobytes(), depth
        if key not in memo:
            w = cases.w[rows].sum(0)
            points: list[Point] = [(float(w[0]), 0.0, 1, cases.classes[1]), (0.0, float(w[1]), 1, cases.classes[0])]
            if depth > 0 and (w > EPS).all():
                for f in np.flatnonzero(s.gains(rows) > -np.inf):
                    a, b = s.halves(rows, int(f))
                    if len(a) and len(b):
                        points += [(x[0] + y[0], x[1] + y[1], x[2] + y[2], (int(f), x, y)) for x in of(a, depth - 1) for y in of(b, depth - 1)]
            memo[key] = _best(points)
        return memo[key]

    return of(np.arange(len(cases.x)), settings.depth)


def _tree(point: Point, cases: Cases) -> Tree:
    way = point[3]
    if not isinstance(way, tuple):
        return Leaf(way, point[0] + point[1])
    f, a, b = way
    return boolean(cases.features[f], _tree(a, cases), _tree(b, cases), prediction=cases.classes[int(cases.w.sum(0).argmax())], loss=point[0] + point[1])


def optimal(cases: Cases, settings: Settings, objective: str | Callable[[float, float, float, float], float] = "bacc") -> tuple[float, Tree]:
    """(loss + regularisation * leaves, tree) of the optimum; ties: fewer leaves, then fewer false positives."""
    n, p = (float(x) for x in cases.w.sum(0))
    loss = LOSSES[objective] if isinstance(objective, str) else objective
    reg = settings.regularisation
    best = min(frontier(cases, settings), key=lambda q: (round(loss(q[0], q[1], p, n) + reg * q[2], 12), q[2], q[0]))
    return loss(best[0], best[1], p, n) + reg * best[2], _tree(best, cases)


def leaf_area(leaves: list[tuple[float, float]]) -> float:
    """Area under the curve of leaves (positives, negatives) ranked by their share of positives."""
    p, n = sum(a for a, _ in leaves), sum(b for _, b in leaves)
    area = tpr = 0.0
    for a, b in sorted(leaves, key=lambda x: -x[0] / max(x[0] + x[1], EPS)):
        area += b / n * (tpr + a / p / 2)
        tpr += a / p
    return area


def best_area(models: ModelSet) -> tuple[float, Tree]:
    """(1 - area + regularisation * leaves, tree) of the best tree of a model set."""
    cases, s = models.cases, models.search

    def leaves(rows: np.ndarray, t: Tree) -> list[tuple[float, float]]:
        if isinstance(t, Leaf):
            w = cases.w[rows].sum(0)
            return [(float(w[1]), float(w[0]))]
        return [x for r, c in zip(s.halves(rows, cases.features.index(t.feature)), t.children, strict=True) for x in leaves(r, c)]

    scored = []
    for i in range(len(models)):
        found = leaves(np.arange(len(cases.w)), models[i])
        scored.append((1 - leaf_area(found) + s.reg * len(found), i))
    value, i = min(scored)
    return value, models[i]


@dataclass(frozen=True)
class Curve:
    """The leaves of a tree over some rows as (negatives, positives), by falling share of positives, and how it is made."""

    leaves: tuple[tuple[float, float], ...]
    way: object

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        """The corners of the curve by distinct negatives, the most positives of each."""
        x, y = np.cumsum([(0.0, 0.0), *self.leaves], axis=0).T
        last = np.append(np.diff(x) > EPS, True)
        return x[last], y[last]

    def covers(self, other: Curve) -> bool:
        """Whether this curve lies nowhere below the other, of the same rows, with no more leaves."""
        if len(self.leaves) > len(other.leaves):
            return False
        (x, y), (ox, oy) = self.points(), other.points()
        return bool((np.interp(ox, x, y) >= oy - EPS).all())

    def area(self, p: float, n: float, most: float = 1.0) -> float:
        """The area up to the share ``most`` of false positives, as a part of the largest there."""
        x, y = self.points()
        x, y = np.append(x / n, 1.0), np.append(y / p, y[-1] / p)
        inside = np.append(x[x < most], most)
        return float(np.trapezoid(np.interp(inside, x, y), inside)) / most


def _merged(a: Curve, b: Curve, way: object) -> Curve:
    return Curve(tuple(sorted(a.leaves + b.leaves, key=lambda q: -q[1] / max(q[0] + q[1], EPS))), way)


def curve_frontier(cases: Cases, settings: Settings) -> list[Curve]:
    """The curves of trees that no other tree's curve covers; class 1 of two is positive."""
    if len(cases.classes) != 2:
        raise ValueError("two classes are needed")
    s, memo = Search(cases, settings), {}

    def of(rows: np.ndarray, depth: int) -> list[Curve]:
        key = rows.tobytes(), depth
        if key not in memo:
            n, p = (float(x) for x in cases.w[rows].sum(0))
            found = [Curve(((n, p),), cases.classes[int(p > n)])]
            if depth > 0 and n > EPS and p > EPS:
                for f in np.flatnonzero(s.gains(rows) > -np.inf):
                    a, b = s.halves(rows, int(f))
                    if len(a) and len(b):
                        found += [_merged(x, y, (int(f), x, y)) for x in of(a, depth - 1) for y in of(b, depth - 1)]
            kept: list[Curve] = []
            for c in sorted(found, key=lambda c: (len(c.leaves), -c.area(p, n) if p > EPS and n > EPS else 0.0)):
                if not any(k.covers(c) for k in kept):
                    kept.append(c)
            memo[key] = kept
        return memo[key]

    return of(np.arange(len(cases.x)), settings.depth)


def optimal_area(cases: Cases, settings: Settings, most: float = 1.0) -> tuple[float, Tree]:
    """(1 - area + regularisation * leaves, tree) of the best tree of all, the area being that up to the share ``most`` of
    false positives, as a part of the largest there; ties: fewer leaves."""
    n, p = (float(x) for x in cases.w.sum(0))
    reg = settings.regularisation
    best = min(curve_frontier(cases, settings), key=lambda c: (round(1 - c.area(p, n, most) + reg * len(c.leaves), 12), len(c.leaves)))

    def tree(c: Curve) -> Tree:
        if not isinstance(c.way, tuple):
            return Leaf(c.way, min(c.leaves[0]), {str(k): float(w) for k, w in zip(cases.classes, c.leaves[0], strict=True)})
        f, a, b = c.way
        return boolean(cases.features[f], tree(a), tree(b), prediction=cases.classes[int(p > n)], loss=sum(min(q) for q in c.leaves))

    return 1 - best.area(p, n, most) + reg * len(best.leaves), tree(best)
