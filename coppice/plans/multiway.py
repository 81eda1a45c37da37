"""Multiway trees on binned features.

Spark collapses the rows to distinct patterns with class weights and teacher weights; the search runs on these. A node
splits the occupied bins of one feature into 2 to ``max_branching`` groups: an interval program finds the best
contiguous groups for impurity and for loss, then groups may scatter, however many the bins (see scatter.py). Above the
lookahead the best candidates are searched exactly, with bounds; below it one candidate is followed. The best nominee by
impurity and the best by loss are always among those searched. Equal scores are decided by fewer runs, then by stronger
boundaries of the teacher at the cuts.
"""

from __future__ import annotations

import math
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.operators.prep import distinct_values
from coppice.plans import scatter
from coppice.plans.scatter import EPS, gini, loss
from coppice.plans.trees import Leaf, Split, Tree, to_spans


@dataclass(frozen=True)
class Settings:
    depth: int = 3
    lookahead: int | None = None  # default: half the depth, rounded up
    regularisation: float = 0.0
    min_child: int = 1
    min_split: int | None = None  # default: twice min_child
    max_branching: int = 3
    top_k: int | None = None  # default: the square root of the candidates
    scatter_bins: int | None = None  # groups stay contiguous where a feature has more bins than that in a node; None: they never need to
    max_patterns: int = 200_000
    seconds: float = 100.0
    selector: str = "nominees"  # or "linear": contiguous groups only, no horizon, any best split is taken, even over the leaf
    drop_dominated: bool = False  # of nominees of one feature those that another beats in loss or impurity, at no cost in the other, go


@dataclass
class Patterns:
    """Distinct rows: bins (patterns, features), rows, class weights and teacher weights (patterns, classes)."""

    features: list[str]
    classes: list
    z: np.ndarray
    n: np.ndarray
    w: np.ndarray
    soft: np.ndarray
    reference: np.ndarray  # weight on which the teacher errs
    square: np.ndarray  # summed squares of the rows' weights
    strength: dict[str, Sequence[float]] = field(default_factory=dict)  # of the teacher's boundaries above each bin, by feature


def collapse(df: DataFrame, features: Sequence[str], y: str, teacher: Column, weight: Column | None = None, most: int = 200_000) -> Patterns:
    """Patterns of a table. teacher: array of probabilities by class in the order of the labels' text."""
    classes = distinct_values(df, y)
    if len(classes) < 2:
        raise ValueError("two or more classes are needed")
    w = weight if weight is not None else F.lit(1.0)
    code = F.array_position(F.array(*(F.lit(c) for c in classes)), F.col(y)).cast("int") - 1
    rows = df.select(*features, code.alias("_y"), w.cast("double").alias("_w"), teacher.alias("_t"))
    t = lambda k: F.element_at("_t", k + 1)
    believed = F.array_position("_t", F.array_max("_t")).cast("int") - 1
    aggs = [F.sum(F.when(F.col("_y") == k, F.col("_w")).otherwise(0.0)).alias(f"_w{k}") for k in range(len(classes))]
    aggs += [F.sum(F.col("_w") * t(k)).alias(f"_t{k}") for k in range(len(classes))]
    aggs.append(F.sum(F.col("_w") * F.col("_w")).alias("_s"))
    agg = rows.groupBy(*features).agg(F.count(F.lit(1)).alias("_n"), *aggs, F.sum(F.when(believed != F.col("_y"), F.col("_w")).otherwise(0.0)).alias("_e"))
    got = agg.limit(most + 1).toPandas()
    if len(got) > most:
        raise ValueError(f"more than {most} distinct patterns: use fewer bins or the level-wise trees")
    got = got.sort_values(list(features), kind="stable")
    total = got[[f"_w{k}" for k in range(len(classes))]].to_numpy().sum()
    take = lambda p: got[[f"{p}{k}" for k in range(len(classes))]].to_numpy(float) / total
    return Patterns(list(features), classes, got[list(features)].to_numpy(int), got["_n"].to_numpy(int), take("_w"), take("_t"), got["_e"].to_numpy(float) / total, got["_s"].to_numpy(float) / total**2)


def interval_partitions(cost: np.ndarray, ok: np.ndarray, most: int, bonus: np.ndarray | None = None) -> dict[int, tuple[float, list[int]]]:
    """Best contiguous partitions of m atoms by number of groups: (cost, group of each atom). cost[i, j] and ok[i, j] are
    of the atoms i to j - 1. Of equal costs that with the greatest sum of bonus[i] over the cuts before atoms i."""
    m = len(cost) - 1
    best, earned = np.full((most + 1, m + 1), np.inf), np.zeros((most + 1, m + 1))
    back = np.zeros((most + 1, m + 1), int)
    best[0, 0] = 0
    at_cut = np.zeros(m + 1)
    if bonus is not None:
        at_cut[1:m] = bonus[1:]
    masked = np.where(ok, cost, np.inf)
    for g in range(1, most + 1):
        total = best[g - 1][:, None] + masked
        best[g] = total.min(0)
        sums = np.where(total <= best[g] + EPS, (earned[g - 1] + at_cut)[:, None], -np.inf)
        back[g] = sums.argmax(0)
        earned[g] = sums.max(0)
    out = {}
    for g in range(2, most + 1):
        if np.isfinite(best[g, m]):
            group, j = np.zeros(m, int), m
            for k in range(g, 0, -1):
                i = back[k, j]
                group[i:j] = k - 1
                j = i
            out[g] = float(best[g, m]), group.tolist()
    return out


def _intervals(bins: scatter.Bins, k: int) -> list[int] | None:
    """The best contiguous groups of the bins in their order; None if none has enough rows in each."""
    upto = [np.concatenate([np.zeros((1, x.shape[1])), x.cumsum(0)]) for x in (bins.x, bins.n[:, None])]
    cost, rows = bins.cost(upto[0][None] - upto[0][:, None]), (upto[1][None] - upto[1][:, None])[..., 0]
    ok = (rows >= bins.least) & (np.arange(len(cost))[None] > np.arange(len(cost))[:, None])
    found = interval_partitions(np.where(ok, cost, 0), ok, k).get(k)
    return found[1] if found else None


def runs(group: Sequence[int]) -> int:
    return 1 + sum(a != b for a, b in zip(group, group[1:], strict=False))


def canonical(group: Sequence[int]) -> list[int]:
    """Groups numbered in the order in which they appear: equal for partitions that differ in the numbers only."""
    number: dict[int, int] = {}
    return [number.setdefault(g, len(number)) for g in group]


def boundary_penalty(group: Sequence[int], bins: np.ndarray, strength: Sequence[float]) -> float:
    """Strength a bin of the boundaries that a scattered group leaps over, less that of the boundaries cut."""
    upto = np.concatenate([[0.0], np.cumsum(strength)])

    def between(i: int, j: int) -> float:
        lo, hi = (min(int(bins[x]), len(upto) - 1) for x in (i, j))
        return float(upto[hi] - upto[lo]) / max(1, int(bins[j] - bins[i]))

    last: dict[int, int] = {}
    total = 0.0
    for i, g in enumerate(group):
        if g in last and last[g] != i - 1:
            total += between(last[g], i)
        if i and group[i - 1] != g:
            total -= between(i - 1, i)
        last[g] = i
    return total


@dataclass
class Nominee:
    score: float  # impurity of classes and teacher
    runs: int
    penalty: float
    family: str
    ceiling: float  # loss and regularisation, were all groups leaves
    group: list[int]
    candidate: dict

    def order(self) -> tuple:
        return round(self.score, 12), self.runs - self.candidate["groups"], round(self.penalty, 12), self.candidate["groups"], self.candidate["feature"], self.family != "impurity"

    def dominates(self, other: Nominee) -> bool:
        loss_less, score_less = self.ceiling - other.ceiling, self.score - other.score
        return max(loss_less, score_less) <= EPS and min(loss_less, score_less) < -EPS


class Solver:
    def __init__(self, p: Patterns, s: Settings):
        self.p, self.s = p, s
        self.lookahead = min(s.lookahead or max(1, (s.depth + 1) // 2), s.depth) if s.depth else 0
        self.min_split = s.min_split or 2 * s.min_child
        self.memo: dict[tuple[bytes, int], tuple[float, Tree]] = {}
        self.until = time.monotonic() + s.seconds
        self.timed_out = False
        self.evaluated: list[int] = []

    def leaf(self, rows: np.ndarray) -> tuple[float, Leaf]:
        w = self.p.w[rows].sum(0)
        top = len(w) - 1 - int(w[::-1].argmax()) if len(w) == 2 else int(w.argmax())  # of two equal classes the second
        counts = {str(c): float(x) for c, x in zip(self.p.classes, w, strict=True)}
        return float(w.sum() - w.max()) + self.s.regularisation, Leaf(self.p.classes[top], float(w.sum() - w.max()), counts)

    def bound(self, rows: np.ndarray) -> float:
        return float(loss(self.p.w[rows]).sum()) + self.s.regularisation

    def unit(self, rows: np.ndarray) -> float:
        """One over the effective number of rows."""
        total = self.p.w[rows].sum()
        return min(1.0, float(self.p.square[rows].sum() / total**2)) if total > EPS else 1.0

    def candidates(self, rows: np.ndarray) -> list[dict]:
        s, p = self.s, self.p
        unit = self.unit(rows)
        w, soft, n = p.w[rows], p.soft[rows], p.n[rows]
        out = []
        for f in range(p.z.shape[1]):
            bins, at = np.unique(p.z[rows, f], return_inverse=True)
            m = len(bins)
            q = min(m, s.max_branching, int(n.sum()) // s.min_child)
            if q < 2:
                continue
            aw, asoft, an = (np.zeros((m, *x.shape[1:])) for x in (w, soft, n))
            for a, x in ((aw, w), (asoft, soft), (an, n)):
                np.add.at(a, at, x)
            cw, cs, cn = (np.concatenate([np.zeros((1, *x.shape[1:])), x.cumsum(0)]) for x in (aw, asoft, an))
            seg = lambda c: c[None] - c[:, None]
            iw, is_, in_ = seg(cw), seg(cs), seg(cn)
            ok = (in_ >= s.min_child) & (np.arange(m + 1)[None] > np.arange(m + 1)[:, None])
            families = {"impurity": (gini(iw) + gini(is_), lambda g, a=aw, b=asoft: self._groups(g, a, gini) + self._groups(g, b, gini)), "loss": (loss(iw), lambda g, a=aw: self._groups(g, a, loss))}
            strength = p.strength.get(p.features[f], ())
            bonus = np.array([0.0, *(-boundary_penalty([0, 1], bins[i : i + 2], strength) for i in range(m - 1))]) if len(strength) else None
            found = {k: interval_partitions(np.where(ok, c, 0), ok, q, bonus) for k, (c, _) in families.items()}
            for g in range(2, q + 1):
                have = {k: v[g] for k, v in found.items() if g in v}
                if have:
                    hard = min(self._groups(x[1], aw, loss) for x in have.values())
                    out.append({"feature": f, "groups": g, "bins": bins, "at": at, "found": have, "scores": {k: families[k][1] for k in have}, "n": an, "tables": {"impurity": (aw, asoft), "loss": (aw,)},
                                "ceiling": hard + s.regularisation * g, "cheap": min(x[0] + unit * (boundary_penalty(x[1], bins, strength) + g) for x in have.values()), "strength": strength, "loss": families["loss"][1],
                                "floor": float(p.reference[rows].sum()) + s.regularisation * g})
        return out

    @staticmethod
    def _groups(group: list[int], a: np.ndarray, f) -> float:  # noqa: ANN001
        t = np.zeros((max(group) + 1, a.shape[1]))
        np.add.at(t, group, a)
        return float(f(t).sum())

    def nominees(self, c: dict) -> list[Nominee]:
        """Refined partitions of a candidate, those that differ."""
        out: list[Nominee] = []
        for k, (_, group) in c["found"].items():
            if self.s.scatter_bins is None or len(group) <= self.s.scatter_bins:
                bins = scatter.Bins(c["tables"][k], c["n"], *((gini, scatter.gini_slope) if k == "impurity" else (loss, scatter.loss_slope)), self.s.min_child)
                group = scatter.best_groups(bins, group, c["groups"], _intervals)
            group = canonical(group)
            if all(group != other.group for other in out):
                score = c["scores"].get("impurity", c["scores"][k])(group)
                ceiling = c["loss"](group) + self.s.regularisation * c["groups"]
                out.append(Nominee(score, runs(group), boundary_penalty(group, c["bins"], c["strength"]), k, ceiling, group, c))
        return out

    def shortlist(self, found: list[Nominee], upper: float | None, budget: int | None) -> list[Nominee]:
        """The nominees worth a search, in its order. With an upper bound those go whose floor is above it (unless all are), and one that
        attains its floor stays alone. The best by impurity and the best by loss are kept whatever the budget (None: one
        nominee)."""
        if self.s.drop_dominated:
            found = [x for x in found if not any(y.candidate["feature"] == x.candidate["feature"] and y.dominates(x) for y in found)]
        if upper is not None:
            found = [x for x in found if x.candidate["floor"] < upper + EPS] or found
            tight = [x for x in found if x.ceiling <= x.candidate["floor"] + EPS]
            if tight:
                return [min(tight, key=lambda x: (x.ceiling, x.candidate["feature"], x.candidate["groups"], x.runs))]
        found = sorted(found, key=Nominee.order)
        if budget is None:
            return found[:1]
        anchors = [next(i for i, x in enumerate(found) if x.family == k) for k in ("impurity", "loss") if any(x.family == k for x in found)]
        room = max(budget, len(anchors))
        others = [i for i in range(len(found)) if i not in anchors][: room - len(anchors)]
        return [found[i] for i in sorted({*anchors, *others})]

    def solve(self, rows: np.ndarray, depth: int, level: int = 0) -> tuple[float, Tree]:
        key = rows.tobytes(), depth
        if key in self.memo:
            return self.memo[key]
        s = self.s
        best, tree = self.leaf(rows)
        node_loss, counts, prediction = tree.loss, tree.counts, tree.prediction
        self.timed_out |= time.monotonic() > self.until
        w = self.p.w[rows].sum(0)
        if depth > 0 and (w > EPS).sum() > 1 and self.p.n[rows].sum() >= self.min_split and not self.timed_out:
            cands = self.candidates(rows)
            exact = level < self.lookahead
            keep = lambda n: s.top_k or math.isqrt(max(0, n - 1)) + 1
            if exact and level + 1 < self.lookahead:
                upper = min([best, *(c["ceiling"] for c in cands)])
                alive = [c for c in cands if c["floor"] < upper + EPS] or cands
                cands = sorted(alive, key=lambda c: (c["ceiling"] - c["floor"], c["ceiling"], c["cheap"], c["groups"], c["feature"]))[: max(keep(len(alive)), 1)]
            elif not exact:
                cands = sorted(cands, key=lambda c: (c["cheap"], c["groups"], c["feature"]))[:1]
            found = [x for c in cands for x in self.nominees(c)]
            picks = self.shortlist(found, upper if exact and level + 1 < self.lookahead else None, keep(len(found)) if exact else None)
            self.evaluated.append(len(picks))
            for x in picks:
                c, group = x.candidate, x.group
                parts = self.parts(rows, c, group)
                lows = [self.bound(x) for x in parts]
                total, children = sum(lows), []
                for part, low in zip(parts, lows, strict=True):
                    if total >= best - EPS:
                        break
                    cost, child = self.solve(part, depth - 1, level + 1)
                    total += cost - low
                    children.append(child)
                if len(children) == len(parts) and total < best - EPS:
                    best, tree = total, Split(self.p.features[c["feature"]], self.branches(c, group), children, prediction, node_loss, counts)
        self.memo[key] = best, tree
        return best, tree

    @staticmethod
    def parts(rows: np.ndarray, c: dict, group: list[int]) -> list[np.ndarray]:
        return [rows[np.isin(c["at"], [i for i, g in enumerate(group) if g == k])] for k in range(c["groups"])]

    @staticmethod
    def branches(c: dict, group: list[int]) -> list:
        return [to_spans([int(c["bins"][i]) for i, g in enumerate(group) if g == k]) for k in range(c["groups"])]

    def solve_linear(self, rows: np.ndarray, depth: int) -> tuple[float, Tree]:
        """Contiguous groups only. Candidates within one effective row of the cheapest are followed, the square root of
        their number at most; the best of their splits is taken whether or not it beats the leaf. On the last level a child
        must predict another class than the node."""
        key = rows.tobytes(), depth
        if key in self.memo:
            return self.memo[key]
        best, tree = self.leaf(rows)
        node, least = tree, math.inf
        self.timed_out |= time.monotonic() > self.until
        if depth > 0 and (self.p.w[rows].sum(0) > EPS).sum() > 1 and self.p.n[rows].sum() >= self.min_split and not self.timed_out:
            cands = sorted(self.candidates(rows), key=lambda c: (c["cheap"], c["groups"], c["feature"]))
            near = [c for c in cands if c["cheap"] <= cands[0]["cheap"] + self.unit(rows) + EPS]
            near = near[: self.s.top_k or math.isqrt(max(0, len(near) - 1)) + 1]
            self.evaluated.append(len(near))
            for c in near:
                seen: list[list[int]] = []
                for _, group in c["found"].values():
                    if group in seen:
                        continue
                    seen.append(group)
                    solved = [self.solve_linear(x, depth - 1) for x in self.parts(rows, c, group)]
                    total, children = sum(x[0] for x in solved), [x[1] for x in solved]
                    if total < least - EPS and (depth > 1 or any(x.prediction != node.prediction for x in children)):
                        least = best = total
                        tree = Split(self.p.features[c["feature"]], self.branches(c, group), children, node.prediction, node.loss, node.counts)
        self.memo[key] = best, tree
        return best, tree


@dataclass
class Fitted:
    tree: Tree
    objective: float
    lower: float
    upper: float
    lookahead: int
    evaluated: list[int]
    status: str


def fit(df: DataFrame, features: Sequence[str], y: str, teacher_logit: str | None = None, weight: str | None = None, settings: Settings = Settings(),
        strength: Mapping[str, Sequence[float]] | None = None) -> Fitted:
    """Fits a tree to binned columns. teacher_logit: a column of margins (two classes) or of arrays of class logits.
    strength: by feature, that of the boundary above each bin (teacher.relative_strengths)."""
    if settings.selector not in ("nominees", "linear"):
        raise ValueError(f"unknown selector {settings.selector}")
    if teacher_logit is None:
        raise ValueError("teacher_logit is needed: a column of margins or of arrays of class logits")
    lowest = df.agg(*(F.min(f).alias(f"m{i}") for i, f in enumerate(features))).first()
    for f, low in zip(features, lowest, strict=True):
        if low is not None and low < 0:
            raise ValueError(f"bins of {f} must not be negative")
    t = F.col(teacher_logit)
    from coppice.functions.impurity import sigmoid, softmax

    p1 = sigmoid(t) if df.schema[teacher_logit].dataType.typeName() != "array" else None
    probs = F.array(1 - p1, p1) if p1 is not None else softmax(t)
    patterns = collapse(df, features, y, probs, F.col(weight) if weight else None, settings.max_patterns)
    patterns.strength = dict(strength or {})
    return search(patterns, settings)


def search(p: Patterns, settings: Settings) -> Fitted:
    solver = Solver(p, settings)
    rows = np.arange(len(p.z))
    objective, tree = solver.solve_linear(rows, settings.depth) if settings.selector == "linear" else solver.solve(rows, settings.depth)
    return Fitted(tree, objective, min(objective, solver.bound(rows)), objective, solver.lookahead, solver.evaluated, "timeout" if solver.timed_out else "done")
