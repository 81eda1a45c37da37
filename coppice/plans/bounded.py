"""Optimal sparse trees by a bounded search over a graph of subproblems: valid bounds at any time.

A node is a set of patterns with the depth left, shared by all splits that lead to it. It has a lower and an upper bound
of its objective: at first what its minority costs, and what its leaf costs. The search goes from the root along the
split of the lowest bound to the child whose bounds lie furthest apart, and splits the first node that has not been split
yet. A node whose bounds change tells its parents, deepest first, so that each is computed again once; a split whose
lower bound reaches its node's upper bound cannot win and is passed over. The root's bounds close in on the optimum, and
where time runs out they say how far it may be.
"""

from __future__ import annotations

import heapq
import time
from dataclasses import dataclass, field

import numpy as np

from coppice.plans.exact import EPS, Cases, Fitted, Search, Settings
from coppice.plans.trees import Leaf, Tree, boolean


@dataclass(eq=False)
class Node:
    rows: np.ndarray
    depth: int
    lower: float
    upper: float
    leaf: Leaf
    best: tuple[int, Node, Node] | None = None  # the split of the upper bound; None: the leaf
    splits: list[tuple[int, Node, Node]] | None = None  # None: not split yet
    parents: list[Node] = field(default_factory=list)


class Graph:
    def __init__(self, cases: Cases, settings: Settings):
        self.cases, self.s = cases, Search(cases, settings)
        self.nodes: dict[tuple[bytes, int], Node] = {}
        self.root = self.node(np.arange(len(cases.x)), settings.depth)

    def node(self, rows: np.ndarray, depth: int) -> Node:
        key = rows.tobytes(), depth
        if key not in self.nodes:
            cost, leaf = self.s.leaf(rows)
            low = self.s.minority(rows)
            split = depth > 0 and len(rows) > 1 and low + 2 * self.s.reg < cost - EPS
            self.nodes[key] = Node(rows, depth, min(cost, low + 2 * self.s.reg) if split else cost, cost, leaf, splits=None if split else [])
        return self.nodes[key]

    def expand(self, node: Node) -> None:
        node.splits = []
        for f in np.flatnonzero(self.s.gains(node.rows) > -np.inf):
            a, b = self.s.halves(node.rows, int(f))
            if not len(a) or not len(b) or self.s.minority(a) + self.s.minority(b) + 2 * self.s.reg >= node.upper - EPS:
                continue
            one, two = self.node(a, node.depth - 1), self.node(b, node.depth - 1)
            node.splits.append((int(f), one, two))
            for child in (one, two):
                child.parents.append(node)
        self.tell(node)

    def tell(self, node: Node) -> None:
        """Computes the bounds of a node again, and of those above that depend on them: fewest levels left first."""
        queue, number, waiting = [(node.depth, 0, node)], 1, {id(node)}
        while queue:
            _, _, x = heapq.heappop(queue)
            waiting.discard(id(x))
            leaf = x.leaf.loss + self.s.reg
            lower, upper, best = leaf, leaf, None
            for f, a, b in x.splits or ():
                if a.upper + b.upper < upper - EPS:
                    upper, best = a.upper + b.upper, (f, a, b)
                lower = min(lower, a.lower + b.lower)
            changed = lower > x.lower + EPS or upper < x.upper - EPS
            if upper < x.upper - EPS or (best is not None and x.best is None):
                x.upper, x.best = min(upper, x.upper), best
            x.lower = max(x.lower, min(lower, x.upper))
            if x.splits:
                x.splits = [t for t in x.splits if t[1].lower + t[2].lower < x.upper - EPS or (x.best is not None and t[0] == x.best[0])]
            if changed:
                for p in x.parents:
                    if id(p) not in waiting:
                        waiting.add(id(p))
                        heapq.heappush(queue, (p.depth, number, p))
                        number += 1

    def frontier(self) -> Node | None:
        """The node to split next; None where the root's bounds have met."""
        node = self.root
        while node.splits is not None:
            open_ = [t for t in node.splits if t[1].upper - t[1].lower > EPS or t[2].upper - t[2].lower > EPS]
            if node.upper - node.lower <= EPS or not open_:
                return None
            _, a, b = min(open_, key=lambda t: (t[1].lower + t[2].lower, t[0]))
            node = a if a.upper - a.lower >= b.upper - b.lower else b
        return node

    def tree(self, node: Node) -> Tree:
        if node.best is None:
            return node.leaf
        f, a, b = node.best
        return boolean(self.cases.features[f], self.tree(a), self.tree(b), prediction=node.leaf.prediction, loss=node.leaf.loss, counts=node.leaf.counts)


def optimal(cases: Cases, settings: Settings = Settings(), most: int | None = None) -> Fitted:
    """The best tree found in ``settings.seconds`` and at most ``most`` splits of nodes, with a lower bound that holds for all
    trees. ``more`` has the number of nodes split and (nodes split, lower, upper) whenever the root's bounds changed."""
    g = Graph(cases, settings)
    until, n = time.monotonic() + settings.seconds, 0
    trace = [(0, g.root.lower, g.root.upper)]
    while (node := g.frontier()) is not None:
        if time.monotonic() > until or (most is not None and n >= most):
            return Fitted(g.tree(g.root), g.root.upper, g.root.lower, "timeout", {"expanded": n, "trace": trace})
        g.expand(node)
        n += 1
        if trace[-1][1:] != (g.root.lower, g.root.upper):
            trace.append((n, g.root.lower, g.root.upper))
    return Fitted(g.tree(g.root), g.root.upper, g.root.upper, "optimal", {"expanded": n, "trace": trace})
