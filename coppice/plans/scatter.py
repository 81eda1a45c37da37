"""Partitions of the bins of one feature into groups that need not be contiguous, for any number of bins.

A group costs a concave function of its class weights (and teacher weights), so a best partition puts each bin where the
function's slope at the group's weights makes it cheapest. The search starts from several partitions: the best contiguous
one; the best contiguous one in the order of a class's share, which for two classes is the best of all; and that of
blocks, which are neighbouring bins of one and the same leading class, solved as if they were bins and lifted. Each
start is settled by slopes, then refined by moves of bins and of runs of bins, scored by their difference alone, until
none lowers the cost; then one move that costs nothing may bridge to further ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np

EPS = 1e-12


def gini(w: np.ndarray) -> np.ndarray:
    t = w.sum(-1)
    return t - np.divide((w * w).sum(-1), t, out=np.zeros_like(t), where=t > 0)


def loss(w: np.ndarray) -> np.ndarray:
    return w.sum(-1) - w.max(-1)


def gini_slope(w: np.ndarray) -> np.ndarray:
    t = np.maximum(w.sum(-1, keepdims=True), EPS)
    return 1 - 2 * w / t + (w * w).sum(-1, keepdims=True) / t**2


def loss_slope(w: np.ndarray) -> np.ndarray:
    return 1.0 - (np.arange(w.shape[-1]) == w.argmax(-1)[..., None])


@dataclass(frozen=True)
class Bins:
    """Weights by class of the bins in each of one or two tables (classes, teacher), rows, and what a group costs."""

    tables: tuple[np.ndarray, ...]
    n: np.ndarray
    cost_of: Callable[[np.ndarray], np.ndarray]
    slope_of: Callable[[np.ndarray], np.ndarray]
    least: int  # rows of a group at least

    @property
    def x(self) -> np.ndarray:
        return np.concatenate(self.tables, 1)

    def _parts(self, w: np.ndarray) -> list[np.ndarray]:
        return np.split(w, np.cumsum([t.shape[1] for t in self.tables])[:-1], axis=-1)

    def cost(self, w: np.ndarray) -> np.ndarray:
        return sum(self.cost_of(p) for p in self._parts(w))

    def slope(self, w: np.ndarray) -> np.ndarray:
        return np.concatenate([self.slope_of(p) for p in self._parts(w)], -1)

    def total(self, group: Sequence[int], k: int) -> float:
        return float(self.cost(_sums(self.x, np.asarray(group), k)).sum())

    def feasible(self, group: np.ndarray, k: int) -> bool:
        rows = np.bincount(group, weights=self.n, minlength=k)
        return bool((rows >= self.least).all() and (np.bincount(group, minlength=k) > 0).all())

    def merged(self, of: np.ndarray) -> Bins:
        """Bins merged to those numbered ``of``."""
        m = int(of.max()) + 1
        return Bins(tuple(_sums(t, of, m) for t in self.tables), np.bincount(of, weights=self.n, minlength=m), self.cost_of, self.slope_of, self.least)


def _sums(x: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, x.shape[1]))
    np.add.at(out, group, x)
    return out


def run_count(group: np.ndarray) -> int:
    return 1 + int((group[1:] != group[:-1]).sum())


def settled(bins: Bins, group: np.ndarray, k: int) -> np.ndarray:
    """Each bin goes to the group of the lowest slope, again and again while the cost falls."""
    x, best = bins.x, bins.total(group, k)
    while True:
        new = (x @ bins.slope(_sums(x, group, k)).T).argmin(1)
        if not bins.feasible(new, k) or (cost := bins.total(new, k)) >= best - EPS:
            return group
        group, best = new, cost


class _Moves:
    """A partition with the sums of its groups, and the moves that change its cost."""

    def __init__(self, bins: Bins, group: np.ndarray, k: int):
        self.bins, self.k, self.group = bins, k, group.copy()
        self.x = bins.x
        self.before = np.concatenate([np.zeros((1, self.x.shape[1])), self.x.cumsum(0)])
        self.rows_before = np.concatenate([[0], bins.n.cumsum()])
        self.sums, self.rows = _sums(self.x, group, k), np.bincount(group, weights=bins.n, minlength=k)

    def change(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """(segments, groups): by how much the cost changes if bins lo to hi - 1, all of one group, go to each group."""
        own, w, n = self.group[lo], self.before[hi] - self.before[lo], self.rows_before[hi] - self.rows_before[lo]
        now = self.bins.cost(self.sums)
        out = self.bins.cost(self.sums[own] - w) - now[own]
        change = self.bins.cost(self.sums[None] + w[:, None]) - now[None] + out[:, None]
        change[np.arange(len(lo)), own] = np.inf
        members = np.bincount(self.group, minlength=self.k)[own] > hi - lo
        change[(self.rows[own] - n < self.bins.least) | ~members] = np.inf
        return change

    def apply(self, lo: int, hi: int, to: int) -> None:
        own, w, n = self.group[lo], self.before[hi] - self.before[lo], self.rows_before[hi] - self.rows_before[lo]
        self.sums[own] -= w
        self.sums[to] += w
        self.rows[own] -= n
        self.rows[to] += n
        self.group[lo:hi] = to

    def segments(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All stretches within each run of one group, a run at a time."""
        edge = np.flatnonzero(np.concatenate([[True], self.group[1:] != self.group[:-1], [True]]))
        for a, b in zip(edge, edge[1:], strict=False):
            lo, hi = np.triu_indices(b - a)
            yield a + lo, a + hi + 1

    def descend(self) -> None:
        """The best move of a bin while there is one, else the best move of a stretch, until none lowers the cost."""
        every = np.arange(len(self.group))
        while True:
            change = self.change(every, every + 1)
            at, to = np.unravel_index(change.argmin(), change.shape)
            if change[at, to] < -EPS:
                self.apply(int(at), int(at) + 1, int(to))
                continue
            best = min(((float(c.min()), int(lo[c.min(1).argmin()]), int(hi[c.min(1).argmin()]), int(c[c.min(1).argmin()].argmin())) for lo, hi, c in ((lo, hi, self.change(lo, hi)) for lo, hi in self.segments())), key=lambda m: m[:3])
            if best[0] >= -EPS:
                return
            self.apply(*best[1:])

    def free(self) -> tuple[int, int, int] | None:
        """Of the moves that cost nothing that after which the runs are fewest; ties: the first."""
        found = []
        for lo, hi in self.segments():
            change = self.change(lo, hi)
            for i, to in zip(*np.nonzero(np.abs(change) <= EPS), strict=True):
                ends = [self.group[j] for j in (lo[i] - 1, hi[i]) if 0 <= j < len(self.group)]
                own = self.group[lo[i]]
                found.append((sum(int(to != e) - int(own != e) for e in ends), int(lo[i]), int(hi[i]), int(to)))
        return min(found)[1:] if found else None


def refined(bins: Bins, group: Sequence[int], k: int) -> np.ndarray:
    """Moves single bins and stretches of one group to other groups while the cost falls, then bridges once by a move that
    costs nothing, where that leads to a lower cost, or to fewer runs at the same one."""
    state = _Moves(bins, np.asarray(group), k)
    state.descend()
    while (move := state.free()) is not None:
        before, cost = state.group.copy(), bins.total(state.group, k)
        state.apply(*move)
        state.descend()
        after = bins.total(state.group, k)
        if after < cost - EPS or (after <= cost + EPS and run_count(state.group) < run_count(before)):
            continue
        return before
    return state.group


def blocks_of(table: np.ndarray) -> np.ndarray:
    """Number of the block of each bin: neighbouring bins of one leading class are one block."""
    lead = table.argmax(1)
    return np.concatenate([[0], np.cumsum(lead[1:] != lead[:-1])])


def best_groups(bins: Bins, contiguous: Sequence[int], k: int, intervals: Callable[[Bins, int], Sequence[int] | None]) -> list[int]:
    """The best partition into k groups that the starts lead to; of equal ones that of the fewest runs, then the first start.
    ``intervals`` gives the best contiguous groups of bins in the order in which they are given."""
    starts = [np.asarray(contiguous)]
    for table in bins.tables:
        share = table / np.maximum(table.sum(1, keepdims=True), EPS)
        for c in range(share.shape[1] if share.shape[1] > 2 else 1):
            order = np.argsort(-share[:, c], kind="stable")
            found = intervals(Bins(tuple(t[order] for t in bins.tables), bins.n[order], bins.cost_of, bins.slope_of, bins.least), k)
            if found is not None:
                group = np.zeros(len(order), int)
                group[order] = found
                starts.append(group)
    of = blocks_of(bins.tables[0])
    if k <= of[-1] + 1 < len(of):
        coarse = bins.merged(of)
        found = intervals(coarse, k)
        if found is not None:
            starts.append(refined(coarse, settled(coarse, np.asarray(found), k), k)[of])
    done = [refined(bins, settled(bins, s, k), k) for s in {s.tobytes(): s for s in starts}.values()]
    return min(done, key=lambda g: (round(bins.total(g, k), 12), run_count(g))).tolist()
