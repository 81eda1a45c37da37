"""Search over settings: grids and random draws, scored on folds."""

from __future__ import annotations

import itertools
import math
import random
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(**values: Sequence) -> list[dict]:
    return [dict(zip(values, v, strict=True)) for v in itertools.product(*values.values())]


def grid_table(spark: SparkSession, **values: Sequence) -> DataFrame:
    """The grid as a cross join of value tables: constants, so of fixed size."""
    frames = [spark.createDataFrame([(v,) for v in vs], [k]) for k, vs in values.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(F.broadcast(f))
    return out


@dataclass(frozen=True)
class Dimension:
    """A setting's values: whole numbers or numbers of like spread in lo to hi (by logarithm where ``log``), with 0 at
    probability ``zero``; or one of ``values``. Called with a source of randomness it draws one."""

    lo: float = 0.0
    hi: float = 1.0
    log: bool = False
    integer: bool = False
    zero: float = 0.0
    values: tuple = ()

    def __call__(self, r: random.Random) -> object:
        if self.values:
            return r.choice(self.values)
        if self.integer:
            return r.randint(int(self.lo), int(self.hi))
        return 0.0 if r.random() < self.zero else self.back(r.uniform(self.to(self.lo), self.to(self.hi)))

    def to(self, x: float) -> float:
        return math.log(x) if self.log else x

    def back(self, x: float) -> object:
        x = min(max(math.exp(x) if self.log else x, self.lo), self.hi)
        return round(x) if self.integer else x

    def near(self, seen: list, r: random.Random) -> object:
        """A value drawn from a mixture of bells around seen values and the dimension itself."""
        if self.values:
            return r.choice([*seen, *self.values])
        at = r.randrange(len(seen) + 1)
        if at == len(seen) or (self.zero and seen[at] == 0):
            return self(r) if at == len(seen) else 0.0
        return self.back(r.gauss(self.to(seen[at]), self.width(len(seen))))

    def width(self, n: int) -> float:
        return (self.to(self.hi) - self.to(self.lo)) / max(2.0, n**0.5) or 1.0

    def log_density(self, x: object, seen: list) -> float:
        if self.values:
            return math.log((seen.count(x) + 1) / (len(seen) + len(self.values)))
        if self.zero and x == 0:
            return math.log((sum(v == 0 for v in seen) + self.zero) / (len(seen) + 1))
        w, span = self.width(len(seen)), self.to(self.hi) - self.to(self.lo) or 1.0
        bells = sum(math.exp(-(((self.to(x) - self.to(v)) / w) ** 2) / 2) / (w * 2.5066) for v in seen if not (self.zero and v == 0))
        return math.log((bells + 1 / span) / (len(seen) + 1))


def whole(lo: int, hi: int) -> Dimension:
    return Dimension(lo, hi, integer=True)


def log_uniform(lo: float, hi: float, zero: float = 0.0) -> Dimension:
    """Log-uniform between lo and hi, or 0 with probability ``zero``."""
    return Dimension(lo, hi, log=True, zero=zero)


def one_of(*values: object) -> Dimension:
    return Dimension(values=values)


def draws(n: int, seed: int = 0, **space: Callable[[random.Random], object]) -> list[dict]:
    r = random.Random(seed)
    return [{k: f(r) for k, f in space.items()} for _ in range(n)]


def parzen_search(
    score: Callable[[dict], float], trials: int, /, *, seed: int = 0, start: int = 10, share: float = 0.25, tries: int = 24, **space: Dimension
) -> list[tuple[float, dict]]:
    """(score, setting) of ``trials`` settings in the order tried, higher being better, by tree-structured Parzen estimation.

    After ``start`` random settings, each next one is drawn ``tries`` times near the best ``share`` of those tried, and
    the draw is tried whose density among these is highest against that among the others. A setting whose score
    raises a ValueError or ArithmeticError counts as -1.
    """
    r, done = random.Random(seed), []
    for i in range(trials):
        if i < start:
            setting = {k: d(r) for k, d in space.items()}
        else:
            ranked = sorted(done, key=lambda x: -x[0])
            cut = max(1, math.ceil(share * len(ranked)))
            good, bad = ([s for _, s in part] for part in (ranked[:cut], ranked[cut:]))
            drawn = [{k: d.near([s[k] for s in good], r) for k, d in space.items()} for _ in range(tries)]
            setting = max(drawn, key=lambda x: sum(d.log_density(x[k], [s[k] for s in good]) - d.log_density(x[k], [s[k] for s in bad]) for k, d in space.items()))
        try:
            value = score(setting)
        except (ValueError, ArithmeticError):
            value = -1.0
        done.append((value, setting))
    return done


def cross_validate(df: DataFrame, settings: Sequence[dict], fit: Callable[[DataFrame, dict], Callable[[DataFrame], DataFrame]], y: str, folds: int, fold: str = "fold") -> list[dict]:
    """A row for each setting and fold with its accuracy; a setting that fails scores -1. ``fit`` returns a function
    that adds ``predicted``."""
    rows = []
    for i, s in enumerate(settings):
        for k in range(folds):
            try:
                predict = fit(df.where(F.col(fold) != k), s)
                held = predict(df.where(F.col(fold) == k))
                score = held.agg(F.avg(F.col("predicted").eqNullSafe(F.col(y)).cast("int"))).first()[0]
            except (ValueError, ArithmeticError):
                score = -1.0
            rows.append({"setting": i, "fold": k, "accuracy": score, **s})
    return rows


def support(fraction: float, n: int) -> int:
    """Rows that a share stands for, at least two."""
    return max(2, math.ceil(fraction * n))


def feature_sparsity(used: Sequence[str], features: Sequence[str]) -> float:
    """Share of the features that a tree does not use."""
    return 1 - len(set(used) & set(features)) / len(features) if features else 0.0


@dataclass(frozen=True)
class Timing:
    seconds: float  # the best run
    spread: float  # between the runs, relative to the best
    steady: bool


def timed(f: Callable[[], object], warm_up: int = 1, runs: int = 2, spread: float = 0.12, absolute: float = 0.05) -> Timing:
    """The best of some runs after warm-up; steady if the runs differ by no more than ``spread`` of the best, or, where
    that takes less than a second, by ``absolute`` seconds."""
    for _ in range(warm_up):
        f()
    took = []
    for _ in range(runs):
        start = time.perf_counter()
        f()
        took.append(time.perf_counter() - start)
    best, gap = min(took), max(took) - min(took)
    return Timing(best, gap / best if best else 0.0, gap <= spread * best or (best < 1 and gap <= absolute))
