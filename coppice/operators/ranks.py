"""Exact order statistics of number columns, by counting: no value is merged with all others in one task.

Values are counted in equal pieces of their range, then in pieces of the pieces that hold a wanted rank, until those have few
rows or one value. Every other round the pieces of a range of several octaves are equal in logarithms, so that columns of any
distribution take a few rounds. Each round is one scan with partial counts for at most ``pieces`` pieces a rank; what comes to the driver
is bounded by the ranks and pieces, however many rows or distinct values there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Statistics:
    """Rows that are not null, how many are NaN, the least and greatest of all (NaN being the greatest), values by rank, from 0,
    and whether a number lies strictly between the least and the greatest, or some value is NaN."""

    n: int
    nan: int
    low: float | None
    high: float | None
    values: dict[int, float]
    between: bool = False

    def quantile(self, p: float) -> float | None:
        """Interpolated between the two ranks beside p * (n - 1)."""
        if not self.n:
            return None
        at = p * (self.n - 1)
        lo, hi = math.floor(at), math.ceil(at)
        a, b = self.values[lo], self.values[hi]
        return a if lo == hi or a == b else (hi - at) * a + (at - lo) * b


def quantile_ranks(n: int, ps: Sequence[float]) -> list[int]:
    return sorted({f(p * (n - 1)) for p in ps for f in (math.floor, math.ceil)}) if n else []


def order_statistics(df: DataFrame, columns: dict[str, Column], ranks: Callable[[int], Sequence[int]], pieces: int = 4096, most: int = 2000) -> dict[str, Statistics]:
    """For each column the values of the ranks that ``ranks`` gives for its number of rows, null left out.

    NaN is above all numbers, and infinities are where they belong. Rows may tie in any number. No rows give no values.
    """
    names = list(columns)
    rows = df.select(*(c.cast("double").alias(f"_{i}") for i, c in enumerate(columns.values())))
    limit = F.lit(float("inf"))
    sums = []
    for i in range(len(names)):
        v = F.col(f"_{i}")
        finite = F.when(~F.isnan(v) & (F.abs(v) < limit), v)
        sums.append(F.struct(F.count(v), F.count_if(F.isnan(v)), F.count_if(v == -limit), F.count_if(v == limit), F.min(finite), F.max(finite)).alias(f"s{i}"))
    found: dict[str, Statistics] = {}
    open_: list[tuple[int, float, float, int, list[int]]] = []  # column, least and greatest value, rows, ranks within
    for i, (n, nan, below, above, lo, hi) in enumerate(rows.agg(*sums).first()):
        wanted = sorted(set(ranks(n)))
        if any(not 0 <= r < n for r in wanted):
            raise ValueError(f"ranks must be from 0 to {n - 1}")
        values = {r: -math.inf for r in wanted if r < below} | {r: math.nan for r in wanted if r >= n - nan} | {r: math.inf for r in wanted if n - nan - above <= r < n - nan}
        low = -math.inf if below else lo if lo is not None else math.inf if above else math.nan if nan else None
        high = math.nan if nan else math.inf if above else hi if hi is not None else -math.inf if below else None
        between = bool(nan or (lo is not None and ((below and lo < high) or (above and hi > low))))
        found[names[i]] = Statistics(n, nan, low, high, values, between)
        if rest := [r for r in wanted if r not in values]:
            open_.append((i, lo, hi, below, rest))
    turn = -1
    while open_:
        turn += 1
        todo, open_ = [x for x in open_ if x[1] < x[2]], [x for x in open_ if x[1] == x[2]]
        for i, lo, _, _, wanted in open_:
            found[names[i]].values.update(dict.fromkeys(wanted, lo))
        open_ = []
        cells: dict[int, list[tuple[float, float, int]]] = {k: [] for k in range(len(todo))}
        counted = _cells(rows, todo, pieces, turn % 2 == 1)
        for k, lo, hi, n in counted:
            cells[k].append((lo, hi, n))
            s = found[names[todo[k][0]]]
            s.between |= any(s.low < x < s.high for x in (lo, hi))
        small: list[tuple[int, float, float, int, list[int]]] = []
        for k, (i, _, _, start, wanted) in enumerate(todo):
            for lo, hi, n in sorted(cells[k]):
                inside = [r for r in wanted if start <= r < start + n]
                if inside:
                    (small if n <= most and lo < hi else open_).append((i, lo, hi, start, inside))
                start += n
        if small:
            values: dict[int, list[tuple[float, int]]] = {k: [] for k in range(len(small))}
            for k, v, n in _values(rows, small):
                values[k].append((v, n))
            for k, (i, _, _, start, wanted) in enumerate(small):
                for v, n in sorted(values[k]):
                    found[names[i]].values.update({r: v for r in wanted if start <= r < start + n})
                    start += n
    return found


def _long(rows: DataFrame, ranges: Sequence[tuple]) -> DataFrame:
    """(k, v, lo, hi) of the values that lie in each range (column, lo, hi, ...), numbered k; ranges of a column do not overlap."""
    of: dict[int, Column] = {}
    for k, (i, lo, hi, *_) in enumerate(ranges):
        v = F.col(f"_{i}")
        told = F.struct(F.lit(k).alias("k"), v.alias("v"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
        inside = (v >= lo) & (v <= hi)
        of[i] = F.when(inside, told) if i not in of else of[i].when(inside, told)
    return rows.select(F.explode(F.array(*of.values())).alias("s")).where("s is not null").select("s.*")


def _octave(v: Column) -> Column:
    """The binary logarithm of the absolute value from the least number on, with the sign of the value: rises with it."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1076))


def _cells(rows: DataFrame, ranges: Sequence[tuple], pieces: int, octaves: bool) -> list[tuple[int, float, float, int]]:
    """(range, least, greatest, rows) of the pieces of each range that hold a row."""
    if not ranges:
        return []
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    part = (v / 2 - lo / 2) / (hi / 2 - lo / 2)  # halves: the difference may overflow
    if octaves:
        many = F.abs(_octave(hi) - _octave(lo)) > 4
        part = F.when(many, (_octave(v) - _octave(lo)) / (_octave(hi) - _octave(lo))).otherwise(part)
    piece = F.greatest(F.lit(0), F.least(F.floor(part * pieces), F.lit(pieces - 1))).alias("p")
    got = _long(rows, ranges).groupBy("k", piece).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    return [tuple(r)[:1] + tuple(r)[2:] for r in got.collect()]  # pieces times ranges


def _values(rows: DataFrame, ranges: Sequence[tuple]) -> list[tuple[int, float, int]]:
    return [tuple(r) for r in _long(rows, ranges).groupBy("k", "v").count().collect()]  # at most ``most`` a range
