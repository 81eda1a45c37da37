r"""Periodic runs of words: stretches that repeat their first q words again and again.

A run of period q and length L is an island of L - q consecutive places that equal the place q further on. So before any
place is looked at, the matches at every lag are counted, exactly: words that a text has often by the autocorrelation of
their places (a fast Fourier transform each, summed before the one transform back), the other words by the differences
of their places. A lag with fewer matches than its shortest run needs is done. Of the others, places at multiples of
the lag are compared first, as an island holds at least three such neighbours; only stretches around such three are
scanned whole. Repeats of a shorter run's words are runs of the multiples of its period too: their three neighbours
are passed over where they lie within the shorter run, and what is found is checked for a smaller period.

Counting takes n log n steps for a word had often and at most that for others, comparing at multiples of all lags n log n.
A text is one row, and rows are only mapped over: nothing is shuffled or gathered.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from coppice.llm.common import appended

RUN = "struct<start: long, length: long, period: long>"


def lag_matches(ids: np.ndarray, top: int, heavy: float = 0.5) -> np.ndarray:
    """How many places i have ids[i] = ids[i + q], for each lag q from 0 to ``top`` (lag 0 is not counted: 0).

    ids are numbers from 0 without gaps. A word is heavy if a transform takes fewer steps than its pairs: if the square of its
    count is over ``heavy`` times size and logarithm of the transform.
    """
    n = len(ids)
    found = np.zeros(top + 1, np.int64)
    if n < 2 or top < 1:
        return found
    often = np.bincount(ids)
    size = 1 << (n + top - 1).bit_length()
    is_heavy = often.astype(float) ** 2 > heavy * size * np.log2(size)
    words = np.flatnonzero(is_heavy)
    if len(words):
        power = np.zeros(size // 2 + 1)
        for k in words:
            spectrum = np.fft.rfft((ids == k).astype(float), size)
            power += spectrum.real**2 + spectrum.imag**2
        found += np.rint(np.fft.irfft(power, size)[: top + 1]).astype(np.int64)
        found[0] = 0
    places = np.argsort(ids, kind="stable")
    places = places[~is_heavy[ids[places]]]
    word, at, step = ids[places], np.arange(len(places)), 0
    while len(at):  # each light place with the next one of its word, the one after that, and so on, up to the largest lag
        step += 1
        at = at[at < len(places) - step]
        lag = places[at + step] - places[at]
        near = (word[at + step] == word[at]) & (lag <= top)
        found += np.bincount(lag[near], minlength=top + 1)
        at = at[near]
    return found


def _divisors(q: int) -> list[int]:
    """q divided by each of its prime factors: it has a period that divides q, and is smaller, if it has one of these."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return [*out, q // rest] if rest > 1 else out


def runs_of(ids: np.ndarray, times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs, by start, then period: maximal stretches of a smallest period q and of length
    max(least, times * q) or more, with times >= 4."""
    if times < 4:
        raise ValueError("times must be 4 or more")
    n = len(ids)
    top = n // times
    if n < least or top < 1:
        return []
    lags = np.arange(top + 1)
    need = np.maximum(least, times * lags) - lags
    found: list[tuple[int, int, int]] = []
    begin, end, period = (np.zeros(0, np.int64) for _ in range(3))
    for q in np.flatnonzero((lag_matches(ids, top) >= need) & (lags > 0)).tolist():
        anchors = ids[: n - q : q] == ids[q::q]
        three = anchors[:-2] & anchors[1:-1] & anchors[2:]
        at = np.flatnonzero(three)
        if not len(at):
            continue
        inside = np.flatnonzero((end - begin >= 2 * q) & (q % np.maximum(period, 1) == 0))
        for b, e in zip(begin[inside].tolist(), end[inside].tolist(), strict=True):
            at = at[(at * q < b) | (at * q + 2 * q > e)]
        for r in {2 * q * k // 16 for k in range(1, 16)}:  # an island holds all that lies between its three
            at = at[ids[at * q + r] == ids[at * q + r + q]]
        if not len(at):
            continue
        bounds = np.flatnonzero(~anchors)  # an island ends before the next anchor that does not match
        lower = np.searchsorted(bounds, at)
        windows = np.unique(np.stack([np.where(lower > 0, bounds[np.maximum(lower - 1, 0)] * q + 1, 0) if len(bounds) else np.zeros(len(at), int),
                                      np.where(lower < len(bounds), bounds[np.minimum(lower, len(bounds) - 1)] * q, n - q) if len(bounds) else np.full(len(at), n - q)], 1), axis=0)
        before = len(found)
        for lo, hi in windows.tolist():
            match = np.concatenate([[False], ids[lo:hi] == ids[lo + q : hi + q], [False]])
            edge = np.flatnonzero(match[1:] != match[:-1])
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= need[q]:
                    s = lo + a
                    if not any(np.array_equal(ids[s : s + q], ids[s + d : s + d + q]) for d in _divisors(q)):
                        found.append((s, b - a + q, q))
        if len(found) > before:
            new = np.array(found[before:], np.int64)
            begin, end, period = np.append(begin, new[:, 0]), np.append(end, new[:, 0] + new[:, 1]), np.append(period, new[:, 2])
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that some run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)])


def _make(times: int, least: int):
    def run(texts: list[str | None]) -> list:
        n_words, runs, left = [], [], []
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").split() if text else []  # bytes are split at \x20 and \x09-\x0D only
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
            got = runs_of(ids, times, least)
            n_words.append(len(words))
            runs.append([{"start": s, "length": length, "period": q} for s, length, q in got])
            left.append(collapsed(words, got).decode("utf-8", "surrogatepass"))
        return [n_words, runs, left]

    return lambda: run


def find(docs: DataFrame, times: int = 4, least: int = 6, without: tuple[str, ...] = ()) -> DataFrame:
    r"""Adds n_words, runs (array of start, length, period in words, by start, then period) and collapsed to docs.

    Words are ``[^\x20\x09-\x0D]+``, numbered from 0. A run is a stretch of smallest period q and of ``max(least, times * q)``
    words or more that no neighbouring word extends. collapsed is the text without the words that any run holds after its
    first q words, joined by one space. Columns of docs of these names are replaced, those of ``without`` not returned.
    Null and empty texts have no words, no runs and an empty collapsed text; texts are read whole, whatever their length; runs
    that overlap are all given; repeated rows, null ids and ids that repeat are treated row by row; no rows give none.
    """
    return appended(docs, ["text"], f"n_words long, runs array<{RUN}>, collapsed string", _make(times, least), rows=256, without=without)
