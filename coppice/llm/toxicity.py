"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of a word vector and of vectors of its character n-grams, so that unseen spellings share
what their characters tell. A gated recurrent unit reads each window of words in both directions, attention weighs
the states, and a logistic output scores the window. A document's score is that of its highest window; windows of
``window`` words start every ``stride`` words and cover the whole text, whatever its length. A run of word characters
longer than LONGEST (slugs, unspaced scripts) is read as overlapping pieces, each a word.

Training is on the driver, on a bounded sample of labelled rows. Labels are of documents: of a toxic document only
the window that scores highest is a positive example, chosen anew in each round (in the first by the log odds of its
character n-grams), while windows of clean documents are all negatives and the highest of them are kept.

Input projections are cached by word, so scoring costs one small matrix product a word and direction.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import appended, remainder

_WORD = re.compile(r"\w+")
WORD_CELLS, GRAM_CELLS, GRAMS = 1 << 13, 1 << 15, (3, 4, 5)
LONGEST, PIECE_STRIDE = 40, 30


def tokens(text: str | None) -> list[str]:
    found = _WORD.findall(text.lower()) if text else []
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [w[s : s + LONGEST] for w in found for s in starts(len(w), LONGEST, PIECE_STRIDE)]


def cells(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of words, one after another, and how many each has: itself, then its character n-grams (of its
    UTF-8, edges marked), all hashed at once."""
    from xxhash import xxh32_intdigest

    raw = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    size = np.array([len(r) for r in raw], np.int64)
    text = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    end = np.repeat(np.cumsum(size), size)
    at = np.arange(len(text))
    number = np.repeat(np.arange(len(words)), size)
    rows = [np.fromiter((xxh32_intdigest(r) for r in raw), np.int64, len(raw)) % WORD_CELLS]
    owner, kind = [np.arange(len(words))], [np.zeros(len(words), np.int64)]
    for n in GRAMS:
        ok = at + n <= end
        h = np.full(int(ok.sum()), n, np.uint32)
        for j in range(n):
            h = (h ^ text[at[ok] + j]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        rows.append(WORD_CELLS + ((h * np.uint32(0x9E3779B1)) >> np.uint32(12)).astype(np.int64) % GRAM_CELLS)
        owner.append(number[ok])
        kind.append(np.full(len(h), n))
    flat, owner_ = np.concatenate(rows), np.concatenate(owner)
    order = np.lexsort((np.concatenate(kind), owner_))
    return flat[order].astype(np.int32), np.bincount(owner_, minlength=len(words))


def summed(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by their number in ``at``, 0 to n - 1."""
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(first):
        out[at[order][first]] = np.add.reduceat(values[order], first, axis=0)
    return out


@dataclass
class Network:
    """Parameters by name; ``table`` has a vector for each cell."""

    p: dict[str, np.ndarray]
    window: int = 32
    stride: int = 24
    bias: float = 0.0

    @property
    def hidden(self) -> int:
        return self.p["U0"].shape[0]


def fresh(dim: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape: int, s: float) -> np.ndarray:
        return rng.normal(0, s, shape).astype(np.float32)

    p = {"table": normal(WORD_CELLS + GRAM_CELLS, dim, s=0.05)}
    for d in "01":
        p |= {f"W{d}": normal(dim, 3 * hidden, s=dim**-0.5), f"U{d}": normal(hidden, 3 * hidden, s=hidden**-0.5), f"b{d}": np.zeros(3 * hidden, np.float32)}
    return p | {"A": normal(2 * hidden, hidden, s=(2 * hidden) ** -0.5), "a": normal(hidden, s=hidden**-0.5), "o": normal(2 * hidden, s=(2 * hidden) ** -0.5), "c": np.full(1, -2, np.float32)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(p: dict[str, np.ndarray], x: tuple, mask: np.ndarray, keep: bool = False) -> tuple:
    """Logits of windows. x: for either direction, the input projections (windows, 3 hidden) of each step, as an array
    or as a function of the step; mask: (time, windows)."""
    steps, n = mask.shape
    h = p["U0"].shape[0]
    both, kept = np.zeros((steps, n, 2 * h), np.float32), ([], [])
    full = mask.all(1)
    for d in (0, 1):
        u, s = p[f"U{d}"], np.zeros((n, h), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            g, v = x[d](t) if callable(x[d]) else x[d][t], s @ u
            zr = g[:, : 2 * h] + v[:, : 2 * h]
            zr *= np.float32(0.5)
            np.tanh(zr, out=zr)
            zr += 1
            zr *= np.float32(0.5)
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(g[:, 2 * h :] + r * v[:, 2 * h :])
            new = s + z * (c - s)
            if keep:
                kept[d].append((t, s, z, r, c, v[:, 2 * h :]))
            s = new if full[t] else np.where(mask[t][:, None], new, s)
            both[t, :, d * h : (d + 1) * h] = s
    q = np.tanh((both.reshape(-1, 2 * h) @ p["A"]).reshape(steps, n, -1))
    e = np.where(mask, q @ p["a"], np.float32(-30))
    e = np.exp(e - e.max(0))
    alpha = e / e.sum(0)
    pooled = np.einsum("tn,tnh->nh", alpha, both)
    logit = pooled @ p["o"] + p["c"]
    return logit, (kept, both, q, alpha, pooled)


def gradients(p: dict[str, np.ndarray], x: tuple, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict, list]:
    """Loss, gradients of the recurrent and pooling parameters, and those of the input projections."""
    logit, (kept, both, q, alpha, pooled) = forward(p, x, mask, True)
    prob = sigmoid(logit)
    loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / weight.sum())
    dl = (weight * (prob - y) / weight.sum()).astype(np.float32)
    g = {"o": pooled.T @ dl, "c": np.array([dl.sum()], np.float32)}
    dpool = dl[:, None] * p["o"]
    dalpha = (both * dpool).sum(2)
    dboth = alpha[:, :, None] * dpool
    de = alpha * (dalpha - (alpha * dalpha).sum(0))
    g["a"] = np.einsum("tn,tnh->h", de, q)
    dq = de[:, :, None] * p["a"] * (1 - q * q)
    g["A"] = np.einsum("tni,tnh->ih", both, dq)
    dboth = dboth + dq @ p["A"].T
    h, dx = p["U0"].shape[0], []
    for d in (0, 1):
        u, dout = p[f"U{d}"], dboth[:, :, d * h : (d + 1) * h]
        carry, du = np.zeros_like(dout[0]), np.zeros_like(p[f"U{d}"])
        dg = np.zeros((*mask.shape, 3 * h), np.float32)
        for t, s, z, r, c, vc in reversed(kept[d]):
            total = carry + dout[t]
            on = mask[t][:, None]
            dn = np.where(on, total, 0)
            dz, dc = dn * (c - s), dn * z
            dcx = dc * (1 - c * c)
            dr = dcx * vc
            dzx, drx = dz * z * (1 - z), dr * r * (1 - r)
            dg[t] = np.concatenate([dzx, drx, dcx], 1)
            dv = np.concatenate([dzx, drx, dcx * r], 1)
            du += s.T @ dv
            carry = np.where(on, total * (1 - z), total) + dv @ u.T
        g[f"U{d}"] = du
        dx.append(dg)
    return loss, g, dx


class Words:
    """Words numbered from 1 as they come, and their cells."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat, self.size = np.zeros(1, np.int32), np.ones(1, np.int64)  # number 0, the padding, has cell 0

    def __len__(self) -> int:
        return len(self.number) + 1

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        number = self.number
        out = [list(map(number.get, t)) for t in texts]
        new: list[str] = []
        for t, ids in zip(texts, out, strict=True):
            if None in ids:
                for i, k in enumerate(ids):
                    if k is None:
                        k = ids[i] = number.setdefault(t[i], len(number) + 1)
                        if k > len(self.size) + len(new) - 1 + self.dropped:
                            new.append(t[i])
        if new:
            made = [cells(new[i : i + 10_000]) for i in range(0, len(new), 10_000)]
            self.flat = np.concatenate([self.flat, *(f for f, _ in made)])
            self.size = np.concatenate([self.size, *(n for _, n in made)])
        return [np.array(x, np.int32) for x in out]

    dropped = 0

    def first(self) -> np.ndarray:
        """Where each word's cells start."""
        if self.known is None or len(self.known) != len(self.size):
            self.known = np.cumsum(self.size) - self.size
        return self.known

    known: np.ndarray | None = None

    def drop(self) -> None:
        """Forget the cells so far; the numbers stay."""
        self.dropped += len(self.size)
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def vectors(self, table: np.ndarray, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of words (of all with cells if not said): that of the word plus the mean of its n-grams'; with them
        the cells and the share of each."""
        if which is None:
            flat, size = self.flat, self.size
        else:
            size = self.size[which]
            first = self.first()[which]
            flat = self.flat[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        start = np.cumsum(size) - size
        share = np.repeat(1 / np.maximum(1, size - 1), size).astype(np.float32)
        share[start] = 1
        return np.add.reduceat(table[flat] * share[:, None], start, axis=0), flat, share


def starts(n: int, window: int, stride: int) -> list[int]:
    """Windows that cover n words; one, maybe empty, for a text of up to ``window``."""
    return [*range(0, max(1, n - window + stride), stride)] if n > window else [0]


def _windows(docs: list[np.ndarray], window: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (0: none) of all windows (windows, time) and the document of each."""
    at = [starts(len(d), window, stride) for d in docs]
    owner = np.repeat(np.arange(len(docs)), [len(a) for a in at])
    out = np.zeros((len(owner), window), np.int32)
    k = 0
    for d, a in zip(docs, at, strict=True):
        for s in a:
            part = d[s : s + window]
            out[k, : len(part)] = part
            k += 1
    return out, owner


def train(
    texts: list[str | None], labels: list[int], dim: int = 12, hidden: int = 8, rounds: int = 2, epochs: int = 3, batch: int | None = None,
    window: int = 32, stride: int = 24, rate: float = 0.01, seed: int = 7, least_steps: int = 200,
) -> Network:
    """Fits the network to all windows of labelled texts. Small samples are gone through more often, ``least_steps``
    steps a round at least, and in smaller batches."""
    batch = batch or (256 if len(texts) >= 2000 else 64)
    rng = np.random.default_rng(seed)
    words = Words()
    docs = [d for i in range(0, len(texts), 200) for d in words.ids([tokens(t) for t in texts[i : i + 200]])]
    y = np.array(labels, np.float32)
    p = fresh(dim, hidden, rng)
    net = Network(p, window, stride)
    if not len(docs) or not 0 < y.sum() < len(y):
        p["o"][:] = 0
        p["c"][:] = 4 if len(y) and y.all() else -4
        return net
    every, owner = _windows(docs, window, stride)
    score = _log_odds(words, docs, y)[every].max(1)
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    step = 0
    for turn in range(rounds):
        if turn:
            score = _score(p, words, every)
        top = _top(score, owner, len(docs))
        hard = np.argsort(-score, kind="stable")
        hard = hard[y[owner[hard]] == 0][: 2 * len(docs)]
        negative = np.unique(np.concatenate([top[y == 0], hard, rng.permutation(np.flatnonzero(y[owner] == 0))[: 2 * len(docs)]]))
        chosen = np.concatenate([top[y == 1], negative])
        target = y[owner[chosen]]
        weight = np.where(target == 1, min(4.0, 0.25 * len(negative) / max(1, int(target.sum()))), 1).astype(np.float32)
        for _ in range(max(epochs, -(-least_steps * batch // len(chosen)))):
            order = rng.permutation(len(chosen))
            for i in range(0, len(order), batch):
                b = order[i : i + batch]
                step += 1
                _learn(p, m, v, step, words, every[chosen[b]], target[b], weight[b], rate * (0.5**turn))
    score = _score(p, words, every)
    best = score[_top(score, owner, len(docs))]
    net.bias = calibration(best, y)
    return net


def calibration(best: np.ndarray, y: np.ndarray) -> float:
    """Shift of the logits that puts the decision bound (score 0.7) where most documents are told right."""
    order = np.argsort(best, kind="stable")
    errors = np.concatenate([[0], np.cumsum(y[order])]) + np.concatenate([np.cumsum((1 - y[order])[::-1])[::-1], [0]])
    lowest = np.flatnonzero(errors == errors.min())
    k = int(lowest[len(lowest) // 2])
    s = best[order]
    cut = s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else (s[k - 1] + s[k]) / 2
    return float(np.log(0.7 / 0.3) - cut)


def _top(score: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((-score, owner))
    return order[np.searchsorted(owner[order], np.arange(n))]


def _log_odds(words: Words, docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """For each word, the highest log odds of being in a toxic document among its cells; 0 for the padding."""
    n = WORD_CELLS + GRAM_CELLS
    seen = np.zeros((2, n))
    first = np.cumsum(words.size) - words.size
    for d, label in zip(docs, y, strict=True):
        if len(d):
            which = np.unique(d)
            size = words.size[which]
            at = np.repeat(first[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            seen[int(label), np.unique(words.flat[at])] += 1
    pos, neg = max(1, y.sum()), max(1, (1 - y).sum())
    odds = (np.log((seen[1] + 0.5) / (pos + 1)) - np.log((seen[0] + 0.5) / (neg + 1))) * np.minimum(1, seen[1] / 5)
    best = np.maximum.reduceat(odds.astype(np.float32)[words.flat], first)
    best[0] = 0
    return best


def _learn(p, m, v, step, words, win, y, weight, rate) -> None:  # noqa: ANN001
    used, at = np.unique(win, return_inverse=True)
    at = at.reshape(win.shape).T
    vec, flat, share = words.vectors(p["table"], used)
    vec[used == 0] = 0
    x = tuple((vec @ p[f"W{d}"] + p[f"b{d}"])[at] for d in (0, 1))
    _, g, dx = gradients(p, x, (win > 0).T, y, weight)
    dvec = np.zeros_like(vec)
    for d in (0, 1):
        per_word = summed(dx[d].reshape(-1, dx[d].shape[2]), at.ravel(), len(used))
        g[f"W{d}"], g[f"b{d}"] = vec.T @ per_word, per_word.sum(0)
        dvec += per_word @ p[f"W{d}"].T
    dvec[used == 0] = 0
    norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
    if norm > 5:
        g = {k: x * (5 / norm) for k, x in g.items()}
    for k, x in g.items():
        m[k] += 0.1 * (x - m[k])
        v[k] += 0.01 * (x * x - v[k])
        p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    rows, back = np.unique(flat, return_inverse=True)
    gt = summed(np.repeat(dvec, words.size[used], axis=0) * share[:, None], back.ravel(), len(rows))
    v["table"][rows] += gt * gt
    p["table"][rows] -= rate * 3 * gt / (np.sqrt(v["table"][rows]) + 1e-8)


def _score(p: dict, words: Words, win: np.ndarray, chunk: int = 2048) -> np.ndarray:
    proj = [np.empty((len(words), p["U0"].shape[1]), np.float32) for _ in (0, 1)]
    for i in range(0, len(words), 10_000):
        vec = words.vectors(p["table"], np.arange(i, min(i + 10_000, len(words))))[0]
        for d in (0, 1):
            proj[d][i : i + 10_000] = vec @ p[f"W{d}"] + p[f"b{d}"]
    for d in (0, 1):
        proj[d][0] = p[f"b{d}"]
    out = np.empty(len(win), np.float32)
    for i in range(0, len(win), chunk):
        w = win[i : i + chunk].T
        out[i : i + chunk] = forward(p, tuple((lambda t, x=x: x[w[t]]) for x in proj), w > 0)[0]  # noqa: B023
    return out


class Scorer:
    """Scores texts; keeps the input projections of up to ``most`` words."""

    def __init__(self, net: Network, most: int = 80_000):
        self.net, self.most = net, most
        self.clear()

    def clear(self) -> None:
        self.words = Words()
        h3 = 3 * self.net.hidden
        self.proj = [np.zeros((1 << 14, h3), np.float32) for _ in (0, 1)]
        self.project()
        for d in (0, 1):
            self.proj[d][0] = self.net.p[f"b{d}"]

    def project(self) -> None:
        done, n = self.words.dropped, len(self.words)
        while n > len(self.proj[0]):
            self.proj = [np.concatenate([x, np.zeros_like(x)]) for x in self.proj]
        if n > done:
            vec = self.words.vectors(self.net.p["table"])[0]
            for d in (0, 1):
                self.proj[d][done:n] = vec @ self.net.p[f"W{d}"] + self.net.p[f"b{d}"]
            self.words.drop()

    def __call__(self, texts: list[str | None], chunk: int = 2048) -> np.ndarray:
        """A score in 0 to 1 for each text: that of its highest window."""
        if len(self.words) > self.most:
            self.clear()
        net = self.net
        docs = self.words.ids([tokens(t) for t in texts])
        self.project()
        best = np.full(len(texts), -np.inf, np.float32)
        win, owner = _windows(docs, net.window, net.stride)
        for i in range(0, len(win), chunk):
            w = win[i : i + chunk].T
            logit = forward(net.p, tuple((lambda t, x=x: x[w[t]]) for x in self.proj), w > 0)[0]
            np.maximum.at(best, owner[i : i + chunk], logit)
        return sigmoid(best.astype(float) + net.bias)


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_clean: int = 2500, **options) -> Network:  # noqa: ANN003
    """Trains on labelled rows: doc_id, text of docs joined with doc_id, toxic of labels.

    The sample is bounded: of either label all ids, or, if there are more, the ``max_toxic`` and ``max_clean`` of the
    smallest hash of doc_id. Their texts are read whole. Null labels and ids are left out; an id that is labelled more
    than once is toxic if one label says so; of documents that repeat an id the one of the smallest text is learned
    from. Without labelled rows of both kinds all texts score alike.
    """
    usable = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = {r["doc_id"]: r["toxic"] for y, n in ((0, max_clean), (1, max_toxic)) for r in usable.where(F.col("toxic") == y).orderBy(*order).limit(n).collect()}
    if not chosen:
        return train([], [], **options)
    rows = docs.where(F.col("doc_id").isin(list(chosen))).groupBy("doc_id").agg(F.min("text").alias("text"))
    got = sorted((r["doc_id"], r["text"] or "") for r in rows.collect())
    return train([t for _, t in got], [chosen[i] for i, _ in got], **options)


def _make(net: Network):
    scorer = Scorer(net)

    def run(texts: list[str | None]) -> list:
        return [scorer(texts).tolist()]

    return run


def score(docs: DataFrame, net: Network, threshold: float = 0.7, without: tuple[str, ...] = ()) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold, else 0) to docs, replacing columns of these names.

    Null and empty texts are scored as one window without words; repeated rows are scored each, alike; no rows give
    none. Columns of ``without`` are not returned.
    """
    got = appended(docs.drop("predicted"), ["text"], "score double", partial(_make, net), rows=250, without=without)
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fit_score(docs: DataFrame, labels: DataFrame, fold: int = 3, without: tuple[str, ...] = ()) -> DataFrame:
    """Learns from rows whose crc32(doc_id as text) mod ``fold`` is not 1, scores all, adds held_out as well."""
    net = fit(docs, labels.where(remainder("doc_id", fold) != 1))
    return score(docs.drop("held_out"), net, without=without).withColumn("held_out", remainder("doc_id", fold) == 1)
