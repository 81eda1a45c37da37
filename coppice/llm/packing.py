"""Best-fit packing by patterns: non-negative least squares over few-document length patterns.

Lengths are whole numbers up to the sequence size, so all that packing needs of the corpus is a histogram of at most
``size`` bins, whatever the number of documents. On the driver, patterns of at most three lengths that fill a
sequence are enumerated, their repeat counts fitted to the histogram by non-negative least squares, rounded down, and
the rest is packed best fit, again by bins. The plan says, for each length, which runs of ranks go to which sequences
and offsets; each piece finds its place by its rank among the pieces of its length.

Ranks need no sort and no window over a hot length: a task numbers its pieces of a length as it tokenises them, the
numbered pieces are written to the shared folder, and each (task, length) gets a base by a running sum over task
counts, which are small.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coppice.llm.common import written

#: Words kept per worker; once full, it stays as it is, as frequent words come early.
CACHE = 120_000


class Encoder:
    """Ids of a text by a byte-level BPE vocabulary, word by word through a bounded cache.

    A space between two characters that are no white space always ends a pre-token and starts the next, so the parts
    between such spaces are encoded on their own and looked up by their text. Other texts go to the tokenizer whole.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None):
        import base64
        import json
        import re

        import public_tokenizers
        import tiktoken

        self.vocabulary, self.whole, self.word = vocabulary, None, None
        if ranks:
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.word = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            with open(vocabulary, encoding="utf-8") as f:
                added = [re.escape(t["content"]) for t in json.load(f).get("added_tokens") or []]
            self.added = re.compile("|".join(added)).search if added else lambda text: None
        self.cache: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.word is None or self.added(text):
            return self.slow(text)
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return self.slow(text)
        cache = self.cache
        got = list(map(cache.get, rest))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    w = rest[i]
                    if not w or w[0].isspace() or w[-1].isspace():
                        return self.slow(text)
                    got[i] = array("I", self.word.encode_ordinary(" " + w)).tobytes()
                    if len(cache) < CACHE and len(w) <= 64:
                        cache[w] = got[i]
        return array("I", self.word.encode_ordinary(first)).tobytes() + b"".join(got)

    def slow(self, text: str) -> bytes:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.vocabulary)
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: only longer ones are cut, the first takes the rest."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def patterns(size: int, present: np.ndarray, slack: int = 0) -> np.ndarray:
    """Rows of three lengths (0: none) with a sum of size - slack to size, all present: pairs and triples."""
    rows = [(int(a), 0, 0) for a in present if size - slack <= a <= size]
    have = np.zeros(size + 1, bool)
    have[present] = True
    for gap in range(slack + 1):
        total = size - gap
        a = present[present * 2 >= total]
        a = a[(total - a) > 0]
        b = total - a
        ok = have[b]
        rows += list(zip(a[ok].tolist(), b[ok].tolist(), [0] * int(ok.sum()), strict=True))
        for c in present[present * 3 <= total]:
            b = present[(present >= c) & (2 * present <= total - c)]
            a = total - c - b
            ok = (a >= b) & (a <= size) & (a > 0)
            ok[ok] = have[a[ok]]
            rows += list(zip(a[ok].tolist(), b[ok].tolist(), [int(c)] * int(ok.sum()), strict=True))
    return np.array(rows, np.int64).reshape(-1, 3)


def non_negative_least_squares(rows: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, column p of A counting the lengths of pattern p.

    Accelerated projected gradient; A is used through its row indices only. The step is 1 over a bound of the largest
    eigenvalue of A'A (largest row sum of AA').
    """
    n = len(histogram)
    x = np.zeros(len(rows))
    if not len(rows):
        return x
    used = (rows > 0).astype(float)
    flat = rows.ravel()

    def fill(y: np.ndarray) -> np.ndarray:
        return np.bincount(flat, weights=(y[:, None] * used).ravel(), minlength=n)

    bound = max(1.0, fill(used.sum(1)).max())
    y, t = x, 1.0
    for _ in range(rounds):
        rest = fill(y) - histogram
        rest[0] = 0
        new = np.maximum(0, y - rest[rows].sum(1) / bound)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of sequences that hold exactly the histogram's pieces, none over size."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: dict[tuple[int, ...], int] = defaultdict(int)
    out[(size,)] += int(left[size])
    left[size] = 0
    rows = patterns(size, np.flatnonzero(left))
    repeats = np.floor(non_negative_least_squares(rows, left.astype(float)) + 1e-6).astype(np.int64)
    for p in np.argsort(-repeats, kind="stable"):
        if repeats[p] <= 0:
            break
        lengths = tuple(int(v) for v in rows[p] if v)
        need = {v: lengths.count(v) for v in lengths}
        k = int(min(repeats[p], min(left[v] // c for v, c in need.items())))
        if k > 0:
            out[lengths] += k
            for v, c in need.items():
                left[v] -= c * k
    # What is left goes best fit decreasing, many equal sequences at once: the longest length, then again and again
    # the longest that still fits.
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        lengths, room, take = [longest], size - longest, left.copy()
        take[longest] -= 1
        while room > 0 and len(fits := np.flatnonzero(take[: room + 1])):
            v = int(fits[-1])
            lengths.append(v)
            take[v] -= 1
            room -= v
        need = {v: lengths.count(v) for v in lengths}
        k = int(min(left[v] // c for v, c in need.items()))
        out[tuple(lengths)] += k
        for v, c in need.items():
            left[v] -= c * k
    return [(k, v) for k, v in out.items() if v]


def slots(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset): ranks of a length run through its slots."""
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for lengths, repeats in found:
        at = 0
        for v in lengths:
            out.append((v, rank[v], rank[v] + repeats, sequence, at))
            rank[v] += repeats
            at += v
        sequence += repeats
    return out


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None, size: int, end_id: int) -> DataFrame:
    """Numbered pieces: doc_id, piece, start, length, ids_crc32, task, local_rank (among the task's of that length)."""
    schema = StructType.fromDDL("piece int, start long, length long, ids_crc32 long, task long, local_rank long")
    out_schema = StructType([docs.schema["doc_id"], *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        ranks_so_far = np.zeros(size + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        for whole in batches:
            encoder = encoder or Encoder(vocabulary, ranks)
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                row, piece, start, length, crc, local = [], [], [], [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    ids = encoder.ids(text or "") + end
                    for k, (s, n) in enumerate(pieces_of(len(ids) // 4, size)):
                        row.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
                        local.append(ranks_so_far[n])
                        ranks_so_far[n] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                        pa.array([task] * len(row), pa.int64()),
                        pa.array(local, pa.int64()),
                    ],
                    names=out_schema.names,
                )

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, out_schema)


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Every piece of every document with its sequence and offset.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts have the end id alone;
    repeated rows are packed each; other columns are ignored; no rows give no sequences. ``vocabulary`` is the path of
    the tokenizer's file, ``ranks`` that of the same vocabulary as ranks (optional, faster).
    """
    numbered = written(pieces(docs, vocabulary, ranks, size, end_id), "pieces")
    counts = numbered.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "piece-counts")
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        histogram[r["length"]] = r["n"]
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n"))
    places = defaultdict(list)
    for v, lo, hi, sequence, offset in slots(plan(histogram, size)):
        places[v].append((lo, hi, sequence, offset))
    tables = {v: tuple(np.array(x, np.int64) for x in zip(*runs, strict=True)) for v, runs in places.items()}

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = StructType([*(numbered.schema[c] for c in names[:5]), *StructType.fromDDL("sequence_id long, offset long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                lo, _, first, place = tables[int(length[rows[0]])]
                at = np.searchsorted(lo, rank[rows], side="right") - 1
                sequence[rows] = first[at] + rank[rows] - lo[at]
                offset[rows] = place[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:5]), pa.array(sequence), pa.array(offset)], names=names)

    ranked = numbered.join(base.drop("n").hint("merge"), ["task", "length"]).select(*names[:5], (F.col("base") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(run, schema)
