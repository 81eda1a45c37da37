"""Near-duplicate vectors by cosine through an inverted multi-index.

Two independent codebooks, on the halves of the unit vectors, form a product grid of cells. From its own cell a
vector visits others in the order of multi-sequence traversal: by the sum over both halves of the squared distance to
the bisector with the own centroid, which bounds from below the squared distance to anything in that cell. It stops
at the sum within which partners at the threshold lie with the target recall; that stop is measured when the index is
fitted, on partners drawn at the threshold around the sample's vectors. Of two cells only the lower visits the higher,
so a pair is met once. Every met pair is verified in double precision.

Every vector is indexed and every vector asks. Equal vectors are collapsed first and counted with their multiplicity.
Cells of one row of the grid make a region (of up to GROUP neighbouring columns): a vector travels once to each region
it visits, with a mask of its cells there, and in the numbers' own precision. The members of a region and its visitors
meet in blocks of bounded size; a block's matrices of cosines give link counts and a spanning forest of its links, so
dense groups send neither pairs nor squares of their size over the network.

Vectors of each length have an index of their own; those of lengths that the sample has not share one cell each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import written
from coppice.llm.graph import components

#: Members and visitors of a block; columns of the grid in a region.
MEMBERS, VISITORS, GROUP = 2048, 8192, 16


@dataclass(frozen=True)
class Index:
    dim: int
    books: tuple[np.ndarray, np.ndarray]
    stop: float

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = (nearest(x, c) for x, c in zip(self.halves(unit), self.books, strict=True))
        return a * len(self.books[1]) + b

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = (self.dim + 1) // 2
        return unit[:, :h], unit[:, h:]

    def bounds(self, unit: np.ndarray) -> list[np.ndarray]:
        return [bisectors(x, c) for x, c in zip(self.halves(unit), self.books, strict=True)]

    def visits(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, cell) of all visits, nearest cells first for each vector; the own cell among them."""
        first, second = self.bounds(unit)
        order1, order2 = np.argsort(first, 1, kind="stable"), np.argsort(second, 1, kind="stable")
        sorted1, sorted2 = np.take_along_axis(first, order1, 1), np.take_along_axis(second, order2, 1)
        who, cell, cost = [], [], []
        alive = np.arange(len(unit))
        for r in range(first.shape[1]):  # along the first sequence while its own part leaves room for the second
            alive = alive[sorted1[alive, r] <= self.stop]
            if not len(alive):
                break
            room = self.stop - sorted1[alive, r]
            many = (sorted2[alive] <= room[:, None]).sum(1)
            rows = np.repeat(alive, many)
            at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            who.append(rows)
            cell.append(order1[rows, r] * len(self.books[1]) + order2[rows, at])
            cost.append(sorted1[rows, r] + sorted2[rows, at])
        if not who:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, cell, cost = (np.concatenate(x) for x in (who, cell, cost))
        order = np.lexsort((cost, who))
        return who[order], cell[order]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None])


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return squared(x, c).argmin(1)


def bisectors(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of x to the bisector between its nearest centroid and each other; 0 for its own."""
    d = squared(x, c)
    own = d.argmin(1)
    gap = np.sqrt(squared(c[own], c))
    out = (d - d[np.arange(len(x)), own][:, None]) / np.where(gap > 0, 2 * gap, 1)
    return np.where(gap > 0, out * out, 0)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centroids, ordered along their direction of largest spread, so that neighbours have numbers nearby."""
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    if not c.size:
        return c
    axis = np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0]
    return c[np.argsort(c @ axis, kind="stable")]


def build(sample: np.ndarray, k: int, threshold: float, recall: float, seed: int = 5) -> Index:
    """Codebooks of k centroids a half, and the stop that reaches ``recall`` for partners at the threshold."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    h = (dim + 1) // 2
    books = tuple(codebook(x, k, rng) for x in (sample[:, :h], sample[:, h:]))
    index = Index(dim, books, np.inf)
    x = sample[rng.integers(0, len(sample), 4096)]
    r = rng.normal(size=x.shape)
    r -= (r * x).sum(1)[:, None] * x
    size = np.linalg.norm(r, axis=1)
    y = threshold * x + (1 - threshold**2) ** 0.5 * np.divide(r, size[:, None], out=np.zeros_like(r), where=size[:, None] > 0)
    # Of a pair the lower cell asks, so both directions count alike; the nearer links are found more often.
    first, second = index.bounds(x)
    a, b = np.divmod(index.cells(y), len(books[1]))
    at = np.arange(len(x))
    return Index(dim, books, float(np.quantile(first[at, a] + second[at, b], recall)) + 1e-12)


def lengths(column: pa.Array) -> np.ndarray:
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are usable vectors of the dimension, their values in double precision)."""
    size = lengths(column)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dim) if dim else np.zeros(0, np.int64)
    values = flat[(np.cumsum(size) - size)[rows][:, None] + np.arange(dim)]
    ok = np.isfinite(values).all(1) & values.any(1)
    return rows[ok], values[ok]


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is taken out first, so that no square overflows or vanishes."""
    if not values.size:
        return values
    values = values / np.abs(values).max(1)[:, None]
    return values / np.linalg.norm(values, axis=1)[:, None]


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the rows and columns of a boolean matrix by connected component (lowest row; -1 without a link)."""
    n = len(linked)
    rows = np.where(linked.any(1), np.arange(n), n)
    while True:
        columns = np.where(linked, rows[:, None], n).min(0)
        new = np.minimum(rows, np.where(linked, columns[None], n).min(1))
        if (new == rows).all():
            break
        rows = new
    return np.where(rows < n, rows, -1), np.where(columns < n, columns, -1)


def _blocks(batches: Iterator[pa.RecordBatch], threshold: float, dtype: str) -> Iterator[pa.RecordBatch]:
    """Rows come by (region, part, turn), the members of a block before its visitors. Yields counts and forest edges."""
    names = ("a", "b", "n")
    key, members = None, []
    held: list | None = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("region", "part", "turn")], 1)
        kind = batch.column("visitor").to_numpy(zero_copy_only=False)
        change = np.ones(len(keys), bool)
        change[1:] = (keys[1:] != keys[:-1]).any(1) | (kind[1:] != kind[:-1])
        cuts = [*np.flatnonzero(change), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(lo, hi - lo)
            if key is None or (keys[lo] != key).any():
                key, members, held = keys[lo], [], None
            if not kind[lo]:
                members.append(part)
                continue
            if held is None:
                held = list(_by_cell(*_loaded(pa.Table.from_batches(members), dtype))) if members else []
            asking = _loaded(pa.Table.from_batches([part]), dtype)
            for cell, ids, m, vectors in held:
                at = np.flatnonzero(asking[4] >> (cell % GROUP) & 1)
                for which in np.split(at, range(1024, len(at), 1024)):
                    if len(which):
                        found = _met(asking[0][which], asking[1][which], asking[2][which], asking[3][which] == cell, ids, m, vectors, threshold)
                        if found is not None:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)


def _met(
    a: np.ndarray, ma: np.ndarray, va: np.ndarray, own: np.ndarray, b: np.ndarray, mb: np.ndarray, vb: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(id, root, links) of the ids that have links: visitors a (``own``: the cell is theirs), members b, m copies each."""
    linked = (va @ vb.T >= threshold) & (a[:, None] != b[None])
    if not linked.any():
        return None
    rows, columns = spanning(linked)
    ids = np.concatenate([a[rows >= 0], b[columns >= 0]])
    roots = a[np.concatenate([rows[rows >= 0], columns[columns >= 0]])]
    n_b = np.where(own, 0, ma) @ linked  # within a cell the partner asks as well
    return ids, roots, np.concatenate([(linked @ mb)[rows >= 0], n_b[columns >= 0]]).astype(np.int64)


def _loaded(t: pa.Table, dtype: str) -> tuple[np.ndarray, ...]:
    """id, m, unit vectors, own cell, mask."""
    values = np.frombuffer(b"".join(t.column("vector").to_pylist()), dtype).reshape(t.num_rows, -1).astype(float)
    id_, m, own, mask = (t.column(c).to_numpy() for c in ("id", "m", "own", "mask"))
    return id_, m, unit(values), own, mask


def _by_cell(ids: np.ndarray, m: np.ndarray, vectors: np.ndarray, own: np.ndarray, _: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(own, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
        yield int(own[part[0]]), ids[part], m[part], vectors[part]


#: Numbers of cells of one length; a cell's number holds the length above them.
_CELLS = 1 << 24


def linked(
    vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999, sample: int = 20_000, per_cell: int = 256, most_centroids: int = 1024
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vec_id (whole number), embedding (array of numbers).

    Rows whose vector is null, empty, zero, or holds null or non-finite components link with nothing, nor do vectors
    of different lengths. Rows without an id are returned with no links and a null component, kept. Rows that repeat
    an id count as one vector if equal, else as several of one id. No rows give none. Other columns are ignored. The
    codebooks are fitted on the ``sample`` rows of the smallest hash of vec_id; all rows are indexed. Components of
    equal value at other precision (0.1 as float and as double) are of one column's type, so equal vectors are equal.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("embedding"))
    known = rows.where("id is not null")
    spark = vectors.sparkSession
    dtype = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() in ("float", "byte", "short") else "<f8"
    picked = known.where("size(embedding) > 0").orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow()
    column = picked.column(0).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    alone = F.lit(0).cast("long")
    n = known.count()
    found: dict[int, Index] = {}
    for dim in np.unique(lengths(column)[lengths(column) > 0]).tolist() if len(column) else []:
        values = matrix(column, dim)[1]
        if len(values):
            share = len(values) / len(column)
            k = int(np.clip(np.ceil((n * share / per_cell) ** 0.5), 1, min(most_centroids, len(values))))
            found[dim] = build(unit(values), k, threshold, recall)
    if not found:
        found = {0: Index(0, (np.zeros((0, 0)), np.zeros((0, 0))), 0.0)}
    indexes = spark.sparkContext.broadcast(found)  # bounded: codebooks over at most ``sample`` vectors

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            for dim in np.unique(lengths(lists)).tolist():
                ok, values = matrix(lists, dim)
                if len(ok):
                    values = (values + 0.0).astype(dtype)  # one zero
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), pa.array([x.tobytes() for x in values], pa.binary())], names=["id", "vector"])

    usable = written(known.mapInArrow(parse, "id long, vector binary").withColumn("digest", F.md5("vector")), "vectors")
    same = usable.groupBy("digest").agg(F.min("id").alias("id"), F.count_distinct("id").alias("m"), F.first("vector").alias("vector"))
    same = written(same, "distinct-vectors")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(dtype).itemsize
        for whole in batches:
            raw = whole.column("vector")
            size = np.array([len(x) for x in raw.to_pylist()], np.int64) // width
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                for i in range(0, len(rows), 512):
                    batch = whole.take(pa.array(rows[i : i + 512]))
                    index, base = indexes.value.get(dim), dim * _CELLS
                    who, cell, own = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                    if index:
                        u = unit(np.frombuffer(b"".join(batch.column("vector").to_pylist()), dtype).reshape(batch.num_rows, -1).astype(float))
                        own, columns = index.cells(u), len(index.books[1])
                        who, cell = index.visits(u)
                        up = cell >= own[who]
                        who, cell = who[up], cell[up]
                        spread = -(-columns // GROUP) * GROUP  # so that no region has cells of two rows of the grid
                        own, cell = (x // columns * spread + x % columns for x in (own, cell))
                    own, cell = own + base, cell + base
                    order = np.lexsort((cell, who))
                    who, region, bit = who[order], cell[order] // GROUP, 1 << (cell[order] % GROUP)
                    new = np.flatnonzero(np.diff(who, prepend=-1).astype(bool) | np.diff(region, prepend=-1).astype(bool))
                    mask = np.bitwise_or.reduceat(bit, new)
                    start = np.searchsorted(who[new], np.arange(batch.num_rows + 1))
                    visits = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(region[new] * (1 << GROUP) + mask, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "m", "vector")), pa.array(own, pa.int64()), visits], names=["id", "m", "vector", "own", "visits"])

    placed = written(same.select("id", "m", "vector").mapInArrow(place, "id long, m long, vector binary, own long, visits array<long>"), "placed")
    region_of = (F.col("own") / GROUP).cast("long")
    split = F.col("visit").bitwiseAND((1 << GROUP) - 1), F.shiftright("visit", GROUP)
    members = placed.groupBy(region_of.alias("region")).agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    visited = placed.select(F.explode("visits").alias("visit")).groupBy(split[1].alias("region")).agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("turns"))
    sized = members.join(visited, "region")  # at most one row for each region of the grids
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = placed.withColumn("region", region_of).join(sized, "region").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).select(
        "region", "part", every("turns").alias("turn"), F.lit(False).alias("visitor"), "id", "m", "vector", "own", F.lit(0).cast("long").alias("mask"))
    asking = placed.select("id", "m", "vector", "own", F.explode("visits").alias("visit")).withColumns({"mask": split[0], "region": split[1]}).join(sized, "region")
    asking = asking.withColumn("turn", F.pmod(F.xxhash64("id"), "turns").cast("int")).select(
        "region", every("parts").alias("part"), "turn", F.lit(True).alias("visitor"), "id", "m", "vector", "own", "mask")
    dealt = held.unionByName(asking).repartition("region", "part", "turn").sortWithinPartitions("region", "part", "turn", "visitor")
    met = written(dealt.mapInArrow(partial(_blocks, threshold=threshold, dtype=dtype), "a long, b long, n long"), "met")

    counts = met.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    classes = components(met.select("a", "b"))
    by_vector = (
        same.select("digest", "id", "m").join(counts, "id", "left").join(classes, "id", "left")
        .select("digest", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    by_row = usable.select("id", "digest").distinct().join(by_vector, "digest").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return rows.select("id").join(by_row, "id", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", alone).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def recall_against_brute_force(vectors: DataFrame, threshold: float = 0.95, every: int = 100, block: int = 20_000, **options) -> float:  # noqa: ANN003
    """Share of the links of all rows whose id is divisible by ``every`` that the index finds; 1.0 where there are none.

    Link counts are compared: verified links are a subset of all, so the counts' ratio is the recall. The rows asked
    are held against all rows in blocks of at most ``block``, one block of them on the driver at a time.
    """
    got = linked(vectors, threshold, **options).where(F.col("vec_id") % every == 0)
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), "embedding")
    asked = rows.where((F.col("vec_id") % every == 0) & (F.size("embedding") > 0)).toLocalIterator()
    true = 0
    while part := [(r[0], r[1]) for _, r in zip(range(block), asked, strict=False)]:
        table = pa.table({"id": [i for i, _ in part], "x": [x for _, x in part]})
        lists = table.column("x").combine_chunks()
        dims = {}
        for dim in np.unique(lengths(lists)).tolist():
            at, values = matrix(lists, dim)
            dims[dim] = np.array([part[i][0] for i in at], np.int64), unit(values)
        shared = vectors.sparkSession.sparkContext.broadcast(dims)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = 0
                for dim, (ids, u) in shared.value.items():  # noqa: B023
                    at, values = matrix(batch.column(1), dim)
                    if len(at) and len(ids):
                        n += int(((u @ unit(values).T >= threshold) & (ids[:, None] != batch.column(0).to_numpy()[at][None])).sum())
                yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

        true += rows.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
        shared.unpersist()
    found = got.agg(F.sum("n_links")).first()[0] or 0
    return found / true if true else 1.0
