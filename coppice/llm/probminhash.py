"""Near-duplicate documents by ProbMinHash over word shingles, banding and verification.

Sketch. A shingle of weight w is a Poisson process of rate w over m registers: its arrivals are exponential steps
drawn from its hash, each falls on a random register, and a register keeps its earliest arrival. Two texts agree in a
register with the probability Jaccard similarity of their weighted shingles, which for equal weights is the Jaccard
similarity of the sets. An element whose next arrival lies beyond the latest register of its text can no longer win
and ends early; all elements of a batch of texts advance together, so the work is numpy's. A shingle weighs as much as
its text has it. Where near-duplicates are told by the Jaccard similarity of the sets, as by default, counts alone could
hide one (a line repeated in one text of two), so a text that has a shingle more than once gets a second sketch of
equal weights beside the weighted one and is a candidate by either.

Candidates. Equal texts are collapsed to one node first, which has a number of its own: ids may repeat, and decide
nothing but which one names a class. Registers are banded; texts that share a band meet in a bucket. Buckets of equal members are compared once. Within a bucket each text is held against those that are not
joined with it yet, first by registers, then by the exact similarity of the shingles; a link joins two groups. So a
bucket of thousands of near copies gives a link for each text rather than all pairs. Large buckets are dealt over
blocks at random, anew in each band. Where links elsewhere have not joined the members of such a bucket, one member
for each group goes on to the next round; only groups that no such round joins are compared block by block.

Texts travel by id to the buckets they share with others, those of buckets of their own stay where they are.
Classes are the connected components of the verified links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import appended, discard, matching, own_names, words, written
from coppice.llm.graph import components

#: A band of four registers is 64 bits. Texts of similarity 0.8 share none of 20 bands with probability 3e-5.
BANDS, ROWS = 20, 4
#: Members and bytes of text of a block at most (but for a single longer text).
BLOCK, BLOCK_BYTES = 1024, 32 << 20
#: Texts of a digest for which its rows are not dealt by it: over one in HOT of all rows, so fewer than HOT digests.
HOT = 1000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        value = self[word] = xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def shingle_hashes(split: list[list[bytes]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of k words of every text; of a text of fewer words, but not none, all of it."""
    if len(_hashes) > 150_000:
        _hashes.clear()
    sizes = np.array([len(w) for w in split], np.int64)
    flat = np.fromiter((h for w in split for h in map(_hashes.__getitem__, w)), np.uint64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        n = np.where(sizes >= k, sizes - k + 1, 0)
        text = np.repeat(np.arange(len(split)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h = mix(h + _GOLD) ^ flat[at + j] if len(at) else h
        short_text, short = [], []
        for i in np.flatnonzero((sizes > 0) & (sizes < k)):
            x = np.array([int(sizes[i])], np.uint64)
            for v in flat[starts[i] : starts[i] + sizes[i]]:
                x = mix(x + _GOLD) ^ v
            short_text.append(i)
            short.append(int(x[0]))
        if short:
            text, h = np.concatenate([text, short_text]).astype(np.int64), np.concatenate([h, np.array(short, np.uint64)])
    return text, mix(h)


def weighted(text: np.ndarray, h: np.ndarray, by_count: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) and their weights: 1, or how often the text has them."""
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h))).astype(float) if by_count else np.ones(len(at))


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard similarity of sorted distinct hashes with weights: the sum over common elements i of
    1 / sum over all z of max(a_z / a_i, b_z / b_i)."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x = np.concatenate([wa[i], np.delete(wa, i), np.zeros(len(b) - len(j))])
    y = np.concatenate([wb[j], np.zeros(len(a) - len(i)), np.delete(wb, j)])
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    below = np.concatenate([[0.0], np.cumsum(y[order])])
    above = np.concatenate([[0.0], np.cumsum(x[order][::-1])])[::-1]
    own = ratio[: len(i)]
    k = np.searchsorted(ratio[order], own)
    return float((1 / (above[k] / wa[i] + below[k] / wb[j])).sum())


def sketch(text: np.ndarray, h: np.ndarray, w: np.ndarray, n: int, m: int) -> np.ndarray:
    """Hash of the winning element in each of m registers of each of n texts (0 where a text has none)."""
    best, won = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    t, step = np.zeros(len(h)), 0
    with np.errstate(over="ignore"):
        while len(h):
            step += 1
            r = mix(h + np.uint64(step) * _GOLD)
            t = t - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / w
            cell = text * m + (mix(r ^ _GOLD) % np.uint64(m)).astype(np.int64)
            np.minimum.at(best, cell, t)
            wins = t == best[cell]
            won[cell[wins]] = h[wins]
            live = t < best.reshape(n, m).max(1)[text]
            text, h, w, t = text[live], h[live], w[live], t[live]
    return won.reshape(n, m)


def _registers(won: np.ndarray, m: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(won + np.arange(m, dtype=np.uint64)) & np.uint64(0xFFFF)).astype("<u2")


def _sketcher(k: int, m: int):
    """Registers of equal weights, and of weights by count for texts that have a shingle more than once (else the same)."""

    def make():
        def run(texts: list[str | None]) -> list:
            split = [words(t) for t in texts]
            text, h, w = weighted(*shingle_hashes(split, k), True)
            even = _registers(sketch(text, h, np.ones(len(w)), len(texts), m), m)
            repeats = np.zeros(len(texts), bool)
            repeats[text[w > 1]] = True
            some = repeats[text]
            counted = _registers(sketch((np.cumsum(repeats) - 1)[text[some]], h[some], w[some], int(repeats.sum()), m), m)
            place = np.cumsum(repeats) - 1
            return [
                [r.tobytes() if w else None for r, w in zip(even, split, strict=True)],
                [counted[place[i]].tobytes() if repeats[i] else None for i in range(len(texts))],
            ]

        return run

    return make


def digest(text: Column) -> Column:
    """16 bytes that tell texts apart; null for null and empty ones."""
    return F.when(F.length(text) > 0, F.substring(F.unhex(F.sha2(text, 256)), 1, 16))


def bucket_links(
    registers: np.ndarray, sets: Callable[[int], tuple[np.ndarray, np.ndarray]], group: np.ndarray, low: float, threshold: float, by_count: bool = False
) -> list[tuple[int, int, float]]:
    """A spanning forest of the links of one bucket: members of one ``group`` count as joined already.

    Each member in turn is held against those not yet joined with it: by registers, then by the exact similarity of
    the shingles, nearest first. Every link between members that are not joined otherwise is found.
    """
    group, found = group.copy(), []
    for p in range(len(group)):
        if (group == group[0]).all():
            break
        apart = np.flatnonzero(group[p + 1 :] != group[p]) + p + 1
        est = (registers[apart] == registers[p]).mean(1)
        order = np.argsort(-est, kind="stable")
        for x in apart[order[: int((est >= low).sum())]]:
            if group[x] == group[p]:
                continue
            (one, w1), (two, w2) = sets(p), sets(int(x))
            if by_count:
                similarity = probability_jaccard(one, w1, two, w2)
            else:
                if min(len(one), len(two)) < threshold * max(len(one), len(two)):
                    continue
                both = len(np.intersect1d(one, two, assume_unique=True))
                similarity = both / (len(one) + len(two) - both) if both else 0.0
            if similarity >= threshold:
                found.append((p, int(x), similarity))
                group[group == group[x]] = group[p]
    return found


def _compare(rows: DataFrame, keys: list[str], k: int, low: float, threshold: float, by_count: bool) -> DataFrame:
    """(a, b, similarity) of the links of each group of rows (keys, id, registers, text, group) that join its members."""
    id_type = rows.schema["id"].dataType

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ks = [batch.column(c).to_numpy() for c in keys]
            change = np.zeros(batch.num_rows, bool)
            for x in ks:
                change[1:] |= x[1:] != x[:-1]
            cuts = [0, *np.flatnonzero(change), batch.num_rows]
            if held and any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != batch.column(c)[0].as_py() for c in keys):
                yield pa.Table.from_batches(held)
                held = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and lo:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches):
            if g.num_rows < 2:
                continue
            registers = np.stack([np.frombuffer(x, "<u2") for x in g.column("registers").to_pylist()])
            ids, texts = g.column("id").combine_chunks(), g.column("text")
            made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

            def sets(i: int) -> tuple[np.ndarray, np.ndarray]:
                if i not in made:
                    made[i] = weighted(*shingle_hashes([words(texts[i].as_py())], k), by_count)[1:]  # noqa: B023
                return made[i]  # noqa: B023

            _, group = np.unique(np.array(g.column("group").to_pylist(), object).astype(str), return_inverse=True)
            found = bucket_links(registers, sets, group, low, threshold, by_count)
            if found:
                a, b, similarity = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(similarity, pa.float64())], names=["a", "b", "similarity"])

    dealt = rows.select(*keys, "id", "registers", "text", "group").repartition(*keys).sortWithinPartitions(*keys, "id")
    name = id_type.simpleString()
    return dealt.mapInArrow(run, f"a {name}, b {name}, similarity double")


def links(
    docs: DataFrame, k: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, by_count: bool = False, block: int = BLOCK
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b, similarity) that join all similar texts, the rows (doc, digest), and the distinct texts (digest, id, doc, n).

    ``docs`` has doc_id and text; a and b are ids of texts, numbers that mean nothing else; doc is a doc_id, of a text the
    smallest one that has it, and n the number of its rows. A text that is null or empty has no digest; one without words
    links with its exact copies only, which share its digest; rows without a doc_id are left out. Candidates are texts
    that share a band of either sketch, all but 3e-5 of those of similarity 0.8. Between texts of a bucket that no other
    link joins no link is left out but where the register test passes over one, as it does over texts estimated six
    standard deviations below the threshold: for a similarity at the threshold with a probability of 1e-9 or so.
    """
    if rows > 4:
        raise ValueError("a band holds at most four registers of 16 bits")
    m = bands * rows
    low = threshold - 6 * (threshold * (1 - threshold) / m) ** 0.5
    source = docs.select(F.col("doc_id").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null")
    known = source.select("doc", "text", digest(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    made = appended(known, ["text"], "registers binary, counted binary", _sketcher(k, m), rows=2000, without=["text"])
    sketched = written(made, "sketches", arrow_rows=2000)
    texts = sketched.where("digest is not null").groupBy("digest").agg(
        F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("registers", "counted", "size")))
    texts = written(texts.withColumn("id", F.monotonically_increasing_id()), "texts")  # the numbers are those of the table

    band = lambda of, b: F.xxhash64(F.lit(b), F.substring(of, 2 * rows * b + 1, 2 * rows))
    of_sets = F.array(*(band(F.col("registers"), b) for b in range(bands)))
    of_counts = F.array(*(band(F.col("counted"), b) for b in range(bands)))
    own = of_sets if not by_count else F.when(F.col("counted").isNull(), of_sets).otherwise(of_counts)
    both = F.when(F.col("counted").isNull(), of_sets).otherwise(F.array_distinct(F.concat(of_counts, of_sets)))
    spots = texts.where("registers is not null").select("id", "size", F.explode(own if by_count else both).alias("bucket"))
    buckets = spots.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum("size").alias("size")).where("n > 1")
    distinct = buckets.groupBy("n", "x", "size").agg(F.min("bucket").alias("bucket"))
    sized = distinct.select("bucket", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    met = written(spots.select("id", "bucket").join(sized.hint("merge"), "bucket"), "buckets")
    ids = written(texts.join(met.select("id").distinct().hint("merge"), "id", "left_semi").select("doc", "digest"), "sharing")
    docs_of = written(ids.select("doc").distinct(), "sharing-docs")
    sharing = matching(source, docs_of, "doc").withColumn("digest", digest(F.col("text")))
    if matching(sketched.select("doc", "digest"), docs_of, "doc").join(ids.hint("merge"), ["doc", "digest"], "left_semi").count() > ids.count():
        sharing = sharing.groupBy("doc", "digest").agg(F.first("text").alias("text"))  # rows that repeat both: one is enough
    compared_by = F.coalesce("counted", "registers") if by_count else F.col("registers")
    registers = texts.select("id", "doc", "digest", compared_by.alias("registers"), "size")

    def whole(rows: DataFrame) -> DataFrame:
        return rows.join(registers.drop("size").hint("merge"), "id").join(sharing.hint("merge"), ["doc", "digest"])

    def compared(rows: DataFrame, keys: list[str]) -> DataFrame:
        return written(_compare(whole(rows), keys, k, low, threshold, by_count), "links", arrow_rows=256)

    def dealt(rows: DataFrame, turn: int) -> DataFrame:
        return rows.withColumn("block", F.pmod(F.xxhash64("id", "bucket", F.lit(turn)), F.col("blocks")).cast("int"))

    found = compared(dealt(met, 0).withColumn("group", F.col("id")), ["bucket", "block"])
    large = met.where("blocks > 1")
    turn, settled = 0, large.isEmpty()
    while not settled:
        # Of a large bucket one member of each group goes on, dealt anew, until all are joined or a round joins none.
        turn += 1
        joined = components(found).withColumnRenamed("component", "group")
        grouped = written(large.join(joined.hint("merge"), "id", "left").withColumn("group", F.coalesce("group", "id")), "grouped")
        open_ = grouped.groupBy("bucket").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("bucket")
        grouped = written(grouped.join(open_, "bucket"), "open")
        if grouped.isEmpty():
            return found, sketched.select("doc", "digest"), texts.select("digest", "id", "doc", "n")
        one = grouped.groupBy("bucket", "group").agg(F.min("id").alias("id")).join(registers.select("id", "size"), "id")
        parts = one.groupBy("bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
        more = compared(dealt(one.drop("size").join(parts, "bucket"), turn), ["bucket", "block"])
        settled = more.isEmpty()
        found = found.unionByName(more)
    if turn:  # what is still apart meets block by block, each pair of blocks once
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        pairs = dealt(grouped, 0).withColumn("other", other).where("other <> block").select(
            "id", "group", "bucket", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
        found = found.unionByName(compared(pairs, ["bucket", "one", "two"]))
    discard(met, ids, docs_of)
    return found, sketched.select("doc", "digest"), texts.select("digest", "id", "doc", "n")


def _classes(docs: DataFrame, k: int, threshold: float, by_count: bool) -> tuple[DataFrame, DataFrame]:
    """The rows (doc, digest) of docs and the texts (digest, doc, n, class_id, first): class_id is the smallest doc of the
    text's class, and first whether the text is the one of the smallest doc, then digest, of its class."""
    found, rows, texts = links(docs, k, threshold, by_count=by_count)
    joined = components(found)
    linked = written(texts.join(joined.hint("merge"), "id").select("digest", "doc", "n", "component"), "linked")
    heads = linked.groupBy("component").agg(F.min(F.struct("doc", "digest")).alias("head"))
    named = linked.join(heads.hint("merge"), "component").select("digest", "doc", "n", F.col("head.doc").alias("class_id"), (F.col("head.digest") == F.col("digest")).alias("first"))
    alone = texts.join(joined.select("id").hint("merge"), "id", "left_anti").select("digest", "doc", "n", F.col("doc").alias("class_id"), F.lit(True).alias("first"))
    return rows, written(named.unionByName(alone), "text-classes")


def classes(docs: DataFrame, k: int = 5, threshold: float = 0.8, by_count: bool = False) -> DataFrame:
    """doc_id, class_id (smallest doc_id reachable by links), kept (doc_id = class_id); a row for each row of docs.

    Rows without an id have no class and are kept, null and empty texts are alone in their class; of rows that repeat an
    id each has the class of its own text; texts are compared whole, whatever their length; no rows give none. Other columns
    are ignored. A text that very many rows share does not go through one task: its class is broadcast. ``by_count`` tells
    classes by the probability Jaccard of shingles weighted by their counts instead of the Jaccard of the sets.
    """
    rows, of_text = _classes(docs, k, threshold, by_count)
    total = of_text.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(of_text.where(F.col("n") > total / HOT).select("digest", F.col("class_id").alias("hot_class")))  # fewer than HOT rows
    marked = rows.join(hot, "digest", "left")
    done = marked.where("digest is null or hot_class is not null").select(F.col("doc").alias("doc_id"), F.coalesce("hot_class", "doc").alias("class_id"))
    rest = marked.where("digest is not null and hot_class is null").select("doc", "digest").join(of_text.select("digest", "class_id").hint("merge"), "digest")
    bare = docs.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"))
    named = done.unionByName(rest.select(F.col("doc").alias("doc_id"), "class_id")).unionByName(bare)
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def deduplicated(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs of which one stays for each class: that of the smallest id, then of the smallest digest of the text.

    Rows are told apart by id and text, so an id that repeats decides over none but its own text: a text that is like no
    other stays, whoever shares its id. Of rows that repeat both, that of the smallest hash of their other columns stays.
    Rows without an id, and null and empty texts, are no one's copies and all stay. All columns of docs are kept as they
    are; no rows give none.
    """
    rows, of_text = _classes(docs, k, threshold, False)
    firsts = of_text.where("first").select("digest", F.col("doc").alias("first_doc"))
    of_row = rows.where("digest is not null").groupBy("doc", "digest").agg(F.count(F.lit(1)).alias("n"))
    told = of_row.join(firsts.hint("merge"), "digest", "left").withColumn("stays", F.coalesce(F.col("first_doc") == F.col("doc"), F.lit(False)))
    told = written(told.where("not stays or n > 1").select(F.col("doc").alias("_doc"), F.col("digest").alias("_digest"), "stays"), "copies")
    rows = docs.toDF(*own_names(docs)).withColumns({"_doc": F.col("doc_id"), "_digest": digest(F.col("text").cast("string"))})
    back = lambda df: df.select(*own_names(docs)).toDF(*docs.columns)
    kept = matching(rows, told.where("not stays").select("_doc", "_digest"), ["_doc", "_digest"], "left_anti")
    repeated = told.where("stays").select("_doc", "_digest")
    if repeated.isEmpty():
        return back(kept)
    plain = [n for n, f in zip(own_names(docs), docs.schema.fields, strict=True) if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    first = F.min_by(F.struct(*own_names(docs)), F.xxhash64(*plain)).alias("row")
    once = matching(kept, repeated, ["_doc", "_digest"]).groupBy("_doc", "_digest").agg(first).select("row.*")
    return back(matching(kept, repeated, ["_doc", "_digest"], "left_anti")).unionByName(back(once))
