"""Perplexity by a class-based bigram model with Brown classes from exchange clustering.

Counting. Documents are packed into chunks of some megabytes: a row with the chunk's distinct words (most frequent
first), their training counts, and each token as a number into them. So words cross the network once a chunk rather
than once a token.

Classes. The units that exchange clustering moves are the ``moved`` most frequent words and, for all other words,
their endings. A seed puts the most frequent few hundred words and the endings into classes on the driver, moving one
at a time to the class that raises the likelihood of the class bigrams most. Then all units exchange classes in
rounds: a pass over the chunks sums each unit's counts with the class before and after it, by task; the sums, whose
size is units times classes, come to the driver, and each unit moves to the class that its own neighbours make
likeliest. Rounds go on while the likelihood rises. Last, every other training word, however many there are, takes
the class of highest likelihood between its own neighbours' classes, leaning on its ending's; class bigrams are
counted anew. Words that training has not have the class of their ending.

The ``hot`` most frequent words (by their counts in the chunks where they are among the first) are few and broadcast,
so only rare words are dealt by word: each row brings a chunk's occurrences there and takes the word's count and class
back. All counts are exact and of all training texts.

Scoring. log10 P(text) = sum of log10 P(class | class before) P(word | class): class transitions are interpolated
with class frequencies, emissions have half a count for a word not seen in the class.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from coppice.llm.common import Spool, discard, remainder, written

#: Stands for the end of a text; no word holds a space.
END = b" "
_CLASSES = 64
_SPOT = 1 << 32  # a class and a position in one number


@dataclass(frozen=True)
class Settings:
    seed_words: int = 600
    moved: int = 1 << 12
    hot: int = 1 << 14
    name_bytes: int = 64  # longer words go by a name that long at most
    endings: int = 200
    classes: int = 64
    rounds: int = 3
    chunk_bytes: int = 8 << 20
    chunk_docs: int = 20_000
    prior: float = 20.0
    ending_tokens: float = 2.0

    def __post_init__(self):
        if self.classes > _CLASSES:
            raise ValueError(f"at most {_CLASSES} classes")


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space (exactly what bytes.split() splits at)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def name(word: bytes, most: int) -> bytes:
    """The word, or for a longer one than ``most`` bytes a digest with its last three bytes, which no UTF-8 text holds: so words
    of any length can be counted, broadcast and told apart alike, and none is too long to be hot."""
    return word if len(word) <= most else b"\xff" + hashlib.blake2b(word, digest_size=16).digest() + word[-3:]


def pack_numbers(x: np.ndarray) -> bytes:
    """Whole numbers, byte planes one after another and deflated: most are small, so the high planes nearly vanish."""
    return zlib.compress(np.ascontiguousarray(x.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, : 8 if x.max(initial=0) >> 32 else 4].T.tobytes() + bytes([8 if x.max(initial=0) >> 32 else 4]), 1)


def unpack_numbers(raw: bytes) -> np.ndarray:
    data = zlib.decompress(raw)
    n = data[-1]
    planes = np.frombuffer(data, np.uint8, len(data) - 1).reshape(n, -1)
    return np.ascontiguousarray(planes.T).view(f"<i{n}").ravel()


def ending(word: bytes, endings: int) -> int:
    return zlib.crc32(word[-3:]) % endings


def chunks(docs: DataFrame, held_out_column: str, settings: Settings) -> DataFrame:
    """doc_id, text, held out -> one row a chunk: chunk, ids, held_out, sizes, tokens, words, counts. Word 0 is the end."""
    id_field = docs.schema["doc_id"]
    schema = StructType([StructField("chunk", LongType()), StructField("ids", ArrayType(id_field.dataType)), *StructType.fromDDL("held_out array<boolean>, sizes array<int>, tokens binary, words array<binary>, counts array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        most = settings.name_bytes
        fresh = lambda: ({END: 0}, [], [], [])
        number, held, sizes, coded = fresh()
        size = 0

        def row() -> pa.RecordBatch:
            flat, n = np.concatenate(coded), len(number)
            train = ~np.repeat(np.array(held, bool), sizes)
            order = np.concatenate([[0], 1 + np.argsort(-np.bincount(flat, minlength=n)[1:], kind="stable")])
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            flat, listed = rank[flat], list(number)
            arrays = [
                pa.array([base + made]), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays(ids_arrays)),
                pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32())), pa.array([pack_numbers(flat)], pa.binary()),
                pa.array([[listed[i] for i in order]], pa.list_(pa.binary())), pa.array([np.bincount(flat[train], minlength=n)], pa.list_(pa.int32())),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        ids_arrays: list[pa.Array] = []
        for batch in batches:
            column, flags = batch.column(0), batch.column(2).to_pylist()
            start = 0
            for i, text in enumerate(batch.column(1)):
                words = tokens(text.as_py())
                mine = np.empty(len(words) + 1, np.int32)
                get = number.setdefault
                mine[:-1] = [get(w if len(w) <= most else name(w, most), len(number)) for w in words]
                mine[-1] = 0
                coded.append(mine)
                held.append(flags[i])
                sizes.append(len(mine))
                size += sum(map(len, words)) + len(words)
                if size >= settings.chunk_bytes or len(held) >= settings.chunk_docs:
                    ids_arrays.append(column.slice(start, i + 1 - start))
                    yield row()
                    number, held, sizes, coded = fresh()
                    ids_arrays, start, size, made = [], i + 1, 0, made + 1
            if start < batch.num_rows:
                ids_arrays.append(column.slice(start))
        if held:
            yield row()

    return docs.select("doc_id", F.col("text").cast("string"), F.col(held_out_column)).mapInArrow(run, schema)


def exchange(bigrams: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """Class of each symbol. Symbol 0, the end of a text, keeps class 0 for itself."""
    n = len(bigrams)
    if n <= 1:
        return np.zeros(n, np.int64)
    weight = bigrams.sum(1)
    order = 1 + np.argsort(-weight[1:], kind="stable")
    classes = min(classes, n)
    own = np.zeros(n, np.int64)
    own[order] = 1 + np.arange(n - 1) % max(1, classes - 1)
    member = np.zeros((n, classes))
    member[np.arange(n), own] = 1
    right, left = bigrams @ member, bigrams.T @ member  # of each symbol, counts with each class after and before it
    g = member.T @ right
    total_l, total_r = g.sum(1), g.sum(0)
    w_l, w_r = bigrams.sum(1), bigrams.sum(0)

    def h(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    for _ in range(rounds):
        moved = 0
        for w in order:
            a, r, c, self_ = own[w], right[w].copy(), left[w].copy(), bigrams[w, w]
            r[a] -= self_
            c[a] -= self_
            g[a] -= r
            g[:, a] -= c
            g[a, a] -= self_
            total_l[a] -= w_l[w]
            total_r[a] -= w_r[w]
            gain_r = h(g + r[None]) - h(g)
            gain_c = h(g + c[:, None]) - h(g)
            d = np.diagonal(g)
            gain = gain_r.sum(1) - np.diagonal(gain_r) + gain_c.sum(0) - np.diagonal(gain_c)
            gain += h(d + r + c + self_) - h(d)
            gain -= h(total_l + w_l[w]) - h(total_l) + h(total_r + w_r[w]) - h(total_r)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            g[b] += r
            g[:, b] += c
            g[b, b] += self_
            total_l[b] += w_l[w]
            total_r[b] += w_r[w]
            if b != a:
                own[w] = b
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
                moved += 1
        if not moved:
            break
    return own


@dataclass(frozen=True)
class Units:
    """The end (0), hot words (1, 2, ...), then the endings of all other words."""

    number: dict[bytes, int]
    endings: int

    def __len__(self) -> int:
        return len(self.number) + self.endings

    def of(self, words: list[bytes]) -> np.ndarray:
        get, hot = self.number.get, len(self.number)
        return np.array([u if (u := get(w)) is not None else hot + ending(w, self.endings) for w in words], np.int64)

    def first(self, n: int) -> np.ndarray:
        """For each unit its number where only the end and the n - 1 most frequent words are units of their own."""
        words = list(self.number)
        n = min(n, len(words))
        return np.concatenate([np.arange(n), n + np.array([ending(w, self.endings) for w in words[n:]], np.int64), n + np.arange(self.endings)])


def _before(now: np.ndarray, sizes: np.ndarray, first: int) -> np.ndarray:
    before = np.concatenate([[first], now[:-1]])
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = first
    return before


def _training(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of chunk i of a batch, sizes of its texts, and which tokens train."""
    sizes = np.array(batch.column("sizes")[i].as_py(), np.int64)
    return unpack_numbers(batch.column("tokens")[i].as_py()), sizes, ~np.repeat(np.array(batch.column("held_out")[i].as_py(), bool), sizes)


_CODED = ["chunk", "ids", "held_out", "sizes", "tokens", "u"]


def _coded(packed: DataFrame, units: Units) -> DataFrame:
    """The chunks with the unit of each of their words instead of the words."""
    shared = packed.sparkSession.sparkContext.broadcast(units)  # bounded by the settings
    schema = StructType([*(packed.schema[c] for c in _CODED[:-1]), *StructType.fromDDL("u binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = pa.array([pack_numbers(shared.value.of(w.as_py())) for w in batch.column("words")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _CODED[:-1]), u], names=_CODED)

    return packed.select(*_CODED[:-1], "words").mapInArrow(run, schema)


def _bigrams(coded: DataFrame, kinds: np.ndarray) -> np.ndarray:
    """Bigrams of kinds of units (one number each) in training texts; what comes before a text is kind 0."""
    s = int(kinds.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s * s, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at, sizes, train = _training(batch, i)
                now = kinds[unpack_numbers(batch.column("u")[i].as_py())][at]
                total += np.bincount(_before(now, sizes, 0)[train] * s + now[train], minlength=s * s)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    got = coded.select(*_CODED[2:]).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # s * s rows at most
    out = np.zeros(s * s)
    out[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(s, s)


def _around(coded: DataFrame, kinds: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """(kinds, 2 k): how often each class comes before, and after, each kind of unit in training texts.

    ``kinds``: of each unit; ``own``: the class of each kind. Class 0 is around texts.
    """
    width, shared = 2 * k, coded.sparkSession.sparkContext.broadcast((kinds, own))  # bounded by the settings

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, own = shared.value
        total = np.zeros(len(own) * width, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at, sizes, train = _training(batch, i)
                u = kinds[unpack_numbers(batch.column("u")[i].as_py())][at]
                now = own[u]
                base = u[train] * width
                total += np.bincount(base + _before(now, sizes, 0)[train], minlength=len(total))
                total += np.bincount(base + k + np.append(now[1:], 0)[train], minlength=len(total))
        keys = np.flatnonzero(total)
        which, start = np.unique(keys // width, return_index=True)
        lists = [pa.ListArray.from_arrays(pa.array(np.append(start, len(keys)), pa.int32()), pa.array(x)) for x in ((keys % width).astype(np.uint8).view(np.int8), total[keys])]
        yield pa.RecordBatch.from_arrays([pa.array(which), *lists], names=["u", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for u, at, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                total.setdefault(u, np.zeros(width, np.int64))[at.values.to_numpy().view(np.uint8)] += n.values.to_numpy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["u", "n"])

    rows = coded.select(*_CODED[2:]).mapInArrow(count, "u long, at array<byte>, n array<long>").repartition("u")
    out = np.zeros((len(own), width))
    for r in rows.mapInArrow(add, "u long, n binary").toArrow().to_batches():  # a row a kind
        for u, n in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True):
            out[u] = np.frombuffer(n, np.int64)
    shared.unpersist()
    return out


def _probabilities(g: np.ndarray, n: np.ndarray, v: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Class transitions, and the denominators of emissions, from class bigrams, tokens and distinct words."""
    share = (n + 0.5) / (n.sum() + 0.5 * len(n))
    return (g + prior * share[None]) / (g.sum(1, keepdims=True) + prior), n + 0.5 * (v + 1)


def likelihood(g: np.ndarray) -> float:
    """What classes add to the log likelihood of a text: that of the class bigrams g over that of words alone."""
    h = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return h(g) - h(g.sum(0)) - h(g.sum(1))


@dataclass(frozen=True)
class Classes:
    own: np.ndarray  # class of each unit
    counts: np.ndarray  # training tokens of each unit
    pull: np.ndarray  # (2 classes, classes): what a neighbour before, or after, adds to the log likelihood of each class
    typical: np.ndarray  # of each ending, the mean of that over its tokens


#: For class choices a rare word is taken to occur so often; scores use the exact number of words.
_RARE_TOKENS = 4.0


def _fits(m: np.ndarray, own: np.ndarray, words: int, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Likelihood of the classes of kinds with counts m around them, of which the first are words, then pull and fits."""
    k = m.shape[1] // 2
    member = np.zeros((len(own), k))
    member[np.arange(len(own)), own] = 1
    g = (member.T @ m[:, :k]).T  # class before, class
    tokens_ = m[:, :k].sum(1)
    distinct = np.concatenate([tokens_[:words] > 0, tokens_[words:] / _RARE_TOKENS])
    transition, emission = _probabilities(g, g.sum(0), distinct @ member, prior)
    pull = np.concatenate([np.log(transition) - np.log(emission)[None], np.log(transition).T])
    pull[:, 0] = -1e9  # class 0 is the end's alone
    return likelihood(g), pull, m @ pull


def cluster(coded: DataFrame, units: Units, settings: Settings) -> Classes:
    few, kinds = units.first(settings.seed_words + 1), units.first(settings.moved + 1)
    words = int(kinds.max()) + 1 - settings.endings
    seed = exchange(_bigrams(coded, few), settings.classes)
    own = np.zeros(words + settings.endings, np.int64)
    own[kinds] = seed[few]
    k, best = int(seed.max()) + 1, None
    for _ in range(settings.rounds + 1):
        m = _around(coded, kinds, own, k)
        gain, pull, fits = _fits(m, own, words, settings.prior)
        if best is not None and gain <= best[0] + 1e-4 * abs(best[0]):
            break
        best = gain, own
        seen = m[:, :k].sum(1) > 0
        seen[0] = False
        own = np.where(seen, fits.argmax(1), own)
    own = best[1][kinds]
    m = _around(coded, np.arange(len(units)), own, k)  # all hot words by themselves
    hot = len(units.number)
    _, pull, fits = _fits(m, own, hot, settings.prior)
    counts = m[:, :k].sum(1)
    typical = fits[hot:] / np.maximum(1, counts[hot:])[:, None]
    new = np.flatnonzero((counts[:hot] > 0) & (np.arange(hot) >= words))
    ends = np.array([ending(w, settings.endings) for w in units.number], np.int64)
    own[new] = (fits[new] + settings.ending_tokens * typical[ends[new]]).argmax(1)
    return Classes(own, counts.astype(np.int64), pull, typical)


def _rare(packed: DataFrame, units: Units, found: Classes, lean: float) -> DataFrame:
    """chunk, x, c of every word of a chunk that is not hot: its class and place in the chunk, and its training count.
    The first row of a word that training has holds cls, its class, as well; else that is -1."""
    k = found.pull.shape[1]
    width, hot = 2 * k, len(units.number)
    shared = packed.sparkSession.sparkContext.broadcast((units, found))  # bounded by the settings

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, found = shared.value
        for batch in batches:
            for i, chunk in enumerate(batch.column("chunk").to_pylist()):
                words = batch.column("words")[i].values
                of = units.of(words.to_pylist())
                at, sizes, train = _training(batch, i)
                now, rare = found.own[of][at], np.flatnonzero(of >= hot)
                mine = np.flatnonzero(train & (of >= hot)[at])
                mine = mine[np.argsort(at[mine], kind="stable")]
                pairs = np.stack([_before(now, sizes, 0)[mine], k + np.append(now[1:], 0)[mine]], 1).astype(np.uint8).tobytes()
                start = 2 * np.append(np.searchsorted(at[mine], rare), len(mine))
                x = pa.Array.from_buffers(pa.binary(), len(rare), [None, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(pairs)])
                columns = [words.take(pa.array(rare)), pa.array(np.full(len(rare), chunk)), pa.array(rare, pa.int32()), x]
                whole = pa.RecordBatch.from_arrays(columns, names=["word", "chunk", "pos", "x"])
                for lo in range(0, len(rare), 10_000):
                    yield whole.slice(lo, 10_000)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, found = shared.value
        spool, last, total = Spool(), None, np.zeros(width, np.int64)

        def decided(batch: pa.RecordBatch, which: np.ndarray, sums: np.ndarray, new: bool) -> pa.RecordBatch:
            """Rows with the number of each row's word and those words' counts by neighbouring class."""
            first = np.diff(which, prepend=-1).astype(bool)
            ends = np.array([ending(w, units.endings) for w in batch.column("word").filter(pa.array(first)).to_pylist()], np.int64)
            c = sums[:, :k].sum(1)
            cls = np.where(c > 0, (sums @ found.pull + lean * found.typical[ends]).argmax(1), found.own[hot + ends])
            first[0] &= new
            x = cls[which] * _SPOT + batch.column("pos").to_numpy()
            told = np.where(first & (c > 0)[which], cls[which], -1)
            return pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(x), pa.array(c[which]), pa.array(told, pa.int32())], names=["chunk", "x", "c", "cls"])

        def ended() -> Iterator[pa.RecordBatch]:  # the rows of one word, however many
            for i, b in enumerate(spool):
                yield decided(b, np.zeros(b.num_rows, np.int64), total[None], i == 0)

        for whole in batches:
            for lo in range(0, whole.num_rows, 5000):
                batch = whole.slice(lo, 5000)
                words = batch.column("word").to_pylist()
                which = np.cumsum([i > 0 and words[i] != words[i - 1] for i in range(len(words))])
                x = batch.column("x")
                size = pa.compute.binary_length(x).to_numpy()
                flat = np.frombuffer(b"".join(x.to_pylist()), np.uint8)
                sums = np.bincount(np.repeat(which, size) * width + flat, minlength=(int(which[-1]) + 1) * width).reshape(-1, width)
                if last is not None and words[0] != last:
                    yield from ended()
                    spool, total = Spool(), np.zeros(width, np.int64)
                total = total + sums[0]
                if not which[-1]:  # one word: maybe more of it comes
                    spool.append(batch)
                else:
                    second, final = np.searchsorted(which, [1, int(which[-1])])
                    spool.append(batch.slice(0, second))
                    yield from ended()
                    if final > second:
                        yield decided(batch.slice(second, final - second), which[second:final] - 1, sums[1:-1], True)
                    spool, total = Spool(), sums[-1]
                    spool.append(batch.slice(final))
                last = words[-1]
        if last is not None:
            yield from ended()

    rows = packed.select("chunk", "held_out", "sizes", "tokens", "words").mapInArrow(deal, "word binary, chunk long, pos int, x binary")
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(choose, "chunk long, x long, c long, cls int")


@dataclass(frozen=True)
class Model:
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # of each class, the denominator of P(word | class)
    n: int
    v: int


_CLASSED = ["ids", "held_out", "sizes", "tokens", "c", "cls"]


def _classed(coded: DataFrame, rare: DataFrame, units: Units, found: Classes) -> DataFrame:
    """The chunks with the training count and the class of each of their words."""
    shared, hot = coded.sparkSession.sparkContext.broadcast(found), len(units.number)
    back = rare.groupBy("chunk").agg(F.collect_list(F.struct("x", "c")).alias("rare"))  # as many as a chunk has words
    rows = coded.join(back.hint("merge"), "chunk", "left").drop("chunk")
    schema = StructType([*(coded.schema[c] for c in _CLASSED[:4]), *StructType.fromDDL("c binary, cls binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                u = unpack_numbers(row.column("u")[0].as_py())
                c, cls = np.where(u < hot, found.counts[u], 0), found.own[u]
                if row.column("rare")[0].is_valid:
                    pairs = row.column("rare")[0].values
                    x = pairs.field("x").to_numpy()
                    c[x % _SPOT], cls[x % _SPOT] = pairs.field("c").to_numpy(), x // _SPOT
                arrays = [pa.array([pack_numbers(c)], pa.binary()), pa.array([pack_numbers(cls)], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(row.column(k) for k in _CLASSED[:4]), *arrays], names=_CLASSED)

    return rows.mapInArrow(run, schema)


def _decoded(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, sizes of the texts, counts and classes of the words of chunk i of a batch."""
    c, cls, at = (unpack_numbers(batch.column(k)[i].as_py()) for k in ("c", "cls", "tokens"))
    return at, np.array(batch.column("sizes")[i].as_py(), np.int64), c, cls


def _class_bigrams(rows: DataFrame, k: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at, sizes, _, cls = _decoded(batch, i)
                now, train = cls[at], ~np.repeat(np.array(batch.column("held_out")[i].as_py(), bool), sizes)
                total += np.bincount(_before(now, sizes, 0)[train] * k + now[train], minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total)], names=["k", "n"])

    out = np.zeros(k * k)
    for r in rows.select(*_CLASSED[1:]).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return out.reshape(k, k)


def _score(model: Model, batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
    at, sizes, counts, cls = _decoded(batch, i)
    base = np.log10((counts + 0.5) / (model.n + 0.5 * (model.v + 1)))
    emitted = np.log10((counts + 0.5) / model.emission[cls])
    now = cls[at]
    start = np.cumsum(sizes) - sizes
    score = emitted[at] + model.transition[_before(now, sizes, 0), now]
    known = (counts > 0)[at]
    columns = [
        batch.column("ids")[i].values, batch.column("held_out")[i].values, pa.array(sizes), pa.array(np.add.reduceat(known.astype(np.int64), start)),
        pa.array(np.full(len(sizes), model.n, np.int64)), pa.array(np.add.reduceat(base[at], start)), pa.array(np.add.reduceat(score, start)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame, fold: int = 5, held: int = 1, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of doc_id, text.

    Learns from the rows whose crc32(doc_id as text) mod ``fold`` is not ``held`` (null ids: remainder 0). Null and
    empty texts are the end token alone; repeated rows count and are scored each; without training rows all counts
    are 0; no rows give none; words of equal count are hot by their bytes. Texts and words are read whole, whatever their
    length: a long word goes by a short name of its own (see ``name``). Other columns are ignored. Perplexity is
    10 ** (-score / n_tokens).
    """
    flagged = docs.select("doc_id", "text", (remainder("doc_id", fold) == held).alias("_held"))
    packed = written(chunks(flagged, "_held", settings), "chunks", arrow_rows=1000)
    first = packed.select(F.explode(F.slice(F.arrays_zip("words", "counts"), 2, settings.hot)).alias("w")).select(F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    top = first.where("n > 0").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(settings.hot).select("word").toArrow()
    units = Units({END: 0} | {w: i + 1 for i, w in enumerate(top.column(0).to_pylist())}, settings.endings)
    coded = written(_coded(packed, units), "coded", arrow_rows=4)
    found = cluster(coded, units, settings)
    rare = written(_rare(packed, units, found, settings.ending_tokens), "rare-words")
    discard(packed)
    rows = written(_classed(coded, rare, units, found), "classed", arrow_rows=4)
    k, hot = found.pull.shape[1], len(units.number)
    n, v = (np.bincount(found.own[:hot], weights=x, minlength=k) for x in (found.counts[:hot], found.counts[:hot] > 0))
    for r in rare.where("cls >= 0").groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # one row a class
        n[r["cls"]] += r["n"]
        v[r["cls"]] += r["v"]
    discard(coded, rare)
    transition, emission = _probabilities(_class_bigrams(rows, k), n, v, settings.prior)
    model = docs.sparkSession.sparkContext.broadcast(Model(np.log10(transition), emission, int(n.sum()), int(v.sum())))  # bounded by the settings
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _score(model.value, batch, i)

    return rows.mapInArrow(run, schema)
