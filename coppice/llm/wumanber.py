"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items: every run of ``window`` consecutive words, or the whole item
where it has fewer. All patterns of one length m share a search. Its block is two words (one for m = 1): a shift
table says how far a position may move when it ends in a given block, so text whose words do not occur in the
benchmark is passed over m - 1 words at a time. Where the shift is 0, the bucket of that suffix block names the
candidate windows, the first word filters them and a direct comparison of all words confirms them.

Documents are only mapped over: nothing is shuffled, whatever the skew. The benchmark is the query set. Its windows,
counted first, are broadcast where they are at most ``block_windows``. More of them are dealt to files of about that
many in the shared folder; a task then keeps its documents on its own disk, goes over them once for each file, of
which it holds one at a time, and so builds each file's tables once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coppice.llm.common import Spool, appended, shared_path, words
from coppice.llm.files import filesystem


class WuManber:
    """Search for word windows of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], m: int):
        self.m, self.b = m, min(2, m)
        self.shift: dict = {}
        self.buckets: dict = {}
        far = m - self.b + 1
        for window, items in patterns.items():
            for end in range(self.b, m + 1):
                block = window[end - self.b : end] if self.b > 1 else window[end - 1]
                self.shift[block] = min(self.shift.get(block, far), m - end)
            block = window[-2:] if self.b > 1 else window[-1]
            self.buckets.setdefault(block, {}).setdefault(window[0], []).append((window, items))
        self.far = far

    def find(self, text: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """Start and items of every occurrence."""
        m, n, shift, far, pos = self.m, len(text), self.shift.get, self.far, self.m - 1
        two = self.b > 1
        while pos < n:
            block = (text[pos - 1], text[pos]) if two else text[pos]
            step = shift(block, far)
            if step:
                pos += step
                continue
            start = pos - m + 1
            for window, items in self.buckets[block].get(text[start], ()):
                if tuple(text[start : pos + 1]) == window:
                    yield start, items
            pos += 1


def windows_of(text: str | None, window: int) -> list[tuple[bytes, ...]]:
    w = words(text)
    return [tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))] if w else []


def _block(rows: Iterable) -> dict[tuple[bytes, ...], list[str]]:
    """Windows of (item, windows) rows, with their items."""
    block: dict[tuple[bytes, ...], list[str]] = {}
    for item_id, windows in rows:
        for w in windows:
            items = block.setdefault(w, [])
            if item_id not in items[-1:] and item_id not in items:
                items.append(item_id)
    return block


def _searches(block: dict[tuple[bytes, ...], list[str]]) -> list[WuManber]:
    by_length: dict[int, dict] = {}
    for w, items in block.items():
        by_length.setdefault(len(w), {})[w] = items
    return [WuManber(p, m) for m, p in sorted(by_length.items())]


class _Hits:
    """Marked words and items of a number of documents."""

    def __init__(self):
        self.marks: dict[int, bytearray] = {}
        self.items: dict[int, set[str]] = {}

    def search(self, searches: list[WuManber], number: int, text: list[bytes]) -> None:
        for s in searches:
            for start, names in s.find(text):
                mark = self.marks.setdefault(number, bytearray(len(text)))
                mark[start : start + s.m] = b"\1" * s.m
                self.items.setdefault(number, set()).update(names)

    def columns(self, first: int, sizes: list[int]) -> list[list]:
        at = range(first, first + len(sizes))
        return [sizes, [sum(self.marks.get(i, b"")) for i in at], [sorted(self.items.get(i, ())) for i in at]]


FIELDS = "n_words long, n_hit long, items array<string>"


def _scanner(block: dict) -> Callable[[], Callable[[list[str | None]], list]]:
    def make() -> Callable[[list[str | None]], list]:
        searches = _searches(block)

        def run(texts: list[str | None]) -> list:
            split, hits = [words(t) for t in texts], _Hits()
            for i, w in enumerate(split):
                hits.search(searches, i, w)
            return hits.columns(0, [len(w) for w in split])

        return run

    return make


def _parts(item_id: str, text: str | None, window: int, most: int) -> Iterator[tuple[str, str]]:
    """The item's words in parts of at most ``most`` windows; every window is in one of them."""
    w = [x.decode("utf-8", "surrogatepass") for x in words(text)]
    for i in range(0, max(1, len(w) - window + 1), most) if w else ():
        yield item_id, " ".join(w[i : i + most + window - 1])


def _scanned_by_files(docs: DataFrame, items: DataFrame, n_windows: int, window: int, block_windows: int) -> DataFrame:
    """The scan with windows in files: part f of a benchmark's items is file f, and so for all documents."""
    files, root = -(-n_windows // block_windows), shared_path(docs.sparkSession, "windows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [p for i, t in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True) for p in _parts(i, t, window, max(1, block_windows // 16))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], names=["item_id", "text"])

    parts = items.mapInArrow(cut, "item_id string, text string").withColumn("file", F.pmod(F.xxhash64("item_id", "text"), F.lit(files)).cast("int"))
    parts.repartition("file").write.partitionBy("file").parquet(root)
    new = StructType.fromDDL(FIELDS)
    kept = docs.drop(*new.names)
    at = kept.columns.index("text")
    schema = StructType(kept.schema.fields + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in new.fields]
        spool, hits = Spool(), _Hits()
        for batch in batches:
            spool.append(batch)
        for searches in map(_searches, _files(root, files, window)):
            number = 0
            for batch in spool:
                for text in batch.column(at):
                    hits.search(searches, number, words(text.as_py()))
                    number += 1
        number = 0
        for batch in spool:
            sizes = [len(words(t.as_py())) for t in batch.column(at)]
            made = [pa.array(x, t) for x, t in zip(hits.columns(number, sizes), types, strict=True)]
            number += len(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return kept.mapInArrow(run, schema)


def _files(root: str, files: int, window: int) -> Iterator[dict]:
    import pyarrow.parquet as pq

    fs, base = filesystem(root)
    present = {i.base_name for i in fs.get_file_info(pa.fs.FileSelector(base))}
    for f in range(files):
        if f"file={f}" in present:
            yield _block(
                (item_id, windows_of(text, window))
                for path in fs.get_file_info(pa.fs.FileSelector(f"{base}/file={f}")) if path.base_name.endswith(".parquet")
                for batch in pq.ParquetFile(fs.open_input_file(path.path)).iter_batches()
                for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
            )


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_windows: int = 200_000) -> DataFrame:
    """Adds n_words, n_hit, items (sorted item ids), n_items, items_sha256 and contaminated to the documents.

    All columns of ``docs`` are kept but those of these names. Null text has no words and is clean; an empty or
    wordless item matches nothing; an item without an id is ignored; items of equal windows are all reported;
    repeated rows are each reported; an empty benchmark leaves everything clean. Contaminated: n_hit > 0 and
    20 * n_hit >= n_words, hit words being those inside any occurrence of any window.
    """
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(max(1, len(words(t)) - window + 1) for t in batch.column(0).to_pylist())])], names=["n"])

    n_windows = items.select("text").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    kept = docs.drop("n_items", "items_sha256", "contaminated")
    if n_windows > block_windows:
        return _digest(_scanned_by_files(kept, items, n_windows, window, block_windows))
    block = _block((r[0], windows_of(r[1], window)) for r in items.collect())  # at most block_windows windows
    return _digest(appended(kept, ["text"], FIELDS, _scanner(block)))


def _digest(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.concat_ws(",", F.array_sort("items")), 256),
        "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")),
    })
