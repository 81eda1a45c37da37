"""What the operators of this subpackage share: shared storage, text normalisation, column guards."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Byte table for the word definition of the benchmark and shingle operators: A-Z lower-cased, every other ASCII
#: byte but 0-9 and a-z a separator. All UTF-8 bytes of code points from U+0080 are kept, so splitting the
#: translated bytes at spaces gives exactly the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """The lower-cased words of a text as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def shared_root(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, which ``spark.checkpoint.dir`` names.

    Where that is unset, a local master gets a temporary folder; a cluster, whose machines would each write to a disk
    of their own, gets an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not root and current.isDefined():
        root = current.get()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="coppice-")
    if not current.isDefined():
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/coppice-{sc.applicationId}"


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def cleared(spark: SparkSession) -> None:
    """Deletes what operators of this application wrote to the shared folder: to be called once results are stored."""
    _delete(spark, shared_root(spark))


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing will read again: all that came of them is written itself."""
    for t in tables:
        _delete(t.sparkSession, t._written_to)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Ids of a broadcast side at most; a broadcast table of them takes some tens of MB.
BROADCAST_IDS = 1_000_000


def matching(df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi") -> DataFrame:
    """Semi or anti join of df with ids (the column or columns ``key``, distinct, of a written table).

    Up to BROADCAST_IDS ids are counted and broadcast, so that df stays where it is; more are dealt by key with df.
    """
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids.hint("merge"), key, how)


def written(df: DataFrame, what: str, arrow_rows: int | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    ``arrow_rows`` is how many rows go to Python at once while this table is made, for rows that hold long texts.
    """
    spark = df.sparkSession
    path = shared_path(spark, what)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if arrow_rows:
        spark.conf.set(name, arrow_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def own_names(docs: DataFrame) -> list[str]:
    """Names for the columns of docs that clash with none of an operator's: doc_id and text keep theirs."""
    return [c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)]


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32(doc_id as text) mod n; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n, F.lit(0)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Spool:
    """Arrow batches kept by a task, to be read as often as needed: beyond ``held`` of them on the task's own disk."""

    def __init__(self, held: int = 16):
        self.held, self.batches, self.file, self.writer = held, [], None, None

    def append(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch)
        if len(self.batches) > self.held:
            if self.writer is None:
                self.file = tempfile.TemporaryFile()
                self.writer = pa.ipc.new_stream(self.file, batch.schema)
            for b in self.batches:
                self.writer.write_batch(b)
            self.batches = []

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        if self.writer is not None:
            self.file.flush()
            end = self.file.tell()
            self.file.seek(0)
            reader = pa.ipc.open_stream(self.file)
            while self.file.tell() < end:
                yield reader.read_next_batch()
            self.file.seek(end)
        yield from self.batches


def appended(
    df: DataFrame, inputs: Sequence[str], fields: str, make: Callable[[], Callable[..., list]], rows: int = 1000, without: Sequence[str] = ()
) -> DataFrame:
    """All rows and columns of df (but those named as a new field or in ``without``) and the columns of ``fields``, made in Python.

    ``make()`` runs once a task and returns the function that gets the values of ``inputs`` as lists, ``rows`` rows
    at a time, and returns a list (or Arrow array) for each new field. Other columns pass through as Arrow buffers,
    so their types and nulls stay as they are.
    """
    new = StructType.fromDDL(fields)
    df = df.drop(*new.names)
    passed = [i for i, c in enumerate(df.columns) if c not in without]
    names = [*(df.columns[i] for i in passed), *new.names]
    at = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in new.fields]
        f = None
        for whole in batches:
            f = f or make()
            for i in range(0, whole.num_rows, rows):
                batch = whole.slice(i, rows)
                made = f(*(batch.column(k).to_pylist() for k in at))
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in passed), *arrays], names=names)

    return df.mapInArrow(run, StructType([df.schema.fields[i] for i in passed] + new.fields))
