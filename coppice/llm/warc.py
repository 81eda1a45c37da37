"""WARC archives: deduplicating writer and splittable reader.

Writer. Each page becomes one gzip member that holds one record. Payload digests are taken in the JVM, the first
page of each digest is found with partial aggregation on (digest, id) alone, and a join brings it back to the pages.
Digests that very many pages share, of which there are few, are broadcast instead, and those pages dealt evenly. A task writes its archive under a
temporary name and renames it; names follow the partition, so a retried task replaces its own file.

Reader. Archives are cut into byte ranges, one row each. A task scans its range for the gzip magic, accepts a
candidate only if the bytes there inflate to a WARC version line, and owns every record whose member starts inside
the range; it reads beyond the range's end to finish the last one. A magic that occurs inside compressed data fails
the validation or lies before the end of a record just read, and is passed over.

Archives live in the shared folder and are reached through pyarrow's filesystems (local, HDFS, S3, ...).
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import shared_path, written
from coppice.llm.files import filesystem

MAGIC = b"\x1f\x8b\x08"
#: A digest is not dealt by if over one in HOT of all pages have it: fewer than HOT digests are so.
HOT = 1000
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, path string, offset long"
_STEP = 1 << 16


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, html: str | None, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the length and digest of the payload but not the payload."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {_clean(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    raw = ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes page_id, url, html as archives below ``path`` and returns the manifest (path, bytes, records).

    Of the records with equal payloads of at least ``min_bytes`` bytes, that of the smallest page_id is the response
    and the others revisit it; smaller payloads are all responses. Null html is an empty payload, a null url has no
    target URI, a page without an id never is the one referred to while another has one, rows with the smallest id
    are all responses, and no rows give no archives. Other columns are ignored.
    """
    spark = pages.sparkSession
    root = path or shared_path(spark, "warc")
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"),
        F.sha1(F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")).alias("digest"),
        (F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= min_bytes).alias("large"),
    )
    firsts = written(rows.where("large").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first-pages")
    hot = F.col("n") > rows.count() / HOT
    hottest = F.broadcast(firsts.where(hot).select("digest", F.col("first").alias("hot_first")))
    cool = firsts.where(~hot).select(F.col("digest").alias("key"), "first")
    own = F.xxhash64("page_id", "url").cast("string")  # is no digest: deals the pages of the hottest ones evenly
    marked = rows.join(hottest, "digest", "left").withColumn("key", F.when(F.col("hot_first").isNull(), F.col("digest")).otherwise(own))
    joined = marked.join(cool.hint("merge"), "key", "left").select("page_id", "url", "html", "large", F.coalesce("hot_first", "first").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = temporary = None
        n = size = 0
        context = TaskContext.get()
        for batch in batches:
            for page_id, url, html, large, first in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None:
                    fs, base = filesystem(root)
                    fs.create_dir(base, recursive=True)
                    final = f"{base}/part-{context.partitionId():06d}.warc.gz"
                    temporary = f"{base}/.tmp-{context.partitionId():06d}-{context.taskAttemptId()}"
                    out = fs.open_output_stream(temporary, compression=None)
                revisit = bool(large) and first is not None and first != page_id
                payload = (html or "").encode("utf-8", "surrogatepass")
                raw = record(page_id, url, html, base32_sha1(payload), first if revisit else None, revisit)
                out.write(raw)
                n, size = n + 1, size + len(raw)
        if out is not None:
            out.close()
            fs.move(temporary, final)
            name = f"{root.rstrip('/')}/{final.rsplit('/', 1)[1]}"
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([n])], names=["path", "bytes", "records"])

    manifest = joined.mapInArrow(run, "path string, bytes long, records long")
    manifest.write.parquet(f"{root.rstrip('/')}/manifest")
    return spark.read.parquet(f"{root.rstrip('/')}/manifest")


class _Window:
    """Bytes of a file by absolute position, read forward in steps and dropped behind the caller."""

    def __init__(self, f, start: int):
        self.f = f
        self.jump(start)

    def jump(self, to: int) -> None:
        self.start, self.data = to, b""
        self.f.seek(to)

    def more(self, n: int = _STEP) -> bool:
        got = self.f.read(n)
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        self.data, self.start = self.data[to - self.start :], to


def records_in(f, lo: int, hi: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every member that starts in [lo, hi): own by start, whatever the end."""
    w = _Window(f, lo)
    while True:
        at = w.data.find(MAGIC)
        while at < 0:
            keep = max(0, len(w.data) - 2)
            w.drop(w.start + keep)
            if w.start >= hi or not w.more():
                return
            at = w.data.find(MAGIC)
        at += w.start
        if at >= hi:
            return
        w.drop(at)
        raw = _inflate(w)
        if raw is None:
            w.jump(at + 1)
        else:
            yield at, raw


def _inflate(w: _Window) -> bytes | None:
    """The member at the window's start, or None if no WARC record inflates there. The window is left at its end.

    Every byte is read and fed once, so the time is linear in the member's length.
    """
    z = zlib.decompressobj(31)
    parts, head = [], b""
    while True:
        if not w.data and not w.more():
            return None
        chunk = w.data
        w.drop(w.start + len(chunk))
        try:
            parts.append(z.decompress(chunk))
        except zlib.error:
            return None
        if len(head) < 7:
            head += parts[-1][: 7 - len(head)]
            if not b"WARC/1.".startswith(head):
                return None
        if z.eof:
            w.data, w.start = z.unused_data, w.start - len(z.unused_data)
            return b"".join(parts) if len(head) == 7 else None


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record (names in lower case) and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, rest[: int(headers.get("content-length", len(rest)))]


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def ranges(manifest: DataFrame, split_bytes: int) -> DataFrame:
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("bytes") - 1), F.lit(split_bytes))
    return (
        manifest.where("bytes > 0").select("path", F.explode(starts).alias("lo"))
        .select("path", "lo", (F.col("lo") + split_bytes).alias("hi"))
    )


def read(manifest: DataFrame, split_bytes: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """The records of the archives of a manifest (path, bytes), read by byte ranges.

    Responses have the length and digest of the payload as read; revisits those that their headers give. With
    ``payloads`` false the payload column is null.
    """
    cut = ranges(manifest, split_bytes)
    parts = max(1, cut.count())
    cut = cut.repartition(min(parts, max(manifest.sparkSession.sparkContext.defaultParallelism * 4, parts // 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())])
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path, lo, hi in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    for offset, raw in records_in(f, lo, hi):
                        headers, block = parse(raw)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit = headers.get("warc-type") == "revisit"
                        if revisit:
                            size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        else:
                            size, digest = len(payload), base32_sha1(payload)
                        rows.append((
                            _page(headers.get("warc-record-id")), headers.get("warc-target-uri"), size, digest, headers.get("warc-type"),
                            _page(headers.get("warc-refers-to")) if revisit else None, payload if payloads and not revisit else None, path, offset,
                        ))
                        held += len(payload) if payloads else 0
                        if len(rows) >= 1000 or held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return cut.mapInArrow(run, RECORDS)
