"""WARC archives with an index, read back by coalesced byte ranges.

Writing: each task puts its records, each a gzip member of its own, into archives in shared storage and returns an index
row per record: archive, offset, length, URL, digest. The index is written as a table before anything is read. A task that
is run again writes other archives; those of the failed one are in no index row and so are never read.

Reading: the index rows asked for are sorted by archive and offset, and neighbours are joined to ranges as long as the
gap between them and the range's whole length stay small; each range is one read. Archives are cut at ``ARCHIVE_BYTES``,
so sorting one archive's rows is a bounded task.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, small_batches, spare, table, written

#: Bytes after which a new archive is begun; widest gap that a read spans; longest read; least payload that a revisit
#: record may stand for.
ARCHIVE_BYTES, GAP_BYTES, READ_BYTES, REVISIT_BYTES = 256 << 20, 64 << 10, 4 << 20, 1000
#: Bytes of archives that a task reads, and least bytes where there are idle cores.
TASK_BYTES, LEAST_TASK_BYTES = 128 << 20, 1 << 20
#: All records bear this date, so that equal pages give equal archives.
DATE = "2024-01-01T00:00:00Z"
_INDEX = "page_id long, url string, archive string, offset long, length long, digest string, record_type string"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has the headers, with its payload's length and digest, but no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324 - the format's digest
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = payload if refers_to is None else b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and body of one record; a record cut short or malformed is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
    size = int(fields["content-length"])
    if not lines[0].startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, rest[:size]


def packed(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def revisits(pages: DataFrame, page: str = "page_id", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` with refers_to: the greatest id among rows of equal payload of ``least`` bytes or more, null for that row itself.

    Only digests that occur again are joined; smaller payloads get keys of their own, so that they don't meet in one partition.
    Several rows of that greatest id are all responses. A column named refers_to is replaced, all others stay.
    """
    key, first, count = spare(pages, "digest", "first", "times")
    payload = F.coalesce(F.col(html), F.lit(""))
    large = F.octet_length(payload) >= least
    keyed = pages.withColumn(key, F.when(large, F.sha1(payload)).otherwise(F.concat(F.lit("small "), F.xxhash64(page, payload).cast("string"))))
    again = keyed.where(large).groupBy(key).agg(F.max(page).alias(first), F.count("*").alias(count)).where(F.col(count) > 1).drop(count)
    found = keyed.join(again, key, "left")
    return found.withColumn("refers_to", F.when(~F.col(first).eqNullSafe(F.col(page)), F.col(first))).drop(key, first)


def write(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of all ``pages`` (with refers_to, see ``revisits``) in shared storage; returns their index as a written table.

    Payloads are the html in UTF-8, null an empty one. Null ids and URLs are written empty; control characters and
    spaces of URLs are percent-encoded. No pages give an empty index.
    """
    folder = new_path(pages.sparkSession, "warc")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows: list[tuple] = []
                for p, u, h, r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        store.create_dir(root, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    payload = (h or "").encode()
                    data = packed(record(p, u, payload, r))
                    out.write(data)
                    rows.append((p, u, f"{folder}/{name}", at, len(data), hashlib.sha1(payload).hexdigest(), "response" if r is None else "revisit"))  # noqa: S324
                    at += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    small_batches(pages.sparkSession)
    chosen = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.col("refers_to").cast("long").alias("refers_to"))
    return written(chosen.mapInArrow(archive, _INDEX), "index")


def ranges(index: DataFrame, gap: int = GAP_BYTES, longest: int = READ_BYTES) -> DataFrame:
    """(archive, start, size, records): the index rows' byte ranges, coalesced; records are their (offset, length), sorted.

    A range ends where the next record lies beyond ``gap``, and where a stretch of ``longest`` bytes of the archive does.
    """
    order = Window.partitionBy("archive").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(order)
    cut = before.isNull() | (F.col("offset") - before > gap) | (F.floor(F.col("offset") / longest) != F.floor(F.lag("offset").over(order) / longest))
    numbered = index.select("archive", "offset", "length").distinct().withColumn("_cut", cut.cast("int")).withColumn("_range", F.sum("_cut").over(order))
    grouped = numbered.groupBy("archive", "_range").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"))
    return grouped.select("archive", "start", (F.col("stop") - F.col("start")).alias("size"), "records")


_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(index: DataFrame, where: Column | None = None, gap: int = GAP_BYTES, longest: int = READ_BYTES) -> DataFrame:
    """The records of the index rows that ``where`` selects, parsed, one read for each range.

    The ranges are dealt to tasks in the order of archives and offsets, so that a task opens an archive once and reads forward.
    A response's payload is checked against its digest. A revisit's payload is null; its bytes and digest are the full
    payload's, as its headers give them.
    """
    chosen = index if where is None else index.where(where)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORD.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        with ExitStack() as held:
            now = source = None
            for batch in batches:
                for path, start, size, records in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if path != now:
                        held.close()
                        store, at = open_store(path)
                        now, source = path, held.enter_context(store.open_input_file(at))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*records_of(path, start, records, source.read_at(size, start)), strict=True), kinds, strict=True)], names=names)

    def records_of(path: str, start: int, records: list[dict], data: bytes) -> list[tuple]:
        rows = []
        for r in records:
            head, body = parsed(zlib.decompress(data[r["offset"] - start :][: r["length"]], 31))
            own = lambda name: int(x) if (x := head.get(name, "")[len("<urn:page:") : -1]) else None  # noqa: B023, E731
            digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
            kind = head["warc-type"]
            if kind == "response" and hashlib.sha1(body).hexdigest() != digest:  # noqa: S324
                raise ValueError(f"the payload at {path}, {r['offset']} is not the one that was written")
            rows.append((own("warc-record-id"), head["warc-target-uri"], kind, own("warc-refers-to"), int(head["x-payload-length"]), digest, body if kind == "response" else None))
        return rows

    spark = index.sparkSession
    small_batches(spark)
    total = chosen.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // TASK_BYTES), min(2 * spark.sparkContext.defaultParallelism, -(-total // LEAST_TASK_BYTES)))
    dealt = ranges(chosen, gap, longest).repartitionByRange(tasks, "archive", "start").sortWithinPartitions("archive", "start")
    return dealt.mapInArrow(fetch, _RECORD)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, and what the archives say of it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return read(write(revisits(pages))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
