"""What the operators of this subpackage share: column-adding Arrow steps and shared storage."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Bytes that an Arrow batch between the JVM and Python, and a slice of it handed to a step, may hold; a single longer row
#: is a batch of its own.
BATCH_BYTES, SLICE_BYTES = 2 << 20, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lodegraph-')}"
        spark.sparkContext.setCheckpointDir(root)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)  # without a scheme, it is the default file system's
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub("^file:/+", "file:///", whole)


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _forget() -> None:
    for spark, path in _written:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared storage; a session that has ended leaves it to the folder's owner."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session is gone
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in shared storage, removed when the driver ends."""
    path = f"{shared_dir(spark)}/lodegraph-{uuid.uuid4().hex}-{name}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in shared storage: its lineage ends there, and lost executors take none of it along."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete the folders of written tables that are no longer read."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, path)


#: Words of 64 places that a sieve holds at most: some 60 MB where it is broadcast. Of 7 million ids a tenth of all others pass, too.
SIEVE = 1 << 20


def sieve(ids: DataFrame, column: str) -> DataFrame:
    """(at, places): which of 64 ``SIEVE`` places the ids in ``column`` fall on, a bit for each; to be broadcast, for it has a bounded size."""
    word, bit = _place(column)
    return ids.select(word.alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("places"))


def _place(column: str) -> tuple[Column, Column]:
    """(word, bit) of an id's place."""
    h = F.xxhash64(column)
    return F.pmod(h, F.lit(SIEVE)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))


def sifted(df: DataFrame, column: str, places: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of ``df`` whose id falls on one of the places (or on none): a filter before a join, so that few rows are shuffled."""
    word, bit = _place(column)
    met = (word == places["at"]) & (places["places"].bitwiseAND(bit) != 0)
    return df.join(F.broadcast(places), met, "left_semi" if inside else "left_anti")


def apart(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that Spark never tells to all tasks: it goes by the size of the files that a frame is read from, and of each row that
    stands there an explode makes dozens, which the driver would have to hold."""
    return df.hint("merge")


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes: by rows alone, one batch of long texts can take a worker's memory. The workers get this package, too."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([bkmg]?)b?", spark.conf.get(key).lower()).groups()
    held = int(number) << {"k": 10, "m": 20, "g": 30}.get(unit, 0)
    if held <= 0 or held > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose text in ``column`` stays under ``limit`` bytes."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist() if batch.num_rows else []
    start = held = 0
    for k, n in enumerate(sizes):
        if k > start and held + n > limit:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def add_columns(df: DataFrame, text: str, fields: list[T.StructField], step: Callable[[], Callable], keep_text: bool = True, done: Callable[[], None] | None = None) -> DataFrame:
    """``df`` with ``fields`` computed from the column ``text`` by Arrow batches.

    ``step()`` runs once a task and returns a function from a list of texts (None where null) to one
    list or Arrow array for each field. A column of ``df`` that bears the name of a new one is replaced.
    Without ``keep_text`` the texts go to Python only, not back. ``done`` runs when a task has ended.
    """
    small_batches(df.sparkSession)
    names = {f.name for f in fields} | (set() if keep_text else {text})
    kept = [f.name for f in df.schema.fields if f.name not in names]
    at = df.columns.index(text)
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    kinds = [pa.field(f.name, _arrow(f.dataType)) for f in fields]
    places = [df.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = step()
        for batch in batches:
            for part in slices(batch, at):
                made = make(part.column(at).to_pylist())
                new = [x if isinstance(x, pa.Array) else pa.array(x, kind.type) for x, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *new], names=[*kept, *(k.name for k in kinds)])
        if done:
            done()
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return to the system what a task has freed: workers live on from task to task, and each would keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def _arrow(kind: T.DataType) -> pa.DataType:
    simple = {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.ShortType: pa.int16(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return simple[type(kind)]


def bounded(drawn: DataFrame, by: str, text: str, most_bytes: int) -> DataFrame:
    """Of a drawn sample (some thousands of rows), so many rows of each ``by`` that their texts together stay under ``most_bytes``, shorter texts first.

    A row of (``by``, bytes, times) is all that is gathered to choose; each ``by`` gets the same share of the bytes.
    """
    kept = written(drawn, "drawn")
    (size,) = spare(kept, "bytes")
    sized = kept.withColumn(size, F.octet_length(text))
    by_size: dict = {}
    for r in sized.groupBy(by, size).count().collect():
        by_size.setdefault(r[0], []).append((r[1], r["count"]))
    share, cuts = most_bytes / max(1, len(by_size)), []
    for group, sizes in by_size.items():
        held, cut = 0, 0
        for bytes_, times in sorted(sizes):
            held += bytes_ * times
            if held > share:
                break
            cut = bytes_
        cuts.append((group, cut))
    if not cuts:
        return kept
    limits = kept.sparkSession.createDataFrame(cuts, T.StructType([T.StructField("_of", kept.schema[by].dataType), T.StructField("_most", T.LongType())]))
    return sized.join(F.broadcast(limits), (F.col(by) == F.col("_of")) & (F.col(size) <= F.col("_most")), "left_semi").drop(size)  # a row for each group


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of one's own, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as a reference, whatever stands in it."""
    return "`" + name.replace("`", "``") + "`"


def remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    id_ = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
