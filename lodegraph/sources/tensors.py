"""Vectors in tensor archives: a zip of raw storages and a description of the tensors that lie in them.

The description is a pickle. It is never loaded: its operations are read one by one into plain values, names stay names, and
what isn't a tensor, a number, a text or a container of these is an error. So a file from elsewhere can run nothing.

A folder holds a file for each node type, or several in order where a type is large. The data source plans partitions of bounded
size from the archives' directories, only of the types that are asked for, and each task reads its rows' bytes alone. Types are
an option of the read, not a filter pushed down: Spark remembers a source's pushed filters for later queries on the same frame.
"""

from __future__ import annotations

import json
import pickletools
import re
import struct
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.numbering import positions
from ..storage import exists

#: Bytes of vectors that a task reads and that a batch holds; rows of a file that is written.
TASK_BYTES, BATCH_BYTES, FILE_ROWS = 32 << 20, 2 << 20, 1 << 18
#: Types whose names hold a sign that a file's name can't; storage kinds.
TYPE_NAMES = {"geneprotein": "gene/protein", "effectphenotype": "effect/phenotype"}
STORAGES = {"FloatStorage": "<f4", "DoubleStorage": "<f8", "HalfStorage": "<f2"}


@dataclass(frozen=True)
class Tensor:
    storage: str
    kind: str
    offset: int
    shape: tuple[int, ...]
    stride: tuple[int, ...]

    @property
    def plain(self) -> bool:
        """Whether rows lie one behind the other."""
        want, step = [], 1
        for n in reversed(self.shape):
            want.append(step)
            step *= n
        return self.stride == tuple(reversed(want))


class _Named(str):
    """A name that the description mentions."""


def described(data: bytes):
    """What a description says: a ``Tensor``, or containers of tensors, numbers and texts."""
    stack, marks, memo = [], [], {}

    def since_mark() -> list:
        at = marks.pop()
        out = stack[at:]
        del stack[at:]
        return out

    def call(name, given):
        if name == "torch._utils _rebuild_tensor_v2":
            (_, kind, key, _, _), offset, shape, stride = given[:4]
            return Tensor(str(key), STORAGES[kind.split()[-1]], int(offset), tuple(shape), tuple(stride))
        if name == "collections OrderedDict" and not given:
            return {}
        raise ValueError(f"a tensor file may not call {name}")

    for op, value, _ in pickletools.genops(data):
        match op.name:
            case "PROTO" | "FRAME" | "STOP":
                pass
            case "MARK":
                marks.append(len(stack))
            case "GLOBAL":
                stack.append(_Named(value))
            case "STACK_GLOBAL":
                last = stack.pop()
                stack[-1] = _Named(f"{stack[-1]} {last}")
            case "BINUNICODE" | "SHORT_BINUNICODE" | "BININT" | "BININT1" | "BININT2" | "LONG1" | "BINFLOAT":
                stack.append(value)
            case "NONE" | "NEWTRUE" | "NEWFALSE":
                stack.append({"NONE": None, "NEWTRUE": True, "NEWFALSE": False}[op.name])
            case "EMPTY_TUPLE" | "EMPTY_LIST" | "EMPTY_DICT":
                stack.append({"EMPTY_TUPLE": (), "EMPTY_LIST": [], "EMPTY_DICT": {}}[op.name])
            case "TUPLE":
                stack.append(tuple(since_mark()))
            case "TUPLE1" | "TUPLE2" | "TUPLE3":
                n = int(op.name[-1])
                stack[-n:] = [tuple(stack[-n:])]
            case "BINPUT" | "LONG_BINPUT":
                memo[value] = stack[-1]
            case "MEMOIZE":
                memo[len(memo)] = stack[-1]
            case "BINGET" | "LONG_BINGET":
                stack.append(memo[value])
            case "BINPERSID":
                pass  # the storage's description stands for it
            case "REDUCE":
                given = stack.pop()
                name = stack.pop()
                if not isinstance(name, _Named):
                    raise ValueError("a tensor file may call names only")
                stack.append(call(name, given))
            case "SETITEM":
                v, k = stack.pop(), stack.pop()
                stack[-1][k] = v
            case "SETITEMS":
                pairs = since_mark()
                stack[-1].update(zip(pairs[::2], pairs[1::2]))
            case "APPEND":
                v = stack.pop()
                stack[-1].append(v)
            case "APPENDS":
                rest = since_mark()
                stack[-1].extend(rest)
            case _:
                raise ValueError(f"a tensor file may not use {op.name}")
    return stack[-1]


def _number(n: int) -> bytes:
    return b"J" + struct.pack("<i", n) if n < 1 << 31 else b"\x8a\x08" + struct.pack("<q", n)


def _text(s: str) -> bytes:
    return b"X" + struct.pack("<I", len(s.encode())) + s.encode()


def _numbers(values: Sequence[int]) -> bytes:
    return b"(" + b"".join(map(_number, values)) + b"t"


def _tensor(key: str, shape: Sequence[int]) -> bytes:
    """The operations that describe a tensor of 32-bit floats with a storage to itself."""
    size, stride = 1, []
    for n in reversed(shape):
        stride.insert(0, size)
        size *= n
    storage = b"(" + _text("storage") + b"ctorch\nFloatStorage\n" + _text(key) + _text("cpu") + _number(size) + b"tQ"
    return b"ctorch._utils\n_rebuild_tensor_v2\n(" + storage + _number(0) + _numbers(shape) + _numbers(stride) + b"\x89ccollections\nOrderedDict\n)RtR"


def _file(uri: str):
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    return system, path


class _Archive:
    """Where the storages of an archive lie."""

    def __init__(self, file):
        self.file, self.zip = file, zipfile.ZipFile(file)
        self.root = next(n for n in self.zip.namelist() if n.endswith("data.pkl")).removesuffix("data.pkl")
        self.value = described(self.zip.read(f"{self.root}data.pkl"))

    def place(self, t: Tensor) -> int:
        """The tensor's first byte in the file."""
        entry = self.zip.getinfo(f"{self.root}data/{t.storage}")
        if entry.compress_type != zipfile.ZIP_STORED or not t.plain:
            raise ValueError("only plain tensors in stored entries can be read by ranges")
        self.file.seek(entry.header_offset + 26)
        name, extra = struct.unpack("<HH", self.file.read(4))
        return entry.header_offset + 30 + name + extra + t.offset * np.dtype(t.kind).itemsize


@dataclass
class _Rows(InputPartition):
    """Vectors that lie one behind the other in a file. ``keys``: those of a dictionary's vectors; else rows count from ``first``."""

    uri: str
    node_type: str
    first: int
    byte: int
    rows: int
    width: int
    kind: str
    keys: list | None = None


class TensorFiles(DataSource):
    """``path``: a folder of node files, or one file with a dictionary; ``kind``: nodes or dictionary; ``types``: a JSON list of node types, all by default."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        first = "node_type string, position long" if self.options.get("kind", "nodes") == "nodes" else "key string"
        return f"{first}, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        types = self.options.get("types")
        return TensorReader(self.options["path"], self.options.get("kind", "nodes"), None if types is None else set(json.loads(types)))


class TensorReader(DataSourceReader):
    def __init__(self, uri: str, kind: str, types: set[str] | None = None):
        self.uri, self.kind, self.types = uri, kind, types

    def _files(self) -> list[tuple[str, str]]:
        """(type, path) in the order of their rows; none where the folder is missing."""
        system, path = _file(self.uri)
        found = system.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
        out = []
        for info in found:
            if info.base_name.endswith(".pt"):
                stem, _, last = info.base_name.removesuffix(".pt").rpartition("_")
                kind, part = TYPE_NAMES.get(stem, stem), last.partition("-")[2]
                if self.types is None or kind in self.types:
                    out.append((kind, int(part or 0), info.path))
        return [(kind, path) for kind, _, path in sorted(out)]

    def partitions(self) -> list[_Rows]:
        system, path = _file(self.uri)
        if self.kind != "nodes":
            if system.get_file_info(path).type != pyarrow.fs.FileType.File:
                return []
            with system.open_input_file(path) as file:
                return list(self._dictionary(_Archive(file), path))
        out, counted = [], {}
        for kind, path in self._files():
            with system.open_input_file(path) as file:
                archive = _Archive(file)
                t = archive.value
                if not isinstance(t, Tensor) or len(t.shape) != 2:
                    raise ValueError(f"{path} is no matrix")
                byte, (rows, width) = archive.place(t), t.shape
            size = np.dtype(t.kind).itemsize * width
            step = max(1, TASK_BYTES // max(1, size))
            for first in range(0, rows, step):
                out.append(_Rows(path, kind, counted.get(kind, 0) + first, byte + first * size, min(step, rows - first), width, t.kind))
            counted[kind] = counted.get(kind, 0) + rows
        return out

    def _dictionary(self, archive: _Archive, path: str) -> Iterator[_Rows]:
        """Runs of vectors whose bytes follow each other are one partition, up to a task's size."""
        held = sorted((archive.place(t), str(k), t) for k, t in archive.value.items())
        run: list = []
        for byte, key, t in held:
            size = int(np.prod(t.shape)) * np.dtype(t.kind).itemsize
            if run and (run[-1][0] + run[-1][2] != byte or run[0][3] != (t.shape, t.kind) or byte + size - run[0][0] > TASK_BYTES):
                yield self._run(run, path)
                run = []
            run.append((byte, key, size, (t.shape, t.kind)))
        if run:
            yield self._run(run, path)

    @staticmethod
    def _run(run: list, path: str) -> _Rows:
        shape, kind = run[0][3]
        return _Rows(path, "", 0, run[0][0], len(run), int(np.prod(shape)), kind, [key for _, key, _, _ in run])

    def read(self, part: _Rows | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark's one partition where none is planned
            return
        system, _ = _file(self.uri)
        size = np.dtype(part.kind).itemsize * part.width
        step = max(1, BATCH_BYTES // max(1, size))
        with system.open_input_file(part.uri) as file:
            for first in range(0, part.rows, step):
                n = min(step, part.rows - first)
                file.seek(part.byte + first * size)
                values = np.frombuffer(file.read(n * size), part.kind).astype("<f4")
                lists = pa.ListArray.from_arrays(np.arange(0, n * part.width + 1, max(1, part.width), dtype=np.int32)[: n + 1], pa.array(values))
                if part.keys is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(part.keys[first : first + n], pa.string()), lists], names=["key", "embedding"])
                else:
                    places = pa.array(np.arange(part.first + first, part.first + first + n))
                    yield pa.RecordBatch.from_arrays([pa.array([part.node_type] * n), places, lists], names=["node_type", "position", "embedding"])


def _reader(spark: SparkSession, path: str, kind: str, types: Sequence[str] | None = None) -> DataFrame:
    spark.dataSource.register(TensorFiles)
    reader = spark.read.format("tensors").option("path", path).option("kind", kind)
    return (reader if types is None else reader.option("types", json.dumps(sorted(types)))).load()


def read_nodes(spark: SparkSession, folder: str, types: Sequence[str] | None = None) -> DataFrame:
    """(node_type, position, embedding): rows of the node files of a folder, of the ``types`` named or of all; no folder gives none."""
    return _reader(spark, folder, "nodes", types)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(key, embedding) of a file that maps ids or texts to vectors; a missing file gives no rows."""
    return _reader(spark, path, "dictionary")


def numbered_ids(nodes: DataFrame) -> DataFrame:
    """(node_id, node_type, position): a type's nodes numbered by id, which is the order of its vectors' rows."""
    return positions(nodes.select("node_id", "node_type"), ["node_type"], ["node_id"])


def node_vectors(spark: SparkSession, folder: str, ids: DataFrame, strict: bool = False) -> DataFrame:
    """(node_id, node_type, embedding) of the nodes whose ``ids`` (node_id, node_type, position) have a row.

    ``strict``: a type of ``ids`` with more or fewer rows than nodes, or without a file, stops the plan.
    """
    rows = read_nodes(spark, folder).withColumnRenamed("node_type", "_type").withColumnRenamed("position", "_at")
    met = (ids["node_type"] == rows["_type"]) & (ids["position"] == rows["_at"])
    if not strict:
        return ids.join(rows, met).select("node_id", "node_type", "embedding")
    both = ids.join(rows, met, "full")
    bad = F.col("node_id").isNull() | F.col("_type").isNull()
    told = F.format_string("vectors and nodes of type %s differ in number", F.coalesce("node_type", "_type"))
    return both.withColumn("node_type", F.when(bad, F.raise_error(told).cast("string")).otherwise(F.col("node_type"))).select("node_id", "node_type", "embedding")


def write_nodes(vectors: DataFrame, folder: str, rows: int = FILE_ROWS) -> None:
    """A file of 32-bit floats for each type of ``vectors`` (node_type, position, embedding), rows by position; larger types in several files of ``rows``.

    Files are streamed, so a task holds no more than a batch; a task that is run again writes the same file anew.
    """
    spark = vectors.sparkSession
    if exists(spark, folder):
        raise FileExistsError(folder)
    dealt = vectors.select("node_type", "position", F.floor(F.col("position") / rows).alias("part"), "embedding").repartition("node_type", "part")
    dealt = dealt.sortWithinPartitions("node_type", "part", "position")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file(folder)
        system.create_dir(base, recursive=True)
        for name, chunks in _files_of(batches):
            count, width = 0, 0
            with system.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                with z.open("archive/data/0", "w", force_zip64=True) as entry:
                    for lists in chunks:
                        values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), "<f4")
                        count, width = count + len(lists), len(values) // max(1, len(lists))
                        entry.write(values.tobytes())
                z.writestr("archive/data.pkl", b"\x80\x02" + _tensor("0", (count, width)) + b".")
                z.writestr("archive/byteorder", "little")
                z.writestr("archive/version", "3\n")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count])], names=["name", "rows"])

    dealt.mapInArrow(write, "name string, rows long").write.format("noop").mode("overwrite").save()


def _files_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[pa.Array]]]:
    """(file name, its runs of vectors): rows come sorted by type and part."""
    held: list = []

    def runs():
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
            start = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[start]:
                    yield keys[start], batch.column(3).slice(start, k - start)
                    start = k

    stream = runs()
    first = next(stream, None)
    while first is not None:
        key = first[0]

        def chunks(first=first, key=key):
            yield first[1]
            for other, lists in stream:
                if other != key:
                    held.append((other, lists))
                    return
                yield lists

        given = chunks()
        yield f"{re.sub('/', '', key[0])}_embeddings" + (f"-{key[1]:05d}.pt" if key[1] else ".pt"), given
        first = held.pop() if held else None


def write_dictionary(vectors: DataFrame, path: str, most_bytes: int = 1 << 30) -> None:
    """One file that maps ``key`` to ``embedding`` (key, embedding), sorted by key. For questions and searched texts: beyond ``most_bytes`` an error.

    The format asks for one file, so one task streams it.
    """
    size = vectors.agg(F.sum(4 * F.size("embedding").cast("long"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of vectors are no dictionary; write them as nodes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _file(path)
        system.create_dir(at.rpartition("/")[0], recursive=True)
        items, n = [], 0
        with system.open_output_stream(at) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for batch in batches:
                for key, lists in zip(batch.column(0).to_pylist(), batch.column(1)):
                    values = np.asarray(lists.values.to_numpy(zero_copy_only=False), "<f4")
                    z.writestr(f"archive/data/{n}", values.tobytes())
                    items.append((_number(key) if isinstance(key, int) else _text(key)) + _tensor(str(n), (len(values),)))
                    n += 1
            z.writestr("archive/data.pkl", b"\x80\x02}(" + b"".join(items) + b"u.")
            z.writestr("archive/version", "3\n")
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    if not size:
        list(write(iter(())))  # no task would run
        return
    vectors.select("key", "embedding").coalesce(1).sortWithinPartitions("key").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
