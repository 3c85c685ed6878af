"""Rows appended by many writers, each batch once.

A batch is written into a folder of its own and counts from the moment a numbered entry of the log names it. Entries come to be
whole or not at all, one for each number: of writers that try the same number one succeeds, the others read on and try the
next. A batch that the log names already is not committed again, so writers may repeat what they don't know to have been done.
Readers see committed folders only.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from . import files


@dataclass(frozen=True)
class State:
    """What a log says up to ``last``: (number, folder) of each that counts, and the batches that are committed."""

    last: int = -1
    folders: tuple[tuple[int, str], ...] = ()
    batches: frozenset[str] = frozenset()


@dataclass
class AppendLog:
    """Rows of ``schema`` under ``path``. Many may write at once, from any driver that shares the folder."""

    spark: SparkSession
    path: str
    schema: T.StructType
    _seen: State = field(default_factory=State)

    def state(self) -> State:
        """The log read on from where it was read last; a compaction's entry says anew which folders count."""
        numbers = [int(n.removesuffix(".json")) for n in storage.names(self.spark, f"{self.path}/log") if n.endswith(".json")]
        now = self._seen
        for number in sorted(n for n in numbers if n > now.last):
            entry = json.loads(storage.content(self.spark, f"{self.path}/log/{number:08d}.json"))
            gone = set(entry.get("replaces", ()))
            kept = tuple((n, f) for n, f in now.folders if f not in gone)
            now = State(number, (*kept, (number, entry["folder"])), now.batches | set(entry["batches"]))
        self._seen = now
        return now

    def _commit(self, batches: list[str], folder: str, replaces: tuple[str, ...] = ()) -> bool:
        """One entry more; False where another writer has committed one of the batches, or replaced what this replaces."""
        while True:
            now = self.state()
            if replaces:
                if not set(replaces) <= {f for _, f in now.folders}:
                    return False
            elif now.batches & set(batches):
                return False
            entry = json.dumps({"batches": batches, "folder": folder, "replaces": replaces})
            if storage.create(self.spark, f"{self.path}/log/{now.last + 1:08d}.json", entry):
                return True

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Commits ``rows`` as ``batch``; False, and nothing appended, where it is committed already. Missing columns are null."""
        if batch in self.state().batches:
            return False
        folder = uuid.uuid4().hex
        fields = (F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None) for f in self.schema.fields)
        whole = rows.select(*(c.cast(f.dataType).alias(f.name) for c, f in zip(fields, self.schema.fields)))
        whole.write.parquet(f"{self.path}/data/{folder}")
        if self._commit([batch], folder):
            return True
        storage.remove(self.spark, f"{self.path}/data/{folder}")
        return False

    def read(self) -> DataFrame:
        """Committed rows with ``commit``: the number of their entry, which orders them; compacted ones have that of before."""
        now = self.state()
        schema = T.StructType([*self.schema.fields, T.StructField("commit", T.LongType())])
        if not now.folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{f}" for _, f in now.folders))
        numbers = self.spark.createDataFrame(list(now.folders), "_number long, _folder string")  # a row for each commit since the last compaction
        folder = F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]{32})/", 1)
        found = rows.withColumn("_in", folder).join(F.broadcast(numbers), F.col("_in") == F.col("_folder"))
        return found.withColumn("commit", F.coalesce("commit", "_number")).drop("_in", "_folder", "_number")

    def compact(self) -> bool:
        """Rows of all folders as one, each with the number it had, so that later ones can still be told; False where another did it meanwhile."""
        now = self.state()
        if len(now.folders) < 2:
            return False
        folder = uuid.uuid4().hex
        self.read().write.parquet(f"{self.path}/data/{folder}")
        done = self._commit([], folder, tuple(f for _, f in now.folders))
        if not done:
            storage.remove(self.spark, f"{self.path}/data/{folder}")
        return done

    def clean(self) -> int:
        """Removes folders that don't count: replaced ones, and what writers left that ended before their commit. Not while others write or read."""
        kept = {f for _, f in self.state().folders}
        gone = [f for f in storage.names(self.spark, f"{self.path}/data") if f not in kept]
        for f in gone:
            storage.remove(self.spark, f"{self.path}/data/{f}")
        return len(gone)


def dump_log(spark: SparkSession, path: str, fields: list[str]) -> AppendLog:
    """A log of dumped results: text cells of ``fields`` and why a question failed."""
    names = [*fields, *(["failure_reason"] if "failure_reason" not in fields else [])]
    return AppendLog(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def append_dump(log: AppendLog, results: DataFrame, batch: str) -> bool:
    """A part of a run's results: nested values as JSON, nulls and missing ones as empty text."""
    cells = files.serialized(results)
    kept = (F.col(f"`{f.name}`") if f.name in cells.columns else F.lit("").alias(f.name) for f in log.schema.fields)
    return log.append(cells.select(*kept), batch)
