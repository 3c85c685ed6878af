"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def _at(spark: SparkSession, path: str):
    """(file system, path) as Hadoop sees them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; without one a local master gets a temporary folder, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _local.get(app) or _local.setdefault(app, f"file://{tempfile.mkdtemp(prefix='lodegraph-')}")
    system, at = _at(spark, root)
    return re.sub("^file:/+", "file:///", system.makeQualified(at).toString())


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in shared storage, removed when the driver ends."""
    path = f"{shared_dir(spark)}/lodegraph-{uuid.uuid4().hex}-{name}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in shared storage: its lineage ends there, and lost executors take none of it along."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    system, at = _at(spark, path)
    system.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _at(spark, path)
    return system.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, in order; nothing where there is none."""
    system, at = _at(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []


def create(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that comes to be whole or not at all; False where there is one already. Of several writers one succeeds."""
    system, at = _at(spark, path)
    _, aside = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = system.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if system.getScheme() == "file":  # its rename would replace
            os.link(aside.toUri().getPath(), at.toUri().getPath())
            return True
        return not system.exists(at) and system.rename(aside, at)
    except FileExistsError:
        return False
    finally:
        system.delete(aside, False)


def content(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    return spark.read.text(path, wholetext=True).first()[0]


@atexit.register
def _forget() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended; the folder is its owner's
            return
