"""Session settings the engine is written for."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", app: str = "lodegraph", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
        .config("spark.driver.memory", os.environ.get("LODEGRAPH_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes that an Arrow batch between the JVM and Python holds, but for a single longer row.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes: rows with long lists would make a batch by rows alone very large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([bkmg]?)b?", spark.conf.get(key).lower()).groups()
    held = int(number) << {"k": 10, "m": 20, "g": 30}.get(unit, 0)
    if held <= 0 or held > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


#: Bytes of shuffled data, and of files, that a task is given at most; bytes of input for each partition that a shuffle starts with.
SHUFFLED_BYTES, SPLIT_BYTES, STARTED_BYTES = 16 << 20, 32 << 20, 4 << 20


def small_tasks(spark: SparkSession, sf_dir: str) -> None:
    """Make the session's shuffles start with partitions in proportion to the tables in ``sf_dir``, and give a task little of them: adaptive execution joins
    small partitions and splits none but skewed ones, so what a task holds would grow with the tables. Settings that ask for less a task stay."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = system.getContentSummary(at).getLength() if system.exists(at) else 0
    bytes_of = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLED_BYTES), ("spark.sql.files.maxPartitionBytes", SPLIT_BYTES)):
        if bytes_of(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    least = int(spark.conf.get(key, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if held // STARTED_BYTES > least:
        spark.conf.set(key, str(held // STARTED_BYTES))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once an application: they needn't have it installed or share the driver's folders."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="lodegraph-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/lodegraph.zip", "w") as out:
        for p in sorted(package.rglob("*.py")):
            out.write(p, p.relative_to(package.parent))
    context.addPyFile(f"{folder}/lodegraph.zip")
    _shipped.add(context.applicationId)
