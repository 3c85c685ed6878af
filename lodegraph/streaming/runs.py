"""Runs as streams: results appended as they come, each once, and metrics that follow. An extension: batch runs need none of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.runs import resume
from ..sources.appends import AppendLog


def questions(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """Question rows from the Parquet files of a folder, those that come later too."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def answered(stream: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Answers everything that is there and ends. A question that has a row in ``out`` isn't answered again.

    Each batch writes its own folder, so a batch that is run again after a failure replaces what it wrote.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.option("basePath", out).parquet(out).where(F.col("batch") != number)
            batch = resume(batch, done)
        except Exception as error:  # noqa: BLE001 - only a folder that isn't there yet is fine
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        answer(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_means(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Number of rows and mean of each column so far; nulls count as 0. The only state is one row."""
    return rows.agg(F.count("*").alias("total_queries"), *(F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(f"avg_{c}") for c in columns))


#: Digits behind the point that summed values are kept to, so that what is taken out cancels what was put in.
DIGITS = 12


class ReplacingMeans:
    """Means over questions of which later rows replace earlier ones, kept as rows come.

    The state holds each question's row of greatest ``seq``; a row that comes late changes nothing. It is Spark's own aggregate, which folds
    a batch's rows before they are shuffled and calls no Python. After each batch the state is summed to one row, committed once under the batch's
    number, so a batch that is run again after a failure doesn't count twice; the last one holds. Sums are decimal, so they don't depend
    on the order of rows. Null values count as 0. State grows with the questions, the log by a row a batch.
    """

    def __init__(self, spark: SparkSession, path: str, columns: list[str], key: str = "query_id", seq: str = "seq"):
        self.spark, self.path, self.columns, self.key, self.seq = spark, path, columns, key, seq
        kind = T.DecimalType(38, DIGITS)
        fields = [T.StructField("total_queries", T.LongType())] + [T.StructField(c, kind) for c in columns]
        self.log = AppendLog(spark, f"{path}/deltas", T.StructType(fields))

    def last(self, rows: DataFrame) -> DataFrame:
        """(key, columns...): each question's row of greatest ``seq``, a null one counting as least; of equal ones that of greater values."""
        seq = F.coalesce(F.col(self.seq).cast("long"), F.lit(-(1 << 63)))
        values = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in self.columns)
        row = F.struct(seq.alias("seq"), F.struct(*values).alias("values"))
        return rows.groupBy(self.key).agg(F.max(row).alias("_last")).select(self.key, "_last.values.*")

    def start(self, rows: DataFrame) -> StreamingQuery:
        """Takes in all that is there and ends; started again it goes on where it stopped."""

        def each(batch: DataFrame, number: int) -> None:
            kind = f"decimal(38,{DIGITS})"
            sums = (F.sum(F.col(c).cast("decimal(25,12)").cast(kind)).alias(c) for c in self.columns)
            self.log.append(batch.agg(F.count("*").alias("total_queries"), *sums), str(number))

        stream = self.last(rows).writeStream.outputMode("complete").foreachBatch(each)
        return stream.option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()

    def means(self) -> DataFrame:
        """(total_queries, avg_...): one row, of all batches that are committed; averages null where no question is in."""
        latest = lambda c: F.max_by(c, "commit")
        n = F.coalesce(latest("total_queries"), F.lit(0)).cast("long")
        mean = lambda c: F.when(n > 0, latest(c).cast("double") / n).alias(f"avg_{c}")
        return self.log.read().agg(n.alias("total_queries"), *(mean(c) for c in self.columns))
