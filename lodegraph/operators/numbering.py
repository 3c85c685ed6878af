"""Dense numbers in an order, without one task that sees all rows of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def positions(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... within each group of ``by`` in the order given; rows that tie are numbered in any order.

    The rows are dealt by ranges and sorted there, so a large group goes to many tasks. A group's rows in a task are numbered from the group's
    first there, plus how many rows the tasks before it hold: the only window runs over one row for each task and group.
    """
    columns = rows.columns
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    # the numbers hold for the tasks as they were dealt once, so they are written
    held = written(dealt.withColumn("_task", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    counts = held.groupBy(*by, "_task").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    keys = (*by, "_task")
    start = (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start")
    starts = counts.select(*(F.col(k).alias(f"_of_{k}") for k in keys), start)
    met = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return held.join(starts, met).select(*columns, (F.col("_row") + F.col("_start")).alias(name))
