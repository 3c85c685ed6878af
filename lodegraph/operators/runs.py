"""Rows of earlier runs: joined, freed of repeats, resumed and selected."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedup(rows: DataFrame, key: Sequence[str], seq: str, keep: str = "last") -> DataFrame:
    """One row per key: the one of greatest (``last``) or least (``first``) sequence. An aggregate, so a key's rows never meet in one task unsummed."""
    whole = F.struct(*rows.columns)
    chosen = F.max_by(whole, seq) if keep == "last" else F.min_by(whole, seq)
    return rows.groupBy(*key).agg(chosen.alias("_r")).select("_r.*")


def resume(queries: DataFrame, done: DataFrame, key: str = "query_id") -> DataFrame:
    """Questions that no finished row has."""
    return queries.join(done.select(key).distinct(), key, "left_anti")


def select(rows: DataFrame, mode: str, key: str = "query_id", status: str = "status", ids: Sequence[int] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows to run again, rows to keep) of an earlier run.

    ``ids``: the named ones run; ``retry``: failed and fallback ones; ``skipped``: skipped ones; ``resume``: none.
    """
    again: Column = {
        "ids": F.col(key).isin(list(ids)), "retry": F.col(status).isin("FAILED", "FALLBACK"), "skipped": F.col(status) == "SKIPPED", "resume": F.lit(False),
    }[mode]
    again = F.coalesce(again, F.lit(False))
    return rows.where(again), rows.where(~again)


def head_share(rows: DataFrame, order: str, percent: int = 10, limit: int | None = None) -> DataFrame:
    """The first ``percent`` of the rows by ``order``, rounded down, and of these at most ``limit``: a range filter that a scan can use, no sort.

    ``order`` numbers the split's rows from 0 without gaps.
    """
    n = rows.count() * percent // 100
    return rows.where(F.col(order) < (n if limit is None else min(n, limit)))


def batches(rows: DataFrame, order: str, workers: int) -> DataFrame:
    """``rows`` with ``batch``: runs of ceil(n / workers) rows in their order. The order is dense from 0."""
    n = rows.agg(F.count("*").alias("_n"))
    size = F.ceil(F.col("_n") / workers)
    return rows.join(F.broadcast(n), F.lit(True)).withColumn("batch", F.floor(F.col(order) / size).cast("int")).drop("_n")  # one row


def first_usable(attempts: DataFrame, key: Sequence[str], usable: Column, limit: int = 3) -> DataFrame:
    """Each key's first usable attempt of the first ``limit``; without one the status is SKIPPED."""
    tried = attempts.where(F.col("attempt") <= limit)
    found = tried.groupBy(*key).agg(F.min_by(F.when(usable, F.col("response")), F.when(usable, F.col("attempt"))).alias("response"), F.min(F.when(usable, F.col("attempt"))).alias("attempt"), F.count("*").alias("tried"))
    return found.withColumn("status", F.when(F.col("attempt").isNull(), F.lit("SKIPPED")).otherwise(F.lit("OK")))


def within_rate(calls: DataFrame, key: str, at: str, limit: int, seconds: int = 62) -> DataFrame:
    """``calls`` with how many calls of the key lie within the last ``seconds``, and whether the rate is kept."""
    w = Window.partitionBy(key).orderBy(F.col(at).cast("long")).rangeBetween(-seconds, 0)
    return calls.withColumn("in_window", F.count("*").over(w)).withColumn("allowed", F.col("in_window") <= limit)
