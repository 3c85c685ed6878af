"""Judging ranked answers against true ones, and summing the judgements up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The answers that recall_20 looks at.
CUT = 20


def per_query(predictions: DataFrame, truths: DataFrame, queries: DataFrame | None = None, cut: int | None = CUT, hits: Sequence[int] = (1, 5)) -> DataFrame:
    """One row per question: hit_k for each k, mrr, recall_20, recall_all, and the counts of truths found and missed.

    ``predictions`` (query_id, rank, node_id), ``truths`` (query_id, node_id). The first hit counts wherever it stands;
    recall_20 looks at ranks up to ``cut`` (null: all), recall_all at the whole list. Questions are those with truths,
    and those of ``queries`` (query_id) if given; one without truths, or without answers, has zeros throughout.
    Truths are matched by hash join on the question and node, so both sides are shuffled once, by that key.
    """
    true = truths.select("query_id", "node_id").distinct()
    best = predictions.groupBy("query_id", "node_id").agg(F.min("rank").alias("rank"))
    each = true.join(best, ["query_id", "node_id"], "left")
    seen = F.col("rank").isNotNull() if cut is None else F.col("rank") <= cut
    found = each.groupBy("query_id").agg(
        *(F.coalesce(F.max((F.col("rank") <= k).cast("double")), F.lit(0.0)).alias(f"hit_{k}") for k in hits),
        F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("mrr"),
        (F.count_if(seen) / F.count("*")).alias("recall_20"),
        (F.count("rank") / F.count("*")).alias("recall_all"),
        F.count("*").alias("total_answers"),
        F.count("rank").alias("retrieved_count"),
        (F.count("*") - F.count("rank")).alias("missed_count"),
    )
    if queries is not None:
        found = queries.select("query_id").distinct().join(found, "query_id", "left")
        found = found.na.fill(0.0, [c for c, t in found.dtypes if t == "double"]).na.fill(0, [c for c, t in found.dtypes if t == "bigint" and c != "query_id"])
    return found


def group_totals(asked: DataFrame, members: DataFrame, itself: bool = True) -> DataFrame:
    """(query_id, node_type, total) of questions whose truths are the members of their group: so many there are, at least one.

    ``asked`` (query_id, node_type), ``members`` (node_id, node_type); an id stands in one group. Without ``itself`` a question isn't its own truth.
    """
    sizes = members.distinct().groupBy("node_type").agg(F.count("*").alias("total"))
    found = asked.select("query_id", "node_type").distinct().join(sizes, "node_type")
    if not itself:
        own = members.select(F.col("node_id").alias("query_id"), "node_type").distinct().withColumn("_own", F.lit(1))
        found = found.join(own, ["query_id", "node_type"], "left").withColumn("total", F.col("total") - F.coalesce("_own", F.lit(0)))
    return found.select("query_id", "node_type", "total").where("total > 0")


def group_hits(answers: DataFrame, totals: DataFrame, members: DataFrame, itself: bool = True) -> DataFrame:
    """The ``answers`` (query_id, node_id, ...) that are members of their question's group, so the pairs of questions and truths are never made."""
    hits = answers.join(members.distinct(), "node_id").join(totals.select("query_id", "node_type"), ["query_id", "node_type"], "left_semi")
    return hits.drop("node_type") if itself else hits.where("query_id <> node_id").drop("node_type")


def per_query_of_groups(predictions: DataFrame, asked: DataFrame, members: DataFrame, itself: bool = True, cut: int = CUT, hits: Sequence[int] = (1, 5)) -> DataFrame:
    """What ``per_query`` gives where the truths of a question are the members of its group."""
    totals = group_totals(asked, members, itself)
    best = predictions.groupBy("query_id", "node_id").agg(F.min("rank").alias("rank"))
    met = group_hits(best, totals, members, itself).groupBy("query_id").agg(
        *(F.max((F.col("rank") <= k).cast("double")).alias(f"hit_{k}") for k in hits),
        (1.0 / F.min("rank")).alias("mrr"), F.count_if(F.col("rank") <= cut).alias("_seen"), F.count("*").alias("retrieved_count"),
    )
    each = totals.join(met, "query_id", "left").na.fill(0.0, [*(f"hit_{k}" for k in hits), "mrr"]).na.fill(0, ["_seen", "retrieved_count"])
    share = lambda c: F.col(c) / F.col("total")
    return each.select(
        "query_id", *(f"hit_{k}" for k in hits), "mrr", share("_seen").alias("recall_20"), share("retrieved_count").alias("recall_all"),
        F.col("total").alias("total_answers"), "retrieved_count", (F.col("total") - F.col("retrieved_count")).alias("missed_count"),
    )


def macro(rows: DataFrame, columns: Sequence[str], nulls: str = "zero") -> DataFrame:
    """Count of rows and mean of every column; a null counts as 0 (``zero``) or not at all (``skip``). Absent columns are left out."""
    there = [c for c in columns if c in rows.columns]
    value = {"zero": lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)), "skip": lambda c: F.col(c).try_cast("double")}[nulls]
    return rows.agg(F.count("*").alias("total_queries"), *(F.avg(value(c)).alias(f"avg_{c}") for c in there))


#: The report's buckets, fixed values: label, lower bound (in), upper bound (not in).
BUCKETS = (("0 (miss)", 0.0, 0.01), ("0–0.25", 0.01, 0.25), ("0.25–0.5", 0.25, 0.5), ("0.5–0.75", 0.5, 0.75), ("0.75–1.0", 0.75, 0.99), ("1.0 (full)", 0.99, 1.001))
BAR = 40


def histogram(rows: DataFrame, value: str | Column) -> DataFrame:
    """(bucket, n, bar) for every bucket, those without rows too; a null counts as 0; bars are in proportion to all rows, out-of-range ones included."""
    value = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0.0))
    label = F.coalesce(*(F.when((value >= a) & (value < z), F.lit(name)) for name, a, z in BUCKETS))
    counted = rows.select(label.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    whole = counted.agg(F.sum("n").alias("_all"))
    names = rows.sparkSession.createDataFrame([(b[0],) for b in BUCKETS], "bucket string")
    found = names.join(counted, "bucket", "left").join(F.broadcast(whole), F.lit(True), "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))  # one row
    return found.select("bucket", "n", F.repeat(F.lit("█"), F.coalesce(F.floor(F.col("n") / F.col("_all") * BAR), F.lit(0)).cast("int")).alias("bar"))


def deltas(rows: DataFrame, before: str, after: str) -> DataFrame:
    """How many rows improved, fell and stayed, with the mean gain and the mean loss; nulls count as 0."""
    d = F.coalesce(F.col(after), F.lit(0.0)) - F.coalesce(F.col(before), F.lit(0.0))
    return rows.select(d.alias("d")).agg(
        F.count_if(F.col("d") > 0).alias("improved"), F.count_if(F.col("d") < 0).alias("hurt"), F.count_if(F.col("d") == 0).alias("same"),
        F.avg(F.when(F.col("d") > 0, F.col("d"))).alias("mean_gain"), F.avg(F.when(F.col("d") < 0, F.col("d"))).alias("mean_loss"), F.avg("d").alias("mean_delta"),
    )


def worst(rows: DataFrame, before: str, after: str, n: int = 5, width: int = 60) -> DataFrame:
    """The ``n`` rows (query_id, query) that lost most, with texts cut to ``width``; ties go to the smaller id."""
    scored = rows.select("query_id", F.substring("query", 1, width).alias("query"), (F.col(after) - F.col(before)).alias("delta"))
    return scored.where("delta is not null").orderBy(F.col("delta").asc(), F.col("query_id").asc()).limit(n)


def shares(rows: DataFrame, by: str) -> DataFrame:
    """(value, n, share) of a column's values, nulls left out."""
    counted = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))
    whole = counted.agg(F.sum("n").alias("_all"))
    return counted.join(F.broadcast(whole), F.lit(True)).select(F.col(by).alias("value"), "n", (F.col("n") / F.col("_all")).alias("share"))  # one row


def group_shares(rows: DataFrame, group: str, by: str, values: Sequence[str]) -> DataFrame:
    """A row for each group, and for each of ``values`` its share of the group's rows; 0 where there is none."""
    counted = rows.groupBy(group).agg(F.count("*").alias("_all"), *(F.count_if(F.col(by) == v).alias(v) for v in values))
    return counted.select(group, *((F.col(v) / F.col("_all")).alias(v) for v in values))


def set_difference(predicted: str, true: str) -> tuple[Column, Column]:
    """The truths that were found, and those that were missed."""
    return F.array_intersect(predicted, true), F.array_except(true, predicted)
