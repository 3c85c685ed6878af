"""Ranked lists joined, replaced and reordered."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics

#: Answers of a merged list; how many of them the graph may give, at least and at most; the earlier pipeline's share.
SIZE, ALPHAS, OLD_ALPHA = 20, (12, 20), 14
#: Nearest vectors asked for, their cutoff, and the earlier pipeline's cutoff; type searched where the answer's is unknown.
NEAREST, CUTOFF, OLD_CUTOFF, DEFAULT_TYPE = 40, 0.65, 0.6, "disease"


def alpha_merged(graph: DataFrame, near: DataFrame, alphas: tuple[int, int] = ALPHAS, size: int = SIZE) -> DataFrame:
    """(query_id, alpha, node_id, rank): for each alpha the first ``alpha`` graph answers, then so many of the nearest others that there are ``size``.

    ``graph`` (query_id, node_id, rank), ``near`` (query_id, node_id, score). The nearest are taken by score over all
    types; only those among the graph answers used are left out. ``size`` minus the graph answers used is the most
    that is added, also where that is none.
    """
    span = F.explode(F.sequence(F.lit(alphas[0]), F.lit(alphas[1])))
    used = graph.where(F.col("rank") <= alphas[1]).select("query_id", "node_id", "rank", span.alias("alpha")).where(F.col("rank") <= F.col("alpha"))
    counts = used.groupBy("query_id", "alpha").agg(F.count("*").alias("_a"))
    best = near.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node_id"))).where(F.col("_n") <= size + alphas[1])
    others = best.select("query_id", "node_id", "_n", span.alias("alpha")).join(used, ["query_id", "alpha", "node_id"], "left_anti")
    others = others.join(counts, ["query_id", "alpha"], "left").withColumn("_a", F.coalesce("_a", F.lit(0)))
    others = others.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "alpha").orderBy("_n"))).where(F.col("_r") <= size - F.col("_a"))
    return used.select("query_id", "alpha", "node_id", F.col("rank").cast("int")).unionByName(others.select("query_id", "alpha", "node_id", (F.col("_r") + F.col("_a")).cast("int").alias("rank")))


def alpha_recall(merged: DataFrame, truths: DataFrame, size: int = SIZE) -> DataFrame:
    """(query_id, alpha, recall) of the first ``size`` merged answers."""
    total = truths.select("query_id", "node_id").distinct().groupBy("query_id").agg(F.count("*").alias("_t"))
    hits = merged.where(F.col("rank") <= size).join(truths.select("query_id", "node_id").distinct(), ["query_id", "node_id"], "left_semi").groupBy("query_id", "alpha").agg(F.count_distinct("node_id").alias("_h"))
    asked = merged.select("query_id", "alpha").distinct()
    return asked.join(total, "query_id").join(hits, ["query_id", "alpha"], "left").select("query_id", "alpha", (F.coalesce("_h", F.lit(0)) / F.col("_t")).alias("recall"))


def alpha_recall_of_groups(merged: DataFrame, asked: DataFrame, members: DataFrame, size: int = SIZE) -> DataFrame:
    """What ``alpha_recall`` gives where the truths of a question are the members of its group, itself included."""
    totals = metrics.group_totals(asked, members)
    hits = metrics.group_hits(merged.where(F.col("rank") <= size), totals, members).groupBy("query_id", "alpha").agg(F.count_distinct("node_id").alias("_h"))
    found = merged.select("query_id", "alpha").distinct().join(totals, "query_id").join(hits, ["query_id", "alpha"], "left")
    return found.select("query_id", "alpha", (F.coalesce("_h", F.lit(0)) / F.col("total")).alias("recall"))


def fallback(near: DataFrame, size: int = SIZE, distinct: bool = True) -> DataFrame:
    """(query_id, node_id, rank): the best ``size`` of each type, by score over all types, each node once where it is first; cut to ``size``."""
    each = near.withColumn("_t", F.row_number().over(Window.partitionBy("query_id", "node_type").orderBy(F.col("score").desc(), "node_id"))).where(F.col("_t") <= size)
    if distinct:
        each = each.groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node_id"))).where(F.col("rank") <= size).select("query_id", "node_id", "rank")


def answer_types(types: Column, known: Column, default: str = DEFAULT_TYPE) -> Column:
    """The answer's types that are known, else the default."""
    kept = F.filter(types, lambda t: F.array_contains(known, t))
    return F.when(F.size(F.coalesce(kept, F.array().cast("array<string>"))) > 0, kept).otherwise(F.array(F.lit(default)))


def scored(answers: DataFrame, recorded: DataFrame, most: int = SIZE, masked: int | None = None) -> DataFrame:
    """Reordered by a recorded score plus a tenth of the place: score + 0.1 * (n - i) / n, i from 0; an unreadable score is 0.5.

    ``masked``: the total is halved and the first so many places get 0.5 on top. Ties stay in order.
    """
    n = F.count("*").over(Window.partitionBy("query_id"))
    total = F.coalesce(F.expr("try_cast(response AS double)"), F.lit(0.5)) + 0.1 * (n - (F.col("rank") - 1)) / n
    if masked is not None:
        total = total / 2 + F.when(F.col("rank") <= masked, 0.5).otherwise(0.0)
    both = answers.join(recorded, ["query_id", "node_id"], "left").withColumn("score", total)
    return _ranked(both, [F.col("score").desc(), F.col("rank")]).where(F.col("rank") <= most).select("query_id", "node_id", "score", "rank")


def _ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def listed(answers: Column, response: Column) -> Column:
    """An answer list as a response orders it: its numbers once each, invented ones left out, missing ones behind; unreadable: unchanged."""
    parts = F.transform(F.split(response, ","), lambda x: F.trim(x).try_cast("long"))
    asked = F.array_distinct(parts)
    usable = F.coalesce(response.isNotNull() & ~F.exists(parts, lambda x: x.isNull()), F.lit(False))
    return F.when(usable, F.concat(F.array_intersect(asked, answers), F.array_except(answers, asked))).otherwise(answers)


def by_wins(answers: DataFrame, duels: DataFrame) -> DataFrame:
    """Reordered by recorded duels (query_id, a, b, response): the winner's id, or A or B, quoted or not; anything else is a tie; more wins first, then place.

    The same order as sorting by the duels where these are transitive.
    """
    won = F.trim(F.regexp_replace("response", "[\"']", ""))
    named = won.try_cast("long")
    winners = duels.select("query_id", F.when(won == "A", F.col("a")).when(won == "B", F.col("b")).when(named.isin(F.col("a"), F.col("b")), named).alias("node_id")).where("node_id is not null")
    wins = winners.groupBy("query_id", "node_id").agg(F.count("*").alias("wins"))
    both = answers.join(wins, ["query_id", "node_id"], "left").withColumn("wins", F.coalesce("wins", F.lit(0)))
    return _ranked(both, [F.col("wins").desc(), F.col("rank")]).select("query_id", "node_id", "wins", "rank")


def by_duels(answers: DataFrame, duels: DataFrame) -> DataFrame:
    """Reordered by a stable sort that asks the recorded duels (query_id, a, b, response) for each comparison, also where they run in circles.

    A duel recorded the other way round counts turned; one that isn't recorded or can't be read is a tie, which keeps the order.
    A question's list and its duels go to one task; lists are short, for each pair of them is a model's answer.
    """
    won = F.trim(F.regexp_replace("response", "[\"']", ""))
    named = won.try_cast("long")
    sign = F.when((won == "A") | (named == F.col("a")), 1).when((won == "B") | (named == F.col("b")), -1).otherwise(0)
    told = duels.groupBy("query_id").agg(F.collect_list(F.struct("a", "b", sign.cast("long").alias("s"))).alias("told"))
    lists = answers.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"]).alias("list"))
    whole = lists.join(told, "query_id", "left")

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, nodes, told in zip(batch["query_id"], batch["list"], batch["told"], strict=True):
                said = {}
                for t in told if told is not None else ():
                    said.setdefault((t["b"], t["a"]), -t["s"])
                said |= {(t["a"], t["b"]): t["s"] for t in (told if told is not None else ())}
                better = sorted(nodes, key=cmp_to_key(lambda x, y, said=said: said.get((x, y), 0)), reverse=True)
                out += [(id_, node, place) for place, node in enumerate(better, 1)]
            yield pd.DataFrame(out, columns=["query_id", "node_id", "rank"])

    return whole.mapInPandas(order, "query_id long, node_id long, rank int")


#: Ways to rerank, by the number that a run's settings give; fixed values.
METHODS = {0: "score", 1: "list", 2: "pairwise", 3: "neural"}


def reranked(questions: DataFrame, method: int, recorded: DataFrame, most: int = SIZE) -> DataFrame:
    """``questions`` (query_id, answers, ...) with ``reranked``: the first ``most`` answers as ``METHODS[method]`` orders what is recorded for it.

    ``recorded`` is what ``scored``, ``listed`` (query_id, response), ``by_duels`` or ``by_position`` reads. A column ``with_relations`` marks
    responses to documents with their relations: a question that has none of these takes those without. A question without
    answers gets an empty list; its other columns, such as its row's place, stay. An unknown method is an error.
    """
    if method not in METHODS:
        raise ValueError(f"unknown reranking method: {method}")
    if "with_relations" in recorded.columns:
        fullest = F.max("with_relations").over(Window.partitionBy("query_id"))
        recorded = recorded.withColumn("_best", fullest).where(F.col("with_relations") == F.col("_best")).drop("_best", "with_relations")
    short = F.slice(F.coalesce("answers", F.array().cast("array<bigint>")), 1, most)
    if method == 1:
        said = recorded.select("query_id", F.col("response").alias("_said"))
        return questions.join(said, "query_id", "left").withColumn("reranked", listed(short, F.col("_said"))).drop("_said")
    each = questions.select("query_id", F.posexplode(short).alias("rank", "node_id")).withColumn("rank", F.col("rank") + 1)
    new = {0: lambda: scored(each, recorded, most), 2: lambda: by_duels(each, recorded), 3: lambda: by_position(each, recorded)}[method]()
    lists = new.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"]).alias("reranked"))
    return questions.join(lists, "query_id", "left").withColumn("reranked", F.coalesce("reranked", F.array().cast("array<bigint>")))


def by_position(answers: DataFrame, returned: DataFrame) -> DataFrame:
    """Reordered as a reranker's returned positions (query_id, index from 0, position) say; a question without any keeps its order."""
    placed = answers.join(returned.select("query_id", (F.col("index") + 1).alias("rank"), "position"), ["query_id", "rank"], "left")
    some = F.max("position").over(Window.partitionBy("query_id")).isNotNull()
    kept = placed.withColumn("_some", some).where(~F.col("_some") | F.col("position").isNotNull())
    return _ranked(kept, [F.col("position").asc_nulls_last(), F.col("rank")]).select("query_id", "node_id", "rank")


def only_valid(answers: Column, valid: Column) -> tuple[Column, Column]:
    """The answers that are valid, in order and with repeats, and how many are not."""
    kept = F.filter(answers, lambda a: F.array_contains(valid, a))
    return kept, F.size(answers) - F.size(kept)
