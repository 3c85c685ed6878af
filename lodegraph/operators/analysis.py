"""Questions tagged with templates, their structure, and why they failed."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t


def with_template(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """``rows`` left-joined to the templates (Id, ...) on template_id."""
    return rows.join(templates, rows["template_id"] == templates["Id"], "left")


def filled(rows: DataFrame, answers: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` taken from ``answers`` where these have the key."""
    new = answers.select(key, F.col(column).alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def structure(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """(query_id, n_types, types, n_relations, relations): distinct first types of a question's symbols, and distinct relations."""
    types = symbols.groupBy("query_id").agg(F.array_sort(F.collect_set("type")).alias("types"))
    rels = relations.groupBy("query_id").agg(F.array_sort(F.collect_set("relation")).alias("relations"))
    both = types.join(rels, "query_id", "full")
    blank = F.array().cast("array<string>")
    both = both.withColumn("types", F.coalesce("types", blank)).withColumn("relations", F.coalesce("relations", blank))
    return both.select("query_id", F.size("types").alias("n_types"), "types", F.size("relations").alias("n_relations"), "relations")


def first_relations(relations: DataFrame) -> DataFrame:
    """Of a question's relations (query_id, a, b, relation, ord) the first between two symbols, whichever way it points."""
    w = Window.partitionBy("query_id", F.least("a", "b"), F.greatest("a", "b")).orderBy("ord")
    return relations.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("symbol", T.StringType()), T.StructField("hops", T.IntegerType()), T.StructField("path", T.StringType())])))
def _ways(edges: pd.Series, roots: pd.Series, hops: pd.Series) -> pd.Series:
    """Breadth-first ways over one question's edges, each layer in the order in which its ways were found."""

    def one(edges, root: str, most: int | None) -> list[dict]:
        around = defaultdict(list)
        for e in sorted(edges, key=lambda e: e["ord"]):
            around[e["a"]].append((e["b"], e["relation"]))
            around[e["b"]].append((e["a"], e["relation"]))
        found, layer = ({root: (0, root)} if root in around else {}), [root]
        for h in count(1):
            if not layer or (most is not None and h > most):
                break
            reached = []
            for s in layer:
                for other, relation in around[s]:
                    if other not in found:
                        found[other] = h, f"{found[s][1]} -[{relation}]-> {other}"
                        reached.append(other)
            layer = reached
        return [{"symbol": s, "hops": h, "path": p} for s, (h, p) in found.items()]

    return pd.Series([one(*x) for x in zip(edges, roots, (None if pd.isna(h) else int(h) for h in hops), strict=True)])


def shortest_paths(relations: DataFrame, root: str = "ANSWER", hops: int | None = None) -> DataFrame:
    """(query_id, symbol, hops, path): the shortest way from the root to every symbol that it reaches, in at most ``hops`` steps if given.

    Relations count both ways, and only the first between two symbols. Of equally short ways the one that earlier
    relations lead along is taken. A question's relations, as many as a model's answer names, meet in one row, so one
    shuffle does; a question without the root has no rows.
    """
    kept = first_relations(relations).groupBy("query_id").agg(F.collect_list(F.struct("a", "b", "relation", "ord")).alias("edges"))
    return kept.select("query_id", F.inline(_ways("edges", F.lit(root), F.lit(hops).cast("int"))))


def failure_causes(rows: DataFrame, mode: str = "strict") -> DataFrame:
    """``rows`` (recall, gt_entities, gt_relations, entities, relations) with both match ratios and the cause.

    Names are comma lists. ``strict`` compares them as they are; ``normalised`` writes spaces as underscores first.
    """
    same = (lambda c: c) if mode == "strict" else t.underscored
    entity = t.match_ratio(same(t.split_names(F.col("gt_entities"))), same(t.split_names(F.col("entities"))))
    relation = t.match_ratio(same(t.split_names(F.col("gt_relations"))), same(t.split_names(F.col("relations"))))
    judged = rows.withColumn("entity_match", entity).withColumn("relation_match", relation)
    return judged.withColumn("cause", t.failure_cause(F.col("recall"), F.col("entity_match"), F.col("relation_match")))


def path_counts(paths: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most frequent paths; ties by the path's text."""
    return paths.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "path").limit(n)
