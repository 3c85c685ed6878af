"""The whole way from recorded model outputs to judged answers, as one plan over all questions at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import candidates, grounding, merging, metrics, runs
from ..operators import vectors as v
from ..operators.grounding import cut


@dataclass(frozen=True)
class Settings:
    """Stages can be left out, as ablations do; the other values are the main pipeline's."""

    verify_relations: bool = True
    verify_anchor: bool = True
    cutoff: float = candidates.CUTOFF
    limit: int = candidates.LIMIT
    alpha: int = 12
    attempts: int = 3
    hops: int = 3
    policy: grounding.Policy = grounding.MAIN


@dataclass
class Graph:
    """nodes (node_id, node_type, name), edges (symmetric), node_emb (node_id, node_type, embedding), text_emb (text, embedding)."""

    nodes: DataFrame
    edges: DataFrame
    node_emb: DataFrame
    text_emb: DataFrame


def symbols_of(responses: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, symbol, ord, type, name, information, constant): the symbols of each question's first readable entity response."""
    asked = responses.where("stage = 'entities'").withColumn("e", parsing.entities(F.col("response")))
    first = runs.first_usable(asked, ["query_id"], F.col("e").isNotNull() & (F.size("e") > 0), settings.attempts)
    each = first.where("status = 'OK'").select("query_id", F.posexplode(parsing.entities(F.col("response"))).alias("ord", "symbol", "e"))
    return each.select("query_id", "symbol", "ord", F.col("e.type").alias("type"), F.col("e.name").alias("name"), F.col("e.information").alias("information"), F.coalesce("e.constant", F.lit(False)).alias("constant"))


def relations_of(responses: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, src_sym, dst_sym, relation, ord): the relations of the first readable response, in their order; only known ones unless left unverified."""
    asked = responses.where("stage = 'relations'").withColumn("r", parsing.relations(F.col("response")))
    first = asked.where((F.col("attempt") <= settings.attempts) & F.col("r").isNotNull()).groupBy("query_id").agg(F.min_by("r", "attempt").alias("r"))
    each = first.select("query_id", F.inline("r")).select("query_id", F.col("a").alias("src_sym"), F.col("b").alias("dst_sym"), "relation", "ord")
    return each.where(parsing.in_vocabulary(F.col("relation"))) if settings.verify_relations else each


def answer(responses: DataFrame, graph: Graph, settings: Settings = Settings()) -> DataFrame:
    """(query_id, node_id, rank, status): merged answers; FALLBACK where the graph gave none, by vectors alone.

    What several stages read (symbols, relations, vector hits, candidates, reached edges, grounded answers) is written first.
    """
    symbols, relations = cut(symbols_of(responses, settings)), cut(relations_of(responses, settings))
    texts = symbols.select("query_id", "symbol", F.concat_ws(" ", "name", "information").alias("text"))
    asked = texts.join(graph.text_emb, "text").join(symbols.select("query_id", "symbol", F.col("type").alias("node_type")), ["query_id", "symbol"])
    # a symbol of a question is one searched vector, so both are one key for the search
    keyed = cut(asked.select("query_id", "symbol", F.xxhash64("query_id", "symbol").alias("_key"), "node_type", "embedding"))
    near = v.top_k(keyed.select(F.col("_key").alias("query_id"), "node_type", "embedding"), graph.node_emb, merging.NEAREST, settings.cutoff)
    near = cut(near.withColumnRenamed("query_id", "_key").join(keyed.select("_key", "query_id", "symbol"), "_key"))

    others = symbols.where("symbol <> 'ANSWER'")
    key = lambda df: df.select(F.xxhash64("query_id", "symbol").alias("query_id"), "node_id", *[c for c in df.columns if c == "score"])
    exact = candidates.exact_names(others.withColumnRenamed("type", "node_type"), graph.nodes)
    found = candidates.initial(key(exact), key(near.where("symbol <> 'ANSWER'")), settings.limit, settings.cutoff)
    names = others.select(F.xxhash64("query_id", "symbol").alias("_key"), "query_id", "symbol")
    cands = found.withColumnRenamed("query_id", "_key").join(names, "_key").select("query_id", "symbol", "node_id", "score", "ord")
    if settings.verify_anchor:
        gate = candidates.needs_anchor(symbols, cands).select("query_id", "symbol")
        recorded = responses.where("stage = 'anchor'").select("query_id", F.col("symbol"), candidates.choice_of(F.col("response"), F.lit(candidates.SHOWN)).alias("choice"))
        cands = candidates.promoted(cands, recorded.join(gate, ["query_id", "symbol"], "left_semi"), ["query_id", "symbol"])

    cands = cut(cands)

    def similar(pairs: DataFrame) -> DataFrame:
        both = pairs.join(keyed.select("query_id", "symbol", F.col("embedding").alias("_q")), "query_id").join(graph.node_emb.select("node_id", "embedding"), "node_id")
        return both.select("query_id", "symbol", "node_id", v.dot("_q", "embedding").alias("score"))

    typed = symbols.select("query_id", "symbol", "ord", F.array("type").alias("types"))
    grounded = grounding.ground(typed, relations, cands, graph.edges, graph.nodes, similar, settings.policy, settings.hops)
    ranked = cut(grounding.answers(grounded).select("query_id", "node_id", "rank"))

    near_answers = near.where("symbol = 'ANSWER'").select("query_id", "node_id", "node_type", "score")
    merged = merging.alpha_merged(ranked, near_answers, (settings.alpha, settings.alpha)).drop("alpha")
    answered = ranked.select("query_id").distinct()
    graph_rows = merged.join(answered, "query_id", "left_semi").withColumn("status", F.lit("SUCCESS"))
    rest = merging.fallback(near_answers.join(answered, "query_id", "left_anti")).withColumn("status", F.lit("FALLBACK"))
    return graph_rows.unionByName(rest)


def judged(answers: DataFrame, truths: DataFrame) -> DataFrame:
    """One row per question of ``truths``, answered or not."""
    return metrics.per_query(answers, truths, truths)
