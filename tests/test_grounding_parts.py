"""How a question's part of the graph is gathered and scored: each step once, and what isn't scored counts as in the lists."""

import random

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import grounding as g
from lodegraph.operators import vectors as v


def test_each_step_is_joined_once(spark):
    """Three steps are three joins with the edges; known sources are left out, and ends are marked."""
    edges = spark.createDataFrame([(1, "p", 2), (2, "p", 3), (3, "p", 4), (4, "p", 5), (1, "q", 9)], "src long, relation string, dst long")
    relations = spark.createDataFrame([(7, "A", "B", "p", 0)], "query_id long, src_sym string, dst_sym string, relation string, ord int")
    starts = spark.createDataFrame([(7, 1)], "query_id long, node_id long")
    found = g.reachable(starts, relations, edges, 3)
    assert sorted((r.src, r.dst) for r in found.collect()) == [(1, 2), (2, 3), (3, 4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 6  # each step with the names and the edges
    more = g.reachable(spark.createDataFrame([(7, 3)], starts.schema), relations, edges, 3, found.select("query_id", "src").distinct())
    assert sorted((r.src, r.dst or 0) for r in more.collect()) == [(4, 5), (5, 0)]


@pytest.mark.parametrize("policy", [g.MAIN, g.ALTERNATIVE])
def test_a_null_similarity_is_none(spark, policy):
    """A neighbour whose similarity is null counts as one that isn't scored, in the fold over edges as in that over lists."""
    make = spark.createDataFrame
    given = (
        make([(1, "A", 0, ["x"]), (1, "ANSWER", 1, ["x"])], "query_id long, symbol string, ord int, types array<string>"),
        make([(1, "A", "ANSWER", "p", 0)], "query_id long, src_sym string, dst_sym string, relation string, ord int"),
        make([(1, "A", 1, 0.8, 0)], "query_id long, symbol string, node_id long, score double, ord int"),
        make([(a, "p", b) for x in (2, 3) for a, b in ((1, x), (x, 1))], "src long, relation string, dst long"),
        make([(n, "x") for n in (1, 2, 3)], "node_id long, node_type string"),
        make([(1, s, n, x) for s in ("A", "ANSWER") for n, x in ((1, 0.7), (2, 0.9), (3, None))], "query_id long, symbol string, node_id long, score double"),
    )
    rows = lambda df: {(r.symbol, r.node_id): (round(r.score, 9), r.support) for r in df.collect()}
    got = rows(g.ground(*given, policy))
    assert got == rows(g.by_lists(*given, policy)) and (("ANSWER", 3) in got) == (policy is g.ALTERNATIVE)


def test_few_pairs_are_multiplied_alone(spark, monkeypatch):
    """A thin mask is multiplied pair by pair, a full one all with all, with the same scores."""
    r = random.Random(3)
    rows = [(i, "t", [r.uniform(-1, 1) for _ in range(8)]) for i in range(120)]
    nodes = spark.createDataFrame(rows, "node_id long, node_type string, embedding array<float>").repartition(3)
    asked = nodes.where("node_id < 60").select(F.col("node_id").alias("query_id"), "node_type", "embedding")
    mask = spark.createDataFrame([(i % 60, i) for i in range(100)] + [(5, 999), (999, 5), (3, 3)], "query_id long, node_id long")
    read = lambda df: sorted((x.query_id, x.node_id, x.score) for x in df.collect())
    want = read(v.pair_scores(mask.distinct(), asked, nodes).where("score is not null"))
    assert len(want) == 100 and read(v.masked(asked, nodes, mask)) == want
    monkeypatch.setattr(v, "SPARSE", 1000)
    assert read(v.masked(asked, nodes, mask)) == want
