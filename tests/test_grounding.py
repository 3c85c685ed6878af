"""Grounding against the simulator, on random graphs, and by hand."""

import random
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import grounding as g

from .simulate import ground as simulated


def random_case(seed):
    r = random.Random(seed)
    nodes = list(range(12))
    kinds = {n: r.choice("xyz") for n in nodes}
    edges = defaultdict(set)
    for _ in range(25):
        a, b, rel = r.choice(nodes), r.choice(nodes), r.choice(("p", "q"))
        edges[a, rel].add(b)
        edges[b, rel].add(a)
    symbols = ["A", "B", "ANSWER", "C"][: r.choice((3, 4))]
    types = {s: set(r.sample("xyz", r.choice((0, 1, 2, 3)))) for s in symbols}
    relations = [(r.choice([*symbols, "D"]), r.choice(symbols), r.choice(("p", "q"))) for _ in range(4)]
    starts = [(s, n, round(r.uniform(-0.2, 1), 3)) for s in symbols if s != "ANSWER" for n in r.sample(nodes, r.choice((1, 3)))]
    similar = {s: {n: round(r.uniform(-0.3, 1), 3) for n in nodes} for s in symbols if r.random() < 0.8}
    return symbols, types, relations, starts, edges, kinds, similar


@pytest.mark.parametrize("alternative", [False, True])
@pytest.mark.parametrize("boost", [0.0, 0.25])
def test_against_simulator(alternative, boost):
    base = g.ALTERNATIVE if alternative else g.MAIN
    for seed in range(150):
        policy = replace(base, neighbors=2, boost=boost, answers=3 if seed % 2 else 20, per_symbol=4 if seed % 3 else 1000)
        symbols, types, relations, starts, edges, kinds, similar = random_case(seed)
        flat = {(s, n): x for s, of in similar.items() for n, x in of.items()} | {(s, None): 0.0 for s in similar}
        run = g.Run(symbols, types, relations, edges, kinds, flat, policy)
        for s in starts:
            run.start(*s)
        got = {s: {n: (c.score, c.support) for n, c in mine.items()} for s, mine in run.all().items()}
        want = simulated(symbols, types, relations, starts, edges, kinds, similar, neighbors=2, decay=policy.decay, boost=boost, answers=policy.answers, per_symbol=policy.per_symbol, alternative=alternative)
        got, want = ({s: m for s, m in x.items() if m} for x in (got, want))
        assert {s: list(m) for s, m in got.items()} == {s: list(m) for s, m in want.items()}, seed
        for s in want:
            for n in want[s]:
                assert got[s][n] == pytest.approx(want[s][n]), seed


def test_distributed_is_the_same(spark):
    rows = defaultdict(list)
    wants = {}
    for seed in range(6):
        symbols, types, relations, starts, edges, kinds, similar = random_case(seed)
        offset = 100 * seed
        rows["symbols"] += [(seed, s, i, sorted(types[s])) for i, s in enumerate(symbols)]
        rows["relations"] += [(seed, a, b, r, i) for i, (a, b, r) in enumerate(relations)]
        rows["cands"] += [(seed, s, n + offset, x, i) for i, (s, n, x) in enumerate(starts)]
        rows["edges"] += [(a + offset, r, b + offset) for (a, r), to in edges.items() for b in to]
        rows["nodes"] += [(n + offset, k) for n, k in kinds.items()]
        rows["similar"] += [(seed, s, n + offset, x) for s, of in similar.items() for n, x in of.items()]
        wants[seed] = simulated(symbols, types, relations, starts, edges, kinds, similar, neighbors=15, decay=0.9, boost=0.25, answers=20, per_symbol=1000, alternative=False)
    schemas = {
        "symbols": "query_id long, symbol string, ord int, types array<string>", "relations": "query_id long, src_sym string, dst_sym string, relation string, ord int",
        "cands": "query_id long, symbol string, node_id long, score double, ord int", "edges": "src long, relation string, dst long", "nodes": "node_id long, node_type string",
        "similar": "query_id long, symbol string, node_id long, score double",
    }
    d = {k: spark.createDataFrame(rows[k], s) for k, s in schemas.items()}
    out = g.ground(d["symbols"], d["relations"], d["cands"], d["edges"], d["nodes"], d["similar"], hops=8).collect()
    got = {(r.query_id, r.symbol, r.node_id - 100 * r.query_id): (r.score, r.support) for r in out}
    want = {(q, s, n): v for q, of in wants.items() for s, m in of.items() for n, v in m.items()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_worked_numbers(spark):
    row = spark.range(1).select(
        g.propagated(F.lit(0.8), F.lit(1.0)).alias("a"), g.propagated(F.lit(-0.2), F.lit(1.0)).alias("b"), g.propagated(F.lit(0.0), F.lit(0.0)).alias("c"),
        g.strengthened(F.lit(0.847059), F.lit(1.0), F.lit(2)).alias("d"), g.strengthened(F.lit(1.274653), F.lit(0.5), F.lit(3)).alias("e"),
    ).first()
    assert [round(x, 6) for x in row] == [0.847059, 0.81, 0.1, 1.274653, 1.716414]


def test_answers_tie_by_arrival(spark):
    df = spark.createDataFrame([(1, "ANSWER", 7, 0.5, 2, 0), (1, "ANSWER", 3, 0.5, 2, 1), (1, "ANSWER", 9, 0.9, 1, 2), (1, "A", 9, 2.0, 9, 0)], "query_id long, symbol string, node_id long, score double, support int, seq int")
    order = lambda how: [r.node_id for r in g.answers(df, how).orderBy("rank").collect()]
    assert order("main") == [7, 3, 9] and order("old") == [9, 7, 3]


@pytest.mark.parametrize("alternative", [False, True])
def test_registered_query_is_unbounded(spark, alternative):
    """gr_ground and gr2_ground on the vectors' graph, at their registered setting, against the simulator on the whole graph."""
    from lodegraph.operators import vectors as v
    from lodegraph.queries import grounding as q
    from lodegraph.sources import graph

    sf, policy = "/root/testdata/sf0.001", g.ALTERNATIVE if alternative else g.MAIN
    asked, n = graph.query_emb(spark, sf), graph.node_emb(spark, sf)
    edges, kinds, starts, near = defaultdict(set), {r.node_id: r.node_type for r in n.collect()}, defaultdict(list), defaultdict(dict)
    for r in graph.vector_edges(spark, sf).collect():
        edges[r.src, r.relation].add(r.dst)
    for r in q.state(spark, sf).orderBy("seq").collect():
        starts[r.query_id].append(("A", r.node_id, r.score))
    for r in v.pair_scores(asked.select("query_id").crossJoin(n.select("node_id")), asked, n).where("score is not null").collect():
        near[r.query_id][r.node_id] = r.score
    symbols, relations = ["A", "B", "ANSWER"], [("A", "B", "r0"), ("B", "ANSWER", "r1"), ("A", "ANSWER", "r1")]
    types, rule = {s: {f"t{i}" for i in range(10)} for s in symbols}, {k: getattr(policy, k) for k in ("neighbors", "decay", "boost", "answers", "per_symbol")}
    want = {}
    for i, mine in starts.items():
        held = simulated(symbols, types, relations, mine, edges, kinds, {s: near[i] for s in symbols}, **rule, alternative=alternative)
        want |= {(i, s, m): x for s, of in held.items() for m, x in of.items()}
    got = {(r.query_id, r.symbol, r.node_id): (r.score, r.support) for r in (q.gr2_ground if alternative else q.gr_ground)(spark, sf).collect()}
    assert got.keys() == want.keys()
    for k, (score, support) in want.items():
        assert got[k] == (pytest.approx(score, abs=1e-6, rel=1e-6), support), k


@pytest.mark.parametrize("policy", [g.MAIN, replace(g.ALTERNATIVE, answers=30)])
def test_hubs_are_cut_before_they_meet_a_question(spark, policy):
    """A hub of 3000 neighbours: as simulated, and no list is longer than the policy has it."""
    r = random.Random(21)
    kinds, edges = {0: "x"}, defaultdict(set)
    for n in range(1, 3001):
        kinds[n] = r.choice("xy")
        for a, b in ((0, n), (n, r.randrange(1, 3001))):
            edges[a, "p"].add(b)
            edges[b, "p"].add(a)
    symbols, types = ["A", "B", "ANSWER"], {"A": {"x"}, "B": {"x", "y"}, "ANSWER": {"y"}}
    relations, starts = [("A", "B", "p"), ("B", "ANSWER", "p")], [("A", 0, 1.0), ("A", 5, 0.9)]
    near = {s: {n: round(r.uniform(-0.2, 1), 4) for n in kinds if n % 7} for s in symbols}
    rule = {k: getattr(policy, k) for k in ("neighbors", "decay", "boost", "answers", "per_symbol")}
    want = simulated(symbols, types, relations, starts, edges, kinds, near, **rule, alternative=policy.choose_by == "score")
    make = spark.createDataFrame
    given = (
        make([(1, s, i, sorted(types[s])) for i, s in enumerate(symbols)], "query_id long, symbol string, ord int, types array<string>"),
        make([(1, a, b, x, i) for i, (a, b, x) in enumerate(relations)], "query_id long, src_sym string, dst_sym string, relation string, ord int"),
        make([(1, s, n, x, i) for i, (s, n, x) in enumerate(starts)], "query_id long, symbol string, node_id long, score double, ord int"),
        make([(a, x, b) for (a, x), to in edges.items() for b in to], "src long, relation string, dst long"),
        make(list(kinds.items()), "node_id long, node_type string"),
    )
    similar = make([(1, s, n, x) for s, of in near.items() for n, x in of.items()], "query_id long, symbol string, node_id long, score double")
    got = {(x.symbol, x.node_id): (x.score, x.support) for x in g.by_lists(*given, similar, policy).collect()}
    flat = {(s, n): v for s, of in want.items() for n, v in of.items()}
    assert got.keys() == flat.keys() and all(got[k] == pytest.approx(flat[k]) for k in flat)
    made = lambda pairs: similar.join(pairs, ["query_id", "node_id"], "left_semi")
    lists = g.Gathering(*given[:2], *given[3:], made, policy).lists(given[2].select("query_id", "symbol", "node_id"), None).collect()
    assert max(len(x.near) for x in lists) == policy.neighbors


def test_large_parts_go_by_lists(spark, monkeypatch):
    """Of two questions one comes to more edges than a task may hold: both as simulated."""
    monkeypatch.setattr(g, "PART", 4)
    test_distributed_is_the_same(spark)
