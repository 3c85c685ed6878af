from lodegraph.operators import analysis


def test_shortest_paths_have_no_bound(spark):
    """A chain of seven steps is followed to its end, unless a bound is asked for."""
    names = ["ANSWER", *"ABCDEFG"]
    rows = [(1, a, b, "r", i) for i, (a, b) in enumerate(zip(names, names[1:]))]
    df = spark.createDataFrame(rows, "query_id long, a string, b string, relation string, ord int")
    assert {r.symbol: r.hops for r in analysis.shortest_paths(df).collect()} == {s: i for i, s in enumerate(names)}
    assert {r.symbol for r in analysis.shortest_paths(df, hops=2).collect()} == {"ANSWER", "A", "B"}
