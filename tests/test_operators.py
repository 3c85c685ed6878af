"""Cases by hand: empty and null input, ties, files, streams, and the whole way to an answer."""

import json

import pytest
from pyspark.sql import functions as F

from lodegraph import providers
from lodegraph.functions import parsing
from lodegraph.functions import text as t
from lodegraph.operators import analysis, candidates, merging, metrics, runs
from lodegraph.operators import vectors as v
from lodegraph.plans import answering, config
from lodegraph.sources import files
from lodegraph.streaming import runs as streaming


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_metrics_without_answers_or_truths(spark):
    p = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 5), (2, 1, 9)], "query_id long, rank int, node_id long")
    truth = spark.createDataFrame([(1, 6), (1, 6), (1, 8), (3, 1)], "query_id long, node_id long")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r.query_id: r for r in metrics.per_query(p, truth, asked).collect()}
    assert (got[1].hit_1, got[1].hit_5, got[1].mrr, got[1].recall_20, got[1].total_answers) == (0, 1, 0.5, 0.5, 2)
    assert all((got[q].hit_1, got[q].mrr, got[q].recall_20) == (0, 0, 0) for q in (2, 3)) and got[3].missed_count == 1
    for r in got.values():
        assert r.hit_1 <= r.hit_5 and r.mrr >= r.hit_1 and r.recall_20 <= r.recall_all and r.retrieved_count + r.missed_count == r.total_answers


def test_macro_nulls(spark):
    df = spark.createDataFrame([(1.0, "2"), (None, "x"), (0.5, None)], "a double, b string")
    zero, skip = metrics.macro(df, ["a", "b", "c"]).first(), metrics.macro(df, ["a"], "skip").first()
    assert (zero.avg_a, round(zero.avg_b, 6), skip.avg_a) == (0.5, round(2 / 3, 6), 0.75)
    assert metrics.histogram(df.limit(0), "a").count() == 6


def test_top_k(spark):
    q = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "y", [0.0, 1.0])], "query_id long, node_type string, embedding array<float>")
    n = spark.createDataFrame([(i, "x" if i < 4 else "y", [float(i % 2), 0.5]) for i in range(6)] + [(9, "x", None)], "node_id long, node_type string, embedding array<float>")
    assert rows(v.top_k(q, n, 2), "query_id", "node_id", "rank") == [(1, 1, 1), (1, 3, 2), (2, 4, 1), (2, 5, 2)]
    assert v.top_k(q.limit(0), n, 2).count() == 0 and v.top_k(q, n.limit(0), 2).count() == 0
    assert v.top_k(q, n, 9, cutoff=0).count() == 6
    with pytest.raises(Exception, match="no vector for node 77"):
        v.reordered(spark.createDataFrame([(1, 77, 1)], "query_id long, node_id long, ord int"), q, n).collect()


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("how", [{}, {"typed": False}, {"typed": False, "by_type": True}, {"cutoff": 0.4}])
def test_questions_and_nodes_meet_in_blocks(spark, monkeypatch, small, how):
    """Against all products: ties by id, types, cutoffs, vectors of very different lengths; told at once, and in blocks with little room."""
    import numpy as np

    if small:
        for name, size in (("QUESTION_BYTES", 200), ("NODE_BYTES", 800), ("PRODUCT_BYTES", 300), ("HELD_ROWS", 5)):
            monkeypatch.setattr(v, name, size)
    r = np.random.default_rng(5)
    kinds = ["a", "b", None]
    nodes = [(i, kinds[i % 3], (np.round(r.normal(size=4), 1) * 10.0 ** -(i % 4)).tolist()) for i in range(200)]
    nodes += [(1000 + i, "a", nodes[6][2]) for i in range(30)] + [(5000, "b", None)]
    asked = [(i, kinds[i % 2], r.normal(size=4).tolist()) for i in range(25)] + [(3, "a", r.normal(size=4).tolist()), (77, "b", None)]
    schema = "long, node_type string, embedding array<double>"
    q, n = spark.createDataFrame(asked, f"query_id {schema}"), spark.createDataFrame(nodes, f"node_id {schema}").repartition(3)
    typed, by_type, cutoff = how.get("typed", True), how.get("by_type", False), how.get("cutoff")
    want = {}
    for i, kind, e in asked:
        for j, other, x in nodes:
            if e is not None and x is not None and (not typed or kind == other and kind is not None):
                s = round(float(np.dot(e, x)), 6)
                if cutoff is None or s >= cutoff:
                    want.setdefault((i, other) if by_type else i, []).append((-s, j))
    got = {}
    for x in v.top_k(q, n, 5, **how).collect():
        got.setdefault((x.query_id, x.node_type) if by_type else x.query_id, []).append((x.rank, -x.score, x.node_id))
    assert {key: [(s, j) for _, s, j in sorted(rows)] for key, rows in got.items()} == {key: sorted(rows)[:5] for key, rows in want.items()}
    pairs = [(x.query_id, x.node_id) for x in v.every(q, n, cutoff).collect()]
    assert len(pairs) == sum(1 for i, _, e in asked for j, _, y in nodes if e is not None and y is not None and (cutoff is None or round(float(np.dot(e, y)), 6) >= cutoff))


def test_short_vectors_are_left_out(monkeypatch):
    """Behind the first slices no product is taken, as lengths tell that none can be among the best."""
    import numpy as np

    monkeypatch.setattr(v, "PRODUCT_BYTES", 80)
    monkeypatch.setattr(v, "HELD_ROWS", 4)
    q = v._Questions(np.array([1]), ["x"], np.array([[1.0, 0.0]]))
    vectors = np.array([[10.0 / (1 + i), 0.1] for i in range(500)])
    taken = []
    round_ = np.round
    monkeypatch.setattr(v.np, "round", lambda a, d: (taken.append(len(a)), round_(a, d))[1])
    (found,) = v._search(q, iter([(np.arange(500), np.array(["x"] * 500, dtype=object), vectors)]), 3, None, True, False)
    assert found.column(1).to_pylist() == [0, 1, 2] and sum(taken) < 50


@pytest.mark.parametrize("hits, size", [(0, 20), (1, 20), (20, 20), (21, 21)])
def test_initial_candidates(spark, hits, size):
    exact = spark.range(hits).select(F.lit(1).cast("long").alias("query_id"), F.col("id").alias("node_id"))
    near = spark.range(15, 60).select(F.lit(1).cast("long").alias("query_id"), F.col("id").alias("node_id"), (1 - F.col("id") / 1000).alias("score"))
    got = candidates.initial(exact, near).orderBy("ord").collect()
    assert len(got) == size and [r.node_id for r in got[:hits]] == list(range(hits)) and len({r.node_id for r in got}) == size


def test_alpha_twenty_is_cut(spark):
    graph = spark.range(25).select(F.lit(1).cast("long").alias("query_id"), F.col("id").alias("node_id"), (F.col("id") + 1).cast("int").alias("rank"))
    near = spark.range(100, 150).select(F.lit(1).cast("long").alias("query_id"), F.col("id").alias("node_id"), (1 / F.col("id")).alias("score"))
    got = merging.alpha_merged(graph, near)
    assert {r.alpha: r["count"] for r in got.groupBy("alpha").count().collect()} == dict.fromkeys(range(12, 21), 20)
    assert rows(got.where("alpha = 12 and rank > 11"), "rank", "node_id") == [(12, 11), *((13 + k, 100 + k) for k in range(8))]


def test_parsers():
    assert parsing.triples_of("```python\n[('A','B','r'), ['a','b','c'], ('x','y')]```") == [{"a": "A", "b": "B", "relation": "r"}]
    assert parsing.triples_of("nonsense") == [] == parsing.triples_of(None)
    got = lambda text: [(r["a"], r["b"], r["relation"]) for r in parsing.relations_of(text)]
    assert got("{('A','B'): ['x','y']}") == [("A", "B", "x"), ("A", "B", "y")]
    assert got('{"(\'A\', \'B\')": ["x"]}') == got('{"(A, B)": ["x"]}') == got("{\"('A' and 'B')\": ['x']}") == [("A", "B", "x")]
    assert got('{"A, B": ["x"]}') == [("A, B", None, "x")]
    assert got("{}") == got("") == [] and parsing.relations_of("{('A','B'): 'x'}") is None and parsing.relations_of("[") is None
    assert parsing.literal("{'a': true, 'b': null}") == {"a": True, "b": None} and parsing.literal("?") is None


def test_text_functions(spark):
    df = spark.createDataFrame([("Hello there. More", " A, b,,A "), (None, None), ("", "")], "x string, y string")
    got = df.select(t.first_sentence(F.col("x")), F.array_join(t.split_names(F.col("y")), ","), t.first_int(F.lit("a12b3"))).collect()
    assert [tuple(r) for r in got] == [("Hello there", "a,b", 12), (None, "", 12), ("", "", 12)]


def test_failure_modes(spark):
    df = spark.createDataFrame([(0.0, "a", "linked_to", "a", "linked to"), (1.0, "", "", None, None)], "recall double, gt_entities string, gt_relations string, entities string, relations string")
    strict, normal = ([r.cause for r in analysis.failure_causes(df, m).collect()] for m in ("strict", "normalised"))
    assert strict == ["relation_error", "success"] and normal == ["reasoning error", "success"]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nline', [1, 2], {}), (1, "b", [], {"k": "v"}), (2, None, None, None)], "id long, text string, ids array<long>, m map<string,string>")
    files.write_csv(df.coalesce(1), f"{tmp_path}/dump")
    (tmp_path / "dump" / "junk.csv").write_bytes(b"\x00\x01")
    back = files.read_csv(spark, f"{tmp_path}/dump", "id long, text string, ids string, m string").where("id is not null")
    last = runs.dedup(back, ["id"], "seq").orderBy("id").select("id", "text", files.nested(F.col("ids"), "array<bigint>").alias("ids"), files.nested(F.col("m"), "map<string,string>").alias("m")).collect()
    assert [tuple(r) for r in last] == [(1, "b", None, {"k": "v"}), (2, None, None, None)]
    assert back.where("text like 'a%'").first().text == 'a "q"\nline'


def test_templates_and_triplets(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿Id,Template,No_of_hops,No_of_entities,Entities,No_of_relations,relations\n1,\"a, b\",2,2,\"drug,gene\",1,target\n".encode())
    (tmp_path / "t.txt").write_text("a --- is in ---> b,\nc --- r ---> d\n\n")
    assert files.read_templates(spark, f"{tmp_path}/t.csv").first().Id == 1
    assert rows(files.read_triplets(spark, f"{tmp_path}/t.txt"), "*") == [("a", "is in", "b"), ("c", "r", "d")]


def test_run_selection(spark):
    df = spark.createDataFrame([(1, "FAILED"), (2, None), (3, "SKIPPED"), (4, "SUCCESS")], "query_id long, status string")
    again, kept = runs.select(df, "retry")
    assert rows(again, "query_id") == [(1,)] and kept.count() == 3
    assert rows(runs.select(df, "ids", ids=[2, 4])[0], "query_id") == [(2,), (4,)]
    assert rows(runs.resume(df, df.where("query_id < 3")), "query_id") == [(3,), (4,)]
    numbered = spark.range(25).withColumnRenamed("id", "pos")
    assert rows(runs.head_share(numbered, "pos"), "pos") == [(0,), (1,)] and runs.head_share(numbered, "pos", 50, limit=5).count() == 5 and runs.head_share(numbered.limit(0), "pos").count() == 0


def test_providers(spark):
    asked = spark.createDataFrame([(1, "s", 1, "x"), (2, "s", 1, "x"), (3, "s", 1, None)], "query_id long, stage string, attempt int, prompt string")
    assert rows(providers.Called(lambda ps: [p + "!" for p in ps]).complete(asked), "query_id", "response") == [(1, "x!"), (2, "x!"), (3, None)]
    said = spark.createDataFrame([(2, "s", 1, "yes")], "query_id long, stage string, attempt int, response string")
    assert rows(providers.Recorded(said).complete(asked).where("response is not null"), "query_id", "response") == [(2, "yes")]


def test_stream_answers_once(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    answer = lambda batch: batch.withColumn("answer", F.col("query_id") * 2)
    for part in (range(3), range(1, 5)):
        spark.createDataFrame([(i,) for i in part], "query_id long").write.mode("append").parquet(folder)
        q = streaming.answered(streaming.questions(spark, folder, "query_id long"), answer, out, f"{tmp_path}/cp")
        q.awaitTermination()
    assert rows(spark.read.parquet(out), "query_id", "answer") == [(i, 2 * i) for i in range(5)]
    means = streaming.running_means(spark.createDataFrame([(1.0,), (None,)], "m double"), ["m"]).first()
    assert tuple(means) == (2, 0.5)


@pytest.fixture(scope="module")
def world(spark):
    """Two diseases treated by drugs; the drugs hit proteins."""
    nodes = spark.createDataFrame([(1, "disease", "flu"), (2, "drug", "alpha"), (3, "drug", "beta"), (4, "gene/protein", "p1")], "node_id long, node_type string, name string")
    pairs = [(2, "indication", 1), (3, "contraindication", 1), (2, "target", 4)]
    edges = spark.createDataFrame([e for a, r, b in pairs for e in ((a, r, b), (b, r, a))], "src long, relation string, dst long")
    emb = spark.createDataFrame([(1, "disease", [1.0, 0.0]), (2, "drug", [0.6, 0.8]), (3, "drug", [0.8, 0.6]), (4, "gene/protein", [0.0, 1.0])], "node_id long, node_type string, embedding array<float>")
    text = spark.createDataFrame([("flu", [1.0, 0.0]), ("the drug", [0.8, 0.6])], "text string, embedding array<float>")
    return answering.Graph(nodes, edges, emb, text)


def test_answering(spark, world):
    entities = '{"A": {"name": "flu", "type": "disease", "constant": true}, "ANSWER": {"information": "the drug", "type": "drug"}}'
    said = spark.createDataFrame(
        [(1, "entities", 1, None, "what?"), (1, "entities", 2, None, f"```json\n{entities}\n```"), (1, "relations", 1, None, "{('A', 'ANSWER'): ['Indication', 'made up']}"), (2, "entities", 1, None, entities), (2, "relations", 1, None, "{}")],
        "query_id long, stage string, attempt int, symbol string, response string",
    )
    said = said.withColumn("response", F.replace("response", F.lit("Indication"), F.lit("indication")))
    got = answering.answer(said, world)
    by = {(r.query_id, r.rank): (r.node_id, r.status) for r in got.collect()}
    assert by == {(1, 1): (2, "SUCCESS"), (1, 2): (3, "SUCCESS"), (2, 1): (3, "FALLBACK"), (2, 2): (2, "FALLBACK")}
    truths = spark.createDataFrame([(1, 2), (2, 2), (3, 2)], "query_id long, node_id long")
    assert rows(answering.judged(got, truths), "query_id", "hit_1", "mrr") == [(1, 1.0, 1.0), (2, 0.0, 0.5), (3, 0.0, 0.0)]


def test_ablations(spark, world):
    s = answering.Settings(verify_relations=False, verify_anchor=False)
    said = spark.createDataFrame([(1, "relations", 1, "{('A', 'ANSWER'): ['made up']}")], "query_id long, stage string, attempt int, response string")
    assert answering.relations_of(said, s).count() == 1 and answering.relations_of(said).count() == 0


@pytest.mark.parametrize(
    "key, symbols",
    [("('A', 'B')", ["A", "B"]), ('("Crohn\'s", "B")', ["Crohn's", "B"]), ("(A, ANSWER)", ["A", "ANSWER"]), ("('A', B)", ["A", "B"]), ("(A)", ["(A)"]), ("A, B", ["A, B"]), (("A", "B"), ["A", "B"]), ("(A, B, C)", ["A", "B, C"]), (7, ["7"]), ("", [""]), ("(", ["("])],
)
def test_symbols_of_keys(key, symbols):
    assert parsing.symbols_of(key) == symbols


def test_choices(spark):
    said = ['{"choice": 2}', '```json\n{"choice": "1"}\n```', 'so {"choice": 3} it is', '{"a": {"b": 1}, "choice": 2}', "{choice: 2}", "2", '{"choice": 9}', '{"other": 1}', "{x} or 4", "{none of these, but perhaps 2}", "", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(said)], "k int, x string")
    got = [r.c for r in df.select("k", candidates.choice_of(F.col("x"), F.lit(3)).alias("c")).orderBy("k").collect()]
    assert got == [2, 1, 3, 2, 2, 0, 0, 0, 0, 0, 0, 0]


def test_duels_that_run_in_circles(spark):
    answers = spark.createDataFrame([(1, n, r) for r, n in enumerate((10, 20, 30), 1)] + [(2, 5, 1), (2, 6, 2), (3, 7, 1)], "query_id long, node_id long, rank int")
    duels = spark.createDataFrame([(1, 10, 20, "A"), (1, 20, 30, "'20'"), (1, 10, 30, ' "B" '), (2, 6, 5, "A"), (2, 5, 6, "?")], "query_id long, a long, b long, response string")
    got = {q: [r.node_id for r in merging.by_duels(answers, duels).where(f"query_id = {q}").orderBy("rank").collect()] for q in (1, 2, 3)}
    better = {(10, 20): 1, (20, 30): 1, (10, 30): -1}
    import functools

    asked = lambda a, b: better.get((a, b), -better.get((b, a), 0))
    assert got == {1: sorted([10, 20, 30], key=functools.cmp_to_key(asked), reverse=True), 2: [5, 6], 3: [7]}


def test_reranking_by_number(spark):
    asked = spark.createDataFrame([(0, 1, [5, 6, 7]), (1, 2, []), (2, 3, None), (3, 4, [8, 9])], "place int, query_id long, answers array<long>")
    lists = lambda *a: [r.reranked for r in merging.reranked(asked, *a).orderBy("place").collect()]
    scores = spark.createDataFrame([(1, 5, "0.1", True), (1, 7, "0.9", True), (1, 6, "1", False), (4, 9, "1", False)], "query_id long, node_id long, response string, with_relations boolean")
    assert lists(0, scores) == [[7, 6, 5], [], [], [9, 8]]
    assert lists(1, spark.createDataFrame([(1, "7, 1, 5"), (4, "?")], "query_id long, response string")) == [[7, 5, 6], [], [], [8, 9]]
    assert lists(2, spark.createDataFrame([(4, 8, 9, "B")], "query_id long, a long, b long, response string")) == [[5, 6, 7], [], [], [9, 8]]
    assert lists(3, spark.createDataFrame([(1, 2, 1), (1, 0, 2), (1, 1, 3)], "query_id long, index int, position int")) == [[7, 5, 6], [], [], [8, 9]]
    assert lists(1, spark.createDataFrame([], "query_id long, response string"), 1) == [[5], [], [], [8]]
    with pytest.raises(ValueError, match="unknown reranking method"):
        lists(4, scores)


def test_outputs_of_a_reranking(spark, tmp_path):
    judged = spark.createDataFrame([(1, 1.0, 1.0, 0.5, 0.25), (2, 0.0, 1.0, 0.5, 0.75)], "query_id long, hit_1 double, hit_5 double, mrr double, recall_20 double")
    files.write_rerank(spark.createDataFrame([(1, [3, 2])], "query_id long, reranked array<long>"), judged, f"{tmp_path}/out", 2, "kg")
    read = lambda name: spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/out{name}.csv").collect()
    assert [r.reranked for r in read("")] == ["[3,2]"] and len(read("_details")) == 2
    assert tuple(read("_summary")[0]) == ("2", "kg", "0.5", "1.0", "0.5", "0.5", "2")


def test_metrics_are_appended(spark, tmp_path):
    for k in (1, 2):
        files.append_metrics(spark.createDataFrame([(k, None)], "query_id long, mrr double"), f"{tmp_path}/m")
    back = spark.read.option("header", True).csv(f"{tmp_path}/m").orderBy("query_id").collect()
    assert [(r.query_id, r.mrr, r["recall@20_alpha_20"]) for r in back] == [("1", "0.0", "0.0"), ("2", "0.0", "0.0")]


def test_vector_cache(spark):
    new = lambda *r: spark.createDataFrame(list(r), "text string, query_id long, embedding array<double>, seq int")
    cache = v.VectorCache(spark.createDataFrame([], "key string, embedding array<double>")).put(new(("a", 0, [1.0], 1), ("a", None, [2.0], 2), ("a", 7, [3.0], 1), ("b", 1, None, 1)))
    later = cache.put(new(("a", 0, [9.0], 1)))
    asked = spark.createDataFrame([("a", 0), ("a", 7), ("a", 8), ("b", 1)], "text string, query_id long")
    assert rows(later.get(asked), "text", "query_id", "embedding") == [("a", 0, [9.0]), ("a", 7, [3.0]), ("a", 8, None), ("b", 1, None)]
    assert (cache.size(), later.size(), later.clear().size()) == (2, 2, 0) and cache.get(asked).where("query_id = 0").first().embedding == [2.0]


def test_scores_without_ranks(spark):
    q = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "y", [0.0, 1.0])], "query_id long, node_type string, embedding array<float>")
    n = spark.createDataFrame([(i, "x", [float(i), 0.5]) for i in range(3)] + [(9, "x", None)], "node_id long, node_type string, embedding array<float>")
    assert v.every(q, n).count() == 6 and rows(v.every(q, n, 0.6), "query_id", "node_id") == [(1, 1), (1, 2)] and v.every(q.limit(0), n).count() == 0
    mask = spark.createDataFrame([(1, 0), (1, 0), (1, 77), (2, 2), (2, 9)], "query_id long, node_id long")
    assert rows(v.masked(q, n, mask), "query_id", "node_id", "score") == [(1, 0, 0.0), (2, 2, 0.5)]


def test_settings_from_a_file(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"experiment": {"dataset": "a"}, "grounding_params": {"score_decay": 0.5}}))
    read = config.load(tmp_path / "c.json", alpha=14, dataset=None, split="test")
    made = config.settings(read)
    assert (made.alpha, made.policy.decay, config.value(read, "dataset"), config.value(read, "split")) == (14, 0.5, "a", "test")
    assert config.settings({}) == answering.Settings()
    with pytest.raises(KeyError):
        config.load(tmp_path / "c.json", other=1)


def test_truths_by_group_are_never_made_pairs(spark):
    """Questions judged by their groups' sizes: as if every truth stood in a row, also for a question alone in its group or without one."""
    n = spark.createDataFrame([(i, None if i == 11 else f"t{i % 3 if i < 9 else i}") for i in range(12)], "node_id long, node_type string")
    q = n.where("node_id in (0, 1, 10, 11)").withColumnRenamed("node_id", "query_id")
    p = spark.createDataFrame([(0, 1, 0), (0, 2, 4), (0, 3, 3), (0, 7, 3), (1, 1, 2), (10, 1, 10), (11, 1, 11)], "query_id long, rank int, node_id long")
    truths = q.join(n, "node_type").select("query_id", "node_id")
    for itself in (True, False):
        old = metrics.per_query(p, truths if itself else truths.where("query_id <> node_id"), cut=3)
        new = metrics.per_query_of_groups(p, q, n, itself, cut=3)
        assert new.columns == old.columns and sorted(new.collect()) == sorted(old.collect())
    m = p.withColumn("alpha", F.lit(12))
    assert sorted(merging.alpha_recall_of_groups(m, q, n, 3).collect()) == sorted(merging.alpha_recall(m, truths, 3).collect())


def test_masks_go_to_the_vectors_not_to_scores(spark):
    """Nothing is joined or shuffled for each pair: what is named or not is told where the vectors are multiplied."""
    n = spark.createDataFrame([(i, "t", None if i == 5 else [float(i), 1.0]) for i in range(6)], "node_id long, node_type string, embedding array<float>")
    q = n.where("node_id in (1, 2)").withColumnRenamed("node_id", "query_id")
    mask = spark.createDataFrame([(1, 0), (1, 0), (1, 5), (1, 99), (7, 3), (2, 2), (None, 4)], "query_id long, node_id long")
    inside, outside = v.masked(q, n, mask), v.unmasked(q, n, mask)
    assert rows(inside, "query_id", "node_id", "score") == [(1, 0, 1.0), (2, 2, 5.0)]
    assert rows(outside, *outside.columns) == rows(v.excluded(v.every(q, n), mask), *outside.columns) and outside.count() == 8
    assert v.masked(q, n, mask.limit(0)).isEmpty() and v.unmasked(q, n, mask.limit(0)).count() == 10
    for df in (inside, outside):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan[: plan.index("MapInArrow")] for x in ("Join", "Exchange", "Window"))


def test_rows_held_for_the_best_stay_few():
    import numpy as np

    best, most, r = v._Best(10, 5), 0, np.random.default_rng(3)
    for start in range(0, 600_000, 10_000):
        best.add(r.integers(0, 10, 10_000), np.arange(start, start + 10_000), np.zeros(10_000, np.int64), r.random(10_000))
        most = max(most, best.held)
    assert most <= 300_000 and len(best.taken()[0]) == 50
