import random

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import runs as operators
from lodegraph.plans import answering, stages
from lodegraph.queries.staged import _provider
from lodegraph.storage import new_path
from lodegraph.streaming import runs as streaming


@pytest.fixture()
def questions(spark):
    return spark.createDataFrame([(1, "drug x"), (2, "drug x"), (3, "a drug"), (4, None), (5, "{facts} (it's)")], "query_id long, query string")


def of(spark, path, provider, **switches):
    return stages.Stages(stages.ResultStore(spark, path, slice_=2), provider, switches=stages.Switches(**switches))


def test_a_second_run_asks_nothing(spark, questions):
    path, first = new_path(spark, "answers"), _provider()
    got = {r.query_id: r for r in of(spark, path, first).extract(questions).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert got[1].facts == got[2].facts == "DRUG X" and got[5].facts == "{FACTS} (IT'S)" and got[4].facts == ""
    assert all([tuple(t) for t in r.relations] == [("A", "ANSWER", "indication")] for r in got.values())
    # four prompts of questions; the one that begins with an a is asked twice for its entities
    assert first.asked == 4 + 5 + 4 + 4
    again = _provider()
    assert {r.query_id: r for r in of(spark, path, again).extract(questions).collect()} == got and again.asked == 0


class Dies:
    """Answers so many slices, then the run is lost."""

    def __init__(self, slices):
        self.inner, self.left = _provider(), slices

    def complete(self, requests):
        if not self.left:
            raise KeyboardInterrupt
        self.left -= 1
        return self.inner.complete(requests)


def test_a_lost_run_goes_on(spark, questions):
    path, asked = new_path(spark, "answers"), 0
    for slices in (1, 3, 2):
        dying = Dies(slices)
        with pytest.raises(KeyboardInterrupt):
            of(spark, path, dying).extract(questions).collect()
        asked += dying.inner.asked
    last = _provider()
    got = of(spark, path, last).extract(questions).collect()
    assert len(got) == 5 and asked + last.asked == 17


def test_ablations(spark, questions):
    provider = _provider()
    got = {r.query_id: r for r in of(spark, new_path(spark, "answers"), provider, deconstruction=False, self_correction=False).extract(questions).collect()}
    assert got[3].facts == "a drug" and [t.relation for t in got[3].relations] == ["indication", "ppi"]
    stages_asked = {r.stage for r in of(spark, new_path(spark, "none"), provider).store.log.read().collect()}
    assert stages_asked == set() and provider.asked == 5 + 4


def test_unreadable_to_the_end(spark, questions):
    silent = stages.Derived(F.when(F.col("stage") == "entities", "no"))
    rows = of(spark, new_path(spark, "answers"), silent, attempts=2).extract(questions).collect()
    assert all(r.entities is None and r.relations == [] for r in rows) and len(rows) == 5
    assert [r.facts for r in sorted(rows, key=lambda r: r.query_id)][:3] == ["drug x", "drug x", "a drug"]


def test_expansion_reads_the_first_documents(spark, questions):
    echo = stages.Derived(F.col("prompt"))
    answers = spark.createDataFrame([(1, k, 10 - k) for k in range(1, 7)] + [(2, 1, 99)], "query_id long, rank int, node_id long")
    docs = spark.createDataFrame([(k, f"doc {k}") for k in range(10)], "node_id long, doc string")
    got = {r.query_id: r.expanded for r in of(spark, new_path(spark, "answers"), echo).expanded(questions, answers, docs).collect()}
    assert got[1].endswith("doc 9\ndoc 8\ndoc 7\ndoc 6") and got[2] == "drug x" and got[4] is None


def test_answers_are_read_by_the_plan(spark, questions):
    responses = stages.as_responses(of(spark, new_path(spark, "answers"), _provider()).extract(questions.where("query_id = 3")))
    symbols = answering.symbols_of(responses).collect()
    assert {(r.symbol, r.type, r.name) for r in symbols} == {("A", "drug", "a drug"), ("ANSWER", "disease", None)}
    assert [(r.src_sym, r.dst_sym, r.relation) for r in answering.relations_of(responses).collect()] == [("A", "ANSWER", "indication")]


def test_nothing_to_ask(spark, questions):
    provider = _provider()
    stage = of(spark, new_path(spark, "answers"), provider)
    assert stage.extract(questions.limit(0)).collect() == [] and provider.asked == 0


def test_slots_are_filled_at_once(spark):
    made = stages.filled("{a}-{b}-{a}", a=F.lit("{b}"), b=F.lit(None))
    assert spark.range(1).select(made.alias("x")).first().x == "{b}--{b}"


def test_means_follow_replacements_after_every_batch(spark, tmp_path):
    own, r = spark.newSession(), random.Random(3)
    own.conf.set("spark.sql.shuffle.partitions", "3")
    rows, path = [], f"file://{tmp_path}"
    for batch in range(5):
        new = [(r.randrange(12), r.randrange(10_000), r.choice([None, 0.1, 1 / 3, 0.7, 1e6, 1e-9]), r.random()) for _ in range(r.choice([1, 30, 60]))]
        rows += new
        schema = "query_id long, seq long, a double, b double"
        own.createDataFrame(new, schema).coalesce(2).write.mode("append").parquet(f"{path}/rows")
        means = streaming.ReplacingMeans(own, f"{path}/means", ["a", "b"])
        means.start(streaming.questions(own, f"{path}/rows", schema, 1)).awaitTermination()
        last = operators.dedup(own.createDataFrame(rows, schema), ["query_id"], "seq")
        want = last.agg(F.count("*").alias("n"), *(F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in "ab")).first()
        got = means.means().first()
        assert got.total_queries == want.n and abs(got.avg_a - want.a) < 1e-9 * max(1, want.a) and abs(got.avg_b - want.b) < 1e-9
    # a batch that is run again changes nothing
    assert not means.log.append(own.createDataFrame([(5, None, None)], means.log.schema), "0")


def test_means_of_nothing(spark, tmp_path):
    got = streaming.ReplacingMeans(spark, f"file://{tmp_path}/m", ["a"]).means().first()
    assert (got.total_queries, got.avg_a) == (0, None)


def test_replacing_means_call_no_python(spark, tmp_path):
    """The state is Spark's own; rows that come late or without a number change nothing, whatever their order."""
    means = streaming.ReplacingMeans(spark, f"file://{tmp_path}/m", ["a"])
    rows = spark.createDataFrame([(1, 5, 1.0), (1, 4, 9.0), (1, None, 7.0), (2, 3, None), (2, 2, 4.0), (3, 1, 2.0), (3, 1, 3.0)], "query_id long, seq long, a double")
    assert {(r.query_id, r.a) for r in means.last(rows).collect()} == {(1, 1.0), (2, 0.0), (3, 3.0)}
    plan = means.last(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
