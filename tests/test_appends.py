import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lodegraph import storage
from lodegraph.plans import batches as b
from lodegraph.queries.appended import _answers
from lodegraph.sources.appends import AppendLog, append_dump, dump_log
from lodegraph.storage import new_path

SF = "/root/testdata/sf0.001"


def rows_of(log):
    return sorted((r.x, r.y) for r in log.read().collect())


@pytest.fixture()
def log(spark):
    path, schema = new_path(spark, "log"), spark.createDataFrame([], "x long, y string").schema
    return lambda: AppendLog(spark, path, schema)


def part(spark, k):
    return spark.range(10 * k, 10 * k + 10).select(F.col("id").alias("x"), F.concat(F.lit("b"), F.lit(k)).alias("y"))


def test_nothing_yet(log):
    assert log().read().columns == ["x", "y", "commit"] and rows_of(log()) == [] and not log().compact()


def test_many_writers_and_repeats(spark, log):
    tasks = [k % 8 for k in range(24)]
    random.Random(1).shuffle(tasks)
    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(lambda k: log().append(part(spark, k), str(k)), tasks))
    assert sum(done) == 8 and rows_of(log()) == [(x, f"b{x // 10}") for x in range(80)]
    assert sorted(r.commit for r in log().read().groupBy("commit").count().collect()) == list(range(8))


def test_what_was_not_committed_is_not_seen(spark, log, monkeypatch):
    log().append(part(spark, 0), "0")
    monkeypatch.setattr(AppendLog, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        log().append(part(spark, 1), "1")
    monkeypatch.undo()
    assert len(rows_of(log())) == 10 and len(storage.names(spark, f"{log().path}/data")) == 2
    assert log().append(part(spark, 1), "1") and log().clean() == 1 and len(rows_of(log())) == 20


def test_compaction_keeps_rows_order_and_batches(spark, log):
    for k in (2, 0, 1):
        log().append(part(spark, k), str(k))
    before, old = [(r.x, r.commit) for r in log().read().orderBy("x").collect()], log()
    old.state()
    assert log().compact() and [(r.x, r.commit) for r in log().read().orderBy("x").collect()] == before
    assert len(log().state().folders) == 1 and not log().append(part(spark, 2), "2")
    assert old.append(part(spark, 5), "5") and len(rows_of(log())) == 40
    assert log().clean() == 3 and len(rows_of(log())) == 40


def test_two_compactions_at_once(spark, log):
    for k in range(3):
        log().append(part(spark, k), str(k))
    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(lambda _: log().compact(), range(3)))
    assert any(done) and len(rows_of(log())) == 30


def test_columns_are_matched_by_name(spark, log):
    log().append(spark.createDataFrame([("7", 1)], "x string, z int"), "a")
    assert rows_of(log()) == [(7, None)]


def test_dump_cells(spark):
    held = dump_log(spark, new_path(spark, "dump"), ["id", "answers", "status"])
    append_dump(held, spark.createDataFrame([(1, [3, 4], None), (2, None, "late")], "id int, answers array<int>, failure_reason string"), "0")
    got = sorted(tuple(r) for r in held.read().drop("commit").collect())
    assert got == [("1", "[3,4]", "", ""), ("2", "", "", "late")]


class Killed(Exception):
    pass


def test_a_job_goes_on_wherever_it_was_killed(spark, monkeypatch):
    """Killed once at every step: before and after each is done, and before it is recorded."""
    queries = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("query_id"), F.lit("t").alias("query")).cache()
    folder, part_size = new_path(spark, "job"), queries.count() // 2 + 1
    service = b.RecordedService(spark, new_path(spark, "service"), _answers(spark, SF), lambda k: "completed")
    kills, submitted = [], []
    originals = {n: getattr(b.BatchJob, n) for n in ("_record", "_collect")} | {"append": AppendLog.append, "submit": service.submit}

    def killing(name, state=None):
        """The next call with this state dies after (or, with a ``!``, before) it is done."""
        def call(self, *given):
            if state in map(str, given) or state is None:
                monkeypatch.undo()
                if not name.startswith("!"):
                    originals[name](self, *given)
                kills.append((name, state))
                raise Killed
            return originals[name.strip("!")](self, *given)
        return call

    def job():
        return b.BatchJob(spark, folder, service, part=part_size)

    points = [("!append", "plan"), ("append", "plan"), ("!_record", b.SUBMITTED), ("_record", b.SUBMITTED), ("!_record", b.DONE), ("_record", b.DONE), ("!_collect", None), ("_collect", None), ("!_record", b.COLLECTED), ("_record", b.COLLECTED)]
    for name, state in points:
        owner = AppendLog if "append" in name else b.BatchJob
        monkeypatch.setattr(owner, name.strip("!"), killing(name, state))
        with pytest.raises(Killed):
            for _ in range(6):
                job().plan(queries)
                job().step()
    assert len(kills) == len(points) and not submitted
    got = {r.query_id: (r.state, r.error) for r in job().run(queries).collect()}
    assert len(got) == queries.count() == job().outcome().count()
    for i, (state, error) in got.items():
        assert (state, error) == (("failed", "lost") if i % 7 == 6 else ("failed", "no result") if i % 5 == 4 else ("done", None))


def test_a_failed_batch(spark):
    queries = spark.createDataFrame([(k, "t") for k in range(10)] + [(None, "t"), (3, "t")], "query_id long, query string")
    service = b.RecordedService(spark, new_path(spark, "service"), _answers(spark, SF), lambda k: "expired" if k == 1 else "completed")
    job = b.BatchJob(spark, new_path(spark, "job"), service, part=4)
    job.plan(queries)
    assert {r.state for r in job.outcome().collect()} == {"pending"}
    got = {r.query_id: (r.state, r.error) for r in job.run(queries).collect()}
    assert len(got) == 10 and all(got[k] == ("failed", "batch expired") for k in (4, 5, 6, 7)) and got[0] == ("done", None)


def test_a_job_without_requests(spark):
    queries = spark.createDataFrame([], "query_id long, query string")
    service = b.RecordedService(spark, new_path(spark, "service"), _answers(spark, SF))
    assert b.BatchJob(spark, new_path(spark, "job"), service).run(queries).collect() == []
