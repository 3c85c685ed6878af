"""Rows that many writers append, and vectors that come in batches."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.batches import BatchJob, RecordedService
from ..sources import appends, graph
from ..sources.tables import table
from ..storage import new_path
from . import query

#: Batches that the events are appended in.
BATCHES = 4


def _batches(rows):
    return [(str(k), rows.where(F.pmod(F.xxhash64("event_id"), F.lit(BATCHES)) == k)) for k in range(BATCHES)]


@query("SELECT event_id, user_id, value FROM events")
def snk_threadsafe_csv(spark, d):
    """Every batch is appended by two writers at once; each row stands once."""
    rows = table(spark, d, "events").select("event_id", "user_id", "value")
    path = new_path(spark, "metrics")

    def write(batch):
        return appends.AppendLog(spark, path, rows.schema).append(batch[1], batch[0])

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, _batches(rows) * 2))
    return appends.AppendLog(spark, path, rows.schema).read().drop("commit")


@query("""SELECT event_id::VARCHAR AS id, coalesce(event_type, '') AS status, coalesce('{"k":' || json_extract(props, '$.k') || '}', '') AS answer,
  CASE WHEN event_type = 'error' THEN 'lost' ELSE '' END AS failure_reason FROM events""")
def snk_partial_dump(spark, d):
    """Results appended part by part as text cells; a part is repeated, one is compacted over."""
    e = table(spark, d, "events")
    answer = F.from_json("props", "struct<k: int>").alias("answer")
    reason = F.when(F.col("event_type") == "error", "lost").alias("failure_reason")
    rows = e.select("event_id", F.col("event_id").alias("id"), F.col("event_type").alias("status"), answer, reason)
    log = appends.dump_log(spark, new_path(spark, "dump"), ["id", "status", "answer"])
    for name, part in _batches(rows):
        appends.append_dump(log, part, name)
        appends.append_dump(log, part, name)
        if name == "1":
            log.compact()
    log.clean()
    return log.read().drop("commit")


def _answers(spark, d):
    """A service that knows every vector but one in five, fails one in seven, answers some twice and in any order."""
    vectors = graph.node_emb(spark, d).select(F.col("node_id").alias("query_id"), "embedding")
    response = lambda code: F.struct(F.lit(code).alias("status_code"), F.struct(F.array(F.struct("embedding")).alias("data")).alias("body"))
    i = F.col("query_id")

    def lines(requests):
        known = requests.select("query_id").join(vectors, "query_id")
        id_ = F.concat(F.lit("qid-"), i).alias("custom_id")
        good = F.to_json(F.struct(id_, response(200).alias("response")))
        bad = F.to_json(F.struct(id_, F.lit("lost").alias("error")))
        once = known.select(F.when(i % 7 == 6, bad).when(i % 5 != 4, good).alias("value"), "query_id").where("value is not null")
        return once.unionByName(once.where(i % 3 == 0)).orderBy(F.xxhash64("query_id"))

    return lines


@query("""SELECT vec_id AS query_id, CASE WHEN vec_id % 5 <> 4 AND vec_id % 7 <> 6 THEN 'done' ELSE 'failed' END AS state,
  CASE WHEN vec_id % 7 = 6 THEN 'lost' WHEN vec_id % 5 = 4 THEN 'no result' END AS error,
  CASE WHEN vec_id % 5 <> 4 AND vec_id % 7 <> 6 THEN round(list_sum(embedding::DOUBLE[]), 5) END AS total FROM embeddings""")
def emb_batch(spark, d):
    """Every vector asked for in batches, by a job that is made anew before each step."""
    queries = graph.node_emb(spark, d).select(F.col("node_id").alias("query_id"), F.format_string("text %d", "node_id").alias("query"))
    folder = new_path(spark, "job")
    service = RecordedService(spark, new_path(spark, "service"), _answers(spark, d))
    job = lambda: BatchJob(spark, folder, service)
    job().plan(queries)
    while job().step():
        pass
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5)
    return job().outcome().select("query_id", "state", "error", total.cast(T.DoubleType()).alias("total"))
