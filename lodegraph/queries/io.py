"""Source and sink queries: lines as runs write them are made from the tables, then read by the sources' own parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files
from ..sources.tables import table
from . import ORACLES, evaluation, query


@query("""SELECT '{"custom_id":"qid-' || o_orderkey || '","method":"POST","url":"/v1/embeddings","body":{"input":"' || o_orderpriority || '","model":"embedding-model","encoding_format":"float"}}' AS value FROM orders""")
def snk_jsonl_requests(spark, d):
    return files.request_lines(table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("query")))


def _result_lines(spark, d):
    """A result for every vector: one in five has another status, one in seven an error."""
    e = table(spark, d, "embeddings")
    i = F.col("vec_id")
    body = F.struct(F.array(F.struct("embedding")).alias("data"))
    response = F.struct(F.when(i % 5 == 4, 500).otherwise(200).alias("status_code"), body.alias("body"))
    return e.select(F.to_json(F.struct(F.concat(F.lit("qid-"), i).alias("custom_id"), F.when(i % 7 == 6, "lost").alias("error"), response.alias("response"))).alias("value"))


@query("SELECT vec_id AS query_id, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings WHERE vec_id % 5 <> 4 AND vec_id % 7 <> 6")
def src_jsonl_results(spark, d):
    good, _ = files.results(_result_lines(spark, d))
    return good.select("query_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("SELECT vec_id AS query_id, CASE WHEN vec_id % 7 = 6 THEN 'lost' ELSE 'status 500' END AS error FROM embeddings WHERE vec_id % 5 = 4 OR vec_id % 7 = 6")
def src_jsonl_failures(spark, d):
    return files.results(_result_lines(spark, d))[1]


@query("SELECT l_orderkey AS query_id, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS answers FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) <= 20) GROUP BY 1")
def src_csv_rerank(spark, d):
    """Answer lists dumped as text and read again, cut to twenty."""
    lists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    dumped = lists.select("query_id", F.to_json(F.transform("l", lambda x: x["l_partkey"])).alias("results"))
    return dumped.select("query_id", F.array_join(files.answers_of(F.col("results")), ",").alias("answers"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE json_extract(props, '$.k')::INT END AS k, coalesce(event_type, '') AS status FROM events")
def src_csv_dump(spark, d):
    """Dump rows with a nested cell: every third is empty, which reads as null."""
    cell = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.col("props"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), files.nested(cell, "struct<k: int>")["k"].alias("k"), F.coalesce("event_type", F.lit("")).alias("status"))


@query("SELECT user_id AS query_id, max_by(value, event_id) AS mrr FROM events GROUP BY 1")
def src_csv_glob(spark, d):
    """Metric rows of many processes as CSV lines, parsed, the last row of a question kept."""
    from ..operators import runs

    lines = table(spark, d, "events").select(F.concat_ws(",", F.col("user_id"), F.format_string('"%s"', F.regexp_replace("props", '"', "'")), F.col("value")).alias("line"), "event_id")
    rows = lines.select(F.from_csv("line", "query_id bigint, query_text string, mrr double").alias("r"), "event_id").select("r.query_id", "r.mrr", "event_id")
    return runs.dedup(rows, ["query_id"], "event_id").select("query_id", "mrr")


@query("SELECT c.c_custkey AS query_id, o.n AS saved FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def jn_saved(spark, d):
    """Saved responses by id; null where there is none."""
    saved = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("query_id")).agg(F.count("*").alias("saved"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("query_id")).join(saved, "query_id", "left")


@query("SELECT c.c_custkey AS query_id, max_by(o_orderpriority, o_orderkey) AS response FROM customer c LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def src_saved_llm(spark, d):
    """The last recorded response of every question."""
    r = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("query_id")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("response"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("query_id")).join(r, "query_id", "left")


@query("SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_suppkey || ',' || (s_suppkey + 1) END AS candidates FROM supplier")
def src_saved_vss(spark, d):
    """Candidate lists replayed by question id; a question that is not there has none."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"))
    line = F.when(F.col("query_id") % 3 != 0, F.format_string('{"%d": [%d, %d]}', F.col("query_id"), F.col("query_id"), F.col("query_id") + 1)).otherwise(F.lit("{}"))
    found = F.coalesce(F.try_element_at(files.saved_candidates(line), F.col("query_id").cast("string")), F.array().cast("array<bigint>"))
    return s.select("query_id", F.array_join(found, ",").alias("candidates"))


@query("SELECT DISTINCT p_type AS src_type, p_brand AS relation, p_name AS dst_type FROM part")
def src_triplets(spark, d):
    """Schema lines, some with a comma at their end."""
    line = F.concat("p_type", F.lit(" --- "), "p_brand", F.lit(" ---> "), "p_name", F.when(F.col("p_partkey") % 2 == 0, ",").otherwise(""))
    a, r, b = files.triplet(line)
    return table(spark, d, "part").select(a.alias("src_type"), r.alias("relation"), b.alias("dst_type")).distinct()


@query("SELECT event_type AS error_type, count(*) AS n, min(event_id) AS first FROM events WHERE event_type = 'error' GROUP BY 1")
def snk_failed_csv(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").groupBy(F.col("event_type").alias("error_type")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("SELECT o_orderkey AS query_id, '[\"' || o_orderstatus || '\",\"' || o_orderpriority || '\"]' AS cell, '' AS blank FROM orders")
def snk_data_dump(spark, d):
    """Dump cells: lists as JSON, empty ones as nothing."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.array("o_orderstatus", "o_orderpriority").alias("cell"), F.array().cast("array<string>").alias("blank"))
    return rows.select(*[files._flat(f) for f in rows.schema.fields])


@query("SELECT count(*) AS total_queries, round(avg(o_totalprice), 4) AS avg_total FROM orders")
def snk_aggregate_csv(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("total_queries"), F.round(F.avg("o_totalprice"), 4).alias("avg_total"))


@query(f"""SELECT 1 AS "Method", 'orders' AS "Dataset", round(avg(hit_1), 6) AS "Hit@1", round(avg(hit_5), 6) AS "Hit@5", round(avg(mrr), 6) AS "MRR", round(avg(recall), 6) AS "Recall@20", count(*) AS "Num_queries" FROM ({ORACLES["ev_metrics_rr"]})""")
def snk_rerank_3files(spark, d):
    """The summary of the reranker's judgements; the lists and the judgements themselves are the other two files."""
    found = files.rerank_summary(evaluation.ev_metrics_rr(spark, d).withColumnRenamed("recall", "recall_20"), 1, "orders")
    return found.select(*(F.round(F.col(f"`{c}`"), 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in found.dtypes))


@query("""SELECT o_orderkey AS query_id, o_orderpriority AS query_text, (o_orderkey % 7)::INT AS total_answers, 0::INT AS retrieved_count, 0::INT AS missed_count, 0::DOUBLE AS "recall@50", 0.5::DOUBLE AS "recall@20", 0::DOUBLE AS "hit@1", CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END::DOUBLE AS "hit@5", 0::DOUBLE AS mrr, 0::DOUBLE AS "recall@20_alpha_12", 0.25::DOUBLE AS "recall@20_alpha_13" FROM orders""")
def snk_metrics_csv(spark, d):
    """Metric rows as they are appended: some columns are missing, some values null."""
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("query_text"), (F.col("o_orderkey") % 7).alias("total_answers"), F.lit(0.5).alias("recall@20"), F.when(F.col("o_orderkey") % 3 == 0, 1.0).alias("hit@5"), F.lit(0.25).alias("recall@20_alpha_13"))
    return files.metric_rows(rows, (12, 13))


@query("SELECT o_orderkey::VARCHAR AS query_id, '[\"' || o_orderstatus || '\"]' AS cell, '[]' AS blank, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS text FROM orders")
def snk_serialize_old(spark, d):
    """The earlier dump's cells: lists as JSON, empty ones too, nulls as nothing."""
    o = table(spark, d, "orders")
    return files.serialized(o.select(F.col("o_orderkey").alias("query_id"), F.array("o_orderstatus").alias("cell"), F.array().cast("array<string>").alias("blank"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("text")))
