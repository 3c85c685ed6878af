"""Judging and reporting queries. Questions are the orders: answers their lines' parts, truths the returned ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..sources import graph
from ..sources.tables import table
from . import query

TRUTH = """pred AS (SELECT l_orderkey AS query_id, l_linenumber AS rank, l_partkey AS node_id FROM lineitem),
truth AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS node_id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT o_orderkey, o_orderkey FROM orders),
best AS (SELECT query_id, node_id, min(rank) AS rank FROM pred GROUP BY 1, 2),
e AS (SELECT t.query_id, b.rank FROM truth t LEFT JOIN best b USING (query_id, node_id))"""
PER = f"""{TRUTH}, per AS (SELECT query_id, coalesce(max((rank <= 1)::INT), 0)::DOUBLE AS hit_1, coalesce(max((rank <= 5)::INT), 0)::DOUBLE AS hit_5, coalesce(1.0 / min(rank), 0)::DOUBLE AS mrr,
count(*) FILTER (rank <= 3) / count(*) AS recall_3, count(rank) / count(*) AS recall_all, count(*) AS total_answers, count(rank) AS retrieved_count, count(*) - count(rank) AS missed_count FROM e GROUP BY 1)"""


def judged(spark, d):
    """Every order's judgement; recall_20 is taken at the first three lines."""
    return metrics.per_query(graph.order_predictions(spark, d), graph.order_truths(spark, d), cut=3).withColumnRenamed("recall_20", "recall_3")


@query(f"WITH {PER} SELECT * REPLACE (round(mrr, 9) AS mrr, round(recall_3, 9) AS recall_3, round(recall_all, 9) AS recall_all) FROM per")
def ev_metrics(spark, d):
    return judged(spark, d).withColumns({c: F.round(c, 9) for c in ("mrr", "recall_3", "recall_all")})


@query(f"WITH {TRUTH} SELECT query_id, coalesce(max((rank <= 1)::INT), 0)::DOUBLE AS hit_1, coalesce(max((rank <= 5)::INT), 0)::DOUBLE AS hit_5, round(coalesce(1.0 / min(rank), 0)::DOUBLE, 9) AS mrr, round(count(rank) / count(*), 9) AS recall FROM e GROUP BY 1")
def ev_metrics_rr(spark, d):
    per = metrics.per_query(graph.order_predictions(spark, d), graph.order_truths(spark, d), cut=None)
    return per.select("query_id", "hit_1", "hit_5", F.round("mrr", 9).alias("mrr"), F.round("recall_20", 9).alias("recall"))


@query(f"""WITH {TRUTH}, p AS (SELECT query_id, min(rank) AS first, count(rank) / count(*) AS recall FROM e GROUP BY 1)
SELECT round(avg(coalesce((first <= 1)::INT, 0)), 9) AS hit_1, round(avg(coalesce((first <= 5)::INT, 0)), 9) AS hit_5, round(avg(coalesce((first <= 10)::INT, 0)), 9) AS hit_10, round(avg(coalesce((first <= 20)::INT, 0)), 9) AS hit_20,
round(avg(coalesce(1.0 / first, 0)), 9) AS mrr, round(avg(recall), 9) AS recall FROM p""")
def ev_metrics_multi_k(spark, d):
    ks = (1, 5, 10, 20)
    per = metrics.per_query(graph.order_predictions(spark, d), graph.order_truths(spark, d), hits=ks)
    return per.agg(*(F.round(F.avg(f"hit_{k}"), 9).alias(f"hit_{k}") for k in ks), F.round(F.avg("mrr"), 9).alias("mrr"), F.round(F.avg("recall_all"), 9).alias("recall"))


@query("""WITH p AS (SELECT l_orderkey AS query_id, list_distinct(list(l_partkey)) AS a, list_distinct(coalesce(list(l_partkey) FILTER (l_returnflag = 'R'), []) || [l_orderkey]) AS t FROM lineitem GROUP BY 1)
SELECT query_id, coalesce(array_to_string(list_sort(list_intersect(a, t)), ','), '') AS found, coalesce(array_to_string(list_sort(list_filter(t, lambda x: NOT list_contains(a, x))), ','), '') AS missed FROM p""")
def ev_set_ops(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.collect_set("l_partkey").alias("a"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("r"))
    p = p.withColumn("t", F.array_union("r", F.array("query_id")))
    found, missed = metrics.set_difference("a", "t")
    return p.select("query_id", F.array_join(F.array_sort(found), ",").alias("found"), F.array_join(F.array_sort(missed), ",").alias("missed"))


@query(f"WITH {PER} SELECT count(*) AS total_queries, round(avg(hit_1), 9) AS avg_hit_1, round(avg(hit_5), 9) AS avg_hit_5, round(avg(mrr), 9) AS avg_mrr, round(avg(recall_3), 9) AS avg_recall_3, round(avg(total_answers), 9) AS avg_total_answers, round(avg(retrieved_count), 9) AS avg_retrieved_count FROM per")
def ag_macro(spark, d):
    return _rounded(metrics.macro(judged(spark, d), ["hit_1", "hit_5", "mrr", "recall_3", "total_answers", "retrieved_count", "not_there"]))


def _rounded(df):
    return df.withColumns({c: F.round(c, 9) for c, t in df.dtypes if t == "double"})


#: Rows of a report: events as questions, with gaps. Kinds of event stand for outcomes.
REPORT = "r AS (SELECT event_id AS query_id, event_type AS category, user_id % 4 AS hops, user_id % 7 AS template_id, (event_id % 101) / 100.0::DOUBLE AS before, CASE WHEN event_id % 11 = 0 THEN NULL ELSE least(1.0, (user_id % 101) / 100.0)::DOUBLE END AS after, props AS query FROM events)"


def report(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("query_id"), F.col("event_type").alias("category"), (F.col("user_id") % 4).alias("hops"), (F.col("user_id") % 7).alias("template_id"),
        ((F.col("event_id") % 101) / 100.0).alias("before"), F.when(F.col("event_id") % 11 != 0, F.least(F.lit(1.0), (F.col("user_id") % 101) / 100.0)).alias("after"), F.col("props").alias("query"),
    )


@query(f"WITH {REPORT} SELECT count(*) AS total_queries, round(avg(before), 9) AS avg_before, round(avg(after), 9) AS avg_after FROM r")
def ag_macro_old(spark, d):
    return _rounded(metrics.macro(report(spark, d), ["before", "after"], "skip"))


@query("SELECT count(*) AS total_queries, round(avg(coalesce(try_cast(CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'bad' ELSE value::VARCHAR END AS DOUBLE), 0)), 6) AS avg_value FROM events")
def ag_macro_csv(spark, d):
    text = table(spark, d, "events").select(F.when(F.col("event_id") % 11 == 0, F.lit("")).when(F.col("event_id") % 13 == 0, F.lit("bad")).otherwise(F.col("value").cast("string")).alias("value"))
    found = metrics.macro(text, ["value"])
    return found.select("total_queries", F.round("avg_value", 6).alias("avg_value"))


@query(f"WITH {REPORT} SELECT count(*) AS total_queries, round(avg(coalesce(before, 0)), 9) AS avg_before, round(avg(coalesce(after, 0)), 9) AS avg_after FROM r")
def ag_report_mean(spark, d):
    return _rounded(metrics.macro(report(spark, d), ["before", "after", "absent"]))


@query(f"WITH {PER} SELECT count(*) AS num_queries, round(avg(hit_1), 9) AS hit_1, round(avg(hit_5), 9) AS hit_5, round(avg(mrr), 9) AS mrr, round(avg(recall_all), 9) AS recall_20 FROM per")
def ag_rerank_mean(spark, d):
    per = judged(spark, d)
    return per.agg(F.count("*").alias("num_queries"), *(F.round(F.avg(c), 9).alias(o) for c, o in (("hit_1", "hit_1"), ("hit_5", "hit_5"), ("mrr", "mrr"), ("recall_all", "recall_20"))))


@query(f"""WITH {REPORT}, b(bucket, lo, hi) AS (VALUES ('0 (miss)', 0.0, 0.01), ('0–0.25', 0.01, 0.25), ('0.25–0.5', 0.25, 0.5), ('0.5–0.75', 0.5, 0.75), ('0.75–1.0', 0.75, 0.99), ('1.0 (full)', 0.99, 1.001)),
c AS (SELECT bucket, count(query_id) AS n FROM b LEFT JOIN r ON coalesce(after, 0) >= lo::DOUBLE AND coalesce(after, 0) < hi::DOUBLE GROUP BY 1), t AS (SELECT count(*) AS total FROM r)
SELECT bucket, n, repeat('█', floor(n / total * 40)::INT) AS bar FROM c, t""")
def ag_histogram(spark, d):
    return metrics.histogram(report(spark, d), "after")


@query(f"""WITH {REPORT}, x AS (SELECT coalesce(after, 0) - coalesce(before, 0) AS d FROM r)
SELECT count(*) FILTER (d > 0) AS improved, count(*) FILTER (d < 0) AS hurt, count(*) FILTER (d = 0) AS same, round(avg(d) FILTER (d > 0), 9) AS mean_gain, round(avg(d) FILTER (d < 0), 9) AS mean_loss, round(avg(d), 9) AS mean_delta FROM x""")
def ag_delta(spark, d):
    return _rounded(metrics.deltas(report(spark, d), "before", "after"))


@query(f"WITH {REPORT} SELECT query_id, query[1:60] AS query, round(after - before, 9) AS delta FROM r WHERE after IS NOT NULL ORDER BY after - before, query_id LIMIT 5")
def ag_worst5(spark, d):
    return _rounded(metrics.worst(report(spark, d), "before", "after"))


@query(f"WITH {REPORT} SELECT template_id, count(*) AS total, sum((coalesce(after, 0) > 0)::INT)::BIGINT AS success, count(*) - sum((coalesce(after, 0) > 0)::INT)::BIGINT AS failure FROM r WHERE template_id <> 0 GROUP BY 1")
def ag_template(spark, d):
    r = report(spark, d).where("template_id <> 0").withColumn("ok", F.coalesce(F.col("after") > 0, F.lit(False)).cast("int"))
    return r.groupBy("template_id").agg(F.count("*").alias("total"), F.sum("ok").alias("success"), (F.count("*") - F.sum("ok")).alias("failure"))


@query(f"WITH {REPORT} SELECT hops, round(avg(before), 9) AS before, round(avg(after), 9) AS after FROM r GROUP BY 1")
def ag_hops(spark, d):
    return _rounded(report(spark, d).groupBy("hops").agg(F.avg("before").alias("before"), F.avg("after").alias("after")))


@query(f"WITH {REPORT} SELECT hops, template_id, category, round(avg(after), 9) AS recall, count(*) AS n FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 5")
def ag_structure(spark, d):
    g = report(spark, d).groupBy("hops", "template_id", "category").agg(F.round(F.avg("after"), 9).alias("recall"), F.count("*").alias("n"))
    return g.where("n >= 5").orderBy("hops", "template_id", "category")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 5")
def flt_min_group(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 5")


@query("SELECT event_type AS value, count(*) AS n, round(count(*) / (sum(count(*)) OVER ()), 9) AS share FROM events GROUP BY 1")
def ag_value_counts(spark, d):
    return _rounded(metrics.shares(table(spark, d, "events"), "event_type"))


_KINDS = ("click", "error", "purchase", "signup", "view", "absent")


@query(f"WITH {REPORT} SELECT hops, " + ", ".join(f"round(count(*) FILTER (category = '{k}') / count(*), 9) AS \"{k}\"" for k in _KINDS) + " FROM r GROUP BY 1")
def ag_group_norm_pivot(spark, d):
    return _rounded(metrics.group_shares(report(spark, d), "hops", "category", _KINDS))


@query(f"WITH {REPORT} SELECT template_id, " + ", ".join(f"round(count(*) FILTER (category = '{k}') / count(*), 9) AS \"{k}\"" for k in _KINDS[:5]) + " FROM r GROUP BY 1")
def ag_crosstab_norm(spark, d):
    return _rounded(metrics.group_shares(report(spark, d), "template_id", "category", _KINDS[:5]))


@query(f"WITH {REPORT} SELECT template_id, round(avg(before), 9) AS entity_match, round(avg(after), 9) AS relation_match FROM r GROUP BY 1")
def ag_match_by_template(spark, d):
    return _rounded(report(spark, d).groupBy("template_id").agg(F.avg("before").alias("entity_match"), F.avg("after").alias("relation_match")))


@query(f"WITH {REPORT} SELECT category, round(avg(after), 9) AS recall, count(*) AS n FROM r GROUP BY 1")
def ag_category(spark, d):
    return _rounded(report(spark, d).groupBy("category").agg(F.avg("after").alias("recall"), F.count("*").alias("n")).orderBy(F.col("recall").desc(), "category"))


@query("SELECT event_type AS error_type, count(*) AS n FROM events WHERE event_type IN ('error', 'view') GROUP BY 1")
def ag_error_counts(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("error", "view")).groupBy(F.col("event_type").alias("error_type")).agg(F.count("*").alias("n"))


@query(f"WITH {TRUTH} SELECT max(n) AS max_truths FROM (SELECT count(*) AS n FROM truth GROUP BY query_id)")
def ag_max(spark, d):
    return graph.order_truths(spark, d).groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("max_truths"))
