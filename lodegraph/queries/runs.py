"""Queries over rows of earlier runs: an event is a row of user ``user_id``'s question, in the order of event ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs
from ..sources.tables import table
from . import query

STATUS = "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'FALLBACK' WHEN 'signup' THEN 'SKIPPED' ELSE 'SUCCESS' END"
ROWS = f"r AS (SELECT user_id AS query_id, event_id AS seq, value, {STATUS} AS status FROM events)"


def rows(spark, d):
    kind = F.col("event_type")
    status = F.when(kind == "error", "FAILED").when(kind == "click", "FALLBACK").when(kind == "signup", "SKIPPED").otherwise("SUCCESS")
    return table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("seq"), "value", status.alias("status"))


@query(f"WITH {ROWS} SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY seq DESC) = 1")
def so_dedup_last(spark, d):
    return runs.dedup(rows(spark, d), ["query_id"], "seq")


@query(f"WITH {ROWS} SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, status ORDER BY seq) = 1")
def so_dedup_first(spark, d):
    return runs.dedup(rows(spark, d), ["query_id", "status"], "seq", "first")


@query(f"WITH {ROWS} SELECT query_id, seq, value, status, NULL::DOUBLE AS total FROM r UNION ALL SELECT o_custkey, o_orderkey, NULL, o_orderstatus, o_totalprice FROM orders")
def so_union_all(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    return runs.union_all([rows(spark, d), o])


@query("WITH p AS (SELECT l_orderkey AS query_id, list(l_partkey % 50 ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY 1), u AS (SELECT query_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM p), f AS (SELECT query_id, x, min(i) AS i FROM u GROUP BY 1, 2) SELECT query_id, string_agg(x::VARCHAR, ',' ORDER BY i) AS answers FROM f GROUP BY 1")
def so_ordered_distinct(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    return p.select("query_id", F.array_join(F.array_distinct(F.transform("a", lambda x: x["l_partkey"] % 50)), ",").alias("answers"))


@query("SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS a, 'first' AS b FROM orders")
def so_dict_update(spark, d):
    """Two maps joined; where both have a key the later one's value stands."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    first = F.create_map(F.lit("a"), F.lit("first"), F.lit("b"), F.lit("first"))
    second = F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("a"), F.lit("second"))).otherwise(F.from_json(F.lit("{}"), "map<string,string>"))
    m = F.map_concat(first, second)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), m["a"].alias("a"), m["b"].alias("b"))


@query("WITH p AS (SELECT l_orderkey AS query_id, list(DISTINCT l_partkey % 9) AS a, list(DISTINCT l_suppkey % 9) AS b FROM lineitem GROUP BY 1) SELECT query_id, len(list_intersect(a, b))::INT AS both, (len(a) - len(list_intersect(a, b)))::INT AS only_a FROM p")
def so_set_ops(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.collect_set(F.col("l_partkey") % 9).alias("a"), F.collect_set(F.col("l_suppkey") % 9).alias("b"))
    return p.select("query_id", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_except("a", "b")).alias("only_a"))


@query("WITH n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey AS query_id, (o_orderkey // ceil(n / 7)::BIGINT)::INT AS batch FROM orders, n")
def so_batch_split(spark, d):
    return runs.batches(table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id")), "query_id", 7)


@query("SELECT c_custkey AS query_id, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def jn_anti_resume(spark, d):
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), "c_name")
    return runs.resume(q, table(spark, d, "orders").select(F.col("o_custkey").alias("query_id")))


@query(f"WITH {ROWS} SELECT *, 'retry' AS chosen FROM r WHERE status IN ('FAILED', 'FALLBACK') UNION ALL SELECT *, 'skipped' FROM r WHERE status = 'SKIPPED' UNION ALL SELECT *, 'kept' FROM r WHERE status NOT IN ('FAILED', 'FALLBACK')")
def flt_status(spark, d):
    r = rows(spark, d)
    again, kept = runs.select(r, "retry")
    skipped, _ = runs.select(r, "skipped")
    return runs.union_all([again.withColumn("chosen", F.lit("retry")), skipped.withColumn("chosen", F.lit("skipped")), kept.withColumn("chosen", F.lit("kept"))])


@query(f"WITH {ROWS} SELECT * FROM r WHERE query_id IN (3, 5, 8)")
def flt_query_ids(spark, d):
    return runs.select(rows(spark, d), "ids", ids=(3, 5, 8))[0]


@query("SELECT event_id, template_id FROM (SELECT event_id, CASE WHEN user_id % 5 = 4 THEN NULL ELSE user_id % 5 END AS template_id FROM events) WHERE template_id IS DISTINCT FROM 0")
def flt_template_nonzero(spark, d):
    """Null templates pass."""
    t = F.when(F.col("user_id") % 5 != 4, F.col("user_id") % 5)
    return table(spark, d, "events").select("event_id", t.alias("template_id")).where(~F.col("template_id").eqNullSafe(0))


@query("SELECT o_orderkey AS query_id FROM orders ORDER BY 1 LIMIT (SELECT count(*) * 10 // 100 FROM orders)")
def src_qa_split(spark, d):
    """The first tenth of the split."""
    return runs.head_share(table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id")), "query_id")


@query("SELECT o_orderkey AS query_id FROM orders ORDER BY 1 LIMIT (SELECT least(100, count(*) * 10 // 100) FROM orders)")
def src_qa_split_old(spark, d):
    """The first tenth of the split, and in a test run a hundred of these."""
    return runs.head_share(table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id")), "query_id", limit=100)


@query("SELECT o_orderkey AS query_id, o_orderpriority AS query FROM orders WHERE o_orderstatus = 'F'")
def src_train_queries(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("query"))


@query("""WITH a AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, props AS response, value > 50 AS ok FROM events)
SELECT query_id, min_by(response, attempt) FILTER (ok) AS response, min(attempt) FILTER (ok)::INT AS attempt, count(*) AS tried, CASE WHEN min(attempt) FILTER (ok) IS NULL THEN 'SKIPPED' ELSE 'OK' END AS status FROM a WHERE attempt <= 3 GROUP BY 1""")
def run_first_usable(spark, d):
    """The first of three attempts that can be used, else the question is skipped."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    a = table(spark, d, "events").select(F.col("user_id").alias("query_id"), n.alias("attempt"), F.col("props").alias("response"), (F.col("value") > 50).alias("ok"))
    return runs.first_usable(a, ["query_id"], F.col("ok"))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_window FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)")
def rr_rate_limit(spark, d):
    """Calls of a key within the last hour."""
    e = table(spark, d, "events").select("event_id", "user_id", F.date_trunc("second", "ts").alias("ts"))
    return runs.within_rate(e, "user_id", "ts", 10, 3600).select("event_id", "user_id", "in_window")
