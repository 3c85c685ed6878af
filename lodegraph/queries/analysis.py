"""Template and failure analysis queries. Brands stand for templates, suppliers' lines for questions' relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import analysis as a
from ..sources.tables import table
from . import query

TEMPLATES = "t AS (SELECT n_nationkey AS \"Id\", n_name AS \"Template\", n_nationkey % 4 AS hops FROM nation)"


def _templates(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("Id"), F.col("n_name").alias("Template"), (F.col("n_nationkey") % 4).alias("hops"))


def _tagged(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 6 != 0, F.col("user_id") % 30).alias("template_id"))


@query(f"WITH {TEMPLATES}, e AS (SELECT event_id, CASE WHEN user_id % 6 <> 0 THEN user_id % 30 END AS template_id FROM events) SELECT event_id, template_id, \"Template\" AS template, hops FROM e LEFT JOIN t ON template_id = \"Id\"")
def jn_template_left(spark, d):
    return a.with_template(_tagged(spark, d), _templates(spark, d)).select("event_id", "template_id", F.col("Template").alias("template"), "hops")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def jn_id_left(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")).join(n, "id", "left")


@query("SELECT c_custkey AS id, coalesce(m, c_mktsegment) AS response FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def jn_update_by_id(spark, d):
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("response"))
    return a.filled(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("response")), new, "id", "response").select("id", "response")


@query("SELECT event_id AS id, event_type AS category, try_cast(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def prj_select(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.get_json_object("props", "$.k").try_cast("double").alias("k"))


@query("SELECT event_id, json_extract(props, '$.k')::INT AS hit, 0 AS recall FROM events")
def prj_extract_metrics(spark, d):
    """Metrics out of a nested result; one that is not there is 0."""
    m = F.from_json("props", "struct<k: int, recall: int>")
    return table(spark, d, "events").select("event_id", m["k"].alias("hit"), F.coalesce(m["recall"], F.lit(0)).alias("recall"))


@query("WITH r AS (SELECT l_orderkey AS query_id, least(l_suppkey % 5, l_partkey % 5) AS lo, greatest(l_suppkey % 5, l_partkey % 5) AS hi, min((l_linenumber, l_partkey, l_suppkey)) AS at, min_by(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) AS relation FROM lineitem GROUP BY 1, 2, 3) SELECT query_id, lo, hi, relation FROM r")
def prj_relation_format(spark, d):
    """The first relation between two symbols, whichever way it points."""
    r = _relations(spark, d)
    kept = a.first_relations(r.withColumn("a", F.col("l_suppkey") % 5).withColumn("b", F.col("l_partkey") % 5))
    return kept.select("query_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "relation")


def _relations(spark, d):
    """Lines as relations of orders: from the supplier's symbol to the part's, in the order of lines."""
    t = table(spark, d, "lineitem")
    return t.select(F.col("l_orderkey").alias("query_id"), "l_suppkey", "l_partkey", F.col("l_returnflag").alias("relation"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"))


PATHS = """WITH RECURSIVE x AS (SELECT l_orderkey AS query_id, CASE l_suppkey % 5 WHEN 0 THEN 'ANSWER' ELSE 'S' || l_suppkey % 5 END AS a, CASE l_partkey % 5 WHEN 0 THEN 'ANSWER' ELSE 'S' || l_partkey % 5 END AS b, l_returnflag AS relation, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord FROM lineitem),
k AS (SELECT query_id, a, b, relation, ord FROM x QUALIFY row_number() OVER (PARTITION BY query_id, least(a, b), greatest(a, b) ORDER BY ord) = 1), s AS (SELECT query_id, a, b, relation, ord FROM k UNION ALL SELECT query_id, b, a, relation, ord FROM k),
p(query_id, symbol, hops, path, way, been) AS (SELECT DISTINCT query_id, 'ANSWER', 0, 'ANSWER', []::BIGINT[], ['ANSWER'] FROM s WHERE a = 'ANSWER' UNION ALL
SELECT p.query_id, s.b, p.hops + 1, p.path || ' -[' || s.relation || ']-> ' || s.b, list_append(p.way, s.ord), list_append(p.been, s.b) FROM p JOIN s ON s.query_id = p.query_id AND s.a = p.symbol WHERE p.hops < 4 AND NOT list_contains(p.been, s.b)),
best AS (SELECT query_id, symbol, hops, path FROM p QUALIFY row_number() OVER (PARTITION BY query_id, symbol ORDER BY hops, way) = 1)"""


def _symbolic(spark, d):
    from pyspark.sql import Window

    r = _relations(spark, d)
    name = lambda c: F.when(F.col(c) % 5 == 0, F.lit("ANSWER")).otherwise(F.concat(F.lit("S"), F.col(c) % 5))
    return r.select("query_id", name("l_suppkey").alias("a"), name("l_partkey").alias("b"), "relation", F.row_number().over(Window.partitionBy("query_id").orderBy("ord")).alias("ord"))


@query(f"{PATHS} SELECT * FROM best")
def fn_bfs_paths(spark, d):
    """Every order's shortest ways from its answer symbol."""
    return a.shortest_paths(_symbolic(spark, d))


@query(f"{PATHS} SELECT path, count(*) AS n FROM best GROUP BY 1 ORDER BY n DESC, path LIMIT 20")
def ag_path_counts(spark, d):
    return a.path_counts(a.shortest_paths(_symbolic(spark, d)))


@query("SELECT l_orderkey AS query_id, 'ANSWER -[' || l_returnflag || ']-> t' || l_partkey % 3 || ' -[' || l_linestatus || ']-> B' AS path, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier FROM lineitem")
def fn_path_to_types(spark, d):
    """Paths of two steps with symbol A replaced by its type; B has none."""
    t = table(spark, d, "lineitem")
    edges = F.array(F.struct(F.lit("ANSWER").alias("a"), F.col("l_returnflag").alias("relation"), F.lit("A").alias("b")), F.struct(F.lit("A").alias("a"), F.col("l_linestatus").alias("relation"), F.lit("B").alias("b")))
    types = F.create_map(F.lit("A"), F.concat(F.lit("t"), F.col("l_partkey") % 3))
    return t.select(F.col("l_orderkey").alias("query_id"), parsing.edge_types(edges, types).alias("path"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))


STRUCT = "SELECT l_orderkey AS query_id, count(DISTINCT l_partkey % 6)::INT AS n_types, string_agg(DISTINCT 't' || l_partkey % 6, ',' ORDER BY 't' || l_partkey % 6) AS types, count(DISTINCT l_returnflag)::INT AS n_relations, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS relations FROM lineitem GROUP BY 1"


def _structure(spark, d):
    t = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "query_id")
    return a.structure(t.select("query_id", F.concat(F.lit("t"), F.col("l_partkey") % 6).alias("type")), t.select("query_id", F.col("l_returnflag").alias("relation")))


@query(f"SELECT query_id, n_types, types FROM ({STRUCT})")
def fn_entity_types(spark, d):
    return _structure(spark, d).select("query_id", "n_types", F.array_join("types", ",").alias("types"))


@query(f"SELECT query_id, n_relations, relations FROM ({STRUCT})")
def fn_relation_types(spark, d):
    return _structure(spark, d).select("query_id", "n_relations", F.array_join("relations", ",").alias("relations"))


def _causes_sql(same: str) -> str:
    return f"""WITH r AS (SELECT p_partkey AS id, (p_partkey % 5) / 4.0::DOUBLE AS recall, list_distinct([lower(p_name), lower(p_type)]) AS ge, list_distinct(CASE WHEN p_partkey % 2 = 0 THEN [lower(p_name)] ELSE [lower(p_brand)] END) AS pe, ['linked to', 'ppi'] AS gr, CASE WHEN p_partkey % 3 = 0 THEN ['linked_to', 'ppi'] ELSE ['ppi'] END AS pr FROM part),
n AS (SELECT id, recall, {same('ge')} AS ge, {same('pe')} AS pe, {same('gr')} AS gr, {same('pr')} AS pr FROM r), m AS (SELECT id, recall, len(list_intersect(ge, pe)) / len(ge) AS e, len(list_intersect(gr, pr)) / len(gr) AS rr FROM n)
SELECT id, round(e, 6) AS entity_match, round(rr, 6) AS relation_match, CASE WHEN recall = 1 THEN 'success' WHEN recall > 0 THEN 'partial_retrieval' WHEN e <= 0.7 AND rr <= 0.7 THEN 'entity+relation_error' WHEN e < rr THEN 'entity_error' WHEN rr < e THEN 'relation_error' ELSE 'reasoning error' END AS cause FROM m"""


def _causes(spark, d, mode):
    i = F.col("p_partkey")
    rows = table(spark, d, "part").select(i.alias("id"), ((i % 5) / 4.0).alias("recall"), F.concat_ws(", ", "p_name", "p_type").alias("gt_entities"), F.when(i % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand")).alias("entities"), F.lit("linked to, ppi").alias("gt_relations"), F.when(i % 3 == 0, "linked_to, ppi").otherwise("ppi").alias("relations"))
    return a.failure_causes(rows, mode).select("id", F.round("entity_match", 6).alias("entity_match"), F.round("relation_match", 6).alias("relation_match"), "cause")


@query(_causes_sql(lambda c: c))
def an_failure_causes(spark, d):
    return _causes(spark, d, "strict")


@query(_causes_sql(lambda c: f"list_transform({c}, lambda x: replace(x, ' ', '_'))"))
def an_failure_causes_normalised(spark, d):
    return _causes(spark, d, "normalised")


@query(f"WITH {TEMPLATES} SELECT \"Id\" AS id, \"Template\" AS template, hops FROM t")
def src_templates(spark, d):
    return _templates(spark, d).select(F.col("Id").alias("id"), F.col("Template").alias("template"), "hops")
