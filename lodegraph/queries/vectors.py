"""Vector search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..operators import vectors as v
from ..sources import graph
from . import query

#: Answers asked for, and the cutoff of similarity for candidates.
K, CUTOFF = 20, 0.65
#: Parts that the nodes of one remainder are dealt to, each of which meets the remainder's questions in a place of its own.
DEALT = 64

EMB = """emb AS (SELECT vec_id AS node_id, 't' || label AS node_type, embedding::DOUBLE[] AS e FROM embeddings),
q AS (SELECT node_id AS query_id, node_type, e FROM emb WHERE node_id % 100 = 0),
alls AS (SELECT q.query_id, emb.node_id, emb.node_type, q.node_type AS query_type, round(list_inner_product(q.e, emb.e), 6) AS score FROM q, emb),
sim AS (SELECT query_id, node_id, node_type, score FROM alls WHERE node_type = query_type)"""


def _mask(spark, d):
    """For each question, nodes whose id leaves the question's remainder by 7."""
    n = graph.node_emb(spark, d).select("node_id", (F.col("node_id") % 7).alias("_r"), F.pmod(F.xxhash64("node_id"), F.lit(DEALT)).cast("int").alias("_part"))
    asked = graph.query_emb(spark, d).select("query_id", (F.col("query_id") % 7).alias("_r"), F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("_part"))
    return asked.join(n, ["_r", "_part"]).select("query_id", "node_id")


MASK = "mask AS (SELECT q.query_id, emb.node_id FROM q JOIN emb ON q.query_id % 7 = emb.node_id % 7)"
SHORT = "mask AS (SELECT q.query_id, emb.node_id FROM q JOIN emb ON emb.node_id // 10 = q.query_id // 10)"


def _short_mask(spark, d):
    n = graph.node_emb(spark, d).select("node_id")
    return graph.query_emb(spark, d).select("query_id").join(n, F.floor(F.col("query_id") / 10) == F.floor(F.col("node_id") / 10)).select("query_id", "node_id")


def all_scores(spark, d):
    """Every question against every node: the question set in blocks against all rows."""
    return v.every(graph.query_emb(spark, d), graph.node_emb(spark, d))


@query(f"WITH {EMB} SELECT * FROM sim")
def vss_similarities(spark, d):
    return v.similarities(graph.query_emb(spark, d), graph.node_emb(spark, d))


@query(f"WITH {EMB} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INT AS rank FROM sim QUALIFY rank <= {K}")
def vss_topk(spark, d):
    return v.top_k(graph.query_emb(spark, d), graph.node_emb(spark, d), K)


@query(f"WITH {EMB} SELECT query_id, node_id, node_type, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INT AS rank FROM alls QUALIFY rank <= {K}")
def vss_topk_multitype(spark, d):
    return v.top_k(graph.query_emb(spark, d), graph.node_emb(spark, d), K, typed=False)


@query(f"""WITH {EMB}, {SHORT}, first AS (SELECT a.query_id, a.node_id, a.node_type, a.score, row_number() OVER (PARTITION BY a.query_id ORDER BY score DESC, a.node_id)::INT AS rank FROM alls a SEMI JOIN mask m USING (query_id, node_id) QUALIFY rank <= {K}),
w AS (SELECT query_id, {K} - count(*) AS wanted FROM mask GROUP BY 1), h AS (SELECT query_id, count(*) AS hits FROM first GROUP BY 1),
rest AS (SELECT a.query_id, a.node_id, a.node_type, a.score, row_number() OVER (PARTITION BY a.query_id ORDER BY score DESC, a.node_id) AS r FROM alls a ANTI JOIN first f USING (query_id, node_id))
SELECT * FROM first UNION ALL SELECT query_id, node_id, node_type, score, (r + coalesce(hits, 0))::INT FROM rest JOIN w USING (query_id) LEFT JOIN h USING (query_id) WHERE r <= wanted""")
def vss_topk_complement(spark, d):
    return v.with_complement(graph.query_emb(spark, d), graph.node_emb(spark, d), _short_mask(spark, d), K)


@query(f"WITH {EMB} SELECT query_id, node_id, node_type, score FROM alls WHERE score >= {CUTOFF}")
def flt_cutoff(spark, d):
    return v.every(graph.query_emb(spark, d), graph.node_emb(spark, d), CUTOFF)


@query(f"WITH {EMB}, {MASK} SELECT query_id, node_id, node_type, score FROM alls SEMI JOIN mask USING (query_id, node_id)")
def flt_mask(spark, d):
    return v.masked(graph.query_emb(spark, d), graph.node_emb(spark, d), _mask(spark, d))


@query(f"WITH {EMB}, {MASK} SELECT query_id, node_id, node_type, score FROM alls ANTI JOIN mask USING (query_id, node_id)")
def flt_exclude(spark, d):
    return v.unmasked(graph.query_emb(spark, d), graph.node_emb(spark, d), _mask(spark, d))


@query(f"WITH {EMB}, {MASK} SELECT query_id, node_id, node_id AS ord, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INT AS rank FROM alls SEMI JOIN mask USING (query_id, node_id)")
def vss_rerank(spark, d):
    pairs = _mask(spark, d).withColumn("ord", F.col("node_id"))
    return v.reordered(pairs, graph.query_emb(spark, d), graph.node_emb(spark, d))


@query("SELECT 't' || label AS node_type, count(*) AS nodes FROM embeddings GROUP BY 1 UNION ALL SELECT 'absent', 0")
def vss_stats(spark, d):
    n = graph.node_emb(spark, d)
    asked = n.select("node_type").union(spark.createDataFrame([("absent",)], "node_type string"))
    return v.type_counts(n, asked)


@query("SELECT 't' || label AS node_type, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS ids FROM embeddings GROUP BY 1")
def src_node_ids_by_type(spark, d):
    ids = graph.node_emb(spark, d).groupBy("node_type").agg(F.array_sort(F.collect_list("node_id")).alias("ids"))
    return ids.select("node_type", F.array_join("ids", ",").alias("ids"))


@query(f"WITH {EMB} SELECT query_id, node_id, node_type, score, row_number() OVER (PARTITION BY query_id, node_type ORDER BY score DESC, node_id)::INT AS rank FROM alls QUALIFY rank <= {K}", name="vss_v1")
def vss_v1(spark, d):
    """The same search with every type ranked by itself."""
    return v.top_k(graph.query_emb(spark, d), graph.node_emb(spark, d), K, typed=False, by_type=True)


@query(f"WITH {EMB} SELECT q.query_id, emb.node_id, round(list_inner_product(q.e, emb.e), 6) AS score FROM q JOIN emb USING (node_type)")
def jn_query_nodes(spark, d):
    return v.similarities(graph.query_emb(spark, d), graph.node_emb(spark, d)).drop("node_type")


@query("""WITH t AS (SELECT vec_id AS query_id, 'text ' || (vec_id % 50) AS text FROM embeddings)
SELECT query_id, text, CASE WHEN query_id % 50 < 20 THEN 'text' WHEN query_id % 3 = 0 THEN 'query' WHEN query_id % 50 < 40 THEN 'remembered' ELSE 'provider' END AS source FROM t""")
def jn_emb_lookup(spark, d):
    """Every vector's text looked up among known texts (the first 20 of 50), questions (each third), and remembered ones (up to 40)."""
    n = graph.node_emb(spark, d)
    texts = n.select(F.col("node_id").alias("query_id"), F.format_string("text %d", F.col("node_id") % 50).alias("text"))
    known = n.where("node_id < 50").select(F.format_string("text %d", F.col("node_id")).alias("text"), "embedding", "node_id")
    by_query = n.where("node_id % 3 = 0").select(F.col("node_id").alias("query_id"), "embedding")
    return v.vectors_for(texts, known.where("node_id < 20"), by_query, known.where("node_id < 40")).select("query_id", "text", "source")


@query("SELECT 'text ' || (vec_id % 50) || CASE WHEN vec_id % 4 = 0 THEN '' ELSE '_' || (vec_id % 4) END AS key, max(vec_id) AS last, (SELECT count(*) FROM (SELECT DISTINCT vec_id % 50, vec_id % 4 FROM embeddings)) AS size FROM embeddings GROUP BY 1")
def vss_cache(spark, d):
    """Vectors remembered by their text and the id's remainder by 4, of which 0 is no id, in two steps: the last one of a key stays."""
    n = graph.node_emb(spark, d)
    new = n.select(F.format_string("text %d", F.col("node_id") % 50).alias("text"), (F.col("node_id") % 4).alias("query_id"), F.array(F.col("node_id")).alias("embedding"), F.col("node_id").alias("seq"))
    none = spark.createDataFrame([], "key string, embedding array<bigint>")
    half = n.agg((F.max("node_id") / 2).alias("h"))
    early, late = (new.join(F.broadcast(half), F.lit(True)).where(x).drop("h") for x in ("seq <= h", "seq > h"))  # one row
    held = v.VectorCache(none).put(early).put(late)
    asked = new.select("text", "query_id").distinct()
    found = held.get(asked).select(v.cache_key("text", "query_id").alias("key"), F.col("embedding")[0].alias("last"))
    return found.join(F.broadcast(held.held.agg(F.count("*").alias("size"))), F.lit(True))  # one row


FLAGSHIP = f"""WITH {EMB}, found AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM alls WHERE node_id <> query_id QUALIFY rank <= {K}),
truth AS (SELECT query_id, node_id FROM sim WHERE node_id <> query_id),
per AS (SELECT t.query_id, count(*) AS total, max((rank = 1)::INT) AS h1, max((rank <= 5)::INT) AS h5, min(rank) AS first, count(rank) AS got FROM truth t LEFT JOIN found USING (query_id, node_id) GROUP BY 1)
SELECT count(*) AS queries, round(avg(coalesce(h1, 0)), 6) AS hit_1, round(avg(coalesce(h5, 0)), 6) AS hit_5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(got / total), 6) AS recall_20 FROM per"""


@query(FLAGSHIP)
def flagship(spark, d):
    """Question vectors searched over all types, itself left out; truths are the vectors of the question's label."""
    q, n = graph.query_emb(spark, d), graph.node_emb(spark, d)
    found = v.top_k(q, n, K + 1, typed=False).where("node_id <> query_id")
    found = v.ranked(found.drop("rank"), ["query_id"]).where(F.col("rank") <= K)
    per = metrics.per_query_of_groups(found, q, n.select("node_id", "node_type"), itself=False)
    return per.agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 6).alias(c) for c in ("hit_1", "hit_5", "mrr", "recall_20")))
