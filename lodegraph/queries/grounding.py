"""Candidate and grounding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates as c
from ..operators import grounding as g
from ..operators import vectors as v
from ..sources import graph
from ..sources.tables import table
from . import query
from .vectors import EMB, all_scores

KG_NODES = "nodes AS (SELECT r_regionkey::BIGINT AS node_id, 'region' AS node_type, r_name AS name FROM region UNION ALL SELECT 1000000000000 + n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 2000000000000 + c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 3000000000000 + s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 4000000000000 + p_partkey, 'part', p_name FROM part)"
KG_EDGES = """one AS (SELECT 1000000000000 + n_nationkey AS src, 'in_region' AS relation, n_regionkey::BIGINT AS dst FROM nation UNION ALL SELECT 2000000000000 + c_custkey, 'in_nation', 1000000000000 + c_nationkey FROM customer
UNION ALL SELECT 3000000000000 + s_suppkey, 'in_nation', 1000000000000 + s_nationkey FROM supplier UNION ALL SELECT 4000000000000 + l_partkey, 'supplied_by', 3000000000000 + l_suppkey FROM lineitem),
edges AS (SELECT DISTINCT src, relation, dst FROM one UNION SELECT DISTINCT dst, relation, src FROM one)"""
V_EDGES = "cnt AS (SELECT count(*) AS n FROM embeddings), one AS (SELECT vec_id AS src, 'r0' AS relation, (vec_id * 7 + 1) % n AS dst FROM embeddings, cnt UNION ALL SELECT vec_id, 'r1', (vec_id * 13 + 5) % n FROM embeddings, cnt), edges AS (SELECT src, relation, dst FROM one UNION SELECT dst, relation, src FROM one)"
STATE = f"""{EMB}, top AS (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INT AS seq FROM sim QUALIFY seq <= 20),
cand AS (SELECT query_id, 'A' AS symbol, node_id, score, (1 + node_id % 3)::INT AS support, node_id % 4 = 0 AS processed, seq FROM top),
pop AS (SELECT * FROM cand WHERE NOT processed QUALIFY row_number() OVER (PARTITION BY query_id, symbol ORDER BY support DESC, score DESC, node_id) = 1)"""
RELS = "rels AS (SELECT q.query_id, r.* FROM q, (VALUES ('A', 'B', 'r0', 1), ('B', 'ANSWER', 'r1', 2), ('A', 'ANSWER', 'r1', 3)) r(src_sym, dst_sym, relation, ord)), adj AS (SELECT query_id, src_sym AS symbol, dst_sym AS other, relation, ord FROM rels UNION ALL SELECT query_id, dst_sym, src_sym, relation, ord FROM rels)"


def state(spark, d):
    """Symbol A's candidates of every question: the 20 nearest of its type, some more supported, some processed."""
    top = v.top_k(graph.query_emb(spark, d), graph.node_emb(spark, d), 20)
    return top.select("query_id", F.lit("A").alias("symbol"), "node_id", "score", (1 + F.col("node_id") % 3).cast("int").alias("support"), (F.col("node_id") % 4 == 0).alias("processed"), F.col("rank").alias("seq"))


def relations(spark, d):
    r = F.explode(F.array(*(F.struct(F.lit(a).alias("src_sym"), F.lit(b).alias("dst_sym"), F.lit(x).alias("relation"), F.lit(i).alias("ord")) for i, (a, b, x) in enumerate((("A", "B", "r0"), ("B", "ANSWER", "r1"), ("A", "ANSWER", "r1")), 1))))
    return graph.query_emb(spark, d).select("query_id", r.alias("r")).select("query_id", "r.*")


@query(f"WITH {KG_NODES} SELECT * FROM nodes")
def src_skb(spark, d):
    return graph.nodes(spark, d).select("node_id", "node_type", "name")


@query(f"WITH {KG_EDGES} SELECT * FROM edges")
def src_skb_edges(spark, d):
    return graph.relational_edges(spark, d)


@query(f"WITH {KG_NODES}, asked AS (SELECT p_partkey AS query_id, 'part' AS node_type, p_name AS name FROM part UNION ALL SELECT n_nationkey, 'nation', lower(n_name) FROM nation UNION ALL SELECT n_nationkey, 'nation', n_name FROM nation) SELECT a.query_id, node_type, name, count(*) AS hits, min(node_id) AS first FROM asked a JOIN nodes USING (node_type, name) GROUP BY 1, 2, 3")
def flt_exact_name(spark, d):
    """Every part's and nation's name looked up; lower-case nation names match none."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.lit("nation").alias("node_type"), F.col("n_name").alias("name"))
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.lit("part").alias("node_type"), F.col("p_name").alias("name"))
    asked = asked.unionByName(n).unionByName(n.withColumn("name", F.lower("name")))
    # names repeat, so the number of a name's nodes is found once and joined to what asks for it
    named = graph.nodes(spark, d).groupBy("node_type", "name").agg(F.count("*").alias("hits"), F.min("node_id").alias("first"))
    found = asked.groupBy("query_id", "node_type", "name").agg(F.count("*").alias("_times")).join(named, ["node_type", "name"])
    return found.select("query_id", "node_type", "name", (F.col("hits") * F.col("_times")).alias("hits"), "first")


NEAR = f"{EMB}, exact AS (SELECT q.query_id, emb.node_id FROM q JOIN emb ON emb.node_id // 8 = q.query_id // 8)"


def _exact(spark, d):
    n = graph.node_emb(spark, d).select("node_id")
    return graph.query_emb(spark, d).select("query_id").join(n, F.floor(F.col("query_id") / 8) == F.floor(F.col("node_id") / 8)).select("query_id", "node_id")


def _nearest(spark, d):
    """As many as can be needed: eight ids at most are exact hits, and these don't count."""
    return v.top_k(graph.query_emb(spark, d), graph.node_emb(spark, d), c.LIMIT + 8, typed=False)


def _initial_sql(cutoff: float) -> str:
    return f"""WITH {NEAR}, h AS (SELECT query_id, count(*) AS hits FROM exact GROUP BY 1),
o AS (SELECT s.query_id, s.node_id, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.node_id) AS r FROM alls s ANTI JOIN exact USING (query_id, node_id) WHERE s.score >= {cutoff}),
b AS (SELECT query_id, node_id, 1.0::DOUBLE AS score FROM exact UNION ALL SELECT query_id, node_id, score FROM o LEFT JOIN h USING (query_id) WHERE r <= greatest(0, 20 - coalesce(hits, 0)))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INT AS ord FROM b"""


@query(_initial_sql(0.2))
def cand_initial(spark, d):
    return c.initial(_exact(spark, d), _nearest(spark, d), cutoff=0.2)


@query(_initial_sql(0.3))
def cand_initial_old(spark, d):
    return c.initial(_exact(spark, d), _nearest(spark, d), cutoff=0.3, skip_when_full=True)


@query(f"WITH {EMB} SELECT query_id, 'S' || node_type AS symbol, node_id, score, row_number() OVER (PARTITION BY query_id, node_type ORDER BY score DESC, node_id)::INT AS ord FROM alls QUALIFY ord <= 20")
def cand_all_symbols(spark, d):
    """A symbol for every type: the nearest 20 of each, all symbols at once."""
    top = v.top_k(graph.query_emb(spark, d), graph.node_emb(spark, d), 20, typed=False, by_type=True)
    return top.select("query_id", F.concat(F.lit("S"), "node_type").alias("symbol"), "node_id", "score", F.col("rank").alias("ord"))


@query(f"""WITH {STATE}, ch AS (SELECT query_id, (query_id // 100 % 4) AS choice FROM q), pick AS (SELECT top.query_id, node_id FROM top JOIN ch ON top.query_id = ch.query_id AND top.seq = ch.choice)
SELECT t.query_id, t.node_id, CASE WHEN p.node_id IS NOT NULL THEN 0.99 ELSE t.score END AS score, row_number() OVER (PARTITION BY t.query_id ORDER BY p.node_id IS NOT NULL DESC, seq)::INT AS ord FROM top t LEFT JOIN pick p USING (query_id, node_id)""")
def cand_anchor_verify(spark, d):
    """Recorded choices 0 to 3 applied to the nearest 20."""
    cands = state(spark, d).select("query_id", "node_id", "score", F.col("seq").alias("ord"))
    choices = graph.query_emb(spark, d).select("query_id", (F.floor(F.col("query_id") / 100) % 4).cast("int").alias("choice"))
    return c.promoted(cands, choices, ["query_id"])


@query(f"WITH {EMB}, s AS (SELECT query_id, node_type AS symbol, max(score) AS best FROM alls WHERE query_id <> node_id GROUP BY 1, 2) SELECT query_id, symbol, query_id % 200 = 0 AS constant FROM s WHERE best < 0.8 AND query_id % 200 = 0 AND symbol <> 't3'")
def flt_anchor_gate(spark, d):
    """A symbol for every type: constant where the question's id is divisible by 200; type t3's has no name. The best two of each type hold the best other one."""
    scored = v.top_k(graph.query_emb(spark, d), graph.node_emb(spark, d), 2, typed=False, by_type=True).drop("rank").where("query_id <> node_id").withColumnRenamed("node_type", "symbol")
    symbols = scored.select("query_id", "symbol").distinct().select("query_id", "symbol", F.when(F.col("symbol") != "t3", F.col("symbol")).otherwise(F.lit("")).alias("name"), (F.col("query_id") % 200 == 0).alias("constant"))
    return c.needs_anchor(symbols, scored).select("query_id", "symbol", "constant")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN CASE WHEN event_id % 5 > 3 THEN 0 ELSE event_id % 5 END WHEN 1 THEN event_id % 3 WHEN 4 THEN 2 ELSE 0 END AS choice FROM events")
def cand_choice_parse(spark, d):
    """Answers in six shapes: fenced JSON, JSON inside prose, a bare number, prose, short broken JSON with a digit, nothing."""
    e, i = table(spark, d, "events"), F.col("event_id")
    answer = (
        F.when(i % 6 == 0, F.format_string('```json\n{"choice": %d}\n```', i % 5)).when(i % 6 == 1, F.format_string('It is {"choice": %d}, I think, by far.', i % 3)).when(i % 6 == 2, (i % 5).cast("string"))
        .when(i % 6 == 3, F.lit("I really could not say which 1 of these it is")).when(i % 6 == 4, F.lit("{choice: 2}")).otherwise(F.lit(""))
    )
    return e.select("event_id", c.choice_of(answer, F.lit(3)).cast("long").alias("choice"))


@query(f"WITH {EMB}, {RELS} SELECT * FROM adj")
def gr_adjacency(spark, d):
    return g.adjacency(relations(spark, d))


@query(f"WITH {STATE} SELECT query_id, symbol, node_id, score, 1::INT AS support, seq FROM cand")
def gr_init(spark, d):
    return state(spark, d).select("query_id", "symbol", "node_id", "score", F.lit(1).alias("support"), "seq")


@query(f"WITH {STATE} SELECT query_id, symbol, node_id, score, support, seq FROM pop")
def gr_pop(spark, d):
    return g.popped(state(spark, d)).drop("processed")


@query(f"WITH {KG_EDGES}, s AS (SELECT s_suppkey AS query_id, 3000000000000 + s_suppkey AS node_id FROM supplier) SELECT query_id, relation, count(*) AS neighbors, min(dst) AS least, max(dst) AS greatest FROM s JOIN edges ON src = node_id GROUP BY 1, 2")
def jn_expand(spark, d):
    """Every supplier's neighbours along all its relations."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), graph.node_id("supplier", "s_suppkey").alias("node_id"), F.lit("S").alias("symbol"))
    adj = s.select("query_id", F.lit("S").alias("symbol"), F.lit("X").alias("other"), F.explode(F.array(F.lit("in_nation"), F.lit("supplied_by"))).alias("relation"), F.lit(1).alias("ord"))
    out = g.expanded(s, adj, graph.relational_edges(spark, d))
    return out.groupBy("query_id", "relation").agg(F.count("*").alias("neighbors"), F.min("neighbor").alias("least"), F.max("neighbor").alias("greatest"))


STEP = f"""WITH {STATE}, {RELS}, {V_EDGES}, st AS (SELECT a.query_id, a.symbol, a.other, a.relation, a.ord, p.node_id, p.score AS source, e.dst AS neighbor FROM cand p JOIN adj a USING (query_id, symbol) JOIN edges e ON e.src = p.node_id AND e.relation = a.relation),
sc AS (SELECT st.*, round(list_inner_product(q.e, emb.e), 6) AS similarity FROM st JOIN q USING (query_id) JOIN emb ON emb.node_id = st.neighbor)"""


def _steps(spark, d):
    """All candidates' neighbours, scored against the question's vector."""
    s = state(spark, d).select("query_id", "symbol", "node_id", F.col("score").alias("source"))
    out = g.expanded(s, g.adjacency(relations(spark, d)), graph.vector_edges(spark, d)).withColumnRenamed("node_id", "_from")
    return v.pair_scores(out.withColumnRenamed("neighbor", "node_id"), graph.query_emb(spark, d), graph.node_emb(spark, d)).withColumnRenamed("score", "similarity").withColumnRenamed("node_id", "neighbor").withColumnRenamed("_from", "node_id")


@query(f"{STEP} SELECT query_id, symbol, other, relation, node_id, neighbor, similarity FROM sc")
def gr_score_neighbors(spark, d):
    return _steps(spark, d).select("query_id", "symbol", "other", "relation", "node_id", "neighbor", "similarity")


@query(f"{STEP} SELECT query_id, symbol, other, relation, neighbor, similarity, row_number() OVER (PARTITION BY query_id, symbol, other, relation ORDER BY similarity DESC, neighbor)::INT AS rank FROM (SELECT DISTINCT query_id, symbol, other, relation, neighbor, similarity FROM sc) QUALIFY rank <= 15")
def gr_topk_neighbors(spark, d):
    key = ["query_id", "symbol", "other", "relation"]
    return g.best_neighbors(_steps(spark, d).select(*key, "neighbor", "similarity").distinct(), key)


@query(f"WITH {EMB} SELECT query_id, node_id, round(CASE WHEN score > 1e-9 AND s * 0.9 > 1e-9 THEN 2 / (1 / score + 1 / (s * 0.9)) WHEN score > 1e-9 THEN score * 0.9 WHEN s * 0.9 > 1e-9 THEN s * 0.9 * 0.9 ELSE 0.1 END, 6) AS main, round(CASE WHEN score > 1e-6 AND s * 0.9 > 1e-6 THEN 2 / (1 / score + 1 / (s * 0.9)) ELSE 0.1 END, 6) AS alternative FROM (SELECT *, (node_id % 5)::DOUBLE / 4 AS s FROM alls)")
def gr_propagate(spark, d):
    """Every question's similarity with every vector, propagated from sources of 0 to 1, under both policies."""
    s = (F.col("node_id") % 5).cast("double") / 4
    out = [F.round(g.propagated(F.col("score"), s, p), 6).alias(n) for p, n in ((g.MAIN, "main"), (g.ALTERNATIVE, "alternative"))]
    return all_scores(spark, d).select("query_id", "node_id", *out)


ARRIVE = "arr AS (SELECT l_orderkey AS query_id, 'A' AS symbol, l_partkey AS node_id, l_linenumber * 1000000000::BIGINT + l_partkey AS seq FROM lineitem), held AS (SELECT DISTINCT l_orderkey AS query_id, 'A' AS symbol, l_suppkey AS node_id FROM lineitem WHERE l_linenumber <= 2)"


@query(f"WITH {ARRIVE}, n AS (SELECT query_id, symbol, node_id, min(seq) AS seq FROM arr ANTI JOIN held USING (query_id, symbol, node_id) GROUP BY 1, 2, 3), h AS (SELECT query_id, symbol, count(*) AS held FROM held GROUP BY 1, 2) SELECT query_id, symbol, node_id, seq FROM n LEFT JOIN h USING (query_id, symbol) QUALIFY row_number() OVER (PARTITION BY query_id, symbol ORDER BY seq) + coalesce(held, 0) <= 4")
def gr_insert(spark, d):
    """Orders' parts arriving where suppliers of their first lines are held, with room for four."""
    arrivals, held = _arrivals(spark, d)
    return g.inserted(arrivals, held, 4)


def _arrivals(spark, d):
    t = table(spark, d, "lineitem").withColumn("query_id", F.col("l_orderkey")).withColumn("symbol", F.lit("A"))
    arrivals = t.select("query_id", "symbol", F.col("l_partkey").alias("node_id"), (F.col("l_linenumber") * F.lit(1_000_000_000).cast("long") + F.col("l_partkey")).alias("seq"))
    return arrivals, t.where("l_linenumber <= 2").select("query_id", "symbol", F.col("l_suppkey").alias("node_id")).distinct()


@query(f"WITH {ARRIVE} SELECT query_id, symbol, node_id, seq FROM arr ANTI JOIN held USING (query_id, symbol, node_id)")
def gr_skip_processed(spark, d):
    arrivals, held = _arrivals(spark, d)
    return arrivals.join(held, ["query_id", "symbol", "node_id"], "left_anti")


@query("""WITH RECURSIVE a AS (SELECT l_suppkey AS query_id, l_returnflag || l_linestatus || l_linenumber AS triplet, max_by(l_discount * 10, (-l_orderkey, -l_partkey, -l_quantity)) AS source, min((l_orderkey, l_partkey, l_quantity)) AS place FROM lineitem GROUP BY 1, 2),
o AS (SELECT query_id, triplet, source, row_number() OVER (PARTITION BY query_id ORDER BY place) AS k FROM a WHERE triplet <> 'AO1'),
f(query_id, k, score, support) AS (SELECT DISTINCT l_suppkey, 0::BIGINT, 0.5::DOUBLE, 1 FROM lineitem UNION ALL SELECT f.query_id, o.k, greatest(f.score, o.source) * (1 + 0.25 * ln(f.support + 2)), f.support + 1 FROM f JOIN o ON o.query_id = f.query_id AND o.k = f.k + 1)
SELECT query_id, round(log10(max_by(score, k)), 6) AS log_score, max(support)::INT AS support FROM f GROUP BY 1""")
def gr_update(spark, d):
    """Every supplier's lines as arrivals, in the order of orders; flag, status and line number are the triplet, one of them there already."""
    t = table(spark, d, "lineitem")
    key = [F.col("l_suppkey").alias("query_id"), F.lit("A").alias("symbol"), F.lit(0).cast("long").alias("node_id")]
    seq = F.struct("l_orderkey", "l_partkey", "l_quantity")
    triplet = F.concat("l_returnflag", "l_linestatus", "l_linenumber")
    # of a triplet's arrivals only the first can count, so the others are folded away before anything is gathered
    first = t.select(*key, triplet.alias("triplet"), seq.alias("at"), (F.col("l_discount") * 10).alias("source")).groupBy("query_id", "symbol", "node_id", "triplet").agg(F.min_by("source", "at").alias("source"), F.min("at").alias("at"))
    from pyspark.sql import Window

    arrivals = first.withColumn("seq", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).cast("long")).drop("at")
    cands = t.select(*key).distinct().select("*", F.lit(0.5).alias("score"), F.lit(1).alias("support"), F.array(F.lit("AO1")).alias("triplets"))
    return g.updated(cands, arrivals).select("query_id", F.round(F.log10("score"), 6).alias("log_score"), "support")


ANS = f"{STATE}, ans AS (SELECT query_id, node_id, score, support, seq FROM cand)"


def _answers(spark, d, order):
    return g.answers(state(spark, d).withColumn("symbol", F.lit("ANSWER")), order).select("query_id", "node_id", "score", "support", "rank")


@query(f"WITH {ANS} SELECT query_id, node_id, score, support, row_number() OVER (PARTITION BY query_id ORDER BY support DESC, score DESC, seq)::INT AS rank FROM ans")
def gr_rank_slm(spark, d):
    return _answers(spark, d, "main")


@query(f"WITH {ANS} SELECT query_id, node_id, score, support, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, support, seq)::INT AS rank FROM ans")
def gr_rank_old(spark, d):
    return _answers(spark, d, "old")


@query("WITH p AS (SELECT l_suppkey AS query_id, l_partkey % 5 AS node_id, (l_orderkey, l_linenumber, l_partkey, l_quantity) AS ord, round((0.5 + l_discount) * (0.5 + l_tax), 9) AS weight FROM lineitem) SELECT query_id, node_id, count(*) AS support, round(sum(weight), 6) AS weight FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY weight DESC, ord) <= 50) GROUP BY 1, 2")
def gr_path_prune(spark, d):
    """Every line a path of two scores, fifty kept of each supplier's five candidates."""
    t = table(spark, d, "lineitem")
    paths = t.select(F.col("l_suppkey").alias("query_id"), (F.col("l_partkey") % 5).alias("node_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("ord"), F.array(F.round((0.5 + F.col("l_discount")) * (0.5 + F.col("l_tax")), 9)).alias("scores"))
    return g.kept_paths(paths).groupBy("query_id", "node_id").agg(F.max("support").alias("support"), F.round(F.sum("weight"), 6).alias("weight"))


def _ground(spark, d, policy):
    q, n = graph.query_emb(spark, d), graph.node_emb(spark, d)
    symbols = q.select("query_id", F.explode(F.array(*(F.struct(F.lit(s).alias("symbol"), F.lit(i).alias("ord")) for i, s in enumerate(("A", "B", "ANSWER"))))).alias("s")).select("query_id", "s.*")
    symbols = symbols.withColumn("types", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("t"), i)))
    cands = state(spark, d).select("query_id", "symbol", "node_id", "score", F.col("seq").alias("ord"))

    scores = v.masking(q, n)

    def similar(pairs):
        return scores(pairs).select("query_id", F.explode(F.array(F.lit("B"), F.lit("ANSWER"), F.lit("A"))).alias("symbol"), "node_id", "score")

    return g.ground(symbols, relations(spark, d), cands, g.cut(graph.vector_edges(spark, d)), n, similar, policy).withColumn("score", F.round("score", 6))


@query()
def gr_ground(spark, d):
    """Every question grounded over the vectors' graph: A - r0 - B - r1 - ANSWER, and A - r1 - ANSWER."""
    return _ground(spark, d, g.MAIN)


@query()
def gr2_ground(spark, d):
    """The same under the alternative policy."""
    return _ground(spark, d, g.ALTERNATIVE)


@query()
def gr_stop(spark, d):
    """How each grounded question ended: the answer full, or nothing left."""
    found = gr_ground(spark, d)
    full = F.count_if(F.col("symbol") == "ANSWER")
    return found.groupBy("query_id").agg(full.alias("answers"), (full >= g.MAIN.answers).alias("full"))
