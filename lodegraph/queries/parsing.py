"""Scalar and parser queries: model outputs are made of the tables' values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as p
from ..functions import text as t
from ..sources.tables import table
from . import query


@query("SELECT event_id, props AS text FROM events")
def fn_strip_fence(spark, d):
    fenced = F.format_string("```json\n%s\n```  ", F.col("props"))
    return table(spark, d, "events").select("event_id", t.without_fence(fenced).alias("text"))


@query("SELECT doc_id, trim(split_part(text[1:150], '.', 1), ' ') AS first FROM documents")
def prj_truncate_doc(spark, d):
    return table(spark, d, "documents").select("doc_id", t.first_sentence(F.col("text")).alias("first"))


@query("SELECT c_custkey, lower(trim('  ' || c_mktsegment || ' ')) AS name FROM customer")
def fn_case_trim(spark, d):
    return table(spark, d, "customer").select("c_custkey", t.vocabulary_name(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("name"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct([lower(p_type), lower(p_brand)])), ',') AS names FROM part")
def fn_split_csv(spark, d):
    listed = F.concat_ws(", ", "p_type", F.lit(" "), "p_brand", "p_type", F.lit(""))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(t.split_names(listed)), ",").alias("names"))


@query("SELECT p_partkey, try_cast(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS number FROM part")
def fn_extract_int(spark, d):
    return table(spark, d, "part").select("p_partkey", t.first_int(F.col("p_brand")).alias("number"))


@query("SELECT event_id, try_cast(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE) AS number FROM events")
def fn_to_numeric(spark, d):
    return table(spark, d, "events").select("event_id", t.number(F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string"))).alias("number"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 3)::DOUBLE END > 0, false)::INT AS success FROM events")
def fn_success_flag(spark, d):
    return table(spark, d, "events").select("event_id", t.success(F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 3).cast("double"))).alias("success"))


RATIO = "r AS (SELECT l_orderkey AS query_id, list(DISTINCT l_partkey % 11) AS g, list(DISTINCT l_suppkey % 11) AS p FROM lineitem GROUP BY 1)"


def _lists(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.collect_set(F.col("l_partkey") % 11).alias("g"), F.collect_set(F.col("l_suppkey") % 11).alias("p"))


@query(f"WITH {RATIO} SELECT query_id, round(len(list_intersect(g, p)) / len(g), 9) AS ratio FROM r")
def fn_match_ratio(spark, d):
    return _lists(spark, d).select("query_id", F.round(t.match_ratio(F.col("g"), F.col("p")), 9).alias("ratio"))


@query("WITH r AS (SELECT event_id, (event_id % 5) / 4.0::DOUBLE AS x, (event_id % 7) / 6.0::DOUBLE AS e, (event_id % 11) / 10.0::DOUBLE AS r FROM events) SELECT event_id, CASE WHEN x = 1 THEN 'success' WHEN x > 0 THEN 'partial_retrieval' WHEN e <= 0.7 AND r <= 0.7 THEN 'entity+relation_error' WHEN e < r THEN 'entity_error' WHEN r < e THEN 'relation_error' ELSE 'reasoning error' END AS cause FROM r")
def fn_failure_cause(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", t.failure_cause((i % 5) / 4.0, (i % 7) / 6.0, (i % 11) / 10.0).alias("cause"))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'unknown' ELSE (event_id % 4) || 'types_' || (event_id % 3) || 'paths_' || (user_id % 5) || 'hops' END AS category FROM events")
def fn_category(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", t.category(F.when(i % 9 != 0, i % 4), i % 3, F.col("user_id") % 5).alias("category"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'gene/protein' WHEN 1 THEN 'effect/phenotype' ELSE regexp_replace(p_name, ' ', '_') END AS type FROM part")
def fn_key_clean(spark, d):
    i = F.col("p_partkey")
    stem = F.when(i % 3 == 0, F.lit("geneprotein_emb")).when(i % 3 == 1, F.lit("effectphenotype_0")).otherwise(F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_emb")))
    return table(spark, d, "part").select("p_partkey", t.type_of_file(stem).alias("type"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 'plain ' || o_orderstatus WHEN 1 THEN o_orderpriority || chr(10) || 'as said' ELSE o_orderpriority END AS answer FROM orders")
def fn_answer_cleanup(spark, d):
    i, p = F.col("o_orderkey") % 4, F.col("o_orderpriority")
    said = F.when(i == 0, F.format_string("<think>no {x}</think> so \\boxed{%s}.", p)).when(i == 1, F.format_string("**Answer:** %s\nas said", p)).when(i == 2, F.format_string("It is **%s** then", p)).otherwise(F.format_string("<think>**a**</think>\nplain %s", F.col("o_orderstatus")))
    return table(spark, d, "orders").select("o_orderkey", t.final_answer(said).alias("answer"))


@query("SELECT conv_id, string_agg(CASE role WHEN 'assistant' THEN 'model' ELSE role END, ',' ORDER BY turn) AS gemini, string_agg(CASE role WHEN 'system' THEN 'user' ELSE role END, ',' ORDER BY turn) AS gemma, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def fn_chat_map(spark, d):
    """Conversations as chats, with the roles of two models. A conversation is one chat, as models take it."""
    chats = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m")).withColumn("chat", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))))
    roles = lambda c: F.array_join(F.transform(c, lambda m: m["role"]), ",")
    return chats.select("conv_id", roles(t.chat_roles(F.col("chat"))).alias("gemini"), roles(t.chat_roles(F.col("chat"), "gemma")).alias("gemma"), F.aggregate("chat", F.lit(0).cast("long"), lambda a, m: a + F.char_length(m["content"])).alias("chars"))


@query("SELECT event_id, event_type = 'error' OR event_id % 8 = 0 AS limited FROM events")
def fn_status_rate_limit(spark, d):
    said = F.when(F.col("event_type") == "error", F.lit("API error 429")).when(F.col("event_id") % 8 == 0, F.lit("Rate Limit reached")).when(F.col("event_id") % 8 == 1, F.lit("bad gateway"))
    return table(spark, d, "events").select("event_id", t.rate_limited(said).alias("limited"))


@query("SELECT event_id, round(ln(value + 1), 6) AS log, round(1.0 / (value + 1), 6) AS reciprocal, greatest(value, event_id % 100)::DOUBLE AS most FROM events")
def fn_math(spark, d):
    x = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(F.log(x + 1), 6).alias("log"), F.round(1.0 / (x + 1), 6).alias("reciprocal"), F.greatest(x, (F.col("event_id") % 100).cast("double")).alias("most"))


def _entity_json():
    """Two symbols in JSON: every fifth second symbol has no type."""
    kind = F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(', "type": "'), "p_type", F.lit('"')))
    return F.concat(F.lit('```json\n{"A": {"name": "'), "p_name", F.lit('", "type": "disease", "information": "of size '), F.col("p_size").cast("string"), F.lit('", "constant": true}, "ANSWER": {"name": null'), kind, F.lit("}}\n```"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'A' ELSE 'A,ANSWER' END AS symbols, p_name AS name, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS answer_type FROM part")
def fn_parse_entities(spark, d):
    e = table(spark, d, "part").withColumn("e", p.entities(_entity_json()))
    return e.select("p_partkey", F.array_join(F.array_sort(F.map_keys("e")), ",").alias("symbols"), F.col("e")["A"]["name"].alias("name"), F.try_element_at("e", F.lit("ANSWER"))["type"].alias("answer_type"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a field is missing' WHEN 2 THEN 'not an object' ELSE 'empty' END AS error FROM part")
def fn_parse_entities_strict(spark, d):
    i = F.col("p_partkey") % 4
    whole = '{"A": {"type": ["drug"], "lexical": {"name": "x"}, "semantic": [], "constant": true}}'
    said = F.when(i == 0, F.lit(whole)).when(i == 1, F.lit('{"A": {"type": ["drug"], "semantic": [], "constant": true}}')).when(i == 2, F.lit("sorry")).otherwise(F.lit("```json\n```"))
    return table(spark, d, "part").select("p_partkey", p.entities_strict(said)[1].alias("error"))


@query("SELECT p_partkey, 'disease' AS type, p_name AS name, 'of size ' || p_size AS semantic, true AS constant FROM part")
def prj_entity_format(spark, d):
    a = p.old_format(p.entities(_entity_json()))["A"]
    return table(spark, d, "part").select("p_partkey", F.array_join(a["type"], ",").alias("type"), a["lexical"]["name"].alias("name"), F.array_join(a["semantic"], ",").alias("semantic"), a["constant"].alias("constant"))


@query("SELECT p_partkey, concat_ws(' ', CASE WHEN p_partkey % 3 > 0 THEN p_name END, p_type, p_brand) AS for_scoring, p_type || p_brand || ' ' || p_name AS for_search FROM part")
def prj_entity_query_text(spark, d):
    s = F.array("p_type", "p_brand")
    return table(spark, d, "part").select("p_partkey", t.entity_text(F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")), s).alias("for_scoring"), t.search_text(s, F.array("p_name")).alias("for_search"))


@query("SELECT p_partkey, p_type || p_brand || ' ' || p_name AS text FROM part")
def prj_search_text(spark, d):
    return table(spark, d, "part").select("p_partkey", t.search_text(F.array("p_type", "p_brand"), F.array("p_name")).alias("text"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'gene/protein' WHEN 1 THEN 'drug' WHEN 2 THEN 'effect/phenotype' ELSE NULL END AS type FROM events")
def flt_node_types(spark, d):
    i = F.col("event_id") % 5
    said = F.when(i == 0, "gene").when(i == 1, "drug").when(i == 2, "phenotype").when(i == 3, "Drug")
    return table(spark, d, "events").select("event_id", p.node_type(said).alias("type"))


_SAID = ("PPI ", "linked to", "writes", "side effect", "author")


@query("SELECT event_id, lower(trim(['PPI ', 'linked to', 'writes', 'side effect', 'author'][event_id % 5 + 1])) AS relation FROM events WHERE event_id % 5 IN (0, 1, 3)")
def flt_rel_vocab(spark, d):
    said = F.array(*(F.lit(x) for x in _SAID))[(F.col("event_id") % 5).cast("int")]
    return table(spark, d, "events").select("event_id", t.vocabulary_name(said).alias("relation")).where(p.in_vocabulary(F.col("relation")))


@query("SELECT l_orderkey AS query_id, l_suppkey % 3 AS a, l_partkey % 3 AS b, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS relations FROM lineitem WHERE l_linenumber IN (1, 2, 3, 5) GROUP BY 1, 2, 3")
def flt_rel_types(spark, d):
    """Relations (line numbers) of pairs of symbols: the valid ones stay, pairs without any go."""
    valid = spark.createDataFrame([(x,) for x in (1, 2, 3, 5)], "l_linenumber int")
    r = table(spark, d, "lineitem").join(valid, "l_linenumber", "left_semi")
    return r.groupBy(F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") % 3).alias("a"), (F.col("l_partkey") % 3).alias("b")).agg(F.array_join(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))), ",").alias("relations"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'author___writes___paper' WHEN '2-HIGH' THEN 'paper___cites___paper' ELSE o_orderpriority END AS relation FROM orders")
def prj_relation_rename(spark, d):
    """Short names of relations by a fixed map; others stay."""
    names = F.create_map(*(F.lit(x) for x in ("1-URGENT", "author___writes___paper", "2-HIGH", "paper___cites___paper")))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(names[F.col("o_orderpriority")], F.col("o_orderpriority")).alias("relation"))


@query("SELECT event_id, event_id % 3 = 0 AS valid FROM events")
def fn_validate_lists(spark, d):
    """Whether a relation map's values are all lists."""
    said = F.when(F.col("event_id") % 3 == 0, '{"a": ["x"], "b": []}').when(F.col("event_id") % 3 == 1, '{"a": "x"}').otherwise("[]")
    parsed = F.from_json(said, "map<string,string>")
    valid = F.coalesce((F.size(parsed) > 0) & F.forall(F.map_values(parsed), lambda v: v.startswith("[")), F.lit(False))
    return table(spark, d, "events").select("event_id", valid.alias("valid"))


@query("""SELECT p_partkey, '[{"a":"A","b":"B","relation":"' || p_type || '"},{"a":"B","b":"ANSWER","relation":"' || p_size || '"}]' AS triples FROM part""")
def fn_parse_tuples(spark, d):
    said = F.concat(F.lit("```python\n[('A', 'B', '"), "p_type", F.lit("'), ['x', 'y', 'z'], ('B', 'ANSWER', "), F.col("p_size").cast("string"), F.lit(")]\n```"))
    return table(spark, d, "part").select("p_partkey", F.to_json(p.triples(said)).alias("triples"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '[{"a":"A","b":"B","relation":"' || p_type || '","ord":0},{"a":"A","b":"B","relation":"ppi","ord":1}]' WHEN 3 THEN '[]' ELSE '[{"a":"A","b":"B","relation":"ppi","ord":0}]' END AS relations FROM part""")
def fn_parse_relation_dict(spark, d):
    i = F.col("p_partkey") % 4
    said = F.when(i == 0, F.concat(F.lit("{('A', 'B'): ['"), "p_type", F.lit("', 'ppi']}"))).when(i == 1, F.lit('{"(\'A\', \'B\')": ["ppi"]}')).when(i == 2, F.lit('{"(A, B)": ["ppi"]}')).otherwise(F.lit("{}"))
    return table(spark, d, "part").select("p_partkey", F.to_json(p.relations(said)).alias("relations"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 3 THEN '{}' ELSE '{"a": true, "b": null}' END AS json FROM events""")
def fn_safe_parse(spark, d):
    i = F.col("event_id") % 4
    said = F.when(i == 0, F.col("props")).when(i == 1, F.lit("{'a': True, 'b': None}")).when(i == 2, F.lit("{'a': true, 'b': null}")).otherwise(F.lit("oops"))
    return table(spark, d, "events").select("event_id", p.as_json(said).alias("json"))


@query()
def fn_seq_ratio(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(p.similarity(F.col("p_name"), F.col("p_type")), 6).alias("ratio"))


@query()
def flt_entity_clean(spark, d):
    """Symbols whose type is none, whose name is the answer's, or whose information says what the answer's says, go; the answer stays."""
    s = table(spark, d, "part").select(
        "p_partkey", F.explode(F.array(*(F.struct(F.lit(n).alias("symbol"), k.alias("type"), m.alias("name"), i.alias("information")) for n, k, m, i in (
            ("ANSWER", F.lit("drug"), F.col("p_name"), F.concat("p_name", F.lit(" of "), "p_type")),
            ("A", F.lit("gene"), F.col("p_brand"), F.concat("p_name", F.lit(" of "), "p_brand")),
            ("B", F.lit("gadget"), F.lit("b"), F.lit("")),
            ("C", F.lit("disease"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.lit("c")), F.lit("")),
        )))).alias("s")).select("p_partkey", "s.*")
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    answer = s.where("symbol = 'ANSWER'").select("p_partkey", low(F.col("name")).alias("_n"), low(F.col("information")).alias("_i"))
    both = s.join(answer, "p_partkey").withColumn("type", p.node_type(F.col("type"))).withColumn("_own", low(F.col("information"))).withColumn("like", p.similarity(F.col("_own"), F.col("_i")))
    named = (F.col("_n") != "") & (low(F.col("name")) == F.col("_n"))
    said = (F.col("_i") != "") & (F.col("_own") != "") & (F.col("like") >= p.SAME_TEXT)
    kept = (F.col("symbol") == "ANSWER") | (F.col("type").isNotNull() & ~named & ~said)
    return both.where(kept).select("p_partkey", "symbol", "type", "name")


@query("SELECT p_partkey, 'Types: disease, drug. Query: ' || p_name || ' Triplets: a --- r ---> b' AS prompt FROM part")
def prj_prompts(spark, d):
    """A prompt template with its slots filled."""
    made = F.lit("Types: {types}. Query: {query} Triplets: {triplets}")
    for slot, value in (("{types}", F.lit("disease, drug")), ("{query}", F.col("p_name")), ("{triplets}", F.lit("a --- r ---> b"))):
        made = F.replace(made, F.lit(slot), value)
    return table(spark, d, "part").select("p_partkey", made.alias("prompt"))
