"""The model's stages over recorded answers, and means that follow a stream of rows that replace each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import stages
from ..sources.tables import table
from ..storage import new_path
from ..streaming import runs as streaming
from . import query


def _provider():
    """A model that says little: facts in capitals, two entities, two relations, of which it keeps one and finds another that is none."""
    question = F.regexp_extract("prompt", "Question: (.*)", 1)
    entities = F.concat(F.lit('{"A": {"name": "'), question, F.lit('", "type": "drug", "constant": true}, "ANSWER": {"type": "disease"}}'))
    relations = F.lit("{('A', 'ANSWER'): ['indication', 'ppi']}")
    kept = F.lit("[('A', 'ANSWER', ' Indication'), ('A', 'ANSWER', 'indication'), ('A', 'ANSWER', 'made up')]")
    readable = F.when((F.col("attempt") == 1) & F.startswith(question, F.lit("a")), "unreadable").otherwise(entities)
    said = {"deconstruct": F.upper(question), "entities": readable, "relations": relations, "validation": kept, "expansion": F.concat(F.lit("about "), question)}
    return stages.Derived(F.coalesce(*(F.when(F.col("stage") == stage, response) for stage, response in said.items())))


def _stages(spark, switches=stages.Switches()):
    return stages.Stages(stages.ResultStore(spark, new_path(spark, "answers")), _provider(), switches=switches)


def _questions(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))


def _plain(rows):
    text = F.array_join(F.transform("relations", lambda t: F.concat_ws(" ", t["a"], t["relation"], t["b"])), "; ")
    return rows.select("query_id", "facts", F.get_json_object("entities", "$.A.name").alias("name"), text.alias("relations"))


@query("SELECT p_partkey AS query_id, upper(p_name) AS facts, p_name AS name, 'A indication ANSWER' AS relations FROM part")
def llm_stages(spark, d):
    """Deconstruction, entities, relations and validation; each question once, each prompt once."""
    return _plain(_stages(spark).extract(_questions(spark, d)))


@query("SELECT p_partkey AS query_id, p_name AS facts, p_name AS name, 'A indication ANSWER; A ppi ANSWER' AS relations FROM part")
def llm_stages_ablated(spark, d):
    """Without deconstruction and self-correction."""
    return _plain(_stages(spark, stages.Switches(deconstruction=False, self_correction=False)).extract(_questions(spark, d)))


@query("SELECT p_partkey AS query_id, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber <= 4) THEN 'about ' || p_name ELSE p_name END AS expanded FROM part")
def llm_expansion(spark, d):
    """Questions expanded where they have answers: the orders' numbers of a part's lines."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("query_id"), F.col("l_linenumber").cast("int").alias("rank")).agg(F.min("l_orderkey").alias("node_id"))
    documents = table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_orderpriority").alias("doc"))
    return _stages(spark).expanded(_questions(spark, d), lines, documents).select("query_id", "expanded")


@query("""WITH r AS (SELECT user_id, event_id, coalesce(value, 0) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT count(*) AS total_queries, round(avg(value), 6) AS avg_value FROM r""")
def stream_replacing_means(spark, d):
    """Means over each user's last event, as the events come in four batches."""
    own, folder = spark.newSession(), new_path(spark, "stream")
    own.conf.set("spark.sql.shuffle.partitions", "8")  # of the state, for good
    rows = table(own, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("seq"), "value")
    rows.repartition(4, F.xxhash64("seq")).write.parquet(f"{folder}/rows")
    stream = streaming.questions(own, f"{folder}/rows", "query_id long, seq long, value double", 1)
    means = streaming.ReplacingMeans(own, f"{folder}/means", ["value"])
    means.start(stream).awaitTermination()
    return streaming.ReplacingMeans(spark, f"{folder}/means", ["value"]).means().withColumn("avg_value", F.round("avg_value", 6))
