"""The graph model (nodes, symmetric edges, vectors, questions), and how the test tables are read as one.

    node_emb    node_id, node_type, embedding
    edges       src, relation, dst; both directions stand in the table
    nodes       node_id, node_type, name, doc
    truths      query_id, node_id
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

#: The relational tables as nodes: table, type, key, name; a node's id is the type's place times ``STRIDE`` plus its key.
ENTITIES = (
    ("region", "region", "r_regionkey", "r_name"),
    ("nation", "nation", "n_nationkey", "n_name"),
    ("customer", "customer", "c_custkey", "c_name"),
    ("supplier", "supplier", "s_suppkey", "s_name"),
    ("part", "part", "p_partkey", "p_name"),
)
STRIDE = 1_000_000_000_000
#: Foreign keys as relations: table, source type and key, relation, target type and key.
FOREIGN_KEYS = (
    ("nation", "nation", "n_nationkey", "in_region", "region", "n_regionkey"),
    ("customer", "customer", "c_custkey", "in_nation", "nation", "c_nationkey"),
    ("supplier", "supplier", "s_suppkey", "in_nation", "nation", "s_nationkey"),
    ("lineitem", "part", "l_partkey", "supplied_by", "supplier", "l_suppkey"),
)
#: Question vectors: every row whose id this divides.
QUERY_STEP = 100


def node_id(kind: str, key: str):
    return F.lit([e[1] for e in ENTITIES].index(kind) * STRIDE) + F.col(key).cast("long")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, node_type, name, doc) of the relational tables."""
    parts = [
        table(spark, sf_dir, name).select(node_id(kind, key).alias("node_id"), F.lit(kind).alias("node_type"), F.col(label).alias("name"), F.format_string("%s (%s)", F.col(label), F.lit(kind)).alias("doc"))
        for name, kind, key, label in ENTITIES
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each once."""
    return edges.select("src", "relation", "dst").unionByName(edges.select(F.col("dst").alias("src"), "relation", F.col("src").alias("dst"))).distinct()


def relational_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The foreign keys as symmetric edges."""
    whole = None
    for name, kind, key, relation, target, other in FOREIGN_KEYS:
        part = table(spark, sf_dir, name).select(node_id(kind, key).alias("src"), F.lit(relation).alias("relation"), node_id(target, other).alias("dst"))
        whole = part if whole is None else whole.unionByName(part)
    return symmetric(whole)


def node_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with a type from their label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.concat(F.lit("t"), F.col("label")).alias("node_type"), "embedding")


def query_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, node_type, embedding): the question vectors, each with its own type."""
    return node_emb(spark, sf_dir).where(F.col("node_id") % QUERY_STEP == 0).withColumnRenamed("node_id", "query_id")


def vector_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric edges between vectors: r0 leads from v to 7 v + 1, r1 from v to 13 v + 5, modulo their number."""
    ids = node_emb(spark, sf_dir).select("node_id")
    n = ids.agg(F.count("*").alias("n"))
    each = ids.join(F.broadcast(n), F.lit(True))  # one row
    out = [each.select(F.col("node_id").alias("src"), F.lit(r).alias("relation"), ((F.col("node_id") * a + b) % F.col("n")).alias("dst")) for r, a, b in (("r0", 7, 1), ("r1", 13, 5))]
    return symmetric(out[0].unionByName(out[1]))


def order_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked answers (query_id, rank, node_id): an order's parts in the order of their lines."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("int").alias("rank"), F.col("l_partkey").alias("node_id"))


def order_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True answers (query_id, node_id): an order's returned parts, and for every order the part of the order's own number."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("node_id"))
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderkey").alias("node_id"))
    return returned.unionByName(own).distinct()
