"""Vectors written as tensor archives and read back by the data source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import graph, tensors
from ..storage import new_path, written
from . import query


def _stored(spark, d):
    """(folder of node files, ids by type): all vectors, a file for each type."""
    vectors = graph.node_emb(spark, d).where("embedding is not null")
    ids = written(tensors.numbered_ids(vectors), "ids")
    folder = new_path(spark, "nodes")
    tensors.write_nodes(ids.join(vectors.drop("node_type"), "node_id"), folder)
    return folder, ids


def _sums(rows):
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5)
    return rows.select("node_id", "node_type", F.size("embedding").alias("width"), total.alias("total"))


_SUMS = "SELECT vec_id AS node_id, 't' || label AS node_type, len(embedding)::INT AS width, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings WHERE embedding IS NOT NULL"


@query(_SUMS)
def src_emb_pt(spark, d):
    """Every node's vector from the file of its type."""
    folder, ids = _stored(spark, d)
    return _sums(tensors.node_vectors(spark, folder, ids))


@query(_SUMS)
def src_emb_pt_v1(spark, d):
    """The same where every type must have as many rows as nodes."""
    folder, ids = _stored(spark, d)
    return _sums(tensors.node_vectors(spark, folder, ids, strict=True))


@query(f"SELECT node_id AS query_id, width, total FROM ({_SUMS}) WHERE node_id % {graph.QUERY_STEP} = 0")
def src_emb_pt_queries(spark, d):
    """The questions' vectors from one file that maps ids to them."""
    path = f"{new_path(spark, 'query')}/query_emb_dict.pt"
    tensors.write_dictionary(graph.query_emb(spark, d).where("embedding is not null").select(F.col("query_id").alias("key"), "embedding"), path)
    read = tensors.read_dictionary(spark, path).select(F.col("key").cast("long").alias("node_id"), F.lit(None).alias("node_type"), "embedding")
    return _sums(read).select(F.col("node_id").alias("query_id"), "width", "total")
