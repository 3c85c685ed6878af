"""Groups of texts that share 0.8 or more of their five-word shingles: links by SimHash, and all others by an exact join.

Texts with the same set of shingles are one node. First, nodes whose SimHash fingerprints (over their shingles) differ in few
bits are linked by the deletion-variant signatures of ``simhash``. Fingerprints miss pairs near the threshold, so the rest
is found exactly: all sets are put into one order of shingles, frequent ones last; two sets of n and m shingles with a
Jaccard of 4/5 or more must then share one of their first n // 5 + 1 and m // 5 + 1, and where the first that they share
stands bounds what they can share in all. Each set that meets others under a shingle is first compared with one hub of
these; then only pairs that lie in different clusters are searched for, for the others add nothing to the components.

Every pair, also of fingerprints, is verified by its whole sets before it counts as a link. Before that, counts of both
sets' shingles in ``CELLS`` cells of a hash bound what they can share, so that few texts are read again; these are picked
out by a sieve of bounded size, so that the others aren't shuffled.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, apart, forget, sieve, sifted, union_all, written
from .components import components
from .simhash import BLOCK, _dealt, majority, shingle_hashes, words_of
from .simhash import links as simhash_links

#: Words of a shingle; one document in so many is looked at for frequent shingles; seen so often there, a shingle is frequent; so many
#: of these, the most frequent ones, are told to all tasks (4 MB). All but the first decide how much is compared, not what is found.
WIDTH, SAMPLED, FREQUENT, TOLD = 5, 16, 3, 1 << 18
#: Cells that a set's shingles are counted in; larger sets than this are not counted, and so only verified.
CELLS, COUNTED = 256, 16_384


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes, ascending; a text of five words or fewer is one shingle."""
    return np.unique(shingle_hashes(words_of(text), WIDTH))


def _sets(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(keep, shingles) of every row's text."""
    fields = [T.StructField("shingles", T.ArrayType(T.LongType()))]
    return add_columns(df.select(*keep, "text"), "text", fields, lambda: lambda texts: [[shingles(t).view(np.int64) for t in texts]], keep_text=False)


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ``TOLD`` shingles that stand most often in a sample of ``docs`` (_row, text), ascending, and how often."""
    sample = _sets(docs.where(F.pmod(F.xxhash64("_row"), F.lit(SAMPLED)) == 0), ())
    seen = sample.select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= FREQUENT)
    seen = seen.orderBy(F.desc("count"), "s").limit(TOLD).toPandas()
    hashes, times = seen["s"].to_numpy(np.int64).view(np.uint64), seen["count"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], times[order]


def prefixes(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, _row, text) without texts, with node (of the set of shingles), n (its size), fp, cells and keys: its first n // 5 + 1 shingles."""
    often = docs.sparkSession.sparkContext.broadcast(frequent(docs))
    fields = T.StructType.fromDDL("node long, n int, fp long, cells array<short>, keys array<long>").fields

    def step():
        hashes, times = often.value

        def one(text):
            mine = shingles(text)
            rank = np.zeros(len(mine), np.int64)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
                rank = np.where(hashes[at] == mine, times[at], 0)
            node = int.from_bytes(xxhash.xxh64_digest(mine.tobytes()), "big", signed=True)
            cells = np.bincount((mine & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.int16) if len(mine) <= COUNTED else None
            return node, len(mine), majority(mine), cells, mine[np.lexsort((mine, rank))][: len(mine) // 5 + 1].view(np.int64)

        return lambda texts: list(zip(*map(one, texts), strict=True))

    return add_columns(docs.select("doc_id", "_row", "text"), "text", fields, step, keep_text=False)


def _can(x: str, y: str) -> Column:
    """Whether sets that share no earlier shingle than the one at ``pos`` can have a Jaccard of 4/5."""
    most = F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos"))
    return 9 * most >= 4 * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard of 4/5 or more; ``nodes`` (node, _row, n, cells) says whose text has a node's set."""
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met")
    places = sieve(pairs.select(F.explode(F.array("a", "b")).alias("node")), "node")
    few = sifted(nodes, "node", places)
    end = lambda e: few.select(F.col("node").alias(e), F.col("n").alias(f"n_{e}"), F.col("cells").alias(f"cells_{e}"))
    most = F.aggregate(F.zip_with("cells_a", "cells_b", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    ends = pairs.join(apart(end("a")), "a").join(apart(end("b")), "b")
    met, pairs = pairs, written(ends.where(F.coalesce(9 * most >= 4 * (F.col("n_a") + F.col("n_b")), F.lit(True))).select("a", "b"), "pairs")
    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(apart(few.select("node", "_row")), "node"), "needed")
    texts = sifted(docs, "_row", sieve(needed, "_row")).join(apart(needed), "_row")
    sets = written(_sets(texts, ("node",)), "sets")
    side = lambda e: sets.select(F.col("node").alias(e), F.col("shingles").alias(f"_{e}"))
    both = pairs.join(apart(side("a")), "a").join(apart(side("b")), "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    found = written(both.where(9 * shared >= 4 * (F.size("_a") + F.size("_b"))).select("a", "b"), "verified")
    forget(met, pairs, needed, sets)
    return found


def _clusters(links: DataFrame, name: str) -> DataFrame:
    return written(components(links, name), "clusters")


def groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, _row, node, top, component_id): top is a node of the component of ``docs`` (doc_id, _row, text), component_id its least doc_id.

    Components are what chains of pairs with a Jaccard of 4/5 or more reach. ``docs`` is read several times, so hand it over as
    a table. Rows with a null id take part and can lend no id; a component of such rows alone has a null id. Repeated rows
    stay repeated; no rows give none.
    """
    docs = docs.select("doc_id", "_row", "text")
    prints = written(prefixes(docs), "prints")
    first = lambda c: F.first(c).alias(c)
    nodes = written(prints.groupBy("node").agg(*(first(c) for c in ("n", "fp", "cells", "keys")), F.min("doc_id").alias("least"), F.min("_row").alias("_row"), F.count("*").alias("docs")), "nodes")
    names = written(prints.select("doc_id", "_row", "node"), "names")
    forget(prints)

    prints_alike = simhash_links(nodes.select("node", "fp", "docs"), block)
    near = _verified(prints_alike, nodes, docs)
    forget(prints_alike)

    every = nodes.select("node", "n", "docs", F.posexplode("keys").alias("pos", "key"))
    held = every.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    rows = written(every.join(apart(held), "key"), "rows")
    in_cluster = lambda links, name: rows.join(apart(_clusters(links, name)), "node", "left").withColumn("cluster", F.coalesce("component", "node")).drop("component")
    named = written(in_cluster(near, "near"), "named")
    hubs = written(named.groupBy("key").agg(F.max_by(F.struct("node", "n", "pos", "cluster"), F.struct("docs", "node")).alias("hub")), "hubs")
    met = named.alias("x").join(apart(hubs), "key").where((F.col("x.cluster") != F.col("hub.cluster")) & _can("x", "hub"))
    stars = _verified(met.select(F.col("node").alias("a"), F.col("hub.node").alias("b")), nodes, docs)
    forget(named)

    named = written(in_cluster(near.union(stars), "stars").join(apart(hubs.select("key", F.col("hub.node").alias("hub"))), "key"), "named")
    forget(rows, hubs)
    # pairs of two clusters have an end outside the hub's cluster; those with the hub itself are known
    homes = named.where("node = hub").select("key", F.col("cluster").alias("home"))
    mixed = named.where("node <> hub").join(apart(homes), "key").select("key", "node", "n", "pos", "held", "cluster", (F.col("cluster") == F.col("home")).alias("inside"))
    mixed = written(mixed, "mixed")
    open_keys = written(mixed.where("not inside").groupBy("key").agg(F.ceil(F.max("held") / block).cast("int").alias("size")), "open")
    right = written(mixed.drop("held").join(apart(open_keys), "key"), "right")
    ours = (F.col("x.cluster") != F.col("y.cluster")) & (F.col("y.inside") | (F.col("x.node") < F.col("y.node"))) & _can("x", "y")
    ends = [F.col("x.node").alias("a"), F.col("y.node").alias("b")]
    few = right.where("size = 1")
    pairs = few.where("not inside").alias("x").join(apart(few.alias("y")), (F.col("x.key") == F.col("y.key")) & ours).select(*ends)
    large = open_keys.where("size > 1").select("key", F.col("size").alias("n_blocks"))
    if not large.isEmpty():
        many = _dealt(right.where("size > 1").drop("size").withColumnRenamed("n", "n_set"), large.withColumnRenamed("n_blocks", "n")).withColumnRenamed("n_set", "n")
        same = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
        own = (F.least("x.mine", "y.mine") == F.col("x.i")) & (F.greatest("x.mine", "y.mine") == F.col("x.j"))
        pairs = pairs.union(many.where("not inside").alias("x").join(apart(many.alias("y")), same & own & ours).select(*ends))
    found = _verified(pairs, nodes, docs)
    forget(named, mixed, open_keys, right)

    clusters = _clusters(union_all([near, stars, found]), "links")
    ends = written(nodes.select("node", "least").join(apart(clusters), "node", "left").select("node", "least", F.coalesce("component", "node").alias("top")), "ends")
    forget(nodes)
    tops = written(ends.groupBy("top").agg(F.min("least").alias("component_id")), "tops")
    return names.join(apart(ends.join(apart(tops), "top").select("node", "top", "component_id")), "node")
