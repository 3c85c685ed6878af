"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints with at most 4 differing bits differ by at most one bit in one of three segments, for
two differing bits in each would make six. Each fingerprint is indexed by its three segments as they are, and by
every variant of a segment that has one bit blotted out: fingerprints equal in a segment meet under the segment,
those that differ in its bit p meet under the variant without p, one from the side with the bit and one from the
side without it. So no two meet twice in a segment. Pairs that meet are verified over all 64 bits.

What keeps large groups linear: equal fingerprints are one; each member of a segment's bucket is first linked to one
hub of the bucket; only pairs that these links leave in different clusters are then searched for, for the others add
nothing to the components. Buckets above ``BLOCK`` members are compared block by block in different tasks.
"""

from __future__ import annotations

from array import array

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, apart, forget, table, union_all, written
from .components import components

#: (first bit, bits) of each segment; differing bits that still link; members of a bucket that one task compares.
SEGMENTS, LINK_BITS, BLOCK = ((0, 21), (21, 21), (42, 22)), 4, 4096


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _signed(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little", signed=True)


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle, words joined by spaces; of all words where there are no more than ``width``."""
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, seed)], dtype=np.uint64)
    starts, digest = [0, *(e + 1 for e in ends)], xxhash.xxh64_intdigest
    return np.frombuffer(array("Q", [digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :])]), dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # on bytes both know ASCII only: A-Z, and \x20 \x09-\x0D


def majority(hashes: np.ndarray) -> int:
    """The fingerprint, as a signed long: a bit is 1 if it is in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += _bits(hashes[k : k + (1 << 16)]).sum(axis=0, dtype=np.int64)
    return _signed(2 * ones > len(hashes))


def fingerprint_of(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Of the hashes of all shingles, repeats included; a text without words has zero."""
    words = words_of(text)
    return majority(shingle_hashes(words, width, seed)) if words else 0


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", keep_text: bool = True) -> DataFrame:
    """``df`` with ``out``: the 64-bit SimHash as a signed long.

    Words are runs without ASCII white space, A-Z lower-cased; shingles are four words, repeats included. A text of
    fewer words is one shingle; null and wordless texts have fingerprint zero.
    """
    return add_columns(df, text, [T.StructField(out, T.LongType())], lambda: lambda texts: [[fingerprint_of(t) for t in texts]], keep_text)


def _near(a: str, b: str, bits: int = LINK_BITS) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def _segment(fp: Column, start: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << bits) - 1))


def _exact(nodes: DataFrame) -> DataFrame:
    """A row for each segment as it is: key is the segment's value under the segment's number."""
    keys = F.array(*(F.lit(k << 40).bitwiseOR(_segment(F.col("fp"), *s)) for k, s in enumerate(SEGMENTS)))
    return nodes.withColumn("key", F.explode(keys))


def _variants(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows for each segment with one bit blotted out, those whose bit is 0 and those whose bit is 1: key has the segment, the bit's place and the other bits."""
    places = [(k, start, bits, p) for k, (start, bits) in enumerate(SEGMENTS) for p in range(bits)]
    side = lambda start, p: F.shiftrightunsigned(F.col("fp"), start + p).bitwiseAND(F.lit(1))
    key = lambda k, start, bits, p: F.lit((k << 40) | ((p + 1) << 32)).bitwiseOR(_segment(F.col("fp"), start, bits).bitwiseAND(F.lit(~(1 << p))))
    of = lambda s: nodes.withColumn("key", F.explode(F.array_compact(F.array(*(F.when(side(start, p) == s, key(k, start, bits, p)) for k, start, bits, p in places)))))
    return of(0), of(1)


def _large(exact: DataFrame, block: int) -> DataFrame:
    """(key, n): every key, exact or variant, that may have over ``block`` rows, and in how many blocks it goes.

    A variant's rows are those of two exact segments, so only variants of an exact one with over half a block can be.
    """
    heavy = exact.groupBy("key").count().where(F.col("count") > block / 2)
    variants = F.expr("transform(sequence(0, if(shiftright(key, 40) = 2, 21, 20)), p -> (key & shiftleft(255L, 40)) | shiftleft(cast(p + 1 as bigint), 32) | (key & (shiftleft(1L, 32) - 1) & ~shiftleft(1L, p)))")
    every = heavy.select(F.explode(F.concat(F.array("key"), variants)).alias("key"), "count")
    return written(every.groupBy("key").agg(F.ceil((F.sum("count") + block / 2) / block).cast("int").alias("n")), "large")


def _dealt(rows: DataFrame, large: DataFrame) -> DataFrame:
    """The rows of large keys, dealt to pairs of blocks (i, j), i <= j; ``mine`` is a row's block. Two rows meet in just the pair of their own blocks."""
    blocks = rows.join(large, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda x: F.struct(F.least(x, F.col("mine")).alias("i"), F.greatest(x, F.col("mine")).alias("j")))
    return blocks.withColumn("pair", F.explode(pairs)).select(*rows.columns, "mine", "pair.i", "pair.j")


def _pairs(left: DataFrame, right: DataFrame, large: DataFrame | None) -> DataFrame:
    """Verified links (a, b) between rows that share a key and lie in different clusters; ``left`` = ``right``: each pair once."""
    verified = (F.col("x.cluster") != F.col("y.cluster")) & _near("x.fp", "y.fp")
    if left is right:
        verified = verified & (F.col("x.node") < F.col("y.node"))
    same = F.col("x.key") == F.col("y.key")
    ends = [F.col("x.node").alias("a"), F.col("y.node").alias("b")]
    if large is None:
        return left.alias("x").join(apart(right.alias("y")), same & verified).select(*ends)
    few = [side.join(large, "key", "left_anti") for side in (left, right)]
    many = [_dealt(side, large) for side in (left, right)]
    met = same & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    own = (F.least("x.mine", "y.mine") == F.col("x.i")) & (F.greatest("x.mine", "y.mine") == F.col("x.j"))
    cold = few[0].alias("x").join(apart(few[1].alias("y")), same & verified).select(*ends)
    return cold.union(many[0].alias("x").join(apart(many[1].alias("y")), met & own & verified).select(*ends))


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), written: so many of the links between ``nodes`` (node, fp, docs) that they have the components of all links.

    Nodes are linked whose fingerprints differ in at most ``LINK_BITS`` bits. ``nodes`` is read several times, so hand it over as a
    written table; no two rows have the same node, but fingerprints may repeat. Where a bucket has several, the node of most docs is its hub.
    """
    exact = _exact(nodes.select("node", "fp", "docs"))
    hubs = exact.groupBy("key").agg(F.max_by(F.struct("node", "fp"), F.struct("docs", "node")).alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = exact.join(apart(hubs), "key").where((F.col("node") != F.col("hub.node")) & _near("fp", "hub.fp"))
    stars = written(stars.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct(), "stars")
    first = written(components(stars, "star"), "clusters").withColumnRenamed("node", "_node")
    named = nodes.join(apart(first), F.col("node") == F.col("_node"), "left").select("node", "fp", F.coalesce("component", "node").alias("cluster"))
    named = written(named, "named")
    exact = _exact(named)
    large = _large(exact, block)
    many = None if large.isEmpty() else large
    found = written(union_all([stars, _pairs(exact, exact, many), _pairs(*_variants(named), many)]), "links")
    forget(stars, first, named, large)
    return found


def near_duplicates(prints: DataFrame, doc: str = "doc_id", block: int = BLOCK, fp: str = "fp") -> DataFrame:
    """(doc, fp, component_id): component_id is the least id among the documents that chains of links reach.

    Documents are linked whose fingerprints differ in at most 4 bits. ``prints`` (doc, fp) is read several times, so hand it over
    as a written table. Rows with a null id take part and can lend no id; a component of such rows alone has a null id. Repeated rows
    stay repeated; no rows give none.
    """
    nodes = written(prints.groupBy(F.col(fp).alias("node")).agg(F.min(doc).alias("least"), F.count("*").alias("docs")), "nodes")
    whole = components(links(nodes.withColumn("fp", F.col("node")), block), "links").withColumnRenamed("node", "_node")
    ends = written(nodes.join(apart(whole), F.col("node") == F.col("_node"), "left").select("node", "least", F.coalesce("component", "node").alias("top")), "ends")
    tops = written(ends.groupBy("top").agg(F.min("least").alias("component_id")), "tops")  # a side of its own, so that a join with a large component can be split
    found = ends.join(apart(tops), "top").select("node", "component_id")
    return prints.select(doc, fp, F.col(fp).alias("node")).join(apart(found), "node").select(doc, fp, "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    prints = written(fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False), "prints")
    return near_duplicates(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
