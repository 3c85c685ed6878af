"""Vector search by inner product, exact, with types, masks, exclusions, cutoffs and complements.

Scores are rounded to ``DIGITS`` before they are ranked, and ties go to the smaller node id, so results are the same
on every cluster. All questions meet all nodes in one stage; each task multiplies its nodes with a block of questions and
passes on each question's best k alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_batches

#: Digits of a score; bytes of question vectors, and of a task's node vectors, as doubles, that are held at once; bytes of a product; scored
#: rows that a task holds, besides the best, before it drops those that can't be among them, and before it passes all on.
DIGITS, QUESTION_BYTES, NODE_BYTES, PRODUCT_BYTES, HELD_ROWS, PASSED_ROWS = 6, 32 << 20, 64 << 20, 2 << 20, 1 << 18, 2 << 20
#: A mask that names less than one in so many of a slice's pairs is multiplied pair by pair, else all with all.
SPARSE = 16


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two arrays in double precision; null where one is null or their lengths differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.round(F.when(F.size(a) == F.size(b), product), DIGITS)


def similarities(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node_id, node_type, score) of every question with every node of the question's type: the equi-join prunes by type."""
    n = nodes.withColumnRenamed("embedding", "_v")
    return queries.join(n, "node_type").select("query_id", "node_id", "node_type", dot("embedding", "_v").alias("score"))


def pair_scores(pairs: DataFrame, queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (query_id, node_id, ...) with score: only asked-for vectors are multiplied. Unknown ids have a null score."""
    q = queries.select("query_id", F.col("embedding").alias("_q"))
    n = nodes.select("node_id", F.col("embedding").alias("_v"))
    return pairs.join(n, "node_id", "left").join(q, "query_id", "left").withColumn("score", dot("_q", "_v")).drop("_q", "_v")


def ranked(scored: DataFrame, by: list[str], order: list[Column] | None = None, name: str = "rank") -> DataFrame:
    """``scored`` with its place in each group: best score first, then smaller node id."""
    order = order or [F.col("score").desc(), F.col("node_id").asc()]
    return scored.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def cut(scored: DataFrame, cutoff: float | None) -> DataFrame:
    """Rows of at least the cutoff; a cutoff that is null or not positive lets everything pass, negative scores too."""
    return scored if cutoff is None or cutoff <= 0 else scored.where(F.col("score") >= cutoff)


class _Questions:
    """Question vectors as a matrix, with their lengths; each question has a type."""

    def __init__(self, ids: np.ndarray, types: Sequence[str | None], matrix: np.ndarray):
        self.ids, self.types, self.matrix = ids, np.array(types, dtype=object), matrix
        self.norms = np.linalg.norm(matrix, axis=1)


class _Best:
    """The best ``k`` nodes of each question: rows that can't be among them are dropped as others come."""

    def __init__(self, questions: int, k: int):
        self.k, self.least = k, np.full(questions, -np.inf)
        self.rows: list[tuple[np.ndarray, ...]] = []  # question, node, kind, score
        self.held = self.kept = 0

    def add(self, *row: np.ndarray) -> None:
        self.rows.append(row)
        self.held += len(row[0])
        if self.held > HELD_ROWS + 2 * self.kept:
            self.settle()

    def settle(self) -> None:
        """Keeps each question's first ``k``, best score first, then smaller node id."""
        question, node, kind, score = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((node, -score, question))
        question, node, kind, score = question[order], node[order], kind[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], question[1:] != question[:-1]]))
        place = np.arange(len(question)) - np.repeat(first, np.diff(np.concatenate([first, [len(question)]])))
        last = place == self.k - 1
        self.least[question[last]] = score[last]
        keep = place < self.k
        self.rows, self.held = [(question[keep], node[keep], kind[keep], score[keep])], int(keep.sum())
        self.kept = self.held

    def taken(self) -> tuple[np.ndarray, ...]:
        self.settle()
        (rows,) = self.rows
        self.rows, self.held = [], 0
        return rows


def _search(q: _Questions, batches: Iterator[tuple], k: int | None, least: float | None, typed: bool, by_type: bool) -> Iterator[pa.RecordBatch]:
    """Each question's best ``k`` (null: all) of the nodes (ids, types, vectors) that score ``least`` or more, and with ``by_type`` of each type.

    Products are taken in slices of ``PRODUCT_BYTES``, longest node vectors first: where no question's length times the slice's longest reaches what it
    has to beat, the rest is left out, for no product exceeds that of the lengths. What is held is ``HELD_ROWS`` and three times the best of
    each question; where the types make that more than ``PASSED_ROWS``, it is passed on early.
    """
    floor, names, best = -np.inf if least is None else least, [], {}

    def rows(question, node, kind, score) -> pa.RecordBatch:
        kinds = pa.array(names, pa.string()).take(pa.array(kind))
        return pa.RecordBatch.from_arrays([pa.array(q.ids[question]), pa.array(node), kinds, pa.array(score)], names=["query_id", "node_id", "node_type", "score"])

    for node, kinds, vectors in batches:
        codes = np.empty(len(node), np.int64)
        present = dict.fromkeys(kinds.tolist())
        for name in present:
            if name not in names:
                names.append(name)
            present[name] = names.index(name)
        for i, name in enumerate(kinds):
            codes[i] = present[name]
        lengths = np.linalg.norm(vectors, axis=1)
        for name, code in present.items() if typed or by_type else [(None, None)]:
            asked = np.flatnonzero(q.types == name) if typed else np.arange(len(q.ids))
            mine = np.arange(len(node)) if code is None else np.flatnonzero(codes == code)
            if not len(asked):
                continue
            mine = mine[np.argsort(-lengths[mine], kind="stable")]
            own = None if k is None else best.setdefault(code if by_type else None, _Best(len(q.ids), k))
            step = max(1, PRODUCT_BYTES // (8 * len(asked)))
            for start in range(0, len(mine), step):
                some = mine[start : start + step]
                bar = np.full(len(asked), floor) if own is None else np.maximum(own.least[asked], floor)
                reach = q.norms[asked] * lengths[some[0]]
                if (reach + 1e-9 * reach + 10.0**-DIGITS < bar).all():
                    break
                scores = np.round(vectors[some] @ q.matrix[asked].T, DIGITS)
                at, question = np.nonzero(scores >= bar)
                found = asked[question], node[some[at]], codes[some[at]], scores[at, question]
                if own is not None:
                    own.add(*found)
                elif len(at):
                    yield rows(*found)
        if sum(b.held for b in best.values()) > PASSED_ROWS:
            for b in best.values():
                if b.rows:
                    yield rows(*b.taken())
    for b in best.values():
        if b.rows:
            yield rows(*b.taken())


def _columns(table: pa.RecordBatch | pa.Table) -> tuple:
    """(ids, types, vectors) of columns that stand in this order."""
    ids, kinds, vectors = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns[:3])
    width = len(vectors.flatten()) // max(1, len(vectors))
    matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), width)
    return ids.to_numpy(zero_copy_only=False), np.array(kinds.to_pylist(), dtype=object), matrix


def _found(queries: DataFrame, nodes: DataFrame, k: int | None, cutoff: float | None, typed: bool, by_type: bool) -> DataFrame:
    """Questions of at most ``QUESTION_BYTES`` together are told to every task, which reads its part of the nodes once.

    More of them are dealt into blocks of that size, the nodes into parts of ``NODE_BYTES``, and each block meets each part in a task of its own: what
    is shuffled is nodes times blocks plus questions times parts, and a task holds one of each.
    """
    least = cutoff if cutoff is not None and cutoff > 0 else None
    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long"), "node_type", "embedding")
    whole = nodes.where("embedding is not null").select(F.col("node_id").cast("long"), "node_type", "embedding")
    n, width = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    schema = "query_id long, node_id long, node_type string, score double"
    if not n:
        return queries.sparkSession.createDataFrame([], schema)
    size = 8 * width
    if n * size <= QUESTION_BYTES:
        held = nodes.sparkSession.sparkContext.broadcast(_columns(asked.toArrow()))

        def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step))
            yield from _search(_Questions(*held.value), map(_columns, parts), k, least, typed, by_type)

        step = max(1, NODE_BYTES // (8 * size))
        return whole.mapInArrow(every, schema)
    blocks, parts = -(-n * size // QUESTION_BYTES), max(1, -(-whole.count() * size // NODE_BYTES))
    # a block's share is about even, as ids are hashed; half the room is left for it not to be
    place = lambda *names: F.xxhash64(*names)
    left = asked.withColumn("block", F.pmod(place("query_id", "node_type"), F.lit(2 * blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = whole.withColumn("part", F.pmod(place("node_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 * blocks - 1).cast("long"))))

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        found = list(_search(_Questions(*_columns(a)), iter([_columns(b)]), k, least, typed, by_type)) if a.num_rows and b.num_rows else []
        kinds = [("query_id", pa.int64()), ("node_id", pa.int64()), ("node_type", pa.string()), ("score", pa.float64())]
        return pa.Table.from_batches(found, pa.schema(kinds))

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(met, schema)


def top_k(queries: DataFrame, nodes: DataFrame, k: int, cutoff: float | None = None, typed: bool = True, by_type: bool = False) -> DataFrame:
    """(query_id, node_id, node_type, score, rank): each question's best ``k`` nodes, fewer if there are fewer.

    ``typed``: only nodes of the question's own type (a question may have several rows, one for each type); else of any
    type. ``by_type`` ranks within each type, else over all.
    """
    found = _found(queries, nodes, k, cutoff, typed, by_type)
    return ranked(found, ["query_id", "node_type"] if by_type else ["query_id"]).where(F.col("rank") <= k)


def every(queries: DataFrame, nodes: DataFrame, cutoff: float | None = None) -> DataFrame:
    """(query_id, node_id, node_type, score) of every question with every node, of at least the cutoff: nothing is shuffled or sorted, and low scores don't leave the task."""
    return _found(queries, nodes, None, cutoff, typed=False, by_type=False)


def _by_mask(queries: DataFrame, nodes: DataFrame) -> Callable[[DataFrame, bool], DataFrame] | None:
    """What makes (query_id, node_id, node_type, score) of the pairs that a mask names, or of all others; null where the questions are too many to be told.

    The mask is gathered by node, and each node's list meets the node's vector once; so neither scores nor vectors are shuffled for each pair.
    Vectors of another length than the questions', or with nulls, have no score.
    """
    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long"), "node_type", "embedding")
    n, least, width = asked.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if not n or least != width or n * 8 * width > QUESTION_BYTES or not asked.where(F.exists("embedding", lambda x: x.isNull())).isEmpty():
        return None
    small_batches(queries.sparkSession)
    held = nodes.sparkSession.sparkContext.broadcast(_columns(asked.toArrow()))
    whole = nodes.where((F.size("embedding") == width) & ~F.exists("embedding", lambda x: x.isNull())).select(F.col("node_id").cast("long"), "node_type", "embedding")
    step = max(1, PRODUCT_BYTES // (8 * n))

    def scored(mask: DataFrame, inside: bool) -> DataFrame:
        named = mask.select("query_id", F.col("node_id").cast("long")).where("query_id is not null").groupBy("node_id").agg(F.collect_set(F.col("query_id").cast("long")).alias("_named"))

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = _Questions(*held.value)
            ids, place = np.unique(q.ids, return_inverse=True)
            once = np.argsort(place) if len(ids) == len(place) else None
            for b in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
                node, kinds, vectors = _columns(b)
                lists = b.column(3)
                lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                values = lists.flatten().to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(ids, values), len(ids) - 1)
                known = ids[at] == values
                row, named_at = np.repeat(np.arange(len(node)), lengths)[known], at[known]
                if inside and once is not None and len(row) * SPARSE < len(node) * len(ids):
                    question = once[named_at]  # few are asked for: only they are multiplied
                    scores = np.round(np.einsum("ij,ij->i", vectors[row], q.matrix[question]), DIGITS)
                else:
                    there = np.zeros((len(node), len(ids)), bool)
                    there[row, named_at] = True
                    row, question = np.nonzero(there[:, place] == inside)
                    scores = np.round(vectors @ q.matrix.T, DIGITS)[row, question] if len(row) else None
                if not len(row):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(q.ids[question]), pa.array(node[row]), pa.array(kinds[row], pa.string()), pa.array(scores)], names=["query_id", "node_id", "node_type", "score"])

        return whole.join(named, "node_id", "inner" if inside else "left").mapInArrow(some, "query_id long, node_id long, node_type string, score double")

    return scored


def masking(queries: DataFrame, nodes: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What makes (query_id, node_id, node_type, score) of a mask, each pair once: no other scores leave the task. Unknown ids are left out."""
    found = _by_mask(queries, nodes)
    if found is not None:
        return lambda mask: found(mask, True)

    def by_pairs(mask: DataFrame) -> DataFrame:
        pairs = mask.select("query_id", "node_id").distinct().join(nodes.select("node_id", "node_type"), "node_id")
        return pair_scores(pairs, queries, nodes).where("score is not null").select("query_id", "node_id", "node_type", "score")

    return by_pairs


def masked(queries: DataFrame, nodes: DataFrame, mask: DataFrame) -> DataFrame:
    """(query_id, node_id, node_type, score) of what the mask names, each pair once."""
    return masking(queries, nodes)(mask)


def unmasked(queries: DataFrame, nodes: DataFrame, mask: DataFrame) -> DataFrame:
    """(query_id, node_id, node_type, score) of every question with every node that the mask doesn't name for it; named scores don't leave the task."""
    found = _by_mask(queries, nodes)
    return excluded(every(queries, nodes), mask) if found is None else found(mask, False)


def excluded(scored: DataFrame, exclude: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Only rows that the exclusion doesn't name."""
    return scored.join(exclude, on or ["query_id", "node_id"], "left_anti")


def with_complement(queries: DataFrame, nodes: DataFrame, mask: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of the mask, and where the mask names fewer than ``k`` nodes, so many of the best others behind them.

    How many others there are depends on the mask's length, not on its hits. At most ``k`` come from the mask and at most
    ``k`` from elsewhere, so the best 2 ``k`` of all nodes hold the others.
    """
    first = ranked(masked(queries, nodes, mask), ["query_id"]).where(F.col("rank") <= k)
    wanted = queries.select("query_id").distinct().join(mask.groupBy("query_id").agg(F.count("*").alias("_n")), "query_id", "left").select("query_id", (k - F.coalesce("_n", F.lit(0))).alias("_wanted"))
    hits = first.groupBy("query_id").agg(F.count("*").alias("_hits"))
    rest = ranked(top_k(queries, nodes, 2 * k, typed=False).drop("rank").join(first, ["query_id", "node_id"], "left_anti"), ["query_id"]).join(wanted, "query_id").where(F.col("rank") <= F.col("_wanted"))
    rest = rest.join(hits, "query_id", "left").withColumn("rank", (F.col("rank") + F.coalesce("_hits", F.lit(0))).cast("int"))
    return first.unionByName(rest.select(first.columns))


def reordered(pairs: DataFrame, queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (query_id, node_id, ord) ranked by similarity, equal ones in their given order; an unknown id is an error."""
    scored = pair_scores(pairs, queries, nodes)
    known = scored.withColumn("score", F.coalesce("score", F.raise_error(F.format_string("no vector for node %s", F.col("node_id"))).cast("double")))
    return ranked(known, ["query_id"], [F.col("score").desc(), F.col("ord").asc()])


def vectors_for(texts: DataFrame, by_text: DataFrame, by_query: DataFrame, remembered: DataFrame) -> DataFrame:
    """``texts`` (query_id, text) with the vector of the text, else of the question, else a remembered one, and where it is from.

    What none of the three has is left null for a provider to fill, each distinct text once.
    """
    t = by_text.select("text", F.col("embedding").alias("_t"))
    q = by_query.select("query_id", F.col("embedding").alias("_q"))
    r = remembered.select("text", F.col("embedding").alias("_r"))
    found = texts.join(t, "text", "left").join(q, "query_id", "left").join(r, "text", "left")
    source = F.when(F.col("_t").isNotNull(), "text").when(F.col("_q").isNotNull(), "query").when(F.col("_r").isNotNull(), "remembered").otherwise("provider")
    return found.withColumn("embedding", F.coalesce("_t", "_q", "_r")).withColumn("source", source).drop("_t", "_q", "_r")


def cache_key(text: str | Column, query_id: str | Column) -> Column:
    """What a remembered vector is found by: the text, with the question's id behind it; an id of 0 counts as none."""
    text, id_ = (F.col(x) if isinstance(x, str) else x for x in (text, query_id))
    return F.when(F.coalesce(id_, F.lit(0)) != 0, F.concat_ws("_", text, id_)).otherwise(text)


class VectorCache:
    """Remembered vectors as a table (key, embedding); each change gives a new cache, so a plan sees the one it was built with."""

    def __init__(self, held: DataFrame):
        self.held = held

    def put(self, new: DataFrame) -> VectorCache:
        """With the vectors of ``new`` (text, query_id, embedding, seq) too: the last one by ``seq`` takes the place of a held one; null ones aren't kept."""
        kept = new.where(F.col("embedding").isNotNull()).groupBy(cache_key("text", "query_id").alias("key")).agg(F.max_by("embedding", "seq").alias("embedding"))
        return VectorCache(self.held.join(kept, "key", "left_anti").unionByName(kept))

    def get(self, texts: DataFrame) -> DataFrame:
        """``texts`` (text, query_id, ...) with embedding, null where none is held; nothing is computed for them."""
        return texts.withColumn("_key", cache_key("text", "query_id")).join(self.held.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")

    def clear(self) -> VectorCache:
        return VectorCache(self.held.limit(0))

    def size(self) -> int:
        return self.held.count()


def type_counts(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(node_type, nodes) for every type asked for; 0 for a type without nodes."""
    counted = nodes.groupBy("node_type").agg(F.count("*").alias("nodes"))
    return asked.select("node_type").distinct().join(counted, "node_type", "left").withColumn("nodes", F.coalesce("nodes", F.lit(0)).cast("long"))
