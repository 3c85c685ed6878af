"""Best-first grounding of a question's graph.

One round takes, for each symbol in order, its best candidate that has not been expanded, follows the question's relations
from it, scores the neighbours against the symbol they would stand for, and adds or strengthens candidates there. Rounds
go on until the answer is full or nothing is left. Two policies differ in how they choose, score and stop.

The steps are DataFrame functions; a whole run is exact and order-dependent. Which neighbours a candidate has, and how alike
they are, is not: only its best ones along each relation count, however many there are. These short lists are made for all
questions at once, by joins and a ranking that is cut before the shuffle, so a node of very many edges meets no task whole. What
depends on order is then a fold over lists whose number the policy bounds, question by question; a question that takes a
candidate without lists is folded again when these have been made.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


#: Lists that are made ahead of the fold in any case; deeper ones wait until a question comes to them. Results don't depend on it.
AHEAD = 20_000
#: Edges of a question's part that a task holds at most; questions that come to more go by lists.
PART = 200_000


@dataclass(frozen=True)
class Policy:
    """What a run is governed by; the defaults are the main pipeline's."""

    neighbors: int = 15
    decay: float = 0.9
    boost: float = 0.25
    answers: int = 20
    per_symbol: int = 1000
    #: support: most supported first, then best score. score: best score alone.
    choose_by: str = "support"
    #: drop: neighbours of other types vanish. half: they count 0.5.
    unscored: str = "drop"
    epsilon: float = 1e-9


MAIN = Policy()
ALTERNATIVE = Policy(neighbors=10, boost=0.15, answers=100, per_symbol=100, choose_by="score", unscored="half", epsilon=1e-6)


def cut(df: DataFrame) -> DataFrame:
    """The frame as a table in shared storage, so that its lineage ends there."""
    return written(df, "cut")


def propagated(similarity: Column, source: Column, policy: Policy = MAIN) -> Column:
    """A new candidate's score: harmonic mean of its similarity and the decayed score of where it was reached from."""
    d, e = source * policy.decay, policy.epsilon
    mean = 2 / (1 / similarity + 1 / d)
    if policy.choose_by == "score":
        return F.when((similarity > e) & (d > e), mean).otherwise(0.1)
    return F.when((similarity > e) & (d > e), mean).when(similarity > e, similarity * policy.decay).when(d > e, d * policy.decay).otherwise(0.1)


def strengthened(score: Column, source: Column, support: Column, policy: Policy = MAIN) -> Column:
    """The score after a triplet that was not there before: the larger of own and source score, times 1 + boost * ln(support + 1)."""
    return F.greatest(score, source) * (1 + policy.boost * F.log(support + 1))


def adjacency(relations: DataFrame) -> DataFrame:
    """(query_id, symbol, other, relation, ord): each relation seen from both of its symbols; one from a symbol to itself twice."""
    there = relations.select("query_id", F.col("src_sym").alias("symbol"), F.col("dst_sym").alias("other"), "relation", "ord")
    return there.unionByName(relations.select("query_id", F.col("dst_sym").alias("symbol"), F.col("src_sym").alias("other"), "relation", "ord"))


def popped(candidates: DataFrame) -> DataFrame:
    """Each symbol's next candidate: unprocessed, most supported, best scored, of least id."""
    w = Window.partitionBy("query_id", "symbol").orderBy(F.col("support").desc(), F.col("score").desc(), F.col("node_id"))
    return candidates.where(~F.col("processed")).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def expanded(sources: DataFrame, adjacent: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, symbol, node_id, score, other, relation, ord, neighbor): equi-joins on the symbol, then on (src, relation)."""
    steps = sources.join(adjacent, ["query_id", "symbol"])
    e = edges.select(F.col("src").alias("node_id"), "relation", F.col("dst").alias("neighbor"))
    return steps.join(e, ["node_id", "relation"])


def best_neighbors(scored: DataFrame, by: list[str], k: int = MAIN.neighbors) -> DataFrame:
    """The ``k`` most similar neighbours of each group, equal ones by id, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.col("similarity").desc(), F.col("neighbor"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def inserted(arrivals: DataFrame, candidates: DataFrame, limit: int) -> DataFrame:
    """The arrivals (query_id, symbol, node_id, seq, ...) that are new and find room, in their order; the first of a node counts."""
    key = ["query_id", "symbol", "node_id"]
    new = arrivals.join(candidates.select(*key), key, "left_anti")
    new = new.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("seq"))).where("_k = 1").drop("_k")
    held = candidates.groupBy("query_id", "symbol").agg(F.count("*").alias("_held"))
    place = F.row_number().over(Window.partitionBy("query_id", "symbol").orderBy("seq"))
    return new.withColumn("_place", place).join(held, ["query_id", "symbol"], "left").where(F.col("_place") + F.coalesce("_held", F.lit(0)) <= limit).drop("_place", "_held")


def updated(candidates: DataFrame, arrivals: DataFrame, policy: Policy = MAIN) -> DataFrame:
    """``candidates`` (..., score, support, triplets) after the arrivals (key, seq, triplet, source): a fold in arrival order."""
    key = ["query_id", "symbol", "node_id"]
    came = arrivals.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "triplet", "source"))).alias("_came"))
    rows = candidates.join(came, key, "left")
    start = F.struct(F.col("score").alias("score"), F.col("support").alias("support"), F.col("triplets").alias("triplets"))

    def take(acc: Column, a: Column) -> Column:
        grown = F.struct(strengthened(acc["score"], a["source"], acc["support"] + 1, policy).alias("score"), (acc["support"] + 1).alias("support"), F.array_append(acc["triplets"], a["triplet"]).alias("triplets"))
        return F.when(F.array_contains(acc["triplets"], a["triplet"]), acc).otherwise(grown)

    rows = rows.withColumn("_s", F.aggregate(F.coalesce("_came", F.array().cast("array<struct<seq: bigint, triplet: string, source: double>>")), start, take))
    return rows.select(*key, F.col("_s.score").alias("score"), F.col("_s.support").alias("support"), F.col("_s.triplets").alias("triplets"))


def answers(candidates: DataFrame, order: str = "main") -> DataFrame:
    """The answer's candidates ranked: ``main`` by support, then score; ``old`` by score, then the less supported; ties in order of arrival."""
    by = {"main": [F.col("support").desc(), F.col("score").desc()], "old": [F.col("score").desc(), F.col("support").asc()]}[order]
    w = Window.partitionBy("query_id").orderBy(*by, "seq")
    return candidates.where("symbol = 'ANSWER'").withColumn("rank", F.row_number().over(w))


def kept_paths(paths: DataFrame, limit: int = 50) -> DataFrame:
    """Of each candidate's paths (key, ord, scores) the ``limit`` of greatest product, in their own order; support is their number."""
    weight = F.aggregate("scores", F.lit(1.0), lambda acc, s: acc * s)
    key = ["query_id", "node_id"]
    ranked = paths.withColumn("weight", weight).withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("weight").desc(), "ord"))).where(F.col("_r") <= limit).drop("_r")
    return ranked.withColumn("support", F.count("*").over(Window.partitionBy(*key)))


@dataclass
class Candidate:
    node: int
    score: float
    support: int = 1
    triplets: set = field(default_factory=set)
    paths: dict = field(default_factory=lambda: defaultdict(list))
    #: The score under which the candidate waits; one that has fallen since is not found any more.
    waits: float = 0.0
    #: How often the candidate waits under that score.
    entries: int = 1


class Run:
    """One question's grounding, held in memory: its candidates, the edges and similarities that it can reach."""

    def __init__(self, symbols: list[str], types: dict[str, set], relations: list[tuple[str, str, str]], edges: dict, kinds: dict, similar: dict, policy: Policy, known: set | None = None):
        #: The nodes whose edges are at hand; None: all.
        self.known = known
        self.symbols, self.types, self.edges, self.kinds, self.similar, self.policy = symbols, types, edges, kinds, similar, policy
        self.around: dict[str, list] = defaultdict(list)
        for a, b, r in relations:
            self.around[a].append((b, r))
            self.around[b].append((a, r))
        self.held: dict[str, dict[int, Candidate]] = {"ANSWER": {}}
        self.done: dict[str, set] = defaultdict(set)

    def start(self, symbol: str, node: int, score: float) -> None:
        mine = self.held.setdefault(symbol, {})
        if node in mine and self.policy.choose_by == "score":
            mine[node].entries += 1
            mine[node].score = mine[node].waits = score
        else:
            mine[node] = Candidate(node, score, waits=score)

    def limit(self, symbol: str) -> int:
        return self.policy.answers if symbol == "ANSWER" else self.policy.per_symbol

    def next(self, symbol: str) -> Candidate | None:
        mine, done = self.held.get(symbol, {}), self.done[symbol]
        if self.policy.choose_by == "support":
            return min((c for c in mine.values() if c.node not in done), key=lambda c: (-c.support, -c.score, c.node), default=None)
        found = min((c for c in mine.values() if c.entries and abs(c.score - c.waits) < 1e-9), key=lambda c: (-c.score, c.node), default=None)
        if found:
            found.entries -= 1
        return found

    def likeness(self, symbol: str, node: int) -> float | None:
        """Null: the neighbour vanishes."""
        wanted = self.types.get(symbol)
        if not wanted or (symbol, None) not in self.similar:
            return 0.5
        if self.kinds.get(node) in wanted and (symbol, node) in self.similar:
            return self.similar[symbol, node]
        return None if self.policy.unscored == "drop" else 0.5

    def near(self, node: int, relation: str, symbol: str) -> list[tuple[float, int]]:
        """(likeness, neighbour): the best neighbours along a relation as candidates of ``symbol``."""
        found = [(s, n) for n in self.edges.get((node, relation), ()) if (s := self.likeness(symbol, n)) is not None]
        return sorted(found, key=lambda x: (-x[0], x[1]))[: self.policy.neighbors]

    def ready(self, symbol: str, node: int) -> bool:
        """Whether all that expanding takes is at hand."""
        return self.known is None or not self.around[symbol] or node in self.known

    def expand(self, symbol: str, source: Candidate) -> None:
        p = self.policy
        self.done[symbol].add(source.node)
        score, d = source.score, source.score * p.decay
        for other, relation in self.around[symbol]:
            for s, node in self.near(source.node, relation, other):
                if node not in self.done[other]:
                    self.arrive(symbol, source.node, score, relation, other, node, self.blend(s, d))

    def blend(self, s: float, d: float) -> float:
        e, p = self.policy.epsilon, self.policy
        if s > e and d > e:
            return 2 / (1 / s + 1 / d)
        if p.choose_by == "score":
            return 0.1
        return s * p.decay if s > e else d * p.decay if d > e else 0.1

    def arrive(self, origin: str, source: int, source_score: float, relation: str, symbol: str, node: int, score: float) -> None:
        mine, triplet = self.held.setdefault(symbol, {}), (origin, relation, symbol)
        c = mine.get(node)
        if c is None:
            if len(mine) >= self.limit(symbol):
                return
            c = mine[node] = Candidate(node, score, waits=score)
            c.triplets.add(triplet)
        elif triplet in c.triplets:
            return
        else:
            before = c.score
            c.triplets.add(triplet)
            c.support += 1
            c.score = max(before, source_score) * (1 + self.policy.boost * math.log(c.support + 1))
            if c.score > before:
                c.waits, c.entries = c.score, 1
        c.paths[origin].append((source, source_score))

    def beyond(self) -> set[int]:
        """Candidates that may yet be expanded and whose edges are not at hand."""
        return {n for s in self.symbols if s != "ANSWER" and self.around[s] for n in self.held.get(s, {}) if n not in self.known and n not in self.done[s]}

    def all(self) -> dict[str, dict[int, Candidate]] | None:
        """None: the next candidate isn't ready."""
        p, waiting = self.policy, [s for s in self.symbols if s != "ANSWER"]
        while True:
            moved, still = False, []
            for symbol in waiting:
                size = len(self.held.get(symbol, {}))
                if size >= p.per_symbol and (p.choose_by == "score" or len(self.done[symbol]) >= size):
                    if p.choose_by == "support":
                        still.append(symbol)
                    continue
                c = self.next(symbol)
                if c is None:
                    if p.choose_by == "support":
                        still.append(symbol)
                    continue
                still.append(symbol)
                if c.node not in self.done[symbol]:  # else the symbol's turn is lost
                    if not self.ready(symbol, c.node):
                        return None
                    self.expand(symbol, c)
                    moved = True
            waiting = still
            if len(self.held["ANSWER"]) >= p.answers or not moved:
                return self.held


class ListedRun(Run):
    """A run over lists of best neighbours by (node, relation, symbol), as far as they have been made."""

    def __init__(self, symbols: list[str], relations: list[tuple[str, str, str]], lists: dict, policy: Policy):
        super().__init__(symbols, {}, relations, {}, {}, {}, policy)
        self.lists = lists

    def near(self, node: int, relation: str, symbol: str) -> list[tuple[float, int]]:
        return self.lists[node, relation, symbol]

    def ready(self, symbol: str, node: int) -> bool:
        return all((node, relation, other) in self.lists for other, relation in self.around[symbol])

    def lacking(self) -> list[tuple[str, int]]:
        """(symbol, node): candidates that may yet be expanded and have not all their lists."""
        return [(s, n) for s in self.symbols if s != "ANSWER" for n in self.held.get(s, {}) if n not in self.done[s] and not self.ready(s, n)]


@dataclass
class Gathering:
    """What lists of best neighbours are made of; ``similar`` makes (query_id, symbol, node_id, score) from pairs (query_id, node_id)."""

    symbols: DataFrame
    relations: DataFrame
    edges: DataFrame
    nodes: DataFrame
    similar: Callable[[DataFrame], DataFrame]
    policy: Policy
    #: (query_id, other, _has): symbols that have similarities; by default those that have some among the first lists' neighbours.
    vectors: DataFrame | None = None

    def lists(self, wanted: DataFrame, known: DataFrame | None) -> DataFrame:
        """(query_id, other, relation, node_id, near) for candidates (query_id, symbol, node_id) that ``known`` doesn't have; near may be empty."""
        key = ["query_id", "other", "relation", "node_id"]
        asked = wanted.join(adjacency(self.relations).select("query_id", "symbol", "other", "relation").distinct(), ["query_id", "symbol"]).select(*key).distinct()
        asked = asked if known is None else asked.join(known.select(*key), key, "left_anti")
        e = self.edges.select(F.col("src").alias("node_id"), "relation", F.col("dst").alias("neighbor"))
        met = cut(asked.join(e, ["node_id", "relation"], "left").distinct())  # a key without edges stands there with a null neighbour
        kinds = self.nodes.select(F.col("node_id").alias("neighbor"), "node_type")
        types = self.symbols.select("query_id", F.col("symbol").alias("other"), F.filter("types", lambda t: t.isNotNull() & (t != "")).alias("_types"))
        pairs = met.where("neighbor is not null").select("query_id", F.col("neighbor").alias("node_id")).distinct()
        scores = self.similar(pairs).select("query_id", F.col("symbol").alias("other"), F.col("node_id").alias("neighbor"), F.col("score").alias("_s"))
        if self.vectors is None:
            self.vectors = cut(scores.select("query_id", "other").distinct().withColumn("_has", F.lit(True)))
        vectors = self.vectors
        rows = met.join(kinds, "neighbor", "left").join(types, ["query_id", "other"], "left").join(vectors, ["query_id", "other"], "left")
        rows = rows.join(scores, ["query_id", "other", "neighbor"], "left")
        unscored = F.lit(None).cast("double") if self.policy.unscored == "drop" else F.lit(0.5)
        blind = (F.coalesce(F.size("_types"), F.lit(0)) <= 0) | F.col("_has").isNull()
        fits = F.coalesce(F.array_contains("_types", F.col("node_type")), F.lit(False)) & F.col("_s").isNotNull()
        similarity = F.when(F.col("neighbor").isNotNull(), F.when(blind, F.lit(0.5)).when(fits, F.col("_s")).otherwise(unscored))
        # what isn't like comes last, and a first row of each key stays, so that every key has a list
        best = best_neighbors(rows.withColumn("similarity", similarity), key, self.policy.neighbors)
        return best.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("similarity").isNotNull(), F.struct("rank", "similarity", "neighbor")))).alias("near"))

    def around(self, wanted: DataFrame, known: DataFrame | None, hops: int) -> DataFrame:
        """``known`` with the lists of ``wanted`` (query_id, symbol, node_id), and of what stands on them, ``hops`` deep, or deeper while they are few."""
        hop, made = 0, 0
        while hop < hops or made < AHEAD:
            new = cut(self.lists(wanted, known))
            known = new if known is None else known.unionByName(new)
            count = new.count()
            if not count:  # all that stands on the lists has lists
                break
            hop, made = hop + 1, made + count
            wanted = new.select("query_id", F.col("other").alias("symbol"), F.explode("near").alias("n")).where("symbol <> 'ANSWER'")
            wanted = wanted.select("query_id", "symbol", F.col("n.neighbor").alias("node_id")).distinct()
        return known


def reachable(starts: DataFrame, relations: DataFrame, edges: DataFrame, hops: int, known: DataFrame | None = None) -> DataFrame:
    """(query_id, src, relation, dst): the edges that ``hops`` steps along the question's relations can reach from ``starts`` (query_id, node_id).

    Sources in ``known`` (query_id, src) are left out; a source that has no edges along a relation stands there with a null dst.
    """
    named = relations.select("query_id", "relation").distinct()
    front = starts.select("query_id", F.col("node_id").alias("src")).distinct()
    step = lambda: front.join(named, "query_id").join(edges.select("src", "relation", "dst"), ["src", "relation"], "left").select("query_id", "src", "relation", "dst")
    for _ in range(hops - 1):
        # what has been reached stays in the front, so that each step stands in the plan once
        front = step().select("query_id", F.explode(F.array_compact(F.array("src", "dst"))).alias("src")).distinct()
    if known is not None:
        front = front.join(known, ["query_id", "src"], "left_anti")
    return step()


def ground(
    symbols: DataFrame, relations: DataFrame, candidates: DataFrame, edges: DataFrame, nodes: DataFrame,
    similar: DataFrame | Callable[[DataFrame], DataFrame], policy: Policy = MAIN, hops: int = 3,
) -> DataFrame:
    """(query_id, symbol, node_id, score, support, seq): every symbol's candidates, seq in the order they were found.

    ``symbols`` (query_id, symbol, ord, types), ``relations`` (query_id, src_sym, dst_sym, relation, ord), ``candidates``
    (query_id, symbol, node_id, score, ord), ``edges`` (src, relation, dst; symmetric), ``nodes`` (node_id, node_type), ``similar``
    (query_id, symbol, node_id, score), or what makes it from pairs (query_id, node_id); a symbol without similarities (of those made:
    to its candidates' neighbours) has no vector. ``hops`` is how deep lists are made ahead and bounds nothing: questions that come to a candidate without lists are
    folded again with more, a step deeper each time. Questions whose part of the graph has ``PART`` edges at most are folded over it at once, all
    others over lists; both give the same. What a task holds of a question is its candidates and their lists: ``policy.per_symbol`` candidates
    a symbol and ``policy.neighbors`` entries a list, whatever the edges of a node.
    """
    candidates = cut(candidates)
    kinds = nodes.select(F.col("node_id").alias("dst"), "node_type")
    part = cut(reachable(candidates, relations, edges, hops).join(kinds, "dst", "left"))
    made = similar if callable(similar) else (lambda pairs: similar.join(pairs, ["query_id", "node_id"], "left_semi"))
    vectors = None if callable(similar) else similar.select("query_id", "symbol").distinct()
    ended, given, large = [], (symbols, relations, candidates), None
    while True:
        over = part.where("dst is not null").groupBy("query_id").agg(F.count("*").alias("_n")).where(F.col("_n") > PART).select("query_id")
        if not over.isEmpty():
            over = cut(over)
            large = over if large is None else large.unionByName(over)
            part = part.join(over, "query_id", "left_anti")
            given = [df.join(over, "query_id", "left_anti") for df in given]
        pairs = part.where("dst is not null").select("query_id", F.col("dst").alias("node_id")).distinct()
        found = cut(_attempt(*given, part, made(pairs), vectors, policy))
        ended.append(found.where("symbol is not null"))
        lacking = found.where("symbol is null").select("query_id", "node_id")
        if lacking.isEmpty():
            break
        again = lacking.select("query_id").distinct()
        given = [df.join(again, "query_id", "left_semi") for df in (symbols, relations, candidates)]
        part = part.join(again, "query_id", "left_semi")
        more = reachable(lacking, given[1], edges, hops, part.select("query_id", "src").distinct()).join(kinds, "dst", "left")
        part = cut(part.unionByName(more))
    if large is not None:
        given = (cut(df.join(large, "query_id", "left_semi")) for df in (symbols, relations, candidates))
        ended.append(by_lists(*given, edges, nodes, similar, policy, hops))
    whole = ended[0]
    for e in ended[1:]:
        whole = whole.unionByName(e)
    return whole


def by_lists(
    symbols: DataFrame, relations: DataFrame, candidates: DataFrame, edges: DataFrame, nodes: DataFrame,
    similar: DataFrame | Callable[[DataFrame], DataFrame], policy: Policy = MAIN, hops: int = 3,
) -> DataFrame:
    """``ground`` for questions whose part of the graph may be of any size."""
    made = similar if callable(similar) else (lambda pairs: similar.join(pairs, ["query_id", "node_id"], "left_semi"))
    vectors = None if callable(similar) else similar.select("query_id", F.col("symbol").alias("other")).distinct().withColumn("_has", F.lit(True))
    gather = Gathering(symbols, relations, edges, nodes, made, policy, vectors)
    lists = gather.around(candidates.where("symbol <> 'ANSWER'").select("query_id", "symbol", "node_id").distinct(), None, hops)
    ended, given = [], (symbols, relations, candidates)
    while True:
        found = cut(_folded(*given, lists, policy))
        ended.append(found.where("seq is not null"))
        lacking = found.where("seq is null").select("query_id", "symbol", "node_id")
        if lacking.isEmpty():
            break
        hops += 1  # few questions are left, so their lists are made deeper
        again = lacking.select("query_id").distinct()
        given = [df.join(again, "query_id", "left_semi") for df in (symbols, relations, candidates)]
        lists = gather.around(lacking, cut(lists.join(again, "query_id", "left_semi")), hops)
    whole = ended[0]
    for e in ended[1:]:
        whole = whole.unionByName(e)
    return whole


def _attempt(symbols: DataFrame, relations: DataFrame, candidates: DataFrame, part: DataFrame, similar: DataFrame, vectors: DataFrame | None, policy: Policy) -> DataFrame:
    """What ``ground`` gives for the questions whose edges in ``part`` suffice; of others the nodes to gather next, without a symbol.

    A symbol has a vector if it has a row in ``similar`` or in ``vectors`` (query_id, symbol).
    """
    blank = {"a": "string", "b": "string", "c": "string", "n": "long", "m": "long", "x": "double", "k": "int"}

    def rows(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
        return df.select("query_id", F.lit(kind).alias("kind"), *(columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in blank.items()))

    col = F.col
    fed = (
        rows(symbols, "symbol", a=col("symbol"), b=F.array_join("types", "\x1f"), k=col("ord"))
        .unionByName(rows(relations, "relation", a=col("src_sym"), b=col("dst_sym"), c=col("relation"), k=col("ord")))
        .unionByName(rows(candidates, "candidate", a=col("symbol"), n=col("node_id"), x=col("score"), k=col("ord")))
        .unionByName(rows(part, "edge", c=col("relation"), n=col("src"), m=col("dst"), b=col("node_type")))
        .unionByName(rows(similar, "similar", a=col("symbol"), n=col("node_id"), x=col("score")))
    )
    if vectors is not None:
        fed = fed.unionByName(rows(vectors, "similar", a=col("symbol")))

    def one(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        of = lambda name: table.filter(pc.equal(table.column("kind"), name))
        ordered = lambda name: sorted(zip(*(c.to_pylist() for c in of(name).select(list(blank)).columns)), key=lambda r: (r[6] or 0, str(r[0]), str(r[1]), str(r[2]), r[3] or 0))
        names, steps, likely = ordered("symbol"), of("edge"), of("similar")
        known = set(_plain(steps, "n"))
        steps, scored = steps.filter(pc.is_valid(steps.column("m"))), likely.filter(pc.is_valid(likely.column("x")))
        edges_of: dict = defaultdict(set)
        for n, c, m in zip(_plain(steps, "n"), _plain(steps, "c"), _plain(steps, "m")):
            edges_of[n, c].add(m)
        kinds = dict(zip(_plain(steps, "m"), _plain(steps, "b")))
        likeness = {(a, None): 0.0 for a in likely.column("a").unique().to_pylist()}
        likeness |= zip(zip(_plain(scored, "a"), _plain(scored, "n")), _plain(scored, "x"))
        run = Run([r[0] for r in names], {r[0]: set(filter(None, (r[1] or "").split("\x1f"))) for r in names}, [r[:3] for r in ordered("relation")], edges_of, kinds, likeness, policy, known)
        for a, _, _, n, _, x, _ in ordered("candidate"):
            run.start(a, n, math.nan if x is None else x)
        query = table.column("query_id")[0].as_py()
        held = run.all()
        out = list(_found(query, held)) if held is not None else [(query, None, n, None, None, None) for n in sorted(run.beyond())]
        schema = pa.schema([("query_id", pa.int64()), ("symbol", pa.string()), ("node_id", pa.int64()), ("score", pa.float64()), ("support", pa.int32()), ("seq", pa.int32())])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, schema.types)], schema=schema)

    return fed.groupBy("query_id").applyInArrow(one, "query_id long, symbol string, node_id long, score double, support int, seq int")


def _plain(table: pa.Table, name: str) -> list:
    """A column's values; of strings, which repeat, each is made once. Numbers aren't null."""
    column = table.column(name).combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        return column.to_numpy(zero_copy_only=False).tolist()
    coded = column.dictionary_encode()
    values = [*coded.dictionary.to_pylist(), None]
    return [values[i] for i in coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).tolist()]


def _folded(symbols: DataFrame, relations: DataFrame, candidates: DataFrame, lists: DataFrame, policy: Policy) -> DataFrame:
    """What ``ground`` gives for the questions whose lists suffice; of others the candidates that lack some, without seq."""
    blank = {"a": "string", "b": "string", "c": "string", "n": "long", "x": "double", "k": "int", "near": "array<struct<rank: int, similarity: double, neighbor: bigint>>"}

    def rows(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
        return df.select("query_id", F.lit(kind).alias("kind"), *(columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in blank.items()))

    col = F.col
    fed = (
        rows(symbols, "symbol", a=col("symbol"), k=col("ord"))
        .unionByName(rows(relations, "relation", a=col("src_sym"), b=col("dst_sym"), c=col("relation"), k=col("ord")))
        .unionByName(rows(candidates, "candidate", a=col("symbol"), n=col("node_id"), x=col("score"), k=col("ord")))
        .unionByName(rows(lists, "list", a=col("other"), c=col("relation"), n=col("node_id"), near=col("near")))
    )

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {kind: list(g.itertuples(index=False)) for kind, g in pdf.groupby("kind")}
        ordered = lambda kind: sorted(parts.get(kind, []), key=lambda r: (r.k, str(r.a), str(r.b), str(r.c), 0 if pd.isna(r.n) else r.n))
        near = {(int(r.n), r.c, r.a): [(float(x["similarity"]), int(x["neighbor"])) for x in r.near] for r in parts.get("list", [])}
        run = ListedRun([r.a for r in ordered("symbol")], [(r.a, r.b, r.c) for r in ordered("relation")], near, policy)
        for r in ordered("candidate"):
            run.start(r.a, int(r.n), float(r.x))
        query = int(pdf["query_id"].iloc[0])
        held = run.all()
        out = list(_found(query, held)) if held is not None else [(query, s, n, None, None, None) for s, n in run.lacking()]
        return pd.DataFrame(out, columns=["query_id", "symbol", "node_id", "score", "support", "seq"])

    return fed.groupBy("query_id").applyInPandas(one, "query_id long, symbol string, node_id long, score double, support int, seq int")


def _found(query: int, held: dict[str, dict[int, Candidate]]) -> Iterator[tuple]:
    for symbol, mine in held.items():
        for k, c in enumerate(mine.values()):
            yield query, symbol, c.node, c.score, c.support, k
