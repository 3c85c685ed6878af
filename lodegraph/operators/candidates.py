"""Candidates for the symbols of a question: exact names, then the nearest vectors, then an anchor moved to the front.

    symbols     query_id, symbol, ord, types (array), name, semantic (array), constant
    candidates  query_id, symbol, node_id, score, ord
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import without_fence

#: Fixed values. Candidates of a symbol; least similarity; the same two of the earlier pipeline.
LIMIT, CUTOFF, OLD_CUTOFF = 20, 0.65, 0.75
#: Fixed values. The anchor check: candidates looked at, distinct ones shown, scores that make it unneeded, score of the chosen one.
LOOKED_AT, SHOWN, SURE, LIKELY, CHOSEN = 15, 3, 1.0, 0.80, 0.99
#: Fixed values. Longest answer in which a bare digit counts, and the digits that do.
SHORT_ANSWER, DIGITS = 20, ("0", "1", "2", "3", "4", "5")


def exact_names(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """``asked`` (..., node_type, name) with the nodes of just that type and name; upper and lower case differ."""
    return asked.join(nodes.select("node_type", "name", "node_id"), ["node_type", "name"])


def initial(exact: DataFrame, near: DataFrame, limit: int = LIMIT, cutoff: float = CUTOFF, skip_when_full: bool = False) -> DataFrame:
    """(query_id, node_id, score, ord): exact hits with score 1, then the nearest others until there are ``limit``.

    ``exact`` (query_id, node_id), ``near`` (query_id, node_id, score). With ``limit`` exact hits or more nothing is
    added, so the list may be longer than ``limit``; ``skip_when_full`` counts distinct hits, else every hit counts.
    """
    hits = exact.groupBy("query_id").agg((F.count_distinct("node_id") if skip_when_full else F.count("*")).alias("_hits"))
    others = near.where(F.col("score") >= cutoff).join(exact.select("query_id", "node_id").distinct(), ["query_id", "node_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("node_id"))
    room = F.greatest(F.lit(0), limit - F.coalesce("_hits", F.lit(0)))
    added = others.withColumn("_r", F.row_number().over(w)).join(hits, "query_id", "left").where(F.col("_r") <= room).select("query_id", "node_id", "score")
    both = exact.select("query_id", "node_id").distinct().withColumn("score", F.lit(1.0)).unionByName(added)
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("node_id"))))


def needs_anchor(symbols: DataFrame, candidates: DataFrame) -> DataFrame:
    """The symbols worth asking about: constant, named, not the answer, with candidates, none of them sure or likely."""
    best = candidates.groupBy("query_id", "symbol").agg(F.max("score").alias("_best"))
    return symbols.join(best, ["query_id", "symbol"]).where((F.col("symbol") != "ANSWER") & F.col("constant") & (F.coalesce("name", F.lit("")) != "") & (F.col("_best") < LIKELY)).drop("_best")


def shown(candidates: DataFrame, key: list[str]) -> DataFrame:
    """The first ``SHOWN`` distinct of the first ``LOOKED_AT`` candidates, numbered from 1."""
    first = candidates.where(F.col("ord") <= LOOKED_AT).groupBy(*key, "node_id").agg(F.min("ord").alias("ord"))
    return first.withColumn("choice", F.row_number().over(Window.partitionBy(*key).orderBy("ord"))).where(F.col("choice") <= SHOWN)


def promoted(candidates: DataFrame, choices: DataFrame, key: list[str]) -> DataFrame:
    """The chosen candidate first, with score ``CHOSEN``; the others behind it in their order. Choice 0 changes nothing.

    ``choices`` (key, choice): recorded answers; a number that was not shown counts as 0.
    """
    chosen = shown(candidates, key).join(choices, [*key, "choice"]).select(*key, F.col("node_id").alias("_chosen"))
    marked = candidates.join(chosen, key, "left").withColumn("_is", F.col("node_id").eqNullSafe(F.col("_chosen")))
    moved = marked.withColumn("score", F.when(F.col("_is"), F.lit(CHOSEN)).otherwise(F.col("score")))
    w = Window.partitionBy(*key).orderBy(F.col("_is").desc(), "ord")
    return moved.withColumn("ord", F.row_number().over(w)).drop("_is", "_chosen")


def _first_object(text: Column) -> Column:
    """The text from its first opening brace to the next closing one; null where it has no such."""
    behind = F.substr(text, F.greatest(F.instr(text, "{"), F.lit(1)))
    return F.when(behind.startswith("{") & behind.contains("}"), F.concat(F.substring_index(behind, "}", 1), F.lit("}")))


def choice_of(answer: Column, n: Column) -> Column:
    """The number that an answer gives, in 0..n, else 0.

    The answer, or the first object in it, is read as JSON, and its ``choice`` counts. Where there is an object that can't be read
    and the answer is no longer than ``SHORT_ANSWER``, the first word that is one of ``DIGITS`` counts.
    """
    said = F.coalesce(without_fence(answer), F.lit(""))
    objects = F.filter(F.transform(F.array(said, _first_object(said)), lambda x: F.from_json(x, "map<string,string>")), lambda m: m.isNotNull())
    given = F.when(F.size(objects) > 0, F.coalesce(F.try_element_at(F.get(objects, F.lit(0)), F.lit("choice")).try_cast("double").cast("int"), F.lit(0)))
    digits = F.filter(F.split(said, "[^0-9A-Za-z_]+"), lambda w: w.isin(*DIGITS))
    guessed = F.when(_first_object(said).isNotNull() & (F.char_length(said) <= SHORT_ANSWER), F.get(digits, F.lit(0)).cast("int"))
    number = F.coalesce(given, guessed, F.lit(0))
    return F.when(number.between(0, n), number).otherwise(0)
