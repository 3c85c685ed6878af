"""Calls of remote models dealt to keys: when each may start, with which key, what a refusal changes, and in which batch."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .numbering import positions
from .scans import BLOCK, automaton, running_max, speculated

#: Microseconds that a call counts against its key's limit.
WINDOW = 62_000_000


def admitted(calls: DataFrame, at: str, order: Sequence[str], keys: int, limit: int, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``calls`` with ``position`` (dense, by ``at`` and then ``order``) and ``start``: the earliest time each may start, in order of arrival.

    Every key takes ``limit`` calls in any ``window`` (both times in microseconds); a call that is ``window`` old no longer counts. Some key has room exactly
    if fewer than ``keys * limit`` calls count, so a call starts when it arrives or when the one that many places before it stops counting. That is a
    running maximum in each of ``keys * limit`` interleaved sequences, taken block by block.
    """
    many = keys * limit
    numbered = positions(calls, [], [at, *order])
    turn = F.floor(F.col("position") / many)
    cut = numbered.withColumn("_lane", F.col("position") % many).withColumn("_turn", turn)
    scanned = running_max(cut, ["_lane"], "_turn", F.col(at) - F.col("_turn") * window, "_most", block)
    return scanned.withColumn("start", F.col("_most") + F.col("_turn") * window).drop("_lane", "_turn", "_most")


def keyed(scheduled: DataFrame, keys: int, limit: int, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``scheduled`` (position, start, ...) with ``key``: the first key with room when the call starts.

    Which key that is depends on all calls that count then, and on when they took theirs. Where all keys were full before calls that start at one time, and those
    that have stopped counting since had started at one time, too, the calls take their places in order, so each has the key of the one ``keys * limit``
    before. Such calls change nothing for later ones: a key is kept for each remainder of positions by that number. Only the others choose; blocks of them
    run at once and again where the choices before turn out to have left other keys. Each call then has the last choice of its remainder, a running maximum.
    """
    many = keys * limit
    held = written(_counting(scheduled, many, window, block), "counting")
    chosen = written(positions(held.where("_chooses").select("position", "_held"), [], ["position"], "_at"), "choices")

    def run(rows: pd.DataFrame, state) -> tuple[pd.DataFrame, list]:
        taken, out = [-1] * many if state is None else [int(k) for k in state], []
        used, before, oldest = [], None, 0
        for position, counting in zip(rows["position"].tolist(), rows["_held"].tolist()):
            if before is None or before + 1 < position:
                used = [0] * (keys + 1)  # the last is of keys that aren't known
                oldest = position - counting
                for back in range(1, counting + 1):
                    used[taken[(position - back) % many]] += 1
            while oldest < position - counting:
                used[taken[oldest % many]] -= 1
                oldest += 1
            # a start that is only guessed may have no room; it is found wrong
            key = next((k for k in range(keys) if used[k] < limit), 0)
            taken[position % many] = key
            used[key] += 1
            before = position
            out.append(key)
        for back in range(counting + 1, many):  # these have stopped counting, and must not make states differ
            taken[(position - back) % many] = -1
        return pd.DataFrame({"_at": rows["_at"], "key": np.array(out, np.int32)}), taken

    made = speculated(chosen, "_at", run, "array<int>", "key int", block).select(F.col("position").alias("_p"), "key")
    cut = held.join(made, F.col("position") == F.col("_p"), "left").withColumn("_lane", F.col("position") % many).withColumn("_turn", F.floor(F.col("position") / many))
    last = running_max(cut, ["_lane"], "_turn", F.when(F.col("key").isNotNull(), F.col("_turn") * keys + F.col("key")), "_last", block)
    return last.select(*scheduled.columns, (F.col("_last") % keys).cast("int").alias("key"))


def _counting(scheduled: DataFrame, many: int, window: int, block: int) -> DataFrame:
    """``scheduled`` with ``_held``: how many calls before each count when it starts, and ``_chooses``: whether its key isn't that of ``many`` calls before.

    Starts rise with positions, so these are the last ones; a block is told the starts before it that this takes, of which ``many`` at most are equal."""
    here = F.floor(F.col("position") / block)
    starts = scheduled.select("position", "start")
    steps = F.sequence(here, F.floor((F.col("position") + 2 * many + 1) / block))
    dealt = starts.select("position", "start", F.explode(steps).alias("_b"))

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        at, start = rows["position"].to_numpy(), rows["start"].to_numpy()
        first, gone = np.searchsorted(start, start, "left"), np.searchsorted(start, start - window, "right")
        left = np.maximum(first - many, 0)  # whose place the first of those that start with a call takes
        follows = (first >= many) & (start[left] > start[first - 1] - window) & (start[gone - 1] == start[left])
        own = at // block == rows["_b"].to_numpy()
        return pd.DataFrame({"_p": at[own], "_held": (np.arange(len(start)) - gone)[own], "_chooses": ~follows[own]})

    told = dealt.groupBy("_b").applyInPandas(counted, "_p long, _held int, _chooses boolean")
    return scheduled.join(told, F.col("position") == F.col("_p")).drop("_p")


def rotated(attempts: DataFrame, order: Sequence[str], refused: Column, keys: int, first: int = 0, block: int = BLOCK) -> DataFrame:
    """``attempts`` with ``key`` (at the start ``first``), ``attempt`` (from 0, within its call) and ``outcome``: retried, given_up or ended.

    The key in use stays until a call is refused for its rate; then the next one, after the last the first, takes over and the call is tried again. The last of ``keys``
    attempts ends the call without a change. The log has the attempts in order; (key, attempt) is the state of an automaton over it.
    """
    state = lambda key, attempt: key * keys + attempt
    refusal = [state((k + 1) % keys, a + 1) if a < keys - 1 else state(k, 0) for k in range(keys) for a in range(keys)]
    other = [state(k, 0) for k in range(keys) for _ in range(keys)]
    refused = F.coalesce(refused, F.lit(False))
    walked = automaton(attempts, order, refused.cast("int"), [other, refusal], state(first % keys, 0), "_state", block)
    attempt = F.col("_state") % keys
    outcome = F.when(~refused, "ended").when(attempt < keys - 1, "retried").otherwise("given_up")
    return walked.withColumn("key", F.floor(F.col("_state") / keys).cast("int")).withColumn("attempt", attempt).withColumn("outcome", outcome).drop("_state")


def packed(prompts: DataFrame, tokens: str, order: Sequence[str], longest: int, step: int = 64) -> DataFrame:
    """``prompts`` with ``padded``, ``batch`` (dense from 0 over all) and ``status``: packed, or too_long with no batch.

    A batch holds prompts of about the same length, padded to a multiple of ``step``, and so many that their padded tokens stay within half of ``longest``; one prompt
    that is longer than that is a batch of its own, one longer than ``longest`` is left out and marked. Prompts without tokens are padded to ``step``. Shorter ones come first; within a length
    ``order`` decides. Numbers come from counts of each length, so no task sees all prompts.
    """
    padded = F.least(F.greatest(F.ceil(F.col(tokens) / step), F.lit(1)) * step, F.lit(longest)).cast("long")
    fits = F.coalesce(F.col(tokens) <= longest, F.lit(False))
    sized = prompts.withColumn("padded", F.when(fits, padded))
    room = F.greatest(F.floor(F.lit(longest) / 2 / F.col("padded")), F.lit(1)).cast("long")
    numbered = positions(sized.where(fits), ["padded"], order, "_at")
    counts = sized.where(fits).groupBy("padded").agg(F.ceil(F.count("*") / F.first(room)).alias("_n"))  # a row for each padded length
    before = Window.orderBy("padded").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("padded", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    batch = (F.col("_first") + F.floor(F.col("_at") / room)).cast("long").alias("batch")
    found = numbered.join(F.broadcast(firsts), "padded").select(*prompts.columns, "padded", batch, F.lit("packed").alias("status"))
    rest = sized.where(~fits).select(*prompts.columns, "padded", F.lit(None).cast("long").alias("batch"), F.lit("too_long").alias("status"))
    return found.unionByName(rest)


#: Parts of a model's name and what serves it, first match first; a name without any runs locally.
BACKENDS = (
    ("ollama", "ollama"), ("oss", "nvidia"), ("meta", "nvidia"), ("deep", "nvidia"), ("nvidia", "nvidia"), ("gpt", "openai"), ("deepseek", "deepseek"), ("gemini", "google"),
)


def backend(model: Column) -> Column:
    """What serves a model, by its name; null for no name."""
    part, served = BACKENDS[0]
    chosen = F.when(F.contains(model, F.lit(part)), served)
    for part, served in BACKENDS[1:]:
        chosen = chosen.when(F.contains(model, F.lit(part)), served)
    return F.when(model.isNotNull(), chosen.otherwise("local"))
