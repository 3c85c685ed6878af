"""What depends on the order of a whole log, without one task that reads it all.

Rows are numbered densely by ranges and cut into blocks. What a block does to a state is summed up, the summaries are scanned
in the same way, and each block then starts from the state that it is given.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .numbering import positions

#: Rows of a block.
BLOCK = 100_000


def running_max(rows: DataFrame, by: Sequence[str], at: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``name``: the greatest ``value`` so far in the order of ``at`` (dense from 0 in each group of ``by``)."""
    cut = rows.withColumn("_v", value).withColumn("_b", F.floor(F.col(at) / block))
    inside = Window.partitionBy(*by, "_b").orderBy(at)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    greatest = cut.groupBy(*by, "_b").agg(F.max("_v").alias("_v"))  # a row for each block
    ends = greatest.select(*(F.col(c).alias(f"_of_{c}") for c in (*by, "_b")), F.max("_v").over(before).alias("_before"))
    met = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*by, "_b")]
    whole = cut.withColumn("_inside", F.max("_v").over(inside)).join(ends, met)
    return whole.select(*rows.columns, F.greatest("_inside", "_before").alias(name))


def automaton(rows: DataFrame, order: Sequence[str], symbol: Column, transitions: Sequence[Sequence[int]], start: int = 0, name: str = "state", block: int = BLOCK) -> DataFrame:
    """``rows`` with ``name``: the state of a finite automaton before each row, read in ``order`` (which no two rows may share).

    ``transitions[symbol][state]`` is the next state; a row whose symbol is null or unknown changes nothing. A block's transitions are composed
    into one, and those of the blocks are run by the same automaton of compositions, so no task reads more than a block.
    """
    table = np.asarray(transitions, np.int32)
    kinds = F.when((symbol >= 0) & (symbol < len(table)), symbol).otherwise(-1).cast("int")
    numbered = written(positions(rows, [], order, "_at").withColumn("_symbol", kinds), "numbered")
    steps = numbered.select("_at", F.col("_symbol").alias("step"))
    whole = np.vstack([table, np.arange(table.shape[1], dtype=np.int32)])  # the last, so -1, changes nothing
    states = _states(steps, lambda step: whole[step], start, table.shape[1], block, name)
    return numbered.join(states, "_at").select(*rows.columns, name)


def _states(steps: DataFrame, of, start: int, width: int, block: int, name: str) -> DataFrame:
    """(_at, ``name``): the state before each of ``steps`` (_at, step), where ``of(step)`` is what a step makes of each state."""
    cut = steps.withColumn("_b", F.floor(F.col("_at") / block))

    def composed(group: pd.DataFrame) -> pd.DataFrame:
        now = np.arange(width, dtype=np.int32)
        for step in group.sort_values("_at")["step"]:
            now = of(step)[now]
        return pd.DataFrame({"_at": group["_b"].iloc[:1], "step": [now.tolist()]})

    def walked(key, group: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        group, state, out = group.sort_values("_at"), int(given["state"].iloc[0]), []
        for step in group["step"]:  # none where the log is empty
            out.append(state)
            state = int(of(step)[state])
        return pd.DataFrame({"_at": group["_at"], name: np.array(out, np.int32)})

    last = steps.agg(F.max("_at")).first()[0]
    spark = steps.sparkSession
    if last is None or last < block:
        starts = spark.createDataFrame([(0, start)], "_b long, state int")
    else:
        summed = written(cut.groupBy("_b").applyInPandas(composed, "_at long, step array<int>"), "composed")
        inner = _states(summed, lambda step: np.asarray(step, np.int32), start, width, block, "state")
        starts = inner.withColumnRenamed("_at", "_b")
    return cut.groupBy("_b").cogroup(starts.groupBy("_b")).applyInPandas(walked, f"_at long, `{name}` int")


def speculated(rows: DataFrame, at: str, run, entry: str, out: str, block: int = BLOCK) -> DataFrame:
    """What ``run`` makes of ``rows`` in the order of ``at`` (dense from 0), block by block, where a block's start depends on the one before.

    ``run(rows, state)`` takes a block's rows as a pandas frame in order and the state before it (None: nothing was before) and returns (frame
    with ``at`` and what ``out`` declares, state after it); ``entry`` is the SQL type of a state. All blocks first run as if nothing was before them;
    then those whose start turns out otherwise run again, all at once, until none does. So the result is that of one run from end to end. Where states
    forget their past soon, that takes two or three rounds; at worst as many as there are blocks.
    """
    spark = rows.sparkSession
    cut = written(rows.withColumn("_b", F.floor(F.col(at) / block)), "blocks")
    names = [at, *(f.split()[0] for f in out.split(","))]

    def known(given: pd.DataFrame):
        state = given["state"].iloc[0] if len(given) else None
        return None if isinstance(state, float) and state != state else state  # pandas' null of numbers

    def after(key, group: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(given):
            return pd.DataFrame({"_b": [], "state": []})
        _, state = run(group.sort_values(at), known(given))
        return pd.DataFrame({"_b": [key[0]], "state": [state]})

    def made(key, group: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        found, _ = run(group.sort_values(at), known(given))
        return found[names]

    schema = f"_b long, state {entry}"
    starts = written(cut.select("_b").distinct().withColumn("state", F.lit(None).cast(entry)), "starts")
    todo, ends = starts, None
    while True:
        fresh = written(cut.join(todo.select("_b"), "_b", "left_semi").groupBy("_b").cogroup(todo.groupBy("_b")).applyInPandas(after, schema), "ends")
        ends = fresh if ends is None else written(ends.join(fresh, "_b", "left_anti").unionByName(fresh), "ends")
        given = ends.select((F.col("_b") + 1).alias("_b"), F.col("state").alias("_new"))
        moved = starts.join(given, "_b", "left").withColumn("_changed", ~F.col("state").eqNullSafe(F.col("_new")))
        moved = written(moved, "moved")
        todo = written(moved.where("_changed").select("_b", F.col("_new").alias("state")), "todo")
        if todo.isEmpty():
            break
        starts = written(moved.select("_b", F.col("_new").alias("state")), "starts")
    kind = ", ".join([f"`{at}` long", out])
    results = cut.groupBy("_b").cogroup(starts.groupBy("_b")).applyInPandas(made, kind)
    return cut.drop("_b").join(results, at)

