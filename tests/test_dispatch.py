import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import dispatch as d
from lodegraph.operators import scans

SF = "/root/testdata/sf0.01"


def simulated(calls, keys, limit, window):
    """(start, key) of each (time, id) in order, one after the other, as a manager of keys with a log for each would."""
    logs, out, now = [deque() for _ in range(keys)], [], 0
    for at, _ in sorted(calls):
        now = max(now, at)
        while True:
            for log in logs:
                while log and log[0] <= now - window:
                    log.popleft()
            key = next((k for k in range(keys) if len(logs[k]) < limit), None)
            if key is not None:
                break
            now = min(log[0] for log in logs) + window
        logs[key].append(now)
        out.append((now, key))
    return out


def held(spark, calls, keys, limit, window, block):
    df = spark.createDataFrame(calls, "called long, id long").repartition(5)
    rows = d.keyed(d.admitted(df, "called", ["id"], keys, limit, window, block), keys, limit, window, block).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(calls)))
    return [(r.start, r.key) for r in rows]


@pytest.mark.parametrize("mean, block", [(1, 40), (9, 64), (30, 25), (400, 1000)])
def test_schedule_as_simulated(spark, mean, block):
    r, now, calls = random.Random(mean), 0, []
    for k in range(700):
        now += r.choice([0, 0, r.randrange(2 * mean), r.randrange(2 * mean)])
        calls.append((now, k * 37 % 701))
    assert held(spark, calls, 3, 4, 100, block) == simulated(calls, 3, 4, 100)


def test_schedule_of_events(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("called"), F.col("event_id").alias("id"))
    calls = [(r.called, r.id) for r in events.collect()]
    got = held(spark, calls, 3, 10, d.WINDOW, 1500)
    assert got == simulated(calls, 3, 10, d.WINDOW)
    for key in range(3):
        starts = [s for s, k in got if k == key]
        assert all(b - a >= d.WINDOW for a, b in zip(starts, starts[10:]))


def folded(refusals, keys, first):
    key, attempt, out = first, 0, []
    for refused in refusals:
        again = bool(refused) and attempt < keys - 1
        out.append((key, attempt, "retried" if again else "given_up" if refused else "ended"))
        key, attempt = ((key + 1) % keys, attempt + 1) if again else (key, 0)
    return out


@pytest.mark.parametrize("keys, block", [(1, 10), (2, 7), (4, 30), (3, 5000)])
def test_rotation_as_folded(spark, keys, block):
    r = random.Random(keys)
    log = [r.choice([True, True, True, False, None]) for _ in range(1200)]
    df = spark.createDataFrame(list(enumerate(log)), "seq long, refused boolean").repartition(7)
    rows = d.rotated(df, ["seq"], F.col("refused"), keys, first=5, block=block).orderBy("seq").collect()
    assert [(x.key, x.attempt, x.outcome) for x in rows] == folded(log, keys, 5 % keys)


def test_automaton_over_many_levels(spark):
    """Blocks of blocks: three levels; unknown symbols change nothing."""
    r = random.Random(4)
    steps = [[1, 2, 3, 4, 0], [0, 0, 2, 2, 4]]
    log = [r.choice([0, 1, 7, None]) for _ in range(300)]
    rows = scans.automaton(spark.createDataFrame(list(enumerate(log)), "seq long, s int"), ["seq"], F.col("s"), steps, 2, block=6).orderBy("seq").collect()
    state = 2
    for x in rows:
        assert x.state == state
        state = steps[x.s][state] if x.s in (0, 1) else state


def test_speculation_that_is_always_wrong(spark):
    """A count of all rows so far: every block's start is another than guessed, and the result is right all the same."""
    df = spark.range(0, 50).withColumnRenamed("id", "n")

    def run(rows, state):
        before = 0 if state is None else int(state)
        rows = rows.assign(so_far=range(before, before + len(rows)))
        return rows, before + len(rows)

    got = scans.speculated(df, "n", run, "bigint", "so_far long", block=9).collect()
    assert all(x.so_far == x.n for x in got) and len(got) == 50


def test_running_max(spark):
    r = random.Random(6)
    rows = [(g, k, r.choice([None, r.randrange(100)])) for g in ("a", None) for k in range(60)]
    got = scans.running_max(spark.createDataFrame(rows, "g string, k long, v int"), ["g"], "k", F.col("v"), "most", 8).collect()
    for x in got:
        seen = [v for g, k, v in rows if g == x.g and k <= x.k and v is not None]
        assert x.most == max(seen, default=None)


def test_empty_logs(spark):
    none = spark.createDataFrame([], "called long, id long")
    assert d.keyed(d.admitted(none, "called", ["id"], 2, 2), 2, 2).collect() == []
    assert d.rotated(none, ["id"], F.lit(True), 3).collect() == []
    assert d.packed(none, "called", ["id"], 100).collect() == []


def test_packing(spark):
    r = random.Random(8)
    rows = [(k, r.choice([0, None, 1, 63, 64, 65, 200, 1023, 1024, 1025, r.randrange(1100)])) for k in range(3000)]
    got = d.packed(spark.createDataFrame(rows, "id long, n long").repartition(6), "n", ["id"], 1024).collect()
    assert len(got) == 3000
    batches, told = {}, dict(rows)
    for x in got:
        assert x.n == told[x.id]
        if x.n is None or x.n > 1024:
            assert (x.batch, x.status) == (None, "too_long")
        else:
            batches.setdefault(x.batch, []).append(x)
    assert sorted(batches) == list(range(len(batches)))
    whole = 0
    for number, members in batches.items():
        assert len({x.padded for x in members}) == 1 and all(x.n <= x.padded for x in members)
        assert len(members) == 1 or len(members) * members[0].padded <= 512
        whole += len(members) == max(1, 512 // members[0].padded)
    assert whole >= len(batches) - 16  # only each length's last one may have room
    assert sum(x.n for m in batches.values() for x in m) > 0.8 * sum(x.padded for m in batches.values() for x in m if x.n)


def test_backends(spark):
    names = ["ollama/gpt-oss", "gpt-oss", "meta/x", "deepseek-v3", "nvidia/x", "gpt-4o", "gemini-pro", "r1_distill", "", None]
    got = [r.b for r in spark.createDataFrame(list(enumerate(names)), "k int, m string").select("k", d.backend(F.col("m")).alias("b")).orderBy("k").collect()]
    assert got == ["ollama", "nvidia", "nvidia", "nvidia", "nvidia", "openai", "google", "local", "local", None]


def test_rounds_do_not_grow_with_a_full_log(spark, monkeypatch):
    """Calls that always wait: which key each takes goes back to the first ones, and is found without a round for each block."""
    calls, seen = [(k // 2, k) for k in range(1500)], []
    inner = d.speculated

    def counted(rows, *rest):
        seen.append(rows.count())
        return inner(rows, *rest)

    monkeypatch.setattr(d, "speculated", counted)
    assert held(spark, calls, 3, 4, 100, 50) == simulated(calls, 3, 4, 100)
    assert seen == [12]
