"""Calls of remote models dealt to keys and batches; an event is a call at its time, in the order of event ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dispatch
from ..sources.tables import table
from . import query

#: Keys of the rate limit and calls that each takes in 62 seconds; keys that are rotated.
KEYS, LIMIT, ROTATED = 3, 10, 4
#: Longest input of the local model, in tokens.
LONGEST = 2048


def _scheduled(spark, d):
    calls = table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("called"))
    return dispatch.admitted(calls, "called", ["event_id"], KEYS, LIMIT)


@query(f"""WITH e AS (SELECT event_id, epoch_us(ts) AS called, row_number() OVER (ORDER BY epoch_us(ts), event_id) - 1 AS position FROM events)
SELECT event_id, called, position, ((position // {KEYS * LIMIT}) * 62000000 + max(called - (position // {KEYS * LIMIT}) * 62000000) OVER (PARTITION BY position % {KEYS * LIMIT} ORDER BY position))::BIGINT AS start FROM e""")
def rr_rate_schedule(spark, d):
    """When each call may start."""
    return _scheduled(spark, d)


@query()
def rr_rate_keys(spark, d):
    """With which key each call starts. SQL would have to walk the calls one by one; a test holds it against a simulator."""
    return dispatch.keyed(_scheduled(spark, d), KEYS, LIMIT).select("event_id", "start", "key")


@query(f"""WITH e AS (SELECT event_id, event_type = 'error' AS r, count(*) FILTER (coalesce(event_type, '') <> 'error') OVER (ORDER BY event_id) AS run FROM events),
p AS (SELECT *, CASE WHEN r THEN row_number() OVER (PARTITION BY run, r ORDER BY event_id) - 1 ELSE 0 END AS p FROM e),
a AS (SELECT event_id, r, CASE WHEN r THEN p % {ROTATED} ELSE coalesce((SELECT max(x.p) + 1 FROM p x WHERE x.r AND x.run = p.run - 1), 0) % {ROTATED} END AS attempt FROM p)
SELECT event_id, (coalesce(sum(CASE WHEN r AND attempt < {ROTATED - 1} THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % {ROTATED})::INT AS key, attempt::INT AS attempt,
  CASE WHEN NOT coalesce(r, FALSE) THEN 'ended' WHEN attempt < {ROTATED - 1} THEN 'retried' ELSE 'given_up' END AS outcome FROM a""")
def llm_key_rotation(spark, d):
    """Which key each attempt took, errors being refusals."""
    attempts = table(spark, d, "events").select("event_id", "event_type")
    return dispatch.rotated(attempts, ["event_id"], F.col("event_type") == "error", ROTATED).drop("event_type")


@query(f"""WITH t AS (SELECT doc_id, ceil(n_chars / 4)::BIGINT AS tokens FROM documents),
s AS (SELECT *, CASE WHEN tokens <= {LONGEST} THEN least(greatest(ceil(tokens / 64), 1) * 64, {LONGEST})::BIGINT END AS padded FROM t),
r AS (SELECT *, greatest({LONGEST} // 2 // padded, 1) AS room, row_number() OVER (PARTITION BY padded ORDER BY doc_id) - 1 AS pos FROM s),
n AS (SELECT padded, ceil(count(*) / max(room))::BIGINT AS n FROM r WHERE padded IS NOT NULL GROUP BY 1),
f AS (SELECT padded, coalesce(sum(n) OVER (ORDER BY padded ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM n)
SELECT doc_id, tokens, padded, (first + pos // room)::BIGINT AS batch, CASE WHEN padded IS NULL THEN 'too_long' ELSE 'packed' END AS status FROM r LEFT JOIN f USING (padded)""")
def llm_batches(spark, d):
    """Every document as a prompt of a local model, of a token for four characters."""
    prompts = table(spark, d, "documents").select("doc_id", F.ceil(F.col("n_chars") / 4).cast("long").alias("tokens"))
    return dispatch.packed(prompts, "tokens", ["doc_id"], LONGEST)


_MODELS = ("ollama/x", "gpt-oss-20b", "meta-llama-3", "deepseek-r1", "nvidia/nemotron", "gpt-4o", "gemini-2", "r1_distill_14b")


@query(f"""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'ollama' WHEN 5 THEN 'openai' WHEN 6 THEN 'google' WHEN 7 THEN 'local' ELSE 'nvidia' END AS backend FROM part""")
def llm_backend(spark, d):
    """What serves the model that a part's key picks."""
    model = F.get(F.array(*map(F.lit, _MODELS)), (F.col("p_partkey") % len(_MODELS)).cast("int"))
    return table(spark, d, "part").select("p_partkey", dispatch.backend(model).alias("backend"))
