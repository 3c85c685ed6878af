"""Vectors of many questions asked for in batches, by a service that answers later.

The job is a state machine over two append logs: what has happened to each part of the requests, and what came back. Each step reads
where the job stands, does what is next and records it; a job that is killed anywhere goes on from its logs. A step that was
done but not recorded is done again: parts have names that the service knows them by, and collected parts are batches
that are committed once. So each request counts once, however results are ordered or repeated.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..operators.numbering import positions
from ..sources import files
from ..sources.appends import AppendLog

#: Requests of a part: what the service takes in one file.
PART = 50_000
#: States of a part, in their order, and of a service's batch that has ended.
PLANNED, SUBMITTED, DONE, FAILED, COLLECTED = "planned", "submitted", "done", "failed", "collected"
ENDED = {"completed": DONE, "failed": FAILED, "expired": FAILED, "cancelled": FAILED}


class BatchService(Protocol):
    def submit(self, requests: str, token: str) -> str:
        """An id for the request lines in the folder ``requests``; the same for the same ``token``."""

    def status(self, id_: str) -> tuple[str, str | None]:
        """(status, folder of the result lines): one of ``ENDED``, or anything else while it runs."""


@dataclass
class BatchJob:
    """A job that lives in ``folder``; make it anew to resume it."""

    spark: SparkSession
    folder: str
    service: BatchService
    model: str = "embedding-model"
    part: int = PART

    def __post_init__(self):
        text, number = T.StringType(), T.LongType()
        fields = [("part", number), ("state", text), ("detail", text)]
        self.parts = AppendLog(self.spark, f"{self.folder}/parts", T.StructType([T.StructField(n, t) for n, t in fields]))
        fields = [("query_id", number), ("embedding", T.ArrayType(T.FloatType())), ("error", text)]
        self.found = AppendLog(self.spark, f"{self.folder}/found", T.StructType([T.StructField(n, t) for n, t in fields]))

    def standing(self) -> dict[int, tuple[str, str | None]]:
        """(state, detail) of each part: the last that was recorded. A row for each part, so for ``PART`` requests."""
        last = self.parts.read().groupBy("part").agg(F.max_by(F.struct("state", "detail"), "commit").alias("s"))
        return {r["part"]: (r["s"]["state"], r["s"]["detail"]) for r in last.collect()}

    def _record(self, part: int, state: str, detail: str | None) -> None:
        rows = self.spark.createDataFrame([(part, state, detail)], self.parts.schema)
        self.parts.append(rows, f"{part}-{state}")

    def plan(self, queries: DataFrame) -> None:
        """Request lines for ``queries`` (query_id, query), each id once, in parts; once for a job."""
        if "plan" in self.parts.state().batches:
            return
        lines = f"{self.folder}/requests"
        distinct = queries.where("query_id is not null").groupBy("query_id").agg(F.min("query").alias("query"))
        numbered = positions(distinct, [], ["query_id"]).withColumn("part", F.floor(F.col("position") / self.part))
        ready = files.request_lines(numbered, self.model, keep=("part", "query_id"))
        ready.repartition("part").write.mode("overwrite").partitionBy("part").parquet(lines)
        parts = self.requests().select(F.col("part").cast("long").alias("part")).distinct()
        self.parts.append(parts.withColumn("state", F.lit(PLANNED)).withColumn("detail", F.lit(None).cast("string")), "plan")

    def requests(self) -> DataFrame:
        """(value, query_id, part) of the planned request lines."""
        return self.spark.read.schema("value string, query_id long, part long").parquet(f"{self.folder}/requests")

    def step(self) -> bool:
        """Does for each part what is next; True while there is something left."""
        standing = self.standing()
        for part, (state, detail) in sorted(standing.items()):
            if state == PLANNED:
                self._record(part, SUBMITTED, self.service.submit(f"{self.folder}/requests/part={part}", f"{self.folder}#{part}"))
            elif state == SUBMITTED:
                status, out = self.service.status(detail)
                if status in ENDED:
                    self._record(part, ENDED[status], out if ENDED[status] == DONE else status)
            elif state == DONE:
                self._collect(part, detail)
                self._record(part, COLLECTED, None)
        return any(state not in (FAILED, COLLECTED) for state, _ in self.standing().values())

    def _collect(self, part: int, out: str) -> None:
        good, bad = files.results(self.spark.read.text(out))
        none = lambda kind: F.lit(None).cast(kind)
        rows = good.withColumn("error", none("string")).unionByName(bad.withColumn("embedding", none("array<float>")))
        self.found.append(rows, str(part))

    def outcome(self) -> DataFrame:
        """(query_id, state, embedding, error) for each request once: done, failed, or pending.

        Of several results of a request one with a vector counts, of these the first committed; results of what was not asked for count not at
        all, lines without an id neither.
        """
        rank = F.struct(F.col("embedding").isNull().alias("n"), "commit", F.coalesce("error", F.lit("")).alias("e"))
        best = self.found.read().groupBy("query_id").agg(F.min_by(F.struct("embedding", "error"), rank).alias("r"))
        ended = self.spark.createDataFrame([(p, d) for p, (s, d) in self.standing().items() if s == FAILED], "part long, why string")
        collected = self.spark.createDataFrame([(p,) for p, (s, _) in self.standing().items() if s == COLLECTED], "part long").withColumn("in", F.lit(True))
        asked = self.requests().select("query_id", "part").join(F.broadcast(ended), "part", "left").join(F.broadcast(collected), "part", "left")  # a row for each part
        rows = asked.join(best, "query_id", "left")
        missing = F.when(F.col("why").isNotNull(), F.concat(F.lit("batch "), F.col("why"))).when(F.col("in"), F.lit("no result"))
        error = F.when(F.col("r.embedding").isNull(), F.coalesce("r.error", missing))
        state = F.when(F.col("r.embedding").isNotNull(), DONE).when(error.isNotNull(), FAILED).otherwise("pending")
        return rows.select("query_id", state.alias("state"), F.col("r.embedding").alias("embedding"), error.alias("error"))

    def run(self, queries: DataFrame, rounds: int = 1000) -> DataFrame:
        """Plans if need be, then steps until every part has ended; polls the service at most ``rounds`` times."""
        self.plan(queries)
        for _ in range(rounds):
            if not self.step():
                return self.outcome()
        raise TimeoutError(f"parts have not ended: {self.folder}")


class RecordedService:
    """Answers from ``lines``: a function from request lines (value, query_id) to result lines (value). A batch is done when it is asked for the second time."""

    def __init__(self, spark: SparkSession, folder: str, lines, ends=lambda part: "completed"):
        self.spark, self.folder, self.lines, self.ends = spark, folder, lines, ends
        self.asked: dict[str, int] = {}

    def submit(self, requests: str, token: str) -> str:
        return requests

    def status(self, id_: str) -> tuple[str, str | None]:
        self.asked[id_] = self.asked.get(id_, 0) + 1
        if self.asked[id_] < 2:
            return "in_progress", None
        part = int(id_.rpartition("=")[2])
        end, out = self.ends(part), f"{self.folder}/part-{part}"
        if end == "completed" and not storage.exists(self.spark, f"{out}/_SUCCESS"):
            requests = self.spark.read.schema("value string, query_id long").parquet(id_)
            self.lines(requests).select("value").write.mode("overwrite").text(out)
        return end, out if end == "completed" else None
