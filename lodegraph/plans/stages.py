"""The stages that ask a language model, each asking only for what has not been answered yet.

Answers are kept in a store under a hash of the stage, the model and the prompt. A stage first looks there; what is missing is asked in
slices, and each slice is committed when it is answered. So a run that was lost goes on where it stopped, a second run asks
nothing, and prompts that several questions share are asked once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parsing
from ..providers import CompletionProvider
from ..sources.appends import AppendLog
from ..storage import written

#: Prompts of a slice: what is lost at most when a run ends.
SLICE = 10_000
#: Documents of first answers that an expansion reads.
DOCUMENTS = 4

STORED = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "stage", "prompt", "response")])


@dataclass(frozen=True)
class Prompts:
    """Texts of the prompts; what stands in braces is filled in."""

    deconstruct: str = "State the facts that the question names, one a line.\nQuestion: {query}"
    entities: str = "List the entities of these facts and the answer as JSON.\nFacts: {facts}\nQuestion: {query}"
    relations: str = "Relate the entities as pairs with lists of relations.\nEntities: {entities}\nFacts: {facts}\nQuestion: {query}"
    validation: str = "Keep the relations that the entities allow, as triples.\nEntities: {entities}\nRelations: {relations}"
    expansion: str = "Write a passage that would answer the question.\nQuestion: {query}\nDocuments: {documents}"


def filled(template: str, **values: Column) -> Column:
    """The template with columns in its slots, all at once: a value that holds a slot's name is left as it is. A null value is empty."""
    parts: list[str | Column] = [template]
    for name, value in values.items():
        cut = []
        for part in parts:
            pieces = part.split(f"{{{name}}}") if isinstance(part, str) else [part]
            for k, piece in enumerate(pieces):
                cut += [F.coalesce(value, F.lit("")), piece] if k else [piece]
        parts = cut
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


class ResultStore:
    """Answers by stage, model and prompt, in an append log. Of two answers to one prompt the first committed counts."""

    def __init__(self, spark: SparkSession, path: str, model: str = "model", slice_: int = SLICE):
        self.log, self.model, self.slice = AppendLog(spark, path, STORED), model, slice_

    def key(self, stage: str, prompt: Column) -> Column:
        return F.sha2(F.concat_ws("\x1f", F.lit(stage), F.lit(self.model), prompt).cast("binary"), 256)

    def answers(self) -> DataFrame:
        """(key, response)"""
        return self.log.read().groupBy("key").agg(F.min_by("response", "commit").alias("response"))

    def ask(self, requests: DataFrame, stage: str, provider: CompletionProvider, attempt: int = 1) -> DataFrame:
        """``requests`` (query_id, prompt, ...) with ``response``, null where there is no prompt or the provider has none; that is asked again next time."""
        keyed = written(requests.withColumn("_key", self.key(stage, F.col("prompt"))), "requests")
        asked = keyed.where("prompt is not null").groupBy("_key").agg(F.min(F.struct("query_id", "prompt")).alias("r"))
        missing = written(asked.join(self.answers().withColumnRenamed("key", "_key"), "_key", "left_anti"), "missing")
        slices = -(-missing.count() // self.slice)
        for k in range(slices):
            of = missing.where(F.pmod(F.xxhash64("_key"), F.lit(slices)) == k) if slices > 1 else missing
            calls = of.select("r.query_id", F.lit(stage).alias("stage"), F.lit(attempt).alias("attempt"), "r.prompt", F.col("_key").alias("key"))
            told = provider.complete(calls).where("response is not null")
            self.log.append(told.select("key", "stage", "prompt", "response"), uuid.uuid4().hex)
        return keyed.join(self.answers().withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


@dataclass(frozen=True)
class Switches:
    """Stages that an ablation leaves out, and how often an unusable answer is asked for again."""

    deconstruction: bool = True
    self_correction: bool = True
    attempts: int = 3


@dataclass
class Stages:
    """From questions (query_id, query) to facts, entities and relations, and to expanded questions."""

    store: ResultStore
    provider: CompletionProvider
    prompts: Prompts = field(default_factory=Prompts)
    switches: Switches = field(default_factory=Switches)

    def _usable(self, requests: DataFrame, stage: str, usable) -> DataFrame:
        """``requests`` with the first usable ``response`` of some attempts, null without one: a further attempt is a prompt of its own."""
        left, done = requests, None
        for attempt in range(1, self.switches.attempts + 1):
            prompt = F.col("prompt") if attempt == 1 else F.concat("prompt", F.lit(f"\n(attempt {attempt})"))
            told = self.store.ask(left.withColumn("_first", F.col("prompt")).withColumn("prompt", prompt), stage, self.provider, attempt)
            told = written(told.withColumn("prompt", F.col("_first")).drop("_first").withColumn("_ok", F.coalesce(usable(F.col("response")), F.lit(False))), "told")
            good = told.where("_ok").drop("_ok")
            done = good if done is None else done.unionByName(good)
            left = told.where("not _ok").drop("_ok", "response")
            if left.isEmpty():
                break
        return done.unionByName(left.withColumn("response", F.lit(None).cast("string")))

    def facts(self, questions: DataFrame) -> DataFrame:
        """``questions`` with ``facts``: what the model makes of the question, the question itself where that stage is left out or gives nothing."""
        if not self.switches.deconstruction:
            return questions.withColumn("facts", F.col("query"))
        asked = questions.withColumn("prompt", filled(self.prompts.deconstruct, query=F.col("query")))
        told = self.store.ask(asked, "deconstruct", self.provider)
        return told.withColumn("facts", F.coalesce("response", "query")).drop("prompt", "response")

    def entities(self, questions: DataFrame) -> DataFrame:
        """``questions`` (with facts) with ``entities``: the readable answer as it was given, null where no attempt is readable."""
        asked = questions.withColumn("prompt", filled(self.prompts.entities, facts=F.col("facts"), query=F.col("query")))
        readable = lambda r: F.size(parsing.entities(r)) > 0
        return self._usable(asked, "entities", readable).withColumnRenamed("response", "entities").drop("prompt")

    def relations(self, questions: DataFrame) -> DataFrame:
        """``questions`` (with entities) with ``relations``: array of (a, b, relation) in order; none where there are no entities or no readable answer.

        With self-correction the model is asked which of them hold; of what it keeps, relations that the vocabulary has stay, lower-cased, each once.
        """
        has = F.col("entities").isNotNull()
        prompt = filled(self.prompts.relations, entities=F.col("entities"), facts=F.col("facts"), query=F.col("query"))
        asked = questions.withColumn("prompt", F.when(has, prompt))
        told = written(self.store.ask(asked, "relations", self.provider).withColumn("_r", parsing.relations(F.col("response"))), "relations")
        found = F.transform("_r", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["relation"].alias("relation")))
        named = told.withColumn("relations", F.coalesce(found, F.array().cast("array<struct<a: string, b: string, relation: string>>"))).drop("_r", "response", "prompt")
        if not self.switches.self_correction:
            return named
        listed = F.to_json("relations")
        prompt = filled(self.prompts.validation, entities=F.col("entities"), relations=listed)
        asked = named.withColumn("prompt", F.when(F.col("entities").isNotNull(), prompt))
        told = written(self.store.ask(asked, "validation", self.provider).withColumn("_t", parsing.triples(F.col("response"))), "validated")
        lowered = F.transform("_t", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), F.trim(F.lower(t["relation"])).alias("relation")))
        valid = F.array_distinct(F.filter(lowered, lambda t: t["relation"].isin(*parsing.RELATION_TYPES)))
        return told.withColumn("relations", F.when(F.col("prompt").isNotNull(), valid).otherwise(F.col("relations"))).drop("_t", "response", "prompt")

    def extract(self, questions: DataFrame) -> DataFrame:
        """(query_id, query, facts, entities, relations) of every question."""
        return self.relations(self.entities(self.facts(questions.select("query_id", "query"))))

    def expanded(self, questions: DataFrame, answers: DataFrame, documents: DataFrame) -> DataFrame:
        """``questions`` (query_id, query) with ``expanded``: a passage by the documents of the first answers; the question where there are no answers.

        ``answers`` (query_id, rank, node_id), ``documents`` (node_id, doc).
        """
        first = answers.where(F.col("rank") <= DOCUMENTS).join(documents, "node_id")
        read = first.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]), "\n").alias("_docs"))
        asked = questions.join(read, "query_id", "left")
        prompt = filled(self.prompts.expansion, query=F.col("query"), documents=F.col("_docs"))
        told = self.store.ask(asked.withColumn("prompt", F.when(F.col("_docs").isNotNull(), prompt)), "expansion", self.provider)
        return told.withColumn("expanded", F.coalesce("response", "query")).drop("prompt", "response", "_docs")


def as_responses(extracted: DataFrame) -> DataFrame:
    """(query_id, stage, attempt, response, symbol): what ``answering.answer`` reads. Relations stand as a map from pairs to lists."""
    pair = lambda t: F.concat(F.lit("('"), t["a"], F.lit("', '"), t["b"], F.lit("'): ['"), t["relation"], F.lit("']"))
    grouped = F.concat(F.lit("{"), F.array_join(F.transform("relations", pair), ", "), F.lit("}"))
    said = (("entities", F.col("entities")), ("relations", grouped))
    stages = F.array(*(F.struct(F.lit(stage).alias("stage"), response.alias("response")) for stage, response in said))
    each = extracted.select("query_id", F.explode(stages).alias("s"))
    return each.select("query_id", "s.stage", F.lit(1).alias("attempt"), "s.response", F.lit(None).cast("string").alias("symbol"))


class Derived:
    """Answers that are a column of the request (query_id, stage, attempt, prompt): for tests and queries. ``asked`` counts the calls."""

    def __init__(self, response: Column):
        self.response, self.asked = response, 0

    def complete(self, requests: DataFrame) -> DataFrame:
        self.asked += requests.count()
        return requests.withColumn("response", self.response)
