"""What the engine asks of models outside: completions, vectors, reranked positions. By default all are recorded tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CompletionProvider(Protocol):
    def complete(self, requests: DataFrame) -> DataFrame:
        """``requests`` (query_id, stage, attempt, prompt) with ``response``, null where there is none."""


class EmbeddingProvider(Protocol):
    def embed(self, texts: DataFrame) -> DataFrame:
        """``texts`` (text) with ``embedding``, null where there is none."""


class Recorded:
    """Answers from a table (query_id, stage, attempt, response): a left join, so nothing outside is called."""

    def __init__(self, responses: DataFrame):
        self.responses = responses

    def complete(self, requests: DataFrame) -> DataFrame:
        return requests.join(self.responses.select("query_id", "stage", "attempt", "response"), ["query_id", "stage", "attempt"], "left")


class RecordedVectors:
    """Vectors from a table (text, embedding)."""

    def __init__(self, vectors: DataFrame):
        self.vectors = vectors

    def embed(self, texts: DataFrame) -> DataFrame:
        return texts.join(self.vectors.select("text", "embedding"), "text", "left")


class Called:
    """Answers of a function from a list of prompts to a list of responses, a batch at a time on the executors, each distinct prompt once."""

    def __init__(self, function: Callable[[list[str]], list[str | None]]):
        self.function = function

    def complete(self, requests: DataFrame) -> DataFrame:
        function = self.function

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(response=function(list(batch["prompt"])))

        asked = requests.select("prompt").where(F.col("prompt").isNotNull()).distinct().mapInPandas(ask, "prompt string, response string")
        return requests.join(asked, "prompt", "left")
