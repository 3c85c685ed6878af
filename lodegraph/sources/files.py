"""Files that runs leave: metrics and dumps in CSV, requests and results in JSON lines, templates, schema triplets, replays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a run's metrics; a share at each alpha may follow.
METRICS = "query_id long, query_text string, total_answers int, retrieved_count int, missed_count int, `recall@50` double, `recall@20` double, `hit@1` double, `hit@5` double, mrr double"
#: Longest answer list that a reranker reads.
MOST_ANSWERS = 20

_RESULT = "custom_id string, error string, response struct<status_code: int, body: struct<data: array<struct<embedding: array<float>>>>>"


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """CSV files with quoted line breaks, files that can't be read left out, with ``seq``: the order of files by name, then of rows.

    ``schema`` null: all columns are strings named by the header. Rows that don't fit the schema have nulls.
    A file is read by one task, for its rows' order counts; many files are read in parallel.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", False)
    rows = reader.csv(paths if isinstance(paths, str) else list(paths))
    return rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.monotonically_increasing_id()).withColumn("seq", F.struct("_file", "_row")).drop("_file", "_row")


def write_csv(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Rows with a header; nested values as JSON, empty ones as nothing. Spark's commit takes the place of locks: a failed task leaves nothing."""
    flat = [_flat(f) for f in rows.schema.fields]
    rows.select(*flat).write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def _flat(field: T.StructField) -> Column:
    """A nested column as JSON text; empty lists and maps, and nulls, are empty text."""
    if isinstance(field.dataType, (T.ArrayType, T.MapType)):
        if isinstance(field.dataType, T.MapType) and not isinstance(field.dataType.keyType, T.StringType):
            return F.when(F.size(field.name) > 0, F.to_json(F.map_entries(field.name))).otherwise("").alias(field.name)
        return F.when(F.size(field.name) > 0, F.to_json(field.name)).otherwise("").alias(field.name)
    if isinstance(field.dataType, T.StructType):
        return F.to_json(field.name).alias(field.name)
    return F.col(field.name)


def metric_rows(rows: DataFrame, alphas: Sequence[int] = range(12, 21)) -> DataFrame:
    """``rows`` with the columns of a run's metrics and a recall for each alpha, in their order; what is missing or null counts as 0."""
    kinds = [(f.name, f.dataType) for f in T._parse_datatype_string(METRICS).fields] + [(f"recall@20_alpha_{a}", T.DoubleType()) for a in alphas]
    zero = lambda c, kind: F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind)
    return rows.select(*((F.coalesce(F.col(f"`{c}`").cast(kind), zero(c, kind)) if c in rows.columns else zero(c, kind)).alias(c) for c, kind in kinds))


def append_metrics(rows: DataFrame, path: str) -> None:
    """Metric rows behind those that are there; every file has its header."""
    write_csv(metric_rows(rows), path)


def serialized(rows: DataFrame) -> DataFrame:
    """The earlier dump's cells: nulls are empty text, nested values JSON (empty ones, too), all others as they are, as text."""
    nested_kinds = (T.ArrayType, T.MapType, T.StructType)
    return rows.select(*(F.coalesce(F.to_json(f.name) if isinstance(f.dataType, nested_kinds) else F.col(f.name).cast("string"), F.lit("")).alias(f.name) for f in rows.schema.fields))


def rerank_summary(judged: DataFrame, method: int, dataset: str) -> DataFrame:
    """One row of a reranking's judgements (hit_1, hit_5, mrr, recall_20 of each question)."""
    means = (F.avg(c).alias(n) for c, n in (("hit_1", "Hit@1"), ("hit_5", "Hit@5"), ("mrr", "MRR"), ("recall_20", "Recall@20")))
    return judged.agg(F.count("*").alias("Num_queries"), *means).select(F.lit(method).alias("Method"), F.lit(dataset).alias("Dataset"), "Hit@1", "Hit@5", "MRR", "Recall@20", "Num_queries")


def write_rerank(reranked: DataFrame, judged: DataFrame, base: str, method: int, dataset: str) -> None:
    """A reranking's three outputs: ``base``.csv with the lists, ``base``_details.csv with each question's metrics, ``base``_summary.csv."""
    for rows, name in ((reranked, ""), (judged, "_details"), (rerank_summary(judged, method, dataset).coalesce(1), "_summary")):
        write_csv(rows, f"{base}{name}.csv", "overwrite")


def nested(text: Column, kind: str) -> Column:
    """A dump's nested cell, read back; null where it is empty or can't be read."""
    return F.from_json(F.when(text != "", text), kind)


def answers_of(text: Column) -> Column:
    """A dumped answer list, cut to what a reranker reads."""
    return F.slice(F.coalesce(nested(text, "array<bigint>"), F.array().cast("array<bigint>")), 1, MOST_ANSWERS)


def request_lines(queries: DataFrame, model: str = "embedding-model", keep: Sequence[str] = ()) -> DataFrame:
    """(value): a JSON line for each question, asking for its vector; ready for a text sink. Columns of ``keep`` stay. Names are the service's: fixed values."""
    body = F.struct(F.col("query").alias("input"), F.lit(model).alias("model"), F.lit("float").alias("encoding_format"))
    id_ = F.concat(F.lit("qid-"), F.col("query_id")).alias("custom_id")
    line = F.struct(id_, F.lit("POST").alias("method"), F.lit("/v1/embeddings").alias("url"), body.alias("body"))
    return queries.select(F.to_json(line).alias("value"), *keep)


def results(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(vectors, failures) of result lines: query_id with embedding, and query_id with why; a line that is no JSON fails without an id."""
    r = lines.select(F.from_json(column, _RESULT).alias("r"))
    ok = F.col("r.error").isNull() & (F.col("r.response.status_code") == 200)
    id_ = F.regexp_replace("r.custom_id", "^qid-", "").try_cast("long").alias("query_id")
    good = r.where(ok).select(id_, F.get(F.col("r.response.body.data"), F.lit(0))["embedding"].alias("embedding"))
    bad = r.where(~F.coalesce(ok, F.lit(False))).select(id_, F.coalesce("r.error", F.concat(F.lit("status "), F.col("r.response.status_code")), F.lit("not readable")).alias("error"))
    return good, bad


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """The question templates; a byte order mark before the header is no part of it."""
    return spark.read.option("header", True).schema("Id int, Template string, No_of_hops int, No_of_entities int, Entities string, No_of_relations int, relations string").csv(path)


def triplet(line: Column) -> tuple[Column, Column, Column]:
    """(source type, relation, target type) of a schema line ``a --- r ---> b``, a comma at its end or not."""
    pattern = r"^\s*(.*?)\s*---\s*(.*?)\s*--->\s*(.*?)\s*,?\s*$"
    return tuple(F.regexp_extract(line, pattern, k) for k in (1, 2, 3))


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    a, r, b = triplet(F.col("value"))
    return spark.read.text(path).select(a.alias("src_type"), r.alias("relation"), b.alias("dst_type")).where("relation <> ''").distinct()


def saved_candidates(line: Column) -> Column:
    """A replay of candidates: {question id as text: [node id, ...]}."""
    return F.from_json(line, "map<string, array<bigint>>")
