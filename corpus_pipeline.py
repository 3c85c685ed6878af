"""Documents made ready for training, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns
of ``documents``; its output is written and read again as the next one's input, so no stage's lineage reaches into another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import byte_bpe, decontaminate, jaccard, language, pii
from lodegraph.llm.common import apart, sieve, sifted, spare, table, written


def _around(docs: DataFrame, own: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` of the documents, with their columns as they were: those that bear a name of the step's ``own`` are put aside for it."""
    aside = {c: spare(docs, f"{c}_of_docs")[0] for c in docs.columns if c in own}
    return step(docs.withColumnsRenamed(aside)).select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have no language (null, or no letter) go; where ``lang`` is null, the language found is filled in.

    Repeated rows are told alike, ties go to the first language by name, no rows give none. All columns stay.
    """
    coder = language.fit(docs, allowed=language.learn_from())

    def step(docs: DataFrame) -> DataFrame:
        found = language.identify(docs, coder).where("lang_pred <> 'und'")
        return found.withColumn("lang", F.coalesce("lang", "lang_pred"))

    return _around(docs, ("lang_pred", "score", "ambiguous"), step)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least id stays, of its rows that repeat this id the first; a null id comes last.

    Texts are linked by SimHash and by their five-word shingles, of which they share 0.8 or more: all such pairs and no others. An id
    that stands on rows of several groups counts in each of them. Null and empty texts are one group. No rows give none; all columns stay.
    ``docs`` is a table, so its rows have the same numbers each time it is read; only the numbers of those that go meet the texts again.
    """
    (row,) = spare(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    found = jaccard.groups(numbered.select("doc_id", "text", F.col(row).alias("_row")))
    found = written(found.select("top", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("one")), "groups")
    first = written(found.groupBy("top").agg(F.min("one").alias("first")), "first")
    gone = written(found.join(apart(first), "top").where(F.col("one._row") != F.col("first._row")).select(F.col("one._row").alias(row)), "gone")
    places = sieve(gone, row)  # the rows that fall on none of these stay where they are
    stay = sifted(numbered, row, places, inside=False).unionByName(sifted(numbered, row, places).join(apart(gone), row, "left_anti"))
    return stay.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; repeated rows go or stay alike; no items take none. All columns stay.
    """
    own = ("n_words", "n_hit", "hit_spans", "hit_items", "_before")
    return _around(docs, own, lambda docs: decontaminate.mark(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to pseudonyms of the same format, and n_chars to the new length.

    Null and empty texts stay as they are, equal texts stay equal, no rows give none. All columns stay.
    """
    (spans,) = spare(docs, "spans")
    found = pii.pseudonymise(docs, pii.EXAMPLE_KEY, spans=spans)
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids (little-endian unsigned 32-bit integers), decoded again and compared.

    Null texts have no ids; repeated rows are encoded alike; no rows give none. Columns named ids, decoded, n_tokens or round_trip are
    replaced, all others stay.
    """
    import public_tokenizers

    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    whole = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return found.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long")).withColumn("round_trip", whole).drop("decoded")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE", tokens),
]

#: SQL can express neither the classifier nor the permutations; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
