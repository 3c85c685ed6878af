"""Quality rules with the frequency of lines across documents, in DataFrame functions alone.

A line's words, lower-cased, are hashed; for each host and hash the distinct documents that hold it
are counted. Lines held by more documents of the host than a limit are taken out, and a document that this leaves
with too small a share of its words is rejected. Repeats within a document are found by sorting its own hashes, so only
line hashes are shuffled, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare, table, written

#: Fewest words; most per cent of words in repeated windows; words of a window; documents of a host that may share a
#: line; least share of words that must be left.
LEAST_WORDS, REPEATED_PERCENT, WINDOW, LINE_LIMIT, LEAST_LEFT = 10, 20, 5, 10, 0.5

_SPACE, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column, window: int) -> Column:
    """Words that lie in a window found twice or more: windows sorted by their hash stand beside their equals."""

    def of(hashes: Column) -> Column:
        n = F.size(hashes) - window + 1
        windows = F.arrays_zip(*(F.slice(hashes, k + 1, n) for k in range(window)))
        in_order = F.sort_array(F.transform(windows, lambda w, i: F.struct(F.xxhash64(w).alias("h"), i.alias("i"))))
        return _bound(in_order, lambda rows: covered(rows, n))

    def covered(rows: Column, n: Column) -> Column:
        beside = F.zip_with(rows, F.slice(rows, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        places = F.sort_array(F.array_distinct(F.flatten(F.array_compact(beside))))
        first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        add = lambda acc, i: F.struct((acc["n"] + i + window - F.greatest(acc["end"], i)).alias("n"), (i + window).alias("end"))
        return F.aggregate(places, first, add)["n"]

    return F.when(F.size(words) > window, _bound(F.transform(words, lambda w: F.xxhash64(w)), of)).otherwise(F.lit(0))


def _line(line: Column) -> Column:
    """(h, words): a hash of the line's words in lower case, and how many there are."""
    return _bound(_words(F.lower(line)), lambda w: F.struct(F.xxhash64(w).alias("h"), F.size(w).alias("words")))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; null texts have no words."""
    body = F.coalesce(F.col(text), F.lit(""))
    (words,) = spare(docs, "words")
    n = docs.withColumn(words, _words(body))
    n = n.withColumn("n_repeat_words", _repeated_words(F.col(words), WINDOW).cast("long"))
    n = n.withColumn("word_chars", F.char_length(F.array_join(words, "")).cast("long"))
    n = n.withColumn("n_words", F.size(words).cast("long")).drop(words)
    n = n.withColumn("n_symbols", (F.char_length(body) - F.char_length(F.translate(body, "#*$%&|<>", ""))).cast("long"))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(_WORD))
    n = n.withColumn("n_dup_lines", _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return n.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")))


def _host(host: str) -> Column:
    return F.coalesce(F.col(host), F.lit("\x00"))


def frequent_lines(docs: DataFrame, text: str = "text", doc: str = "doc_id", host: str = "source", limit: int = LINE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Every document's lines (doc, row, at, line, words), and the lines in more than ``limit`` documents of a host.

    ``row`` is a hash of text and host, ``at`` the line's place in the text. ``line`` is a hash of host and normalised line, so that
    equal lines of other hosts stay apart; a null host is a host of its own. Documents are told apart by id; rows that
    repeat an id are one document.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x, i: F.struct(i.alias("at"), _line(x).alias("of"))), lambda x: x["of"]["words"] > 0)
    every = docs.select(F.col(doc).alias("doc"), F.xxhash64(text, _host(host)).alias("row"), F.xxhash64(_host(host)).alias("host"), F.explode(lines).alias("x"))
    every = written(every.select("doc", "row", "x.at", F.xxhash64("host", "x.of.h").alias("line"), F.col("x.of.words").alias("words")), "lines")
    return every, every.groupBy("line").agg(F.count_distinct("doc").alias("docs")).where(F.col("docs") > limit)


def judge(docs: DataFrame, text: str = "text", doc: str = "doc_id", host: str = "source", limit: int = LINE_LIMIT, least_left: float = LEAST_LEFT) -> DataFrame:
    """The documents' measures without their texts, with n_line_words_removed and kept.

    A document is kept if the base rules pass it and at least ``least_left`` of its words stand in lines of at most
    ``limit`` documents of its host. Null and empty texts fail the base. Every row is judged by its own text and host, also where
    ids are repeated. Rows with a null id are measured, but their lines count for no document and none is taken from them.
    Other columns stay; columns named as the new ones are replaced.
    """
    every, frequent = frequent_lines(docs, text, doc, host, limit)  # read twice, so written once
    mine, row, gone = spare(docs, "of_doc", "of_row", "removed")
    once = every.where("doc is not null").join(frequent.select("line"), "line").groupBy("doc", "row", "at").agg(F.first("words").alias("words"))  # a row that is repeated loses each line once
    removed = once.groupBy("doc", "row").agg(F.sum("words").alias(gone)).withColumnsRenamed({"doc": mine, "row": row})
    keyed = docs.withColumn(row, F.xxhash64(text, _host(host)))
    found = measure(keyed, text).drop(text, "n_line_words_removed", "kept")
    found = found.join(removed, (found[doc] == removed[mine]) & (found[row] == removed[row]), "left").drop(mine, row)
    found = found.withColumn("n_line_words_removed", F.coalesce(gone, F.lit(0)).cast("long")).drop(gone)
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_line_words_removed") >= least_left * F.col("n_words")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words_removed")
