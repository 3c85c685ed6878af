"""Text and list functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_fence(text: Column) -> Column:
    """The text without Markdown fences around code, trimmed of white space."""
    bare = F.regexp_replace(text, r"```(?:json|python)?", "")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def first_sentence(doc: Column, width: int = 150) -> Column:
    """What stands before the first full stop of the first ``width`` characters, trimmed."""
    return F.trim(F.substring_index(F.substring(doc, 1, width), ".", 1))


def vocabulary_name(value: Column) -> Column:
    return F.lower(F.trim(value))


def split_names(text: Column) -> Column:
    """The distinct names of a comma list, trimmed and in lower case; empty ones left out; null gives none."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def first_int(text: Column) -> Column:
    """The first run of digits as a number, null without one."""
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("int")


def number(text: Column) -> Column:
    """The value as a number, null where it is none."""
    return text.try_cast("double")


def success(recall: Column) -> Column:
    return F.coalesce(recall > 0, F.lit(False)).cast("int")


def match_ratio(true: Column, predicted: Column) -> Column:
    """The share of true names that were predicted, 0 without true names."""
    n = F.size(F.array_distinct(true))
    return F.when(n > 0, F.size(F.array_intersect(true, predicted)) / n).otherwise(0.0)


def underscored(names: Column) -> Column:
    """Names with underscores for spaces, as the templates write them: the ``normalised`` mode of comparing."""
    return F.transform(names, lambda x: F.regexp_replace(x, r"\s+", "_"))


def failure_cause(recall: Column, entity: Column, relation: Column, low: float = 0.7) -> Column:
    """Why a question failed, or that it didn't; the first that fits."""
    return (
        F.when(recall == 1, "success").when(recall > 0, "partial_retrieval").when((entity <= low) & (relation <= low), "entity+relation_error")
        .when(entity < relation, "entity_error").when(relation < entity, "relation_error").otherwise("reasoning error")
    )


def category(types: Column, paths: Column, hops: Column) -> Column:
    """A name for a question's structure, ``unknown`` where it is not known."""
    return F.when(types.isNull() | paths.isNull() | hops.isNull(), F.lit("unknown")).otherwise(F.format_string("%dtypes_%dpaths_%dhops", types, paths, hops))


def type_of_file(stem: Column) -> Column:
    """A node type from a vector file's name: the last part goes, and two types get their slash back."""
    bare = F.regexp_replace(stem, r"_[^_]*$", "")
    return F.when(bare == "geneprotein", "gene/protein").when(bare == "effectphenotype", "effect/phenotype").otherwise(bare)


def final_answer(text: Column) -> Column:
    """A reasoning model's answer: what follows its thoughts; of that what is boxed; of that what follows the mark of the answer; and the bold part if there is just one."""
    said = F.substring_index(text, "</think>", -1)
    boxed = F.substring_index(F.regexp_extract(said, r"^([\s\S]*)\}", 1), "boxed{", -1)
    said = F.when(F.contains(said, F.lit("boxed{")) & F.contains(said, F.lit("}")), boxed).otherwise(said)
    said = F.replace(F.replace(F.substring_index(said, "Answer:**", -1), F.lit("\\_"), F.lit("_")), F.lit("\\'"), F.lit("'"))
    parts = F.split(said, r"\*\*")
    return F.regexp_replace(F.when(F.size(parts) == 3, F.get(parts, F.lit(1))).otherwise(said), r"^\s+|\s+$", "")


def chat_roles(chat: Column, model: str = "gemini") -> Column:
    """A chat (array of role, content) in another model's roles: the assistant is the model; where there is no system role it speaks as the user."""
    if model == "gemini":
        return F.transform(chat, lambda m: F.struct(F.when(m["role"] == "assistant", "model").otherwise(m["role"]).alias("role"), m["content"].alias("content")))
    return F.transform(chat, lambda m: F.struct(F.when(m["role"] == "system", "user").otherwise(m["role"]).alias("role"), m["content"].alias("content")))


def rate_limited(error: Column) -> Column:
    """Whether an error's text says that calls came too fast."""
    return F.coalesce(F.lower(error).contains("429") | F.lower(error).contains("rate limit"), F.lit(False))


def entity_text(name: Column, semantic: Column) -> Column:
    """A symbol's text for scoring: its name and what is said of it, spaces between; nulls left out."""
    return F.array_join(F.filter(F.concat(F.array(name), F.coalesce(semantic, F.array().cast("array<string>"))), lambda x: x.isNotNull()), " ")


def search_text(semantic: Column, lexical: Column) -> Column:
    """A symbol's text for retrieval: what is said of it with nothing between, then each name behind a space."""
    return F.concat(F.array_join(F.coalesce(semantic, F.array().cast("array<string>")), ""), F.array_join(F.transform(F.coalesce(lexical, F.array().cast("array<string>")), lambda x: F.concat(F.lit(" "), x)), ""))
