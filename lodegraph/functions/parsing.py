"""Parsers of model outputs: JSON in the JVM; Python literals, which are no JSON, by Arrow batches."""

from __future__ import annotations

import ast
import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import vocabulary_name, without_fence

#: Node and relation types of the biomedical graph. Fixed values.
NODE_TYPES = ("disease", "gene/protein", "molecular_function", "drug", "pathway", "anatomy", "effect/phenotype", "biological_process", "cellular_component", "exposure")
RELATION_TYPES = (
    "ppi", "carrier", "enzyme", "target", "transporter", "contraindication", "indication", "off-label use", "synergistic interaction", "associated with",
    "parent-child", "phenotype absent", "phenotype present", "side effect", "interacts with", "linked to", "expression present", "expression absent",
)
#: Other spellings of node types. Fixed values.
TYPE_SPELLINGS = {"gene": "gene/protein", "protein": "gene/protein", "effect": "effect/phenotype", "phenotype": "effect/phenotype"}
#: Similarity of two texts from which the one says nothing new.
SAME_TEXT = 0.85

_ENTITY = "map<string,struct<name:string,type:string,information:string,constant:boolean>>"
_OLD_ENTITY = "map<string,struct<type:array<string>,lexical:map<string,string>,semantic:array<string>,constant:boolean>>"


def entities(text: Column) -> Column:
    """Symbol -> (name, type, information, constant) of a model's JSON, fenced or not; symbols without a type left out; null where unreadable."""
    return F.map_filter(F.from_json(without_fence(text), _ENTITY), lambda _, e: e["type"].isNotNull())


def entities_strict(text: Column) -> tuple[Column, Column]:
    """(map, error) of the earlier format: every symbol needs type, lexical, semantic and constant; error says what is wrong, else null."""
    parsed = F.from_json(without_fence(text), _OLD_ENTITY)
    lacking = F.exists(F.map_values(parsed), lambda e: e["type"].isNull() | e["lexical"].isNull() | e["semantic"].isNull() | e["constant"].isNull())
    error = F.when(F.coalesce(without_fence(text), F.lit("")) == "", "empty").when(parsed.isNull(), "not an object").when(lacking, "a field is missing")
    return parsed, error


def old_format(entities_: Column) -> Column:
    """The earlier format of the map that ``entities`` gives: types and information as lists, the name as a lexical value; nulls left out."""
    listed = lambda x: F.filter(F.array(x), lambda v: v.isNotNull())
    return F.transform_values(
        entities_,
        lambda _, e: F.struct(listed(e["type"]).alias("type"), F.map_filter(F.create_map(F.lit("name"), e["name"]), lambda _, v: v.isNotNull()).alias("lexical"), listed(e["information"]).alias("semantic"), F.coalesce(e["constant"], F.lit(False)).alias("constant")),
    )


def in_vocabulary(relation: Column) -> Column:
    return vocabulary_name(relation).isin(*RELATION_TYPES)


def node_type(value: Column) -> Column:
    """A type in its usual spelling, null where it is none; upper case and blanks make it none."""
    spelled = F.coalesce(*(F.when(value == a, b) for a, b in TYPE_SPELLINGS.items()), value)
    return F.when(spelled.isin(*NODE_TYPES), spelled)


def without_marks(text: str) -> str:
    """A text without code fence marks and the blanks around it."""
    return re.sub(r"```(?:json|python)?", "", text).strip()


def literal(text: str | None):
    """The Python value that a text denotes; null, None, true and false are understood in either language; no value: None."""
    if not text or not text.strip():
        return None
    bare = without_marks(text)
    for read in (json.loads, ast.literal_eval, lambda t: ast.literal_eval(re.sub(r"\b(true|false|null)\b", lambda m: {"true": "True", "false": "False", "null": "None"}[m[0]], t))):
        try:
            return read(bare)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
    return None


def triples_of(text: str | None) -> list[dict]:
    """The 3-tuples of a list as (a, b, relation); lists in their place and other values are left out."""
    try:
        found = ast.literal_eval(without_marks(text or ""))
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return []
    if not isinstance(found, (list, tuple, set)):
        return []
    return [dict(zip(("a", "b", "relation"), map(str, t), strict=True)) for t in found if isinstance(t, tuple) and len(t) == 3]


#: What the text of a pair is made of: a quoted name, a comma, or a run of anything else.
_PIECE = re.compile(r"""(?P<name>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<comma>,)|(?P<rest>[^,"']+|["'])""")


def symbols_of(key) -> list[str]:
    """The symbols that a map's key names: two for a pair, which may be written as text in round brackets; else the key alone.

    In brackets, names may be quoted, with anything between them, or stand bare on either side of the first comma.
    """
    if isinstance(key, tuple) and len(key) == 2:
        return [str(x) for x in key]
    text = str(key).strip()
    if text[:1] + text[-1:] != "()":
        return [str(key)]
    names, sides = [], [""]
    for piece in _PIECE.finditer(text, 1, len(text) - 1):
        if piece["name"]:
            names.append(re.sub(r"\\(.)", r"\1", piece["name"][1:-1]))
        if piece["comma"] and len(sides) == 1:
            sides.append("")
        else:
            sides[-1] += piece[0]
    if len(names) == 2:
        return names
    return [side.strip(" \t\r\n\"'") for side in sides] if len(sides) == 2 else [str(key)]


def relations_of(text: str | None) -> list[dict] | None:
    """(a, b, relation, ord) of a map from pairs to lists of relations; b is null where a key is no pair.

    Blank text and an empty map give none; text that denotes no map, and a map that has anything but lists, give null.
    """
    found = literal(text) if text and without_marks(text) else {}
    if not isinstance(found, dict) or not all(isinstance(v, (list, tuple)) for v in found.values()):
        return None
    named = [(*symbols_of(key), None)[:2] + (str(r),) for key, of_pair in found.items() for r in of_pair]
    return [{"a": a, "b": b, "relation": r, "ord": k} for k, (a, b, r) in enumerate(named)]


_NAMED = [T.StructField(c, T.StringType()) for c in ("a", "b", "relation")]
_TRIPLES = T.ArrayType(T.StructType(_NAMED))
_RELATIONS = T.ArrayType(T.StructType([*_NAMED, T.StructField("ord", T.IntegerType())]))


@F.pandas_udf(_TRIPLES)
def triples(texts: pd.Series) -> pd.Series:
    return texts.map(triples_of)


@F.pandas_udf(_RELATIONS)
def relations(texts: pd.Series) -> pd.Series:
    return texts.map(relations_of)


@F.pandas_udf(T.StringType())
def as_json(texts: pd.Series) -> pd.Series:
    """Any literal as JSON text; null for null, ``{}`` for what denotes no value."""
    return texts.map(lambda t: None if t is None else json.dumps(v, default=str) if isinstance(v := literal(t), (dict, list)) else "{}")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the length of the blocks that two texts share, over both lengths; null counts as empty."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def edge_types(edges: Column, types: Column) -> Column:
    """A path's text with its symbols replaced by their types."""
    name = lambda s: F.coalesce(F.try_element_at(types, s), s)
    return F.concat(name(edges[0]["a"]), F.array_join(F.transform(edges, lambda e: F.concat(F.lit(" -["), e["relation"], F.lit("]-> "), name(e["b"]))), ""))
