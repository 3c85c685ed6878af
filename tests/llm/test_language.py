import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import language as g

from .conftest import clash


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 12, 40])
def test_codewords_lie_apart(n):
    code = g.codewords(n)
    assert len({tuple(r) for r in code}) == n and set(np.unique(code)) <= {-1, 1}
    if n > 2:
        assert all(abs(c.sum()) < n for c in code.T)
        apart = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        assert apart >= (2 ** (n - 2) if n <= 7 else 4)  # so single wrong bits are put right


def test_a_wrong_bit_is_put_right():
    rows = [("en", "the house and the garden of the king"), ("de", "das haus und der garten des königs"), ("fr", "la maison et le jardin du roi"), ("es", "la casa y el jardín del rey")] * 5
    coder = g.Coder(rows)
    for k in range(coder.code.shape[1]):
        broken = g.Coder(rows)
        broken.weights[:, k] *= -1
        assert all(broken.decide(t)[0] == lang for lang, t in rows[:4])


def test_edge_cases(docs, none):
    coder = g.fit(docs)
    out = g.identify(clash(docs, "lang_pred", "score", "ambiguous"), coder)
    assert out.columns == ["doc_id", "text", "lang", "source", "extra", "lang_pred", "score", "ambiguous"]
    got = {r.doc_id: r for r in out.collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (2, 3, 7, 8))
    assert got[5].lang_pred == "de" and got[1].lang_pred == "en" and got[None].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert g.identify(none, coder).count() == 0
    blank = g.fit(none)
    assert {r.lang_pred for r in g.identify(docs, blank).collect()} == {"und"}


def test_labels_of_held_out_documents_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(g.learn_from(), F.col("lang")).otherwise("xx"))
    a, b = g.fit(docs, allowed=g.learn_from()), g.fit(other, allowed=g.learn_from())
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = g.op8_language(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null")
    assert got.where("lang = lang_pred").count() >= 0.99 * got.count()


def brute_margins(weights, scale, text):
    """The mean weight of the text's n-grams, n-gram by n-gram."""
    points = [ord(c) for c in " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "]
    total, n = [0.0] * len(scale), 0
    for size in (1, 2, 3):
        for i in range(len(points) - size + 1):
            x = 0
            for j, odd in enumerate((0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)[:size]):
                x = ((x ^ (points[i + j] * odd % 2**32)) * 0x27D4EB2F + size) % 2**32
            total = [a + float(w) for a, w in zip(total, weights[x >> 16])]
            n += 1
    return [a / n * float(s) for a, s in zip(total, scale)]


def test_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    coder = g.fit(docs, allowed=g.learn_from())
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in g.op8_language(spark, sf).collect()}
    assert got.keys() == text.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        if not text[i] or not re.search(r"[^\W\d_]", text[i]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        if len(text[i]) > 4000:
            continue
        margins = brute_margins(coder.weights, coder.scale, text[i])
        loss = [sum(float(t) * math.log1p(math.exp(-4 * int(c) * max(-8, min(8, m)))) for c, m, t in zip(word, margins, coder.trust)) for word in coder.code]
        best = min(range(len(loss)), key=loss.__getitem__)
        assert r.lang_pred == coder.languages[best] and abs(r.score - 1 / sum(math.exp(-2 * (x - loss[best])) for x in loss)) < 1e-4


def test_loss_weights_come_from_texts_that_were_not_fitted():
    """One part of the languages can't be told by letters: its bits get less weight, though in-sample they are always right."""
    draw = random.Random(1)
    word = lambda letters: "".join(draw.choices(letters, k=6))
    rows = [(lang, " ".join(word(letters) for _ in range(8))) for lang, letters in (("a", "abcd"), ("b", "abcd"), ("c", "wxyz")) for _ in range(60)]
    coder = g.Coder(rows)
    parts = [k for k in range(coder.code.shape[1]) if coder.code[0][k] != coder.code[1][k]]
    whole = [k for k in range(coder.code.shape[1]) if coder.code[0][k] == coder.code[1][k]]
    assert max(coder.trust[parts]) < min(coder.trust[whole]) / 3 and min(coder.wrong[parts]) > 0.2
    assert abs(coder.trust.sum() - 1) < 1e-5


def test_the_sample_is_bounded_by_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from lodegraph.llm.common import bounded

    kept = bounded(docs.where("lang is not null and text is not null").select("lang", "text", "doc_id"), "lang", "text", 20_000)
    assert kept.columns == ["lang", "text", "doc_id"] and 0 < kept.agg(F.sum(F.octet_length("text"))).first()[0] <= 20_000
