import math
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodegraph.llm import toxicity as t

from .conftest import clash


def brute_segments(scores):
    """All maximal segments by the recursive definition: the best segment, then those left and right of it."""
    out = []

    def within(a, z):
        best = None
        for i in range(a, z):
            total = 0
            for j in range(i, z):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[2] + 1e-12):
                    best = i, j + 1, total
        if best:
            out.append((best[0], best[1], round(best[2], 6)))
            within(a, best[0])
            within(best[1], z)

    within(0, len(scores))
    return sorted(out)


def test_segments():
    r = random.Random(2)
    for _ in range(1500):
        seq = [r.choice([-0.5, -0.5, -0.5, 1.37, 2.2, 0.81]) for _ in range(r.randrange(1, 25))]
        got = t.maximal_segments([(i, x) for i, x in enumerate(seq) if x > 0], 0.5)
        assert sorted((a, b, round(s, 6)) for a, b, s in got) == brute_segments(seq)


def test_segments_are_found_in_linear_time():
    r = random.Random(5)
    for kind in (lambda k: (20 * k, 1.0), lambda k: (k, 1.0 + k / 1e6), lambda k: (3 * k + r.randrange(2), r.random() * 4), lambda k: (20 * k, 9.0 - k / 1e4)):
        places = [kind(k) for k in range(64_000)]
        began = time.perf_counter()
        t.maximal_segments(places[:16_000], 0.5)
        assert time.perf_counter() - began < 0.25  # a tenth of this where nothing else runs
        t.maximal_segments(places, 0.5)
        assert time.perf_counter() - began < 1.5


@pytest.fixture(scope="module")
def model():
    r = random.Random(4)
    words = [f"w{i:03d}" for i in range(200)]
    words = ["".join(chr(97 + int(c)) for c in w[1:]) + "x" for w in words]
    clean = lambda: " ".join(r.choices(words, k=r.randrange(20, 80)))
    rows = [(clean(), int(r.random() < 0.01)) for _ in range(400)]
    rows += [(f"{clean()} vile {clean()} nasty vile {clean()}", 1) for _ in range(60)]
    return t.Model(rows, {0: 390, 1: 70}), clean


def test_toxic_passages_are_found(model):
    m, clean = model
    assert set(m.words.scores) == {"vile", "nasty"} and m.words.rate > 0
    text = f"{clean()} Vile, nasty vile. {clean()}"
    score, passages = m.judge(text)
    assert score > 0.9 and text[passages[0]["start"] : passages[0]["end"]] == "Vile, nasty vile"
    assert all(m.judge(x)[0] < t.CUT and not m.judge(x)[1] for x in [*(clean() for _ in range(50)), "", None, "12 !"])


def test_every_copy_of_a_passage_is_found(model):
    m, clean = model
    passage = "vile nasty vile vile nasty nasty"
    text = f"İ {clean()} {passage} {clean()} {passage}. {clean()} {passage.title()}"
    score, passages = m.judge(text)
    assert [text[p["start"] : p["end"]].lower() for p in passages] == [passage] * 3
    assert score == m.judge(f"İ {clean()} {passage} {clean()} {clean()} {passage}")[0] or score > 0.9


def brute_lexicon(rows):
    """Word -> (score, share in clean text), by definition: a word counts once for each word that stands before it."""
    pairs = {0: set(), 1: set()}
    for text, y in rows:
        words = re.findall(r"[^\W\d_]+", text.lower())
        pairs[y] |= set(zip(["", *words], words))
    n = {y: len(p) for y, p in pairs.items()}
    seen, prior, out = {y: Counter(w for _, w in p) for y, p in pairs.items()}, max(1.0, min(n.values())), {}
    for w in seen[1]:
        a = prior * (seen[0][w] + seen[1][w]) / (n[0] + n[1])
        y1, y0 = seen[1][w] + a, seen[0][w] + a
        odds = math.log(y1 / (n[1] + prior - y1)) - math.log(y0 / (n[0] + prior - y0))
        if odds >= t.LEAST_ODDS and odds / (1 / y1 + 1 / y0) ** 0.5 >= t.LEAST_Z:
            out[w] = min(odds, t.MOST)
    return out


def brute_score(m, lexicon, text):
    """The score by definition: best segments by exhaustion, right and left of each again, summed where significant."""
    words, once, scores = re.findall(r"[^\W\d_]+", (text or "").lower()), set(), []
    for pair in zip(["", *words], words):
        scores.append((0.0 if pair in once else lexicon[pair[1]]) if pair[1] in lexicon else -t.DRIFT)
        once.add(pair)
    total, open_ = 0.0, [(0, len(scores))]
    while open_:
        a, z = open_.pop()
        best, low, at, run = None, 0.0, a, 0.0
        for i in range(a, z):
            run += scores[i]
            if run - low > 1e-12 and (best is None or run - low > best[2] + 1e-12):
                best = at, i + 1, run - low
            if run < low:
                low, at = run, i + 1
        if best:
            e = m.words.rate * best[2] - math.log(m.k * len(words))
            total += e if -math.expm1(-math.exp(-e)) <= t.LEVEL else 0
            open_ += [(a, best[0]), (best[1], z)]
    return 1 / (1 + math.exp(-m.curve[0] - m.curve[1] * math.log1p(max(0.0, total))))


def test_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    text, label = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect()}
    m = t.fit(docs, labels, allowed=t.remainder("doc_id", 4) != 2)
    taught = [i for i in label if zlib.crc32(str(i).encode()) % 4 != 2 and text.get(i) is not None]
    lexicon = brute_lexicon([(text[i], label[i]) for i in taught])
    assert lexicon.keys() == m.words.scores.keys() and all(abs(lexicon[w] - m.words.scores[w]) < 1e-9 for w in lexicon)
    got = {r.doc_id: r for r in t.op6_toxicity(spark, sf).collect()}
    assert got.keys() == text.keys()
    for i, r in got.items():
        assert abs(r.score - brute_score(m, lexicon, text[i])) < 1e-9 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_the_root_solves_its_equation(model):
    scores = [(2.0, 0.01), (1.0, 0.02)]
    x = t.Lexicon._root(scores)
    assert abs(0.97 * math.exp(-t.DRIFT * x) + sum(p * math.exp(s * x) for s, p in scores) - 1) < 1e-6


def test_edge_cases(docs, none, spark, model):
    out = t.judge(clash(docs, "score", "passages"), model[0])
    assert out.columns == ["doc_id", "text", "lang", "source", "extra", "score", "passages"]
    assert out.count() == docs.count() and out.where("score between 0 and 1").count() == docs.count()
    labels = spark.createDataFrame([(1, 1), (4, 0), (1, 0), (None, 1), (5, None), (99, 1), (8, 7)], "doc_id long, toxic int")
    assert t.judge(docs, t.fit(docs, labels)).count() == docs.count()
    blank = t.fit(docs, labels.limit(0))
    assert t.judge(docs, blank).select("score").distinct().count() == 1 and t.judge(none, blank).count() == 0


def test_held_out_documents_teach_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    allowed = t.remainder("doc_id", 4) != 2
    flipped = labels.withColumn("toxic", F.when(allowed, F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = t.fit(docs, labels, allowed=allowed), t.fit(docs, flipped, allowed=allowed)
    assert (a.words.scores, a.k, a.curve) == (b.words.scores, b.k, b.curve)
    assert t.fit(docs, labels, most_bytes=40_000).words.scores != a.words.scores


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = t.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.9 and n[0, 1] / (n[0, 0] + n[0, 1]) < 0.02
