import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import ngram_lm as m

from .conftest import clash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, train, fold):
    """Each row's counts, base score and score, from plain counters; rows are (id, text)."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = [[*WORD.findall(low(t)), None] for _, t in rows]

    def grams(k):
        """(word, bigram, trigram) of every token; what stands before the first word is 0."""
        two = list(zip([0, *tokens[k][:-1]], tokens[k], strict=True))
        return zip(tokens[k], two, zip([0, *two[:-1]], tokens[k], strict=True), strict=True)

    def counted(chosen):
        counts = Counter(), Counter(), Counter()
        for k in chosen:
            for found in grams(k):
                for c, g in zip(counts, found, strict=True):
                    c[g] += 1
        return *counts, len(chosen)

    def estimates(counts, k):
        one, two, three, n = counts
        total, types = sum(one.values()), len(one)
        for w, bi, tri in grams(k):
            c, d = (n, n) if bi[0] == 0 else (one[bi[0]], two[tri[0]])
            step = lambda x: min(int(math.log2(x)), m.CONTEXT_BUCKETS - 1)
            yield (one[w] + 1) / (total + types + 1), two[bi] / c if c else 0.0, three[tri] / d if d else 0.0, step(d) if d else m.CONTEXT_BUCKETS + step(c) if c else 2 * m.CONTEXT_BUCKETS, one[w]

    whole = counted([k for k, (i, _) in enumerate(rows) if train(i)])
    less = counted([k for k, (i, _) in enumerate(rows) if train(i) and not fold(i)])
    steps, seen = (m.RATIO_HIGH - m.RATIO_LOW) * m.RATIO_STEPS, Counter()
    step = lambda x: 1 + min(max(math.floor((math.log2(x) - m.RATIO_LOW) * m.RATIO_STEPS), 0), steps - 1) if x else 0
    for k, (i, _) in enumerate(rows):
        if train(i) and fold(i):
            seen.update((c, step(b / u), step(t / u)) for u, b, t, c, _ in estimates(less, k))
    w = em(seen)
    for k, (i, _) in enumerate(rows):
        e = list(estimates(whole, k))
        yield i, train(i), len(e), sum(x[-1] > 0 for x in e), sum(whole[0].values()), sum(math.log10(x[0]) for x in e), sum(math.log10(w[c][0] * u + w[c][1] * b + w[c][2] * t) for u, b, t, c, _ in e)


def em(seen):
    """Weights by context bucket from (bucket, bigram step, trigram step) -> times, by plain expectation-maximisation."""
    value = lambda s: 2.0 ** (m.RATIO_LOW + (s - 0.5) / m.RATIO_STEPS) if s else 0.0
    out = []
    for b in range(2 * m.CONTEXT_BUCKETS + 1):
        levels = 3 if b < m.CONTEXT_BUCKETS else 2 if b < 2 * m.CONTEXT_BUCKETS else 1
        mine = [((1.0, value(s), value(t))[:levels], n) for (c, s, t), n in sorted(seen.items()) if c == b]
        w, total = [1 / levels] * levels, sum(n for _, n in mine)
        for _ in range(m.EM_ROUNDS if mine else 0):
            sums = [0.0] * levels
            for part, n in mine:
                whole = sum(x * y for x, y in zip(w, part, strict=True))
                sums = [s + n * x * y / whole for s, x, y in zip(sums, w, part, strict=True)]
            w = [s / total for s in sums]
            if w[0] < m.LEAST_UNIGRAM and levels > 1:
                w = [m.LEAST_UNIGRAM, *(x * (1 - m.LEAST_UNIGRAM) / sum(w[1:]) for x in w[1:])]
        out.append((w + [0.0, 0.0])[:3] if mine else out[-1] if levels > 1 and b % m.CONTEXT_BUCKETS else [1.0, 0.0, 0.0])
    return out


def mod(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7


def same(got, rows, train, fold):
    want = sorted(brute(rows, train, fold), key=lambda r: (str(r[0]), r[2], r[5]))
    got = sorted(((r.doc_id, r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=lambda r: (str(r[0]), r[2], r[5]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("block_rows, fan_out", [(2048, 4096), (2, 4096), (2, 3), (3, 1)])
def test_against_brute_force(docs, spark, block_rows, fan_out, tmp_path):
    """Also where there are more buckets than a block may send to, so that entries go in runs."""
    clash(docs, "block", "train", "run", "kind").write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs").union(spark.read.parquet(f"{tmp_path}/docs"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = m.score(df, m.remainder("doc_id", 7) != 2, m.remainder("doc_id", 7) == 3, block_rows=block_rows, bucket_entries=1000, fan_out=fan_out).collect()
    same(got, rows, lambda i: mod(i) != 2, lambda i: mod(i) == 3)


def test_a_block_sends_to_few_buckets(spark):
    """Rows sent grow with the blocks, not with blocks times buckets."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    blocked = m._blocked(docs, "text", F.lit(True), F.lit(False), "doc_id", 8)
    blocks = blocked.select("block").distinct().count()
    assert blocks > 20 and m._send(blocked, 16, 50).count() <= 3 * 16 * blocks


def test_nothing_and_no_training(docs, none):
    assert m.score(none, F.lit(True), F.lit(False)).count() == 0
    got = m.score(docs, F.lit(False), F.lit(False)).collect()
    assert len(got) == docs.count() and {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)}


def test_estimates_add_up_to_one():
    """After any two tokens, seen or not, the probabilities of all words that may follow, seen and unseen, sum to 1."""
    text, other = "a b a b c a b", ["a b", "b c", "c c", "x a", "x y", "a", "x", ""]
    vocabulary = ["a", "b", "c", None, "unseen"]
    weights = np.random.default_rng(1).random((2 * m.CONTEXT_BUCKETS + 1, 3))
    weights[m.CONTEXT_BUCKETS :, 2], weights[-1, 1] = 0, 0
    weights /= weights.sum(axis=1, keepdims=True)
    taught = m.Block()
    taught.add(text)
    counted = {kind: dict(zip(keys, counts, strict=True)) for kind, keys, counts, _ in m._keys(taught, [1], 60)}
    for before in other:
        total = 0.0
        for word in vocabulary:
            block = m.Block()
            block.add(f"{before} {word or ''}")
            rows = []
            for kind, keys, _, _ in m._keys(block, [0], 60):
                rows.append({"kind": kind, "bucket": 0, "own": len(keys), "more": np.packbits(np.ones(len(keys), bool)).tobytes(), "counts": m._short(np.array([counted[kind].get(k, 0) for k in keys], dtype=np.uint64)), "folds": b""})
            n, v = int(sum(counted[1].values())), len(counted[1])
            e = m.Estimates(block, [0], pd.DataFrame(rows), n, v, 1, False, 60)
            total += e.mixed(weights)[len(before.split())]
        assert total == pytest.approx(1)


def test_weights_go_to_what_predicts():
    steps = (m.RATIO_HIGH - m.RATIO_LOW) * m.RATIO_STEPS
    cells = [(1, 0, 0, 50), (2, steps, 0, 50), (3, 0, steps, 50), (4, steps, 0, 40), (4, 0, steps, 60), (m.CONTEXT_BUCKETS + 1, steps, 0, 10)]
    w = m.learnt(*(np.array(x, dtype=np.int64) for x in zip(*cells, strict=True)))
    assert tuple(w[0]) == (1, 0, 0) and w[1][0] > 0.99 and w[2][1] > 0.99 and w[3][2] > 0.99 and 0.35 < w[4][1] < 0.45 < w[4][2] < 0.65
    assert np.array_equal(w[5], w[4]) and w[m.CONTEXT_BUCKETS + 1][1] > 0.99 and np.allclose(w.sum(axis=1), 1)


def test_packing():
    for values in ([], [0], [255, 256], [2**64 - 1, 3]):
        a = np.array(values, dtype=np.uint64)
        assert np.array_equal(m._long(m._short(a)), a)
        assert not len(a) or np.array_equal(m._unpacked_keys(m._packed_keys(np.sort(a))), np.sort(a))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = m.op10_ngram_lm(spark, sf).withColumn("train", ~F.col("held_out")).collect()
    same(got, rows, lambda i: mod(i) != 2, lambda i: mod(i) == 3)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
