import hashlib
import random
import re

import pytest

from lodegraph.llm import decontaminate as d

from .conftest import clash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, own = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    hit.update(range(k, k + n))
                    own |= found
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in own if x is not None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [d.BLOCK_BYTES, 60])
def test_against_brute_force(spark, block_bytes):
    r = random.Random(7)
    vocabulary = ["the", "of", "a", "é", "x1", "königs", "rare", "B", "c-d"]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, text(r.choice((1, 2, 3, 9, 10, 11, 25)))) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (53, "dup dup dup"), (54, "Dup, dup! DUP?"), (None, "an item without id")]
    docs = [(i, text(60)) for i in range(20)] + [(100 + i, f"{text(5)} {t} {text(5)}") for i, (_, t) in enumerate(items)] + [(200, None), (201, ""), (201, ""), (202, "dup dup dup dup an ITEM without id")]
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    got = d.mark(left, right, block_bytes=block_bytes).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_hit, tuple(x.hit_items)) for x in got), key=str) == brute(docs, items)
    for x in got:
        assert sum(s.end - s.start for s in x.hit_spans) == x.n_hit


def test_edge_cases(docs, none, spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and then")], "item_id long, text string")
    out = d.mark(clash(docs, "n_words", "n_hit", "hit_spans", "hit_items", "_before"), items)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "extra", "n_words", "n_hit", "hit_spans", "hit_items"}
    got = {r.doc_id: r for r in out.collect()}
    assert got[4].n_hit == got[4].n_words > 20_000 and got[1].n_hit == 0 and out.count() == docs.count()
    assert d.mark(none, items).count() == 0 and d.mark(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_the_prefix_is_the_rarest_shingle():
    w = d.Windows([(1, "a b c d e f g h i j")], {(b"a", b"b", b"c"): 5, (b"d", b"e", b"f"): 1, **{k: 3 for k in [(b"b", b"c", b"d"), (b"c", b"d", b"e"), (b"e", b"f", b"g"), (b"f", b"g", b"h"), (b"g", b"h", b"i"), (b"h", b"i", b"j")]}})
    assert list(w.under) == [(b"d", b"e", b"f")]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    table = lambda n, i: [tuple(r) for r in spark.read.parquet(f"{sf}/{n}.parquet").select(i, "text").collect()]
    want = [(i, n, h, len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), h > 0) for i, n, h, own in brute(table("documents", "doc_id"), table("benchmark", "item_id"))]
    assert sorted((tuple(r) for r in d.op9_decontaminate(spark, sf).collect()), key=str) == want
