import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lodegraph.llm import simhash as s
from lodegraph.llm.components import components

from .conftest import TEXTS, clash


def brute_print(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in ([w[i : i + 4] for i in range(len(w) - 3)] or [w])]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints, linked=lambda a, b: bin(a ^ b).count("1") <= 4):
    """id -> least id of the chain, by union of all pairs."""
    top = {i: i for i, _ in prints}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if i < j and linked(a, b):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(docs):
    for r in s.fingerprints(clash(docs, "fp")).collect():
        assert r.fp == signed(brute_print(r.text)) and r.extra == 7


@pytest.mark.parametrize("block", [4096, 3])
def test_components_of_random_clusters(spark, block):
    r, prints = random.Random(5), []
    for _ in range(12):
        center = r.getrandbits(64)
        for _ in range(r.choice((1, 2, 25))):
            x = center
            for bit in r.sample(range(64), r.randrange(0, 5)):
                x ^= 1 << bit
            prints.append((len(prints) * 3 % 1009, x))
            if r.random() < 0.2:
                prints.append((len(prints) * 3 % 1009, x))
    for step in range(0, 40, 4):  # a chain whose ends lie far apart
        prints.append((2000 - step, (1 << step) - 1))
    assert len({i for i, _ in prints}) == len(prints)
    df = spark.createDataFrame([(i, signed(x)) for i, x in prints], "doc_id long, fp long")
    got = {x.doc_id: x.component_id for x in s.near_duplicates(df, block=block).collect()}
    assert got == brute_components(prints)


def test_every_pair_within_four_bits_is_found(spark):
    """Random pairs at distances 0 to 6: linked at 4 and below, not above."""
    r, rows, near = random.Random(8), [], {}
    for k in range(120):
        x, d = r.getrandbits(64), k % 7
        y = x
        for bit in r.sample(range(64), d):
            y ^= 1 << bit
        rows += [(2 * k, signed(x)), (2 * k + 1, signed(y))]
        near[2 * k + 1] = 2 * k if d <= 4 else 2 * k + 1
    got = {x.doc_id: x.component_id for x in s.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    assert {i: got[i] for i in near} == near


def test_edge_cases(docs, none):
    prints = s.fingerprints(docs)
    got = s.near_duplicates(prints).collect()
    assert len(got) == len(TEXTS)
    wordless = {r.component_id for r in got if r.doc_id in (2, 3, 7)}
    assert wordless == {2}
    assert s.near_duplicates(s.fingerprints(none)).count() == 0
    alone = prints.where("doc_id is null")
    assert [r.component_id for r in s.near_duplicates(alone).collect()] == [None]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 50)] + [(100, 100), (7, 3), (3, 7), (200, 150), (None, 4)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 51)} | {150: 150, 200: 150}
    assert components(edges.limit(0)).count() == 0


def test_large_group_makes_few_links(spark):
    """Near copies in hundreds: the links searched stay far below their square."""
    r = random.Random(1)
    center = r.getrandbits(64)
    prints = {center}
    while len(prints) < 400:
        prints.add(center ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    df = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(sorted(prints))], "doc_id long, fp long")
    assert {x.component_id for x in s.near_duplicates(df).collect()} == {0}
    nodes = df.select(F.col("fp").alias("node"), "fp", F.lit(0).cast("long").alias("cluster"))
    exact = s._exact(nodes)
    assert s._pairs(exact, exact, s._large(exact, 100)).count() == 0


def test_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    prints = {r.doc_id: brute_print(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute_components(list(prints.items()))
    got = s.op3_simhash(spark, sf).collect()
    assert len(got) == len(prints) and {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{x:016x}", want[i]) for i, x in prints.items()}


def test_repeated_rows_stay(spark):
    rows = [(3, 0b1111), (3, 0b1111), (1, 0), (9, (1 << 40) - 1), (3, (1 << 40) - 1), (None, 0)]
    got = s.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    assert sorted((r.doc_id or 0, r.fp, r.component_id) for r in got) == sorted([(3, 15, 1), (3, 15, 1), (1, 0, 1), (9, (1 << 40) - 1, 3), (3, (1 << 40) - 1, 3), (0, 0, 1)])


def test_exploded_rows_are_not_told_to_all_tasks(spark):
    """A table of fingerprints is small beside its 66 rows of keys each; a join by its files' size would hold those in the driver."""
    named = s.written(spark.range(1000).select(F.col("id").alias("node"), F.xxhash64("id").alias("fp"), F.col("id").alias("cluster")), "named")
    exact = s._exact(named)
    for pairs in (s._pairs(exact, exact, None), s._pairs(*s._variants(named), None)):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
