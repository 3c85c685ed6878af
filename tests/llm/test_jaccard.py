import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from lodegraph.llm import jaccard
from lodegraph.llm.common import written

from .test_simhash import brute_components


def shingle_set(text):
    """Five words each, A-Z lower-cased; of five words or fewer, all of them."""
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_against_brute_force(spark, sf):
    """The pipeline's stage keeps the least id of each component of exact Jaccard, no more and no less."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    top = brute_components([(r.doc_id, shingle_set(r.text)) for r in docs.collect()], alike)
    kept = [r.doc_id for r in c.near_duplicates(spark, docs, "").select("doc_id").collect()]
    assert sorted(kept) == sorted({i for i, t in top.items() if i == t})


@pytest.mark.parametrize("block", [4096, 3])
def test_random_groups(spark, block, tmp_path):
    """Edited copies around the threshold, chains, a common passage, short texts, repetitions of themselves."""
    r, texts = random.Random(3), []
    word = lambda: f"w{r.randrange(3000)}"
    common = [word() for _ in range(40)]
    for _ in range(25):
        base = [word() for _ in range(r.choice((3, 6, 30, 120)))] + (common if r.random() < 0.4 else [])
        for _ in range(r.choice((1, 2, 9))):
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 40)):
                base[r.randrange(len(base))] = word()
    texts += ["a b c d e f g", "a b c d e f g a b c d e f g", "", " ", "a", "A"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs").withColumn("_row", F.monotonically_increasing_id())
    got = {x.doc_id: x.component_id for x in jaccard.groups(docs, block).collect()}
    assert got == brute_components([(i, shingle_set(t)) for i, t in enumerate(texts)], alike)


def test_repeated_id_of_unrelated_texts(spark, tmp_path):
    """An id on rows of two groups stands for both; groups without ids keep one row each."""
    x, y, z = (" ".join(f"{k}{i}" for i in range(30)) for k in "xyz")
    rows = [(1, x), (1, y), (2, y), (3, x), (1, x), (None, z), (None, z + " more"), (None, "quite another text without an id")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    kept = c.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), "").collect()
    assert sorted((str(r.doc_id), r.text[:2]) for r in kept) == [("1", "x0"), ("1", "y0"), ("None", "qu"), ("None", "z0")]


def test_frequent_shingles_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLED", 1)
    df = spark.createDataFrame([(k, "one two three four five six seven " + ("eight nine " * (k % 3))) for k in range(12)], "_row long, text string")
    every = jaccard.frequent(df)
    monkeypatch.setattr(jaccard, "TOLD", 2)
    hashes, times = jaccard.frequent(df)
    assert len(hashes) == 2 < len(every[0]) and sorted(times) == sorted(every[1])[-2:]


def test_sieve(spark):
    from lodegraph.llm.common import sieve, sifted

    ids = spark.range(0, 5000).withColumnRenamed("id", "row")
    some = ids.where("row % 7 = 0")
    inside, outside = sifted(ids, "row", sieve(some, "row")), sifted(ids, "row", sieve(some, "row"), inside=False)
    assert some.exceptAll(inside).isEmpty() and inside.count() < some.count() + 20 and inside.count() + outside.count() == 5000
    assert sifted(ids, "row", sieve(some.limit(0), "row")).isEmpty()


def test_only_sieves_are_told_to_all_tasks(spark, monkeypatch):
    plans = []

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(jaccard, "written", noted)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, i, " ".join(words[: 30 + i % 3] + [f"x{i // 3}"])) for i in range(30)]
    docs = written(spark.createDataFrame(rows, "doc_id long, _row long, text string"), "docs")
    plans.append(jaccard.groups(docs)._jdf.queryExecution().executedPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if re.search(r"BroadcastHashJoin", line)]
    assert len(plans) > 10 and joins and all("at#" in line for line in joins)
