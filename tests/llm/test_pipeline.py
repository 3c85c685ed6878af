import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline as c
from lodegraph.llm import byte_bpe, pii

from .test_decontaminate import brute as brute_hits
from .test_jaccard import alike, shingle_set
from .test_simhash import brute_components


def by_hand(rows, items):
    """(doc_id, text) that stay, from the stages' definitions; languages aside, rejection is for lack of letters."""
    rows = [r for r in rows if r.text and any(ch.isalpha() for ch in r.text)]
    top = brute_components([(r.doc_id, shingle_set(r.text)) for r in rows if r.doc_id is not None], alike)
    first = {}
    for r in rows:
        if top.get(r.doc_id) == r.doc_id:
            first.setdefault(r.doc_id, r)
    clean = {i for i, _, hit, _ in brute_hits([(r.doc_id, r.text) for r in first.values()], items) if not hit}
    plain = pii.Pseudonyms(pii.EXAMPLE_KEY)
    return {i: plain.replace(r.text)[0] for i, r in first.items() if i in clean}


def test_stages_are_the_required_ones():
    assert [n.split()[0] for n, _ in c.STAGES] == ["language", "SimHash", "benchmark", "PII", "byte-level"]


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    table = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    want = by_hand(table("documents").collect(), [tuple(r) for r in table("benchmark").select("item_id", "text").collect()])
    got = c.run(spark, sf)
    ranks = byte_bpe.read_ranks(spark, P.path("byte_bpe_multi_50k.tiktoken"))
    assert {r.doc_id: r.text for r in got.collect()} == want and got.count() == len(want)
    assert got.where("not round_trip").count() == 0
    back = byte_bpe.decode(got, ranks).collect()
    assert all(bytes(r.decoded).decode() == r.text for r in back)


def test_edge_cases(docs, none, spark):
    sf = "/root/testdata/sf0.001"
    for start in (docs.withColumn("n_chars", F.char_length("text").cast("long")), none.withColumn("n_chars", F.lit(0).cast("long"))):
        now = start
        for k, (_, stage) in enumerate(c.STAGES):
            now = stage(spark, now, sf)
            if k < len(c.STAGES) - 1:
                assert now.columns == start.columns
            now = now.cache()
        kept = [r.doc_id for r in now.collect()]
        assert sorted(kept, key=str) == ([1, 10, 4, 5, None] if start.count() else [])


def test_no_column_is_lost(spark, tmp_path):
    """A user's columns that bear the names of the stages' own."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns(dict.fromkeys(("_row", "row", "pii", "spans", "top", "at", "score", "n_hit"), F.lit("mine")))
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.where(" and ".join(f"{x} = 'mine'" for x in ("_row", "row", "pii", "spans", "top", "at", "score", "n_hit"))).count() == out.count() > 100
