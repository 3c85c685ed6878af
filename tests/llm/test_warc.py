import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodegraph.llm import warc as w

BIG, SMALL = "<p>" + "x é " * 400, "<p>small"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/1", BIG), (2, "http://a/2 x\ty", BIG), (3, None, SMALL), (4, "http://a/4", SMALL), (5, "http://a/5", None), (6, "", ""), (7, "http://b", BIG), (8, "http://c", BIG + "!"), (7, "http://b", BIG)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def brute(rows):
    by, out = defaultdict(list), []
    for r in rows:
        by[r.html or ""].append(r.page_id)
    for r in rows:
        data, most = (r.html or "").encode(), max(by[r.html or ""])
        again = len(data) >= 1000 and r.page_id != most
        out.append((r.page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", most if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("archive_bytes, gap, longest", [(w.ARCHIVE_BYTES, w.GAP_BYTES, w.READ_BYTES), (1, 0, 1), (400, 10, 300)])
def test_round_trip(pages, archive_bytes, gap, longest):
    df = pages.withColumn("extra", F.lit(1)).withColumn("_digest", F.lit(1))
    index = w.write(w.revisits(df), archive_bytes=archive_bytes)
    got = w.read(index, gap=gap, longest=longest).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == brute(pages.collect())
    text = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert all(bytes(r.payload) == text[r.page_id] for r in got if r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")


def test_no_column_is_lost(pages):
    extra = dict.fromkeys(("_digest", "digest", "_first", "first", "times"), F.lit("mine"))
    out = w.revisits(pages.withColumns(extra))
    assert out.columns == ["page_id", "url", "html", *extra, "refers_to"] and all(out.where(f"{c} = 'mine'").count() == pages.count() for c in extra)


def test_reading_is_parallel(pages, monkeypatch):
    monkeypatch.setattr(w, "TASK_BYTES", 1000)
    index = w.write(w.revisits(pages), archive_bytes=1)
    got = w.read(index, longest=1)
    assert got.rdd.getNumPartitions() > 1 and got.count() == pages.count()


def test_only_selected_ranges_are_read(pages):
    index = w.write(w.revisits(pages).coalesce(1))
    assert index.select("archive").distinct().count() == 1
    one = w.read(index, F.col("url") == "http://a/4").collect()
    assert [r.page_id for r in one] == [4]
    every = w.ranges(index)
    assert every.count() == 1 and every.first()["size"] == index.agg(F.sum("length")).first()[0]
    apart = w.ranges(index.where("page_id in (1, 8)"), gap=0)
    assert apart.count() == 2


def test_records_are_standard(pages):
    index = w.write(w.revisits(pages).coalesce(1)).orderBy("offset").collect()
    store, at = w.open_store(index[0].archive)
    with store.open_input_file(at) as f:
        data = f.read()
    assert index[-1].offset + index[-1].length == len(data)
    whole, rest = b"", data
    while rest:  # the archive is its members one after another, as any reader of gzip sees it
        z = zlib.decompressobj(31)
        whole += z.decompress(rest)
        rest = z.unused_data
    assert whole.count(b"WARC/1.1\r\n") == len(index) and whole.endswith(b"\r\n\r\n")


def test_damage_is_noticed():
    good = w.record(1, "u", b"payload", None)
    assert w.parsed(good)[1] == b"payload"
    for bad in (good[:-6], good.replace(b"WARC/1.1", b"XARC/1.1"), good + b"more"):
        with pytest.raises(ValueError):
            w.parsed(bad)


def test_nothing(pages):
    assert w.read(w.write(w.revisits(pages.limit(0)))).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in w.op5_warc(spark, sf).collect()], key=str)
    assert got == brute(spark.read.parquet(f"{sf}/pages.parquet").collect())
