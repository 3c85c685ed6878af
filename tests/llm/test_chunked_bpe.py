import hashlib
import random
import struct

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodegraph.llm import chunked_bpe as c

from .conftest import clash

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def spec(spark):
    return c.read_tokenizer(spark, PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder(spec):
    return c.Encoder(spec, c.cuttable())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


ALPHABETS = (
    ["a", "b", "the ", "don't ", "'", "re", "'ll", " ", "\n", ".", ",", "!!", "1", "42", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext"],
    ["e", "́", "̈", "E", "̧", "ᄀ", "ᅡ", "ᆨ", "가", "İ", "Σ", "ς", "ß", "Ǆ", "ͅ", " ", "x", "ெ", "ௗ"],
    ["日", "本", "語", "。", "、", "か", "゙", "ก", "ำ", "1", "<|endoftext|>", "\U0001f600", "‍", "क", "ि", "्"],
    ["a", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​", "\x0b", "\x00", "\t", "\r", ".", "é", "²", "Ⅷ", "_"],
)


@pytest.mark.parametrize("sizes", [(1, 2, 9), (4, 8, 40), (16, 32, 4000)])
def test_joined_as_the_library(encoder, library, monkeypatch, sizes):
    for name, size in zip(("LEAST", "AVERAGE", "MOST"), sizes):
        monkeypatch.setattr(c, name, size)
    monkeypatch.setattr(c, "BLOCK", 64)
    r, several = random.Random(sizes[0]), 0
    for k in range(2500):
        text = "".join(r.choices(r.choice(ALPHABETS), k=r.choice([3, 20, 80, 300])))
        assert list(c.unpack(encoder.encode(text, {}))) == ids_of(library, text), repr(text)
        several += len(encoder.chunker.cuts(text)) > 3
    assert several > 500


def test_all_white_space_and_letters_beside_it(encoder, library):
    for k in [*range(0x250), *range(0x1680, 0x1681), *range(0x2000, 0x2070), 0x3000, 0xFEFF]:
        text = f"ab{chr(k)}cd {chr(k)} {chr(k)}e E{chr(k)}. 'S{chr(k)}"
        assert list(c.unpack(encoder.plain(text))) == ids_of(library, text)


def test_text_without_white_space_is_joined_at_its_words(encoder, library):
    r = random.Random(5)
    text = "".join(r.choice("日本語学校生活時間。、") for _ in range(60_000))
    known = {k: encoder.entry(t) for k, t in enumerate(encoder.chunker.chunks(text))}
    assert len(known) > 20
    again = []
    own = encoder._words
    encoder._words = lambda t: (again.append(len(t)), own(t))[1]
    try:
        assert list(c.unpack(encoder.encode(text, known))) == ids_of(library, text)
    finally:
        del encoder._words
    assert sum(again) < len(text) / 4  # of what is known, little is encoded again


def test_one_very_long_word(encoder, library):
    text = "ab" * 150_000
    assert list(c.unpack(encoder.encode(text, {}))) == ids_of(library, text)


def test_cuts_follow_content(encoder):
    r = random.Random(9)
    text = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(60_000))
    whole, moved = set(encoder.chunker.chunks(text)), set(encoder.chunker.chunks("another beginning " + text[1000:]))
    assert len(whole & moved) > 0.9 * len(whole)
    assert "".join(encoder.chunker.chunks(text)) == text and max(map(len, whole)) <= c.MOST + 1


def test_what_is_forgotten_is_found_again(spec, library, monkeypatch):
    monkeypatch.setattr(c, "RUNS", 5)
    own, r = c.Encoder(spec, c.cuttable()), random.Random(2)
    for _ in range(200):
        text = " ".join("".join(r.choice("abé,.") for _ in range(r.randrange(1, 6))) for _ in range(9))
        assert list(c.unpack(own.plain(text))) == ids_of(library, text)
    assert len(own.runs) <= 5


def test_each_row(docs, spec, library):
    df = clash(docs, "ids", "row", "chunks", "body")
    out = c.decode(c.encode(df, spec), spec)
    assert set(out.columns) == {*df.columns, "decoded"}
    got = out.collect()
    assert len(got) == docs.count()
    for x in got:
        want = ids_of(library, x.text)
        assert list(c.unpack(x.ids)) == want and x.decoded == library.decode(want, skip_special_tokens=False) and x.row == "mine"


def test_shared_chunks_are_encoded_once(spark, spec, library, tmp_path):
    r = random.Random(11)
    prose = lambda n: " ".join("".join(r.choice("aeioubcdfg") for _ in range(r.randrange(2, 9))) for _ in range(n))
    passage, long = prose(3000), "".join(r.choice("日本語学校。") for _ in range(20_000))
    texts = [prose(40) + "<|endof" + passage + prose(30) for _ in range(30)] + [passage] * 5 + [long + prose(5)] * 3 + [prose(700) for _ in range(20)] + [None, "", "x"]
    rows = [(k // 2 if k % 9 else None, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    held = spark.sparkContext.broadcast((spec, c.cuttable()))
    found = c.shared_chunks(df.select(F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text")), held).collect()
    assert len(found) >= 38 and max(len(x.chunks) for x in found) > 10
    got = c.encode(df, spec, decoded="decoded").collect()
    assert len(got) == len(rows)
    for x in got:
        want = ids_of(library, x.text)
        assert list(c.unpack(x.ids)) == want and x.decoded == library.decode(want, skip_special_tokens=False)


def test_nothing(none, spec):
    assert c.encode(none, spec, decoded="decoded").collect() == []


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError):
        c.read_tokenizer(spark, P.path("byte_bpe_50k.json"))


def test_query(spark, library):
    rows = {x.doc_id: x for x in c.op11_chunked_bpe(spark, "/root/testdata/sf0.001").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(texts)
    for t in texts:
        want, x = ids_of(library, t.text), rows[t.doc_id]
        packed = struct.pack(f"<{len(want)}I", *want)
        decoded = library.decode(want, skip_special_tokens=False).encode()
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(want), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest())
