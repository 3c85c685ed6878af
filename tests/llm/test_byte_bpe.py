import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from lodegraph.llm import byte_bpe as b

from .conftest import clash

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks(spark):
    return b.read_ranks(spark, PATH)


@pytest.fixture(scope="module")
def oracle(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(c) for a, c in map(bytes.split, ranks.splitlines())}, special_tokens={})


def test_tables_appends_and_edits(ranks, oracle):
    v, r = b.Vocabulary(ranks), random.Random(3)
    for _ in range(400):
        data = bytes(r.choice(b"abthe  \xc3\xa9aaaa!\x00\xff") for _ in range(r.randrange(1, 90)))
        table = b.PrefixTable(v, data[:10])
        table.append(data[10:])
        for end in range(1, len(data) + 1, 7):
            assert table.tokens(end) == oracle._core_bpe.encode_single_piece(data[:end])
        x = r.randrange(len(data))
        y, new = r.randrange(x, len(data) + 1), bytes(r.choice(b"the a") for _ in range(r.randrange(6)))
        table.splice(x, y, new)
        assert table.last == b.PrefixTable(v, data[:x] + new + data[y:]).last


def test_an_edit_is_local(ranks):
    table = b.PrefixTable(b.Vocabulary(ranks), b"the cat sat on the mat. " * 500)
    assert table.splice(100, 103, b"dog") < 400


def test_as_the_library(docs, ranks, oracle):
    df = clash(docs, "ids", "decoded")
    out = b.decode(b.encode(df, ranks, P.PATTERN), ranks)
    assert out.columns == ["doc_id", "text", "lang", "source", "extra", "ids", "decoded"]
    got = out.collect()
    assert len(got) == docs.count()
    for r in got:
        assert list(b.unpack(r.ids)) == oracle.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_in_one_worker(docs, ranks):
    two, one = b.decode(b.encode(docs, ranks, P.PATTERN), ranks), b.round_trip(docs, ranks, P.PATTERN)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_one_very_long_piece(ranks, oracle):
    v, text = b.Vocabulary(ranks), "ab" * 20_000
    assert list(b.unpack(v.pieces[text])) == oracle.encode_ordinary(text)


def test_what_is_forgotten_is_found_again(ranks, oracle, monkeypatch):
    monkeypatch.setattr(b, "PIECES", 5)
    monkeypatch.setattr(b, "PAIRS", 5)
    v, r = b.Vocabulary(ranks), random.Random(8)
    for _ in range(300):
        piece = "".join(r.choice("abéthe") for _ in range(r.randrange(1, 12)))
        assert list(b.unpack(v.pieces[piece])) == oracle._core_bpe.encode_single_piece(piece.encode()) == b.PrefixTable(v, piece.encode()).tokens()


def test_nothing(none, ranks):
    assert b.encode(none, ranks, P.PATTERN).count() == 0


def test_query(spark):
    rows = b.op1_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(len(r.ids_sha256) == 64 for r in rows)


def test_long_pieces_are_not_remembered():
    v = b.Vocabulary(b.Path(PATH).read_bytes())
    for k in range(20):
        piece = "x" * (60 + k)
        assert b.unpack(v.pieces[piece]).tolist() == v.merged(piece.encode())
    assert max(map(len, v.pieces)) == b.REMEMBERED


def test_pieces_go_with_their_task(spark, docs, ranks):
    """A worker that encoded holds no pieces when the next step runs in it, and of pieces and pairs no more than some tens of MB while it does."""
    assert b.PIECES <= 100_000 and b.PAIRS <= 200_000

    def step(batches):
        for _ in batches:
            pass
        one = b._encoder(held.value, P.PATTERN)
        one("of a task")
        pieces = b.vocabulary_of(held.value).pieces
        before = len(pieces)
        b.forget()
        yield pa.RecordBatch.from_pydict({"before": [before], "after": [len(pieces) + len(pieces.old)]})

    import pyarrow as pa

    held = spark.sparkContext.broadcast(ranks)
    b.round_trip(docs, ranks, P.PATTERN).collect()  # ends its tasks by forgetting, so that only the next one's pieces are found
    (row,) = spark.range(1, numPartitions=1).mapInArrow(step, "before long, after long").collect()
    assert (row.before, row.after) == (3, 0)
