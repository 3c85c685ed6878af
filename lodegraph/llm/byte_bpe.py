"""Byte-level BPE by prefix dynamic programming.

For each prefix of a byte string, exactly one vocabulary token can end the prefix's encoding. The table of these
last tokens answers every prefix at once: walking it backwards gives the encoding, appending bytes extends it
without touching what stands, and an edit needs new entries only until the old ones hold again.

A token t may end a prefix if the token u that ends what precedes it goes with t: BPE turns the bytes of u and t
together into just (u, t). A sequence of tokens is an encoding exactly if all its neighbours go together.
"""

from __future__ import annotations

import base64
import io
from array import array
from functools import lru_cache
from pathlib import Path

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns

#: Pieces and pairs of tokens that a Python worker remembers before it forgets those not met since it last did; longest piece that
#: is remembered, so that these have a bounded size; characters of a text whose matches are listed at once.
PIECES, PAIRS, REMEMBERED, LISTED = 100_000, 200_000, 64, 1 << 20


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """A rank file (base64 token, space, rank; at most a few MB) as bytes: the driver's own file, or by Spark's readers where the path has a scheme."""
    if "://" not in path:
        return Path(path).read_bytes()
    return spark.read.text(path, wholetext=True).first()[0].encode()


class Vocabulary:
    """Tokens, their ranks, the automaton that finds them, and which pairs of them go together."""

    def __init__(self, rank_file: bytes):
        self.rank = {base64.b64decode(t): int(r) for t, r in (line.split() for line in io.BytesIO(rank_file) if line.strip())}
        self.bytes = [b""] * (max(self.rank.values()) + 1)
        self.finder = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.bytes[rank] = token
            self.finder.add_word(token.decode("latin-1"), (len(token), rank))
        self.finder.make_automaton()
        self.longest = max(map(len, self.rank))
        self.pairs: dict[int, bool] = {}
        self.old_pairs: dict[int, bool] = {}
        self.pieces = _Pieces(self)

    def merged(self, data: bytes) -> list[int]:
        """The encoding by the definition: join the neighbours of least rank, leftmost first. For a few tokens' bytes only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], len(self.bytes)))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.rank[p] for p in parts]

    def go_together(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes is the two; a = -1: whether b's is itself."""
        key = (a + 1) << 32 | b
        answer = self.old_pairs.get(key)
        if answer is None:
            before, alone = (self.bytes[a], [a]) if a >= 0 else (b"", [])
            answer = self.merged(before + self.bytes[b]) == [*alone, b]
        if len(self.pairs) >= PAIRS:
            self.old_pairs, self.pairs = self.pairs, {}
        self.pairs[key] = answer
        return answer

    def tokens(self, data: bytes) -> list[int]:
        """The encoding of a piece: its prefix table, made once and walked back."""
        last: list[int] = []
        known, ask, done = self.pairs.get, self.go_together, 0
        for end, (length, token) in self.finder.iter(data.decode("latin-1")):
            if end == done:
                left = last[end - length] if length <= end else -1
                fits = known((left + 1) << 32 | token)
                if ask(left, token) if fits is None else fits:
                    last.append(token)
                    done += 1
        out, at = [], len(data) - 1
        while at >= 0:
            out.append(token := last[at])
            at -= len(self.bytes[token])
        out.reverse()
        return out


class _Pieces(dict):
    """Packed ids by piece. A piece that is a token is that token."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            data = piece.encode()
            whole = self.vocabulary.rank.get(data)
            ids = pack([whole] if whole is not None else self.vocabulary.tokens(data))
        if len(piece) <= REMEMBERED:
            if len(self) >= PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def forget(self) -> None:
        self.old = {}
        self.clear()


@lru_cache(1)
def vocabulary_of(rank_file: bytes) -> Vocabulary:
    """A worker's vocabulary, kept from task to task."""
    return Vocabulary(rank_file)


_encoders: list[_Pieces] = []


def forget() -> None:
    """A task's pieces go with it: a worker lives on, and would hold them under the steps that come after. Tokens and their pairs stay."""
    while _encoders:
        _encoders.pop().forget()


def pack(ids: list[int]) -> bytes:
    out = array("I", ids)
    assert out.itemsize == 4
    if array("H", [1]).tobytes() != b"\x01\x00":
        out.byteswap()
    return out.tobytes()


def unpack(data: bytes) -> array:
    out = array("I")
    out.frombytes(data)
    if array("H", [1]).tobytes() != b"\x01\x00":
        out.byteswap()
    return out


class PrefixTable:
    """``last[i]``: the token that ends the encoding of the first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), array("i")
        self.append(data)

    def _entries(self, start: int):
        """(position, token) for every position from ``start`` on; reads ``self.last`` before it and as it grows."""
        v, last = self.vocabulary, self.last
        known, ask = v.pairs.get, v.go_together
        begin = max(0, start - v.longest + 1)
        text, done = self.data[begin:].decode("latin-1"), start - begin
        for end, (length, token) in v.finder.iter(text):
            if end != done:
                continue  # found already, or before the start
            before = end - length + begin
            left = last[before] if before >= 0 else -1
            fits = known((left + 1) << 32 | token)
            if ask(left, token) if fits is None else fits:
                yield end + begin, token
                done += 1

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        for _, token in self._entries(start):
            self.last.append(token)
        assert len(self.last) == len(self.data), "a byte is no token"

    def splice(self, start: int, stop: int, new: bytes) -> int:
        """Replace data[start:stop]; returns how many entries were computed anew.

        Entries behind the edit are old ones moved as soon as as many neighbours as the longest token has bytes
        agree with the old table, for an entry depends on no earlier ones.
        """
        old, moved, agree = self.last[start:], len(new) - (stop - start), 0
        self.data[start:stop] = new
        del self.last[start:]
        for at, token in self._entries(start):
            self.last.append(token)
            was = at - moved
            agree = agree + 1 if at >= start + len(new) and old[was - start] == token else 0
            if agree == self.vocabulary.longest:
                self.last.extend(old[was - start + 1 :])
                return at + 1 - start
        return len(self.last) - start

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes, of all by default."""
        at, out = (len(self.data) if end is None else end) - 1, []
        while at >= 0:
            out.append(token := self.last[at])
            at -= len(self.vocabulary.bytes[token])
        return out[::-1]


def _encoder(rank_file: bytes, pattern: str):
    """A function from a text to its packed ids."""
    pieces, compiled = vocabulary_of(rank_file).pieces, regex.compile(pattern)
    _encoders.append(pieces)
    ids_of = pieces.__getitem__

    def one(text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(ids_of, compiled.findall(text) if len(text) <= LISTED else (m[0] for m in compiled.finditer(text))))

    return one


def _decoder(rank_file: bytes):
    """A function from packed ids to bytes; null to null."""
    tokens = vocabulary_of(rank_file).bytes.__getitem__
    return lambda packed: None if packed is None else b"".join(map(tokens, unpack(packed)))


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """``df`` with ``ids``: binary, the ids of the whole text as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded by itself. Null and empty texts get no ids (empty binary). Equal rows get
    equal ids; other columns stay, and one named ``ids`` is replaced. Texts of any length take memory in
    proportion to that one text. Special tokens are ordinary text.
    """
    held = df.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file: under 1 MB

    def step():
        one = _encoder(held.value, pattern)
        return lambda texts: [[one(t) for t in texts]]

    return add_columns(df, text, [T.StructField(ids, T.BinaryType())], step, keep_text, forget)


def round_trip(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded", keep_text: bool = True) -> DataFrame:
    """``encode``, then ``decode`` of the ids it gave, in one worker: ids and the bytes that they stand for."""
    held = df.sparkSession.sparkContext.broadcast(ranks)

    def step():
        one, back = _encoder(held.value, pattern), _decoder(held.value)

        def both(texts):
            packed = [one(t) for t in texts]
            return packed, [back(p) for p in packed]

        return both

    return add_columns(df, text, [T.StructField(ids, T.BinaryType()), T.StructField(out, T.BinaryType())], step, keep_text, forget)


def decode(df: DataFrame, ranks: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: binary, the bytes of the tokens in ``ids``; null ids decode to null."""
    held = df.sparkSession.sparkContext.broadcast(ranks)

    def step():
        one = _decoder(held.value)
        return lambda packed: [[one(p) for p in packed]]

    return add_columns(df, ids, [T.StructField(out, T.BinaryType())], step)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ranks = read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = round_trip(docs, ranks, public_tokenizers.PATTERN, keep_text=False)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


__all__ = ["Vocabulary", "PrefixTable", "encode", "decode", "round_trip", "read_ranks", "pack", "unpack", "op1_byte_bpe"]
