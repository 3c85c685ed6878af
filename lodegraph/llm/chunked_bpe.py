"""BPE with word ends, by chunks that documents share.

A rolling hash cuts texts where their content says so, so passages that documents share become equal chunks, wherever they
stand. Of the chunks that occur more than once each is encoded once, into a table that all documents join; the others are
encoded where they are. Where two chunks meet, the text around the cut is encoded again, as far as both agree:

- no word of the tokenizer holds white space, so words from the first one behind white space on are those of the whole text;
- words are found from left to right, by what follows: from a place where a word begins in the whole text and in the chunk alone,
  both find the same ones, up to the last few characters of the chunk, where more text could still change them.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import pack, unpack
from .common import add_columns, give_back, quoted, sieve, sifted, slices, small_batches, spare, table, written

#: Code points of a chunk: at least, on average beyond that, and from where on the next possible place is taken.
LEAST, AVERAGE, MOST = 256, 1024, 8192
#: Code points whose hash a cut depends on; of a text that are hashed at once.
WINDOW, BLOCK = 32, 1 << 18
#: Runs without white space that a worker remembers before it forgets those not met since; longest that is remembered.
RUNS, REMEMBERED = 400_000, 64
#: Characters before the end of a chunk whose words may change by what follows, at least: the longest contraction has three.
MARGIN = 16
#: Words at the head of a chunk without white space among which its neighbour's are looked for.
HEAD = 8

#: Fixed value: the tokenizer's words, lower-cased. A run of letters is one of them, and no more than three characters decide where one ends.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: White space that parts words for certain, and marks that are a word of their own behind a letter.
WHITE, MARKS = " \t\n\r", ".,;:!?"
_RUN = re.compile(f"[^{WHITE}]+")


@lru_cache(1)
def cuttable() -> bytes:
    """A bit for each code point: whether a text can be cut before it, so that normalised halves make the normalised whole.

    That is so for assigned characters that neither combine nor are the second of a composition; later versions of Unicode keep this.
    """
    second = set(range(0x1161, 0x1176)) | set(range(0x11A7, 0x11C3))  # Hangul vowels and final consonants
    known = [k for k in range(0x110000) if unicodedata.category(chr(k)) not in ("Cn", "Cs")]
    for k in known:
        parts = unicodedata.decomposition(chr(k)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(int(parts[1], 16))
    out = np.zeros(0x110000, bool)
    out[[k for k in known if not unicodedata.combining(chr(k)) and k not in second]] = True
    return np.packbits(out).tobytes()


def read_tokenizer(spark: SparkSession, path: str) -> str:
    """A tokenizer file (at most a few MB): the driver's own, or by Spark's readers where the path has a scheme."""
    found = Path(path).read_text("utf-8") if "://" not in path else spark.read.text(path, wholetext=True).first()[0]
    spec = json.loads(found)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    first, *then = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    drops = first.get("pattern") == {"Regex": WORDS} and first.get("behavior") == "Removed" and first.get("invert")
    drops = drops and [(t["type"], t["add_prefix_space"], t["use_regex"]) for t in then] == [("ByteLevel", False, False)]
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    if not drops or not plain or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or spec.get("post_processor"):
        raise ValueError("chunks can be joined for tokenizers whose words are WORDS")
    return found


class Chunker:
    def __init__(self, bits: bytes):
        self.cuttable = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)

    def cuts(self, text: str) -> list[int]:
        """Where the text is cut, its ends included."""
        if len(text) <= LEAST:
            return [0, len(text)]
        places, allowed = [], []
        for start in range(0, len(text), BLOCK):
            begin = max(0, start - WINDOW)
            points = np.frombuffer(text[begin : start + BLOCK].encode("utf-32-le"), np.uint32)
            h = points * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            reach = 1
            while reach < WINDOW:
                h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
                reach *= 2
            free = self.cuttable[points]
            hit = np.flatnonzero((h[:-1] < (1 << 32) // AVERAGE) & free[1:]) + 1 + begin
            places.append(hit[hit > start] if start else hit)
            allowed.append(free[start - begin :])
        return self._chosen(np.concatenate(places).tolist(), np.concatenate(allowed))

    @staticmethod
    def _chosen(places: list[int], allowed: np.ndarray) -> list[int]:
        out, n = [0], len(allowed)
        for place in [*places, n]:
            while place - out[-1] > MOST:
                free = np.flatnonzero(allowed[out[-1] + MOST : place])
                if not len(free):
                    break
                out.append(out[-1] + MOST + int(free[0]))
            if place == n or place - out[-1] >= LEAST:
                out.append(place)
        return out

    def chunks(self, text: str) -> list[str]:
        cuts = self.cuts(text)
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def key_of(chunk: str) -> bytes:
    return xxhash.xxh3_128_digest(chunk.encode())


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is seen in print, one behind the bytes else."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class _Runs(dict):
    """Packed ids by run of characters without white space. Most are letters, with a mark behind them at most: words that go to the merges as they are."""

    def __init__(self, tokenizer):
        self.tokenizer, self.old = tokenizer, {}
        self.merges, self.letters = tokenizer.model, _byte_letters()
        self.packed = [pack([k]) for k in range(tokenizer.get_vocab_size(with_added_tokens=True))]

    @staticmethod
    def _word(run: str) -> str:
        """The run as the one word that it becomes, if it is one of letters and surely so; empty else."""
        if not run.isalpha():
            return ""
        lower = run.lower()
        # a sigma's lower case depends on its place to Python alone; some letters become a letter and a mark
        plain = run.isascii() or lower.isalpha() and "\u03a3" not in run and unicodedata.is_normalized("NFC", run)
        return lower if plain else ""

    def _ids(self, run: str) -> bytes:
        marked = run[-1] in MARKS
        if word := self._word(run[:-1] if marked else run):
            if marked:
                return self[run[:-1]] + self[run[-1]]
            if not run.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            return b"".join([self.packed[t.id] for t in self.merges.tokenize(word)])
        return pack(self.tokenizer.encode(run, add_special_tokens=False).ids)

    def __missing__(self, run: str) -> bytes:
        ids = self.old.get(run)
        if ids is None:
            ids = self._ids(run)
        if len(run) <= REMEMBERED:
            if len(self) >= RUNS:
                self.old = dict(self)
                self.clear()
            self[run] = ids
        return ids


class Entry:
    """A chunk's ids and where its words can be joined.

    ``marks``: place and tokens before it, of the first word behind white space and of the last; none if no word is. Then ``starts``
    has place and tokens before it for all words that begin where a text can be cut.
    """

    __slots__ = ("ids", "marks", "starts")

    def __init__(self, ids: bytes, marks: list[int], starts: list[int]):
        self.ids, self.marks, self.starts = ids, marks, starts


class Encoder:
    def __init__(self, spec: str, bits: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.runs, self.chunker = _Runs(self.tokenizer), Chunker(bits)
        self.margin = max(MARGIN, *(len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.tokens = {k: t.encode() for t, k in self.tokenizer.get_vocab(with_added_tokens=True).items()}

    def plain(self, text: str) -> bytes:
        """The ids, run by run."""
        return b"".join(map(self.runs.__getitem__, _RUN.findall(text)))

    def _words(self, text: str) -> tuple[list[int], list[int]]:
        """(ids, starts) as the library finds them."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        words, offsets, starts, free = found.word_ids, found.offsets, [], self.chunker.cuttable
        for k, word in enumerate(words):
            # a character that becomes two words begins only the first of them
            first = k == 0 or word != words[k - 1] and offsets[k - 1][1] <= offsets[k][0]
            if first and free[ord(text[offsets[k][0]])]:
                starts += [offsets[k][0], k]
        return found.ids, starts

    def entry(self, chunk: str) -> Entry:
        runs = _RUN.findall(chunk)
        if not runs:
            return Entry(b"", [len(chunk), 0, len(chunk), 0], [])
        behind = chunk[0] in WHITE
        if not behind and len(runs) == 1:
            ids, starts = self._words(chunk)
            return Entry(pack(ids), [], starts)
        ids = [self.runs[r] for r in runs]
        rest = chunk if behind else chunk[len(runs[0]) :]
        first = len(chunk) - len(rest.lstrip(WHITE))
        last = len(chunk.rstrip(WHITE)) - len(runs[-1])
        whole = b"".join(ids)
        if len(runs) == 1 + (not behind) and first > last:  # white space at the end only
            first = last = len(chunk)
        return Entry(whole, [first, 0 if behind else len(ids[0]) // 4, last, (len(whole) - len(ids[-1])) // 4], [])

    def encode(self, text: str, known: dict[int, Entry]) -> bytes:
        """The ids of the whole text from its chunks; ``known`` has those that are encoded already, by their number."""
        out: list[bytes] = []
        pending, tried = "", 0  # text from the start of a word whose end is open; how long it was when it was last compared
        for k, chunk in enumerate(self.chunker.chunks(text)):
            e = known.get(k) or self.entry(chunk)
            if e.marks:
                first, before, last, to_last = e.marks
                out += (self.plain(pending + chunk[:first]), e.ids[4 * before : 4 * to_last])
                pending, tried = chunk[last:], 0
            elif not e.starts or (len(pending) > MOST and len(pending) < 2 * tried):
                pending += chunk
            else:
                tried = len(pending)
                joined = self._agree(pending, chunk, e)
                if joined is None:
                    pending += chunk
                else:
                    ids, at = joined
                    place, to_last = max((p, t) for p, t in zip(e.starts[::2], e.starts[1::2]) if p == e.starts[at] or p + self.margin <= len(chunk))
                    out += (ids, e.ids[4 * e.starts[at + 1] : 4 * to_last])
                    pending, tried = chunk[place:], 0
        out.append(self.plain(pending))
        return b"".join(out)

    def _agree(self, pending: str, chunk: str, e: Entry) -> tuple[bytes, int] | None:
        """The ids of ``pending`` and of ``chunk`` up to a word that begins in both, and where that word stands in ``e.starts``."""
        starts = e.starts
        if not pending:
            sure = starts[0] == 0 or starts[0] + self.margin <= len(chunk)
            return (e.ids[: 4 * starts[1]], 0) if sure else None
        reach = min(len(chunk), starts[min(len(starts), 2 * HEAD) - 2] + self.margin)
        ids, both = self._words(pending + chunk[:reach])
        found = dict(zip(both[::2], both[1::2]))
        for at in range(0, min(len(starts), 2 * HEAD), 2):
            place = starts[at]
            if place + self.margin <= reach and len(pending) + place in found:
                return pack(ids[: found[len(pending) + place]]), at
        return None

    def decode(self, ids: bytes) -> bytes:
        return b" ".join(map(self.tokens.__getitem__, unpack(ids)))


@lru_cache(1)
def encoder_of(spec: str, bits: bytes) -> Encoder:
    """A worker's encoder, kept from task to task."""
    return Encoder(spec, bits)


_ENTRY = "ids binary, marks array<int>, starts array<int>"


def _mapped(df: DataFrame, text: int, schema: str, held, row) -> DataFrame:
    """Rows that ``row(encoder, columns of a slice as lists)`` yields, by Arrow slices whose texts stand in column number ``text``."""
    kinds = [(f.name, f.dataType) for f in T._parse_datatype_string(schema)] if isinstance(schema, str) else [(f.name, f.dataType) for f in schema]
    simple = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(*held.value)
        for batch in batches:
            for part in slices(batch, text):
                rows = list(row(encoder, [c.to_pylist() for c in part.columns]))
                columns = zip(*rows) if rows else [[] for _ in kinds]
                arrays = [pa.array(list(c), simple[t.simpleString()]) for c, (_, t) in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in kinds])
        give_back()

    return df.mapInArrow(run, schema)


def shared_chunks(rows: DataFrame, held) -> DataFrame:
    """(row, chunks): for each row of (row, text) that holds chunks that occur elsewhere, too, their numbers and entries; each is encoded once.

    Only keys of 16 bytes are shuffled for all chunks; text only for the rows that are the first to hold a shared chunk. A chunk that a third
    of all rows hold is counted before it is shuffled, and its rows meet its entry by an equi-join, which adaptive execution splits.
    """

    def keys(encoder, columns):
        for row, text in zip(*columns):
            for k, chunk in enumerate(encoder.chunker.chunks(text)):
                yield row, k, key_of(chunk)

    refs = written(_mapped(rows, 1, "row long, k int, key binary", held, keys), "chunks")
    counted = refs.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("row", "k")).alias("first"))
    shared = written(counted.where("n > 1").select("key", "first.row", "first.k"), "shared")
    mine = shared.groupBy("row").agg(F.collect_list(F.struct("k", "key")).alias("mine"))

    def entries(encoder, columns):
        for text, mine in zip(*columns):
            chunks = encoder.chunker.chunks(text)
            for m in mine:
                e = encoder.entry(chunks[m["k"]])
                yield m["key"], e.ids, e.marks, e.starts

    owners = sifted(rows, "row", sieve(shared, "row")).join(mine, "row").select("text", "mine")
    encoded = written(_mapped(owners, 0, f"key binary, {_ENTRY}", held, entries), "encoded")
    found = refs.join(encoded, "key").groupBy("row").agg(F.collect_list(F.struct("k", "ids", "marks", "starts")).alias("chunks"))
    return written(found, "found")


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with ``ids``: binary, the ids of the whole text as little-endian unsigned 32-bit integers, as the library gives them without special tokens.

    ``decoded``: also a column of this name with the text that the ids stand for. ``tokenizer`` is the content of its file
    (``read_tokenizer``). Null and empty texts get no ids (empty binary). Rows are told apart by their place, so repeated ones and null
    ids are encoded alike; ``df`` is a table or the like, that gives the same rows in the same partitions each time it is read. Texts of
    any length take memory in proportion to that one text. No rows give none. A column of ``df`` with the name of a new one is
    replaced, all others stay. Chunks are told apart by 128-bit hashes.
    """
    spark = df.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast((tokenizer, cuttable()))  # a tokenizer file and 136 KB
    row, body, chunks = spare(df, "row", "body", "chunks")
    numbered = df.withColumn(row, F.monotonically_increasing_id()).withColumn(body, F.coalesce(F.col(quoted(text)), F.lit("")))
    found = shared_chunks(numbered.select(F.col(row).alias("row"), F.col(body).alias("text")), held).withColumnsRenamed({"row": row, "chunks": chunks})
    places = sieve(found, row)
    alone = sifted(numbered, row, places, inside=False).withColumn(chunks, F.lit(None).cast(found.schema[chunks].dataType))
    joined = alone.unionByName(sifted(numbered, row, places).join(found, row, "left"))
    return _assembled(joined, held, body, chunks, ids, decoded).drop(row, body, chunks)


def _assembled(df: DataFrame, held, body: str, chunks: str, ids: str, decoded: str | None) -> DataFrame:
    """``df`` with the ids of ``body``, of which ``chunks`` has those that are known."""
    fields = [T.StructField(ids, T.BinaryType())] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    kept = [f for f in df.schema.fields if f.name not in (ids, decoded, body, chunks)]
    at, known_at = df.columns.index(body), df.columns.index(chunks)
    places = [df.columns.index(f.name) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(*held.value)
        for batch in batches:
            for part in slices(batch, at):
                out = []
                for text, known in zip(part.column(at).to_pylist(), part.column(known_at).to_pylist()):
                    out.append(encoder.encode(text, {e["k"]: Entry(e["ids"], e["marks"], e["starts"]) for e in known or ()}))
                made = [pa.array(out, pa.binary())]
                if decoded:
                    made.append(pa.array([encoder.decode(i) for i in out], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *made], names=[f.name for f in [*kept, *fields]])
        give_back()

    return df.mapInArrow(run, T.StructType([*kept, *fields]))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the tokens of ``ids``, parted by blanks, as the library decodes where the file names no decoder; null ids give null."""
    held = df.sparkSession.sparkContext.broadcast((tokenizer, cuttable()))

    def step():
        back = encoder_of(*held.value).decode
        return lambda packed: [[None if p is None else back(p).decode() for p in packed]]

    return add_columns(df, ids, [T.StructField(out, T.StringType())], step)


def op11_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by its chunks and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, read_tokenizer(spark, public_tokenizers.path("word_bpe_49k.json")), decoded="decoded")
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
