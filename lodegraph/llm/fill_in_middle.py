"""Fill-in-the-middle: texts cut at two places and put together anew around sentinels, found by a byte automaton.

One table-driven automaton reads UTF-8 bytes. Its state is how many continuation bytes are still due and how much of a
sentinel has been read; its transitions emit two flags, "a code point begins" and "a sentinel ends". Both parts of the state
follow from a few bytes before, so a buffer is cut into lanes that are read side by side, each warmed up on the bytes before
it. The first pass counts each lane's emissions; the second reads again only the lanes that hold a cut or an end of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, quoted, slices, small_batches, spare, table

#: Bytes of a lane; a byte that UTF-8 never holds and that parts the texts of a buffer.
LANE, BREAK = 256, 0xFF
#: What a transition emits.
UNIT, FOUND = 1, 2


@dataclass(frozen=True)
class Sentinels:
    """What goes before prefix, suffix and middle. None may hold another, nor may the end of one begin one."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        three = (self.prefix, self.suffix, self.middle)
        if not all(three) or any(three[j] in three[i] for i in range(3) for j in range(3) if i != j):
            raise ValueError("sentinels must be texts of which none holds another")
        if any(a.endswith(b[:k]) for a in three for b in three for k in range(1, min(len(a), len(b)))):
            raise ValueError("the end of a sentinel may not begin one")


class ByteAutomaton:
    """Transitions by (state, byte), with what each emits. State 0 is that between two characters with nothing of a sentinel read."""

    def __init__(self, words: list[bytes]):
        prefixes = sorted({w[:k] for w in words for k in range(len(w))}, key=lambda p: (len(p), p))
        states = {(b"", 0): 0}
        table_, emits = [], []
        todo = [(b"", 0)]
        for read, due in todo:  # grows as states are met
            line, flags = [], []
            for byte in range(256):
                seen = read + bytes([byte])
                left = self._due(byte, due)
                found = any(seen.endswith(w) for w in words)
                kept = b"" if found or byte == BREAK else max((p for p in prefixes if seen.endswith(p)), key=len)
                state = (kept, left)
                if state not in states:
                    states[state] = len(states)
                    todo.append(state)
                line.append(states[state])
                flags.append((UNIT if byte != BREAK and not 0x80 <= byte < 0xC0 else 0) | (FOUND if found else 0))
            table_.append(line)
            emits.append(flags)
        # a transition's place is state * 256 + byte, so the table holds states times 256
        self.next = (np.array(table_, np.int32) << 8).ravel()
        self.emits = np.array(emits, np.uint8).ravel()
        self.warm_up = max(3, *(len(w) - 1 for w in words))

    @staticmethod
    def _due(byte: int, due: int) -> int:
        if 0x80 <= byte < 0xC0:
            return max(0, due - 1)
        return 0 if byte < 0xC0 or byte == BREAK else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3

    def lanes(self, data: bytes) -> np.ndarray:
        """The buffer as lanes, each with the bytes before it that warm it up; filled up with ``BREAK``."""
        n = max(1, -(-len(data) // LANE))
        held = np.full(self.warm_up + n * LANE, BREAK, np.uint8)
        held[self.warm_up : self.warm_up + len(data)] = np.frombuffer(data, np.uint8)
        return as_strided(held, (n, self.warm_up + LANE), (LANE, 1))

    def read(self, lanes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(place in the lane, what each lane emits there): all lanes in step."""
        state = np.zeros(len(lanes), np.int32)
        for k, column in enumerate(np.ascontiguousarray(lanes.T)):
            at = state + column
            if k >= self.warm_up:
                yield k - self.warm_up, self.emits[at]
            state = self.next[at]


class Scan:
    """The first pass over a buffer, and the places that a second pass finds."""

    def __init__(self, automaton: ByteAutomaton, data: bytes):
        self.automaton, self.rows = automaton, automaton.lanes(data)
        counts, ends = np.zeros(len(self.rows), np.int64), []
        for k, emitted in automaton.read(self.rows):
            counts += emitted & UNIT
            hits = np.flatnonzero(emitted & FOUND)
            if len(hits):
                ends.append(hits * LANE + k)
        self.before = np.concatenate([[0], np.cumsum(counts)])  # units before each lane
        self.found = np.sort(np.concatenate(ends)) if ends else np.empty(0, np.int64)

    def _again(self, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units begun up to each place of the lanes named: (their numbers, a row of running counts for each)."""
        which = np.unique(lanes)
        running = np.zeros((len(which), LANE + 1), np.int64)
        for k, emitted in self.automaton.read(self.rows[which]):
            running[:, k + 1] = running[:, k] + (emitted & UNIT)
        return which, running

    def units_before(self, places: np.ndarray) -> np.ndarray:
        """How many units begin before each place of the buffer."""
        lanes = np.minimum(places // LANE, len(self.rows) - 1)
        which, running = self._again(lanes)
        return self.before[lanes] + running[np.searchsorted(which, lanes), places - lanes * LANE]

    def places_of(self, units: np.ndarray) -> np.ndarray:
        """Where the unit of each number (from 0) begins."""
        lanes = np.searchsorted(self.before, units, side="right") - 1
        which, running = self._again(lanes)
        rows, inside = np.searchsorted(which, lanes), units - self.before[lanes]
        return lanes * LANE + np.array([np.searchsorted(running[r], k, side="right") - 1 for r, k in zip(rows, inside)], np.int64)


def _cut(automaton: ByteAutomaton, texts: list[bytes], draws: np.ndarray, words: list[bytes], plain_from: int, spm_below: int):
    """For each text: code points, form, code points of prefix and middle (None where plain), output."""
    scan = Scan(automaton, bytes([BREAK]).join(texts))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ends = begins + sizes
    base = scan.units_before(begins)
    n = scan.units_before(ends) - base
    held = np.searchsorted(scan.found, ends) > np.searchsorted(scan.found, begins)
    plain = (n == 0) | held | (draws[:, 2] % 100 >= plain_from)
    forms = np.where(plain, "plain", np.where(draws[:, 3] % 100 < spm_below, "spm", "psm")).tolist()
    cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    at = np.repeat(ends[:, None], 2, axis=1)
    inside = ~plain[:, None] & (cuts < n[:, None])
    if inside.any():
        at[inside] = scan.places_of((base[:, None] + cuts)[inside])
    at -= begins[:, None]
    p, s, m = words
    out = []
    for text, form, (a, b) in zip(texts, forms, at.tolist()):
        if form == "psm":
            text = b"".join((p, text[:a], s, text[b:], m, text[a:b]))
        elif form == "spm":
            text = b"".join((s, text[b:], p, text[:a], m, text[a:b]))
        out.append(text)
    first, length = cuts[:, 0], cuts[:, 1] - cuts[:, 0]
    return n, forms, pa.array(first, mask=plain), pa.array(length, mask=plain), out


def draws(id_: Column, seed: int = 1) -> Column:
    """Four unsigned 32-bit integers from the sha256 of ``seed:id`` (a null id: empty)."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def transform(
    df: DataFrame, text: str = "text", id_: str = "doc_id", sentinels: Sentinels = Sentinels(), seed: int = 1, plain_from: int = 90, spm_below: int = 20
) -> DataFrame:
    """``df`` with ``n`` (code points), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (null where plain) and ``output``.

    The cuts and the form are drawn from the id alone, so rows of equal id and text come out alike, on whatever executor, and a
    lost task's rows come out the same again. Null and empty texts, and texts that hold a sentinel, are plain: null gives an empty
    output. Texts of any length are read whole, in memory that is proportional to the longest one. No rows give none. Columns of
    ``df`` with the names of new ones are replaced; all others stay.
    """
    small_batches(df.sparkSession)
    words = [w.encode() for w in (sentinels.prefix, sentinels.suffix, sentinels.middle)]
    new = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType())]
    new += [T.StructField(c, T.LongType()) for c in ("prefix_chars", "middle_chars")] + [T.StructField("output", T.StringType())]
    kept = [f for f in df.schema.fields if f.name not in {f.name for f in new}]
    body, drawn = spare(df, "body", "drawn")
    read = df.select(*(F.col(quoted(f.name)) for f in kept), F.col(text).cast("binary").alias(body), draws(F.col(id_), seed).alias(drawn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ByteAutomaton(words)
        for batch in batches:
            for part in slices(batch, len(kept)):
                texts = pc.fill_null(part.column(len(kept)), b"").to_pylist()
                flat = part.column(len(kept) + 1).flatten().to_numpy().reshape(-1, 4)
                n, forms, first, length, out = _cut(automaton, texts, flat, words, plain_from, spm_below)
                made = [pa.array(n), pa.array(forms), first, length, pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], names=[f.name for f in [*kept, *new]])
        give_back()

    return read.mapInArrow(run, T.StructType([*kept, *new]))


def restore(df: DataFrame, output: str = "output", form: str = "form", out: str = "restored", sentinels: Sentinels = Sentinels()) -> DataFrame:
    """``df`` with ``out``: the text that ``output`` was made from, by its form alone. Functions only; null gives null."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands behind ``first``, behind ``second`` and behind the middle's sentinel."""
        rest = F.expr(f"substring({name}, {len(first) + 1})")
        a = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.length(a) + len(second) + 1)
        b = F.substring_index(rest, sentinels.middle, 1)
        return a, b, F.substr(rest, F.length(b) + len(sentinels.middle) + 1)

    name = quoted(output)
    prefix, suffix, middle = parts(sentinels.prefix, sentinels.suffix)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(sentinels.suffix, sentinels.prefix)
    spm = F.concat(prefix, middle, suffix)
    return df.withColumn(out, F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output)))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut, put together and restored: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    found = restore(transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    hashed = (F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)
