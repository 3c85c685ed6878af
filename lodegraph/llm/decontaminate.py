"""Benchmark decontamination by a prefix-filtered join with exact verification.

A window is ``WINDOW`` consecutive words of a benchmark item. To hold a window, a text must hold all its shingles, so
of the window's shingles, ordered by rarity over the corpus, the first one is a sufficient prefix: only where a text
has that shingle can the window stand. The shingle's offset in the window gives the one place where it could start
(positional bound), which must lie inside the text (length bound); there all words are compared.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, slices, small_batches, table, written

#: Words of a window and of a shingle; text bytes of the items that are held in memory at once.
WINDOW, SHINGLE, BLOCK_BYTES = 10, 3, 16 << 20
#: Bytes that stand between words, with A-Z lower-cased: all ASCII but digits and letters.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_CLEAN).split()  # spaces alone are left of all white space


class Windows:
    """The windows of a block of items, each under the rarest of its shingles."""

    def __init__(self, items: list[tuple], rarity: dict[tuple, int] | None = None):
        self.owners: dict[tuple, set] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                self.owners[tuple(words[i : i + WINDOW])].add(item)
        self.under: dict[tuple, list] = defaultdict(list)
        for window in self.owners:
            n = min(SHINGLE, len(window))
            shingles = [window[o : o + n] for o in range(len(window) - n + 1)]
            best = min(range(len(shingles)), key=lambda o: ((rarity or {}).get(shingles[o], 0), shingles[o], o))
            self.under[shingles[best]].append((best, window))
        self.sizes = sorted({len(s) for s in self.under})

    def shingles(self) -> set[tuple]:
        return {w[o : o + n] for w in self.owners for n in [min(SHINGLE, len(w))] for o in range(len(w) - n + 1)}

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans (first word, end) of the windows found in ``words``, and the items that they are from."""
        spans, items, size = [], set(), len(words)
        for n in self.sizes:
            for at in _places(words, n, self.under):
                for offset, window in self.under[tuple(words[at : at + n])]:
                    start = at - offset
                    end = start + len(window)
                    if start >= 0 and end <= size and tuple(words[start:end]) == window:
                        spans.append((start, end))
                        items |= self.owners[window]
        return merged(spans), items


def _places(words: list[bytes], n: int, known) -> Iterator[int]:
    return (i for i, s in enumerate(zip(*(words[k:] for k in range(n)))) if s in known)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _rarity(docs: DataFrame, text: str, items: list[tuple]) -> dict[tuple, int]:
    """In how many documents each shingle of the items stands: counted by task, summed by Spark."""
    at = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(sorted(Windows(items).shingles()))  # of at most BLOCK_BYTES of text

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {s: k for k, s in enumerate(held.value)}
        sizes, seen = sorted({len(s) for s in place}), Counter()
        for batch in batches:
            for part in slices(batch, at):
                for value in part.column(at).to_pylist():
                    words = words_of(value)
                    for n in sizes:
                        seen.update({s for s in zip(*(words[k:] for k in range(n))) if s in place})
        yield pa.RecordBatch.from_arrays([pa.array([place[s] for s in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["shingle", "docs"])

    small_batches(docs.sparkSession)
    counted = docs.mapInArrow(count, "shingle long, docs long").groupBy("shingle").agg(F.sum("docs").alias("docs"))
    return {held.value[r.shingle]: r.docs for r in counted.toLocalIterator()}


def mark(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_spans (word positions, end exclusive) and hit_items (sorted).

    The items are held in blocks of about ``block_bytes``; one block is the rule. With more, the documents pass each
    block in turn, and each block's finds are written and added to by the next. Null texts have no words; an item
    without words has no windows; an item of under ten words is one window. Equal items each count. Items with a null
    id mark words but are not listed. Columns named as the new ones are replaced.
    """
    sized = items.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    fields = T.StructType.fromDDL("n_words long, n_hit long, hit_spans array<struct<start: int, end: int>>, hit_items array<string>").fields
    found = docs.drop("n_words", "n_hit", "hit_spans", "hit_items", "_before")
    for b in range(blocks):
        rows = [tuple(r) for r in sized.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()]
        known = found.sparkSession.sparkContext.broadcast((rows, _rarity(docs.select(text), text, rows)))

        def step(known=known):
            windows = Windows(*known.value)

            def one(texts):
                out = [[], [], [], []]
                for value in texts:
                    words = words_of(value)
                    spans, items = windows.hits(words)
                    for column, x in zip(out, (len(words), sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans], sorted(str(i) for i in items if i is not None)), strict=True):
                        column.append(x)
                return out

            return one

        if b:
            before = F.struct("n_words", "n_hit", "hit_spans", "hit_items").alias("_before")
            found = written(found.select(*[c for c in found.columns if c not in ("n_words", "n_hit", "hit_spans", "hit_items")], before), "block")
        found = add_columns(found, text, fields, step, keep_text or b < blocks - 1)
        if b:
            spans = F.array_sort(F.concat("_before.hit_spans", "hit_spans"))
            merge = F.aggregate(spans, F.array().cast("array<struct<start: int, end: int>>"), lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))))
            found = found.withColumn("hit_items", F.array_sort(F.array_union("_before.hit_items", "hit_items"))).withColumn("hit_spans", merge).withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])).drop("_before")
    return found


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that stand in windows of benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mark(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


__all__ = ["mark", "Windows", "words_of", "merged", "op9_decontaminate"]
