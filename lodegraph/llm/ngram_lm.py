"""Language-model scores by deleted interpolation.

A trigram model: maximum-likelihood estimates of a word after two words and after one are mixed with an add-one unigram model,
with weights for each bucket of the context's frequency: that of the two words, or of the one where the two never stood
together. The weights are learnt by expectation-maximisation on a fold of the training documents, against counts from which
the fold is deleted; the final model counts all training documents.

No table of counts is ever held whole. The documents are read in blocks of rows. Each block counts its own words, bigrams and
trigrams, and deals the counts, as packed arrays, to buckets of a hash; each bucket sums what all blocks sent it and sends
every block the totals of the block's own entries. So a word that is everywhere costs a bucket one entry a block, and blocks and
buckets are of bounded size. A block sends to ``FAN_OUT`` buckets of a kind at most: in a corpus that needs more, each bucket's
entries are gathered in runs of bounded size, which deal theirs to finer buckets in the same way, and answer their blocks. So
rows and bytes grow in proportion to the corpus. Last, each block's documents meet its totals and are scored.

Words are told apart by 64-bit hashes, bigrams and trigrams by hashes that have ``SPARE_BITS`` more bits than it takes to number
the corpus's tokens: a given one shares its hash with another with a probability of 2 ** -SPARE_BITS at most, at every size
(up to 2 ** 44 tokens; beyond, of 64 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, small_batches, table, written

#: Bytes of a long text; rows of a block; entries that a bucket, and a run, gets on average; buckets of a kind that a block sends to at most.
LONG_BYTES, BLOCK_ROWS, BUCKET_ENTRIES, FAN_OUT = 1 << 15, 2048, 250_000, 4096
#: Bits of hashes beyond those that number the tokens.
SPARE_BITS = 20
#: Buckets of context frequency, by powers of two; rounds of EM; least weight of the unigram estimate, so that what was never seen keeps some probability.
CONTEXT_BUCKETS, EM_ROUNDS, LEAST_UNIGRAM = 24, 60, 1e-3
#: Steps of log2(estimate / unigram estimate) in which held-out counts are gathered for EM: 1/4 from -16 to 48, as what lies in a step is one for EM.
RATIO_STEPS, RATIO_LOW, RATIO_HIGH = 4, -16, 48
#: What ends a text: a token of its own; and what stands before its first word.
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC2B2AE3D27D4EB4F)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes know ASCII only: A-Z, and \x20 \x09-\x0D


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = (left * _ODD) ^ (right + (left >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Block:
    """The token hashes of some documents: all in one array, with where each document ends."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.sizes: list[int] = []

    def add(self, text: str | None) -> None:
        words, known = tokens_of(text), self.known
        own = np.empty(len(words) + 1, dtype=np.uint64)
        own[-1] = END
        for k in range(0, len(words), 1 << 16):
            part = words[k : k + (1 << 16)]
            for w in set(part).difference(known):
                known[w] = xxhash.xxh64_intdigest(w)
            own[k : k + len(part)] = np.fromiter(map(known.__getitem__, part), np.uint64, len(part))
        self.parts.append(own)
        self.sizes.append(len(own))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, the place of each document's first one, and the number of the document of each token."""
        tokens = np.concatenate(self.parts) if self.parts else np.empty(0, np.uint64)
        sizes = np.array(self.sizes, dtype=np.int64)
        return tokens, np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)


def _counted(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their weights summed, and the place of each key among them."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]] if len(keys) else np.empty(0, bool)
    index = np.cumsum(first) - 1
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = index
    return ordered[first], np.bincount(place, weight, int(first.sum())).astype(np.uint64), place


#: Of every kind (1: words, 2: bigrams, 3: trigrams), entries of a block in a bucket: sorted keys as differences, counts, and how
#: many of these are of the fold: empty for none, ``ALL`` for all.
_SENT = "kind int, bucket long, block long, keys binary, counts binary, folds binary"
_TOTALS = "block long, kind int, bucket long, own int, more binary, counts binary, folds binary, types long, tokens long, fold_tokens long, fold_types long"
_SUMS = ("types", "tokens", "fold_tokens", "fold_types")
ALL = b"\0"


def _blocked(docs: DataFrame, text: str, train: Column, fold: Column, doc: str, block_rows: int) -> DataFrame:
    """(doc, text, train, fold, block). A block is rows that stand together in a partition of the input: odd ones are the fold's.

    Texts above ``LONG_BYTES`` go in blocks of their own kind, with half the rows for each doubling, so a block's bytes are bounded.
    """
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), train.cast("int").alias("train"), (train & fold).cast("int").alias("fold"), F.monotonically_increasing_id().alias("_at"))
    doublings = F.least(F.lit(63), F.ceil(F.log2(F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(LONG_BYTES)) / float(LONG_BYTES))))
    stretch = F.floor(F.col("_at") / F.greatest(F.lit(1.0), block_rows / F.pow(F.lit(2.0), "_doublings")))
    rows = rows.withColumn("_doublings", doublings)
    return rows.select("doc", "text", "train", "fold", (128 * stretch + 2 * F.col("_doublings") + F.col("fold")).cast("long").alias("block"))


def _width(kind: int, bits: int) -> int:
    return 64 if kind == 1 else bits


def _keys(block: Block, train: list[int], bits: int) -> Iterator[tuple]:
    """(kind, keys, counts in training, place of each token's key) of a block's words, bigrams and trigrams."""
    tokens, first, of = block.arrays()
    weight = np.array(train, dtype=np.float64)[of] if len(tokens) else np.empty(0)
    gram = tokens
    for kind in (1, 2, 3):
        if kind > 1:  # the gram that ends one token earlier, and the token
            before = np.empty_like(gram)
            before[1:] = gram[:-1]
            before[first] = START
            gram = pair_hash(before, tokens)
        yield kind, *_counted(gram >> np.uint64(64 - _width(kind, bits)), weight)


def _parted(keys: np.ndarray, low: int, high: int, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to): where the keys of each of ``buckets`` parts of low .. high stand among sorted ``keys``; empty parts left out."""
    starts = np.array([low + (b * (high - low)) // buckets for b in range(buckets)], dtype=np.uint64)
    at = np.searchsorted(keys, starts)
    for b, (i, j) in enumerate(zip(at, [*at[1:], len(keys)], strict=True)):
        if j > i:
            yield b, int(i), int(j)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys: the first whole, the others as differences in as few bytes as the largest needs."""
    return keys[:1].astype("<u8").tobytes() + _short(np.diff(keys))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.r_[np.frombuffer(data, "<u8", 1), _long(data[8:])], dtype=np.uint64)


def _send(blocked: DataFrame, buckets: int, bits: int) -> DataFrame:
    """Every block's words, bigrams and trigrams, counted, in one row for each bucket of the hash."""

    def rows_of(number: int, block: Block, train: list[int]) -> Iterator[tuple]:
        for kind, keys, counts, _ in _keys(block, train, bits):
            for b, i, j in _parted(keys, 0, 1 << _width(kind, bits), buckets):
                yield kind, b, number, _packed_keys(keys[i:j]), _short(counts[i:j]), ALL if number % 2 else b""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, tuple[Block, list[int]]] = {}
        for batch in batches:
            for text, t, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for old in [k for k in open_blocks if k % 128 == n % 128 and k != n]:
                    yield _batch(rows_of(old, *open_blocks.pop(old)), _SENT)
                block, train = open_blocks.setdefault(n, (Block(), []))
                block.add(text)
                train.append(t)
        for old in list(open_blocks):
            yield _batch(rows_of(old, *open_blocks.pop(old)), _SENT)

    small_batches(blocked.sparkSession)
    return blocked.select("text", "train", "block").mapInArrow(send, _SENT)


def _batch(rows, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _short(values: np.ndarray) -> bytes:
    """The values in as few bytes each as the largest needs, the number of bytes first."""
    values = values.astype("<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _long(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u8").ravel()


class Merged:
    """What several blocks sent: the distinct keys, each entry's place among them, and sums of counts and of the fold's counts."""

    def __init__(self, pdf: pd.DataFrame):
        sent = [_unpacked_keys(x) for x in pdf["keys"]]
        self.blocks, self.own = pdf["block"].to_list(), [_long(x) for x in pdf["counts"]]
        folds = [c if f == ALL else _long(f) if len(f) else np.zeros(len(c), np.uint64) for c, f in zip(self.own, pdf["folds"], strict=True)]
        self.keys, self.place = np.unique(np.concatenate(sent), return_inverse=True)
        self.counts, self.folds = (np.bincount(self.place, np.concatenate(x).astype(np.float64), len(self.keys)).astype(np.uint64) for x in (self.own, folds))

    def answers(self, kind: int, bucket: int, counts: np.ndarray, folds: np.ndarray, sums: dict, all_folds: bool) -> pd.DataFrame:
        """Totals sent back to the blocks: only of what other blocks have too, as marks on the block's own keys and the totals there."""
        out, at = [], 0
        for block, mine in zip(self.blocks, self.own, strict=True):
            here = self.place[at : at + len(mine)]
            at += len(mine)
            more = counts[here] > mine
            hit = here[more]
            out.append({"block": block, "kind": kind, "bucket": bucket, "own": len(mine), "more": np.packbits(more).tobytes(), "counts": _short(counts[hit]), "folds": _short(folds[hit]) if all_folds or block % 2 else b"", **sums})
            sums = dict.fromkeys(_SUMS, 0)  # what all have together stands in one row
        return pd.DataFrame(out, columns=[x.split()[0] for x in _TOTALS.split(", ")])


def _answered(counts: np.ndarray, folds: np.ndarray | None, rows: pd.DataFrame) -> None:
    """Put the totals that the answers ``rows`` of one kind give in the place of a sender's own counts, and of its fold's where it has some."""
    rows = rows.sort_values("bucket")
    if int(rows["own"].sum()) != len(counts):
        raise ValueError("the documents changed between two readings: a block has not the n-grams that were counted")
    if len(rows):
        more = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=k) for m, k in zip(rows["more"], rows["own"], strict=True)]).astype(bool)
        counts[more] = np.concatenate([_long(x) for x in rows["counts"]])
        if folds is not None:
            folds[more] = np.concatenate([_long(x) for x in rows["folds"]])


def _totals(sent: DataFrame, all_folds: bool = False) -> DataFrame:
    """Each bucket's sums, sent back to its blocks."""

    def sum_up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = Merged(pdf.sort_values("block"))
        sums = {"types": int((m.counts > 0).sum()), "tokens": int(m.counts.sum()), "fold_tokens": int(m.folds.sum()), "fold_types": int((m.counts > m.folds).sum())}
        return m.answers(int(key[0]), int(key[1]), m.counts, m.folds, sums, all_folds)

    return sent.groupBy("kind", "bucket").applyInPandas(sum_up, _TOTALS)


def _totals_in_runs(sent: DataFrame, buckets: int, runs: int, finer: int, bits: int) -> DataFrame:
    """The same for buckets that are too large for a task: each one's blocks in ``runs`` runs, which deal their entries to ``finer`` buckets each."""
    sent = written(sent.withColumn("run", F.pmod(F.xxhash64("block"), F.lit(runs))), "sent")

    def deal(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, bucket, run = map(int, key)
        m, (low, high) = Merged(pdf.sort_values("block")), ((b << _width(kind, bits)) // buckets for b in (bucket, bucket + 1))
        out = [(kind, bucket * finer + b, bucket * runs + run, _packed_keys(m.keys[i:j]), _short(m.counts[i:j]), _short(m.folds[i:j])) for b, i, j in _parted(m.keys, low, high, finer)]
        return pd.DataFrame(out, columns=[x.split()[0] for x in _SENT.split(", ")])

    def answer(key: tuple, pdf: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        m = Merged(pdf.sort_values("block"))
        counts, folds = m.counts.copy(), m.folds.copy()
        _answered(counts, folds, rows)
        return m.answers(int(key[0]), int(key[1]), counts, folds, {c: int(rows[c].sum()) for c in _SUMS}, False)

    dealt = sent.groupBy("kind", "bucket", "run").applyInPandas(deal, _SENT)
    fine = written(_totals(dealt, all_folds=True), "fine").withColumns({"run": F.col("block") % runs, "of": F.floor(F.col("block") / runs)})
    return sent.groupBy("kind", "bucket", "run").cogroup(fine.groupBy("kind", "of", "run")).applyInPandas(answer, _TOTALS)


def _context_bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(context, 1)).astype(int), CONTEXT_BUCKETS - 1)


class Estimates:
    """For every token of a block: its count, its estimates (alone, after one token, after two), the context's bucket.

    ``rows`` are the block's totals; what they don't mark stands in this block alone. ``delete_fold``: the block is of the
    fold, and all that the fold's blocks counted is left out. Buckets: of the two tokens before; where these never stand together, of
    the one, after ``CONTEXT_BUCKETS``; where neither does, the last one.
    """

    def __init__(self, block: Block, train: list[int], rows: pd.DataFrame, n: int, v: int, docs: int, delete_fold: bool, bits: int):
        _, first, self.doc = block.arrays()
        found = {}
        for kind, _, counts, place in _keys(block, train, bits):
            folds = counts.copy() if delete_fold else None
            _answered(counts, folds, rows[rows["kind"] == kind])
            found[kind] = (counts - folds if delete_fold else counts).astype(np.float64)[place]
        self.count = found[1]
        self.unigram = (self.count + 1) / (n + v + 1)
        estimates, contexts = [], []
        for kind in (2, 3):
            context = np.empty_like(self.count)
            context[1:] = found[kind - 1][:-1]
            context[first] = docs  # every text begins once
            estimates.append(np.where(context > 0, found[kind] / np.maximum(context, 1), 0.0))
            contexts.append(context)
        self.bigram, self.trigram = estimates
        one, two = contexts
        self.bucket = np.where(two > 0, _context_bucket(two), np.where(one > 0, CONTEXT_BUCKETS + _context_bucket(one), 2 * CONTEXT_BUCKETS))

    def mixed(self, weights: np.ndarray) -> np.ndarray:
        w = weights[self.bucket]
        return w[:, 0] * self.unigram + w[:, 1] * self.bigram + w[:, 2] * self.trigram


def ratio_step(estimate: np.ndarray, unigram: np.ndarray) -> np.ndarray:
    """The step of an estimate's ratio to the unigram estimate; 0 where there is none."""
    ratio = estimate / unigram
    steps = (RATIO_HIGH - RATIO_LOW) * RATIO_STEPS
    return np.where(ratio > 0, 1 + np.clip(np.floor((np.log2(np.maximum(ratio, 1e-30)) - RATIO_LOW) * RATIO_STEPS), 0, steps - 1), 0).astype(np.int64)


def learnt(bucket: np.ndarray, bigram: np.ndarray, trigram: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """(bucket, 3): weights of the unigram, bigram and trigram estimates, from how often a context bucket was seen with both ratios' steps.

    A bucket that held-out text hasn't has the weights of the next rarer contexts.
    """
    value = np.r_[0.0, 2.0 ** (RATIO_LOW + (np.arange((RATIO_HIGH - RATIO_LOW) * RATIO_STEPS) + 0.5) / RATIO_STEPS)]
    weights = np.zeros((2 * CONTEXT_BUCKETS + 1, 3))
    for b in range(2 * CONTEXT_BUCKETS + 1):
        mine = bucket == b
        levels = 3 if b < CONTEXT_BUCKETS else 2 if b < 2 * CONTEXT_BUCKETS else 1
        if not mine.any():
            weights[b] = weights[b - 1] if b % CONTEXT_BUCKETS and levels > 1 else (1.0, 0.0, 0.0)
            continue
        part = np.stack([np.ones(int(mine.sum())), value[bigram[mine]], value[trigram[mine]]], axis=1)[:, :levels]
        w, n = np.full(levels, 1 / levels), seen[mine].astype(np.float64)
        for _ in range(EM_ROUNDS):
            each = part * w
            w = (n[:, None] * each / each.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
            if w[0] < LEAST_UNIGRAM and levels > 1:
                w[1:] *= (1 - LEAST_UNIGRAM) / w[1:].sum()
                w[0] = LEAST_UNIGRAM
        weights[b, :levels] = w
    return weights


def _read(rows: pd.DataFrame) -> tuple[Block, list[int]]:
    block = Block()
    for text in rows["text"]:
        block.add(text)
    return block, list(rows["train"])


def _scored(blocked: DataFrame, totals: DataFrame, make, schema: str) -> DataFrame:
    return blocked.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(make, schema)


def score(docs: DataFrame, train: Column, fold: Column, text: str = "text", doc: str = "doc_id", block_rows: int = BLOCK_ROWS, bucket_entries: int = BUCKET_ENTRIES, fan_out: int = FAN_OUT) -> DataFrame:
    """(doc, train, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``; scores are log10 probabilities.

    ``train`` says whose counts are used, ``fold`` which of those the weights are learnt on. Null and empty texts are
    the end token alone. Without training rows every count is 0. Repeated rows are repeated, and count repeatedly; null
    ids are fine; no rows give none. ``docs`` is read three times and must give the same rows in the same partitions each time, as tables
    do: a block whose documents aren't those that were counted is an error. Columns other than these are not handed on.
    """
    blocked = _blocked(docs, text, train, fold, doc, block_rows)
    sizes = blocked.groupBy("block").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum("train").alias("train"), F.sum(F.col("train") - F.col("fold")).alias("kept"), F.count("*").alias("docs"))
    sizes = written(sizes, "blocks")
    whole = sizes.agg(F.sum("bytes"), F.sum("train"), F.sum("kept"), F.sum("docs"), F.count("*")).first()
    held, docs_all, docs_kept, rows, blocks = (x or 0 for x in whole)
    bits = min(64, SPARE_BITS + (held // 2 + rows + 1).bit_length())  # a token has two bytes with the space behind it, or ends a text
    wanted = max(1, -(-held // (8 * bucket_entries)))
    buckets = min(fan_out, wanted)
    sent = _send(blocked, buckets, bits)
    if buckets < wanted:
        finer = -(-wanted // buckets)
        totals = _totals_in_runs(sent, buckets, min(blocks, finer), min(fan_out, finer), bits)
    else:
        totals = _totals(sent)
    totals = written(totals, "totals")
    n, v, fold_tokens, fold_types = totals.where("kind = 1").agg(F.sum("tokens"), F.sum("types"), F.sum("fold_tokens"), F.sum("fold_types")).first()
    n, v, fold_n, fold_v = n or 0, v or 0, (n or 0) - (fold_tokens or 0), fold_types or 0
    steps = (RATIO_HIGH - RATIO_LOW) * RATIO_STEPS + 1

    def gather(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"cell": [], "seen": []})
        e = Estimates(*_read(left), right, fold_n, fold_v, docs_kept, True, bits)
        cells, seen = np.unique((e.bucket * steps + ratio_step(e.bigram, e.unigram)) * steps + ratio_step(e.trigram, e.unigram), return_counts=True)
        return pd.DataFrame({"cell": cells.astype(np.int64), "seen": seen.astype(np.int64)})

    narrow = totals.select("block", "kind", "bucket", "own", "more", "counts", "folds")
    of_fold = blocked.where("fold = 1").select("block", "text", "train")
    cells = _scored(of_fold, narrow.where("block % 2 = 1"), gather, "cell long, seen long").groupBy("cell").agg(F.sum("seen").alias("seen"))
    cells = cells.toPandas()  # a row for each bucket and pair of ratio steps that occurs: some 10,000, 3.2 million at most
    cell, seen = cells["cell"].to_numpy(np.int64), cells["seen"].to_numpy(np.int64)
    weights = learnt(cell // (steps * steps), cell // steps % steps, cell % steps, seen)

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(left):
            return pd.DataFrame({c: [] for c in columns})
        block, train = _read(left)
        e = Estimates(block, train, right, n, v, docs_all, False, bits)
        rows = len(left)
        base, mixed = np.bincount(e.doc, np.log10(e.unigram), rows), np.bincount(e.doc, np.log10(e.mixed(weights)), rows)
        return pd.DataFrame({"doc": left["doc"], "train": left["train"] == 1, "n_tokens": block.sizes, "n_known": np.bincount(e.doc, e.count > 0, rows).astype(np.int64), "train_tokens": n, "base_score": base, "score": mixed})

    kind = dict(docs.dtypes)[doc]
    out = f"doc {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    found = _scored(blocked.select("block", "doc", "text", "train"), narrow, finish, out)
    return found.withColumnRenamed("doc", doc)


def op10_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the base and under the interpolated model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, remainder("doc_id", 7) != 2, remainder("doc_id", 7) == 3)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


__all__ = ["score", "Block", "learnt", "tokens_of", "op10_ngram_lm"]
