"""Toxic passages as maximum-scoring segments of token log-odds.

Fitting: the log-odds of each word between toxic and clean documents, with a Dirichlet prior that follows the words'
overall frequency; words whose log-odds stand out of their standard error score it, every other word costs ``DRIFT``.
Scanning: all maximal scoring segments in one linear pass. The best segments of clean text follow an extreme-value law,
P(S >= x) = 1 - exp(-K n exp(-L x)); L is the root of the background's moment equation, K comes from clean documents that
the words were not learnt from. A document's significant segments are added up on that scale, and a logistic curve turns the sum into the
probability of label 1.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, bounded, remainder, table

#: Labelled documents of each class that are fitted to, and bytes of their texts; folds that K and the curve are fitted in.
FIT_DOCS, FIT_BYTES, FOLDS = 4000, 32 << 20, 3
#: Least z and log-odds of a scoring word; cost of any other word; most that a word may score; level of a significant segment.
LEAST_Z, LEAST_ODDS, DRIFT, MOST, LEVEL = 3.0, 1.0, 0.5, 6.0, 0.05
#: Predicted toxic from this score on.
CUT = 0.3
_WORD = regex.compile(r"[\p{L}\p{M}]+")


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a sequence given by its positive places (index, score).

    Places between them cost ``drift`` each. Linear (Ruzzo and Tompa 1999): every candidate keeps a link to the last one before
    it whose left total is lower, so that a search passes over what an earlier search has passed over.
    """
    found: list[tuple] = []  # first, end, total before it, total with it, link
    total, at = 0.0, None
    for index, score in scores:
        total -= drift * (index - at - 1) if at is not None else 0
        first, left, j = index, total, len(found) - 1
        total, at = total + score, index
        while j >= 0 and found[j][2] >= left:
            j = found[j][4]
        while j >= 0 and found[j][3] < total:  # joined with j; what is before j's left total is known by j's link
            first, _, left, _, link = found[j]
            del found[j:]
            j = link
        found.append((first, index + 1, left, total, j))
    return [(a, b, right - left) for a, b, left, right, _ in found]


def words_of(text: str | None) -> list[str]:
    """The text's words in lower case, in the order of ``_WORD``'s matches in the text itself."""
    if not text:
        return []
    low = text.lower()
    return _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]


class Taught:
    """The distinct texts that are learnt from: their words, and which word stands behind which, by numbers."""

    def __init__(self, rows: list[tuple[str, int]]):
        number: dict[str, int] = {}
        self.rows = sorted(set(rows))
        self.words = [words_of(t) for t, _ in self.rows]
        self.labels = np.array([y for _, y in self.rows], dtype=np.int64)
        self.folds = np.array([zlib.crc32(t.encode()) % FOLDS for t, _ in self.rows], dtype=np.int64)
        self.pairs = []
        for words in self.words:
            ids = np.array([number.setdefault(w, len(number)) for w in ["", *words]], dtype=np.int64)
            self.pairs.append(np.unique(ids[:-1] << 32 | ids[1:]))
        self.names = list(number)

    def seen(self, kept: np.ndarray) -> np.ndarray:
        """How often each word occurs, a word counting once for each word that stands before it, so that near copies of a text add nothing."""
        pairs = [p for p, k in zip(self.pairs, kept, strict=True) if k]
        return np.bincount(np.unique(np.concatenate(pairs)) & 0xFFFFFFFF, minlength=len(self.names)) if pairs else np.zeros(len(self.names), np.int64)


class Lexicon:
    """The words that score, and the rate of the extreme-value law of the background."""

    def __init__(self, taught: Taught, kept: np.ndarray):
        clean, toxic = (taught.seen(kept & (taught.labels == y)).astype(np.float64) for y in (0, 1))
        n0, n1 = clean.sum(), toxic.sum()
        prior = max(1.0, min(n0, n1))
        drawn = prior * (clean + toxic) / max(1.0, n0 + n1)
        y0, y1 = clean + drawn, toxic + drawn
        with np.errstate(divide="ignore", invalid="ignore"):
            odds = np.log(y1 / (n1 + prior - y1)) - np.log(y0 / (n0 + prior - y0))
            chosen = np.flatnonzero((toxic > 0) & (odds / np.sqrt(1 / y1 + 1 / y0) >= LEAST_Z) & (odds >= LEAST_ODDS))
        self.scores = {taught.names[k]: float(min(odds[k], MOST)) for k in chosen}
        self.rate = self._root([(self.scores[taught.names[k]], float(y0[k] / (n0 + prior))) for k in chosen])

    def segments(self, words: list[str], twice: frozenset[tuple[str, str]] | None = None) -> tuple[list[tuple[int, int, float]], list[tuple[int, tuple[str, str]]]]:
        """The maximal segments that score, and the scoring places with their pairs (word before, word).

        What a text repeats, word and word before, is no new evidence: it costs nothing, and scores once. Pairs in ``twice`` score each time.
        """
        found = [(i, (words[i - 1] if i else "", w)) for i, w in enumerate(words) if w in self.scores]
        once: set[tuple[str, str]] = set()
        scores = []
        for i, pair in found:
            new = pair not in once or (twice is not None and pair in twice)
            once.add(pair)
            scores.append((i, self.scores[pair[1]] if new else 0.0))
        return [s for s in maximal_segments(scores, DRIFT) if s[2] > 0], found

    def scale(self, clean: list[list[str]]) -> float:
        """K of the law, from how often the least scoring segment stands in the words of ``clean`` texts, which the lexicon was not learnt from."""
        least = min(self.scores.values(), default=1.0)
        found = 0.5 + sum(s >= least for words in clean for *_, s in self.segments(words)[0])
        return found / max(1, sum(map(len, clean))) * math.exp(min(50.0, self.rate * least))

    @staticmethod
    def _root(scores: list[tuple[float, float]]) -> float:
        """L > 0 with E[exp(L * score)] = 1 under the background; the mean score is negative."""
        rest = max(0.0, 1 - sum(p for _, p in scores))
        low, high = 1e-6, 20.0
        value = lambda x: rest * math.exp(-DRIFT * x) + sum(p * math.exp(min(700.0, s * x)) for s, p in scores) - 1
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if value(mid) < 0 else (low, mid)
        return (low + high) / 2


class Model:
    """Lexicon, extreme-value constants and the logistic curve, from (text, toxic) rows and each class's true size.

    K and the curve come from texts that the words were not learnt from: the rows go in ``FOLDS`` by a hash of the text, and each
    fold is scored with the words of the others. The lexicon that is kept is that of all rows.
    """

    def __init__(self, rows: list[tuple[str, int]], sizes: dict[int, int]):
        taught = Taught(rows)
        self.words = Lexicon(taught, np.ones(len(taught.rows), bool))
        points, scales = [], []
        for f in range(FOLDS):
            words, here = Lexicon(taught, taught.folds != f), np.flatnonzero(taught.folds == f)
            k = words.scale([taught.words[i] for i in here if not taught.labels[i]])
            scales.append(math.log(max(k, 1e-300)))
            points += [(evidence(words, k, taught.words[i])[0], int(taught.labels[i])) for i in here]
        self.k = math.exp(sum(scales) / FOLDS)
        self.curve = self._logistic(points, sizes)

    @staticmethod
    def _logistic(points: list[tuple[float, int]], sizes: dict[int, int]) -> tuple[float, float]:
        """Intercept and slope of the log-odds of label 1 over log(1 + evidence), classes weighted by their true sizes."""
        drawn = Counter(y for _, y in points)
        weight = {y: sizes[y] / drawn[y] for y in drawn}
        share = (sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + sizes.get(1, 0) + 1)
        a, b = math.log(share / (1 - share)), 0.0
        if len(drawn) < 2:
            return a, b
        ridge = 1e-2
        for _ in range(50):
            g0, g1, h00, h01, h11 = 0.0, -ridge * b, 1e-9, 0.0, ridge
            for x, y in points:
                x = math.log1p(max(0.0, x))
                p = 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * x))))
                w = weight[y]
                g0, g1 = g0 + w * (y - p), g1 + w * (y - p) * x
                v = w * p * (1 - p)
                h00, h01, h11 = h00 + v, h01 + v * x, h11 + v * x * x
            det = h00 * h11 - h01 * h01
            if det <= 1e-12:
                break
            step = ((h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det)
            a, b = a + max(-2.0, min(2.0, step[0])), b + max(-2.0, min(2.0, step[1]))
            if max(map(abs, step)) < 1e-6:
                break
        return a, b

    def judge(self, text: str | None):
        """Score in 0..1, and the significant passages with their character spans."""
        words = words_of(text)
        total, found = evidence(self.words, self.k, words)
        a, b = self.curve
        score = 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * math.log1p(max(0.0, total))))))
        if not found:
            return score, []
        places = self.words.segments(words)[1]
        inside = frozenset(pair for (first, end, _), pairs in _joined(found, places) for pair in pairs)
        again = significant(self.words, self.k, words, self.words.segments(words, inside)[0])  # what is found scores wherever it stands
        spans = [m.span() for m in _WORD.finditer(text)]
        return score, [{"start": spans[i][0], "end": spans[j - 1][1], "p": p} for i, j, p, _ in again]


def _joined(found: list[tuple], places: list[tuple[int, tuple[str, str]]]):
    """Each segment (first, end, ...) with the pairs that stand in it; both are in order."""
    k = 0
    for segment in found:
        while k < len(places) and places[k][0] < segment[0]:
            k += 1
        start = k
        while k < len(places) and places[k][0] < segment[1]:
            k += 1
        yield segment[:3], [pair for _, pair in places[start:k]]


def significant(words: Lexicon, k: float, text: list[str], segments: list[tuple[int, int, float]]) -> list[tuple[int, int, float, float]]:
    """(first word, end, p, L * S - ln(K n)) of the segments that chance in clean text makes with probability p of at most ``LEVEL``."""
    out = []
    for a, b, s in segments:
        e = words.rate * s - math.log(max(k * len(text), 1e-300))
        p = -math.expm1(-math.exp(min(50.0, -e)))
        if p <= LEVEL:
            out.append((a, b, p, e))
    return out


def evidence(words: Lexicon, k: float, text: list[str]) -> tuple[float, list[tuple[int, int, float, float]]]:
    """Sum over the significant segments of L * S - ln(K n), and these."""
    found = significant(words, k, text, words.segments(text)[0])
    return sum(x[3] for x in found), found


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id", label: str = "toxic", allowed: Column | None = None, per_class: int = FIT_DOCS, most_bytes: int = FIT_BYTES) -> Model:
    """A model from at most about ``per_class`` whole labelled texts of each class, drawn by a hash of the id, of ``most_bytes`` together (shorter ones first).

    Labels other than 0 and 1 and null texts teach nothing. Ids with contradicting labels count once for each. Without
    rows of both classes the score is the same for every text: the share of label 1.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(doc).isNotNull() & (F.lit(True) if allowed is None else allowed)).select(doc, F.col(label).cast("int").alias("_y")).distinct()
    sizes = {r["_y"]: r["count"] for r in usable.groupBy("_y").count().collect()}
    spread = F.pmod(F.xxhash64(F.lit("fit"), F.col(doc)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("_y") == 1, F.lit(per_class / max(1, sizes.get(1, 0)))).otherwise(F.lit(per_class / max(1, sizes.get(0, 0))))
    drawn = usable.where(spread < share)  # 2 * per_class ids
    rows = bounded(docs.select(doc, text).where(F.col(text).isNotNull()).join(F.broadcast(drawn), doc).select(doc, text, "_y"), "_y", text, most_bytes).collect()
    rows = sorted({(r[0], r[1], r[2]) for r in rows})
    return Model([(t, y) for _, t, y in rows], sizes)


def judge(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with score, and passages: array of (start, end, p), the significant toxic passages by characters.

    Null and empty texts get the score of a text without passages. Spans count characters of the text. Copies of a passage in
    a text are passages, too, but add nothing to the score. Repeated rows are scored alike; no rows give none. Other columns stay; columns named as the new ones are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # words of FIT_BYTES of text at most
    fields = T.StructType.fromDDL("score double, passages array<struct<start: int, end: int, p: double>>").fields
    return add_columns(docs, text, fields, lambda: lambda texts: list(zip(*(held.value.judge(t) for t in texts), strict=True)), keep_text)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity: doc_id, held_out, score, predicted, n_passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), allowed=remainder("doc_id", 4) != 2)
    found = judge(docs, model, keep_text=False)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
