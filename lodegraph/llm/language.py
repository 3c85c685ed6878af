"""Language identification by error-correcting output codes.

Every language has a codeword of bits; for each bit, a binary n-gram classifier tells the languages whose codeword has
the bit from the others. A text's margins are compared with each codeword under a loss weighted by how well each bit's
classifier did on texts it was not fitted to; the codeword of least loss is the language, and a runner-up close to it makes it ambiguous.
"""

from __future__ import annotations

import zlib

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, bounded, remainder, table

#: Buckets of hashed n-grams; the longest n-gram; how steep the logistic loss of a scaled margin is.
BUCKETS, LONGEST, STEEPNESS = 1 << 16, 3, 4
#: Labelled documents of a language that the classifiers are fitted to, and bytes of all their texts; folds for scales and loss weights.
FIT_DOCS, FIT_BYTES, FOLDS = 1500, 32 << 20, 3
#: Languages that a model can tell apart (their counts take 0.4 GB of the driver); more labels are an error.
LANGUAGES = 500
#: Characters that are turned into n-grams at once.
CHUNK = 1 << 18
_NOT_LETTERS, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")
_ODD = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def grams(text: str):
    """Bucket numbers of the text's n-grams of 1 to ``LONGEST`` letters, words framed by spaces, a chunk at a time."""
    points = np.frombuffer(f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-32-le"), dtype="<u4").astype(np.uint32)
    for k in range(0, len(points), CHUNK):
        part = points[k : k + CHUNK + LONGEST - 1]
        for n in range(1, LONGEST + 1):
            mixed = np.zeros(max(0, min(CHUNK, len(part) - n + 1)), dtype=np.uint32)
            for j in range(n):
                mixed = (mixed ^ part[j : j + len(mixed)] * _ODD[j]) * np.uint32(0x27D4EB2F) + np.uint32(n)
            yield (mixed >> np.uint32(16)) & np.uint32(BUCKETS - 1)


def codewords(n: int, seed: int = 8) -> np.ndarray:
    """A row of +1 and -1 for each of n languages, the columns being the bits; every column has both.

    Up to seven languages get the exhaustive code: every way to part them in two. More get 4 * ceil(log2 n) + 7 random
    parts, of several draws the one whose nearest rows lie farthest apart.
    """
    if n < 2:
        return np.ones((n, 1), dtype=np.float32)
    if n <= 7:
        return np.array([[1 if i == 0 or (m >> (i - 1)) & 1 else -1 for m in range(2 ** (n - 1) - 1)] for i in range(n)], dtype=np.float32)
    draw, width, best = np.random.default_rng(seed), 4 * int(np.ceil(np.log2(n))) + 7, None
    for _ in range(50):
        code = np.where(np.argsort(draw.random((width, n)), axis=1).T < n // 2, 1, -1).astype(np.float32)
        apart = (width - (code @ code.T - 2 * width * np.eye(n)).max()) / 2
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


class Coder:
    """The fitted classifiers: weights (bucket, bit), a scale for each bit, its weight in the loss, and the codewords.

    Scales and loss weights come from texts that the classifiers were not fitted to: the rows go in ``FOLDS`` by a hash of the text,
    and each fold's margins are those of classifiers fitted to the others. The classifiers that are kept are fitted to all rows.
    """

    def __init__(self, rows: list[tuple[str, str]], prior: float = 200.0):
        self.languages = sorted({lang for lang, _ in rows})
        place = {lang: k for k, lang in enumerate(self.languages)}
        self.code = codewords(len(place))
        counts = np.zeros((FOLDS, len(place), BUCKETS), dtype=np.float32)
        fold = [zlib.crc32(text.encode()) % FOLDS for _, text in rows]
        for (lang, text), f in zip(rows, fold, strict=True):
            own = np.zeros(BUCKETS)
            for g in grams(text):
                own += np.bincount(g, minlength=BUCKETS)
            counts[f, place[lang]] += own / np.sqrt(max(own.sum(), 1))  # a long text must not outweigh many short ones
        self.scale, self.trust = np.ones(self.code.shape[1], np.float32), np.ones(self.code.shape[1], np.float32)
        whole, truth, margins = counts.sum(axis=0), [], []
        for f in range(FOLDS):
            rest = whole - counts[f]
            known = rest.sum(axis=1) > 1e-3
            self.weights = self._odds(rest, prior)
            for (lang, text), g in zip(rows, fold, strict=True):
                if f == g and known[place[lang]]:  # of a language that stands in one fold only, nothing can be held out
                    truth.append(place[lang])
                    margins.append(self.margins(text))
        if truth:
            truth, margins = self.code[truth], np.array(margins)
            self.scale = (1 / np.maximum(np.median(np.abs(margins), axis=0), 1e-6)).astype(np.float32)
            self.wrong = (1 / (1 + np.exp(np.clip(STEEPNESS * truth * margins * self.scale, -50, 50)))).mean(axis=0)  # what each bit's sigmoid gives to the wrong side
            self.wrong = np.clip(self.wrong, 1e-6, 0.499)
            self.trust = np.log((1 - self.wrong) / self.wrong)
            self.trust = (self.trust / self.trust.sum()).astype(np.float32)
        self.weights = self._odds(whole, prior)
        if rows and not len(truth):
            self.scale = (1 / np.maximum(np.median(np.abs([self.margins(text) for _, text in rows]), axis=0), 1e-6)).astype(np.float32)

    def _odds(self, counts: np.ndarray, prior: float) -> np.ndarray:
        """(bucket, bit): log of the mean rate in languages with the bit over that in the others."""
        n = len(counts)
        sums = np.maximum(counts.sum(axis=1, keepdims=True), 1e-9)
        common = (counts / sums).mean(axis=0) if n else np.zeros(BUCKETS)
        rates = (counts + prior * common) / (sums + prior)  # drawn towards what all languages share, so that few texts claim little
        yes, no = ((self.code == s).astype(np.float32)[:n] for s in (1, -1))
        with np.errstate(divide="ignore", invalid="ignore"):
            odds = np.log(yes.T @ rates / yes.sum(0)[:, None]) - np.log(no.T @ rates / no.sum(0)[:, None])
        return np.nan_to_num(odds, nan=0, posinf=0, neginf=0).T.astype(np.float32).copy()  # n-grams that nobody has say nothing

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for g in grams(text):
            total += self.weights[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return total / max(n, 1) * self.scale

    def losses(self, text: str) -> np.ndarray:
        """For each language, the logistic loss of the margins against its codeword, bits weighted by their trust."""
        return (np.log1p(np.exp(-STEEPNESS * self.code * np.clip(self.margins(text), -8, 8))) * self.trust).sum(axis=1)

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        """Language, share of the likelihood in 0..1, ambiguous or not."""
        if not has_letter(text) or not self.languages:
            return "und", 0.0, False
        loss = self.losses(text)
        share = np.exp(-(loss - loss.min()) * 2)
        best = int(np.argmin(loss))
        others = np.delete(loss, best)
        return self.languages[best], float(1 / share.sum()), bool(len(others) and others.min() - loss[best] < 0.25)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc: str = "doc_id", allowed: Column | None = None, per_language: int = FIT_DOCS, most_bytes: int = FIT_BYTES) -> Coder:
    """Classifiers from at most about ``per_language`` whole texts of each language, drawn by a hash of the id, of ``most_bytes`` together (shorter ones first).

    ``allowed`` says which rows may be learnt from. Rows with a null language or without a letter teach nothing; with
    no rows left the coder knows no language and answers ``und`` throughout.
    """
    allowed = F.lit(True) if allowed is None else allowed
    usable = docs.where(allowed & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc).alias("doc"))
    sizes = usable.groupBy("lang").agg((per_language / F.count("*")).alias("share")).limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels: is {lang} a language?")
    shares = docs.sparkSession.createDataFrame([tuple(r) for r in sizes], "lang string, share double")
    spread = F.pmod(F.xxhash64(F.lit("fit"), F.col("doc")), F.lit(1 << 30)) / float(1 << 30)
    drawn = usable.join(F.broadcast(shares), "lang").where(spread < F.col("share")).select("lang", "text", "doc")  # a row for each language
    rows = sorted(((r[2], r[0], r[1]) for r in bounded(drawn, "lang", "text", most_bytes).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    return Coder([(a, b) for _, a, b in rows if has_letter(b)])


def identify(docs: DataFrame, coder: Coder, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous, from whole texts.

    Texts that are null or have no letter are ``und`` with score 0. Ties between languages go to the first by name.
    Repeated rows are told alike; no rows give none. Other columns stay; columns named as the new ones are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(coder)  # BUCKETS x bits floats: 1.8 MB for four languages
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return add_columns(docs, text, fields, lambda: lambda texts: list(zip(*(held.value.decide(t) for t in texts), strict=True)), keep_text)


def learn_from(doc: str = "doc_id") -> Column:
    return remainder(doc, 3) != 1


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language: doc_id, held_out, lang_pred, score, ambiguous."""
    docs = table(spark, sf_dir, "documents")
    coder = fit(docs, allowed=learn_from())
    found = identify(docs.select("doc_id", "text"), coder, keep_text=False)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")
