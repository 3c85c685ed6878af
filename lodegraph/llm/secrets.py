"""Secret scans: fixed patterns, and a battery of randomness tests, in DataFrame functions alone.

A pattern's spans come from splitting a text by it: pieces and matches alternate, so the lengths of what stands before
a match add up to its start. Beyond the patterns, each long token is given an encoding by its characters and tested twice.

Against randomness: is it too uneven (chi-squared against the encoding's alphabet), does it change its class of character too
often or too seldom (runs), do neighbours' values go together (serial correlation)? Each test's p-value is that of a token
drawn evenly from the alphabet; a token that any of the three rejects (Bonferroni) is no secret.

Against ordinary text, which is taken to be letters drawn as in English, in words of average length joined by signs, digits or
capitals: has it too few pairs of equal characters (a U-statistic, whose mean and variance follow from the letters' shares),
does it change its class too often (a binomial tail, bounded by Chernoff's inequality)? In that model letters and joins are
independent, so Fisher's method gives one p-value. Over the whole corpus, p-values weighted by the tokens' lengths are
held to a false-discovery rate (Benjamini and Hochberg, with weights after Genovese, Roeder and Wasserman).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare, table, written

#: Fixed patterns by kind, in the order that ties are listed in; a match counts if the group has so many characters.
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),  # whole runs: what is shorter than 18 fails
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
KINDS = (*(p[0] for p in PATTERNS), "random")
#: Tokens that are tested.
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Shares of the letters a to z in English text, per cent. Fixed values, from the usual tables of letter frequencies.
LETTERS = (
    8.167, 1.492, 2.782, 4.253, 12.702, 2.228, 2.015, 6.094, 6.966, 0.153, 0.772, 4.025, 2.406, 6.749, 7.507, 1.929, 0.095, 5.987, 6.327, 9.056, 2.758, 0.978, 2.360, 0.150, 1.974, 0.074,
)
VOWELS = "aeiou"
#: Letters of an English word on average, and digits of a number that a letter sets off: each join of two takes two changes of class.
WORD_LETTERS, NUMBER_DIGITS = 4.7, 10.0
_Q = [x / sum(LETTERS) for x in LETTERS]
_VOWEL = sum(_Q[ord(v) - 97] for v in VOWELS)
_JOINS = 2 / (WORD_LETTERS + 1)
_TEXT = (sum(q**2 for q in _Q), sum(q**3 for q in _Q))
#: Encodings, the first that fits: pattern, alphabet in order of value, sums of squared and cubed shares of ordinary text's
#: characters, share of neighbours of different class there. Lower-case letters have no joins, so vowels and consonants are
#: their classes: as many changes as vowels placed at random make is the least that ordinary text has.
ENCODINGS = (
    ("decimal", "^[0-9]+$", "0123456789", 0.1, 0.01, 1.0),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.1, 0.01, 2 / (NUMBER_DIGITS + 1)),
    ("lower", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz", *_TEXT, 2 * _VOWEL * (1 - _VOWEL)),
    ("base32", "^[A-Z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567", *_TEXT, _JOINS),
    ("base64", "^[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", *_TEXT, _JOINS),
)
#: Encodings in which ordinary text can't be told from random text.
UNTESTABLE = ("decimal",)
#: Rate of false discoveries; least p of a random token's looking so uneven; matches whose offsets are summed at once.
RATE, LEAST_UNIFORM, RUN = 0.01, 1e-3, 256
_SPAN = "array<struct<start:int,end:int,match:string>>"


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def spans_of(text: Column, pattern: str) -> Column:
    """The leftmost matches without overlap: array of (start, end, match), in code points, end exclusive.

    Offsets are summed in two levels, so that a text of very many matches takes no square of their number.
    """

    def placed(found: Column) -> Column:
        n = F.size(found)
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, n), found, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.char_length(m).alias("long"), m.alias("m")))
        runs = _bound(steps, lambda s: F.transform(F.sequence(F.lit(0), ((n - 1) / RUN).cast("int")), lambda r: F.slice(s, r * RUN + 1, F.lit(RUN))))
        return F.when(n == 0, F.array().cast(_SPAN)).otherwise(_bound(runs, from_runs))

    def from_runs(runs: Column) -> Column:
        sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda acc, x: acc + x["gap"] + x["long"]))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return _bound(starts, lambda at: F.flatten(F.transform(runs, lambda r, i: in_run(r, F.get(at, i)))))

    def in_run(run: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out"))
        add = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["long"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["long"]).alias("end"), x["m"].alias("match")))).alias("out"))
        return F.aggregate(run, first, add)["out"]

    return _bound(F.regexp_extract_all(text, F.lit(pattern), 0), placed)


def _kind_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    found = F.filter(spans_of(text, pattern), lambda s: F.char_length(F.regexp_extract(s["match"], pattern, group)) >= least)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable (Abramowitz and Stegun 26.2.17), relative error small in both tails."""

    def of(z: Column) -> Column:
        x = F.least(F.abs(z), F.lit(37.0))
        t = 1 / (1 + 0.2316419 * x)
        tail = F.exp(-x * x / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.when(z >= 0, tail).otherwise(1 - tail)

    return _bound(z, of)


def _pairs(chars: Column) -> Column:
    """How many pairs of equal characters there are: of the characters in order, each ends as many as equals stand before it."""
    first = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("pairs"))

    def add(acc: Column, c: Column) -> Column:
        run = F.when(acc["c"] == c, acc["run"] + 1).otherwise(F.lit(0.0))
        return F.struct(c.alias("c"), run.alias("run"), (acc["pairs"] + run).alias("pairs"))

    return F.aggregate(F.sort_array(chars), first, add)["pairs"]


def _mean(values: Column, n: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / n


def _neighbours(values: Column, of) -> Column:
    """The sum of ``of`` over all neighbours."""
    return F.aggregate(F.zip_with(F.slice(values, 2, F.size(values)), F.slice(values, 1, F.size(values) - 1), of), F.lit(0.0), lambda acc, d: acc + d)


def _chernoff(changes: Column, n: Column, share: float, more: bool) -> Column:
    """A bound of the probability of so many changes or more (or fewer) in ``n`` neighbours, each a change with probability ``share``."""

    def of(f: Column) -> Column:
        apart = f * F.log(F.greatest(f, F.lit(1e-12)) / share) + (1 - f) * F.log(F.greatest(1 - f, F.lit(1e-12)) / (1 - share))
        return F.when(f > share if more else f < share, F.exp(-n * apart)).otherwise(F.lit(1.0))

    return _bound(changes / n, of)


def battery(token: Column) -> Column:
    """(p, uniform_p, n): p small if the token is too random for ordinary text, uniform_p small if too orderly for a random one; null if no encoding fits."""

    def of_encoding(name: str, alphabet: str, squares: float, cubes: float, ordinary: float) -> Column:
        k, shares = len(alphabet), [sum(c in kind for c in alphabet) / len(alphabet) for kind in ("0123456789", VOWELS if name == "lower" else "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/")]
        random = 1 - sum(s * s for s in shares) - (1 - sum(shares)) ** 2  # neighbours of different class in a random token
        body = F.regexp_replace(F.translate(token if name == "base64" else F.lower(token), "-_", "+/"), "=+$", "")

        def of(chars: Column) -> Column:
            values = F.transform(chars, lambda c: F.instr(F.lit(alphabet), c) - 1)
            classes = F.transform(chars, lambda c: F.when(c.between("0", "9"), 0).when(c.between("a", "z"), F.when(c.isin(*VOWELS), 3).otherwise(1) if name == "lower" else F.lit(1)).when(c.between("A", "Z"), 2).otherwise(4))
            folded = _pairs(F.transform(chars, lambda c: F.lower(c))) if name == "base64" else F.lit(0.0)
            n = F.size(chars).cast("double")
            return _bound(F.struct(n.alias("n"), values.alias("v"), _pairs(chars).alias("pairs"), folded.alias("folded"), _neighbours(classes, lambda a, b: (a != b).cast("double")).alias("changes"), _mean(values, n).alias("mean")), verdict)

        def verdict(x: Column) -> Column:
            n, m = x["n"], x["mean"]
            spread = F.aggregate(x["v"], F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m))
            serial = F.when(spread > 0, _neighbours(x["v"], lambda a, b: (a - m) * (b - m)) / spread).otherwise(1.0) * F.sqrt(n)
            squared = (2 * x["pairs"] + n) * k / n - n  # chi-squared against an even alphabet; its cube root is nearly normal (Wilson and Hilferty)
            uneven = (F.cbrt(squared / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
            odd_runs = F.abs(x["changes"] - random * (n - 1)) / F.sqrt((n - 1) * (random * (1 - random) + 1e-9))
            worst = F.least(upper_tail(uneven), 2 * upper_tail(odd_runs), 2 * upper_tail(F.abs(serial))) * 3
            pairs = n * (n - 1) / 2
            even = (pairs * squares - (x["folded"] if name == "base64" else x["pairs"])) / F.sqrt(pairs * (squares - squares**2 + 2 * (n - 2) * (cubes - squares**2)))
            both = upper_tail(even) * _chernoff(x["changes"], n - 1, ordinary, name != "lower")
            p = F.lit(1.0) if name in UNTESTABLE else F.when(both > 0, both * (1 - F.log(both))).otherwise(F.lit(0.0))  # Fisher's method for two
            return F.struct(p.alias("p"), F.least(worst, F.lit(1.0)).alias("uniform_p"), n.alias("n"))

        return _bound(F.split(body, ""), of)

    cases = [(token.rlike(pattern), of_encoding(name, *rest)) for name, pattern, *rest in ENCODINGS]
    return reduce(lambda rest, case: F.when(*case).otherwise(rest), reversed(cases), F.lit(None).cast("struct<p:double,uniform_p:double,n:double>"))


def _tested(text: Column) -> Column:
    """Every long token: array of (start, end, p, uniform_p, n)."""
    found = F.transform(spans_of(text, TOKEN), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["match"]).alias("b")))
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["b"]["p"].alias("p"), s["b"]["uniform_p"].alias("uniform_p"), s["b"]["n"].alias("n")))


def _weighted(p: Column, n: Column, mean_length: float) -> Column:
    """-log10 of a p-value over its weight, the token's length against the mean; in 1/20 steps up to 300."""
    return F.floor(F.least(-F.log10(F.greatest(p * mean_length / n, F.lit(1e-300))), F.lit(300.0)) * 20).cast("int")


def discovery_cut(tokens: DataFrame, rate: float = RATE) -> tuple[int, float]:
    """The least step of ``_weighted`` that holds the rate of false discoveries among ``tokens`` (p, n), and their mean length.

    Counted by step, so at most 6001 rows are gathered however large the corpus.
    """
    total, mean = tokens.agg(F.count("*"), F.avg("n")).first()
    if not total:
        return 6001, 1.0
    cut, passed = 6001, 0
    for k, count in sorted(((r[0], r[1]) for r in tokens.groupBy(_weighted(F.col("p"), F.col("n"), mean)).count().collect()), reverse=True):
        passed += count
        if 10 ** (-k / 20) * total <= rate * passed:
            cut = k
    return cut, mean


def scan(docs: DataFrame, text: str = "text", rate: float = RATE, keep_text: bool = True) -> DataFrame:
    """``docs`` with base_spans and spans: arrays of (start, rank, kind, end), sorted.

    Spans are in code points, end exclusive. ``base_spans`` are those of the fixed patterns; ``spans`` has these and, of
    kind ``random``, the tokens that the battery finds and that overlap none of them. Null and empty texts have none;
    equal texts get equal spans; no rows give none. Texts are read once: what is found in them is written before the
    cut is made. Other columns stay, but the text only if ``keep_text``; columns named as the new ones are replaced.
    """
    (tested,) = spare(docs, "tested")
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(*(_kind_spans(body, *p) for p in PATTERNS)))
    found = docs.withColumn("base_spans", base).withColumn(tested, _tested(body))
    found = written(found if keep_text else found.drop(text), "tokens")
    cut, mean = discovery_cut(found.select(F.explode(tested).alias("t")).select("t.p", "t.n").where("p is not null"), rate)
    chosen = F.filter(tested, lambda t: (t["uniform_p"] >= LEAST_UNIFORM) & (_weighted(t["p"], t["n"], mean) >= cut))
    free = _bound(F.col("base_spans"), lambda own: F.filter(chosen, lambda t: ~F.exists(own, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))))
    more = F.transform(free, lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS) - 1).alias("rank"), F.lit("random").alias("kind"), t["end"].alias("end")))
    return found.withColumn("spans", F.array_sort(F.concat("base_spans", more))).drop(tested)


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    of_kind = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(kind) for kind, *_ in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
