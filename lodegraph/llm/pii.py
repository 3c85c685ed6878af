"""Personal data turned into pseudonyms by keyed permutations that keep the format.

Whatever is found and validated (card numbers by check digit, bank accounts by theirs, dates by the calendar, addresses of the
Internet by range, social security numbers by their rules, phone numbers by their plan, e-mail addresses by their parts) is a
number in a range: a Feistel network over that range, keyed and tweaked by the kind, permutes it, walking on until it lands
in the range again. So a pseudonym has the format of what it stands for, equal values get equal pseudonyms in all
documents, different values different ones, and whoever has the key can turn them back.

Not looked for, since their form alone can't tell them: national phone numbers other than of the form 555-123-4567, numbers of
ten digits without any sign, dates with months in words or years of two digits, IPv6 addresses, names and postal addresses.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, table

#: Rounds of the network; pseudonyms that a Python worker remembers, of values of so many characters at most; letters and digits of a long value that are one number.
ROUNDS, REMEMBERED, LONGEST, BLOCK = 8, 100_000, 64, 32
#: Dates within these years stay within them, all others outside.
YEARS = (1900, 2100)
#: The key that queries and tests use. Real data needs a key of its own, kept apart from the data.
EXAMPLE_KEY = b"example key: set your own"
#: Country calling codes of one and of two digits; all others have three. Fixed values.
SHORT_CODES = ("1", "7")
TWO_DIGIT_CODES = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)

#: What is looked for, in the order of precedence at one place.
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
_FIND = regex.compile(
    r"""
    (?=[\p{L}\p{M}0-9._%+-])(?<![\p{L}\p{M}0-9._%+-]'*)(?P<email>[\p{L}\p{M}0-9._%+-][\p{L}\p{M}0-9._%+'-]*+@(?:[\p{L}\p{M}\p{N}-]+\.)+(?:xn--[A-Za-z0-9-]+|[\p{L}\p{M}]{2,})(?![\p{L}\p{M}\p{N}]))
    |(?<![\p{L}0-9])(?P<iban>[A-Z]{2}[0-9]{2}(?:(?P<space>[ ]?)[A-Z0-9]{4})(?:(?P=space)[A-Z0-9]{4}){1,6}(?:(?P=space)[A-Z0-9]{1,4})?)(?![\p{L}0-9])
    |(?<![0-9.])(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9]|\.[0-9])
    |(?<![0-9/.-])(?P<date>[0-9]{4}(?P<of>[/-])[0-9]{1,2}(?P=of)[0-9]{1,2}|[0-9]{1,2}(?P<by>[./-])[0-9]{1,2}(?P=by)[0-9]{4})(?![0-9/-]|\.[0-9])
    |(?<![\p{L}0-9.+/-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\p{L}0-9]|[./-][0-9])
    |(?<![\p{L}0-9+])(?P<phone>\+[0-9](?:(?:[ .-]|[ .-]?\(|\)[ .-]?)?[0-9]){7,14}
      |(?<![./-])(?:1[ .-])?(?:\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}(?P<sign>[ .-])[0-9]{3}(?P=sign)[0-9]{4}))(?![\p{L}0-9]|[./-][0-9])
    |(?<![0-9])(?P<card>[0-9]{4}(?P<gap>[ -]?)[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}|[0-9]{4}(?P<wide>[ -])[0-9]{6}(?P=wide)[0-9]{4,5}|[0-9]{13,19})(?![0-9])""",
    regex.X,
)
_LOCAL = "abcdefghijklmnopqrstuvwxyz"


_HINT = re.compile("[0-9@]")


def _lines(text: str):
    """The lines that have a digit or an @; nothing that is looked for goes without, or over a line's end."""
    at = 0
    while m := _HINT.search(text, at):
        end = text.find("\n", m.end())
        at = len(text) if end < 0 else end
        yield text.rfind("\n", 0, m.start()) + 1, at


def luhn_digit(payload: str) -> int:
    """The check digit that a card number's other digits call for."""
    doubled = [int(d) * (2 if k % 2 == 0 else 1) for k, d in enumerate(reversed(payload))]
    return -sum(d - 9 if d > 9 else d for d in doubled) % 10


class Permuter:
    """Keyed permutations of ranges of integers, and of long rows of letters and digits."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, k: int, half: int, bits: int) -> int:
        """As many bits as a half has, of as many digests as they need."""
        width = (bits + 7) // 8
        message = tweak + bytes([k]) + half.to_bytes(width, "big")
        drawn = b"".join(hmac.digest(self.key, message + i.to_bytes(4, "big"), "sha256") for i in range(-(-width // 32)))
        return int.from_bytes(drawn, "big") & ((1 << bits) - 1)

    def _network(self, tweak: bytes, bits: int, value: int, back: bool) -> int:
        left, right = value >> bits, value & ((1 << bits) - 1)
        for k in range(ROUNDS) if not back else reversed(range(ROUNDS)):
            if back:
                left, right = right ^ self._round(tweak, k, left, bits), left
            else:
                left, right = right, left ^ self._round(tweak, k, right, bits)
        return left << bits | right

    def permute(self, kind: str | bytes, size: int, value: int, back: bool = False) -> int:
        """A permutation of 0 .. size - 1; ``back``: its inverse. The network covers under 16 times the range, and walks on outside it."""
        kind = kind.encode() if isinstance(kind, str) else kind
        span = size.to_bytes((size.bit_length() + 7) // 8, "big")
        tweak = len(kind).to_bytes(4, "big") + kind + len(span).to_bytes(4, "big") + span
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        value = self._network(tweak, bits, value, back)
        while value >= size:
            value = self._network(tweak, bits, value, back)
        return value

    def digits(self, kind: str, digits: str, back: bool = False) -> str:
        return str(self.permute(f"{kind}{len(digits)}", 10 ** len(digits), int(digits), back)).zfill(len(digits))

    def row(self, kind: str, bases: list[int], values: list[int], back: bool = False) -> list[int]:
        """A permutation of the rows of numbers below ``bases``, in time linear in their length.

        Blocks of ``BLOCK`` are permuted from left to right, tweaked by all that stands before them, then from right to left, tweaked
        by all that now stands behind them: so every number depends on every other.
        """
        tweak = hashlib.sha256(kind.encode() + b"\0" + bytes(bases)).digest()  # short, for each block takes it in
        cuts = range(0, len(bases), BLOCK)
        blocks, passes = [values[a : a + BLOCK] for a in cuts], [(1, list(range(len(cuts))))]
        if len(cuts) > 1:
            passes.append((2, list(reversed(range(len(cuts))))))
        for number, order in reversed(passes) if back else passes:
            chain = hashlib.sha256(bytes([number])).digest()
            for k in order:
                given = blocks[k]
                blocks[k] = self._block(tweak + chain, bases[cuts[k] : cuts[k] + BLOCK], given, back)
                chain = hashlib.sha256(chain + bytes(blocks[k] if back else given)).digest()
        return [v for block in blocks for v in block]

    def _block(self, tweak: bytes, bases: list[int], values: list[int], back: bool) -> list[int]:
        value, size = 0, 1
        for v, b in zip(values, bases, strict=True):
            value, size = value * b + v, size * b
        value, out = self.permute(tweak, size, value, back), []
        for b in reversed(bases):
            value, v = divmod(value, b)
            out.append(v)
        return out[::-1]


def _like(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced, in order, by ``digits``."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() and c.isascii() else c for c in pattern)


class Pseudonyms:
    """Finds and replaces; ``back`` turns pseudonyms into what they stand for."""

    def __init__(self, key: bytes, back: bool = False):
        self.permuter, self.back = Permuter(key), back
        self._remembered = lru_cache(REMEMBERED)(self._of)

    def of(self, kind: str, found: str) -> str | None:
        return self._remembered(kind, found) if len(found) <= LONGEST else self._of(kind, found)

    def _of(self, kind: str, found: str) -> str | None:
        """The pseudonym, None where ``found`` isn't valid and so stays."""
        return getattr(self, f"_{kind}")(found)

    def _card(self, found: str) -> str | None:
        digits = "".join(c for c in found if c.isdigit())
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != int(digits[-1]):
            return None
        new = self.permuter.digits("card", digits[:-1], self.back)
        return _like(found, new + str(luhn_digit(new)))

    def _iban(self, found: str) -> str | None:
        """The country stays, letters stay letters and digits digits, and the check digits are made anew."""
        plain = found.replace(" ", "")
        if not 15 <= len(plain) <= 34 or self._remainder(plain[4:] + plain[:4]) != 1:
            return None
        account = plain[4:]
        bases = [10 if c.isdigit() else 26 for c in account]
        new = self.permuter.row("iban" + plain[:2], bases, [int(c) if b == 10 else ord(c) - 65 for b, c in zip(bases, account, strict=True)], self.back)
        account = "".join(str(v) if b == 10 else chr(65 + v) for b, v in zip(bases, new, strict=True))
        rest = iter(f"{plain[:2]}{98 - self._remainder(account + plain[:2] + '00'):02d}{account}")
        return "".join(c if c == " " else next(rest) for c in found)

    @staticmethod
    def _remainder(text: str) -> int:
        """By 97, of the number that letters and digits stand for: A is 10, Z is 35."""
        return int("".join(str(int(c, 36)) for c in text)) % 97

    def _ssn(self, found: str) -> str | None:
        """Areas 001 to 899 but 666, groups and serial numbers but of zeros."""
        area, group, serial = map(int, found.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        at = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        rest, serial = divmod(self.permuter.permute("ssn", 898 * 99 * 9999, at, self.back), 9999)
        area, group = divmod(rest, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _phone(self, found: str) -> str:
        """The country code stays; all behind it is permuted. A number without one is a national number of +1, with a 1 before it or not."""
        if found[0] == "+":
            set_off = regex.match(r"\+[0-9]{1,3}(?=[ .(-])", found)
            long = 1 if found[1] in SHORT_CODES else 2 if found[1:3] in TWO_DIGIT_CODES else 3
            head = set_off[0] if set_off else found[: 1 + long]
        else:
            head = regex.match(r"(?:1[ .-])?", found)[0]
        rest = found[len(head) :]
        return head + _like(rest, self.permuter.digits("phone" + (head if found[0] == "+" else "+1"), "".join(c for c in rest if c.isdigit()), self.back))

    def _ip(self, found: str) -> str | None:
        parts = found.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        value = self.permuter.permute("ip", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"), self.back)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def _date(self, found: str) -> str | None:
        """A date is the same however it is written: year first, day first, or, where that is no date, month first.

        That it can be told which, dates after the 12th stay such, and so do those whose day and month both have two digits.
        """
        sign = next(c for c in found if not c.isdigit())
        parts = found.split(sign)
        orders = ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy") if sign != "." else ("dmy",)
        for order in orders:
            of = dict(zip(order, parts, strict=True))
            try:
                day = datetime.date(int(of["y"]), int(of["m"]), int(of["d"]))
            except ValueError:
                continue
            new = self._other_day(day)
            padded = min(len(of["m"]), len(of["d"])) == 2 or "0" in (of["m"][0], of["d"][0])
            written = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if padded else str(new.month), "d": f"{new.day:02d}" if padded else str(new.day)}
            return sign.join(written[c] for c in order)
        return None

    def _other_day(self, day: datetime.date) -> datetime.date:
        first, last = (datetime.date(y, 1, 1).toordinal() for y in YEARS)
        end, span = datetime.date.max.toordinal(), last - first
        kind = lambda d: (d.day > 12, d.day > 9 and d.month > 9)
        new = day
        while new is day or kind(new) != kind(day):
            at = new.toordinal()
            if first <= at < last:
                at = first + self.permuter.permute("date", span, at - first, self.back)
            else:
                at = self.permuter.permute("far date", end - span, at - 1 - (span if at >= last else 0), self.back) + 1
                at += span if at >= first else 0
            new = datetime.date.fromordinal(at)
        return new

    def _email(self, found: str) -> str | None:
        """The part before the @: its letters a-z and digits are permuted, a letter staying a letter of its case; other letters become a-z first.

        Only what is made of A-Z, a-z and digits can be turned back. The domain stays.
        """
        local, _, domain = found.rpartition("@")
        plain = "".join(low if len(low := c.lower()) == 1 else c for c in local)
        if not plain.isascii():
            drawn = hashlib.shake_256(plain.encode()).digest(2 * len(plain))
            plain = "".join(c if c.isascii() else _LOCAL[int.from_bytes(drawn[2 * i : 2 * i + 2], "big") % 26] for i, c in enumerate(plain))
        bases = [26 if c in _LOCAL else 10 if c.isdigit() else 0 for c in plain]
        if not any(bases):
            return None
        shape = "".join("a" if b == 26 else "0" if b else c for b, c in zip(bases, plain, strict=True))
        kept = [b for b in bases if b]
        new = iter(self.permuter.row("email" + shape, kept, [_LOCAL.index(c) if b == 26 else int(c) for b, c in zip(bases, plain, strict=True) if b], self.back))
        out = (_LOCAL[next(new)] if b == 26 else str(next(new)) if b else c for b, c in zip(bases, plain, strict=True))
        return "".join(n.upper() if c.isupper() else n for c, n in zip(local, out, strict=True)) + "@" + domain

    def replace(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and what was replaced: (kind, start, end) in the given text."""
        if not text:
            return text, []
        out, at, spans = [], 0, []
        for first, last in _lines(text):
            for m in _FIND.finditer(text, first, last):
                kind = next(k for k in KINDS if m[k] is not None)
                new = self.of(kind, m[kind])
                if new is not None:
                    start, end = m.span(kind)
                    out += [text[at:start], new]
                    at = end
                    spans.append((kind, start, end))
        return "".join([*out, text[at:]]), spans


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", spans: str = "pii", back: bool = False) -> DataFrame:
    """``docs`` with ``text`` rewritten and ``spans``: array of (kind, start, end) of what was replaced, in the old text.

    Null and empty texts stay as they are, with no spans; whole texts of any length are searched. What looks like a
    number, date or address but isn't valid stays. Where kinds could overlap, the leftmost counts, and of those that begin
    together the first of ``KINDS``. Repeated rows and equal values are treated alike; no rows give none. ``back`` inverts.
    Other columns stay; one named ``spans`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(key)
    fields = [T.StructField(text, T.StringType()), *T.StructType.fromDDL(f"`{spans}` array<struct<kind: string, start: int, end: int>>").fields]

    def step():
        worker = Pseudonyms(held.value, back)

        def one(texts):
            made = [worker.replace(t) for t in texts]
            return [t for t, _ in made], [[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in made]

        return one

    order = [c for c in docs.columns if c != spans]
    return add_columns(docs, text, fields, step, keep_text=False).select(*order, spans)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms in place of personal data, and how many of each kind there were."""
    found = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), EXAMPLE_KEY)
    of_kind = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", "text", *(of_kind(k) for k in KINDS), F.array_join(F.transform("pii", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",").alias("spans"))
