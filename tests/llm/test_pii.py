import datetime
import random
import re

import pytest

from lodegraph.llm import pii

from .conftest import clash

KEY = b"a key for tests"


@pytest.mark.parametrize("size", [2, 10, 100, 1000])
def test_permutations(size):
    p = pii.Permuter(KEY)
    there = [p.permute("x", size, i) for i in range(size)]
    assert sorted(there) == list(range(size)) and [p.permute("x", size, i, True) for i in there] == list(range(size))
    assert size < 100 or there != [p.permute("y", size, i) for i in range(size)]


CASES = [
    ("card 4845168114407329, end", "card"), ("4111 1111 1111 1111", "card"), ("ip 97.51.17.173.", "ip"), ("tel +1 (017) 555-7713 x", "phone"), ("born 1999-12-31", "date"),
    ("am 24.12.2001 da", "date"), ("on 01/13/2020 at", "date"), ("on 1/5/2020 at", "date"), ("31-12-1999", "date"), ("2020/02/29", "date"), ("in 1799-03-02", "date"), ("10/11/2021", "date"),
    ("call 555-123-4567 now", "phone"), ("(555) 123-4567", "phone"), ("+15551234567", "phone"), ("+44 20 7946 0123", "phone"), ("+33 1 23 45 67 89.", "phone"), ("1-555-123-4567", "phone"),
    ("3782 822463 10005", "card"), ("x@münchen.de", "email"), ("an o'brien@x.org", "email"), ("SSN 123-45-6789.", "ssn"), ("GB82 WEST 1234 5698 7654 32", "iban"), ("to DE89370400440532013000", "iban"),
    ("q" * 3100 + "@x.org", "email"), ("mail erpf.34@mail7.example.com, x", "email"), ("EAU.12@MAIL3.EXAMPLE.COM!! LE", "email"), ("Von Ab-c_9@x.org", "email"), ("4845168114407329!! so", "card"),
]


@pytest.mark.parametrize("text, kind", CASES)
def test_each_kind(text, kind):
    there, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, back=True)
    new, spans = there.replace(text)
    assert [s[0] for s in spans] == [kind] and new != text and len(new) - len(text) in range(-8, 9)
    assert there.replace(new)[1][0][0] == kind  # a pseudonym is as valid as what it stands for
    assert back.replace(new)[0] == text
    _, start, end = spans[0]
    assert text[:start] == new[:start] and there.replace(f"again {text[start:end]} here")[0] == f"again {new[start : len(new) - len(text) + end]} here"


@pytest.mark.parametrize("text", ["9807915762804490", "999.1.1.1 and 1.2.3.4.5", "2023-02-30", "v1.2.3", "12345678901234567890", "a@b", "000-12-3456", "GB82 WEST 1234 5698 7654 33", "13/13/2020", "no data at all", "", None])
def test_invalid_stays(text):
    assert pii.Pseudonyms(KEY).replace(text) == (text, [])


@pytest.mark.parametrize("n", [100, 1000, 10_000])
def test_long_values_show_nothing(n):
    draw = random.Random(n)
    there, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, back=True)
    kept = 0
    for _ in range(5):
        local = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
        new = there.of("email", f"{local}@x.org")
        assert back.of("email", new) == f"{local}@x.org"
        kept += sum(a == b for a, b in zip(local, new))
        other = there.of("email", f"{local[:-1]}{'a' if local[-1] != 'a' else 'b'}@x.org")
        if not local[-1].isdigit():  # a change of the last letter changes all of it
            assert sum(a == b for a, b in zip(new, other)) < 0.2 * n + 20
    chance = 26 / 36 / 26 + 10 / 36 / 10
    assert kept < 5 * n * chance + 6 * (5 * n * chance) ** 0.5


@pytest.mark.parametrize("write", ["{0.year:04d}-{0.month:02d}-{0.day:02d}", "{0.day:02d}.{0.month:02d}.{0.year:04d}", "{0.day}/{0.month}/{0.year:04d}", "{0.month}/{0.day}/{0.year:04d}"])
def test_dates_are_one_however_written(write):
    there, back, draw = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, back=True), random.Random(3)
    for _ in range(300):
        day = datetime.date.fromordinal(draw.randrange(1, datetime.date.max.toordinal()))
        text = write.format(day)
        new = there.of("date", text)
        assert back.of("date", new) == text
        if write.startswith("{0.month}") and day.day <= 12:
            day = datetime.date(day.year, day.day, day.month)  # read day first
        other = there._other_day(day)
        assert (1900 <= day.year < 2100) == (1900 <= other.year < 2100)
        parts = [int(x) for x in re.split("[-./]", new)]
        assert sorted(parts) == sorted([other.year, other.month, other.day])


def test_distributed(docs, none):
    df = clash(docs, "pii")
    out = pii.pseudonymise(df, KEY)
    assert out.columns == ["doc_id", "text", "lang", "source", "extra", "pii"]
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    assert pii.pseudonymise(none, KEY).count() == 0


PLAIN = {  # each kind by a plain pattern and check of its own; only the forms that the tables hold
    "email": (r"(?:(?<=^)|(?<=[^\w.%+-]))[^\W_][\w.]*@[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+", lambda x: True),
    "ip": (r"(?<![0-9.])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+(?![0-9])", lambda x: all(p == str(int(p)) and int(p) < 256 for p in x.split("."))),
    "card": (r"(?<![0-9])[0-9]{13,19}(?![0-9])", lambda x: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(x))) % 10 == 0),
    "phone": (r"\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4}", lambda x: True),
}


def test_query_links_and_hides(spark):
    """Against a plain search: what is found, what stays, and that equal values are linked and different ones are not."""
    sf = "/root/testdata/sf0.01"
    new = {r.doc_id: r for r in pii.op4_pii(spark, sf).collect()}
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    seen, total = {}, 0
    assert set(new) == set(old)
    for i, text in old.items():
        want = sorted((m.start(), m.end(), kind) for kind, (pattern, good) in PLAIN.items() for m in re.finditer(pattern, text or "") if good(m[0]))
        got = [(int(a), int(b), kind) for kind, a, b in (x.split(":") for x in new[i].spans.split(",") if x)]
        assert got == want and [new[i][f"n_{k}"] for k in pii.KINDS] == [sum(k == g[2] for g in got) for k in pii.KINDS]
        shift = at = 0
        for a, b, kind in want:
            assert new[i].text[at + shift : a + shift] == text[at:a]
            end = len(new[i].text) - len(text) + b if (a, b, kind) == want[-1] else None
            value = new[i].text[a + shift : end] if end else re.match(PLAIN[kind][0] if kind != "ip" else r"[0-9.]+(?<!\.)", new[i].text[a + shift :])[0]
            assert value != text[a:b] and seen.setdefault(text[a:b], value) == value
            shift, at, total = shift + len(value) - (b - a), b, total + 1
        assert new[i].text is None if text is None else new[i].text[at + shift :] == text[at:]
    assert len(set(seen.values())) == len(seen) and total > 30


def test_a_line_of_quotes_takes_linear_time():
    import time

    worker = pii.Pseudonyms(b"key")
    for unit in ("a'", "a''", "'", "a'b''"):
        began = time.perf_counter()
        line = unit * 200_000 + "1"
        assert worker.replace(line) == (line, [])
        assert time.perf_counter() - began < 5
    text, spans = worker.replace("x='it's@example.org' 'o'neil@example.org'")
    assert [text[a:b].endswith("@example.org") for _, a, b in spans] == [True, True]


def test_a_number_is_one_number_however_it_is_written():
    worker = pii.Pseudonyms(b"key")
    forms = ["+1 555 123 4567", "1-555-123-4567", "555-123-4567", "(555) 123-4567", "+1 (555) 123-4567", "555.123.4567"]
    new = {"".join(c for c in worker.replace(f)[0] if c.isdigit())[-10:] for f in forms}
    assert len(new) == 1 and new != {"5551234567"}
    back = pii.Pseudonyms(b"key", back=True)
    assert [back.replace(worker.replace(f)[0])[0] for f in forms] == forms


def test_long_values_are_not_remembered():
    worker = pii.Pseudonyms(b"key")
    worker.replace("a" * 5000 + "@example.org and b@example.org")
    assert worker._remembered.cache_info().currsize == 1
