import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodegraph.llm import fill_in_middle as m

from .conftest import clash


def plainly(id_, text, words=("<P>", "<S>", "<M>"), seed=1):
    """(n, form, prefix_chars, middle_chars, output) by slices of the text."""
    t = text or ""
    n, h = len(t), hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(w in t for w in words) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    p, s, x = words
    if h4 % 100 < 20:
        return n, "spm", a, b - a, s + t[b:] + p + t[:a] + x + t[a:b]
    return n, "psm", a, b - a, p + t[:a] + s + t[b:] + x + t[a:b]


def test_each_row(docs):
    found = m.restore(m.transform(clash(docs, "n", "output", "restored", "body")))
    assert found.columns == ["doc_id", "text", "lang", "source", "restored", "body", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(r.doc_id, r.text)
        assert r.restored == (r.text or "") and r.body == "mine"


def test_many_random_texts(spark):
    r = random.Random(12)
    letters = ["<", ">", "P", "S", "M", "<P", "<S>", "é", "日", "\U0001f600", "a", " ", "\n", "\x00", "´"]
    rows = [(k, "".join(r.choices(letters, [3, 3, 3, 3, 3, 2, 0.02, 4, 4, 4, 9, 9, 1, 1, 2], k=r.choice([0, 1, 2, 5, 40, 255, 256, 257, 3000])))) for k in range(1500)]
    found = m.restore(m.transform(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    forms = {}
    for x in found:
        want = plainly(x.doc_id, x.text)
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == want and x.restored == x.text
        forms[x.form] = forms.get(x.form, 0) + 1
    assert min(forms.values()) > 100


def test_a_sentinel_over_two_texts_is_none(spark):
    rows = [(k, t) for k, t in enumerate(["x <P", "> y", "<", "S>", "é<", "M>é"] * 20)]
    for x in m.transform(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect():
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == plainly(x.doc_id, x.text)


def test_own_sentinels_and_seed(spark):
    words = ("<｜begin｜>", "<｜hole｜>", "<｜end｜>")
    rows = [(k, "ab日本語 <｜begin ｜hole｜> " * k + ("<｜end｜>" if k % 7 == 0 else "")) for k in range(60)]
    own = m.Sentinels(*words)
    found = m.restore(m.transform(spark.createDataFrame(rows, "doc_id long, text string"), sentinels=own, seed=5), sentinels=own).collect()
    for x in found:
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == plainly(x.doc_id, x.text, words, 5) and x.restored == x.text


def test_sentinels_that_can_be_taken_for_each_other():
    for bad in (("a", "ab", "c"), ("", "b", "c"), ("xa", "ay", "z"), ("aba", "c", "d"), ("a", "a", "b")):
        with pytest.raises(ValueError):
            m.Sentinels(*bad)


def test_one_very_long_text_and_many_short_ones(spark):
    long = "日<Pé" * 700_000
    rows = [(1, long), (2, "x")] + [(k, "y") for k in range(3, 3000)]
    found = {x.doc_id: x for x in m.restore(m.transform(spark.createDataFrame(rows, "doc_id long, text string"))).where(F.col("restored") == F.col("text")).collect()}
    assert len(found) == len(rows)
    assert (found[1].n, found[1].form, found[1].prefix_chars, found[1].middle_chars, found[1].output) == plainly(1, long)


def test_nothing(none):
    assert m.restore(m.transform(none)).collect() == []
