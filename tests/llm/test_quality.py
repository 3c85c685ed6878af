import re
from collections import defaultdict

from pyspark.sql import functions as F

from lodegraph.llm import quality as q

from .conftest import clash

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, limit):
    """(doc_id, text) -> measures and verdict, by definition."""
    lines, out = defaultdict(set), {}
    for r in rows:
        for x in (r.text or "").split("\n"):
            if W.search(x) and r.doc_id is not None:
                lines[r.source, tuple(W.findall(x.lower()))].add(r.doc_id)
    for r in rows:
        t = r.text or ""
        w, windows, covered = W.findall(t), defaultdict(list), set()
        for i in range(len(w) - 4):
            windows[tuple(w[i : i + 5])].append(i)
        for at in windows.values():
            if len(at) > 1:
                covered.update(k for i in at for k in range(i, i + 5))
        own = [x for x in t.split("\n") if W.search(x)]
        gone = 0 if r.doc_id is None else sum(len(W.findall(x)) for x in own if len(lines[r.source, tuple(W.findall(x.lower()))]) > limit)
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        out[r.doc_id, r.text] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(own) - len(set(own)), len(covered), failed, gone, not failed and len(w) - gone >= 0.5 * len(w))
    return out


def check(df, limit):
    rows = df.collect()
    keyed = q.judge(df.withColumn("key", F.coalesce("text", F.lit("\0null"))), limit=limit)
    got = keyed.collect()
    assert len(got) == len(rows)
    want = brute(rows, limit)
    for r in got:
        text = None if r.key == "\0null" else r.key
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_line_words_removed, r.kept) == want[r.doc_id, text]


def test_edge_cases(docs):
    check(docs, 10)
    check(docs, 1)


def test_frequent_lines_go_by_host(spark):
    shared = "this very line is in every document of this host and has many words"
    own = lambda i: " ".join(f"word{i}x{k}" for k in range(20))
    rows = [(i, f"{shared}\n{own(i)}" if i % 2 else f"{shared}\n{shared}  \nx{i}", "h" if i < 8 else "g") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(df, 3)
    kept = {r.doc_id for r in q.judge(df, limit=3).where("kept").collect()}
    assert {1, 3, 5, 7} <= kept and not kept & {0, 2, 4, 6}


def test_repeats_and_ties(spark):
    texts = ["a b c d e " * k + "f g h i j" for k in range(6)] + ["x y z v w x y z v w x", "one two three four five", "#$ %& |<> ***", "same\nsame\n\n same \nsame"]
    check(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string"), 2)


def test_repeated_ids(spark):
    """Twelve documents share a line: a row that stands twice loses it once, and a second text under an id loses its own lines only."""
    shared = "a line of these words"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(9))
    rows = [(i, f"{shared}\n{own(i)}", "h") for i in range(12)] + [(0, f"{shared}\n{own(0)}", "h")] * 2
    rows += [(1, "\n".join([shared] * 4), "h"), (1, own("z") + " and more", "h"), (None, f"{shared}\n{own(5)}", "h"), (2, f"{shared}\n{own(2)}", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_line_words_removed, r.kept) for r in q.judge(df).collect())
    want = [(i, 14, 5, True) for i in range(12)] + [(0, 14, 5, True)] * 2 + [(1, 20, 20, False), (1, 11, 0, True), (-1, 14, 0, True), (2, 14, 0, True)]
    assert got == sorted(want)


def test_nothing_and_clashes(docs, none):
    assert q.judge(none).count() == 0
    out = q.judge(clash(docs, "kept", "n_words", "_words", "words", "row", "of_row", "removed"))
    assert out.where("kept = true").count() > 0 and "extra" in out.columns
    assert out.where("words = 'mine' and _words = 'mine' and row = 'mine' and of_row = 'mine' and removed = 'mine'").count() == docs.count()


def test_native(docs):
    plan = q.measure(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
