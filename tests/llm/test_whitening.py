import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import whitening as w

SF = "/root/testdata/sf0.001"


def exact(rows):
    """(n, sums, covariance) of integer rows by fractions."""
    n, d = len(rows), len(rows[0])
    sums = [sum(r[i] for r in rows) for i in range(d)]
    products = [[sum(r[i] * r[j] for r in rows) for j in range(d)] for i in range(d)]
    return n, sums, [[float(Fraction(n * products[i][j] - sums[i] * sums[j], n * n)) for j in range(d)] for i in range(d)]


def whole(vector):
    return None if vector is None or any(c is None or not math.isfinite(c) for c in vector) else tuple(math.floor(64 * c) + 1_000_000 for c in vector)


def frame(spark, vectors):
    rows = [(k if k != 3 else None, v) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_scatter_of_any_size():
    r = np.random.default_rng(4)
    for top in (10, 1 << 19, 1 << 21, 1 << 45, (1 << 61) + 5):
        x = r.integers(-top, top, (9000 if top < 1 << 22 else 50, 3))
        held = w.Scatter(3)
        held.add(x[:7])
        held.add(x[7:])
        rows = x.tolist()
        assert held.n == len(rows) and held.sums.tolist() == [sum(v[i] for v in rows) for i in range(3)]
        assert held.products.tolist() == [[sum(v[i] * v[j] for v in rows) for j in range(3)] for i in range(3)]


@pytest.mark.parametrize("top", [1.0, 3e4, 1e15])
def test_against_fractions(spark, top):
    r = np.random.default_rng(7)
    mixed = r.normal(size=(400, 5)) @ r.normal(size=(5, 5)) * top
    vectors = mixed.tolist() + mixed[:150].tolist() * 2 + [None, [None] + [1.0] * 4, [float("nan")] * 5, [1.0, float("-inf"), 0.0, 0.0, 0.0], [1.0, 2.0], []]
    df = frame(spark, vectors).repartition(5)
    model, listed = w.fit(df)
    rows = sorted({whole(v) for v in vectors if v and len(v) == 5 and whole(v)})
    n, sums, covariance = exact(rows)
    assert model.n == n == listed.count() and (model.sums + n * model.shift.astype(object)).tolist() == sums
    values, parts = np.linalg.eigh(np.array(covariance))
    assert np.allclose(model.values, values[::-1], rtol=1e-9)
    found = w.whiten(df.withColumn("whitened", F.lit("mine")).withColumn("x", F.lit(1)), model).collect()
    assert len(found) == 700 and set(found[0].asDict()) == {"vec_id", "embedding", "x", "whitened", "deviation"}
    for row in found:
        centred = [n * a - s for a, s in zip(whole(row.embedding), sums)]
        far = sum(c * c for c in centred)
        assert (int(row.deviation) == far) if far < 10**38 else row.deviation is None
        want = np.array([c / n for c in centred]) @ parts[:, ::-1] / np.sqrt(values[::-1])
        assert np.allclose(np.abs(row.whitened), np.abs(want), rtol=1e-6, atol=1e-8)
    assert w.identity_error(model, listed, 16) < 1e-8


def test_dealt_otherwise_the_model_is_the_same(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    (a, _), (b, _) = w.fit(rows.repartition(7, F.rand(1))), w.fit(rows.coalesce(1))
    assert a.n == b.n and (a.values == b.values).all() and (a.vectors == b.vectors).all()


def test_components_without_spread_are_null(spark):
    df = frame(spark, [[1.0, 2.0, 3.0], [2.0, 4.0, 3.0], [1.0, 2.0, 3.0]])
    model, listed = w.fit(df)
    rows = w.whiten(df, model).collect()
    assert model.n == 2 and all(abs(abs(r.whitened[0]) - 1) < 1e-12 and r.whitened[1:] == [None, None] for r in rows)
    assert w.identity_error(model, listed, 16) < 1e-12
    model, listed = w.fit(frame(spark, [[0.5, 0.5]] * 4))
    assert model.n == 1 and model.trace == 0 and w.identity_error(model, listed, 16) == 0


def test_nothing(spark):
    for vectors in ([], [None, None], [[], []]):
        df = frame(spark, vectors)
        model, _ = w.fit(df)
        assert model is None and w.whiten(df, model).collect() == []


def test_query(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    good = {r.vec_id: whole(r.embedding) for r in rows if whole(r.embedding)}
    n, sums, covariance = exact(sorted(set(good.values())))
    values, parts = np.linalg.eigh(np.array(covariance))
    values, parts = values[::-1], parts[:, ::-1]
    got = {}
    for r in w.op13_whitening(spark, SF).collect():
        got.setdefault(r.vec_id, []).append(r)
    assert set(got) == set(good)
    for id_, lines in got.items():
        centred = [n * a - s for a, s in zip(good[id_], sums)]
        lines.sort(key=lambda r: r.component)
        assert [r.component for r in lines] == list(range(1, 17))
        want = np.array([c / n for c in centred]) @ parts[:, :16] / np.sqrt(values[:16])
        for r in lines:
            assert r.n == n and r.deviation == sum(c * c for c in centred) and r.identity_error < 1e-8
            assert abs(r.explained - values[r.component - 1] / np.trace(covariance)) < 1e-9
            assert abs(abs(r.whitened) - abs(want[r.component - 1])) < 1e-6
