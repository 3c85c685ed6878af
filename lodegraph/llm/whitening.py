"""Whitening of embeddings over an exact integer scatter.

Entries become integers. A shift is taken off, sums and cross-products are accumulated as integers of any size, and
n·XᵀX - SSᵀ is formed from them without rounding; only then does the covariance become floating point and is decomposed.
So the model doesn't depend on how rows are dealt, on their order or on the shift.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, quoted, small_batches, spare, table, written

#: An entry c becomes floor(SCALE * c) + OFFSET; scaled entries beyond ±CLAMP count as that.
SCALE, OFFSET, CLAMP = 64, 1_000_000, 2.0**61
#: Bits of a limb whose products a float matrix product sums exactly over ROWS rows: 2 * 20 + 12 < 53.
LIMB, ROWS = 20, 4096
#: A total goes to Spark's sum as PARTS integers of PART bits, the last with the sign: 180 bits, where 126 and a row number's 40 are needed.
PART, PARTS = 30, 6
#: Eigenvalues below this share of the largest, times the dimensions, are taken for zero.
NOTHING = 2.0**-50


def integers(vector: Column) -> Column:
    """The entries as longs."""
    scaled = lambda c: F.least(F.greatest(c.cast("double") * SCALE, F.lit(-CLAMP)), F.lit(CLAMP))
    return F.transform(vector, lambda c: F.floor(scaled(c)).cast("long") + OFFSET)


def usable(vector: Column) -> Column:
    """Whether there is a vector, with entries that are all there and finite."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """``x`` as floats of LIMB bits, the last with the sign: sum of limb k << (LIMB * k)."""
    out, most = [], max(int(x.max(initial=0)), -int(x.min(initial=0)))
    while most >> LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x, most = x >> LIMB, most >> LIMB
    return [*out, x.astype(np.float64)]


class Scatter:
    """n, sums and cross-products of integer rows, exact at any size."""

    def __init__(self, width: int):
        self.n, self.sums = 0, np.zeros(width, object)
        self.products = np.zeros((width, width), object)

    def add(self, x: np.ndarray) -> None:
        for start in range(0, len(x), ROWS):
            block = _limbs(x[start : start + ROWS])
            self.n += len(block[0])
            for i, a in enumerate(block):
                self.sums += a.sum(axis=0).astype(np.int64).astype(object) << (LIMB * i)
                for j, b in enumerate(block[i:], i):
                    both = (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
                    self.products += both if i == j else both + both.T

    def totals(self) -> np.ndarray:
        """n, the sums, and the products on and above the diagonal, in one row of Python integers."""
        return np.concatenate([np.array([self.n], object), self.sums, self.products[np.triu_indices(len(self.sums))]])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(rows: DataFrame) -> list:
    """Rows (entry, value...) added up by entry and brought to the driver in order; as many as the statistic has entries."""
    names = rows.columns[1:]
    return rows.groupBy("entry").agg(*(F.sum(c).alias(c) for c in names)).orderBy("entry").collect()


def _scatter(fit: DataFrame, shift: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, S, XᵀX) of the rows of ``fit`` (x) less ``shift``, as Python integers. A task sends a row for each entry, in parts that are summed by Spark."""
    width = len(shift)
    schema = "entry long, " + ", ".join(f"p{k} long" for k in range(PARTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Scatter(width)
        for batch in batches:
            if batch.num_rows:
                held.add(_matrix(batch.column(0), width) - shift)
        if held.n:
            whole = held.totals()
            parts = [(whole >> (PART * k)) & ((1 << PART) - 1) for k in range(PARTS - 1)] + [whole >> (PART * (PARTS - 1))]
            columns = [pa.array(np.arange(len(whole))), *(pa.array(p.astype(np.int64)) for p in parts)]
            yield pa.RecordBatch.from_arrays(columns, names=["entry", *(f"p{k}" for k in range(PARTS))])
        give_back()

    got = [sum(int(r[k + 1]) << (PART * k) for k in range(PARTS)) for r in _summed(fit.mapInArrow(run, schema))]
    if not got:
        return 0, np.zeros(width, object), np.zeros((width, width), object)
    products = np.zeros((width, width), object)
    products[np.triu_indices(width)] = got[1 + width :]
    products = np.triu(products, 1).T + products
    return got[0], np.array(got[1 : 1 + width], object), products


@dataclass(frozen=True)
class Whitener:
    """What ``fit`` learned: n rows, a shift and the sums S of the rows less it, eigenvalues (falling) and their unit vectors as rows."""

    n: int
    shift: np.ndarray
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.shift)

    def scales(self, most: int) -> np.ndarray:
        """1 / sqrt(e) of the first components; 0 where e is zero but for rounding."""
        e = self.values[:most]
        real = e > NOTHING * self.width * max(0.0, self.values[0])
        return np.where(real, 1 / np.sqrt(np.where(real, e, 1.0)), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n·x - S, exact: longs where they surely hold it, Python integers else."""
        moved = x - self.shift
        most = max(int(moved.max(initial=0)), -int(moved.min(initial=0)))
        if self.n * most + max(map(abs, self.sums.tolist()), default=0) < 1 << 62:
            return moved * np.int64(self.n) - self.sums.astype(np.int64)
        return moved.astype(object) * self.n - self.sums

    def deviation(self, centred: np.ndarray) -> list[int]:
        """The sum of squares of each row, exact."""
        most = max(int(centred.max(initial=0)), -int(centred.min(initial=0)))
        wide = centred if most * most * self.width < 1 << 63 else centred.astype(object)
        return [int(v) for v in (wide * wide).sum(axis=1)]

    def project(self, centred: np.ndarray, most: int) -> np.ndarray:
        real = (centred / self.n).astype(np.float64)
        return (real @ self.vectors[:most].T) * self.scales(most)


def _width(rows: DataFrame) -> int | None:
    """The most frequent length of a vector, the larger of several; None where no row has an entry."""
    row = rows.groupBy(F.size("x").alias("size")).count().where("size > 0").orderBy(F.desc("count"), F.desc("size")).first()
    return row and row["size"]


def prepared(df: DataFrame, vector: str) -> DataFrame:
    """(x): the usable vectors as integers."""
    v = F.col(quoted(vector))
    return df.where(usable(v)).select(integers(v).alias("x"))


def fit(df: DataFrame, vector: str = "embedding") -> tuple[Whitener | None, DataFrame]:
    """The model and the fit list: each distinct integer vector once, a written table (x).

    Vectors that are null or hold a null or non-finite entry are left out, and of the others those whose length isn't the most
    frequent one (the larger, of equally frequent ones). Without any vector there is no model. Equal vectors count once, however
    many there are: a task keeps one of each before anything is shuffled. To the driver come n, S and XᵀX, which grow with the
    dimensions alone.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = written(prepared(df, vector).distinct(), "distinct")
    width = _width(rows)
    if width is None:
        return None, rows
    rows = rows.where(F.size("x") == width)
    shift = np.array(rows.first()["x"], np.int64)
    n, sums, products = _scatter(rows, shift)
    scaled = n * products - np.outer(sums, sums)
    covariance = np.array([[v / (n * n) for v in line] for line in scaled.tolist()], np.float64)  # integers' quotients are rounded once
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1].copy(), vectors.T[::-1].copy()
    signs = np.sign(vectors[np.arange(width), np.abs(vectors).argmax(axis=1)])
    vectors *= signs[:, None]  # the largest entry is positive
    return Whitener(n, shift, sums, values, vectors, float(np.trace(covariance))), rows


def identity_error(model: Whitener, rows: DataFrame, most: int) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, measured over the rows (x); components without spread don't count."""
    real = np.flatnonzero(model.scales(most))
    k = len(real)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = model.project(model.centred(_matrix(batch.column(0), model.width)), most)[:, real]
                sums += w.sum(axis=0)
                products += w.T @ w
        both = np.concatenate([sums, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both)], names=["entry", "value"])
        give_back()

    if not k:
        return 0.0
    got = np.array([r.value for r in _summed(rows.mapInArrow(run, "entry long, value double"))])
    mean = got[:k] / model.n
    return float(np.abs(got[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, model: Whitener | None, vector: str = "embedding", most: int = 16) -> DataFrame:
    """The rows of ``df`` with usable vectors of the model's length, with ``whitened`` and ``deviation``.

    ``whitened``: array of double, a component's value for each of the first ``most`` (as many as there are dimensions at most), null where
    a component has no spread. ``deviation``: decimal(38,0), the sum of squares of n·x - S, exact; null beyond 38 digits. Repeated
    rows are told alike, without a model there are no rows. Columns of ``df`` with these names are replaced, all others stay.
    """
    small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in ("whitened", "deviation")]
    schema = T.StructType([*kept, T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.DecimalType(38, 0))])
    (own,) = spare(df, "x")
    v = F.col(quoted(vector))
    rows = df.where(usable(v)).select(*(F.col(quoted(f.name)) for f in kept), integers(v).alias(own))
    if model is None:
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[len(kept) :]]
        return rows.where(F.lit(False)).select(*(F.col(quoted(f.name)) for f in kept), *none)
    rows = rows.where(F.size(own) == model.width)
    shown, limit = model.scales(most), 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = model.centred(_matrix(batch.column(len(kept)), model.width))
            w = model.project(centred, most)
            flat = pa.array(w.ravel(), mask=np.tile(shown == 0, len(w)))
            lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), flat)
            far = [Decimal(d) if d < limit else None for d in model.deviation(centred)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], lists, pa.array(far, pa.decimal128(38, 0))], names=schema.names)
        give_back()

    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each usable embedding and component up to 16: vec_id, component, n, deviation, whitened, explained, identity_error."""
    most, rows = 16, table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model, listed = fit(rows)
    error = identity_error(model, listed, most) if model else None
    shares = [float(v) / model.trace if model.trace > 0 else None for v in model.values[:most]] if model else []
    found = whiten(rows, model, most=most).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n if model else None).cast("long").alias("n"),
        F.expr("try_cast(deviation AS BIGINT)").alias("deviation"),
        "whitened",
        F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
