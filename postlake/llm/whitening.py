"""Whitening of embeddings from exact integer cross-products, which are counted in bit planes.

Entries become integers, and each dimension of a batch, shifted by its minimum, is cut into bit
planes that are packed across rows into words. The AND of two planes has as many bits as rows have
both, so popcounts, weighted by powers of two, give the exact cross-products; partitions send sums of those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c counts as floor(SCALE * c) + ORIGIN; sums are kept without the origin.
SCALE, ORIGIN = 64, 1_000_000
#: Entries of this size or more have no such number in a long, and count as not finite.
LARGEST = 2.0**56
#: Bits of each of the numbers that a cross-product is sent as, and how many there are.
LIMB, LIMBS = 30, 5
#: Rows of which bits are packed at a time, and rows that results are made for at a time.
PACK_ROWS, OUT_ROWS = 8192, 2048

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame, dims: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows whose vector has finite entries only and ``dims`` of them, and that number.

    By default that is the commonest length, the larger one of two as common; vectors of other lengths lie in
    other spaces and are left out. Empty vectors count as null.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where((F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False))))
    if dims is None:
        first = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
        dims = first["dims"] if first else 0
    return rows.where(F.size("v") == dims), dims


def _whole(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers, without the origin, of an array of lists."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) * SCALE).astype(np.int64)


def planes(y: np.ndarray) -> np.ndarray:
    """(bit, dimension, word): the bits of columns of numbers from 0 on, 64 rows a word."""
    bits = max(1, int(y.max(initial=0)).bit_length())
    out = np.zeros((bits, y.shape[1], -(-len(y) // 64) * 8), np.uint8)
    for k in range(bits):
        packed = np.packbits(((y >> k) & 1).astype(np.uint8).T, axis=1)
        out[k, :, : packed.shape[1]] = packed
    return out.view(np.uint64)


def cross_products(y: np.ndarray) -> np.ndarray:
    """The sums of y[:, i] * y[:, j], exact, of numbers from 0 on, by popcounts of planes."""
    cut = planes(y)
    bits, dims, _ = cut.shape
    kind = np.int64 if 2 * bits + int(len(y)).bit_length() < 62 else object
    weights = np.array([1 << k for k in range(bits)], kind)
    out = np.zeros((dims, dims), kind)
    for k in range(bits):
        for i in range(dims):
            both = np.bitwise_count(cut & cut[k, i]).sum(axis=2, dtype=np.int64).astype(kind)
            out[i] += (weights[:, None] * both).sum(axis=0) << k
    return out


def _moments(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of a batch's integers, as Python's numbers."""
    z = _whole(column, dims)
    low = z.min(axis=0)
    y = z - low
    low, sums = low.astype(object), y.sum(axis=0, dtype=np.int64).astype(object)
    shifted = np.multiply.outer(low, sums)
    return sums + len(z) * low, cross_products(y).astype(object) + shifted + shifted.T + len(z) * np.multiply.outer(low, low)


@dataclass
class Whitening:
    """n vectors with sums S (without the origin), eigenvalues by falling size, and unit eigenvectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def centred(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x - floor(S / n), remainders of S by n, x - S / n) of a batch."""
        whole, rest = (np.array([f(s, self.n) for s in self.sums], np.int64) for f in (int.__floordiv__, int.__mod__))
        u = _whole(column, len(self.sums)) - whole
        return u, rest, u - rest / self.n

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened coordinates; not a number where the eigenvalue is zero."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (centred @ self.vectors) / np.where(self.values > 0, np.sqrt(self.values), np.nan)

    def deviations(self, u: np.ndarray, rest: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S)^2, exact; null where it isn't a long."""
        most = self.n * (int(np.abs(u).max(initial=0)) + 1)
        w = u.astype(np.int64 if u.shape[1] * most * most < 2**62 else object) * self.n - rest
        return [x if x < 2**63 else None for x in (w * w).sum(axis=1).tolist()]


def fit(rows: DataFrame, dims: int, components: int = 32) -> Whitening | None:
    """Whitening of the rows of `usable`; None if there are none.

    A partition sends a row per pair of dimensions, whose sums come to the driver: a number set by dims alone.
    Centring, by n * products - sums * sums, is done in integers. Eigenvalues that are zero up to rounding are set to zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            for at in range(0, batch.num_rows, PACK_ROWS):
                part = batch.column("v").slice(at, PACK_ROWS)
                a, b = _moments(part, dims)
                n, sums, products = n + len(part), sums + a, products + b
        if n:
            i, j = np.triu_indices(dims)
            i, j = np.concatenate([[-1], np.full(dims, -1), i]), np.concatenate([[-1], np.arange(dims), j])
            every = [n, *sums, *products[np.triu_indices(dims)]]
            limbs = [pa.array([(x >> LIMB * k) & ((1 << LIMB) - 1) if k < LIMBS - 1 else x >> LIMB * k for x in every], pa.int64()) for k in range(LIMBS)]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *limbs], names)

    limbs = [f"l{k}" for k in range(LIMBS)]
    names = ["i", "j", *limbs]
    sent = rows.select("v").mapInArrow(run, "i int, j int, " + ", ".join(f"{x} long" for x in limbs))
    found = {(r["i"], r["j"]): sum(r[x] << LIMB * k for k, x in enumerate(limbs)) for r in sent.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in limbs]).collect()}
    if not found:
        return None
    n, sums = found[-1, -1], [found[-1, i] for i in range(dims)]
    v = np.array([[(n * found[min(i, j), max(i, j)] - sums[i] * sums[j]) / (n * n) for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors, trace = values[order], vectors[:, order], float(np.trace(v))
    values = np.where(values > max(values[0], 0) * dims * np.finfo(float).eps, values, 0.0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return Whitening(n, sums, values, vectors * signs, values / trace if trace else np.full(len(order), np.nan))


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the covariance of whitened rows minus the identity; None if no eigenvalue is above zero.

    Measured on all rows: partitions send sums of products of the components.
    """
    at = np.flatnonzero(model.values > 0)
    k = len(at)
    if not k:
        return None
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.project(model.centred(batch.column("v"))[2])[:, at]
            sums, products = sums + w.sum(axis=0), products + w.T @ w
        every = np.concatenate([sums, products[i, j]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(k, -1), i]), pa.int32()), pa.array(np.concatenate([np.arange(k), j]), pa.int32()), pa.array(every)], ["i", "j", "s"])

    got = {(r["i"], r["j"]): r["s"] / model.n for r in rows.select("v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    return max(abs(got[a, b] - got[-1, a] * got[-1, b] - (a == b)) for a, b in zip(i.tolist(), j.tolist(), strict=True))


def whitened(rows: DataFrame, model: Whitening, error: float | None) -> DataFrame:
    """A row per row of `usable` and component, numbered from 1 by falling eigenvalue."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                u, rest, centred = model.centred(part.column("v"))
                m = len(u)
                again = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    part.column("vec_id").take(again),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(model.deviations(u, rest), pa.int64()).take(again),
                    pa.array(model.project(centred).ravel(), from_pandas=True),
                    pa.array(np.tile(model.explained, m), from_pandas=True),
                    pa.array([error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in OUT.split(", ")])

    return rows.mapInArrow(run, OUT)


def whitening(vectors: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row and component.

    Rows whose vector is null or empty, holds null or non-finite entries, or isn't of the commonest length, give none; see
    `usable`. Repeated rows and null ids count and come as often as they are there. There are as many components as
    dimensions if those are fewer. A component whose eigenvalue is zero, as with one row or equal ones, has null coordinates
    and takes no part in identity_error; explained is null if all are. A deviation that is no long is null. An empty table gives no row.
    Columns besides vec_id and embedding are not read.
    """
    rows, dims = usable(vectors)
    model = fit(rows, dims, components) if dims else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    return whitened(rows, model, identity_error(rows, model))
