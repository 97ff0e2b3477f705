"""Whitening of embeddings by LOBPCG.

Vectors are taken as whole numbers, x = floor(SCALE * c) + SHIFT, so their sums are exact. The
fit list has each distinct x once; it is written once to the shared folder and every product
with the covariance V is a Spark job over it: tasks centre their rows, (n x - S) / n with
the whole numbers before the division, and add up C' (C W) for the block W, and Spark sums
the tasks' matrices by entry. What reaches the driver is a block, dimensions x columns.

The iteration is the locally optimal block method: a Rayleigh-Ritz step on the span of the
iterate X, its residuals R and the previous directions P, whose basis is made orthonormal
first; the block has more columns than components are asked for, so close eigenvalues at its
end don't hold it up. Only V R is a new product, V X and V P are combinations of what is
known; when the residuals look small, V X is made anew and only what it shows counts. It
ends when no residual of the components is above GOAL times the largest eigenvalue, or when
they stop falling below CERTIFIED times it; else RuntimeError. Where the basis spans all
dimensions the Rayleigh-Ritz step is the whole eigenproblem, two or three products away.

Rows whose vector is null or holds null or non-finite entries are left out, as are rows whose
vector has another length than most (of equally many, the longest); a null id is kept.
Repeated rows count once in the fit list and are whitened each. Components without variance
(eigenvalue below EMPTY of the trace) have no whitened coordinate and are left out, so an
empty table or a single vector gives no rows. Entries are below 2**40 in size, else
the job fails, as for a deviation that 64 bits don't hold. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm import _arrays, _shared

SCALE, SHIFT = 64, 1_000_000
GOAL, CERTIFIED, EMPTY = 1e-14, 1e-10, 1e-12
#: Columns of the block beyond the components, and iterations at most.
MORE, ROUNDS = 12, 500


@dataclass(frozen=True)
class Whitening:
    """n and S of the fit list, components (columns), eigenvalues, their share of the trace, and how far whitened data is from unit covariance."""

    n: int
    total: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float
    residual: float
    products: int


def _entries(vector: Column) -> Column:
    """Whole numbers of a vector of finite entries; null for others."""
    c = vector.cast("array<double>")
    fit = vector.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(c, lambda v: F.floor(v * F.lit(float(SCALE))) + F.lit(SHIFT))
    large = F.raise_error(F.lit("entries of a vector are below 2**40 in size")).cast("array<long>")
    return F.when(fit, F.when(F.exists(c, lambda v: F.abs(v) >= float(1 << 40)), large).otherwise(whole))


def _rows(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, d)


def _summed(fit: DataFrame, f: Callable[[np.ndarray], np.ndarray], d: int, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of f(rows) over the fit list: a matrix a task, summed by entry in Spark."""

    def add(batches):
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += f(_rows(batch, d))
        flat = total.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "v"])

    out = np.zeros(int(np.prod(shape)))
    got = _arrays.run(fit, add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # an entry of the matrix each
    out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out.reshape(shape)


def _basis(blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An orthonormal basis of the blocks' columns, and the combination that makes it of them; directions that add nothing are dropped."""
    s = np.concatenate(blocks, 1)
    size = np.linalg.norm(s, axis=0)
    take = np.flatnonzero(size > 0)
    make = np.zeros((s.shape[1], len(take)))
    make[take, np.arange(len(take))] = 1 / size[take]
    for _ in range(2):  # twice is enough
        w, u = np.linalg.eigh((s @ make).T @ (s @ make))
        keep = w > 1e-12 * w[-1]
        make = make @ (u[:, keep] / np.sqrt(w[keep]))
    return s @ make, make


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The k largest eigenvalues and unit eigenvectors of the symmetric matrix that product() multiplies a block by, the largest residual (as a part of the largest eigenvalue) and the number of products."""
    b = min(d, k + MORE)
    x = np.linalg.qr(np.random.default_rng(12).standard_normal((d, b)))[0]
    vx, p, vp = product(x), None, None
    done, best, worse = 1, np.inf, 0
    for _ in range(ROUNDS):
        w, u = np.linalg.eigh((x.T @ vx + vx.T @ x) / 2)
        order = np.argsort(-w, kind="stable")
        w, x, vx = w[order], x @ u[:, order], vx @ u[:, order]
        if w[0] <= 0:
            return w[:k], x[:, :k], 0.0, done
        r = vx - x * w
        size = np.linalg.norm(r[:, :k], axis=0).max() / w[0]
        if size <= CERTIFIED or b == d:
            # certified by a product of its own
            x = np.linalg.qr(x)[0]
            vx, done = product(x), done + 1
            w = np.einsum("ij,ij->j", x, vx)
            r = vx - x * w
            size = np.linalg.norm(r[:, :k], axis=0).max() / w[0]
            worse = worse + 1 if size > best / 2 else 0
            best = min(best, size)
            if size <= GOAL or (size <= CERTIFIED and worse >= 2):
                order = np.argsort(-w[:k], kind="stable")
                return w[:k][order], x[:, :k][:, order], float(size), done
        r = r - x @ (x.T @ r)
        if not np.any(r):
            continue
        size = np.linalg.norm(r, axis=0)
        r = np.linalg.qr(r[:, size > 0] / size[size > 0])[0]
        vr, done = product(r), done + 1
        blocks, images = [x, r], [vx, vr]
        if p is not None:
            blocks, images = [*blocks, p], [*images, vp]
        q, make = _basis(blocks)
        vq = np.concatenate(images, 1) @ make
        w, u = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        u = u[:, ::-1][:, :b]
        # the new direction: what the step took from residuals and former directions
        c = make @ u
        c[: x.shape[1]] = 0
        p, vp = np.concatenate(blocks, 1) @ c, np.concatenate(images, 1) @ c
        x, vx = q @ u, vq @ u
    raise RuntimeError(f"residuals did not fall below {CERTIFIED} in {ROUNDS} rounds")


def _prepared(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    return vectors.select(F.col(id).alias("id"), _entries(F.col(vector)).alias("x")).where("x is not null")


def _dimension(rows: DataFrame) -> int:
    """The length that most vectors have."""
    most = rows.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    return most["d"] if most else 0


def fit(vectors: DataFrame, components: int = 16, id: str = "vec_id", vector: str = "embedding") -> Whitening:
    """The whitening of vectors' distinct rows onto their first components."""
    rows = _prepared(vectors, id, vector)
    d = _dimension(rows)
    none = Whitening(0, (0,) * d, np.zeros((d, 0)), np.zeros(0), np.zeros(0), 0.0, 0.0, 0)
    if not d:
        return none
    distinct = _shared.written(rows.where(F.size("x") == d).select("x").distinct(), "fit-list")
    # in 128 bits, then as whole numbers of any size
    sums = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()  # a row a dimension
    n, total = sums[0]["n"], tuple(int(r["s"]) for r in sorted(sums))

    def covariance(w: np.ndarray) -> np.ndarray:
        def times(x):
            c = _centred(x, n, total)
            return c.T @ (c @ w)

        return _summed(distinct, times, d, w.shape) / n

    trace = float(_summed(distinct, lambda x: np.square(_centred(x, n, total)).sum(0), d, (d,)).sum() / n)
    if trace <= 0:
        _shared.drop(distinct)
        return none
    values, x, residual, products = eigenpairs(covariance, d, min(components, d))
    keep = values > EMPTY * trace
    values, x = values[keep], x[:, keep]
    scaled = x / np.sqrt(values)
    own = _summed(distinct, lambda r: np.concatenate([(w := _centred(r, n, total) @ scaled).T @ w, w.sum(0)[None]]), d, (len(values) + 1, len(values)))
    mean = own[-1] / n
    error = float(np.abs(own[:-1] / n - np.outer(mean, mean) - np.eye(len(values))).max())
    _shared.drop(distinct)
    return Whitening(n, total, x, values, values / trace, error, residual, products)


def _centred(x: np.ndarray, n: int, total: tuple[int, ...]) -> np.ndarray:
    """x - S/n: differences of whole numbers where 64 bits hold them, so nothing is lost before the division."""
    if n < 1 << 16:
        return (x * n - np.array(total, np.int64)) / n
    whole = np.array([t // n for t in total], np.int64)
    return (x - whole) - np.array([t % n for t in total]) / n


def _deviation(x: np.ndarray, n: int, total: tuple[int, ...]) -> np.ndarray:
    """The sum over dimensions of (n x - S)**2, exact."""
    if not len(x):
        return np.zeros(0, np.int64)
    if n * int(np.abs(x).max()) + max(map(abs, total)) < 1 << 62:
        off = x * n - np.array(total, np.int64)
        if int(np.abs(off).max()) ** 2 * x.shape[1] < 1 << 63:
            return np.square(off).sum(1)
    exact = [sum((n * v - t) ** 2 for v, t in zip(row, total, strict=True)) for row in x.tolist()]
    if max(exact) >= 1 << 63:
        raise OverflowError("a deviation does not fit 64 bits")
    return np.array(exact, np.int64)


def whiten(vectors: DataFrame, model: Whitening, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and identity_error: a row for each remaining row and component."""
    d, k = len(model.total), len(model.values)
    rows = _prepared(vectors, id, vector).where(F.size("x") == d)
    scaled = model.vectors / np.sqrt(model.values)

    def project(batches):
        for batch in batches:
            m = batch.num_rows
            if not m or not k:
                continue
            x = _rows(batch, d)
            row = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)), pa.array(np.repeat(_deviation(x, model.n, model.total), k)), pa.array((_centred(x, model.n, model.total) @ scaled).reshape(-1)), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = f"id {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return _arrays.run(rows, project, schema).withColumnRenamed("id", id)
