import numpy as np
import pytest

from wayfold.llm import whitening
from wayfold.llm.whitening import eigenpairs, fit, whiten


def plain(vectors, k=16):
    """Of the distinct whole vectors: n, S, and numpy's eigenpairs."""
    x = np.unique(np.floor(np.array(vectors, np.float64) * 64).astype(np.int64) + 1_000_000, axis=0)
    s = x.sum(0)
    c = (x * len(x) - s) / len(x)
    w, u = np.linalg.eigh(c.T @ c / len(x))
    return len(x), s, w[::-1][:k], u[:, ::-1][:, :k], w.sum()


def check(spark, vectors, k=16, tolerance=1e-9):
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(5)
    vectors = [np.float32(v) for v in vectors]
    model = fit(df, k)
    n, s, w, u, trace = plain(vectors, k)
    rows = whiten(df, model).orderBy("vec_id", "component").collect()
    assert len(rows) == len(vectors) * len(w) and {r.n for r in rows} == {n} and model.total == tuple(s.tolist())
    x = np.floor(np.array(vectors, np.float64) * 64).astype(np.int64) + 1_000_000
    want = (x - s / n) @ u / np.sqrt(w)
    got = np.array([r.whitened for r in rows]).reshape(len(vectors), -1)
    got *= np.sign((got * want).sum(0))
    assert np.abs(got - want).max() < tolerance
    assert [r.deviation for r in rows[:: len(w)]] == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    assert np.allclose([r.explained for r in rows[: len(w)]], w / trace, rtol=1e-9)
    assert rows[0].identity_error < 1e-9 and len({r.identity_error for r in rows}) == 1
    return model


def test_equals_the_eigenproblem(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 40)) * np.linspace(1, 2, 40)
    model = check(spark, [*vectors, *vectors[:50], vectors[0]])
    assert model.n == 300 and model.residual < 1e-12


def test_fewer_dimensions_than_components(spark):
    check(spark, np.random.default_rng(2).normal(size=(50, 5)))
    check(spark, np.random.default_rng(2).normal(size=(50, 1)))


def test_many_dimensions_take_rounds():
    """The basis stays far smaller than the space, eigenvalues are close, two are equal."""
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(400, 400)))[0]
    w = np.sort(np.append(rng.uniform(0, 50, 380), np.append(np.linspace(60, 66, 18), [70, 70])))[::-1]
    v = q * w @ q.T
    seen = []
    values, x, residual, products = eigenpairs(lambda b: (seen.append(b.shape), v @ b)[1], 400, 16)
    assert np.allclose(values, w[:16], rtol=1e-12) and residual < 1e-10 and products == len(seen) > 10
    assert np.abs(v @ x - x * values).max() < 1e-8 and np.abs(x.T @ x - np.eye(16)).max() < 1e-12
    assert max(s[1] for s in seen) <= 28


def test_nulls_odd_lengths_and_no_variance(spark):
    schema = "vec_id long, embedding array<float>, x int, id string, n int"
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, [1.0, None, 2.0]), (3, [nan, 1.0, 1.0]), (4, [1.0, -inf, 1.0]), (5, []), (6, [1.0, 2.0])]
    good = [(7, [1.0, 2.0, 3.0]), (8, [2.0, 1.0, 3.0]), (8, [2.0, 1.0, 3.0]), (None, [4.0, 0.5, 3.0])]
    df = spark.createDataFrame([(*r, 1, "a", 2) for r in odd + good], schema)
    model = fit(df)
    rows = whiten(df, model).collect()
    # three distinct vectors, their third entry is the same: two components at most
    assert model.n == 3 and sorted((r.vec_id or 0, r.component) for r in rows) == [(0, 1), (0, 2), (7, 1), (7, 2), (8, 1), (8, 1), (8, 2), (8, 2)]
    assert rows[0].identity_error < 1e-12
    for some in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 8")):
        assert whiten(some, fit(some)).collect() == []


def test_sums_beyond_64_bits_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="below 2"):
        fit(df)
    assert whitening._deviation(np.array([[1 << 26, 5]]), 1 << 3, (0, 1)).tolist() == [(1 << 58) + 39**2]
    with pytest.raises(OverflowError):
        whitening._deviation(np.array([[1 << 40]]), 1 << 3, (0,))
