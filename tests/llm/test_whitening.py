"""Whitening against a dense eigendecomposition of the whole covariance."""

import math

import numpy as np
import pytest

from tidewatch.llm import whitening

SHAPE = "vec_id long, embedding array<float>, label int, whitened double, id string, x string"


def dense(vectors, components=4):
    """(n, S, values, vectors, trace) over the distinct fixed-point vectors."""
    dim = max(map(len, vectors))
    x = np.unique(np.array([[math.floor(256.0 * float(c)) for c in v] + [0] * (dim - len(v)) for v in vectors], np.int64), axis=0)
    n, sums = len(x), x.sum(axis=0)
    apart = x - sums / n
    v = apart.T @ apart / n
    values, vectors = np.linalg.eigh(v)
    return n, sums, values[::-1][:components], vectors[:, ::-1][:, :components], np.trace(v)


def hold(df, got):
    vectors = {r.vec_id: r.embedding for r in df.collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)}
    n, sums, values, axes, trace = dense(list(vectors.values()))
    assert {(r.vec_id, r.component) for r in got} == {(i, c) for i in vectors for c in range(1, len(values) + 1)}
    signs = {}
    for r in got:
        x = np.zeros(len(sums), np.int64)
        x[: len(vectors[r.vec_id])] = [math.floor(256.0 * c) for c in vectors[r.vec_id]]
        assert (r.n, r.deviation) == (n, sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True)))
        k = r.component - 1
        want = float((x - sums / n) @ axes[:, k] / math.sqrt(values[k]))
        if abs(want) > 1e-3:
            assert signs.setdefault(k, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(abs(want) - abs(r.whitened)) < 1e-7 * max(1, abs(want))
        assert abs(r.explained - values[k] / trace) < 1e-9 and r.identity_error < 1e-9


def test_whitening_equals_dense_solution(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    known = whitening.fit(df)
    hold(df, whitening.whiten(df, known).collect())
    assert known.residuals.max() <= 1e-10 * known.values[0] and known.passes > 3


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(c) for c in rng.normal(size=5) * (5, 4, 3, 2, 1)], 0, 1.0, "mine", "mine") for k in range(60)]
    rows += [(100 + k, rows[0][1], 0, None, None, None) for k in range(40)] + [rows[1]]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    rows += [(i, v, 0, None, None, None) for i, v in bad] + [(300, [1.0, 2.0], 0, None, None, None), (301, [], 0, None, None, None), (302, [-1e-9, 0.0, 0.0, 0.0, 0.0], 0, None, None, None)]
    df = spark.createDataFrame(rows, SHAPE)
    got = whitening.whiten(df, whitening.fit(df)).collect()
    assert len(got) == 4 * (len(rows) - len(bad))
    hold(df.dropDuplicates(["vec_id"]), [r for r in got if r.vec_id != 1] + [r for r in got if r.vec_id == 1][:4])


def test_small_and_flat_tables(spark):
    none = spark.createDataFrame([], SHAPE)
    assert whitening.whiten(none, whitening.fit(none)).collect() == []
    one = spark.createDataFrame([(None, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(one, whitening.fit(one)).collect()
    assert len(got) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 0.5]) for k in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line, whitening.fit(line)).collect()
    assert {r.component for r in got if r.whitened is not None} == {1} and len(got) == 27 and all(abs(r.explained - (r.component == 1)) < 1e-9 for r in got)


@pytest.mark.parametrize("values", [np.geomspace(1, 1e-6, 40), np.r_[np.full(6, 2.0), np.full(34, 1.0)], np.linspace(1, 0.9, 40)])
def test_lobpcg_alone(values):
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((40, 40)))[0]
    v = (q * values) @ q.T
    for width in (8, 40):
        e, x, residuals = whitening.lobpcg(lambda b: v @ b, 40, 4, width, 200)
        assert np.allclose(e, values[:4], rtol=1e-12) and np.allclose(v @ x, x * e, atol=1e-10) and np.allclose(x.T @ x, np.eye(4), atol=1e-12)


def test_beyond_longs(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df, whitening.fit(df)).collect()
    assert len(got) == 6 and {r.deviation for r in got if r.vec_id != 3} == {None}
