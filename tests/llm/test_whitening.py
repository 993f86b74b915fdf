"""Whitening: NumPy's covariance and eigenvectors, exact sums, hard rows."""

import numpy as np
import pytest

from riskloom.llm import whitening


def plain(x, k=8):
    x = np.array(x, dtype=object)
    n, s = len(x), x.sum(axis=0)
    off = ((x * n - s) / n).astype(float)
    e, v = np.linalg.eigh(off.T @ off / n)
    e, v = e[::-1], v.T[::-1]
    return ((x * n - s) ** 2).sum(axis=1), off @ v[:k].T / np.sqrt(e[:k]), e / e.sum()


@pytest.mark.parametrize("a", [np.zeros((3, 3)), np.diag([1.0, 3.0, 1.0]), np.array([[2.0]]), np.ones((5, 5)), np.cov(np.random.default_rng(1).normal(size=(30, 200))) * 1e9, np.tri(6) + np.tri(6).T])
def test_eigen(a):
    e, v = whitening.symmetric_eigen(a)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], rtol=1e-12, atol=1e-12 * max(1, abs(a).max()))
    assert np.allclose(v @ v.T, np.eye(len(a)), atol=1e-12) and np.allclose(v.T @ np.diag(e) @ v, a, atol=1e-12 * max(1, abs(a).max()))


def test_report_against_numpy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = sorted(table.collect())
    x = np.floor(1024 * np.array([r.embedding for r in rows], float)).astype(int) + 100000
    deviation, white, explained = plain(x)
    got = sorted(whitening.report(table.repartition(40)).collect(), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in got] == [(r.vec_id, k) for r in rows for k in range(1, 9)]
    assert [r.deviation for r in got[::8]] == deviation.tolist() and {r.n for r in got} == {len(rows)}
    made = np.array([r.whitened for r in got]).reshape(-1, 8)
    assert np.allclose(made * np.sign((made * white).sum(axis=0)), white, atol=1e-9)
    assert np.allclose([r.explained for r in got[:8]], explained[:8], rtol=1e-12)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (2, [0.3, -0.2]), (2, [0.3, -0.2]), (None, [0.0, 1.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.report(df.withColumns({"x": df.vec_id, "n": df.vec_id, "whitened": df.vec_id, "deviation": df.vec_id})).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in got) == sorted((i, k, 4) for i in ("1", "2", "2", "None") for k in (1, 2))
    x = np.floor(1024 * np.array([[0.1, 0.2], [0.3, -0.2], [0.3, -0.2], [0, 1.0]], np.float32).astype(float)).astype(int) + 100000
    assert sorted(r.deviation for r in got[::2]) == sorted(plain(x, 2)[0])
    for none in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 2"), df.where("vec_id > 4 and vec_id < 9")):
        assert whitening.report(none).count() == 0
    assert whitening.report(df.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_huge_entries_and_constant_dimensions(spark):
    rows = [(i, [1e300 * (-1) ** i, 5.0, float(i)]) for i in range(20)]
    got = whitening.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1} and {r.deviation for r in got} == {None} and got[0].identity_error < 1e-9


def test_doubles_are_whitened_too(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7), float(i % 3)]) for i in range(50)], "id long, v array<double>").repartition(7)
    model = whitening.fit(whitening.usable(df, "v"), "v")
    out = whitening.whitened(df, "v", model, ["id"])
    assert model.n == 50 and np.allclose(model.mean, np.array(model.sums) / 50) and whitening.identity_error(out) < 1e-12 and out.columns == ["id", "whitened"]
