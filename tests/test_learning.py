"""What is learned from vectors, against plain NumPy."""

import numpy as np
import pytest

from riskloom.operators import training


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 5))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int) + (x[:, 2] > 1)
    x[:, 4] = 2.0  # does not vary
    rows = [(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, y))] + [(999, x[0].tolist(), None)]
    return x, y, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)


def test_logistic(data):
    x, y, d = data
    m = training.train_logistic(d, [0, 1, 2], epochs=15, rate=0.7)
    dev = x.std(0, ddof=1)
    z = (x - x.mean(0)) / np.where(dev > 1e-12, dev, 1)
    w, b = np.zeros((3, 5)), np.zeros(3)
    for _ in range(15):
        off = 1 / (1 + np.exp(-(z @ w.T + b))) - np.eye(3)[y]
        w, b = w - 0.7 * off.T @ z / len(z), b - 0.7 * off.mean(0)
    assert np.allclose(m.w[:, :4], w[:, :4], atol=1e-9) and np.allclose(m.b, b, atol=1e-9)
    got = {r.vec_id: r.prediction for r in training.classify(d, m).collect()}
    assert np.mean([got[i] == c for i, c in enumerate(y)]) > 0.75 and 999 in got
    assert training.train_logistic(d.where("label is null"), [0, 1]).w.size == 0


def test_autoencoder(data, tmp_path):
    x, _, d = data
    ae = training.train_autoencoder(d, (4, 3), epochs=5)
    plain = training.Autoencoder(5, (4, 3))
    x = np.r_[x, x[:1]]
    for _ in range(5):
        h = plain.inner(plain.encode(x))
        w, b = plain.decoder[-1]
        off = h @ w.T + b - x
        plain.decoder[-1] = (w - 0.1 * 2 * off.T @ h / len(x) / 5, b - 0.1 * 2 * off.mean(0) / 5)
    e = plain.errors(x)
    got = {r.vec_id: r for r in training.autoencoder_errors(d, ae).collect()}
    assert np.allclose([got[i].error for i in range(240)], e[:240]) and np.isclose(ae.threshold, np.quantile(e, 0.95))
    assert sum(r.is_anomaly for r in got.values()) == (e > np.quantile(e, 0.95)).sum()
    path = str(tmp_path / "m.json")
    training.save_model(ae, path)
    assert np.allclose(training.load_model(path, training.Autoencoder, training.Logistic).errors(x), e)
    training.save_model(ae, f"file://{tmp_path}/shared", d.sparkSession)
    assert np.allclose(training.load_model(f"file://{tmp_path}/shared", training.Autoencoder, spark=d.sparkSession).errors(x), e)


def test_quantiles(spark):
    v = [3.0, 1.0, 1.0, 7.5, 2.0, 2.0, 2.0, None]
    d = spark.createDataFrame([(x,) for x in v], "v double").repartition(3)
    for share in (0.0, 0.2, 0.5, 0.77, 0.95, 1.0):
        assert np.isclose(training.quantile(d, "v", share), np.quantile([x for x in v if x is not None], share))
    assert training.quantile(d.limit(0), "v", 0.5) == 0.0


def test_best_splits(data):
    x, y, d = data
    gini = lambda c: 1 - ((np.bincount(c, minlength=3) / len(c)) ** 2).sum()
    got = {r.dim: r for r in training.best_splits(d, [0, 1, 2]).collect()}
    assert set(got) == {1, 2, 3, 4}
    for j in range(4):
        gains = {t: gini(y) - ((x[:, j] <= t).mean() * gini(y[x[:, j] <= t]) + (x[:, j] > t).mean() * gini(y[x[:, j] > t])) for t in x[:, j] if (x[:, j] > t).any()}
        assert np.isclose(got[j + 1].gain, max(gains.values()), atol=1e-8) and np.isclose(gains[got[j + 1].threshold], max(gains.values()), atol=1e-8)


def test_verdicts(spark):
    s = spark.createDataFrame([(1, 0.9), (2, 0.6), (3, 0.6), (4, 0.1)], "id long, score double")
    assert [(r.id, r.percentile, r.level, r.is_anomaly) for r in training.verdicts(s).orderBy("id").collect()] == [(1, 75.0, "CRITICAL", True), (2, 25.0, "HIGH", True), (3, 25.0, "HIGH", True), (4, 0.0, "LOW", False)]
    assert [r.id for r in training.anomalies(s).collect()] == [1, 2, 3]
    found = training.contributions(np.array([3.0, 0.0, 1.0]), np.zeros(3), lambda x: float(np.abs(x).sum() / 10))
    assert [i for i, _ in found] == [1, 3]
