"""Forests as tables of nodes: samples, plain recursion, partitions, odd rows, saving, the detector in a scan."""

import numpy as np
import pytest

from riskloom.operators import project, scan, trees
from riskloom.sources import code


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    x[:, 5] = 1.0  # does not vary
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 0.5)
    rows = [(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(6)


def test_each_tree_draws_from_all_rows(spark):
    d = spark.range(4000).selectExpr("id AS vec_id", "array(CAST(id AS FLOAT), CAST(id % 7 AS FLOAT)) AS embedding")
    drawn = trees._samples(d, 100, 256)
    assert len(drawn) == 100 and all(len({r[0] for r in x.tolist()}) == 256 for x in drawn)
    assert len({r[0] for x in drawn for r in x.tolist()}) > 3900
    assert len(trees._samples(d.where("vec_id < 100"), 3, 256)[0]) == 100
    # half of the rows are one row
    same = d.selectExpr("IF(vec_id < 2000, NULL, vec_id) AS vec_id", "IF(vec_id < 2000, array(0f, 0f), embedding) AS embedding")
    assert all(len(x) == 256 for x in trees._samples(same, 5, 256))


def test_forest_learns_and_does_not_depend_on_partitions(data):
    x, y, d = data
    f = trees.grow_forest(d, [0, 1, 2, 3], trees=15, depth=6)
    again = trees.grow_forest(d.repartition(2), [0, 1, 2, 3], trees=15, depth=6)
    assert f.inner == again.inner and f.leaves == again.leaves
    got = {r.vec_id: r for r in trees.classify(d, f).collect()}
    assert np.mean([got[i].prediction == c for i, c in enumerate(y)]) > 0.8 and all(0 < r.confidence <= 1 for r in got.values())
    assert not any(dim == 6 for t in f.inner for dim, _ in t.values())
    for inner, leaves in zip(f.inner, f.leaves, strict=True):
        assert set(inner) | set(leaves) == {1} | {c for k in inner for c in (2 * k, 2 * k + 1)} and not set(inner) & set(leaves)
        assert max(k.bit_length() - 1 for k in leaves) <= 6
    share = {}
    for r in trees.shares(d, f).collect():
        share.setdefault(r.vec_id, []).append(r.share)
    assert all(abs(sum(s) - 1) < 1e-5 and len(s) == 4 for s in share.values())


def test_odd_labels_and_no_rows(data):
    _, _, d = data
    odd = d.selectExpr("vec_id", "embedding", "CASE WHEN vec_id < 200 THEN label WHEN vec_id < 250 THEN 77 END AS label")
    f, same = trees.grow_forest(odd, [0, 1, 2, 3], trees=3), trees.grow_forest(d.where("vec_id < 200"), [0, 1, 2, 3], trees=3)
    assert f.inner == same.inner and trees.classify(odd, f).count() == 300
    assert trees.grow_forest(d.limit(0), [0, 1]).dim == 0
    one = trees.grow_forest(d.where("label = 1"), [0, 1], trees=2)
    assert [list(t) for t in one.leaves] == [[1], [1]] and {r.prediction for r in trees.classify(d, one).collect()} == {1}


def test_isolation_against_plain_recursion(data):
    x, _, d = data
    f = trees.isolation_forest(d, trees=7, sample=64)

    def way(t, node, row):
        if node in f.leaves[t]:
            _, _, n, depth = f.leaves[t][node]
            return depth + trees.average_path_length(n)
        dim, at = f.inner[t][node]
        return way(t, 2 * node + (row[dim - 1] > at), row)

    want = [2 ** (-np.mean([way(t, 1, row) for t in range(7)]) / trees.average_path_length(64)) for row in x]
    got = {r.vec_id: r.score for r in trees.scores(d, f).collect()}
    assert np.allclose([got[i] for i in range(300)], want)
    assert all(sum(n for *_, n, _ in t.values()) == 64 for t in f.leaves)


def test_detector_finds_what_is_far_and_says_why(data, tmp_path):
    x, _, d = data
    spark = d.sparkSession
    far = spark.createDataFrame([(1000, [0.0, 0.0, 9.0, 0.0, 0.0, 1.0], 0), (1001, [0.0, 0.0, 0.0, 8.0, -7.0, 1.0], 0)], d.schema)
    both = d.union(far)
    f = trees.fit_detector(both, contamination=0.02)
    found = {r.vec_id for r in trees.detect(both, f).where("is_anomaly").collect()}
    assert {1000, 1001} <= found and 7 <= len(found) <= 9
    why = {(r.vec_id, r.place): r for r in trees.reasons(both, f).collect()}
    assert why[1000, 1].dim == 3 and {why[1001, 1].dim, why[1001, 2].dim} == {4, 5} and all(r.place <= 5 and r.impact > 0.01 for r in why.values())
    f.save(spark, f"file://{tmp_path}/forest")
    back = trees.load(spark, f"file://{tmp_path}/forest")
    assert back == f
    assert trees.fit_detector(d.limit(0)).dim == 0


def test_detector_in_a_scan(spark):
    usual = [(f"f{i}.py", "python", f"def f{i}(x):\n    return x + {i % 7}\n") for i in range(60)]
    odd = [("odd.py", "python", "\n".join(f"    if a{i} and b{i} or ((({i}))):\n        for x in [[{i}]]:\n            while y: c = {i}" for i in range(40)))]
    files = spark.createDataFrame(usual + odd, "path string, language string, content string")
    detector = scan.train_detector(files, contamination=0.01)
    found = project.findings_of(files, detector).where("pass = 'anomaly'").collect()
    assert [(r.file_path, r.vuln_class, r.line_start, r.title) for r in found] == [("odd.py", "CODE_EXECUTION", 1, "Anomalous code pattern detected")]
    assert scan.scan(files).where("pass = 'anomaly'").count() == 0
    assert scan.scan(code.corpus(spark), trees.Forest("isolation", 0)).where("pass = 'anomaly'").count() == 0
