"""Intervals against sets, counts against lists, long chains of forks, chains of taint."""

import random
import warnings
from itertools import islice

from riskloom.operators import flow, graph
from riskloom.sources import code


def made(n, edges, exits=()):
    return graph.Graph([{"node": i, "is_exit": i in exits, "condition": None, "leaves": False} for i in range(n)], [{"src": a, "dst": b} for a, b in edges])


def test_intervals_say_what_sets_say():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 12)
        g = made(n, [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 20))], set(rng.sample(range(n), rng.randint(0, min(2, n)))))
        for tree, sets in ((g.dominator_tree(), g.dominators()), (g.post_dominator_tree(), g.post_dominators())):
            assert all(graph.dominates(tree, a, b) == (a in sets[b]) for a in range(n) for b in range(n))
            assert sorted(enter for _, enter, _ in tree.values()) == list(range(len(tree)))


def test_ways_are_counted_as_they_are_listed():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 8)
        g = made(n, sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(14)) if a < b}))
        assert g.ways() == {i: len(list(g.paths(i))) for i in range(n) if list(g.paths(i))}
    loop = made(4, [(0, 1), (1, 2), (2, 1), (2, 3), (1, 3)])
    assert loop.ways() == {0: 1, 1: 1, 2: 1, 3: 2} and loop.components() == {0: 0, 1: 1, 2: 1, 3: 3}


def test_forty_forks_in_a_row(spark):
    edges = [e for i in range(40) for e in ((3 * i, 3 * i + 1), (3 * i, 3 * i + 2), (3 * i + 1, 3 * i + 3), (3 * i + 2, 3 * i + 3))]
    g = made(121, edges)
    assert g.ways()[120] == 2**40 and len(list(islice(g.paths(120), 5000))) == 5000
    nodes = [(i, i == 120, None, False) for i in range(121)]
    rows = spark.createDataFrame([("f", nodes, edges), ("g", nodes, edges + [(0, 1)] * 2)], "path string, nodes array<struct<node:int,is_exit:boolean,condition:string,leaves:boolean>>, edges array<struct<src:int,dst:int>>")
    assert {(r.path, r.ways) for r in graph.ways_to(rows).where("node = 120").collect()} == {("f", 2**40), ("g", 2**41)}
    tree = {r.node: r for r in graph.dominator_trees(rows).where("path = 'f'").collect()}
    assert tree[0].idom is None and tree[3].idom == 0 and tree[120].idom == 117
    long = made(140, [e for i in range(69) for e in ((2 * i, 2 * i + 1), (2 * i, 2 * i + 2), (2 * i + 1, 2 * i + 2))])
    assert long.ways()[138] == 2**69


def test_chains_of_taint(spark):
    names = [f"k{chr(97 + i)}" for i in range(15)]
    text = "src = input()\n" + "\n".join(f"{b} = {a} + 1" for a, b in zip(names, names[1:], strict=False)) + "\nka = src\nw = src\nw = ka\nexec(kc)\neval(w)"
    lines = code.lines(spark.createDataFrame([("f.py", "python", text)], "path string, language string, content string"))
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        ten = {r.var: r for r in flow.provenance(lines).collect()}
    assert max(r.depth for r in ten.values()) == 10 and any("10 rounds" in str(w.message) for w in said)
    all_ = {r.var: r for r in flow.provenance(lines, None).collect()}
    assert all_["ko"].depth == 15 and all_["w"].parent == "src" and all_["w"].line_no == 17
    steps = {r.var: [(s.line_no, s.var) for s in r.steps] for r in flow.chains(flow.provenance(lines, None)).collect()}
    assert steps["kc"] == [(1, "src"), (16, "ka"), (2, "kb"), (3, "kc")] and steps["ko"][-1] == (15, "ko") and len(steps["ko"]) == 16
    got = {(r.line_no, r.var, r.source, r.source_line) for r in flow.taint_chains(lines).collect()}
    assert {(19, "kc", "src", 1), (20, "w", "src", 1)} <= got
    ranges = flow.tainted_ranges(lines)
    from pyspark.sql import functions as F

    assert flow.is_tainted_at(ranges, F.lit("src"), F.lit(5)).count() == 1 and flow.is_tainted_at(ranges, F.lit("zz"), F.lit(5)).count() == 0
