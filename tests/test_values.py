"""Values worked out by hand from the rules."""

from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions import text as T
from riskloom.operators import advisories, features, flow, matching, risk
from riskloom.sources import code


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def of(spark, name):
    return code.lines(code.corpus(spark).where(F.col("path") == name))


def test_risk_and_cvss(spark):
    d = spark.createDataFrame([("HIGH", c, 0.8, 0.1, "t") for c in ("INJECTION", "CODE_EXECUTION", "AUTHENTICATION_BYPASS", "INFORMATION_DISCLOSURE", "XSS")], "severity string, vuln_class string, confidence double, fp double, tag string")
    got = {r.vuln_class: r for r in risk.prioritize(d).collect()}
    assert abs(got["INJECTION"].risk - 0.64296) < 1e-9 and got["INJECTION"].priority == 3
    assert {k: v.cvss for k, v in got.items()} == {"CODE_EXECUTION": 9.6, "AUTHENTICATION_BYPASS": 9.1, "INJECTION": 8.3, "INFORMATION_DISCLOSURE": 6.5, "XSS": 4.6}


def test_trend_and_empty(spark):
    d = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "ts int, risk double")
    assert risk.trend(d).first()["direction"] == "INCREASING"
    none = spark.createDataFrame([], "severity string, vuln_class string, risk double")
    r = risk.aggregate(none).collect()
    assert [(x.grain, x.value, x.level) for x in r] == [("overall", 0.0, "LOW")]


def test_valid_ids(spark):
    d = spark.createDataFrame([("CVE-2021-44228",), ("CVE-21-1",)], "c string")
    assert [r[0] for r in d.select(advisories.is_valid(F.col("c"))).collect()] == [True, False]


def test_taint_of_app(spark):
    lines = of(spark, "app.py")
    t = flow.propagate(lines)
    assert rows(t, "var", "depth") == [("cmd", 1), ("q", 1), ("safe", 1), ("user", 0)]
    sinks = flow.taint_sinks(lines, t)
    assert [(r[0], r[1], r[2]) for r in rows(sinks.where("exploitable"), "line_no", "sink_type", "var")].count((5, "command", "cmd")) == 2
    assert rows(flow.sanitized(lines, t).where("line_no = 8"), "var") == [("safe",), ("user",)]


def test_c_features(spark):
    f = features.features(code.corpus(spark).where("path = 'overflow.c'")).first()
    assert (f.complexity, f.nesting, f.dangerous) == (2, 3, 2)
    m = code.corpus(spark).where("path = 'overflow.c'").select(T.comment_lines("content", "language").alias("m")).first().m
    assert (m.code, m.comment) == (9, 0)


def test_flow_of_flow(spark):
    lines = of(spark, "flow.py")
    assert rows(flow.def_use(lines), "var", "def_line", "use_line") == [("a", 1, 1), ("a", 1, 2), ("a", 3, 3), ("a", 3, 4), ("b", 2, 2), ("b", 2, 4)]
    assert rows(flow.live(lines), "var", "live_until") == [("a", 4), ("b", 4), ("input", 1)]
    assert rows(flow.closure(flow.dependencies(lines)).where("var = 'b'"), "needs") == [("a",), ("input",)]


def test_secret(spark):
    m = matching.match(of(spark, "secrets.js")).where("pattern = 'Hardcoded Credentials'").first()
    assert abs(m.confidence - 0.56) < 1e-9 and m.fp_reason is None and abs(m.score - 39.2) < 1e-9


def test_custom_rule_adds_matches(spark):
    lines = of(spark, "main.go")
    own = rules.custom_pattern("run", r"func run", "CODE_EXECUTION")
    assert matching.match(lines, [*rules.PATTERNS, own]).count() == matching.match(lines).count() + 1


def test_comment_line_changes_no_code_count(spark):
    d = spark.createDataFrame([("x", "python", "a = 1"), ("y", "python", "a = 1\n# note")], "path string, language string, content string")
    assert [r[0] for r in d.select(T.comment_lines("content", "language")["code"]).collect()] == [1, 1]


def test_read_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("print(1)")
    (tmp_path / "a" / "y.md").write_text("no")
    assert rows(code.read_folder(spark, str(tmp_path), include=["*.py"]), "language", "content") == [("python", "print(1)")]


def test_entry_without_llm(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    e = importlib.import_module("__spark_entry__")
    assert "prioritized" in e.queries() and "pipeline" not in e.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


def test_long_dependency_chain(spark):
    d = spark.createDataFrame([("a", f"x{i + 1}", f"x{i}") for i in range(70)] + [("b", "x1", "x2"), ("b", "x2", "x1")], "path string, var string, needs string")
    got = {tuple(r) for r in flow.closure(d).collect()}
    want = {("a", f"x{i}", f"x{j}") for i in range(71) for j in range(i)}
    assert got == want | {("b", f"x{i}", f"x{j}") for i in (1, 2) for j in (1, 2)}


def test_reachable_chain(spark):
    edges = spark.createDataFrame([("a", i, i + 1) for i in range(12)] + [("a", 12, 3), ("a", 20, 21)], "path string, src int, dst int")
    assert {r.node for r in flow.reachable(edges).collect()} == set(range(13))


def test_control_flow_of_a_file(spark):
    from riskloom.operators import graph
    from riskloom.sources.code import corpus

    f = corpus(spark).where("path = 'overflow.c'")
    nodes = graph.cfg_nodes(f)
    edges = graph.cfg_edges(f, nodes)
    assert sorted((r.node, r.line_start, r.line_end, r.kind) for r in nodes.collect()) == [(0, 0, 0, "entry"), (1, 1, 4, "normal"), (2, 5, 5, "branch"), (3, 6, 7, "normal"), (4, 8, 8, "exit"), (5, 9, 9, "normal")]
    assert sorted((r.src, r.dst, r.edge_type) for r in edges.collect()) == [(0, 1, "fall_through"), (0, 1, "fall_through"), (1, 2, "fall_through"), (2, 3, "branch_true"), (3, 4, "fall_through")]
    g = graph.as_rows(nodes, edges)
    dom = {n: {r.dom for r in graph.dominators(g).collect() if r.node == n} for n in (3, 5)}
    assert dom == {3: {0, 1, 2, 3}, 5: set(range(6))}
    assert [r.node for r in graph.unreachable(g).collect()] == [5] and graph.natural_loops(g).count() == 0


def test_graph_against_its_definitions():
    import random

    from riskloom.operators.graph import Graph

    rng = random.Random(11)
    for _ in range(200):
        n = rng.randint(1, 8)
        g = Graph([{"node": i, "is_exit": rng.random() < 0.3, "leaves": False, "condition": None} for i in range(n)], [{"src": rng.randrange(n), "dst": rng.randrange(n)} for _ in range(rng.randint(0, 14))])

        def reach(start, out, without, stop=()):
            seen, todo = {x for x in start if x != without}, [x for x in start if x != without]
            while todo:
                for b in out[todo.pop()]:
                    if b not in seen and b != without and b not in stop:
                        seen.add(b)
                        todo.append(b)
            return seen

        exits = {i for i in g.ids if g.info[i]["is_exit"]}
        for got, roots, out, stop in ((g.dominators(), {0}, g.out, ()), (g.post_dominators(), exits, g.into, exits)):
            alive = reach(roots, out, None, stop)
            for i in g.ids:
                assert got[i] == ({d for d in g.ids if d == i or i not in reach(roots, out, d, stop)} if i in alive else set(g.ids))
        ways = sorted(g.paths(n - 1))
        assert all(w[:1] == [0] and len(set(w)) == len(w) and n - 1 not in w for w in ways if n > 1)


def test_taint_coverage_of_a_file(spark):
    from riskloom.sources.code import corpus, lines

    d = lines(corpus(spark).where("path = 'app.py'"))
    assert [tuple(r) for r in flow.coverage(d).collect()] == [("app.py", 2, 4, 4, 4, 2, 4)]
    t = flow.propagate(d)
    assert {(r.steps, r.complexity) for r in flow.sink_complexity(flow.taint_sinks(d, t), t).collect()} == {(3, "medium")}


def test_patterns_are_kept(spark, tmp_path):
    from riskloom import rules

    own = rules.custom_pattern("Own", r"abc\d", "XSS", cwes=("CWE-79",))
    path = str(tmp_path / "p.jsonl")
    rules.save_patterns(path, [*rules.PATTERNS, own])
    back = rules.load_patterns(path)
    rules.save_patterns(f"file://{tmp_path}/shared", [*rules.PATTERNS, own], spark)
    assert rules.load_patterns(f"file://{tmp_path}/shared", spark) == back and rules.load_patterns(f"file://{tmp_path}/none", spark) == rules.PATTERNS
    assert back == [*rules.PATTERNS, own] and rules.load_patterns(str(tmp_path / "none")) == rules.PATTERNS
    assert [p.name for p in rules.patterns_of("XSS", "python", "CWE-79", [own])] == ["Own"] and not rules.patterns_of(cwe="CWE-0")
    newer = rules.custom_pattern("Own", "x", "XSS")
    assert rules.update_patterns(back, [newer])[-1] == newer and len(rules.update_patterns(back, [newer])) == len(back)


def test_advisory_section():
    from riskloom.operators import advisories

    assert advisories.section([]) == "No related CVEs found."
    assert advisories.section(["| a |"]).count("\n") == 2


def test_types():
    from riskloom.operators import types

    go = "type Box struct {\n  name string\n  size int\n}\n"
    assert "name" in types.types_of(go, "go")["Box"][0]
    java = "public class Dao {\n  private String id;\n  public String runQuery(String id) {\n    return id;\n  }\n}"
    fields, methods, dangerous = types.types_of(java, "java")["Dao"]
    assert fields == ["id"] and "runQuery" in methods and dangerous
    assert types.types_of("class A(object):\n    self.x = 1", "python") == {"A": ([], [], False)}  # no brace closes it


_JSON = '{"vulnerabilities":[{"cve":{"id":"CVE-1","descriptions":[{"lang":"es","value":"no"},{"lang":"en","value":"yes"}],"metrics":{"cvssMetricV30":[{"cvssData":{"baseScore":5.5}}]},"weaknesses":[{"description":[{"value":"CWE-79"},{"value":"other"}]}],"references":[{"url":"u1"},{"url":"u2"}],"published":"2024-01-02T03:04:05.678"}},{"cve":{"id":"CVE-2","descriptions":[],"metrics":{"cvssMetricV31":[{"cvssData":{"baseScore":9.8}}],"cvssMetricV30":[{"cvssData":{"baseScore":1.0}}]},"weaknesses":[],"references":[],"published":"2024-02-02T03:04:05"}}]}'


def test_advisory_service_and_store(spark, tmp_path):
    from riskloom.sources import advisories

    now, slept, asked = [100.0], [], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    def get(url, headers):
        asked.append((url, headers))
        if "bad" in url:
            raise OSError("down")
        return _JSON

    s = advisories.Service("http://x", "k", per_minute=30, keep=50, get=get, clock=lambda: now[0], sleep=sleep)
    assert s.search(keyword="a b") == _JSON == s.search(keyword="a b") and len(asked) == 1 and slept == []
    assert asked[0] == ("http://x?keywordSearch=a+b&resultsPerPage=100&startIndex=0", {"apiKey": "k"})
    assert s.search(keyword="bad") is None and slept == [2.0]
    now[0] += 60
    assert s.search(keyword="a b") == _JSON and len(asked) == 3

    path = str(tmp_path / "store")
    store = advisories.update(advisories.load(spark, path), s, ["a b", "bad"])
    advisories.save(store, path)
    back = advisories.load(spark, path)
    assert sorted((r.cve_id, r.cvss_v3_score, tuple(r.cwe_ids)) for r in back.collect()) == [("CVE-1", 5.5, ("CWE-79",)), ("CVE-2", 9.8, ())]
    assert [r.cve_id for r in advisories.search(back, "CWE-79", 5.0).collect()] == ["CVE-1"]
    assert advisories.update(back, s, ["a b"]).count() == 2 and advisories.update(back, s, ["bad"]).count() == 2


def test_features_come_back_from_a_vector(spark):
    from riskloom.operators import vectors
    from riskloom.sources.code import corpus

    d = vectors.feature_vectors(corpus(spark)).select("path", vectors.of_vector(F.col("x")).alias("f")).select("path", "f.*")
    got = {r.path: r for r in d.collect()}
    for r in features.features(corpus(spark)).collect():
        assert all(got[r.path][c] == r[c] for c in ("complexity", "nesting", "inputs", "sinks", "dangerous", "taint_flows", "unchecked", "pointers"))
        assert 0 < got[r.path].entropy <= 8 and 0 < got[r.path].diversity <= 1
