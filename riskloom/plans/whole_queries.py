"""The scan of all passes. Its twin puts the twins of the passes together, caps and thins them."""

from __future__ import annotations

from riskloom import rules
from riskloom.operators import scan
from riskloom.plans.registry import SQL, query, values
from riskloom.plans.tree_queries import isolation_sql
from riskloom.sources.code import FILES_SQL, files

_VECTORS = f"SELECT f.path AS vec_id, list(coalesce(value, 0e0) ORDER BY n) AS x FROM (SELECT path, CAST(unnest(range(1, 161)) AS INTEGER) AS n FROM ({FILES_SQL})) f LEFT JOIN ({SQL['feature_vector_160']}) v ON v.path = f.path AND v.dim = n GROUP BY f.path"
_ODD = f"{isolation_sql(_VECTORS)} SELECT vec_id AS path, score FROM sc, th WHERE score >= bound"


def _grade(x: str, steps: list[tuple[float, str]], rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {v!r}e0 THEN '{s}'" for v, s in steps) + f" ELSE '{rest}' END"


_LEVELS = ["CRITICAL", "HIGH", "MEDIUM"]
_RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in (("CRITICAL", 4), ("HIGH", 3), ("MEDIUM", 2), ("LOW", 1))) + " ELSE 0 END"
_PATTERNS = [(p.name, p.vuln_class, float(p.severity)) for p in rules.PATTERNS]
_PASSES = [
    (f"({SQL['evidence_lines']})", "static", "1", "'INJECTION'", "'HIGH'", "0.7e0"),
    (f"({SQL['feature_counts']}) WHERE complexity > 20", "static", "1", "'INFORMATION_DISCLOSURE'", "'LOW'", "0.5e0"),
    (f"({SQL['unsafe_casts']})", "semantic", "line_no", "'TYPE_CONFUSION'", "'MEDIUM'", "0.5e0"),
    (f"({SQL['resource_leaks']})", "semantic", "1", "'DENIAL_OF_SERVICE'", "'MEDIUM'", "0.6e0"),
    (f"({SQL['null_derefs']})", "semantic", "line_no", "'DENIAL_OF_SERVICE'", "'HIGH'", "0.7e0"),
    (f"({SQL['privilege_ops']})", "semantic", "line_no", "'PRIVILEGE_ESCALATION'", "'MEDIUM'", "0.6e0"),
    (f"({SQL['tainted_flows']})", "dataflow", "1", "'INJECTION'", "'HIGH'", "0.8e0"),
    (f"({SQL['exploitable_paths']})", "taint", "line_no", "vuln_class", _grade("confidence", list(zip((0.8, 0.6, 0.4), _LEVELS, strict=True)), "LOW"), "confidence"),
    (f"({SQL['pattern_matches']}) m JOIN ({values(_PATTERNS)}) p(pattern, vuln_class, grave) USING (pattern) WHERE fp_reason IS NULL", "rules", "line_no", "vuln_class", _grade("grave", list(zip((0.9, 0.7, 0.5), _LEVELS, strict=True)), "LOW"), "confidence"),
    (f"({SQL['predict_classes']}) WHERE prob >= 0.6e0", "model", "1", "vuln_class", _grade("prob", list(zip((0.9, 0.8, 0.7), _LEVELS, strict=True)), "LOW"), "prob"),
    (f"({_ODD})", "anomaly", "1", "'CODE_EXECUTION'", _grade("score", [(0.8, "HIGH")], "MEDIUM"), "score"),
]
_ALL = " UNION ALL ".join(f"SELECT path AS file_path, CAST({line} AS INTEGER) AS line_start, {cls} AS vuln_class, {severity} AS severity, floor(({confidence}) * 1e6 + 0.5e0) / 1e6 AS confidence, '{name}' AS pass FROM {source}" for source, name, line, cls, severity, confidence in _PASSES)


@query(f"""WITH found AS ({_ALL}), c AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY {_RANK} DESC, confidence DESC, pass || ':' || vuln_class || ':' || line_start) AS place FROM found WHERE confidence >= 0.3e0),
    u AS (SELECT *, row_number() OVER (PARTITION BY file_path, line_start, vuln_class ORDER BY place) AS n FROM c WHERE place <= 50)
    SELECT file_path, line_start, vuln_class, severity, confidence, pass FROM u WHERE n = 1""")
def scan_findings(spark, sf_dir):
    f = files(spark, sf_dir)
    return scan.scan(f, scan.train_detector(f))
