"""Queries on semantics, data flow, taint and control flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import model, rules
from riskloom.operators import flow, graph, scan
from riskloom.plans.registry import q, query, values
from riskloom.sources.code import FILES_SQL, LINES_SQL, files, texts

_BASE = f"WITH RECURSIVE files AS ({FILES_SQL}), {LINES_SQL}, st AS (SELECT * FROM (SELECT path, language, CAST(line_no AS INTEGER) AS line_no, trim(text, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS text FROM lines) WHERE text <> '')"


def _table(name, rows, cols):
    return f"{name}({cols}) AS ({values(rows)})"


def _lines(spark, sf_dir):
    return texts(files(spark, sf_dir))


def _joined(name):
    return F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(name)


def _case(table, one, default):
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {one(v)}" for k, v in table.items() if k != "*") + f" ELSE {one(table['*']) if '*' in table else default} END"


def _any(regexes):
    return "(" + " OR ".join(f"regexp_matches(text, {q(r)})" for r in regexes) + ")"


@query(f"{_BASE}, {_table('r', [(k, i, x) for k, v in rules.CASTS.items() for i, x in enumerate(v)], 'language, regex_no, regex')} SELECT path, CAST(line_no AS INTEGER) AS line_no, regex_no FROM lines JOIN r USING (language) WHERE regexp_matches(text, regex)")
def unsafe_casts(spark, sf_dir):
    return flow.unsafe_casts(_lines(spark, sf_dir))


def _count(table):
    return _case(table, lambda v: " + ".join(f"len(regexp_extract_all(content, {q(r)}))" for r in v), "0")


@query(f"{_BASE} SELECT * FROM (SELECT path, CAST({_count(rules.OPENS)} AS INTEGER) AS opens, CAST({_count(rules.CLOSES)} AS INTEGER) AS closes FROM files) WHERE opens > closes")
def resource_leaks(spark, sf_dir):
    return flow.resource_leaks(files(spark, sf_dir))


@query(f"{_BASE} SELECT path, CAST(line_no AS INTEGER) AS line_no FROM lines WHERE {_any(['(?i)' + r for r in rules.PRIVILEGES])}")
def privilege_ops(spark, sf_dir):
    return flow.privilege_lines(_lines(spark, sf_dir))


_SYMBOLS = f"""{_table('decl', [(k, i, kind, r) for k, v in rules.DECLARATIONS.items() for i, (kind, r) in enumerate(v)], 'language, rank, kind, regex')},
    sy0 AS (SELECT path, line_no, rank, kind, unnest(regexp_extract_all(text, regex, 1)) AS name, {_case(rules.INPUTS, _any, 'false')} AS tainted FROM st JOIN decl USING (language)),
    symbols AS (SELECT path, name, kind, line_no, tainted FROM (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY line_no DESC, rank DESC) AS n FROM sy0) WHERE n = 1)"""


@query(f"{_BASE}, {_SYMBOLS} SELECT path, name, kind, line_no, tainted FROM symbols")
def symbol_table(spark, sf_dir):
    return flow.symbols(_lines(spark, sf_dir))


@query(f"""{_BASE}, {_SYMBOLS}, {_table('kw', list(rules.KEYWORDS.items()), 'language, words')}, c AS (SELECT path, language, line_no, unnest(regexp_extract_all(text, '([a-zA-Z_][a-zA-Z0-9_]*(?:\\.[a-zA-Z_][a-zA-Z0-9_]*)*)\\s*\\(', 1)) AS callee FROM lines)
    SELECT DISTINCT c.path, symbols.name AS caller, callee FROM c JOIN symbols ON symbols.path = c.path AND symbols.kind = 'function' AND c.line_no >= symbols.line_no LEFT JOIN kw USING (language) WHERE words IS NULL OR NOT list_contains(words, callee)""")
def call_graph(spark, sf_dir):
    return flow.calls(_lines(spark, sf_dir))


_ASSIGN = {**rules.ASSIGNMENTS, "*": [r"([a-zA-Z_]\w*)\s*=\s*(.+)"]}
_DEFS = f"""{_table('asg', [(k, i, r, "(.+)" in r) for k, v in _ASSIGN.items() for i, r in enumerate(v)], 'lang, rank, regex, has_expr')}, langs AS (SELECT DISTINCT lang FROM asg),
    d0 AS (SELECT st.*, regex, has_expr, {_case(rules.INPUTS, _any, 'false')} AS tainted FROM st JOIN asg ON lang = CASE WHEN language IN (SELECT lang FROM langs) THEN language ELSE '*' END WHERE contains(text, '=')),
    d1 AS (SELECT path, language, line_no, tainted, unnest(regexp_extract_all(text, regex, 1)) AS var, unnest(regexp_extract_all(text, regex, 2)) AS expr FROM d0 WHERE has_expr
        UNION ALL SELECT path, language, line_no, tainted, unnest(regexp_extract_all(text, regex, 1)), '' FROM d0 WHERE NOT has_expr)"""


@query(f"{_BASE}, {_DEFS} SELECT path, line_no, var, expr, tainted FROM d1")
def definitions(spark, sf_dir):
    return flow.definitions(_lines(spark, sf_dir)).select("path", "line_no", "var", "expr", "tainted")


_WORDS = {k: sorted({*v, *rules.BUILTINS[k]}) for k, v in rules.KEYWORDS.items()}
_USES = f"{_table('kw2', list(_WORDS.items()), 'language, words')}, u0 AS (SELECT DISTINCT path, language, line_no, unnest(regexp_extract_all(text, {q(flow.IDENT)})) AS var FROM st), uses AS (SELECT path, line_no, var FROM u0 LEFT JOIN kw2 USING (language) WHERE words IS NULL OR NOT list_contains(words, var))"
_REACH = "r0 AS (SELECT DISTINCT path, var, line_no AS def_line FROM d1), reaching AS (SELECT *, lead(def_line) OVER (PARTITION BY path, var ORDER BY def_line) - 1 AS until FROM r0)"


@query(f"{_BASE}, {_DEFS}, {_REACH} SELECT path, var, def_line, until FROM reaching")
def reaching_defs(spark, sf_dir):
    return flow.reaching(_lines(spark, sf_dir))


@query(f"{_BASE}, {_USES} SELECT path, var, max(line_no) AS live_until FROM uses GROUP BY 1, 2")
def live_vars(spark, sf_dir):
    return flow.live_of(files(spark, sf_dir))


@query(f"{_BASE}, {_DEFS}, {_REACH}, {_USES} SELECT uses.path, uses.var, def_line, line_no AS use_line FROM uses JOIN reaching ON uses.path = reaching.path AND uses.var = reaching.var AND line_no >= def_line AND (until IS NULL OR line_no <= until)")
def def_use_chains(spark, sf_dir):
    return flow.def_use(_lines(spark, sf_dir))


@query(f"""{_BASE}, {_DEFS}, {_USES}, {_table('snk', [(k, i, r) for k, v in rules.SINKS.items() for i, r in enumerate(v)], 'language, sink_no, regex')}, sat AS (SELECT path, line_no, sink_no FROM st JOIN snk USING (language) WHERE regexp_matches(text, regex)),
    t AS (SELECT DISTINCT path, var, line_no AS def_line FROM d1 WHERE tainted)
    SELECT t.path, t.var, def_line, uses.line_no AS use_line, sink_no FROM t JOIN uses ON uses.path = t.path AND uses.var = t.var JOIN sat ON sat.path = t.path AND sat.line_no = uses.line_no""")
def tainted_flows(spark, sf_dir):
    return flow.tainted_paths(_lines(spark, sf_dir))


_DEPS = f"deps AS (SELECT DISTINCT path, var, unnest(regexp_extract_all(expr, {q(flow.IDENT)})) AS needs FROM d1)"


@query(f"{_BASE}, {_DEFS}, {_DEPS} SELECT path, var, needs FROM deps")
def data_dependencies(spark, sf_dir):
    return flow.dependencies(_lines(spark, sf_dir))


@query(f"{_BASE}, {_DEFS}, {_DEPS}, cl AS (SELECT path, var, needs FROM deps UNION SELECT cl.path, cl.var, deps.needs FROM cl JOIN deps ON deps.path = cl.path AND deps.var = cl.needs) SELECT path, var, needs FROM cl")
def dependency_closure(spark, sf_dir):
    return flow.closure(flow.dependencies(_lines(spark, sf_dir)))


_VAR = _case(rules.ASSIGNED, lambda r: f"nullif(regexp_extract(text, {q(r)}, 1), '')", "NULL")
_KINDS = ["(0, 'user_input', " + _case(rules.USER_INPUT, _any, "false") + ")", *[f"({i + 1}, '{k}', {_any(v)})" for i, (k, v) in enumerate(rules.TAINT_SOURCES.items())]]
_SOURCES = f"""asl AS (SELECT path, language, line_no, text, {_VAR} AS var FROM st WHERE contains(text, '=')), s0 AS ({' UNION ALL '.join(f"SELECT path, line_no, var, {k[1]} AS rank, {k.split(', ', 2)[1]} AS source_type FROM asl WHERE var IS NOT NULL AND {k.split(', ', 2)[2][:-1]}" for k in _KINDS)}),
    sources AS (SELECT path, var, source_type, line_no FROM (SELECT *, row_number() OVER (PARTITION BY path, var ORDER BY line_no DESC, rank DESC) AS n FROM s0) WHERE n = 1)"""


@query(f"{_BASE}, {_SOURCES} SELECT path, var, source_type, line_no FROM sources")
def taint_sources(spark, sf_dir):
    return flow.taint_sources(_lines(spark, sf_dir))


_SPREAD = f"""{_SOURCES}, pr AS (SELECT path, var, 0 AS depth FROM sources UNION SELECT pr.path, asl.var, depth + 1 FROM pr JOIN asl ON asl.path = pr.path AND contains(asl.text, pr.var) AND asl.var IS NOT NULL WHERE depth < 10),
    tainted AS (SELECT path, var, min(depth) AS depth, 0.9e0 * pow(0.95e0, CAST(min(depth) AS DOUBLE)) AS confidence FROM pr GROUP BY path, var)"""


@query(f"{_BASE}, {_SPREAD} SELECT path, var, CAST(depth AS INTEGER) AS depth, floor(confidence * 1e6 + 0.5e0) / 1e6 AS confidence FROM tainted")
def taint_propagation(spark, sf_dir):
    return flow.propagate(_lines(spark, sf_dir)).withColumn("confidence", F.floor(F.col("confidence") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6))


_SINKS = f"""{_SPREAD}, {_table('tsk', [(k, i, r) for k, v in rules.TAINT_SINKS.items() for i, r in enumerate(v)], 'sink_type, regex_no, regex')},
    sinks AS (SELECT st.path, line_no, var, sink_type, regex_no, NOT regexp_matches(text, {q(rules.PROTECTIONS)}) AS exploitable FROM st JOIN tainted ON tainted.path = st.path AND contains(text, var) JOIN tsk ON regexp_matches(text, regex))"""


@query(f"{_BASE}, {_SINKS} SELECT path, line_no, var, sink_type, regex_no, exploitable FROM sinks")
def taint_sinks(spark, sf_dir):
    d = _lines(spark, sf_dir)
    return flow.taint_sinks(d, flow.propagate(d))


@query(f"{_BASE}, {_SPREAD}, {_table('san', [(k, x) for k, v in rules.SANITIZERS.items() for x in v], 'language, word')} SELECT st.path, tainted.var, max(line_no) AS line_no FROM st JOIN san ON san.language = st.language AND contains(text, word) JOIN tainted ON tainted.path = st.path AND contains(text, tainted.var) GROUP BY 1, 2")
def taint_sanitized(spark, sf_dir):
    d = _lines(spark, sf_dir)
    return flow.sanitized(d, flow.propagate(d))


@query(f"""{_BASE}, {_SINKS}, via AS (SELECT t.path, t.var, min((asl.line_no, p.var)) AS v FROM tainted t JOIN asl ON asl.path = t.path AND asl.var = t.var JOIN tainted p ON p.path = t.path AND p.depth = t.depth - 1 AND contains(asl.text, p.var) WHERE t.depth > 0 GROUP BY 1, 2),
    ch AS (SELECT path, var, var AS source, line_no || ':' || var AS steps FROM sources UNION ALL SELECT ch.path, via.var, source, steps || ',' || v[1] || ':' || via.var FROM ch JOIN via ON via.path = ch.path AND v[2] = ch.var)
    SELECT sinks.path, sinks.line_no, sinks.var, sink_type, regex_no, source, s.line_no AS source_line, s.source_type, steps FROM sinks JOIN ch ON ch.path = sinks.path AND ch.var = sinks.var JOIN sources s ON s.path = ch.path AND s.var = ch.source""")
def taint_chains(spark, sf_dir):
    d = flow.taint_chains(_lines(spark, sf_dir))
    return d.withColumn("steps", F.array_join(F.transform("steps", lambda x: F.concat_ws(":", x["line_no"].cast("string"), x["var"])), ","))


def _pick(table, default):
    return "CASE sink_type " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in table.items()) + f" ELSE {q(default)} END"


@query(f"""{_BASE}, {_SINKS} SELECT sinks.path, line_no, sinks.var, sink_type, regex_no, {_pick(model.SINK_CLASS, 'INJECTION')} AS vuln_class, {_pick(model.SINK_CWE, 'CWE-20')} AS cwe_id, {_pick(model.SINK_ADVICE, 'Sanitize user input before use')} AS advice,
    floor(confidence * 1e6 + 0.5e0) / 1e6 AS confidence FROM sinks JOIN tainted ON tainted.path = sinks.path AND tainted.var = sinks.var WHERE exploitable""")
def exploitable_paths(spark, sf_dir):
    d = _lines(spark, sf_dir)
    t = flow.propagate(d)
    return flow.exploitable(flow.taint_sinks(d, t), t).withColumn("confidence", F.floor(F.col("confidence") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6))


@query(f"""{_BASE}, k AS (SELECT path, line_no, text, CASE WHEN {_case(rules.IFS, lambda r: f'regexp_matches(text, {q(r)})', 'false')} THEN 'if' WHEN {_case(rules.ELSES, lambda r: f'regexp_matches(text, {q(r)})', 'false')} THEN 'else'
        WHEN {_case(rules.LOOPS, lambda r: f'regexp_matches(text, {q(r)})', 'false')} THEN 'loop' WHEN regexp_matches(text, {q(rules.RETURNS)}) THEN 'return' END AS kind FROM st)
    SELECT path, line_no, kind, coalesce(nullif(regexp_extract(text, '(?:if|while|for)\\s*\\(([^)]+)\\)', 1), ''), regexp_extract(text, '(?:if|while|for)\\s+(.+):', 1)) AS condition FROM k WHERE kind IS NOT NULL""")
def control_lines(spark, sf_dir):
    return flow.control_lines(_lines(spark, sf_dir))


_SYMBOL_FLOWS = f"""{_table('snk2', [(k, i, r) for k, v in rules.SINKS.items() for i, r in enumerate(v)], 'language, sink_no, regex')},
    tsf AS (SELECT lines.path, line_no, name AS var, sink_no FROM lines JOIN snk2 USING (language) JOIN (SELECT path, name FROM symbols WHERE tainted) s ON s.path = lines.path WHERE regexp_matches(text, regex) AND contains(text, name))"""


@query(f"{_BASE}, {_SYMBOLS}, {_SYMBOL_FLOWS} SELECT path, CAST(line_no AS INTEGER) AS line_no, var, sink_no FROM tsf")
def tainted_symbols(spark, sf_dir):
    return flow.tainted_symbols(_lines(spark, sf_dir))


@query(f"""{_BASE}, {_SYMBOLS}, {_SYMBOL_FLOWS}, {_table('cst', [(k, i, x) for k, v in rules.CASTS.items() for i, x in enumerate(v)], 'language, regex_no, regex')}, lk AS (SELECT path, CAST({_count(rules.OPENS)} AS INTEGER) AS opens, CAST({_count(rules.CLOSES)} AS INTEGER) AS closes FROM files),
    bf AS (SELECT path, language, line_no, ls[line_no] AS text, array_to_string(ls[greatest(line_no - 3, 1):line_no], chr(10)) AS before FROM l1), nr(language, regex) AS ({values(list(rules.NULLS.items()))}), na AS (SELECT path, line_no AS assign_line, unnest(regexp_extract_all(text, regex, 1)) AS var FROM bf JOIN nr USING (language))
    SELECT path, 'tainted_flow' AS kind, CAST(line_no AS INTEGER) AS line_no, 0.8e0 AS confidence FROM tsf UNION ALL SELECT path, 'unsafe_cast', CAST(line_no AS INTEGER), 0.5e0 FROM lines JOIN cst USING (language) WHERE regexp_matches(text, regex)
    UNION ALL SELECT path, 'resource_leak', 1, 0.6e0 FROM lk WHERE opens > closes
    UNION ALL SELECT bf.path, 'null_deref', CAST(line_no AS INTEGER), 0.7e0 FROM bf JOIN na ON na.path = bf.path AND line_no >= assign_line AND (contains(text, var || '.') OR contains(text, var || '->')) WHERE NOT regexp_matches(before, 'if\\s*\\(?\\s*' || var || '\\s*(?:!=|!==)\\s*(?:NULL|nullptr|null|None)')
    UNION ALL SELECT path, 'privilege_escalation', CAST(line_no AS INTEGER), 0.6e0 FROM lines WHERE {_any(['(?i)' + r for r in rules.PRIVILEGES])}""")
def semantic_patterns(spark, sf_dir):
    f = files(spark, sf_dir)
    return flow.semantic_patterns(f, texts(f), scan.null_derefs(f))


_FN, _CLS = r"(?:def|function|func|fn)\s+(\w+)", r"class\s+(\w+)"


@query(f"""{_BASE}, sc0 AS (SELECT path, line_no, regexp_extract(text, {q(_FN)}, 1) AS fn, regexp_extract(text, {q(_CLS)}, 1) AS cls, regexp_matches(text, '^\\s*\\}}\\s*$') AS ends FROM lines),
    sc1 AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS rn FROM sc0 WHERE fn <> '' OR cls <> '' OR ends),
    sc AS (SELECT path, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS line_no, 'global' AS scope FROM sc1 WHERE rn = 1 UNION ALL SELECT sc.path, sc1.rn, sc1.line_no, CASE WHEN fn <> '' THEN scope || '.' || fn WHEN cls <> '' THEN cls WHEN scope = 'global' THEN scope WHEN contains(scope, '.') THEN regexp_replace(scope, '\\.[^.]*$', '') ELSE 'global' END FROM sc JOIN sc1 ON sc1.path = sc.path AND sc1.rn = sc.rn + 1)
    SELECT path, CAST(line_no AS INTEGER) AS line_no, scope FROM sc WHERE rn > 0""")
def scopes(spark, sf_dir):
    return flow.scopes(files(spark, sf_dir))


_RANGES = f"""{_DEFS}, tr0 AS (SELECT path, var, line_no AS from_line, bool_or(tainted) AS tainted FROM d1 GROUP BY 1, 2, 3), tr1 AS (SELECT *, lead(from_line) OVER (PARTITION BY path, var ORDER BY from_line) - 1 AS until FROM tr0),
    tr AS (SELECT tr1.path, var, from_line, coalesce(until, last_line) AS to_line FROM tr1 JOIN (SELECT path, max(line_no) AS last_line FROM lines GROUP BY path) m ON m.path = tr1.path WHERE tainted)"""


@query(f"{_BASE}, {_RANGES} SELECT path, var, from_line, CAST(to_line AS INTEGER) AS to_line FROM tr")
def tainted_ranges(spark, sf_dir):
    return flow.tainted_ranges(_lines(spark, sf_dir))


@query(f"{_BASE}, {_RANGES} SELECT lines.path, CAST(line_no AS INTEGER) AS line_no, string_agg(DISTINCT var, ',' ORDER BY var) AS vars FROM lines JOIN tr ON tr.path = lines.path AND line_no BETWEEN from_line AND to_line GROUP BY 1, 2")
def tainted_at_lines(spark, sf_dir):
    return flow.tainted_at(flow.tainted_ranges(_lines(spark, sf_dir))).select("path", "line_no", F.array_join("vars", ",").alias("vars"))


@query(f"""{_BASE}, {_DEFS}, {_USES}, {_table('snk', [(k, i, r) for k, v in rules.SINKS.items() for i, r in enumerate(v)], 'language, sink_no, regex')}, sat AS (SELECT path, line_no, sink_no FROM st JOIN snk USING (language) WHERE regexp_matches(text, regex)),
    t AS (SELECT DISTINCT path, var, line_no AS def_line FROM d1 WHERE tainted)
    SELECT t.path, t.var, def_line, sink_no, array_to_string(range(def_line, uses.line_no + 1), ',') AS way FROM t JOIN uses ON uses.path = t.path AND uses.var = t.var JOIN sat ON sat.path = t.path AND sat.line_no = uses.line_no""")
def tainted_ways(spark, sf_dir):
    d = flow.tainted_paths(_lines(spark, sf_dir)).withColumn("way", flow.line_path(F.col("def_line"), F.col("use_line")))
    return d.select("path", "var", "def_line", "sink_no", _joined("way"))


@query(f"""{_BASE}, {_SINKS}, {_table('san', [(k, x) for k, v in rules.SANITIZERS.items() for x in v], 'language, word')}, sz AS (SELECT DISTINCT st.path, tainted.var FROM st JOIN san ON san.language = st.language AND contains(text, word) JOIN tainted ON tainted.path = st.path AND contains(text, tainted.var)),
    c1 AS (SELECT path, count(*) AS sources FROM s0 GROUP BY path), c2 AS (SELECT path, count(*) AS tracked FROM tainted GROUP BY path), c3 AS (SELECT path, count(*) AS sinks, count(*) FILTER (exploitable) AS exploitable FROM sinks GROUP BY path), c4 AS (SELECT path, count(*) AS sanitized FROM sz GROUP BY path)
    SELECT c1.path, sources, tracked, coalesce(sinks, 0) AS sinks, coalesce(sinks, 0) AS reached, coalesce(sanitized, 0) AS sanitized, coalesce(exploitable, 0) AS exploitable FROM c1 JOIN c2 USING (path) LEFT JOIN c3 USING (path) LEFT JOIN c4 USING (path)""")
def taint_coverage(spark, sf_dir):
    return flow.coverage(_lines(spark, sf_dir))


@query(f"{_BASE}, {_SINKS} SELECT sinks.path, line_no, sinks.var, sink_type, regex_no, CAST(depth + 2 AS INTEGER) AS steps, CASE WHEN depth + 2 <= 2 THEN 'low' WHEN depth + 2 <= 5 THEN 'medium' ELSE 'high' END AS complexity FROM sinks JOIN tainted ON tainted.path = sinks.path AND tainted.var = sinks.var")
def sink_complexity(spark, sf_dir):
    d = _lines(spark, sf_dir)
    t = flow.propagate(d)
    return flow.sink_complexity(flow.taint_sinks(d, t), t)


_KIND = f"CASE WHEN {_case(rules.IFS, lambda r: f'regexp_matches(text, {q(r)})', 'false')} THEN 'if' WHEN {_case(rules.ELSES, lambda r: f'regexp_matches(text, {q(r)})', 'false')} THEN 'else' WHEN {_case(rules.LOOPS, lambda r: f'regexp_matches(text, {q(r)})', 'false')} THEN 'loop' WHEN regexp_matches(text, {q(rules.RETURNS)}) THEN 'return' END"
_COND = "coalesce(nullif(regexp_extract(text, '(?:if|while|for)\\s*\\(([^)]+)\\)', 1), ''), regexp_extract(text, '(?:if|while|for)\\s+(.+):', 1))"
_CFG = f"""k1 AS (SELECT path, line_no, text, {_KIND} AS kind, {_COND} AS condition, regexp_matches(text, '\\b(break|return|throw|raise)\\b') AS leaves FROM st),
    k2 AS (SELECT *, lag(kind) OVER (PARTITION BY path ORDER BY line_no) AS prev, row_number() OVER (PARTITION BY path ORDER BY line_no) AS rn FROM k1),
    k3 AS (SELECT *, kind IS NULL AND (rn = 1 OR prev IS NOT NULL) OR coalesce(kind IN ('if', 'loop', 'return'), false) AS begins, CASE WHEN kind IN ('if', 'loop', 'return') THEN line_no + 1 WHEN kind = 'else' AND rn > 1 AND prev IS NULL THEN line_no END AS starts FROM k2),
    k4 AS (SELECT *, coalesce(last_value(starts IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS begin_at,
        min(CASE WHEN kind IS NOT NULL THEN line_no END) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
        sum(CAST(begins AS INTEGER)) OVER (PARTITION BY path ORDER BY line_no) AS node, max(CASE WHEN kind IN ('if', 'loop') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS opened FROM k3),
    nl AS (SELECT path, max(line_no) AS n_lines FROM lines GROUP BY path),
    cn AS (SELECT path, CAST(0 AS INTEGER) AS node, CAST(0 AS INTEGER) AS line_start, CAST(0 AS INTEGER) AS line_end, 'entry' AS kind, CAST(NULL AS VARCHAR) AS condition, false AS leaves, false AS is_exit FROM files
        UNION ALL SELECT k4.path, CAST(node AS INTEGER), CAST(max(CASE WHEN begins THEN CASE WHEN kind IS NULL THEN begin_at ELSE line_no END END) AS INTEGER), CAST(max(CASE WHEN begins THEN CASE WHEN kind IS NULL THEN coalesce(nxt - 1, n_lines) ELSE line_no END END) AS INTEGER),
        coalesce(max(CASE kind WHEN 'if' THEN 'branch' WHEN 'loop' THEN 'loop' WHEN 'return' THEN 'exit' END), 'normal'), max(CASE WHEN kind IN ('if', 'loop') THEN condition END), bool_or(leaves), coalesce(bool_or(kind = 'return'), false) OR (count(kind) = 0 AND max(nxt) IS NULL)
        FROM k4 JOIN nl ON nl.path = k4.path WHERE kind IS NULL OR kind <> 'else' GROUP BY k4.path, node),
    ce AS (SELECT path, node AS src, dst, CASE WHEN kind IN ('branch', 'loop') THEN 'branch_true' ELSE 'fall_through' END AS edge_type, condition FROM (SELECT *, lead(node) OVER (PARTITION BY path ORDER BY node) AS dst FROM cn) WHERE dst IS NOT NULL AND kind <> 'exit'
        UNION ALL SELECT path, 0, 1, 'fall_through', NULL FROM cn WHERE node = 1 AND kind = 'normal' AND NOT is_exit
        UNION ALL SELECT path, CAST(node AS INTEGER), CAST(node + {1 + graph.ELSE_STEP} AS INTEGER), 'fall_through', NULL FROM k4 WHERE kind = 'else' AND opened = 1),
    ge AS (SELECT ce.path, src, dst FROM ce JOIN cn ON cn.path = ce.path AND cn.node = dst)"""


def _graphs(spark, sf_dir):
    f = files(spark, sf_dir)
    nodes = graph.cfg_nodes(f)
    return graph.as_rows(nodes, graph.cfg_edges(f, nodes))


@query(f"{_BASE}, {_CFG} SELECT path, node, line_start, line_end, kind, condition, is_exit FROM cn")
def cfg_nodes(spark, sf_dir):
    return graph.cfg_nodes(files(spark, sf_dir)).drop("leaves")


@query(f"{_BASE}, {_CFG} SELECT path, src, dst, edge_type, condition FROM ce")
def cfg_edges(spark, sf_dir):
    return graph.cfg_edges(files(spark, sf_dir))


_REACHED = "re AS (SELECT DISTINCT path, 0 AS node FROM cn UNION SELECT re.path, dst FROM re JOIN ge ON ge.path = re.path AND src = node)"


@query(f"{_BASE}, {_CFG}, {_REACHED} SELECT path, node FROM cn EXCEPT SELECT path, node FROM re")
def unreachable_nodes(spark, sf_dir):
    return graph.unreachable(_graphs(spark, sf_dir))


# a node dominates another if the other can't be reached without it
_DOMS = f"""{_REACHED}, av AS (SELECT path, node AS dom, 0 AS node FROM cn WHERE node <> 0 UNION SELECT av.path, dom, dst FROM av JOIN ge ON ge.path = av.path AND src = av.node WHERE dst <> dom),
    doms AS (SELECT a.path, a.node, b.node AS dom FROM cn a JOIN cn b ON b.path = a.path LEFT JOIN av ON av.path = a.path AND av.dom = b.node AND av.node = a.node LEFT JOIN re ON re.path = a.path AND re.node = a.node WHERE re.node IS NULL OR b.node = 0 OR av.node IS NULL)"""


@query(f"{_BASE}, {_CFG}, {_DOMS} SELECT path, node, dom FROM doms")
def dominators(spark, sf_dir):
    return graph.dominators(_graphs(spark, sf_dir))


_POST = """inner_ AS (SELECT path, node FROM cn WHERE NOT is_exit), rx AS (SELECT path, node FROM cn WHERE is_exit UNION SELECT ge.path, src FROM rx JOIN ge ON ge.path = rx.path AND dst = rx.node JOIN inner_ ON inner_.path = ge.path AND inner_.node = src),
    ax AS (SELECT a.path, b.node AS pdom, a.node FROM cn a JOIN cn b ON b.path = a.path WHERE a.is_exit AND a.node <> b.node UNION SELECT ax.path, pdom, src FROM ax JOIN ge ON ge.path = ax.path AND dst = ax.node JOIN inner_ ON inner_.path = ge.path AND inner_.node = src WHERE src <> pdom),
    pdoms AS (SELECT a.path, a.node, b.node AS pdom FROM cn a JOIN cn b ON b.path = a.path LEFT JOIN ax ON ax.path = a.path AND ax.pdom = b.node AND ax.node = a.node LEFT JOIN rx ON rx.path = a.path AND rx.node = a.node WHERE rx.node IS NULL OR ax.node IS NULL)"""


@query(f"{_BASE}, {_CFG}, {_POST} SELECT path, node, pdom FROM pdoms")
def post_dominators(spark, sf_dir):
    return graph.post_dominators(_graphs(spark, sf_dir))


# a node is numbered by the order of the chains of what dominates it
_TREE = """chn AS (SELECT path, node, list(dom ORDER BY d) AS chain FROM (SELECT doms.*, c.d FROM doms JOIN (SELECT path, node, count(*) AS d FROM doms GROUP BY 1, 2) c ON c.path = doms.path AND c.node = dom) GROUP BY 1, 2),
    num AS (SELECT path, node, chain[len(chain) - 1] AS idom, CAST(row_number() OVER (PARTITION BY path ORDER BY chain) - 1 AS INTEGER) AS enter FROM chn),
    und AS (SELECT path, dom AS node, count(*) AS n FROM doms GROUP BY 1, 2)
    SELECT cn.path, cn.node, CASE WHEN len(chain) > 1 THEN idom END AS idom, enter, CAST(enter + n - 1 AS INTEGER) AS leave FROM cn LEFT JOIN num ON num.path = cn.path AND num.node = cn.node LEFT JOIN chn ON chn.path = cn.path AND chn.node = cn.node LEFT JOIN und ON und.path = cn.path AND und.node = cn.node AND enter IS NOT NULL"""


@query(f"{_BASE}, {_CFG}, {_DOMS.replace('doms AS (', 'dall AS (')}, doms AS (SELECT dall.* FROM dall JOIN re ON re.path = dall.path AND re.node = dall.node), {_TREE}")
def dominator_tree(spark, sf_dir):
    return graph.dominator_trees(_graphs(spark, sf_dir))


@query(f"""{_BASE}, {_CFG}, {_POST}, doms AS (SELECT pdoms.path, pdoms.node, pdom AS dom FROM pdoms JOIN rx ON rx.path = pdoms.path AND rx.node = pdoms.node), {_TREE}""")
def post_dominator_tree(spark, sf_dir):
    return graph.post_dominator_trees(_graphs(spark, sf_dir))


@query(f"""{_BASE}, {_CFG}, far AS (SELECT path, src AS a, dst AS b FROM ge UNION SELECT far.path, a, dst FROM far JOIN ge ON ge.path = far.path AND src = b),
    co AS (SELECT cn.path, cn.node, least(cn.node, coalesce(min(f.b), cn.node)) AS comp FROM cn LEFT JOIN (SELECT x.* FROM far x JOIN far y ON y.path = x.path AND y.a = x.b AND y.b = x.a) f ON f.path = cn.path AND f.a = cn.node GROUP BY 1, 2),
    be AS (SELECT ge.path, s.comp AS a, d.comp AS b, count(*) AS k FROM ge JOIN co s ON s.path = ge.path AND s.node = src JOIN co d ON d.path = ge.path AND d.node = dst WHERE s.comp <> d.comp GROUP BY 1, 2, 3),
    wy AS (SELECT path, comp, CAST(1 AS BIGINT) AS w FROM co WHERE node = 0 UNION ALL SELECT wy.path, be.b, CAST(w * k AS BIGINT) FROM wy JOIN be ON be.path = wy.path AND be.a = wy.comp)
    SELECT co.path, co.node, CAST(sum(w) AS BIGINT) AS ways FROM co JOIN wy ON wy.path = co.path AND wy.comp = co.comp GROUP BY 1, 2""")
def ways_to_nodes(spark, sf_dir):
    return graph.ways_to(_graphs(spark, sf_dir))


_LIMIT = "coalesce(" + ", ".join(f"nullif(regexp_extract(condition, {q(r)}, 1), '')" for r in rules.BOUNDED) + ")"


@query(f"""{_BASE}, {_CFG}, {_DOMS}, le AS (SELECT ge.path, src AS tail, dst AS header FROM ge JOIN doms ON doms.path = ge.path AND doms.node = src AND doms.dom = dst),
    lb AS (SELECT path, tail, header, tail AS node FROM le UNION SELECT lb.path, tail, header, src FROM lb JOIN ge ON ge.path = lb.path AND dst = lb.node WHERE src <> header), body AS (SELECT path, tail, header, node FROM lb UNION SELECT path, tail, header, header FROM le),
    lx AS (SELECT DISTINCT body.path, tail, header, src FROM body JOIN ge ON ge.path = body.path AND src = body.node WHERE NOT EXISTS (SELECT 1 FROM body b WHERE b.path = body.path AND b.tail = body.tail AND b.header = body.header AND b.node = ge.dst)),
    bs AS (SELECT body.path, tail, header, string_agg(CAST(body.node AS VARCHAR), ',' ORDER BY body.node) AS body, bool_or(leaves) AS leaves FROM body JOIN cn ON cn.path = body.path AND cn.node = body.node GROUP BY 1, 2, 3), xs AS (SELECT path, tail, header, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS exits FROM lx GROUP BY 1, 2, 3)
    SELECT le.path, le.header, le.tail, body, coalesce(exits, '') AS exits, {_LIMIT} AS bound, {_LIMIT} IS NULL AND NOT bs.leaves AND exits IS NULL AS infinite
    FROM le JOIN bs ON bs.path = le.path AND bs.tail = le.tail AND bs.header = le.header LEFT JOIN xs ON xs.path = le.path AND xs.tail = le.tail AND xs.header = le.header JOIN cn ON cn.path = le.path AND cn.node = le.header""")
def natural_loops(spark, sf_dir):
    d = graph.natural_loops(_graphs(spark, sf_dir))
    return d.select("path", "header", "tail", _joined("body"), _joined("exits"), "bound", "infinite")


@query(f"""{_BASE}, {_CFG}, tg AS (SELECT path, max(node) AS target FROM cn GROUP BY path), pw AS (SELECT path, target, 0 AS node, '' AS way, ',0,' AS seen FROM tg
    UNION ALL SELECT pw.path, target, dst, CASE WHEN way = '' THEN CAST(pw.node AS VARCHAR) ELSE way || ',' || pw.node END, seen || dst || ',' FROM pw JOIN ge ON ge.path = pw.path AND src = pw.node WHERE pw.node <> target AND NOT contains(seen, ',' || dst || ','))
    SELECT path, target, way FROM pw WHERE node = target""")
def paths_to_node(spark, sf_dir):
    return graph.paths_to(_graphs(spark, sf_dir), lambda g: g.ids[-1]).select("path", "target", _joined("way"))
