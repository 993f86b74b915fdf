"""Queries on files of code: features, rule matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import model, rules
from riskloom.functions import text as T
from riskloom.operators import explain, features, matching
from riskloom.operators.ml import rounded
from riskloom.plans.registry import q, query, values
from riskloom.sources.code import FILES_SQL, LINES_SQL, files, glob, glob_any, guessed_language, lines

# In the twins, characters beyond ASCII become a letter, so that RE2's ASCII classes see the words that Unicode classes do.
_FILES = f"WITH files AS ({FILES_SQL}), plain AS (SELECT path, language, content, regexp_replace(content, '[^\\x00-\\x7F]', 'x', 'g') AS a FROM files)"


def _n(regexes, col="a"):
    return "(" + " + ".join(f"len(regexp_extract_all({col}, {q(r)}))" for r in regexes) + ")"


def _by_language(table, one, default="0"):
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {one(v)}" for k, v in table.items() if k != "*") + f" ELSE {one(table['*']) if '*' in table else default} END"



@query("SELECT page_id, url FROM pages WHERE (regexp_matches(url, '(?i)^.*example.*$') OR regexp_matches(url, '(?i)^.*/page/?.*$')) AND NOT regexp_matches(url, '(?i)^.*1.$')")
def collect_files_glob(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.where(glob_any(F.col("url"), ["*example*"]) | F.col("url").rlike("(?i)^.*/page/?.*$")).where(~glob(F.col("url"), "*1?")).select("page_id", "url")


@query(f"WITH files AS ({FILES_SQL}) SELECT path, language, CASE " + " ".join(f"WHEN {' OR '.join(f'regexp_matches(content, {q(r)})' for r in rs)} THEN '{k}'" for k, rs in rules.MARKERS.items()) + " ELSE 'unknown' END AS guessed FROM files")
def language_dispatch(spark, sf_dir):
    return files(spark, sf_dir).select("path", "language", guessed_language(F.col("content")).alias("guessed"))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY 1, 2), t AS (SELECT doc_id, CAST(sum(k) AS DOUBLE) AS n FROM n GROUP BY 1),
    e AS (SELECT doc_id, sum(-(k / n) * log2(k / n)) AS h FROM n JOIN t USING (doc_id) GROUP BY 1)
    SELECT d.doc_id, floor(coalesce(h, 0e0) * 1e5 + 0.5e0) / 1e5 AS entropy FROM documents d LEFT JOIN e USING (doc_id)""")
def code_entropy(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", (F.floor(T.entropy("text") * F.lit(1e5) + F.lit(0.5)) / F.lit(1e5)).alias("entropy"))


@query(f"""{_FILES}, {LINES_SQL}, s AS (SELECT path, language, line_no, trim(text, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS t FROM lines),
    e AS (SELECT *, {_by_language(rules.COMMENTS, lambda v: f"contains(t, {q(v[1])})", 'false')} AS has_begin, {_by_language(rules.COMMENTS, lambda v: f"contains(t, {q(v[2])})", 'false')} AS has_end,
        {_by_language({**rules.COMMENTS, '*': (['#'],)}, lambda v: '(' + ' OR '.join(f"starts_with(t, {q(p)})" for p in v[0]) + ')')} AS has_prefix FROM s),
    v AS (SELECT *, CASE WHEN t = '' THEN NULL WHEN has_end THEN 0 WHEN has_begin THEN 1 END AS ev FROM e),
    w AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM v),
    k AS (SELECT path, t <> '' AND (has_end OR has_begin OR inside = 1 OR has_prefix) AS note, t = '' AS blank FROM w)
    SELECT path, count(*) AS n_lines, CAST(sum(CASE WHEN note THEN 1 ELSE 0 END) AS BIGINT) AS n_comment, CAST(sum(CASE WHEN NOT note AND NOT blank THEN 1 ELSE 0 END) AS BIGINT) AS loc FROM k GROUP BY path""")
def line_metrics(spark, sf_dir):
    d = files(spark, sf_dir).select("path", T.comment_lines("content", "language").alias("m"))
    return d.select("path", F.col("m.all").cast("long").alias("n_lines"), F.col("m.comment").cast("long").alias("n_comment"), F.col("m.code").cast("long").alias("loc"))


@query(f"{_FILES} SELECT path, 1 + {_n(rules.DECISIONS)} AS complexity FROM plain")
def cyclomatic_complexity(spark, sf_dir):
    return files(spark, sf_dir).select("path", T.complexity("content").cast("long").alias("complexity"))


@query(f"""{_FILES}, c AS (SELECT path, string_split(regexp_replace(content, '[^\\[\\](){{}}]', '', 'g'), '') AS cs FROM files), u AS (SELECT path, unnest(cs) AS ch, unnest(range(1, len(cs) + 1)) AS i FROM c),
    s AS (SELECT path, i, sum(CASE WHEN ch IN ('(', '[', '{{') THEN 1 WHEN ch IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS d FROM u),
    m AS (SELECT path, d - least(0, min(d) OVER (PARTITION BY path ORDER BY i)) AS depth FROM s), x AS (SELECT path, max(depth) AS nesting FROM m GROUP BY path)
    SELECT path, CAST(coalesce(nesting, 0) AS BIGINT) AS nesting FROM files LEFT JOIN x USING (path)""")
def nesting_depth(spark, sf_dir):
    return files(spark, sf_dir).select("path", T.nesting("content").cast("long").alias("nesting"))


@query(f"""{_FILES}, t AS (SELECT path, regexp_extract_all(content, {q(rules.TOKEN)}) AS ts FROM files)
    SELECT path, len(ts) AS n_tokens, len(list_distinct(ts)) AS n_distinct, CASE WHEN len(ts) > 0 THEN floor(len(list_distinct(ts)) / len(ts) * 1e6 + 0.5e0) / 1e6 ELSE 0e0 END AS diversity FROM t""")
def token_stats(spark, sf_dir):
    d = files(spark, sf_dir).select("path", T.tokens("content").alias("ts"))
    d = d.select("path", F.size("ts").cast("long").alias("n_tokens"), F.size(F.array_distinct("ts")).cast("long").alias("n_distinct"))
    return d.withColumn("diversity", F.when(F.col("n_tokens") > 0, rounded(F.col("n_distinct") / F.col("n_tokens"))).otherwise(0.0))


_KNOWN = f"known(language, names) AS ({values([(k, v) for k, v in rules.DANGEROUS.items()])})"


@query(f"""{_FILES}, {_KNOWN}, c AS (SELECT DISTINCT path, language, unnest(regexp_extract_all(content, {q(features.CALL)}, 1)) AS name FROM files)
    SELECT path, name FROM c JOIN known USING (language) WHERE list_contains(names, name) OR list_contains(names, regexp_extract(name, '([^.:]*)$', 1))""")
def dangerous_calls(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.explode(features.dangerous("content", "language")).alias("name"))


_FEATURES = f"""{_FILES}, {_KNOWN}, g AS (SELECT path, count(DISTINCT name) AS dangerous FROM (SELECT path, language, unnest(regexp_extract_all(content, {q(features.CALL)}, 1)) AS name FROM files) JOIN known USING (language)
        WHERE list_contains(names, name) OR list_contains(names, regexp_extract(name, '([^.:]*)$', 1)) GROUP BY path),
    h AS (SELECT path, count(*) AS unchecked FROM (SELECT path, unnest(string_split(content, chr(10))) AS x FROM files) WHERE regexp_matches(x, {q(rules.LONE_CALL)}) AND NOT regexp_matches(x, '^\\s*(//|#)') AND NOT regexp_matches(x, {q(rules.CHECKED_CALL)}) GROUP BY path),
    f AS (SELECT path, language, 1 + {_n(rules.DECISIONS)} AS complexity, {_by_language(rules.FUNCTIONS, _n)} AS functions, {_by_language(rules.INPUTS, _n)} AS inputs, {_by_language(rules.SINKS, _n)} AS sinks,
        {_n(rules.FAMILIES['crypto'])} AS crypto, CASE WHEN language IN ('c', 'cpp') THEN {_n(rules.FAMILIES['memory'])} ELSE 0 END AS memory, {_n(rules.FAMILIES['file'])} AS file_ops, {_n(rules.FAMILIES['network'])} AS network,
        CASE WHEN language IN ('c', 'cpp') THEN {_n(rules.POINTERS)} ELSE 0 END AS pointers FROM plain),
    feats AS (SELECT f.*, coalesce(dangerous, 0) AS dangerous, coalesce(unchecked, 0) AS unchecked, least(inputs * sinks, 100) AS taint_flows FROM f LEFT JOIN g USING (path) LEFT JOIN h USING (path))"""
_SHOWN = ["complexity", "functions", "inputs", "sinks", "crypto", "memory", "file_ops", "network", "dangerous", "unchecked", "pointers", "taint_flows"]


@query(f"{_FEATURES} SELECT path, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _SHOWN)} FROM feats")
def feature_counts(spark, sf_dir):
    return features.features(files(spark, sf_dir)).select("path", *[F.col(c).cast("long").alias(c) for c in _SHOWN])


def _logit(c):
    w, bias = rules.WEIGHTS.get(c, rules.WEIGHTS["*"])
    return " + ".join(["0e0", *[f"{features.NUMBERED[i]} * {v}e0" for i, v in w.items()]]) + f" + ({bias}e0)"


_NEST = "x AS (SELECT path, max(depth) AS nesting FROM m GROUP BY path)"


@query(f"""{_FEATURES}, c AS (SELECT path, string_split(regexp_replace(content, '[^\\[\\](){{}}]', '', 'g'), '') AS cs FROM files), u AS (SELECT path, unnest(cs) AS ch, unnest(range(1, len(cs) + 1)) AS i FROM c),
    s AS (SELECT path, i, sum(CASE WHEN ch IN ('(', '[', '{{') THEN 1 WHEN ch IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS d FROM u),
    m AS (SELECT path, d - least(0, min(d) OVER (PARTITION BY path ORDER BY i)) AS depth FROM s), {_NEST}, y AS (SELECT feats.*, coalesce(nesting, 0) AS nesting FROM feats LEFT JOIN x USING (path)),
    p AS ({' UNION ALL '.join(f"SELECT path, '{c[0]}' AS vuln_class, 1e0 / (1e0 + exp(-greatest(-500e0, least(500e0, {_logit(c[0])})))) AS prob FROM y" for c in model.CLASSES)})
    SELECT path, vuln_class, floor(prob * 1e6 + 0.5e0) / 1e6 AS prob FROM p WHERE prob >= 0.5e0""")
def predict_classes(spark, sf_dir):
    return features.predict(features.features(files(spark, sf_dir))).withColumn("prob", rounded(F.col("prob")))


_DANGER = f"gn AS (SELECT path, string_agg(name, ', ' ORDER BY name) AS names FROM (SELECT DISTINCT path, name FROM (SELECT path, language, unnest(regexp_extract_all(content, {q(features.CALL)}, 1)) AS name FROM files) JOIN known USING (language) WHERE list_contains(names, name) OR list_contains(names, regexp_extract(name, '([^.:]*)$', 1))) GROUP BY path)"
_SAID = ", ".join([f"replace({q(t)}, '{{}}', gn.names)" if c == "names" else f"CASE WHEN {c} > 0 THEN replace({q(t)}, '{{}}', CAST({c} AS VARCHAR)) END" for c, t in model.SAID]) + ", reason"


@query(f"""{_FEATURES}, {LINES_SQL}, {_DANGER}, c AS (SELECT path, string_split(regexp_replace(content, '[^\\[\\](){{}}]', '', 'g'), '') AS cs FROM files), u AS (SELECT path, unnest(cs) AS ch, unnest(range(1, len(cs) + 1)) AS i FROM c),
    s AS (SELECT path, i, sum(CASE WHEN ch IN ('(', '[', '{{') THEN 1 WHEN ch IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS d FROM u),
    m AS (SELECT path, d - least(0, min(d) OVER (PARTITION BY path ORDER BY i)) AS depth FROM s), {_NEST}, y AS (SELECT feats.*, coalesce(nesting, 0) AS nesting FROM feats LEFT JOIN x USING (path)),
    p AS ({' UNION ALL '.join(f"SELECT y.*, '{k[0]}' AS vuln_class, 1e0 / (1e0 + exp(-greatest(-500e0, least(500e0, {_logit(k[0])})))) AS prob FROM y" for k in model.CLASSES)}), k(vuln_class, regex) AS ({values(list(rules.LOCATIONS.items()))}), loc AS (SELECT path, vuln_class, min(line_no) AS line FROM lines, k WHERE regexp_matches(text, regex) GROUP BY 1, 2),
    e(vuln_class, exploitability, impact, reason, remediation, refs) AS ({values([(x[0], x[7], x[8], model.REASONS.get(x[0]), ' | '.join(model.FIXES.get(x[0], model.FIXES['*'])), ' | '.join([*model.BASE_REFERENCES, *[v for k, v in model.REFERENCES.items() if k == x[0]]])) for x in model.CLASSES])})
    SELECT p.path, p.vuln_class, CAST(coalesce(loc.line, 1) AS INTEGER) AS line_start, floor(prob * 1e6 + 0.5e0) / 1e6 AS overall, exploitability, impact, (0.6e0 * impact + 0.4e0 * exploitability) * 10e0 AS cvss, concat_ws(' | ', {_SAID}) AS reasoning, remediation, refs AS "references"
    FROM p JOIN e ON e.vuln_class = p.vuln_class LEFT JOIN gn ON gn.path = p.path LEFT JOIN loc ON loc.path = p.path AND loc.vuln_class = p.vuln_class WHERE prob >= 0.5e0""")
def prediction_results(spark, sf_dir):
    d = explain.predictions(files(spark, sf_dir))
    return d.select("path", "vuln_class", "line_start", rounded(F.col("overall")).alias("overall"), "exploitability", "impact", "cvss", *[F.array_join(c, " | ").alias(c) for c in ("reasoning", "remediation", "references")])


@query(f"WITH files AS ({FILES_SQL}), k(language, pointers, manual_memory, garbage_collection, type_safety, bounds_checking, null_safety, common) AS ({values([(k, *f, ','.join(v)) for k, (f, v) in model.LANGUAGES.items()])}) SELECT path, pointers, manual_memory, garbage_collection, type_safety, bounds_checking, null_safety, common FROM files LEFT JOIN k USING (language)")
def language_profiles(spark, sf_dir):
    d = files(spark, sf_dir).select("path", explain.language_profile(F.col("language")).alias("p")).select("path", "p.*")
    return d.withColumn("common", F.array_join("common", ","))


@query(f"WITH files AS ({FILES_SQL}), k(pattern, languages) AS ({values([(p.name, p.languages) for p in rules.PATTERNS])}) SELECT path, pattern FROM files JOIN k ON list_contains(languages, language)")
def patterns_of_files(spark, sf_dir):
    return matching.applying(files(spark, sf_dir))


@query(f"{_FILES}, {LINES_SQL}, k(vuln_class, regex) AS ({values(list(rules.LOCATIONS.items()))}), h AS (SELECT path, vuln_class, min(line_no) AS line FROM lines, k WHERE regexp_matches(text, regex) GROUP BY 1, 2) SELECT files.path, k.vuln_class, CAST(coalesce(line, 1) AS INTEGER) AS line FROM files CROSS JOIN k LEFT JOIN h ON h.path = files.path AND h.vuln_class = k.vuln_class")
def vuln_location(spark, sf_dir):
    return features.locations(files(spark, sf_dir))


_RULES = "rules(pattern, vuln_class, severity, weight, languages, excl, req, regex_no, regex) AS (" + values([(p.name, p.vuln_class, p.severity, p.weight, p.languages, p.excludes, p.requires, i, r) for p in rules.PATTERNS for i, r in enumerate(p.regexes)]) + ")"
_EXCLUDED = " ".join(f"WHEN list_contains(excl, '{k}') AND regexp_matches(context, {q(r)}) THEN {q(why)}" for k, (r, why) in rules.EXCLUSIONS.items())
_MATCHES = f"""{_FILES}, {LINES_SQL}, {_RULES}, o AS (SELECT path, line_no, text, context, pattern, vuln_class, severity, weight, excl, req, regex_no, unnest(regexp_extract_all(text, regex)) AS matched FROM lines JOIN rules ON list_contains(languages, language) AND regexp_matches(text, regex)),
    c AS (SELECT *, greatest(0e0, least(1e0, severity * weight * (CASE WHEN list_contains(req, 'has_bounds_check') AND NOT regexp_matches(context, {q(rules.BOUNDS_CHECK)}) THEN 1.1e0 ELSE 1e0 END)
        * (CASE WHEN list_contains(req, 'in_security_context') AND regexp_matches(context, {q(rules.SECURITY_WORDS)}) THEN 1.2e0 ELSE 1e0 END) * (CASE WHEN matched IN ('=', '+', '(', ')') THEN 0.7e0 ELSE 1e0 END) * (CASE WHEN length(matched) < 5 THEN 0.8e0 ELSE 1e0 END))) AS confidence,
        CASE {_EXCLUDED} WHEN regexp_matches(context, {q(rules.TEST_WORDS)}) AND regexp_matches(text, {q(rules.COMMENT_MARKS)}) THEN 'Appears to be test/example code' WHEN regexp_matches(context, {q(rules.CLEANERS)}) THEN 'Sanitization appears to be present'
        WHEN vuln_class = 'INJECTION' AND regexp_matches(context, {q(rules.PREPARED)}) THEN 'Appears to use parameterized query' END AS fp_reason FROM o),
    matches AS (SELECT *, severity * 100e0 * confidence * (CASE WHEN fp_reason IS NOT NULL THEN 0.1e0 ELSE 1e0 END) * (CASE WHEN vuln_class IN ({', '.join(map(repr, rules.CRITICAL_CLASSES))}) THEN 1.5e0 ELSE 1e0 END) AS score FROM c)"""


@query(f"{_FILES}, {_RULES} SELECT DISTINCT path, pattern FROM plain JOIN rules ON list_contains(languages, language) AND regexp_matches(a, regex)")
def pattern_match_ids(spark, sf_dir):
    return matching.pattern_ids(files(spark, sf_dir))


@query(f"{_MATCHES} SELECT path, CAST(line_no AS INTEGER) AS line_no, pattern, regex_no, matched, confidence, fp_reason, score FROM matches")
def pattern_matches(spark, sf_dir):
    return matching.match(lines(files(spark, sf_dir))).select("path", "line_no", "pattern", "regex_no", "matched", "confidence", "fp_reason", "score")


@query(f"{_MATCHES} SELECT pattern, vuln_class, count(*) AS n, count(fp_reason) AS false_positives, floor(avg(confidence) * 1e6 + 0.5e0) / 1e6 AS avg_confidence FROM matches GROUP BY 1, 2")
def match_summary(spark, sf_dir):
    return matching.summarize(matching.match(lines(files(spark, sf_dir)))).withColumn("avg_confidence", rounded(F.col("avg_confidence")))


_NEAR = f"""nf AS (SELECT path, language, string_split(content, chr(10)) AS ls FROM files), nm AS (SELECT path, language, ls, unnest(range(greatest(len(ls) - 2, 1), len(ls) + 1)) AS mid FROM nf),
    nk AS (SELECT path, language, ls, unnest(range(greatest(mid - 5, 1), least(mid + 5, len(ls)) + 1)) AS line_no, array_to_string(ls[greatest(mid - 5, 1):mid + 5], chr(10)) AS context FROM nm), lines AS (SELECT path, language, line_no, ls[line_no] AS text, context FROM nk)"""


@query(_MATCHES.replace(LINES_SQL, _NEAR) + " SELECT path, CAST(line_no AS INTEGER) AS line_no, pattern, max(confidence) AS confidence FROM matches GROUP BY 1, 2, 3")
def incremental_matches(spark, sf_dir):
    """As if the last three lines of every file had changed."""
    f = files(spark, sf_dir)
    n = F.size(F.split("content", "\n", -1))
    return matching.incremental(f, f.select("path", F.explode(F.sequence(F.greatest(n - 2, F.lit(1)), n)).alias("line_no")))


@query(f"{_MATCHES} SELECT path, CAST(line_no AS INTEGER) AS line_no, pattern, regex_no, matched, score, CAST(row_number() OVER (PARTITION BY path ORDER BY score DESC, line_no, pattern, regex_no, matched) AS INTEGER) AS place FROM matches")
def match_ranking(spark, sf_dir):
    return matching.ranked(matching.match(lines(files(spark, sf_dir)))).select("path", "line_no", "pattern", "regex_no", "matched", "score", "place")
