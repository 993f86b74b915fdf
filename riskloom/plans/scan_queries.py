"""Queries on whole scans and their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import rules
from riskloom.operators import features, scan, types
from riskloom.plans.registry import q, query, values
from riskloom.sources.code import FILES_SQL, LINES_SQL, files
from riskloom.sources.views import ADVISORIES_SQL, FINDINGS_SQL, advisories, findings

_KNOWN = f"known(language, names) AS ({values(list(rules.DANGEROUS.items()))})"


@query(f"""WITH files AS ({FILES_SQL}), {LINES_SQL}, b AS (SELECT path, language, line_no, ls[line_no] AS text, array_to_string(ls[greatest(line_no - 3, 1):line_no], chr(10)) AS before FROM l1),
    r(language, regex) AS ({values(list(rules.NULLS.items()))}), n AS (SELECT path, line_no AS assign_line, unnest(regexp_extract_all(text, regex, 1)) AS var FROM b JOIN r USING (language))
    SELECT b.path, CAST(assign_line AS INTEGER) AS assign_line, CAST(line_no AS INTEGER) AS line_no, var FROM b JOIN n ON n.path = b.path AND line_no >= assign_line AND (contains(text, var || '.') OR contains(text, var || '->'))
    WHERE NOT regexp_matches(before, 'if\\s*\\(?\\s*' || var || '\\s*(?:!=|!==)\\s*(?:NULL|nullptr|null|None)')""")
def null_derefs(spark, sf_dir):
    return scan.null_derefs(files(spark, sf_dir))


@query(f"""WITH files AS ({FILES_SQL}), {LINES_SQL}, {_KNOWN}, c AS (SELECT DISTINCT path, language, unnest(regexp_extract_all(content, {q(features.CALL)}, 1)) AS name FROM files),
    d AS (SELECT path, name FROM c JOIN known USING (language) WHERE list_contains(names, name) OR list_contains(names, regexp_extract(name, '([^.:]*)$', 1)))
    SELECT d.path, name, CAST(min(line_no) AS INTEGER) AS line_no FROM d JOIN lines ON lines.path = d.path AND contains(text, name) GROUP BY 1, 2""")
def evidence_lines(spark, sf_dir):
    return scan.evidence(files(spark, sf_dir))


@query(f"""WITH f AS ({FINDINGS_SQL}), h AS (SELECT id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(file_path || ':' || line_start || ':' || vuln_class)) AS h FROM f)
    SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (position(substr(h, 17, 1) IN '0123456789abcdef') - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS finding_id FROM h""")
def finding_ids(spark, sf_dir):
    return findings(spark, sf_dir).select("id", scan.uuid5(F.concat_ws(":", "file_path", F.col("line_start").cast("string"), "vuln_class")).alias("finding_id"))


@query(f"""WITH files AS ({FILES_SQL}), l AS (SELECT path, string_split(content, chr(10)) AS ls FROM files), i AS (SELECT path, ls, unnest(range(1, least(6, len(ls)) + 1)) AS i FROM l)
    SELECT path, string_agg(printf('%s%4d │ %s', CASE WHEN i = 3 THEN '→ ' ELSE '  ' END, i, ls[i]), chr(10) ORDER BY i) AS snippet FROM i GROUP BY path""")
def snippets(spark, sf_dir):
    return files(spark, sf_dir).select("path", scan.snippet(F.col("content"), F.lit(3)).alias("snippet"))


@query(f"""WITH a AS ({ADVISORIES_SQL}) SELECT cve_id, 'about ' || cwe_id AS description, cvss AS score, 'CVSS:3.1/' || cwe_id AS vector, cwe_id AS cwes, 'https://a/' || cve_id || ',https://b' AS urls, 'cpe:' || cwe_id || ',cpe:' || cve_id AS products, strftime(published, '%Y-%m-%d') || 'T00:00:00' AS published FROM a""")
def nvd_json_parse(spark, sf_dir):
    """The advisories of the orders view as answers of a service, read again."""
    text = lambda *parts: F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p) for i, p in enumerate(parts)])
    one = F.struct(
        F.col("cve_id").alias("id"),
        F.array(F.struct(F.lit("es").alias("lang"), F.lit("no").alias("value")), F.struct(F.lit("en").alias("lang"), text("about ", "cwe_id").alias("value"))).alias("descriptions"),
        F.struct(F.array(F.struct(F.struct(F.col("cvss").alias("baseScore"), text("CVSS:3.1/", "cwe_id").alias("vectorString")).alias("cvssData"))).alias("cvssMetricV31")).alias("metrics"),
        F.array(F.struct(F.array(F.struct(F.col("cwe_id").alias("value")), F.struct(F.lit("other").alias("value"))).alias("description"))).alias("weaknesses"),
        F.array(F.struct(text("https://a/", "cve_id").alias("url")), F.struct(F.lit("https://b").alias("url"))).alias("references"),
        F.array(*[F.struct(F.array(F.struct(F.array(F.struct(text("cpe:", c).alias("criteria"))).alias("cpeMatch"))).alias("nodes")) for c in ("cwe_id", "cve_id")]).alias("configurations"),
        F.concat(F.date_format("published", "yyyy-MM-dd"), F.lit("T00:00:00.000")).alias("published"),
    )
    answers = advisories(spark, sf_dir).select(F.to_json(F.struct(F.array(F.struct(one.alias("cve"))).alias("vulnerabilities"))).alias("j"))
    d = scan.parse_advisories(answers, "j")
    return d.select("cve_id", "description", "score", "vector", "cwes", "urls", F.array_join("products", ",").alias("products"), "published")


@query(f"WITH files AS ({FILES_SQL}), r(language, regex_no, regex) AS ({values([(k, i, x) for k, v in rules.FUNCTIONS.items() for i, x in enumerate(v)])}) SELECT path, regex_no, unnest(regexp_extract_all(content, regex, 1)) AS name FROM files JOIN r USING (language)")
def function_names(spark, sf_dir):
    return types.functions_of(files(spark, sf_dir))


_TYPES = {k: rules.TYPES.get(k, rules.TYPES["*"]) for k in sorted({*rules.TYPES, *rules.FUNCTIONS, *rules.EXTENSIONS.values(), "unknown"} - {"*"})}


# where a type begins follows from the lengths of what stands between the matches; its block ends where { and : are closed
@query(f"""WITH files AS ({FILES_SQL}), ty(language, tr, fr) AS ({values([(k, *v) for k, v in _TYPES.items()])}), fn(language, regex) AS ({values([(k, x) for k, v in rules.FUNCTIONS.items() for x in v])}),
    m AS (SELECT path, language, content, fr, regexp_extract_all(content, tr) AS ms, regexp_extract_all(content, tr, 1) AS ns, regexp_split_to_array(content, tr) AS ps FROM files JOIN ty USING (language) WHERE regexp_matches(content, tr)),
    k AS (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM m), b AS (SELECT path, language, fr, ns[k] AS name, k, substr(content, CAST(list_sum(list_transform(ps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) + 1 AS BIGINT)) AS rest FROM k),
    c AS (SELECT path, k, unnest(string_split(rest, '')) AS ch, unnest(range(1, length(rest) + 1)) AS i FROM b), d AS (SELECT path, k, ch, i, sum(CASE WHEN ch IN ('{{', ':') THEN 1 WHEN ch = '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY path, k ORDER BY i) AS depth FROM c),
    e AS (SELECT path, k, min(i) AS last FROM d WHERE ch = '}}' AND depth <= 0 GROUP BY 1, 2), o AS (SELECT b.path, language, fr, name, b.k, left(rest, coalesce(last, 1)) AS body FROM b LEFT JOIN e ON e.path = b.path AND e.k = b.k),
    g AS (SELECT o.path, o.k, flatten(list(regexp_extract_all(body, regex, 1))) AS names FROM o JOIN fn USING (language) GROUP BY 1, 2),
    l AS (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY k DESC) AS r FROM o)
    SELECT l.path, name, array_to_string(list_sort(list_distinct(regexp_extract_all(body, fr, 1))), ',') AS fields, coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS methods,
    len(list_filter(coalesce(names, []), lambda x: {' OR '.join(f"contains(lower(x), {q(w)})" for w in rules.DANGEROUS_METHODS)})) > 0 AS dangerous FROM l LEFT JOIN g ON g.path = l.path AND g.k = l.k WHERE r = 1""")
def type_info(spark, sf_dir):
    d = types.type_info(files(spark, sf_dir))
    return d.select("path", "name", *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("fields", "methods")], "dangerous")
