"""Queries on findings, advisories, vectors and labels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom import model
from riskloom.operators import advisories, explain, ml, report, risk
from riskloom.plans.registry import query, values
from riskloom.sources.views import ADVISORIES_SQL, FINDINGS_SQL, findings
from riskloom.sources.views import advisories as advisory_view

_CLASSES = f"classes(vuln_class, ordinal, w, c, i, a, cwe_id, exploit, impact_est) AS ({values(model.CLASSES)})"
_SEVERITIES = f"severities(severity, rank, sw, least) AS ({values(model.SEVERITIES)})"
_BASE = f"WITH f AS ({FINDINGS_SQL}), {_CLASSES}, {_SEVERITIES}, r AS (SELECT f.*, rank, c, i, a, cwe_id, greatest(0e0, least(1e0, sw * w * (1e0 - 0.3e0 * (1e0 - confidence)) * (1e0 - fp))) AS risk FROM f JOIN classes USING (vuln_class) JOIN severities USING (severity))"
_CVSS = """, x AS (SELECT r.*, 8.22e0 * 0.85e0 * (CASE WHEN vuln_class IN ('RACE_CONDITION', 'USE_AFTER_FREE') THEN 0.44e0 ELSE 0.77e0 END)
        * (CASE WHEN vuln_class = 'AUTHENTICATION_BYPASS' THEN 0.85e0 ELSE 0.62e0 END) * (CASE WHEN vuln_class IN ('XSS', 'DESERIALIZATION') THEN 0.62e0 ELSE 0.85e0 END) AS exploitability,
        1e0 - (1e0 - c) * (1e0 - i) * (1e0 - a) AS isc, vuln_class IN ('CODE_EXECUTION', 'PRIVILEGE_ESCALATION') AS changed FROM r),
    y AS (SELECT *, CASE WHEN changed THEN 7.52e0 * (isc - 0.029e0) - 3.25e0 * pow(isc - 0.02e0, 15e0) ELSE 6.42e0 * isc END AS impact FROM x),
    z AS (SELECT *, ceil((CASE WHEN impact <= 0 THEN 0e0 ELSE least(CASE WHEN changed THEN 1.08e0 * (impact + exploitability) ELSE impact + exploitability END, 10e0) END) * 10e0) / 10e0 AS cvss FROM y)"""
#: plain names that events stand for
_PLAIN = {"error": "sql_injection", "purchase": "XSS", "click": "Crypto", "signup": "authentication", "view": "unknown"}
_V = f"WITH v AS ({ADVISORIES_SQL})"


@query(f"{_BASE} SELECT id, risk, CASE WHEN risk >= 0.9e0 THEN 1 WHEN risk >= 0.7e0 THEN 2 WHEN risk >= 0.5e0 THEN 3 WHEN risk >= 0.3e0 THEN 4 ELSE 5 END AS priority FROM r")
def risk_scores(spark, sf_dir):
    r = risk.risk(F.col("severity"), F.col("vuln_class"), F.col("confidence"), F.col("fp"))
    return findings(spark, sf_dir).select("id", r.alias("risk")).withColumn("priority", risk.priority(F.col("risk")))


@query(f"{_BASE}{_CVSS} SELECT id, exploitability, impact, cvss, CASE WHEN cvss >= 9 THEN 'CRITICAL' WHEN cvss >= 7 THEN 'HIGH' WHEN cvss >= 4 THEN 'MEDIUM' WHEN cvss >= 0.1e0 THEN 'LOW' ELSE 'INFO' END AS level FROM z")
def cvss_scores(spark, sf_dir):
    return risk.cvss(findings(spark, sf_dir)).select("id", "exploitability", "impact", "cvss", risk.cvss_severity(F.col("cvss")).alias("level"))


_WEIGHTS = {"error": 1.2, "view": 0.5}


@query(f"""{_BASE}{_CVSS}, p AS (SELECT *, greatest(0e0, least(1e0, risk * (CASE tag WHEN 'error' THEN 1.2e0 ELSE 1e0 END) * (CASE tag WHEN 'view' THEN 0.5e0 ELSE 1e0 END))) AS r2 FROM z)
    SELECT id, r2 AS risk, cvss, CASE WHEN r2 >= 0.9e0 THEN 1 WHEN r2 >= 0.7e0 THEN 2 WHEN r2 >= 0.5e0 THEN 3 WHEN r2 >= 0.3e0 THEN 4 ELSE 5 END AS priority,
           CASE WHEN vuln_class = 'CODE_EXECUTION' OR vuln_class = 'AUTHENTICATION_BYPASS' THEN 'Medium (hours)' ELSE 'Low (minutes)' END AS effort FROM p""")
def prioritized(spark, sf_dir):
    return risk.prioritize(findings(spark, sf_dir), _WEIGHTS).select("id", "risk", "cvss", "priority", "effort").orderBy(F.desc("risk"), "id")


@query(f"""{_BASE}, o AS (SELECT floor((0.7e0 * max(risk) + 0.3e0 * avg(risk)) * 1e6 + 0.5e0) / 1e6 AS value FROM r)
    SELECT 'overall' AS grain, '*' AS key, value, CASE WHEN value >= 0.9e0 THEN 'CRITICAL' WHEN value >= 0.7e0 THEN 'HIGH' WHEN value >= 0.5e0 THEN 'MEDIUM' WHEN value >= 0.2e0 THEN 'LOW' ELSE 'MINIMAL' END AS level FROM o
    UNION ALL SELECT 'severity', severity, floor(max(risk) * 1e6 + 0.5e0) / 1e6, NULL FROM r GROUP BY severity
    UNION ALL SELECT 'class', vuln_class, floor(max(risk) * 1e6 + 0.5e0) / 1e6, NULL FROM r GROUP BY vuln_class""")
def aggregate_risk(spark, sf_dir):
    return risk.aggregate(risk.prioritize(findings(spark, sf_dir)))


def _advice(table: dict, name: str) -> str:
    return "CASE vuln_class " + " ".join(f"WHEN '{k}' THEN " + "'" + "; ".join(v).replace("'", "''") + "'" for k, v in table.items() if k != "*") + f" ELSE '{table['*'][0]}' END AS {name}"


@query(f"""{_BASE} SELECT vuln_class, count(*) AS finding_count, CASE WHEN max(risk) >= 0.8e0 THEN 'IMMEDIATE' WHEN max(risk) >= 0.6e0 THEN 'HIGH' WHEN max(risk) >= 0.4e0 THEN 'MEDIUM' ELSE 'LOW' END AS urgency,
    {_advice(model.REMEDIATION, "steps")}, {_advice(model.GUIDELINES, "guidelines")}, {_advice(model.TOOLS, "tools")} FROM r GROUP BY vuln_class""")
def recommendations(spark, sf_dir):
    return risk.recommend(risk.prioritize(findings(spark, sf_dir)))


_DAILY = f"{_BASE}, d AS (SELECT CAST(ts AS DATE) AS day, max(risk) * 0.7e0 + avg(risk) * 0.3e0 AS risk FROM r GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM d)"


def _daily(spark, sf_dir):
    d = risk.prioritize(findings(spark, sf_dir)).groupBy(F.to_date("ts").alias("ts"))
    return d.agg((F.max("risk") * F.lit(0.7) + F.avg("risk") * F.lit(0.3)).alias("risk"))


@query(f"""{_DAILY}, s AS (SELECT count(*) AS n, floor(regr_slope(risk, i) * 1e6 + 0.5e0) / 1e6 AS slope FROM n)
    SELECT n, slope, CASE WHEN slope > 0.01e0 THEN 'INCREASING' WHEN slope < -0.01e0 THEN 'DECREASING' ELSE 'STABLE' END AS direction FROM s""")
def risk_trend(spark, sf_dir):
    return risk.trend(_daily(spark, sf_dir))


@query(f"{_DAILY} SELECT CAST(day AS VARCHAR) AS day, floor(risk * 1e6 + 0.5e0) / 1e6 AS risk FROM (SELECT *, row_number() OVER (ORDER BY day DESC) AS back FROM d) WHERE back <= 30")
def risk_history_window(spark, sf_dir):
    d = _daily(spark, sf_dir).withColumn("back", F.row_number().over(Window.orderBy(F.desc("ts")))).where("back <= 30")
    return d.select(F.col("ts").cast("string").alias("day"), (F.floor(F.col("risk") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).alias("risk"))


@query(f"""{_BASE}, c AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY rank DESC, confidence DESC, id) AS place FROM r WHERE confidence >= 0.3e0),
    u AS (SELECT *, row_number() OVER (PARTITION BY file_path, line_start, vuln_class ORDER BY place) AS n FROM c WHERE place <= 50)
    SELECT id, file_path, line_start, severity, vuln_class, place FROM u WHERE n = 1""")
def findings_capped_dedup(spark, sf_dir):
    return risk.capped(findings(spark, sf_dir)).select("id", "file_path", "line_start", "severity", "vuln_class", "place")


@query(f"""{_BASE} SELECT file_path, count(*) AS n, CAST(sum(CASE WHEN severity = 'CRITICAL' THEN 1 ELSE 0 END) AS BIGINT) AS critical, CAST(sum(CASE WHEN severity = 'HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high,
    count(DISTINCT vuln_class) AS classes FROM r GROUP BY file_path""")
def scan_stats(spark, sf_dir):
    count = lambda s: F.count_if(F.col("severity") == s)
    return findings(spark, sf_dir).groupBy("file_path").agg(F.count("*").alias("n"), count("CRITICAL").alias("critical"), count("HIGH").alias("high"), F.count_distinct("vuln_class").alias("classes"))


@query(f"""WITH f AS ({FINDINGS_SQL}), h AS (SELECT sha256(file_path || '|' || line_start || '|' || vuln_class || '|' || title) AS hash, ts < TIMESTAMP '2024-01-16' AS old FROM f),
    g AS (SELECT hash, bool_or(old) AS o, bool_or(NOT old) AS n FROM h GROUP BY hash)
    SELECT hash, CASE WHEN NOT o THEN 'new' WHEN NOT n THEN 'fixed' ELSE 'persistent' END AS status FROM g""")
def compare_scans(spark, sf_dir):
    f = findings(spark, sf_dir)
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return risk.compare(f.where(F.col("ts") < cut), f.where(F.col("ts") >= cut))


@query(f"""WITH f AS ({FINDINGS_SQL}) SELECT id, vuln_class AS rule_id, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END AS level,
    file_path AS uri, line_start, sha256(file_path || line_start) AS line_hash, replace(replace(replace(replace(file_path || ' <' || title || '> & "x"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html FROM f""")
def sarif_rows(spark, sf_dir):
    f = findings(spark, sf_dir)
    html = report.escape_html(F.concat("file_path", F.lit(" <"), "title", F.lit('> & "x"')))
    return report.sarif(f).withColumn("html", html).select("id", "rule_id", "level", "uri", "line_start", "line_hash", "html")


@query(f"SELECT vuln_class, CASE WHEN vuln_class IN ({', '.join(map(repr, model.SARIF_ERROR))}) THEN 'error' WHEN vuln_class IN ({', '.join(map(repr, model.SARIF_WARNING))}) THEN 'warning' ELSE 'note' END AS level, cwe_id FROM (SELECT DISTINCT vuln_class FROM ({FINDINGS_SQL})) JOIN ({values(model.CLASSES)}) t(vuln_class, ordinal, w, c, i, a, cwe_id, exploit, impact_est) USING (vuln_class)")
def sarif_rules(spark, sf_dir):
    return report.rules(findings(spark, sf_dir))


@query(f"{_BASE} SELECT severity, vuln_class, count(*) AS n, '| ' || severity || ' | ' || vuln_class || ' | ' || count(*) || ' |' AS row FROM r GROUP BY severity, vuln_class")
def markdown_summary(spark, sf_dir):
    return report.markdown_counts(findings(spark, sf_dir))


@query(f"{_V} SELECT cve_id, cvss, cwe_id FROM v WHERE cvss >= 7e0 AND cwe_id = 'CWE-89'")
def cve_search(spark, sf_dir):
    return advisories.search(advisory_view(spark, sf_dir), "CWE-89", 7.0).select("cve_id", "cvss", "cwe_id")


@query(f"{_V} SELECT cwe_id, count(*) AS n, floor(avg(cvss) * 1e6 + 0.5e0) / 1e6 AS avg_cvss, max(cvss) AS max_cvss FROM v GROUP BY cwe_id")
def cve_by_cwe(spark, sf_dir):
    return advisories.by_cwe(advisory_view(spark, sf_dir)).withColumn("avg_cvss", F.floor(F.col("avg_cvss") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6))


@query(f"""{_V}, y AS (SELECT CAST(unnest(range(1999, 2004)) AS INTEGER) AS year), g AS (SELECT year(published) AS year, count(*) AS n, avg(cvss) AS m, sum(CASE WHEN cvss >= 9 THEN 1 ELSE 0 END) AS k FROM v GROUP BY 1)
    SELECT y.year, coalesce(n, 0) AS n, floor(coalesce(m, 0e0) * 1e6 + 0.5e0) / 1e6 AS avg_cvss, CAST(coalesce(k, 0) AS BIGINT) AS n_critical FROM y LEFT JOIN g USING (year)""")
def cve_yearly_trend(spark, sf_dir):
    return advisories.yearly(advisory_view(spark, sf_dir), 2003).withColumn("avg_cvss", F.floor(F.col("avg_cvss") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6))


_TOP = "t AS (SELECT *, row_number() OVER (PARTITION BY cwe_id ORDER BY cvss DESC, cve_id) AS place FROM v)"


@query(f"{_BASE}, v AS ({ADVISORIES_SQL}), {_TOP} SELECT id, cve_id, cvss, place FROM r JOIN t USING (cwe_id) WHERE place <= 5")
def cve_correlate_top5(spark, sf_dir):
    return advisories.correlate(findings(spark, sf_dir), advisory_view(spark, sf_dir))


@query(f"""{_BASE}, v AS (SELECT * FROM ({ADVISORIES_SQL}) WHERE cvss >= 5), {_TOP}, b AS (SELECT cwe_id, count(*) AS n_cves, sum(cvss) AS s FROM t WHERE place <= 5 GROUP BY cwe_id)
    SELECT id, cwe_id, coalesce(n_cves, 0) AS n_cves, floor(greatest(0e0, least(1e0, CASE WHEN s IS NOT NULL THEN 0.5e0 * confidence + 0.5e0 * (s / n_cves) / 10e0 ELSE confidence END)) * 1e6 + 0.5e0) / 1e6 AS risk
    FROM r LEFT JOIN b USING (cwe_id)""")
def cve_enrich(spark, sf_dir):
    d = advisories.enrich(findings(spark, sf_dir), advisory_view(spark, sf_dir)).drop("exploit")
    return d.withColumn("risk", F.floor(F.col("risk") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6))


@query(f"""{_BASE}, v AS (SELECT * FROM ({ADVISORIES_SQL}) WHERE cvss >= 5), {_TOP}, o AS (SELECT DISTINCT cve_id FROM ({ADVISORIES_SQL}) JOIN orders ON o_orderkey = CAST(split_part(cve_id, '-', 3) AS BIGINT) WHERE o_orderstatus = 'O'),
    b AS (SELECT cwe_id, count(*) AS n_cves, sum(cvss) AS s, bool_or(o.cve_id IS NOT NULL) AS exploit FROM t LEFT JOIN o ON o.cve_id = t.cve_id WHERE place <= 5 GROUP BY cwe_id),
    k AS (SELECT id, cwe_id, coalesce(n_cves, 0) AS n_cves, coalesce(exploit, false) AS exploit, CASE WHEN s IS NOT NULL THEN 0.5e0 * confidence + 0.5e0 * (s / n_cves) / 10e0 ELSE confidence END AS x FROM r LEFT JOIN b USING (cwe_id))
    SELECT id, cwe_id, n_cves, exploit, floor(greatest(0e0, least(1e0, CASE WHEN exploit THEN least(x * 1.3e0, 1e0) ELSE x END)) * 1e6 + 0.5e0) / 1e6 AS risk FROM k""")
def cve_exploited(spark, sf_dir):
    """Enrichment where the orders of one status stand for advisories with a known exploit."""
    known = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'O'").select(F.lpad(F.col("o_orderkey").cast("string"), 7, "0").alias("number"))
    view = advisory_view(spark, sf_dir)
    known = view.join(known, F.substring_index("cve_id", "-", -1) == F.col("number")).select("cve_id")
    d = advisories.enrich(findings(spark, sf_dir), view, exploited=known)
    return d.withColumn("risk", F.floor(F.col("risk") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6))



@query(f"""{_BASE}, v AS ({ADVISORIES_SQL}), {_TOP}, u AS (SELECT DISTINCT cwe_id FROM r), c AS (SELECT count(DISTINCT cve_id) AS n_cves, max(cvss) AS max_cvss, floor(avg(cvss) * 1e6 + 0.5e0) / 1e6 AS avg_cvss FROM t JOIN u USING (cwe_id) WHERE place <= 5)
    SELECT (SELECT count(*) FROM r) AS n_findings, n_cves, max_cvss, avg_cvss, CASE WHEN max_cvss >= 9 THEN 'CRITICAL' WHEN max_cvss >= 7 THEN 'HIGH' WHEN max_cvss >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM c""")
def cve_impact(spark, sf_dir):
    d = advisories.impact(findings(spark, sf_dir), advisory_view(spark, sf_dir))
    return d.withColumn("avg_cvss", F.floor(F.col("avg_cvss") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6))


@query(f"{_V} SELECT DISTINCT cve_id, cwe_id FROM v WHERE cwe_id IN ('CWE-94', 'CWE-89') AND published > TIMESTAMP '2001-01-01'")
def cve_monitor_new(spark, sf_dir):
    return advisories.new_since(advisory_view(spark, sf_dir), ["CWE-94", "CWE-89"], "2001-01-01").select("cve_id", "cwe_id")


@query(f"""{_V}, x AS (SELECT 'see ' || cve_id || ' and CVE-21-1, ' || replace(cve_id, '-0', '-9') AS note FROM v), e AS (SELECT unnest(regexp_extract_all(note, 'CVE-(\\d{{4}})-(\\d+)')) AS cve_id FROM x)
    SELECT cve_id, CAST(split_part(cve_id, '-', 2) AS INTEGER) AS year, CAST(split_part(cve_id, '-', 3) AS BIGINT) AS number, regexp_full_match(cve_id, 'CVE-\\d{{4}}-\\d{{4,}}') AS valid FROM e""")
def cve_parse(spark, sf_dir):
    v = advisory_view(spark, sf_dir).select(F.concat(F.lit("see "), "cve_id", F.lit(" and CVE-21-1, "), F.replace("cve_id", F.lit("-0"), F.lit("-9"))).alias("note"))
    return advisories.parse_ids(v, "note").select("cve_id", "year", "number", advisories.is_valid(F.col("cve_id")).alias("valid"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, vec_id, list_dot_product(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(qe AS DOUBLE[]), CAST(qe AS DOUBLE[]))) * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS sim FROM q, embeddings),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(sim * 1e6 + 0.5e0) DESC, vec_id) AS place FROM s)
    SELECT query_id, vec_id, place, floor(sim * 1e6 + 0.5e0) / 1e6 AS similarity FROM k WHERE place <= 5""")
def similar_topk(spark, sf_dir):
    return ml.similar_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 5)


@query("""WITH c AS (SELECT CAST(quality AS INTEGER) AS actual, CAST(toxic AS INTEGER) AS predicted, count(*) AS n FROM labels GROUP BY 1, 2), t AS (SELECT sum(n) AS total, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS hit FROM c),
    k AS (SELECT unnest([0, 1]) AS cls), s AS (SELECT cls, coalesce(sum(CASE WHEN actual = cls AND predicted = cls THEN n END), 0) AS tp, coalesce(sum(CASE WHEN actual <> cls AND predicted = cls THEN n END), 0) AS fpos, coalesce(sum(CASE WHEN actual = cls AND predicted <> cls THEN n END), 0) AS fneg FROM k, c GROUP BY cls),
    m AS (SELECT avg(CASE WHEN tp + fpos > 0 THEN tp / (tp + fpos) ELSE 0e0 END) AS p, avg(CASE WHEN tp + fneg > 0 THEN tp / (tp + fneg) ELSE 0e0 END) AS r FROM s)
    SELECT floor(hit / total * 1e6 + 0.5e0) / 1e6 AS accuracy, floor(p * 1e6 + 0.5e0) / 1e6 AS "precision", floor(r * 1e6 + 0.5e0) / 1e6 AS recall, floor(2 * p * r / (p + r + 1e-10) * 1e6 + 0.5e0) / 1e6 AS f1 FROM t, m""")
def classifier_metrics(spark, sf_dir):
    return ml.metrics(spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("quality").alias("actual"), F.col("toxic").alias("predicted")), [0, 1]).drop("n")


@query("""WITH g AS (SELECT source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2), t AS (SELECT source, sum(n) AS total FROM g GROUP BY 1)
    SELECT source, floor((1e0 - sum((n / total) * (n / total))) * 1e6 + 0.5e0) / 1e6 AS gini FROM g JOIN t USING (source) GROUP BY source""")
def gini_by_group(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return ml.gini(d, "source", "quality")


@query("""WITH e AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), s AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM e GROUP BY dim)
    SELECT vec_id, CAST(dim AS INTEGER) AS dim, CASE WHEN hi > lo THEN floor((x - lo) / (hi - lo) * 1e6 + 0.5e0) / 1e6 ELSE 0e0 END AS minmax FROM e JOIN s USING (dim)""")
def minmax_features(spark, sf_dir):
    return ml.minmax(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query(f"WITH f AS ({FINDINGS_SQL}), k(tag, name) AS ({values(list(_PLAIN.items()))}), n(name, cls) AS ({values(list(model.CLASS_NAMES.items()))}) SELECT id, coalesce(cls, 'INJECTION') AS vuln_class FROM f JOIN k USING (tag) LEFT JOIN n ON n.name = lower(k.name)")
def class_names(spark, sf_dir):
    return findings(spark, sf_dir).select("id", explain.class_of_name(model.choose(F.col("tag"), _PLAIN, "")).alias("vuln_class"))


@query(f"WITH f AS ({FINDINGS_SQL}), {_CLASSES}, nt(cwe_id, cves) AS ({values([(k, ','.join(v)) for k, v in model.NOTABLE.items()])}), kw(vuln_class, words) AS ({values([(k, ','.join(v)) for k, v in model.KEYWORDS.items()])}) SELECT id, coalesce(cves, '') AS notable, coalesce(words, f.vuln_class) AS keywords FROM f JOIN classes USING (vuln_class) LEFT JOIN nt USING (cwe_id) LEFT JOIN kw USING (vuln_class)")
def notable_advisories(spark, sf_dir):
    c = F.col("vuln_class")
    return findings(spark, sf_dir).select("id", F.array_join(advisories.notable(model.of_class(c, 6, "CWE-20")), ",").alias("notable"), F.array_join(advisories.keywords(c), ",").alias("keywords"))


@query(f"""{_V}, d AS (SELECT cve_id, cvss, CASE WHEN cvss >= 9 THEN 'CRITICAL' WHEN cvss >= 7 THEN 'HIGH' WHEN cvss >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity, repeat(cwe_id || ' ', 9) AS description FROM v)
    SELECT cve_id, CASE severity WHEN 'CRITICAL' THEN '🔴' WHEN 'HIGH' THEN '🟠' WHEN 'MEDIUM' THEN '🟡' ELSE '🟢' END || ' ' || cve_id || ' (CVSS: ' || cvss || ')' AS shown, '| ' || cve_id || ' | ' || cvss || ' | ' || severity || ' | ' || CASE WHEN length(description) > 50 THEN substr(description, 1, 50) || '...' ELSE description END || ' |' AS row FROM d""")
def cve_lines(spark, sf_dir):
    s = F.when(F.col("cvss") >= 9, "CRITICAL").when(F.col("cvss") >= 7, "HIGH").when(F.col("cvss") >= 4, "MEDIUM").otherwise("LOW")
    d = advisory_view(spark, sf_dir).select("cve_id", "cvss", s.alias("severity"), F.repeat(F.concat("cwe_id", F.lit(" ")), F.lit(9)).alias("description"))
    return advisories.section_rows(d).select("cve_id", advisories.display(F.col("cve_id"), F.col("cvss"), F.col("severity")).alias("shown"), "row")


_FIX = "CASE vuln_class " + " ".join(f"WHEN '{c}' THEN '" + "; ".join(v).replace("'", "''") + "'" for c, v in model.REMEDIATION.items() if c != "*") + f" ELSE '{model.REMEDIATION['*'][0]}' END"


@query(f"""WITH f AS ({FINDINGS_SQL}), {_CLASSES}, d AS (SELECT f.*, cwe_id, {_FIX} AS fix, CAST(round(confidence * 100) AS INTEGER) AS pct, CASE severity {' '.join(f"WHEN '{s}' THEN '{m}'" for s, m in report.MARKS.items())} END AS mark, file_path || ':' || line_start AS spot FROM f JOIN classes USING (vuln_class))
    SELECT id, '{{"id":"' || id || '","vuln_class":"' || vuln_class || '","severity":"' || severity || '","confidence":' || confidence || ',"title":"' || title || '","location":{{"file":"' || file_path || '","line_start":' || line_start || '}},"cwe_id":"' || cwe_id || '","remediation":"' || fix || '"}}' AS json,
    '### ' || mark || ' ' || title || chr(10) || chr(10) || '**Severity:** ' || severity || '  ' || chr(10) || '**Vulnerability Type:** ' || vuln_class || '  ' || chr(10) || '**Location:** `' || spot || '`  ' || chr(10) || '**Confidence:** ' || pct || '%  ' || chr(10) || '**CWE:** ' || cwe_id || chr(10) || chr(10) || fix || chr(10) AS markdown,
    '<article class="' || lower(severity) || '"><h3>' || title || '</h3><p>' || severity || ' | ' || spot || ' | ' || vuln_class || ' | ' || cwe_id || ' | ' || pct || '%</p><p>' || fix || '</p></article>' AS html FROM d""")
def report_parts(spark, sf_dir):
    return report.rendered(report.described(findings(spark, sf_dir))).select("id", "json", "markdown", "html")
