"""Risk, CVSS, priorities, aggregates, recommendations, trends, comparison of scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom import model


def risk(severity: Column, vuln_class: Column, confidence: Column, fp: Column) -> Column:
    """Severity and class weights, less for doubt and for likely false positives; 0 to 1."""
    r = model.severity_weight(severity) * model.of_class(vuln_class, 2, 0.5) * (F.lit(1.0) - F.lit(0.3) * (F.lit(1.0) - confidence)) * (F.lit(1.0) - fp)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), r))


def cvss(df: DataFrame) -> DataFrame:
    """Adds exploitability, impact and cvss (base score, rounded up to a tenth) by class."""
    c = F.col("vuln_class")
    ac = F.when(c.isin("RACE_CONDITION", "USE_AFTER_FREE"), 0.44).otherwise(0.77)
    pr = F.when(c == "AUTHENTICATION_BYPASS", 0.85).otherwise(0.62)
    ui = F.when(c.isin("XSS", "DESERIALIZATION"), 0.62).otherwise(0.85)
    changed = c.isin("CODE_EXECUTION", "PRIVILEGE_ESCALATION")
    conf, integ, avail = (model.of_class(c, i, 0.22) for i in (3, 4, 5))
    isc = F.lit(1.0) - (F.lit(1.0) - conf) * (F.lit(1.0) - integ) * (F.lit(1.0) - avail)
    df = df.withColumn("exploitability", F.lit(8.22) * F.lit(0.85) * ac * pr * ui).withColumn("_isc", isc)
    df = df.withColumn("impact", F.when(changed, F.lit(7.52) * (F.col("_isc") - F.lit(0.029)) - F.lit(3.25) * F.pow(F.col("_isc") - F.lit(0.02), F.lit(15.0))).otherwise(F.lit(6.42) * F.col("_isc")))
    total = F.col("impact") + F.col("exploitability")
    base = F.when(F.col("impact") <= 0, 0.0).otherwise(F.least(F.when(changed, F.lit(1.08) * total).otherwise(total), F.lit(10.0)))
    return df.withColumn("cvss", F.ceil(base * F.lit(10.0)).cast("double") / F.lit(10.0)).drop("_isc")


def cvss_severity(score: Column) -> Column:
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score >= 0.1, "LOW").otherwise("INFO")


def priority(r: Column) -> Column:
    return F.when(r >= 0.9, 1).when(r >= 0.7, 2).when(r >= 0.5, 3).when(r >= 0.3, 4).otherwise(5)


def effort(c: Column) -> Column:
    return F.when(c.isin(model.EFFORT_HIGH), "High (days)").when(c.isin(model.EFFORT_MEDIUM), "Medium (hours)").otherwise("Low (minutes)")


def prioritize(findings: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds risk (times the context weights of the finding's tag), cvss, priority and effort."""
    r = risk(F.col("severity"), F.col("vuln_class"), F.col("confidence"), F.col("fp"))
    for tag, w in (weights or {}).items():
        r = r * F.when(F.col("tag") == tag, w).otherwise(1.0)
    df = findings.withColumn("risk", F.greatest(F.lit(0.0), F.least(F.lit(1.0), r)))
    return cvss(df).withColumn("priority", priority(F.col("risk"))).withColumn("effort", effort(F.col("vuln_class")))


def aggregate(df: DataFrame) -> DataFrame:
    """(grain, key, value, level): overall risk, and the greatest by severity and by class; (0, LOW) for no findings.

    One pass over grouping sets; the overall row sums up those of severities.
    """
    g = df.groupingSets([[F.col("severity")], [F.col("vuln_class")]], "severity", "vuln_class").agg(F.max("risk").alias("top"), F.sum("risk").alias("total"), F.count("risk").alias("n"), F.grouping_id().alias("gid"))
    tidy = lambda v: F.floor(v * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)
    keys = g.select(F.when(F.col("gid") == 1, "severity").otherwise("class").alias("grain"), F.coalesce("severity", "vuln_class").alias("key"), tidy(F.col("top")).alias("value"), F.lit(None).cast("string").alias("level"))
    o = g.where("gid = 1").agg(F.max("top").alias("top"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    value = F.coalesce(tidy(F.lit(0.7) * F.col("top") + F.lit(0.3) * (F.col("total") / F.col("n"))), F.lit(0.0))
    level = F.when(F.col("n").isNull(), "LOW").when(value >= 0.9, "CRITICAL").when(value >= 0.7, "HIGH").when(value >= 0.5, "MEDIUM").when(value >= 0.2, "LOW").otherwise("MINIMAL")
    return keys.union(o.select(F.lit("overall"), F.lit("*"), value, level))


def recommend(df: DataFrame) -> DataFrame:
    """One row for each class: how many findings, how urgent, what to do."""
    g = df.groupBy("vuln_class").agg(F.count("*").alias("finding_count"), F.max("risk").alias("top"))
    urgency = F.when(F.col("top") >= 0.8, "IMMEDIATE").when(F.col("top") >= 0.6, "HIGH").when(F.col("top") >= 0.4, "MEDIUM").otherwise("LOW")
    advice = [F.array_join(model.choose(F.col("vuln_class"), {k: v for k, v in t.items() if k != "*"}, t["*"]), "; ").alias(n) for n, t in (("steps", model.REMEDIATION), ("guidelines", model.GUIDELINES), ("tools", model.TOOLS))]
    return g.select("vuln_class", "finding_count", urgency.alias("urgency"), *advice)


def trend(series: DataFrame) -> DataFrame:
    """Direction and least-squares slope of (ts, risk) rows on their rank in time: a few rows, one for each period."""
    n = series.withColumn("i", F.row_number().over(Window.orderBy("ts")))
    s = n.agg(F.count("*").alias("n"), F.regr_slope("risk", "i").alias("slope"))
    slope = F.when(F.col("n") < 2, 0.0).otherwise(F.floor(F.col("slope") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6))
    return s.select("n", slope.alias("slope")).withColumn("direction", F.when(F.col("slope") > 0.01, "INCREASING").when(F.col("slope") < -0.01, "DECREASING").otherwise("STABLE"))


def capped(df: DataFrame, most: int = 50, least: float = 0.3) -> DataFrame:
    """Per file: at least ``least`` confident, the ``most`` gravest, then the first of each line and class. The order matters."""
    w = Window.partitionBy("file_path").orderBy(F.desc("rank"), F.desc("confidence"), "id")
    once = Window.partitionBy("file_path", "line_start", "vuln_class").orderBy("place")
    d = df.where(F.col("confidence") >= least).withColumn("rank", model.severity_rank(F.col("severity"))).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return d.withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")


def fingerprint() -> Column:
    return F.sha2(F.concat_ws("|", "file_path", F.col("line_start").cast("string"), "vuln_class", "title"), 256)


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(hash, status): new, fixed or persistent. Hashes are aggregated first, so copies never multiply."""
    h = lambda d, n: d.select(fingerprint().alias("hash")).distinct().withColumn(n, F.lit(1))
    j = h(old, "o").join(h(new, "n"), "hash", "full")
    return j.select("hash", F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "fixed").otherwise("persistent").alias("status"))
