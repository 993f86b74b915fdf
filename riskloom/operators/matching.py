"""Rule matching: occurrences with context, false positives, confidence, score; ids; summaries; changed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom import rules
from riskloom.functions.text import found, java, possible
from riskloom.rules import Pattern


def pattern_ids(files: DataFrame, patterns: list[Pattern] = rules.PATTERNS) -> DataFrame:
    """(path, pattern): rules of the file's language of which any regex is found in the whole text; the first hit ends the search."""
    hits, files = [], files.where(possible("content", [r for p in patterns for r in p.regexes]))
    for p in patterns:
        mine = F.col("language").isin(list(p.languages))
        any_ = F.lit(False)
        for r in p.regexes:
            any_ = any_ | found("content", r)
        hits.append(F.when(mine & any_, F.lit(p.name)))
    return files.select("path", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("pattern"))


def _attribute(patterns: list[Pattern], value) -> Column:
    out = None
    for p in patterns:
        out = F.when(F.col("pattern") == p.name, F.lit(value(p))) if out is None else out.when(F.col("pattern") == p.name, F.lit(value(p)))
    return out


def reason(patterns: list[Pattern]) -> Column:
    """Why a match is a false positive, or null; the first rule that holds."""
    c, t = F.col("context"), F.col("text")
    out = None
    for key, (regex, why) in rules.EXCLUSIONS.items():
        names = [p.name for p in patterns if key in p.excludes]
        cond = F.col("pattern").isin(names) & c.rlike(regex)
        out = F.when(cond, why) if out is None else out.when(cond, why)
    out = out.when(c.rlike(rules.TEST_WORDS) & t.rlike(rules.COMMENT_MARKS), "Appears to be test/example code")
    out = out.when(c.rlike(rules.CLEANERS), "Sanitization appears to be present")
    return out.when((F.col("vuln_class") == "INJECTION") & c.rlike(rules.PREPARED), "Appears to use parameterized query")


def confidence(patterns: list[Pattern]) -> Column:
    c, m = F.col("context"), F.col("matched")
    x = _attribute(patterns, lambda p: p.severity) * _attribute(patterns, lambda p: p.weight)
    needs = lambda key: F.col("pattern").isin([p.name for p in patterns if key in p.requires])
    x = x * F.when(needs("has_bounds_check") & ~c.rlike(rules.BOUNDS_CHECK), 1.1).otherwise(1.0)
    x = x * F.when(needs("in_security_context") & c.rlike(rules.SECURITY_WORDS), 1.2).otherwise(1.0)
    x = x * F.when(m.isin("=", "+", "(", ")"), 0.7).otherwise(1.0) * F.when(F.char_length(m) < 5, 0.8).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def match(lines: DataFrame, patterns: list[Pattern] = rules.PATTERNS) -> DataFrame:
    """Every occurrence of every regex of the language's rules on every line, and of custom rules' literal words.

    All rules are one array expression on the line; only lines with hits give rows, so there is no join and no shuffle.
    """

    def hit(p: Pattern, i: int):
        return lambda m: F.struct(F.lit(p.name).alias("pattern"), F.lit(p.vuln_class).alias("vuln_class"), F.lit(i).alias("regex_no"), m.alias("matched"))

    hits = []
    for p in patterns:
        mine = F.col("language").isin(list(p.languages))
        for i, r in enumerate(p.regexes):
            hits.append(F.when(mine & found("text", r), F.transform(F.regexp_extract_all("text", F.lit(java(r)), F.lit(0)), hit(p, i))))
        for w in p.semantic:
            hits.append(F.when(mine & F.contains("text", F.lit(w)), F.transform(F.array(F.lit(w)), hit(p, -1))))
    any_ = possible("text", [r for p in patterns for r in p.regexes])
    for w in {w for p in patterns for w in p.semantic}:
        any_ = any_ | F.contains("text", F.lit(w))
    d = lines.where(any_).select("path", "language", "line_no", "text", "context", F.explode(F.flatten(F.filter(F.array(*hits), lambda x: x.isNotNull()))).alias("h"))
    d = d.select("path", "line_no", "text", "context", "h.*")
    d = d.withColumn("confidence", confidence(patterns)).withColumn("fp_reason", reason(patterns))
    score = _attribute(patterns, lambda p: p.severity) * F.lit(100.0) * F.col("confidence")
    score = score * F.when(F.col("fp_reason").isNotNull(), 0.1).otherwise(1.0) * F.when(F.col("vuln_class").isin(rules.CRITICAL_CLASSES), 1.5).otherwise(1.0)
    return d.withColumn("score", score)


def summarize(matches: DataFrame) -> DataFrame:
    """By rule: occurrences, false positives, mean confidence."""
    return matches.groupBy("pattern", "vuln_class").agg(F.count("*").alias("n"), F.count("fp_reason").alias("false_positives"), F.avg("confidence").alias("avg_confidence"))


def incremental(files: DataFrame, changed: DataFrame, around: int = 5, patterns: list[Pattern] = rules.PATTERNS) -> DataFrame:
    """(path, line_no, pattern, confidence): matches on changed lines (path, line_no) and ``around`` lines on each side.

    Each changed line's neighbourhood is the context of all in it; of one rule and line, the most confident match
    stays, false positives too. Files without a changed line leave before their lines are made.
    """
    at = changed.groupBy("path").agg(F.array_sort(F.collect_set(F.col("line_no").cast("int"))).alias("at"))
    d = files.join(at, "path").select("path", "language", F.split("content", "\n", -1).alias("ls"), F.explode("at").alias("mid")).where(F.col("mid").between(1, F.size("ls")))
    d = d.withColumn("first", F.greatest(F.col("mid") - around, F.lit(1)))
    d = d.select("path", "language", "first", F.slice("ls", F.col("first"), F.col("mid") + around - F.col("first") + 1).alias("chunk"))
    d = d.select("path", "language", F.posexplode("chunk").alias("i", "text"), (F.col("first")).alias("first"), F.array_join("chunk", "\n").alias("context"))
    near = d.select("path", "language", (F.col("first") + F.col("i")).alias("line_no"), "text", "context")
    return match(near, patterns).groupBy("path", "line_no", "pattern").agg(F.max("confidence").alias("confidence"))


def ranked(matches: DataFrame) -> DataFrame:
    """Matches of each file by falling score: adds place; ties by line, rule, regex and text."""
    w = Window.partitionBy("path").orderBy(F.desc("score"), "line_no", "pattern", "regex_no", "matched")
    return matches.withColumn("place", F.row_number().over(w))


def applying(files: DataFrame, patterns: list[Pattern] = rules.PATTERNS) -> DataFrame:
    """(path, pattern): the rules of a file's language."""
    mine = F.filter(F.array(*[F.when(F.col("language").isin(list(p.languages)), p.name) for p in patterns]), lambda x: x.isNotNull())
    return files.select("path", F.explode(mine).alias("pattern"))
