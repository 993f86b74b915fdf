"""Features of files, the default scoring model, and first places that speak for a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import model, rules
from riskloom.functions import text as T

CALL = r"([a-zA-Z_][a-zA-Z0-9_.:]*)\s*\("


def dangerous(content, language):
    """The distinct called names that are, or end in, a dangerous one."""
    content = F.col(content) if isinstance(content, str) else content
    names = F.array_distinct(F.regexp_extract_all(content, F.lit(CALL), F.lit(1)))
    known = T.by_language(language, rules.DANGEROUS, lambda v: F.array(*map(F.lit, v)), F.array().cast("array<string>"))
    hits = F.filter(names, lambda n: F.array_contains(known, n) | F.array_contains(known, F.element_at(F.split(n, "[.:]"), -1)))
    return F.when(~F.contains(content, F.lit("(")), F.array().cast("array<string>")).otherwise(hits)  # no call without one


def unchecked(content):
    return F.size(F.filter(F.split(content, "\n"), lambda x: F.contains(x, F.lit("(")) & x.rlike(rules.LONE_CALL) & ~x.rlike(r"^\s*(//|#)") & ~x.rlike(rules.CHECKED_CALL)))


def features(files: DataFrame, keep: list[Column] = ()) -> DataFrame:
    """path, language, counts and the columns ``keep``; every count is an expression on the row, so the plan is one scan."""
    c = "content"
    zero = F.lit(0)
    lang = lambda table: T.by_language("language", table, lambda v: T.matches(c, v), zero)
    only_c = lambda e: F.when(F.col("language").isin("c", "cpp"), e).otherwise(0)
    d = files.select(
        "path", "language",
        T.complexity(c).alias("complexity"), T.nesting(c).alias("nesting"), lang(rules.FUNCTIONS).alias("functions"),
        lang(rules.INPUTS).alias("inputs"), lang(rules.SINKS).alias("sinks"),
        T.fast_matches(c, rules.FAMILIES["crypto"]).alias("crypto"), only_c(T.matches(c, rules.FAMILIES["memory"])).alias("memory"),
        T.fast_matches(c, rules.FAMILIES["file"]).alias("file_ops"), T.fast_matches(c, rules.FAMILIES["network"]).alias("network"),
        F.size(dangerous(c, "language")).alias("dangerous"), unchecked(c).alias("unchecked"), only_c(T.matches(c, rules.POINTERS)).alias("pointers"), *keep,
    )
    return d.withColumn("taint_flows", F.least(F.col("inputs") * F.col("sinks"), F.lit(100)))


#: names of the numbered features that the default model weighs
NUMBERED = {1: "complexity", 2: "nesting", 5: "inputs", 6: "sinks", 7: "crypto", 8: "memory", 9: "file_ops", 10: "network", 11: "dangerous", 12: "taint_flows", 13: "unchecked", 14: "pointers"}


def scored(threshold: float) -> Column:
    """Of a row of features: structs of the classes that the default model gives at least ``threshold``."""
    rows = []
    for c in model.CLASSES:
        w, bias = rules.WEIGHTS.get(c[0], rules.WEIGHTS["*"])
        x = sum((F.col(NUMBERED[i]) * F.lit(v) for i, v in w.items()), F.lit(0.0)) + F.lit(bias)
        rows.append(F.struct(F.lit(c[0]).alias("vuln_class"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x))))).alias("prob")))
    return F.filter(F.array(*rows), lambda r: r["prob"] >= threshold)


def predict(feats: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(path, vuln_class, prob) of the classes that the default model gives at least ``threshold``."""
    return feats.select("path", F.explode(scored(threshold)).alias("r")).select("path", "r.vuln_class", "r.prob")


def first_lines(content) -> Column:
    """A map from class to the first line that speaks for it; 1 where none does."""
    at = T.first_line_of(content, list(rules.LOCATIONS.values()))
    return F.map_from_arrays(F.array(*map(F.lit, rules.LOCATIONS)), at)


def locations(files: DataFrame) -> DataFrame:
    """(path, vuln_class, line): the first line that speaks for a class; 1 where none does."""
    return files.select("path", F.explode(first_lines("content")).alias("vuln_class", "line"))
