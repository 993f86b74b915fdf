"""What stands beside a finding: estimates, reasons, remediation, references; languages and class names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import model
from riskloom.operators import features


def class_of_name(name: Column) -> Column:
    """The class that a plain name stands for, in any case; INJECTION where none does."""
    return model.choose(F.lower(name), model.CLASS_NAMES, "INJECTION")


def exploitability(cls: Column) -> Column:
    return model.of_class(cls, 7, 0.5)


def impact(cls: Column) -> Column:
    return model.of_class(cls, 8, 0.5)


def cvss_estimate(overall: Column, exploit: Column, harm: Column) -> Column:
    """From 0 to 10: three fifths impact and two exploitability, or where one is not above 0 the overall risk."""
    both = F.when((exploit > 0) & (harm > 0), (F.lit(0.6) * harm + F.lit(0.4) * exploit) * F.lit(10.0)).otherwise(overall * F.lit(10.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), both))


def fixes(cls: Column) -> Column:
    return model.choose(cls, {k: v for k, v in model.FIXES.items() if k != "*"}, model.FIXES["*"])


def references(cls: Column) -> Column:
    return F.concat(F.array(*map(F.lit, model.BASE_REFERENCES)), model.choose(cls, {k: [v] for k, v in model.REFERENCES.items()}, F.array().cast("array<string>")))


def reasons(cls: Column) -> Column:
    """Of a row of features with the names of its dangerous functions: sentences that speak for the class."""
    told = {"names": (F.size("names") > 0, F.array_join("names", ", "))}
    said = [F.when(there, F.replace(F.lit(sentence), F.lit("{}"), text)) for c, sentence in model.SAID for there, text in [told.get(c, (F.col(c) > 0, F.col(c).cast("string")))]]
    said.append(model.choose(cls, model.REASONS, None))
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def predictions(files: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A row for each class that the scoring model gives a file: place, risk, reasons, remediation, references.

    Names of dangerous functions come in alphabetical order. All from one scan of the files; nothing is joined.
    """
    feats = features.features(files, keep=[F.array_sort(features.dangerous("content", "language")).alias("names"), features.first_lines("content").alias("places")])
    rows = features.scored(threshold)
    d = feats.select("*", F.explode(rows).alias("r")).select("*", "r.vuln_class", "r.prob")
    cls = F.col("vuln_class")
    d = d.withColumns({"line_start": F.coalesce(F.col("places")[cls], F.lit(1)), "exploitability": exploitability(cls), "impact": impact(cls), "reasoning": reasons(cls), "remediation": fixes(cls), "references": references(cls)})
    return d.select("path", "vuln_class", "line_start", F.col("prob").alias("overall"), "exploitability", "impact", cvss_estimate(F.col("prob"), F.col("exploitability"), F.col("impact")).alias("cvss"), "reasoning", "remediation", "references")


def language_profile(language: Column) -> Column:
    """A struct of what a language guards against, and the classes that are common in it; null for others."""
    names = ("pointers", "manual_memory", "garbage_collection", "type_safety", "bounds_checking", "null_safety")
    out = None
    for k, (flags, common) in model.LANGUAGES.items():
        s = F.struct(*[F.lit(x).alias(n) for n, x in zip(names, flags, strict=True)], F.array(*map(F.lit, common)).alias("common"))
        out = F.when(language == k, s) if out is None else out.when(language == k, s)
    return out
