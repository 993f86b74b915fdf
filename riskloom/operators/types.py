"""Types that files define, with fields and methods, and functions with their parameters."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions.text import by_language, java


def functions_of(files: DataFrame) -> DataFrame:
    """(path, name, regex_no): every function definition of a file, by the language's regexes."""
    none = F.array().cast("array<array<string>>")
    names = by_language("language", rules.FUNCTIONS, lambda v: F.array(*[F.regexp_extract_all("content", F.lit(java(r)), F.lit(1)) for r in v]), none)
    return files.select("path", F.posexplode(names).alias("regex_no", "names")).select("path", "regex_no", F.explode("names").alias("name"))


def block(text: str, start: int) -> str:
    """From a place to the } that closes what { and : have opened since; one character where none does."""
    depth = 0
    for i in range(start, len(text)):
        if text[i] in "{:":
            depth += 1
        elif text[i] == "}":
            depth -= 1
            if depth <= 0:
                return text[start : i + 1]
    return text[start : start + 1]


def types_of(text: str, language: str) -> dict[str, tuple[list[str], list[str], bool]]:
    """Fields, methods and whether a method's name sounds dangerous, by type name; of one name, the last."""
    found = {}
    type_regex, field_regex = rules.TYPES.get(language, rules.TYPES["*"])
    for m in re.finditer(type_regex, text):
        body = block(text, m.start())
        fields = list(dict.fromkeys(re.findall(field_regex, body)))
        methods = list(dict.fromkeys(x for r in rules.FUNCTIONS.get(language, []) for x in re.findall(r, body)))
        found[m.group(1)] = fields, methods, any(w in x.lower() for x in methods for w in rules.DANGEROUS_METHODS)
    return found


def type_info(files: DataFrame) -> DataFrame:
    """(path, name, fields, methods, dangerous) of each type; only files that name one leave the JVM."""
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("fields", pa.list_(pa.string())), ("methods", pa.list_(pa.string())), ("dangerous", pa.bool_())])

    def run(batches):
        for b in batches:
            rows = [(p, n, *t) for p, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for n, t in types_of(text, lang).items()]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    hit = by_language("language", {k: v[0] for k, v in rules.TYPES.items()}, lambda r: F.col("content").rlike(java(r)), None)
    return files.where(hit).select("path", "language", "content").mapInArrow(run, "path string, name string, fields array<string>, methods array<string>, dangerous boolean")
