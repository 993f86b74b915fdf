"""Semantic checks, line-level data flow, taint, control lines and graphs over files of code."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom import model, rules
from riskloom.functions.lineage import cut
from riskloom.functions.text import by_language, extracted, found, java, matches, possible

_TRIM = " \t\r\f\x0b"
IDENT = r"[a-zA-Z_][a-zA-Z0-9_]*"


def stripped(lines: DataFrame) -> DataFrame:
    """path, language, line_no, text without surrounding space; blank lines go."""
    t = F.trim(F.col("text"), F.lit(_TRIM))
    return lines.select("path", "language", "line_no", t.alias("text")).where(F.col("text") != "")


def any_of(text: Column, regexes: list[str]) -> Column:
    out = F.lit(False)
    for r in regexes:
        out = out | found(text, r)
    return out


# --- semantic checks -------------------------------------------------------------------------------------------------


def unsafe_casts(lines: DataFrame) -> DataFrame:
    """(path, line_no, regex_no): each cast regex that a line matches."""
    t = F.col("text")
    none = F.array().cast("array<int>")
    hits = by_language("language", rules.CASTS, lambda v: F.array(*[F.when(found(t, r), i) for i, r in enumerate(v)]), none)
    return lines.select("path", "line_no", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("regex_no"))


def resource_leaks(files: DataFrame) -> DataFrame:
    """(path, opens, closes) where more is opened than closed."""
    count = lambda t: by_language("language", t, lambda v: matches("content", v), F.lit(0))
    return files.select("path", count(rules.OPENS).alias("opens"), count(rules.CLOSES).alias("closes")).where("opens > closes")


def privilege_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("text").rlike("(?i)(" + "|".join(rules.PRIVILEGES) + ")")).select("path", "line_no")


def symbols(lines: DataFrame) -> DataFrame:
    """(path, name, kind, line_no, tainted): the last declaration of each name in a file."""
    t = F.col("text")
    none = F.array().cast("array<struct<kind:string,names:array<string>>>")
    declared = by_language("language", rules.DECLARATIONS, lambda v: F.array(*[F.struct(F.lit(k).alias("kind"), extracted(t, r, 1).alias("names")) for k, r in v]), none)
    tainted = by_language("language", rules.INPUTS, lambda v: any_of(t, v), F.lit(False))
    d = stripped(lines).select("path", "line_no", tainted.alias("tainted"), F.posexplode(declared).alias("rank", "f")).select("path", "line_no", "tainted", "rank", "f.kind", F.explode("f.names").alias("name"))
    d = d.groupBy("path", "name").agg(F.max(F.struct("line_no", "rank", "kind", "tainted")).alias("s"))
    return d.select("path", "name", "s.kind", "s.line_no", "s.tainted")


def calls(lines: DataFrame) -> DataFrame:
    """(path, caller, callee): what is called from a function's first line to the end of its file."""
    t = F.col("text")
    d = lines.select("path", "language", "line_no", "text")
    fns = symbols(lines).where("kind = 'function'").select("path", F.col("name").alias("caller"), F.col("line_no").alias("from"))
    keywords = by_language("language", rules.KEYWORDS, lambda v: F.array(*map(F.lit, v)), F.array().cast("array<string>"))
    names = F.array_except(F.regexp_extract_all(t, F.lit(r"([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*)\s*\("), F.lit(1)), keywords)
    # a call counts if it is on or after the function's line: its last line decides
    last = d.where(F.contains("text", F.lit("("))).select("path", "line_no", F.explode(names).alias("callee")).groupBy("path", "callee").agg(F.max("line_no").alias("last"))
    return fns.join(last, "path").where("last >= `from`").select("path", "caller", "callee")


# --- data flow -------------------------------------------------------------------------------------------------------


def definitions(lines: DataFrame) -> DataFrame:
    """(path, language, line_no, var, expr, tainted): every match of every assignment regex on stripped lines."""
    t = F.col("text")

    def assigned(regexes):
        parts = []
        for r in regexes:
            var = F.regexp_extract_all(t, F.lit(java(r)), F.lit(1))
            expr = F.regexp_extract_all(t, F.lit(java(r)), F.lit(2)) if "(.+)" in r else F.transform(var, lambda _: F.lit(""))
            parts.append(F.arrays_zip(var.alias("var"), expr.alias("expr")))
        return F.flatten(F.array(*parts))

    pairs = by_language("language", {**rules.ASSIGNMENTS, "*": [r"([a-zA-Z_]\w*)\s*=\s*(.+)"]}, assigned, None)
    tainted = by_language("language", rules.INPUTS, lambda v: any_of(t, v), F.lit(False))
    d = stripped(lines).where(F.contains("text", F.lit("=")))  # all assignments have one: cheap, and keeps regexes off other lines
    return d.select("path", "language", "line_no", tainted.alias("tainted"), F.explode(pairs).alias("p")).select("path", "language", "line_no", "p.var", "p.expr", "tainted")


def uses(lines: DataFrame) -> DataFrame:
    """(path, line_no, var): the distinct identifiers of a line that are no keywords or built-ins."""
    words = {k: sorted({*v, *rules.BUILTINS[k]}) for k, v in rules.KEYWORDS.items()}
    known = by_language("language", words, lambda v: F.array(*map(F.lit, v)), F.array().cast("array<string>"))
    return stripped(lines).select("path", "line_no", F.explode(F.array_except(F.regexp_extract_all("text", F.lit(IDENT), F.lit(0)), known)).alias("var"))


def reaching(lines: DataFrame) -> DataFrame:
    """(path, var, def_line, until): a definition reaches the lines from its own to the one before the variable's next.

    Straight-line code has this closed form, so no sweeps are needed.
    """
    d = definitions(lines).select("path", "var", F.col("line_no").alias("def_line")).distinct()
    w = Window.partitionBy("path", "var").orderBy("def_line")
    return d.withColumn("until", F.lead("def_line").over(w) - 1)


def live(lines: DataFrame) -> DataFrame:
    """(path, var, live_until): a variable is live up to its last use."""
    return uses(lines).groupBy("path", "var").agg(F.max("line_no").alias("live_until"))


def live_of(files: DataFrame) -> DataFrame:
    """``live`` of whole files: a file is one row until the end, so that rows for each line and word are not shuffled."""
    known = {k: frozenset(v) | frozenset(rules.BUILTINS[k]) for k, v in rules.KEYWORDS.items()}
    ident = re.compile(IDENT)

    def last_uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, at = [], []
            for language, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                last = {w: i for i, x in enumerate((content or "").split("\n"), 1) for w in ident.findall(x)}
                mine = [w for w in last if w not in known.get(language, ())]
                names.append(mine)
                at.append([last[w] for w in mine])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array(at, pa.list_(pa.int32()))], names=["path", "vars", "at"])

    d = files.select("path", "language", "content").mapInArrow(last_uses, "path string, vars array<string>, at array<int>")
    # rows of one path are one file
    d = d.groupBy("path").agg(F.collect_list(F.arrays_zip("vars", "at")).alias("rs"))
    all_ = F.flatten("rs")
    most = lambda v: F.array_max(F.transform(F.filter(all_, lambda u: u["vars"] == v), lambda u: u["at"]))
    merged = F.transform(F.array_distinct(F.transform(all_, lambda u: u["vars"])), lambda v: F.struct(v.alias("vars"), most(v).alias("at")))
    uses_ = F.when(F.size("rs") == 1, F.get("rs", F.lit(0))).otherwise(merged)
    return d.select("path", F.explode(uses_).alias("u")).select("path", F.col("u.vars").alias("var"), F.col("u.at").alias("live_until"))


def def_use(lines: DataFrame) -> DataFrame:
    """(path, var, def_line, use_line): uses with the definitions that reach them, on the own line too.

    The definition that reaches a use is the last one up to its line, so one window over both finds it, without a join.
    """
    d = definitions(lines).select("path", "var", "line_no", F.col("line_no").alias("def_line")).distinct()
    both = d.withColumn("use", F.lit(False)).unionByName(uses(lines).select("path", "var", "line_no", F.lit(None).cast("int").alias("def_line"), F.lit(True).alias("use")))
    w = Window.partitionBy("path", "var").orderBy("line_no", "use").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("def_line", F.last("def_line", ignorenulls=True).over(w)).where("use AND def_line IS NOT NULL")
    return out.select("path", "var", "def_line", F.col("line_no").alias("use_line"))


def tainted_paths(lines: DataFrame) -> DataFrame:
    """(path, var, def_line, use_line, sink_no): tainted definitions that a line with a sink uses; a use may come first."""
    d = definitions(lines).where("tainted").select("path", "var", F.col("line_no").alias("def_line")).distinct()
    t = F.col("text")
    none = F.array().cast("array<int>")
    sinks = by_language("language", rules.SINKS, lambda v: F.array(*[F.when(found(t, r), i) for i, r in enumerate(v)]), none)
    at = stripped(lines).select("path", "line_no", F.explode(F.filter(sinks, lambda x: x.isNotNull())).alias("sink_no"))
    u = uses(lines).join(d, ["path", "var"]).join(at, ["path", "line_no"])
    return u.select("path", "var", "def_line", F.col("line_no").alias("use_line"), "sink_no")


def dependencies(lines: DataFrame) -> DataFrame:
    """(path, var, needs): identifiers in a variable's right-hand sides."""
    return definitions(lines).select("path", "var", F.explode(F.regexp_extract_all("expr", F.lit(IDENT), F.lit(0))).alias("needs")).distinct()


def closure(deps: DataFrame) -> DataFrame:
    """(path, var, needs) with all that is needed on the way. Each round joins the result with itself, which doubles the reach, until nothing is new."""
    out = deps.distinct().transform(cut)
    n = out.count()
    while True:
        step = out.join(out.select("path", F.col("var").alias("needs"), F.col("needs").alias("next")), ["path", "needs"]).select("path", "var", F.col("next").alias("needs"))
        out = out.union(step).distinct().transform(cut)
        size = out.count()
        if size == n:
            return out
        n = size


# --- taint -----------------------------------------------------------------------------------------------------------


def _assigned() -> Column:
    return by_language("language", rules.ASSIGNED, lambda r: F.nullif(F.regexp_extract("text", java(r), 1), F.lit("")), None)


def taint_events(lines: DataFrame) -> DataFrame:
    """(path, var, line_no, rank, source_type): each kind of source on each line that assigns a variable."""
    t = F.col("text")
    kinds = [F.when(by_language("language", rules.USER_INPUT, lambda v: any_of(t, v), None), F.struct(F.lit(0).alias("rank"), F.lit("user_input").alias("source_type")))]
    for i, (k, v) in enumerate(rules.TAINT_SOURCES.items()):
        kinds.append(F.when(any_of(t, v), F.struct(F.lit(i + 1).alias("rank"), F.lit(k).alias("source_type"))))
    d = stripped(lines).where(F.contains("text", F.lit("="))).withColumn("var", _assigned()).where("var is not null")
    d = d.select("path", "line_no", "var", F.explode(F.filter(F.array(*kinds), lambda x: x.isNotNull())).alias("k"))
    return d.select("path", "var", "line_no", "k.rank", "k.source_type")


def taint_sources(lines: DataFrame) -> DataFrame:
    """(path, var, source_type, line_no): variables assigned on a line with a source; later lines and types win."""
    d = taint_events(lines).groupBy("path", "var").agg(F.max(F.struct("line_no", "rank", "source_type")).alias("s"))
    return d.select("path", "var", "s.source_type", "s.line_no")


def provenance(lines: DataFrame, rounds: int | None = 10) -> DataFrame:
    """(path, var, depth, line_no, parent): taint spreads to what a line assigns that names a tainted variable anywhere.

    Rounds in step: a variable's depth is the least, and of the lines that spread taint to it then, the first one counts,
    with the first (by name) of the variables that it names. A source's line is that of its event, and it has no parent.
    ``rounds`` is where the reference stops; None goes on until nothing is new, and a search that a bound ends warns. Only
    assignment lines of files with sources take part.
    """
    known = taint_sources(lines).select("path", "var", F.lit(0).alias("depth"), "line_no", F.lit(None).cast("string").alias("parent")).transform(cut)
    assign = stripped(lines).where(F.contains("text", F.lit("="))).withColumn("to", _assigned()).where("to is not null").select("path", "line_no", "text", "to").join(known.select("path").distinct(), "path", "left_semi").transform(cut)
    front, depth = known, 0
    while not front.isEmpty():
        depth += 1
        new = assign.join(front.select("path", "var"), "path").where(F.contains("text", F.col("var")))
        new = new.groupBy("path", F.col("to").alias("name")).agg(F.min(F.struct("line_no", "var")).alias("via"))
        new = new.select("path", F.col("name").alias("var"), F.lit(depth).alias("depth"), "via.line_no", F.col("via.var").alias("parent"))
        front = new.join(known.select("path", "var"), ["path", "var"], "left_anti").transform(cut)
        if rounds is not None and depth > rounds:
            if not front.isEmpty():
                warnings.warn(f"taint spreads further than {rounds} rounds", stacklevel=2)
            break
        known = known.unionByName(front).transform(cut)
    return known


def propagate(lines: DataFrame, rounds: int | None = 10) -> DataFrame:
    """(path, var, depth, confidence) of ``provenance``; each round costs a twentieth of the confidence."""
    return provenance(lines, rounds).select("path", "var", "depth", (F.lit(0.9) * F.pow(F.lit(0.95), F.col("depth").cast("double"))).alias("confidence"))


def chains(links: DataFrame) -> DataFrame:
    """(path, var, source, steps) of rows of ``provenance``: steps are (line_no, var) from the source to the variable.

    Each round joins what a variable leads to with what that leads to, so chains double.
    """
    now = links.select("path", "var", F.col("parent").alias("up"), F.array(F.struct("line_no", "var")).alias("steps")).transform(cut)
    while not now.where("up is not null").isEmpty():
        above = now.select("path", F.col("var").alias("up"), F.col("up").alias("next"), F.col("steps").alias("before"), F.lit(True).alias("there"))
        now = now.join(above, ["path", "up"], "left").select("path", "var", F.when(F.col("there"), F.col("next")).alias("up"), F.when(F.col("there"), F.concat("before", "steps")).otherwise(F.col("steps")).alias("steps")).transform(cut)
    return now.select("path", "var", F.get("steps", F.lit(0))["var"].alias("source"), "steps")


def taint_chains(lines: DataFrame, rounds: int | None = 10) -> DataFrame:
    """Sinks with where their taint comes from: path, line_no, var, sink_type, regex_no, source, source_line, source_type, steps."""
    links = cut(provenance(lines, rounds))
    kinds = taint_sources(lines).select("path", F.col("var").alias("source"), "source_type", F.col("line_no").alias("source_line"))
    hit = taint_sinks(lines, links.select("path", "var")).drop("exploitable").join(chains(links), ["path", "var"]).join(kinds, ["path", "source"])
    return hit.select("path", "line_no", "var", "sink_type", "regex_no", "source", "source_line", "source_type", "steps")


def taint_sinks(lines: DataFrame, tainted: DataFrame) -> DataFrame:
    """(path, line_no, var, sink_type, regex_no, exploitable): tainted variables named on lines with a sink."""
    t = F.col("text")
    hits = [F.when(found(t, r), F.struct(F.lit(k).alias("sink_type"), F.lit(i).alias("regex_no"))) for k, v in rules.TAINT_SINKS.items() for i, r in enumerate(v)]
    any_ = possible("text", [r for v in rules.TAINT_SINKS.values() for r in v])
    d = stripped(lines).where(any_).select("path", "line_no", "text", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("s"))
    d = d.join(tainted.select("path", "var"), "path").where(F.contains("text", F.col("var")))
    return d.select("path", "line_no", "var", "s.sink_type", "s.regex_no", (~t.rlike(rules.PROTECTIONS)).alias("exploitable"))


def sanitized(lines: DataFrame, tainted: DataFrame) -> DataFrame:
    """(path, var, line_no): the last line that names a sanitizer and the variable."""
    names = by_language("language", rules.SANITIZERS, lambda v: F.array(*map(F.lit, v)), F.array().cast("array<string>"))
    d = stripped(lines).where(F.exists(names, lambda s: F.contains(F.col("text"), s))).select("path", "line_no", "text")
    d = d.join(tainted.select("path", "var"), "path").where(F.contains("text", F.col("var")))
    return d.groupBy("path", "var").agg(F.max("line_no").alias("line_no"))


def exploitable(sinks: DataFrame, tainted: DataFrame) -> DataFrame:
    """Exploitable sinks with class, CWE, advice and the confidence of their variable."""
    s = F.col("sink_type")
    d = sinks.where("exploitable").join(tainted.select("path", "var", "confidence"), ["path", "var"])
    return d.select("path", "line_no", "var", "sink_type", "regex_no", model.choose(s, model.SINK_CLASS, "INJECTION").alias("vuln_class"), model.choose(s, model.SINK_CWE, "CWE-20").alias("cwe_id"), model.choose(s, model.SINK_ADVICE, "Sanitize user input before use").alias("advice"), "confidence")


def coverage(lines: DataFrame) -> DataFrame:
    """By file: source events, tainted variables, sink events, sinks that are reached, sanitized variables, exploitable sinks.

    Files without a source have no row: nothing is tainted there.
    """
    tainted = cut(propagate(lines))
    by = lambda d, *aggs: d.groupBy("path").agg(*aggs)
    n = F.count("*")
    out = by(taint_events(lines), n.alias("sources")).join(by(tainted, n.alias("tracked")), "path")
    sinks = by(taint_sinks(lines, tainted), n.alias("sinks"), F.count_if(F.col("exploitable")).alias("exploitable"))
    out = out.join(sinks, "path", "left").join(by(sanitized(lines, tainted), n.alias("sanitized")), "path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("path", "sources", "tracked", zero("sinks"), F.coalesce("sinks", F.lit(0)).alias("reached"), zero("sanitized"), zero("exploitable"))


def sink_complexity(sinks: DataFrame, tainted: DataFrame) -> DataFrame:
    """Sinks with the length of the way to them, from the source over each propagation, and how hard it is to exploit."""
    d = sinks.join(tainted.select("path", "var", "depth"), ["path", "var"]).withColumn("steps", F.col("depth") + 2)
    level = F.when(F.col("steps") <= 2, "low").when(F.col("steps") <= 5, "medium").otherwise("high")
    return d.select("path", "line_no", "var", "sink_type", "regex_no", "steps", level.alias("complexity"))


def tainted_ranges(lines: DataFrame) -> DataFrame:
    """(path, var, from_line, to_line): lines at which a tainted definition of a variable holds; the end of the file ends it."""
    d = definitions(lines).groupBy("path", "var", F.col("line_no").alias("from_line")).agg(F.max("tainted").alias("tainted"))
    d = d.withColumn("until", F.lead("from_line").over(Window.partitionBy("path", "var").orderBy("from_line")) - 1).where("tainted")
    last = lines.groupBy("path").agg(F.max("line_no").alias("last"))
    return d.join(last, "path").select("path", "var", "from_line", F.coalesce("until", "last").alias("to_line"))


def is_tainted_at(ranges: DataFrame, var: Column, line: Column) -> DataFrame:
    return ranges.where((F.col("var") == var) & line.between(F.col("from_line"), F.col("to_line")))


def tainted_at(ranges: DataFrame) -> DataFrame:
    """(path, line_no, vars): all tainted variables of every line that has any."""
    d = ranges.select("path", "var", F.explode(F.sequence("from_line", "to_line")).alias("line_no"))
    return d.groupBy("path", "line_no").agg(F.array_sort(F.collect_set("var")).alias("vars"))


def line_path(first: Column, last: Column) -> Column:
    """All lines from one to another; none where the last comes before the first."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def tainted_symbols(lines: DataFrame) -> DataFrame:
    """(path, line_no, var, sink_no): lines that name a tainted symbol and match a sink, for each sink."""
    t = F.col("text")
    sinks = by_language("language", rules.SINKS, lambda v: F.array(*[F.when(found(t, r), i) for i, r in enumerate(v)]), F.array().cast("array<int>"))
    at = lines.select("path", "line_no", "text", F.explode(F.filter(sinks, lambda x: x.isNotNull())).alias("sink_no"))
    known = symbols(lines).where("tainted").select("path", F.col("name").alias("var"))
    return at.join(known, "path").where(F.contains("text", F.col("var"))).select("path", "line_no", "var", "sink_no")


def semantic_patterns(files: DataFrame, lines: DataFrame, nulls: DataFrame) -> DataFrame:
    """(path, kind, line_no, confidence) of all semantic checks; a leak is of the whole file and stands at line 1.

    ``nulls`` are null dereferences (path, line_no).
    """
    row = lambda d, kind, line, c: d.select("path", F.lit(kind).alias("kind"), F.col(line).cast("int").alias("line_no") if line else F.lit(1).alias("line_no"), F.lit(c).alias("confidence"))
    out = row(tainted_symbols(lines), "tainted_flow", "line_no", 0.8).unionAll(row(unsafe_casts(lines), "unsafe_cast", "line_no", 0.5))
    out = out.unionAll(row(resource_leaks(files), "resource_leak", None, 0.6)).unionAll(row(nulls, "null_deref", "line_no", 0.7))
    return out.unionAll(row(privilege_lines(lines), "privilege_escalation", "line_no", 0.6))


def scopes(files: DataFrame) -> DataFrame:
    """(path, line_no, scope) of lines that change the scope: a function adds its name, a class sets its own, a lone } leaves.

    Only such lines of a file are folded, on its own row.
    """
    d = files.select("path", F.split("content", "\n", -1).alias("ls"))
    fn, cls = r"(?:def|function|func|fn)\s+(\w+)", r"class\s+(\w+)"
    e = F.transform("ls", lambda x, i: F.struct((i + 1).alias("line_no"), F.regexp_extract(x, java(fn), 1).alias("fn"), F.regexp_extract(x, java(cls), 1).alias("cls"), x.rlike(r"^\s*\}\s*$").alias("ends")))
    d = d.select("path", F.filter(e, lambda x: (x["fn"] != "") | (x["cls"] != "") | x["ends"]).alias("es")).where(F.size("es") > 0)

    def step(a, x):
        now = a["scope"]
        up = F.when(F.contains(now, F.lit(".")), F.regexp_replace(now, r"\.[^.]*$", "")).otherwise("global")
        new = F.when(x["fn"] != "", F.concat(now, F.lit("."), x["fn"])).when(x["cls"] != "", x["cls"]).otherwise(F.when(now == "global", now).otherwise(up))
        return F.struct(new.alias("scope"), F.concat(a["out"], F.array(F.struct(x["line_no"].alias("line_no"), new.alias("scope")))).alias("out"))

    start = F.struct(F.lit("global").alias("scope"), F.array().cast("array<struct<line_no:int,scope:string>>").alias("out"))
    return d.select("path", F.explode(F.aggregate("es", start, step, lambda a: a["out"])).alias("o")).select("path", "o.line_no", "o.scope")


# --- control flow and graphs -----------------------------------------------------------------------------------------


def control_lines(lines: DataFrame) -> DataFrame:
    """(path, line_no, kind, condition) of lines that branch, loop or return."""
    t = F.col("text")
    is_ = lambda table: by_language("language", table, lambda r: t.rlike(r), None)
    kind = F.when(is_(rules.IFS), "if").when(is_(rules.ELSES), "else").when(is_(rules.LOOPS), "loop").when(t.rlike(rules.RETURNS), "return")
    cond = F.coalesce(F.nullif(F.regexp_extract(t, r"(?:if|while|for)\s*\(([^)]+)\)", 1), F.lit("")), F.regexp_extract(t, r"(?:if|while|for)\s+(.+):", 1))
    return stripped(lines).select("path", "line_no", kind.alias("kind"), cond.alias("condition")).where("kind is not null")


def reachable(edges: DataFrame, start: int = 0) -> DataFrame:
    """(path, node): what can be reached from each path's node ``start``; breadth first, each node joined once, until nothing is new."""
    seen = edges.select("path").distinct().withColumn("node", F.lit(start)).transform(cut)
    front = seen
    while True:
        front = front.withColumnRenamed("node", "src").join(edges, ["path", "src"]).select("path", F.col("dst").alias("node")).distinct().join(seen, ["path", "node"], "left_anti").transform(cut)
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front).transform(cut)
