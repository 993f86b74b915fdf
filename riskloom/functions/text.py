"""Text metrics as column expressions. What reads every letter of a text several times is counted by Arrow's regexes or NumPy."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import rules


def java(regex: str) -> str:
    """Classes and word bounds by Unicode, where a regex has any."""
    return "(?U)" + regex if any(x in regex for x in (r"\w", r"\b", r"\d")) else regex


def needed(regex: str) -> str | None:
    """A sign (no letter, digit or space) that every match of a regex has, or None; of several, one that prose lacks."""
    depth, signs = 0, []
    parts = re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?[a-zA-Z]+\)|\(\?(?::|<?[=!])|\{\d+,?\d*\}|.", regex, re.DOTALL)
    for x, after in zip(parts, [*parts[1:], ""], strict=True):
        if re.fullmatch(r"\(\?[a-zA-Z]+\)", x):
            continue
        if x[0] == "(":
            depth += 1
        elif x == ")":
            depth -= 1
        elif depth == 0 and x == "|":
            return None
        elif depth == 0 and after not in ("*", "?") and not after.startswith("{"):
            if len(x) == 2 and x[0] == "\\" and not x[1].isalnum():
                signs.append(x[1])
            elif len(x) == 1 and x in "=%\"'`/#&<>:;,-@!~_":
                signs.append(x)
    order = "`|{}$%+*([\"'=<>&#@~!\\/_:;,-."
    return min(signs, key=lambda c: order.find(c) % 99) if signs else None


def found(text, regex: str) -> Column:
    """Whether a text has a match; texts that lack a sign that every match has are told by it, without a search."""
    text = F.col(text) if isinstance(text, str) else text
    sign = needed(regex)
    return text.rlike(java(regex)) if sign is None else F.contains(text, F.lit(sign)) & text.rlike(java(regex))


def possible(text, regexes: list[str]) -> Column:
    """False only for texts that none of the regexes matches: one test for each sign, a search only where prose has the sign, too."""
    text = F.col(text) if isinstance(text, str) else text
    by = {r: needed(r) for r in regexes}
    rare = sorted({c for c in by.values() if c not in (None, ".", "_", "-", ",", ";", ":")})
    out = F.lit(False)
    for c in rare:
        out = out | F.contains(text, F.lit(c))
    for r in [r for r, c in by.items() if c not in rare]:
        out = out | found(text, r)
    return out


def extracted(text, regex: str, group: int) -> Column:
    """All matches of a regex; an empty array, without a search, for texts that lack a sign that every match has."""
    text = F.col(text) if isinstance(text, str) else text
    sign, out = needed(regex), F.regexp_extract_all(text, F.lit(java(regex)), F.lit(group))
    return out if sign is None else F.when(F.contains(text, F.lit(sign)), out).when(text.isNotNull(), F.array().cast("array<string>"))


def matches(text, regexes: list[str]) -> Column:
    """How many times any of the regexes matches, summed."""
    return sum((F.regexp_count(text, F.lit(java(r))) for r in regexes), F.lit(0))


def linear(regex: str) -> str:
    """A Java regex of literals, groups and ASCII classes in the syntax of RE2, with the same matches."""
    any_case, out = regex.startswith("(?i)"), []
    for x in re.findall(r"\\.|\[(?:\\.|[^\]\\])*\]|\(\?:|.", regex.removeprefix("(?i)"), re.DOTALL):
        if x == r"\s":
            x = r"[\t-\r ]"
        elif any_case and x.isalpha():
            x = f"[{x.lower()}{x.upper()}]"
        elif x[0] == "[" and any_case or x[0] == "\\" and x[1].isalnum() and x != r"\b":
            raise ValueError(f"no linear form of {regex}")
        out.append(x)
    return "".join(out)


def _null(texts: pa.Array, values: list, kind: pa.DataType) -> pa.Array:
    """One value for each text, null for a null."""
    return pa.array([v if valid else None for v, valid in zip(values, texts.is_valid().to_pylist(), strict=True)], kind)


def counts(text, regexes: list[str]) -> Column:
    """An array of how many times each of the regexes matches; none may have classes or word bounds by Unicode."""
    forms = [linear(r) for r in regexes]

    @F.arrow_udf("array<bigint>")
    def each(texts: pa.Array) -> pa.Array:
        found = [pc.count_substring_regex(texts, r).to_numpy(zero_copy_only=False) for r in forms]
        return _null(texts, np.nan_to_num(np.stack(found, 1)).astype(np.int64).tolist(), pa.list_(pa.int64()))

    return each(text)


def fast_matches(text, regexes: list[str]) -> Column:
    """``matches`` by ``counts``."""
    return F.aggregate(counts(text, regexes), F.lit(0).cast("long"), lambda s, x: s + x).cast("int")


def first_line_of(text, regexes: list[str]) -> Column:
    """An array of the first line that each of the regexes is found on, 1 where none is; none may match a line's end."""
    forms = [linear(r) for r in regexes]

    @F.arrow_udf("array<int>")
    def each(texts: pa.Array) -> pa.Array:
        out = np.ones((len(texts), len(forms)), np.int32)
        for k, r in enumerate(forms):
            at = pc.find_substring_regex(texts, r).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(at > 0):
                out[i, k] = texts[i].as_buffer()[: int(at[i])].to_pybytes().count(b"\n") + 1
        return _null(texts, out.tolist(), pa.list_(pa.int32()))

    return each(text)


def by_language(language, table: dict, fn, default) -> Column:
    """A CASE over languages; ``*`` is for all others."""
    out = None
    for k, v in table.items():
        if k != "*":
            out = F.when(F.col(language) == k, fn(v)) if out is None else out.when(F.col(language) == k, fn(v))
    return out.otherwise(fn(table["*"]) if "*" in table else default)


#: characters beyond ASCII that surely are letters, and those that surely are neither letters, digits, marks nor space
LETTERS, SIGNS = "ªµºÀ-ÖØ-öø-ɏ", "¡-©«¬®-´¶-¹»-¿×÷‐-‧‰-‸€"


def complexity(text) -> Column:
    """Decisions, whose words are bounded by Unicode. Texts with characters that are not sorted here take Java's regexes."""
    forms = [linear(r) for r in rules.DECISIONS]

    @F.arrow_udf("int")
    def decisions(texts: pa.Array) -> pa.Array:
        plain = pc.replace_substring_regex(texts, f"[{LETTERS}]", "x")
        total = sum(pc.count_substring_regex(plain, r).to_numpy(zero_copy_only=False) for r in forms)
        known = pc.invert(pc.match_substring_regex(texts, f"[^\\x00-\\x7F{LETTERS}{SIGNS}]")).to_numpy(zero_copy_only=False)
        return pa.array([int(n) if k else None for n, k in zip(total, known, strict=True)], pa.int32())

    return F.coalesce(decisions(text), matches(text, rules.DECISIONS)) + 1


def _entropy(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        x = np.frombuffer((t or "").encode("utf-32-le"), np.uint32)
        k = np.unique(x, return_counts=True)[1] if len(x) and x.max() > 4095 else np.bincount(x)
        k = k[k > 1].astype(float)
        out.append(float(np.log2(len(x)) - (k * np.log2(k)).sum() / len(x)) if len(x) else 0.0)
    return _null(texts, out, pa.float64())


def entropy(text) -> Column:
    """Bits of a character's Shannon entropy."""
    return F.arrow_udf(_entropy, "double")(text)


def nesting(text) -> Column:
    """The deepest bracket, never below zero. Most texts have none, which is tested first."""
    brackets = F.filter(F.split(F.regexp_replace(text, r"[^\[\](){}]", ""), ""), lambda c: c != "")
    step = lambda a, c: F.when(c.isin("{", "(", "["), F.struct((a["d"] + 1).alias("d"), F.greatest(a["m"], a["d"] + 1).alias("m"))).otherwise(F.struct(F.greatest(a["d"] - 1, F.lit(0)).alias("d"), a["m"].alias("m")))
    opens = F.contains(text, F.lit("(")) | F.contains(text, F.lit("[")) | F.contains(text, F.lit("{"))
    return F.when(~opens, 0).otherwise(F.aggregate(brackets, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step, lambda a: a["m"]))


#: tokens as Java has them: ASCII digits, and no line end after a backslash
_TOKEN = re.compile(rules.TOKEN.replace(r"\\.", "\\\\[^\n\r\u0085\u2028\u2029]"), re.ASCII)


def token_counts(text, words: list[str]) -> Column:
    """struct(n, distinct, words): how many tokens, different ones, and of each word in any case."""

    @F.arrow_udf("struct<n: bigint, distinct: bigint, words: array<bigint>>")
    def each(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            k = Counter(_TOKEN.findall(t or ""))
            of = Counter()
            for x, n in k.items():
                of[x.lower()] += n
            out.append({"n": k.total(), "distinct": len(k), "words": [of[w] for w in words]})
        return _null(texts, out, pa.struct([("n", pa.int64()), ("distinct", pa.int64()), ("words", pa.list_(pa.int64()))]))

    return each(text)


def tokens(text) -> Column:
    return F.regexp_extract_all(text, F.lit(rules.TOKEN), F.lit(0))


def comment_lines(text, language) -> Column:
    """struct(comment, code, all): lines of comment, of code (neither blank nor comment), and all, by a scan with a block state.

    Blank lines change nothing. A line with the end mark closes a block and is a comment; so is one with the begin
    mark, and all inside. Where both marks are the same, every such line closes.
    """

    def scan(marks):
        prefixes, begin, end = marks
        start = F.struct(F.lit(False).alias("b"), F.lit(0).alias("k"), F.lit(0).alias("c"))

        def step(a, raw):
            s = F.trim(raw, F.lit(" \t\r\f\x0b"))
            prefix = F.lit(False)
            for p in prefixes:
                prefix = prefix | F.startswith(s, F.lit(p))
            closes = F.contains(s, F.lit(end)) if end else F.lit(False)
            inside = (a["b"] | F.contains(s, F.lit(begin))) if begin else F.lit(False)
            note = closes | inside | prefix
            return F.when(s == "", a).otherwise(F.struct((inside & ~closes).alias("b"), (a["k"] + note.cast("int")).alias("k"), (a["c"] + (~note).cast("int")).alias("c")))

        ls = F.split(text, "\n", -1)
        return F.aggregate(ls, start, step, lambda a: F.struct(a["k"].alias("comment"), a["c"].alias("code"), F.size(ls).alias("all")))

    return by_language(language, {**rules.COMMENTS, "*": (["#"], None, None)}, scan, None)
