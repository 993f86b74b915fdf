"""Plans and rows of steps that must not grow faster than their input."""

import re
import time

import numpy as np

from riskloom import rules
from riskloom.functions import text as T
from riskloom.functions.lineage import cut
from riskloom.operators import ml
from riskloom.operators import token_vectors as tv


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_of_tokens_are_not_shuffled(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"alpha beta w{i % 7} eval " * (i % 5)) for i in range(60)], "id long, content string")
    params = cut(tv.first_vectors(tv.vocabulary(texts), 8))
    whole = tv.embed(texts, params, 8)
    assert "hashpartitioning(token" not in plan(whole)
    want = {r.id: r.v for r in whole.collect()}
    monkeypatch.setattr(tv, "BLOCK", 50 * 8)
    parts = tv.embed(texts, params, 8)
    assert plan(parts).count("BroadcastExchange") > 3
    got = {r.id: r.v for r in parts.collect()}
    assert set(got) == set(want) and all(abs(x - y) < 1e-12 for i in want for x, y in zip(got[i], want[i], strict=True))


def test_tokens_cut_as_bytes_equal_the_regexes(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    signs = list("ab_Z09xF..,;:(\"'\"' \n+=<é中İΣ#@0x1\\")
    odd = ["", "x" * 50 + "=" * 30, "'İΣ' \"ΑΣ\" don't 0x1Fg 12.5.6 1..2 a1.5 'Ⅷ' K", "it's \"a 'b\" c'd", "0x 0X1f 1.", "\"open", ""]
    texts = [*odd, *("".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(400))]
    want = [r[0][1:-1] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i").select(tv.tokens(F.col("t"), None)).collect()]
    for low, high in ((0, len(texts)), (3, 4), (0, 1), (5, 90)):
        sizes, at, words = tv._cut(pa.array(texts).slice(low, high - low))
        words, ends = words.to_pylist(), np.concatenate([[0], np.cumsum(sizes)])
        assert [[words[k] for k in at[i:j]] for i, j in zip(ends, ends[1:], strict=False)] == want[low:high]


def test_training_cuts_texts_twice_and_pairs_meet_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    words = [*"alpha beta gamma delta eval password query zeta".split(), *(f"w{i}" for i in range(90)), "12.5", "();"]
    texts = spark.createDataFrame([(i, " ".join(rng.choice(words, rng.integers(0, 40))) or None) for i in range(120)], "id long, content string").repartition(4)
    pairs = spark.createDataFrame([(i, (7 * i + 1) % 130, bool(i % 3)) for i in range(120)], "a long, b long, alike boolean")
    params = cut(tv.first_vectors(tv.vocabulary(texts, 3), 8))
    runs = []
    for matrix in (tv.MATRIX, 60 * 8):
        monkeypatch.setattr(tv, "MATRIX", matrix)
        for ends in ((10, 20), (None, None)):
            table, losses, e = tv.fit(texts, pairs, params, 8, 2, 0.3, 0.3, *ends)
            assert "regexp_extract_all" not in plan(e) and plan(e).count("MapInArrow") == (1 if matrix > 480 else 6)
            want = {r.id: r.v for r in tv.embed(texts, table, 8, *ends).collect()}
            got = {r.id: r.v for r in e.collect()}
            assert set(got) == set(want) and all(np.allclose(got[i], want[i], atol=1e-12) for i in want)
            runs.append((losses, {r.token: r.v for r in table.collect()}))
    for (a, x), (b, y) in zip(runs[:2], runs[2:], strict=True):
        assert np.allclose(a, b) and set(x) == set(y) and all(np.allclose(x[t], y[t], atol=1e-12) for t in x)


def test_topk_meets_blocks_and_equals_a_loop(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ml, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (700, 4)).astype(np.float32)  # many equal ones, so many ties, and some zeros
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = [tuple(r) for r in ml.similar_topk(d, 5).orderBy("query_id", "place").collect()]

    def sim(a, b):
        dot = lambda p, q: sum(float(s) * float(t) for s, t in zip(p, q, strict=True))
        n = dot(a, a) ** 0.5 * dot(b, b) ** 0.5
        return np.floor((dot(a, b) / n if n else 0.0) * 1e6 + 0.5)

    want = []
    for q in range(0, 700, 100):
        first = sorted((-sim(x[q], x[i]), i) for i in range(700))[:5]
        want += [(q, i, place, -s / 1e6) for place, (s, i) in enumerate(first, 1)]
    assert got == want
    wide = spark.range(30000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.rand(5).cast("float")).alias("embedding"))
    began = time.time()
    assert ml.similar_topk(wide, 5).count() == 1500
    assert "zip_with" not in plan(ml.similar_topk(d, 5)), "pairs meet as matrices"
    assert time.time() - began < 60


def test_linear_counts_equal_javas(spark):
    from pyspark.sql import functions as F

    odd = ["", None, "if(x) ELSE\x0bif y else if z —if éif ifé Key ſecret PASSword http://x ../..\\ new\x85 new\x0b", "for and or\nwhile? a : b && || case", "a‿if 中if if中 x́if", "sha1SHA256 aesdes HTTPS connect\x1crecv"]
    d = spark.createDataFrame([(t,) for t in odd], "t string").repartition(2)
    regexes = [*rules.VECTOR_REGEXES, *(r for k in ("crypto", "file", "network") for r in rules.FAMILIES[k])]
    got = d.select(T.counts("t", regexes), F.array(*[F.regexp_count("t", F.lit(r)) for r in regexes]), T.complexity("t"), T.matches("t", rules.DECISIONS) + 1).collect()
    for mine, java, decisions, plain in got:
        assert (mine == java or mine is None and set(java) == {None}) and decisions == plain
    assert [r[0] for r in d.select(T.first_line_of("t", ["(?i)WHILE", "x"])).collect() if r[0]].count([2, 1]) == 1
    e = d.select(T.complexity("t"), T.entropy("t"), T.fast_matches("t", regexes))
    assert "regexp_replace" not in plan(e) and "ArrowEvalPython" in plan(e)


def test_signs_tell_texts_without_a_match(spark):
    from pyspark.sql import functions as F

    from riskloom.sources.code import CORPUS

    sets = [*(p.regexes for p in rules.PATTERNS), *rules.TAINT_SINKS.values(), *rules.TAINT_SOURCES.values(), *rules.SINKS.values(), *rules.CASTS.values(), *rules.USER_INPUT.values()]
    regexes = sorted({r for v in sets for r in v})
    assert T.needed(r"(?i)a\s*\([^)]*\+") == "+" and T.needed(r"a\(|b") is None and T.needed(r"x\+?=") == "=" and T.needed("[(]a(=)b") is None and T.needed(r"a\+*b") is None
    lines = sorted({x for _, t in CORPUS for x in t.split("\n")} | {"a = b +c", "`x$", "echo x", "(int) y", "%s SELECT"})
    d = spark.createDataFrame([(x,) for x in lines], "text string")
    got = d.select(*[F.count_if(T.found("text", r) != F.col("text").rlike(T.java(r))).alias(str(i)) for i, r in enumerate(regexes)]).first()
    assert set(got) == {0}


def test_live_variables_shuffle_files(spark):
    from riskloom.operators import flow
    from riskloom.sources import code

    rows = [("a", "python", "x = y\n\nx.z(é)\nif y"), ("a", "python", "w\nx\ny"), ("b", "odd", "if x"), ("c", "c", None)]
    d = spark.createDataFrame(rows, "path string, language string, content string").repartition(3)
    got = flow.live_of(d)
    assert sorted(got.collect()) == sorted(flow.live(code.lines(d)).collect()) and len(got.collect()) == 6
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan(got))
    assert keys and not any("var" in k for k in keys)
