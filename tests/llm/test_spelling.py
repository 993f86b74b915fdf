"""Spelling variants: all pairs, by both ways, on small alphabets; a plain count of words; hard rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from riskloom.llm import spelling


def plain_variants(counts):
    near = {a: [b for b in counts if b != a and spelling.one_edit(a, b)] for a in counts}
    form = {a: min(near[a], key=lambda b: (-counts[b], b), default=None) for a in counts}
    form = {a: b if b and counts[b] >= 2 * counts[a] else None for a, b in form.items()}

    def root(a):
        return root(form[a]) if form[a] else a

    return {a: (form[a], root(a), counts[a], len(near[a]), counts[form[a]] if form[a] else None) for a in counts}


def plain_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_one_edit():
    rng = random.Random(1)
    words = ["".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in range(60)]
    assert all(spelling.one_edit(a, b) == plain_edit(a, b) for a in words for b in words)


@pytest.mark.parametrize("letters,hot", [("ab", 20_000), ("ab", 2), ("abcé", 20_000), ("abcé", 5), ("abcé", 0)])
def test_all_pairs(spark, letters, hot):
    rng = random.Random(len(letters))
    counts = {"".join(rng.choices(letters, k=rng.randint(2, 9))): rng.choice([3, 3, 4, 6, 7, 12, 24, 50]) for _ in range(250)}
    counts |= {"a" * 70 + x: 5 for x in ("", "b", "a", "ba")} | {"b" * 66 + "a" * 64: 20, "b" * 65 + "a" * 64: 4, "b" * 65 + "a" * 65: 8}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    out = spelling.variants(words, hot=hot, shard_words=60)
    assert rows_of(out) == plain_variants(counts)


def test_words_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert {r.word: r.n for r in spelling.vocabulary(docs).collect()} == want
    assert rows_of(spelling.spelling_variants(docs)) == plain_variants(want)


def test_hard_rows(spark):
    long = "x" * 40_000
    rows = [(1, "Éclair éclair ÉCLAIR×÷ abc"), (2, None), (None, "hello hello hello"), (3, ""), (4, f"{long} {long} {long}y {long}y"), (4, f"{long} {long}y"), (4, f"{long} {long}y"), (5, "hellu hellu hellu " + "hallo " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(spelling.spelling_variants(df.withColumns({"word": df.text, "n": df.doc_id, "seg": df.text, "key": df.text, "like": df.doc_id})))
    got = {w[:8]: v for w, v in got.items() if len(w) < 50} | {len(w): v for w, v in got.items() if len(w) >= 50}
    assert got["hallo"] == (None, "hallo", 9, 1, None) and got["hello"] == ("hallo", "hallo", 3, 2, 9) and got["hellu"] == (None, "hellu", 3, 1, None)
    assert got[40_000][3] == got[40_001][3] == 1
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    ten = spark.createDataFrame([(7, "Éclair " * 10)], "doc_id long, text string")
    assert list(rows_of(spelling.spelling_variants(ten))) in (["Éclair"], ["clair"], [w for w in ("Élair", "Écair", "Éclir", "Éclar", "Éclai")][:1])
