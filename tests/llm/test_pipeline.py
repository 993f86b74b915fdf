"""The stages one after another, each against what it must keep."""

import collections
import random

import corpus_pipeline
from pyspark.sql import functions as F

from riskloom.llm.common import materialize

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    cols = docs.columns
    seen = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, DATA), "stage")
        if i < 4:
            assert docs.columns == cols, name
        seen.append(docs)
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in seen]
    assert set(ids[1]) <= set(ids[0]) and set(ids[2]) <= set(ids[1]) and set(ids[3]) <= set(ids[2])
    kept = {r.doc_id: r.text for r in seen[3].collect()}
    assert len(set(kept.values())) == len(kept) == len(ids[3])
    copies = collections.Counter(ids[4])
    assert max(copies.values()) <= 3 and sorted(ids[4]) == sorted(ids[5])
    assert seen[5].where("not round_trip").count() == 0


def test_null_and_repeated_ids(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(None, text(i)) for i in range(6)] + [(7, text(i)) for i in range(6, 9)] + [(8, text(6)), (3, text(0)), (9, text(9)), (9, text(9)), (4, text(9) + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    left = materialize(corpus_pipeline.near_duplicate_stage(spark, docs, DATA), "stage")
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    want = [(None, text(i)) for i in range(1, 6)] + [(3, text(0)), (7, text(6)), (7, text(7)), (7, text(8)), (4, text(9) + " more")]
    assert got == sorted(want, key=str)

    mixed = collections.Counter(r.text for r in corpus_pipeline.mixing_stage(spark, left, DATA).collect())
    assert set(mixed) <= {t for _, t in want} and max(mixed.values()) <= 3


def test_unsure_and_unlabelled_languages(spark):
    rng = random.Random(3)
    one = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [(i, one("abcde" if i % 2 else "klmno"), "ab"[i % 2]) for i in range(60)]
    rows += [(60, "abcde klmno " * 15, None), (61, one("vwxyz"), None), (62, "12 34", None), (63, None, None)]
    for lang in (True, False):
        docs = spark.createDataFrame([(i, t, x if lang else None, "s") for i, t, x in rows], "doc_id long, text string, lang string, source string")
        got = sorted(r.doc_id for r in corpus_pipeline.language_stage(spark, docs, DATA).collect())
        assert got == list(range(62))


def test_columns_named_like_ours_come_back(spark):
    names = ["lang_pred", "score", "_text", "_key", "_row", "copies", "_copy", "row", "key", "place", "copy", "gid", "kept", "words", "start", "leaf", "h"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = materialize(stage(spark, docs, DATA), "stage")
        assert docs.columns[-len(names) :] == names, name
    rows = docs.collect()
    assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0
