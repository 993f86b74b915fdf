"""The corpus pipeline: quality rules, language ID, near-duplicate removal, source mixing, tokenization.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written as Parquet and read
again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm import language_id, piece_codec, quality_rules, source_mixing
from riskloom.llm.common import materialize
from riskloom.llm.ngram_jaccard import jaccard_join
from riskloom.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; each row is judged by its own text."""
    return quality_rules.accepted(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, however sure the language of the others is, and also where the documents name no language to learn."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    known = language_id.predict(docs.select(_row(docs), "text"), model, ["row"])
    return known.where(F.col("lang_pred") != language_id.UNDETERMINED).select("row.*")


def _row(docs: DataFrame) -> Column:
    """The caller's columns as one, so that no name of theirs meets one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def _keyed(docs: DataFrame) -> DataFrame:
    """row, and a key of its doc_id and text, as ids may be null or name several texts."""
    return docs.select(_row(docs), F.xxhash64("doc_id", "text", F.col("doc_id").isNull(), F.col("text").isNull()).alias("key"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the least doc_id, nulls last (five-word shingles, a likeness of 0.8).

    Of rows with one doc_id and text, one stays. Different texts of one doc_id or of none are documents of their own.
    """
    keyed = _keyed(docs)
    found = jaccard_join(keyed.select(F.col("key").alias("doc_id"), "row.text"), k=5, percent=80).select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"))
    ids = keyed.select("key", "row.doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    keep = found.distinct().join(ids, "key").groupBy("group").agg(first.alias("first")).select("first.key")
    again = Window.partitionBy("key").orderBy(F.xxhash64("row"))
    return keyed.join(keep, "key").withColumn("place", F.row_number().over(again)).where("place = 1").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stands as often as the mix takes it, at most three times. The stage before leaves one row of a doc_id and text."""
    keyed = _keyed(docs)
    mixed = source_mixing.mix(keyed.select(F.col("key").alias("doc_id"), "row.text", "row.source")).where("copies > 0").select(F.col("doc_id").alias("key"), "copies")
    return keyed.join(mixed, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and round_trip: whether decoding the ids gives the text back (a vocabulary maps U+2581 to a space)."""
    path = tokenizer("piece_bpe_32k.model")
    return piece_codec.encode_checked(docs, path)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: the pipeline's contract asks for this name; robust estimates, kernels, tokens and coins are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
