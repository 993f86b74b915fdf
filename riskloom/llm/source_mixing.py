"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same fractional number of copies,
target / source size. Whole copies are taken; the fractions are rounded in
pairs, of two documents or of one and the block of all smaller ones: mass moves from one document to the other, so that their expected words
stay as they are, until one of the two is integral. A document that is still
fractional goes on to the next pair. Leaves of a reduction tree round bounded
groups of a source; what is left of each leaf meets in the next level, and one
document of a source is left to the last coin. So the words that the mix takes
of a source miss its target by less than one document.

Coins are hashes of what meets, so reruns agree whatever the partitions.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import WORD, materialize, partitions, table_by_group

#: documents of a leaf, and leaves that meet in a node
LEAF, FAN = 20_000, 256
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
_EPS = 1e-12


def _coin(*parts) -> float:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little") / 2**64


def round_pairs(items: list[tuple], seed: int) -> tuple[list[int | None], int | None, float]:
    """Dependent rounding of (id, size, p) with 0 < p < 1 and size > 0, in the order given.

    Returns 0 or 1 for each item, but None for the one that is left, its place, and its p. The sum of size * p
    over all items doesn't change, and each keeps its expected value.
    """
    out: list[int | None] = [None] * len(items)
    at, p = None, 0.0
    for i, (key, size, q) in enumerate(items):
        if at is None:
            at, p = i, q
            continue
        a, b = items[at][1], size
        up, down = min(a * (1 - p), b * q), min(a * p, b * (1 - q))
        move = up if _coin(seed, items[at][0], key, p, q) * (up + down) < down else -down
        p, q = p + move / a, q - move / b
        for j, x in ((at, p), (i, q)):
            if x <= _EPS or x >= 1 - _EPS:
                out[j] = round(x)
        left = [(j, x) for j, x in ((at, p), (i, q)) if out[j] is None]
        at, p = left[0] if left else (None, 0.0)
    return out, at, p


def round_leaf(items: list[tuple], seed: int) -> tuple[list[int | None], int | None, float]:
    """``round_pairs`` for items with one p, by falling size: each document meets all smaller ones as one block.

    The block's documents move alike, so they keep one p. A large document becomes integral against the mass of many
    small ones, and what remains in the end is small. Where a block is too light to give or take that mass, its
    documents meet in pairs.
    """
    out: list[int | None] = []
    rest, p = sum(x[1] for x in items), items[0][2]
    for i, (key, size, _) in enumerate(items):
        rest -= size
        if rest <= 0 or p - (1 - p) * size / rest < 0 or p + p * size / rest > 1:
            tail, at, left = round_pairs([(k, b, p) for k, b, _ in items[i:]], seed)
            return out + tail, None if at is None else at + i, left
        out.append(int(_coin(seed, "block", key, size, p) < p))
        p += (p - out[i]) * size / rest
    raise AssertionError("the last document has no block")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, sid, target).

    Weights repeat over the sources in code point order, null last. target = min(3 * size, c * weight), where c makes
    them share all words: what sources beyond their limit leave is shared by the others by weight. Only this table of
    sources, not documents, meets in one window.
    """
    every = Window.partitionBy(F.lit(0))
    s = sizes.withColumn("sid", (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", MOST_COPIES * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = every.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("c", share).withColumn("c", F.when(F.col("c") < F.col("ratio"), F.col("c")))
    s = s.withColumn("c", F.first("c", ignorenulls=True).over(every.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", "sid", F.least("cap", F.coalesce(F.col("c") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row of ``docs`` (reads doc_id, text, source).

    size is the number of words, 0 for a null text; taken = copies * size, at most three times the size. A null source
    is a source, and comes last. Rows without words take no part and have no copies. Repeated rows are rows of their
    own. A source without words has target 0. An empty table gives an empty result. Texts are counted whole.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    d = materialize(d, "sizes")
    sources = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = materialize(sources, "sources")
    count = d.groupBy("source").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("leaves"))
    known = sources.join(count, sources["source"].eqNullSafe(count["source"])).select(sources["source"].alias("name"), "source_size", "sid", "target", "leaves")
    d = d.join(known, d["source"].eqNullSafe(known["name"]))
    d = d.withColumn("p", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    d = d.withColumn("whole", F.floor(F.col("p") + _EPS).cast("int")).withColumn("p", F.col("p") - F.col("whole"))
    d = d.withColumn("p", F.when(F.col("p") > _EPS, F.col("p")))
    d = d.withColumn("leaf", F.pmod(F.xxhash64("doc_id", "size"), "leaves").cast("int")).select("sid", "leaf", "leaves", "doc_id", "size", "whole", "p")
    deep = d.agg(F.max("leaves")).first()[0] or 1

    def level(first: bool, last: bool):
        def run(key, rows: pa.Table):
            ids, size, p = (rows[c].to_pylist() for c in ("doc_id", "size", "p"))
            copy, at, left = (round_leaf if first else round_pairs)(list(zip(ids, size, p, strict=True)), seed)
            if last and at is not None:
                copy[at], at = int(_coin(seed, "last", key[0], ids[at], left) < left), None
            rest = [left if i == at else None for i in range(len(ids))]
            whole = [w + (c or 0) for w, c in zip(rows["whole"].to_pylist(), copy, strict=True)]
            return pa.RecordBatch.from_pydict({"sid": rows["sid"].combine_chunks(), "leaf": pa.array([key[1] // FAN] * len(ids), pa.int32()), "doc_id": rows["doc_id"].combine_chunks(), "size": rows["size"].combine_chunks(), "whole": pa.array(whole, pa.int32()), "p": pa.array(rest, pa.float64())})

        return run

    schema = "sid int, leaf int, doc_id long, size long, whole int, p double"
    done = d.where("p is null").select("sid", "doc_id", "size", "whole")
    first = True
    open_, leaves = d.where("p is not null").drop("leaves"), deep
    while True:
        out = materialize(table_by_group(open_, ["sid", "leaf"], n, level(first, leaves == 1), schema, [F.desc("size"), F.asc("doc_id"), F.asc("p")]), "rounded")
        done = done.union(out.where("p is null").select("sid", "doc_id", "size", "whole"))
        if leaves == 1:
            break
        open_, leaves, first = out.where("p is not null"), -(-leaves // FAN), False
    out = done.join(sources.select("sid", "source_size", "target"), "sid")
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size")).cast("long").alias("taken"), F.col("whole").alias("copies"))
