"""Similarity, metrics, impurity, normalisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _dot(a, b) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def rounded(col: Column) -> Column:
    return F.floor(col * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


#: rows of a packed block of vectors, and of queries
BLOCK_ROWS = 4096


def _packed(vectors: DataFrame) -> DataFrame:
    """(ids, x): blocks of at most BLOCK_ROWS vectors of one length as float64 bytes, row after row; a null vector or entry counts as no number."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(rows):
            ids, xs = zip(*rows, strict=True)
            return pa.RecordBatch.from_pydict({"ids": pa.array([list(ids)], pa.list_(pa.int64())), "x": pa.array([np.concatenate(xs).tobytes()], pa.binary())})

        for batch in batches:
            values, offsets = batch.column(1), batch.column(1).offsets.to_numpy()
            flat = values.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            for i, (vec_id, valid) in enumerate(zip(batch.column(0).to_pylist(), values.is_valid().to_pylist(), strict=True)):
                x = flat[offsets[i] : offsets[i + 1]] if valid else np.zeros(0)
                rows = held.setdefault(len(x), [])
                rows.append((vec_id, x))
                if len(rows) == BLOCK_ROWS:
                    yield block(held.pop(len(x)))
        yield from map(block, held.values())

    return vectors.select("vec_id", "embedding").mapInArrow(pack, "ids array<bigint>, x binary")


def _dots(a: np.ndarray, b: np.ndarray, i=slice(None), j=slice(None)) -> np.ndarray:
    """Dot products of rows ``i`` and ``j``, summed in the order of their places, as the SQL twin and a plain loop do."""
    return sum((x[i] * y[j] for x, y in zip(a.T, b.T, strict=True)), np.zeros(len(a[i, :0])))


def _nearest(q: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """(query ids, ids, similarities) of the first k of the rows ``x`` for each query; 0 where a vector has no length."""
    nx, nq = np.sqrt(_dots(x, x)), np.sqrt(_dots(q, q))
    if x.shape[1] == q.shape[1]:
        ux, uq = (np.divide(v, n[:, None], out=np.zeros_like(v), where=n[:, None] > 0) for v, n in ((x, nx), (q, nq)))
        near = np.nan_to_num(uq @ ux.T, nan=2.0)
    else:
        near = np.full((len(q), len(x)), 2.0)
    least = np.partition(near, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(q), -3.0)
    # two of one millionth are a tie; the margin covers it
    i, j = np.nonzero(near >= least[:, None] - 2e-6)
    both = (nq[i] > 0) & (nx[j] > 0)
    dots = _dots(q, x, i, j) if x.shape[1] == q.shape[1] else np.full(len(i), np.nan)
    sim = np.divide(dots, nq[i] * nx[j], out=np.zeros(len(i)), where=both)
    order = np.lexsort((ids[j], -np.floor(np.nan_to_num(sim) * 1e6 + 0.5), i))
    place = np.arange(len(i)) - np.searchsorted(i[order], i[order])
    kept = order[place < k]
    return query_ids[i[kept]], ids[j[kept]], sim[kept]


def similar_topk(vectors: DataFrame, k: int) -> DataFrame:
    """The k most alike of each query vector (ids divisible by 100), by cosine, ties by id.

    All rows meet all queries, block by block as matrix products. What may be among the first k of its block, with a
    margin for the order of sums, is measured again place by place; so k rows of a query and a block are shuffled.
    """
    queries = _packed(vectors.where("vec_id % 100 = 0")).toDF("query_ids", "q")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, query_ids, q in zip(*[batch.column(c).to_pylist() for c in ("ids", "x", "query_ids", "q")], strict=True):
                ids, query_ids = np.array(ids, np.int64), np.array(query_ids, np.int64)
                x, q = (np.frombuffer(v).reshape(len(n), -1) for v, n in ((x, ids), (q, query_ids)))
                for at in range(0, len(q), 256):  # a million pairs at a time
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _nearest(q[at : at + 256], query_ids[at : at + 256], x, ids, k)], names=["query_id", "vec_id", "sim"])

    s = _packed(vectors).crossJoin(queries).mapInArrow(best, "query_id bigint, vec_id bigint, sim double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.floor(F.col("sim") * F.lit(1e6) + F.lit(0.5))), "vec_id")
    return s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "vec_id", "place", rounded(F.col("sim")).alias("similarity"))


def metrics(df: DataFrame, classes: list) -> DataFrame:
    """Accuracy, macro precision, recall and F1 over all classes, absent ones counting 0; one aggregation."""
    a, p = F.col("actual"), F.col("predicted")
    cols = [F.count("*").alias("n"), F.count_if(a == p).alias("hit")]
    for i, c in enumerate(classes):
        cols += [F.count_if((a == c) & (p == c)).alias(f"tp{i}"), F.count_if(p == c).alias(f"p{i}"), F.count_if(a == c).alias(f"a{i}")]
    g = df.agg(*cols)
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    n = len(classes)
    g = g.withColumn("pr", sum((share(f"tp{i}", f"p{i}") for i in range(n)), F.lit(0.0)) / n).withColumn("re", sum((share(f"tp{i}", f"a{i}") for i in range(n)), F.lit(0.0)) / n)
    f1 = F.lit(2.0) * F.col("pr") * F.col("re") / (F.col("pr") + F.col("re") + F.lit(1e-10))
    return g.select("n", rounded(F.col("hit") / F.col("n")).alias("accuracy"), rounded(F.col("pr")).alias("precision"), rounded(F.col("re")).alias("recall"), rounded(f1).alias("f1"))


def gini(df: DataFrame, group: str, label: str) -> DataFrame:
    c = df.groupBy(group, label).agg(F.count("*").alias("n"))
    t = c.groupBy(group).agg(F.sum("n").alias("total"), F.collect_list("n").alias("ns"))  # a count for each label
    p = F.aggregate(F.transform("ns", lambda n: (n / F.col("total")) * (n / F.col("total"))), F.lit(0.0), lambda s, x: s + x)
    return t.select(group, rounded(F.lit(1.0) - p).alias("gini"))


def minmax(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, minmax), 0 where a feature doesn't vary."""
    e = vectors.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", (F.col("pos") + 1).alias("dim"), F.col("x").cast("double").alias("x"))
    s = e.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    v = F.when(F.col("hi") > F.col("lo"), rounded((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")))).otherwise(0.0)
    return e.join(s, "dim").select("vec_id", "dim", v.alias("minmax"))
