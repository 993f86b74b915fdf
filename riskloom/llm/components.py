"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import drop_table, materialize

#: edges (16 bytes each) that one task joins by itself; the answer is that of the rounds
AT_ONCE = 1_000_000


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One round on (a, b) with a > b. Large-star hangs the greater neighbours of u on its least one, small-star the lesser.

    The least neighbour is a minimum that partial ones make up. The join that hands it to a hub's neighbours is split
    where it is skewed (spark.sql.adaptive.skewJoin), as the side of the least neighbours has one row for each u.
    """
    if both_ways:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        hung = near.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        hung = edges.join(low, edges["a"] == low["u"]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return hung.where("a > b").distinct()


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def find(i: int) -> int:
        up.setdefault(i, i)
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for x in batches:
        for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_pydict({"node": pa.array(list(up), pa.int64()), "root": pa.array([find(i) for i in up], pa.int64())})


def connected(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(a bigint, b bigint) edges to (node, root): root is the least node of the component; nodes without edges are absent.

    Nulls and loops are ignored; direction and repeats don't matter.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= at_once:
        return materialize(now.coalesce(1).mapInArrow(_join_all, "node long, root long"), "roots")
    state = None
    while True:
        after = materialize(_star(_star(now, True), False), "edges")
        row = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        drop_table(now)
        now = after
        if row == state:
            break
        state = row
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
