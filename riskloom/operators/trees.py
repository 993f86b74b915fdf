"""Forests as tables of nodes: classification trees grown level by level, isolation trees, detection and its reasons.

Nodes are numbered as in a heap: 1 is the root, 2k and 2k + 1 are the children of k. All chance comes from MD5 of a name, so
a forest is the same however its rows are partitioned, and SQL can grow it again. A level of all classification trees is
one pass, which ships counts of a fixed size; an isolation tree grows on its own sample of a fixed size. A forest itself is
of a fixed size, goes to the workers whole, and is saved as a table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.lineage import cut
from riskloom.operators.ml import rounded
from riskloom.operators.training import _stacked, _summed, classes_of_feature

#: equal steps of a dimension's range, whose edges are the thresholds that are tried
STEPS = 32
#: upper ends of the shares of rows that a bootstrap sample of the same size takes 0, 1, 2, ... times
POISSON = (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015)
SPAN = 1 << 32
NODES = "tree int, node int, dim int, threshold double, label int, confidence double, size long, depth int"


def chance(*name: object) -> int:
    """A number below SPAN that a name stands for."""
    return int(hashlib.md5(":".join(map(str, name)).encode()).hexdigest()[:8], 16)


def _chance(*name: Column | str) -> Column:
    parts = [F.lit(n) if isinstance(n, str) else F.coalesce(n.cast("string"), F.lit("")) for n in name]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


@dataclass
class Forest:
    """Trees as dicts of nodes: (dim, threshold) of inner ones, (label, confidence, size, depth) of leaves."""

    kind: str
    dim: int
    classes: list[int] = field(default_factory=list)
    inner: list[dict[int, tuple[int, float]]] = field(default_factory=list)
    leaves: list[dict[int, tuple[int | None, float, int, int]]] = field(default_factory=list)
    #: isolation only: rows of a sample, and the score from which on a row is an anomaly
    sample: int = 0
    threshold: float = 1.0

    def leaf_of(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The leaf's node of each row: left where the value is less than (isolation: at most) the threshold."""
        node = np.ones(len(x), np.int64)
        inner = self.inner[tree]
        going = np.arange(len(x))
        while len(going):
            now, parts = node[going], []
            for k in np.unique(now).tolist():
                if (split := inner.get(k)) is None:
                    continue
                rows = going[now == k]
                v = x[rows, split[0] - 1]
                node[rows] = 2 * k + ((v > split[1]) if self.kind == "isolation" else (v >= split[1]))
                parts.append(rows)
            going = np.concatenate(parts) if parts else going[:0]
        return node

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each node; dim and threshold are null for leaves."""
        rows = [(t, k, d, float(c), None, None, None, k.bit_length() - 1) for t, nodes in enumerate(self.inner) for k, (d, c) in nodes.items()]
        rows += [(t, k, None, None, x, float(c), n, d) for t, nodes in enumerate(self.leaves) for k, (x, c, n, d) in nodes.items()]
        return spark.createDataFrame(rows, NODES)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write nodes and settings as Parquet below ``path``, in any file system that Spark knows."""
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = [(self.kind, self.dim, self.classes, self.sample, self.threshold, len(self.inner))]
        spark.createDataFrame(meta, "kind string, dim int, classes array<int>, sample int, threshold double, trees int").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load(spark: SparkSession, path: str) -> Forest:
    """A forest that ``Forest.save`` wrote."""
    s = spark.read.parquet(f"{path}/settings").first()
    out = Forest(s.kind, s.dim, list(s.classes), [{} for _ in range(s.trees)], [{} for _ in range(s.trees)], s.sample, s.threshold)
    for r in spark.read.parquet(f"{path}/nodes").collect():  # of a fixed size
        if r.dim is not None:
            out.inner[r.tree][r.node] = (r.dim, r.threshold)
        else:
            out.leaves[r.tree][r.node] = (r.label, r.confidence, r.size, r.depth)
    return out


# --- classification --------------------------------------------------------------------------------------------------


def _best(counts: np.ndarray, dims: list[int], edges: np.ndarray) -> tuple[int, float, np.ndarray] | None:
    """(dim, threshold, classes left of it) of the highest gain in Gini impurity, or None; counts are by (dim, step, class).

    Equal gains (to nine places) fall to the least dimension, then to the least threshold.
    """
    left = counts.cumsum(axis=1)[:, :-1]
    all_ = counts[0].sum(axis=0)
    na, nt = left.sum(axis=2), all_.sum()
    nb = nt - na
    qa, qb, qt = (left**2).sum(axis=2), ((all_ - left) ** 2).sum(axis=2), (all_**2).sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.floor(((1 - qt / (nt * nt)) - (na * (1 - qa / (na * na)) + nb * (1 - qb / (nb * nb))) / nt) * 1e9 + 0.5)
    gain[(na == 0) | (nb == 0)] = -1
    order = np.argsort(dims)
    f, k = divmod(int(gain[order].argmax()), gain.shape[1])
    f = int(order[f])
    return (dims[f], float(edges[dims[f] - 1, k]), left[f, k]) if gain[f, k] > 0 else None


def grow_forest(vectors: DataFrame, classes: list[int], trees: int = 10, depth: int = 5) -> Forest:
    """Learn from (vec_id, embedding, label) rows: each tree sees the root of all dimensions, and rows as often as a bootstrap sample.

    A node becomes a leaf at ``depth``, with one row, one class or no gain. Rows without a label, and classes that are not
    among ``classes``, don't count. A level is one pass over the rows, which are walked to their nodes; its counts by
    (tree, node, dimension, step, class) are added up in partitions first and have a fixed size.
    """
    where = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label").cast("int")) - 1
    u = lambda t: _chance("b", F.lit(t), F.col("vec_id")) / F.lit(float(SPAN))

    def times(t: int) -> Column:
        out = F.lit(len(POISSON))
        for n in range(len(POISSON) - 1, -1, -1):
            out = F.when(u(t) < POISSON[n], n).otherwise(out)
        return out

    d = vectors.where(F.col("label").cast("int").isin(classes)).select(F.col("embedding").cast("array<double>").alias("x"), where.cast("int").alias("y"), F.array(*[times(t) for t in range(trees)]).alias("w"))
    d = cut(d)
    ends = d.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.min("v").alias("low"), F.max("v").alias("high")).orderBy("pos").collect()  # a row for each dimension
    dim, k = len(ends), len(classes)
    forest = Forest("classes", dim, classes, [{} for _ in range(trees)], [{} for _ in range(trees)])
    if not dim:
        return forest
    low, high = np.array([r.low for r in ends]), np.array([r.high for r in ends])
    edges = low[:, None] + (high - low)[:, None] * np.arange(1, STEPS) / float(STEPS)
    own = [sorted(range(1, dim + 1), key=lambda f: hashlib.md5(f"f:{t}:{f}".encode()).hexdigest())[: math.ceil(math.sqrt(dim))] for t in range(trees)]  # noqa: B023
    width = len(own[0])
    going = [{1} for _ in range(trees)]

    def close(t: int, node: int, n: np.ndarray) -> bool:
        """Whether a node of these class counts is a leaf for certain; it is entered then."""
        level = node.bit_length() - 1
        if level < depth and n.sum() >= 2 and (n > 0).sum() > 1:
            return False
        forest.leaves[t][node] = (classes[int(n.argmax())], float(n.max() / n.sum()) if n.sum() else 0.0, int(n.sum()), level)
        return True

    for level in range(depth):
        at = [{node: i for i, node in enumerate(sorted(g))} for g in going]
        most = max(map(len, at))
        if not most:
            break
        held = d.sparkSession.sparkContext.broadcast((forest.inner, at))  # of a fixed size

        def count(b):
            inner, at = held.value  # noqa: B023
            x, y, w = _stacked(b, 0, dim), b.column(1).to_numpy(), _stacked(b, 2, trees).astype(int)
            step = np.stack([np.searchsorted(edges[f], x[:, f], "right") for f in range(dim)], 1)
            walker = Forest("classes", dim, inner=inner)
            out = np.zeros((trees, most * width * STEPS * k))  # noqa: B023
            for t in range(trees):
                node = walker.leaf_of(t, x)
                place = np.array([at[t].get(i, -1) for i in node.tolist()])
                rows = np.flatnonzero((place >= 0) & (w[:, t] > 0))
                for f, name in enumerate(own[t]):
                    cell = ((place[rows] * width + f) * STEPS + step[rows, name - 1]) * k + y[rows]
                    out[t] += np.bincount(cell, w[rows, t], minlength=out.shape[1])
            return out.reshape(-1)

        found = _summed(d, count).reshape(trees, most, width, STEPS, k)
        held.unpersist()
        after: list[set[int]] = [set() for _ in range(trees)]
        for t in range(trees):
            for node, i in at[t].items():
                n = found[t, i, 0].sum(axis=0)
                if close(t, node, n):
                    continue
                best = _best(found[t, i], own[t], edges)
                if best is None:
                    forest.leaves[t][node] = (classes[int(n.argmax())], float(n.max() / n.sum()), int(n.sum()), level)
                    continue
                forest.inner[t][node] = best[:2]
                after[t] |= {child for child, c in ((2 * node, best[2]), (2 * node + 1, n - best[2])) if not close(t, child, c)}
        going = after
    return forest


def _scored(vectors: DataFrame, forest: Forest, keep: list[str], fn: Callable, kind: pa.DataType, sql: str) -> DataFrame:
    """The columns ``keep`` and what ``fn`` makes of the matrix of each batch."""
    held = vectors.sparkSession.sparkContext.broadcast(forest)
    kept = vectors.select(*keep)

    def run(batches):
        for b in batches:
            out = fn(held.value, _stacked(b, b.num_columns - 1, held.value.dim)) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, kind)], names=[*b.schema.names[:-1], "value"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields) + f", value {sql}"
    return vectors.select(*keep, F.col("embedding").cast("array<double>").alias("value")).mapInArrow(run, schema)


def _votes(forest: Forest, x: np.ndarray, weighted: bool) -> np.ndarray:
    place = {c: i for i, c in enumerate(forest.classes)}
    out = np.zeros((len(x), len(forest.classes)))
    for t, leaves in enumerate(forest.leaves):
        if leaves:
            at = forest.leaf_of(t, x)
            for k in np.unique(at).tolist():
                out[at == k, place[leaves[k][0]]] += leaves[k][1] if weighted else 1.0
    return out


def classify(vectors: DataFrame, forest: Forest) -> DataFrame:
    """(vec_id, label, prediction, confidence): trees vote with the confidence of their leaf; the first of equal classes wins."""

    def vote(f: Forest, x: np.ndarray) -> list:
        v = np.floor(_votes(f, x, True) * 1e9 + 0.5) / 1e9
        return [{"p": f.classes[i], "c": float(v[r, i]) / len(f.leaves)} for r, i in enumerate(v.argmax(axis=1).tolist())]

    kind = pa.struct([("p", pa.int32()), ("c", pa.float64())])
    out = _scored(vectors.withColumn("label", F.col("label").cast("int")), forest, ["vec_id", "label"], vote, kind, "struct<p:int,c:double>")
    return out.select("vec_id", "label", F.col("value.p").alias("prediction"), rounded(F.col("value.c")).alias("confidence"))


def shares(vectors: DataFrame, forest: Forest) -> DataFrame:
    """(vec_id, class, share): the share of the trees that each class has."""
    out = _scored(vectors, forest, ["vec_id"], lambda f, x: (_votes(f, x, False) / max(1, len(f.leaves))).tolist(), pa.list_(pa.float64()), "array<double>")
    names = F.array(*[F.lit(c) for c in forest.classes])
    return out.select("vec_id", F.posexplode("value").alias("at", "share")).select("vec_id", F.get(names, F.col("at")).alias("class"), rounded(F.col("share")).alias("share"))


# --- isolation -------------------------------------------------------------------------------------------------------


def average_path_length(n: int) -> float:
    """Of an unsuccessful search in a binary tree of n rows."""
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 1 else 0.0


def _samples(vectors: DataFrame, trees: int, sample: int) -> list[np.ndarray]:
    """For each tree the ``sample`` rows of all that come first in its order (all rows where there are fewer).

    A row's place in a tree's order is (a + tree * b + tree * tree * c) modulo SPAN, with a, b and c from MD5 of its id; ties go by id, then by
    vector. Only rows under a bound, about half as many again as are needed, come to the driver: some 38,400 for 100 trees.
    Equal rows come once, with their number.
    """
    n = vectors.count()
    share, need = 1.5 * sample / max(n, 1), min(sample, n)
    x = F.col("embedding").cast("array<double>")
    h = F.md5(F.concat(F.lit("s:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))))
    part = lambda i: F.conv(F.substring(h, i, 8), 16, 10).cast("long")
    base = vectors.select("vec_id", x.alias("x"), part(1).alias("a"), part(9).alias("b"), part(17).alias("c"))
    while True:
        order = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: (F.col("a") + t.cast("long") * F.col("b") + (t * t).cast("long") * F.col("c")) % SPAN)
        most = F.lit(min(SPAN, math.ceil(share * SPAN)))
        under = base.where(F.exists(order, lambda v: v < most))
        rows = under.groupBy("vec_id", "x", "a", "b", "c").agg(F.count("*").alias("n")).collect()
        rows.sort(key=lambda r: (r.vec_id is None, r.vec_id or 0, r.x))
        out = []
        for t in range(trees):
            mine = sorted(((r.a + t * r.b + t * t * r.c) % SPAN, i) for i, r in enumerate(rows))
            mine = [(v, i) for v, i in mine if v < min(SPAN, math.ceil(share * SPAN))]
            if sum(rows[i].n for _, i in mine) < need:
                break
            out.append(np.array([x for _, i in mine for x in [rows[i].x] * rows[i].n][:sample], float))
        else:
            return out
        share *= 2


def isolation_forest(vectors: DataFrame, trees: int = 100, sample: int = 256) -> Forest:
    """Isolation trees of (vec_id, embedding) rows: a node's dimension and cut come by chance; it is a leaf at the height limit, with one row, or where the dimension doesn't vary."""
    grown = _samples(vectors, trees, sample)
    dim = grown[0].shape[1] if grown and len(grown[0]) else 0
    limit = math.ceil(math.log2(sample))
    out = Forest("isolation", dim, inner=[{} for _ in range(trees)], leaves=[{} for _ in range(trees)], sample=sample)
    for t, x in enumerate(grown if dim else []):
        todo = [(1, x)]
        while todo:
            node, rows = todo.pop()
            depth = node.bit_length() - 1
            f = chance("i", t, node) % dim
            low, high = rows[:, f].min(), rows[:, f].max()
            if depth >= limit or len(rows) <= 1 or low == high:
                out.leaves[t][node] = (None, 0.0, len(rows), depth)
                continue
            at = float(low + (high - low) * (chance("u", t, node) / SPAN))
            out.inner[t][node] = (f + 1, at)
            left = rows[:, f] <= at
            todo += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]
    return out


def _scores(f: Forest, x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for t, leaves in enumerate(f.leaves):
        length = {k: d + average_path_length(n) for k, (_, _, n, d) in leaves.items()}
        total += np.array([length[k] for k in f.leaf_of(t, x).tolist()]) if leaves else 0.0
    return 2.0 ** (-(total / max(1, len(f.leaves))) / average_path_length(f.sample))


def scores(vectors: DataFrame, forest: Forest) -> DataFrame:
    """(vec_id, score), from 0 to 1: the shorter the mean way to a row's leaves, the higher."""
    return _scored(vectors, forest, ["vec_id"], lambda f, x: _scores(f, x).tolist(), pa.float64(), "double").withColumnRenamed("value", "score")


def fit_detector(vectors: DataFrame, contamination: float = 0.1, trees: int = 100, sample: int = 256) -> Forest:
    """An isolation forest whose threshold leaves the share ``contamination`` of the rows at or over it.

    Scores count by millionths, so that the threshold comes from a table of a bounded size, summed in a shuffle.
    """
    forest = isolation_forest(vectors, trees, sample)
    bins = scores(vectors, forest).groupBy(F.floor(F.col("score") * 1e6 + 0.5).alias("bin")).agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect() if forest.dim else []
    want, seen = max(1, math.ceil(contamination * sum(r.n for r in bins))), 0
    for r in bins:
        seen += r.n
        if seen >= want:
            forest.threshold = r.bin / 1e6
            break
    return forest


def detect(vectors: DataFrame, forest: Forest) -> DataFrame:
    """(vec_id, score, is_anomaly): scores by millionths, and whether they are at or over the threshold."""
    s = scores(vectors, forest).withColumn("score", rounded(F.col("score")))
    return s.select("vec_id", "score", (F.col("score") >= forest.threshold).alias("is_anomaly"))


def reasons(vectors: DataFrame, forest: Forest, least: float = 0.01, most: int = 5) -> DataFrame:
    """(vec_id, score, place, dim, impact, classes) of the anomalies' strongest dimensions.

    A dimension's impact is by how much the score falls when it is put to the mean of all rows. Only rows over the
    threshold are asked; a row's changed versions are scored as one matrix, and at most ``most`` of them leave the task.
    """
    x = F.col("embedding").cast("array<double>")
    mean = vectors.select(F.posexplode(x).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m")).orderBy("pos").collect()  # a row for each dimension
    means = np.array([r.m for r in mean])

    def why(f: Forest, rows: np.ndarray) -> list:
        own = np.floor(_scores(f, rows) * 1e6 + 0.5) / 1e6
        out: list = [None] * len(rows)
        for i in np.flatnonzero(own >= f.threshold).tolist():
            changed = np.repeat(rows[i : i + 1], f.dim, axis=0)
            np.fill_diagonal(changed, means)
            both = _scores(f, np.concatenate((rows[i : i + 1], changed)))
            by = np.floor((both[0] - both[1:]) * 1e6 + 0.5) / 1e6
            best = [k for k in np.argsort(-by, kind="stable").tolist() if by[k] > least][:most]
            out[i] = {"score": float(own[i]), "dims": [k + 1 for k in best], "by": [float(by[k]) for k in best]}
        return out

    kind = pa.struct([("score", pa.float64()), ("dims", pa.list_(pa.int32())), ("by", pa.list_(pa.float64()))])
    out = _scored(vectors, forest, ["vec_id"], why, kind, "struct<score:double,dims:array<int>,by:array<double>>").where("value is not null")
    out = out.select("vec_id", "value.score", F.posexplode(F.arrays_zip("value.dims", "value.by")).alias("at", "r"))
    return out.select("vec_id", "score", (F.col("at") + 1).alias("place"), F.col("r.dims").alias("dim"), F.col("r.by").alias("impact"), F.array_join(classes_of_feature(F.col("r.dims")), ",").alias("classes"))
