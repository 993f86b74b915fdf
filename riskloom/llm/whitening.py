"""Embedding whitening: Welford's rank-one updates, merged over partitions, and a symmetric QR eigen-solve.

Each partition's iterator holds one state (rows, mean, sum of outer products of deviations) that every vector updates by
one rank-one step, so nothing is centred by a difference of large sums. States meet in a tree of tasks, FAN at a time, by
the parallel update formula; the driver gets a single matrix of dimension x dimension. Its eigenvectors come from
Householder's tridiagonal form and implicit QR steps with Wilkinson's shift.

Rows whose vector is null, or holds a null, NaN or infinity, are left out everywhere, and so are those of another length
than most have (of lengths that tie, the greatest counts). Repeated rows count each. Components whose eigenvalue is zero to
double precision, as of constant or dependent dimensions or of fewer rows than dimensions, do not exist; an empty table, a
single row and equal rows have none. Equal eigenvalues have some orthonormal basis of their space. Other columns, of
whatever name, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from riskloom.llm.common import drop_table, groups, materialize

#: states that meet in one task of the tree: each is a matrix
FAN = 32
STATE = "node long, child long, n long, sums array<string>, mean binary, m2 binary"


@dataclass
class Whitening:
    """What a fit finds: rows, exact sums of integer vectors, eigenvalues (falling) and eigenvectors (rows), trace of the covariance."""

    n: int
    sums: list
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dim(self) -> int:
        return len(self.sums)


@dataclass
class State:
    """Rows so far, their mean and the sum of the outer products of their deviations from it."""

    n: int
    sums: list
    mean: np.ndarray
    m2: np.ndarray

    def add(self, rows: np.ndarray) -> None:
        """One rank-one step a row."""
        outer = np.empty_like(self.m2)
        for x in rows.astype(float):
            self.n += 1
            off = x - self.mean
            self.mean += off / self.n
            np.multiply(off[:, None], off * (1 - 1 / self.n), out=outer)
            self.m2 += outer
        wide = rows.dtype.kind == "i" and len(rows) and np.abs(rows).max() > 2**62 // len(rows)
        self.sums = [a + b for a, b in zip(self.sums, rows.sum(axis=0, dtype=object if wide else None).tolist(), strict=True)]

    def merge(self, other: State) -> None:
        """The parallel formula."""
        n = self.n + other.n
        off = other.mean - self.mean
        self.m2 += other.m2 + np.outer(off, off) * (self.n * other.n / n)
        self.mean += off * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def row(self, node: int, child: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"node": [node], "child": [child], "n": [self.n], "sums": [[repr(s) for s in self.sums]], "mean": [self.mean.tobytes()], "m2": [self.m2.tobytes()]})


def _state(row: dict) -> State:
    mean = np.frombuffer(row["mean"]).copy()
    read = [float(s) if "." in s or "e" in s or "n" in s else int(s) for s in row["sums"]]
    return State(row["n"], read, mean, np.frombuffer(row["m2"]).reshape(len(mean), -1).copy())


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows of a symmetric matrix."""
    n, scale = len(a), float(np.abs(a).max(initial=0)) or 1.0
    a, q = (a + a.T) / (2 * scale), np.eye(len(a))
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        norm = math.copysign(float(np.linalg.norm(v)), v[0])
        if norm == 0:
            continue
        v[0] += norm
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = -norm
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    d, e, z = np.diag(a).copy(), np.diag(a, -1).copy(), q.T.copy()
    top = n - 1
    while top > 0:
        e[:top][np.abs(e[:top]) <= 2.0**-52 * (np.abs(d[:top]) + np.abs(d[1 : top + 1])) + 1e-300] = 0
        if e[top - 1] == 0:
            top -= 1
            continue
        cut = np.flatnonzero(e[: top - 1] == 0)
        low = int(cut[-1]) + 1 if len(cut) else 0
        half = (d[top - 1] - d[top]) / 2
        shift = d[top] - e[top - 1] ** 2 / (half + math.copysign(math.hypot(half, e[top - 1]), half))
        x, y = d[low] - shift, e[low]
        for k in range(low, top):
            r = math.hypot(x, y)
            c, s = (x / r, y / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            p, u, o = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * p + 2 * c * s * o + s * s * u, s * s * p - 2 * c * s * o + c * c * u
            e[k] = c * s * (u - p) + (c * c - s * s) * o
            if k < top - 1:
                x, y = e[k], s * e[k + 1]
                e[k + 1] *= c
            z[k], z[k + 1] = c * z[k] + s * z[k + 1], c * z[k + 1] - s * z[k]
    order = np.argsort(-d, kind="stable")
    return d[order] * scale, z[order]


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is whole and finite and has the length that most such rows have."""
    col = F.col(f"`{vector}`")
    whole = df.where(col.isNotNull() & F.forall(col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))))
    top = whole.groupBy(F.size(col).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return whole.where(F.size(col) == F.lit(top["size"] if top else -1))


def _rows(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _states(vectors: DataFrame) -> State | None:
    """The state of all rows of the only column, vectors of one length."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = None
        for b in batches:
            if b.num_rows:
                rows = _rows(b.column(0))
                state = state or State(0, [0] * rows.shape[1], np.zeros(rows.shape[1]), np.zeros((rows.shape[1],) * 2))
                state.add(rows)
        if state:
            at = TaskContext.get().partitionId()
            yield state.row(at // FAN, at)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (node,), rows in groups(batches, ["node"]):
            state = None
            for row in rows.to_pylist():
                if state:
                    state.merge(_state(row))
                else:
                    state = _state(row)
            yield state.row(node // FAN, node)

    out = materialize(vectors.mapInArrow(first, STATE), "states")
    while (n := out.count()) > 1:
        below, out = out, materialize(out.repartition(-(-n // FAN), "node").sortWithinPartitions("node", "child").mapInArrow(join, STATE), "states")
        drop_table(below)
    found = out.collect()  # the root of the tree
    drop_table(out)
    return _state(found[0].asDict()) if found else None


def fit(df: DataFrame, vector: str, most: int | None = None) -> Whitening:
    """The first ``most`` (all, if None) components of the covariance, divisor n, of a column of ``usable`` vectors, integer or double."""
    state = _states(df.select(F.col(f"`{vector}`")))
    if state is None:
        return Whitening(0, [], np.zeros(0), np.zeros(0), np.zeros((0, 0)), 0.0)
    cov = state.m2 / state.n
    values, vectors = symmetric_eigen(cov)
    real = values > len(values) * 2.0**-50 * max(values[0], 0)
    return Whitening(state.n, state.sums, state.mean, values[real][:most], vectors[real][:most], float(np.trace(cov)))


def whitened(df: DataFrame, vector: str, model: Whitening, carry: list[str]) -> DataFrame:
    """The columns ``carry`` and whitened array<double>: deviations from the mean on the components, over the root of their eigenvalues."""
    kept = df.select(*[F.col(f"`{c}`") for c in carry])
    to = (model.vectors / np.sqrt(model.values)[:, None]).T if len(model.values) else np.zeros((model.dim, 0))
    # integer vectors lose nothing: n * x - S is exact, and is rounded once, when divided
    sums = np.array(model.sums, object)

    def deviations(rows: np.ndarray) -> np.ndarray:
        if rows.dtype.kind == "f":
            return rows - model.mean
        safe = not rows.size or int(np.abs(rows).max()) * model.n < 2**62 and max(abs(s) for s in model.sums) < 2**62
        return ((rows * model.n - sums.astype(np.int64)) if safe else (rows.astype(object) * model.n - sums)).astype(float) / model.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            made = deviations(_rows(b.column(b.num_columns - 1))) @ to
            cut = np.arange(0, made.size + 1, max(made.shape[1], 1)) if made.shape[1] else np.zeros(b.num_rows + 1, int)
            out = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], names=[*b.schema.names[:-1], "whitened"])

    schema = StructType([*kept.schema.fields]).add("whitened", ArrayType(DoubleType()))
    return df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{vector}`").alias("whitened")).mapInArrow(run, schema)


def identity_error(white: DataFrame) -> float | None:
    """The largest absolute entry of the covariance of the column whitened minus the identity; null without rows or components."""
    state = _states(white.select("whitened").where(F.size("whitened") > 0))
    return float(np.abs(state.m2 / state.n - np.eye(len(state.m2))).max()) if state else None


def as_integers(c: Column) -> Column:
    """floor(1024 * c) + 100000 as long; beyond 4e18 entries are held there."""
    scaled = F.least(F.greatest(c.cast("double") * 1024, F.lit(-4e18)), F.lit(4e18))
    return F.floor(scaled).cast("long") + F.lit(100000).cast("long")


def report(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component.

    Reads vec_id and embedding. Entries become integers first (``as_integers``). deviation is null where it is beyond a
    long. Null and repeated ids are carried as they are.
    """
    x = usable(embeddings.select("vec_id", "embedding"), "embedding").select("vec_id", F.transform("embedding", as_integers).alias("x"))
    model = fit(x, "x", components)
    n = F.lit(model.n).cast("long")
    exact = all(abs(s) < 2**63 for s in model.sums)
    sums = F.array(*[F.lit(s).cast("long") for s in model.sums]) if exact and model.sums else F.lit(None).cast("array<long>")
    off = F.zip_with("x", sums, lambda a, s: F.try_subtract(F.try_multiply(n, a), s))
    square = F.aggregate(off, F.lit(0).cast("long"), lambda a, d: F.try_add(a, F.try_multiply(d, d)))
    rows = x.select("vec_id", square.alias("deviation"), "x")
    white = whitened(rows, "x", model, ["vec_id", "deviation"])
    error = identity_error(white)
    explained = F.array(*[F.lit(float(v) / model.trace) for v in model.values]) if len(model.values) else F.array().cast("array<double>")
    out = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), n.alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
