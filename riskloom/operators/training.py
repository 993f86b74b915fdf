"""Learning from tables: best splits, logistic regression, an autoencoder; verdicts on scores; saving models.

Gradients are sums over partitions, so a step is one pass that ships a matrix of a fixed size, however many rows there are.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom import model, rules
from riskloom.functions.files import read_lines, write_lines
from riskloom.functions.lineage import cut
from riskloom.operators.ml import metrics, rounded


def running(df: DataFrame, by: list[str], order: str, sums: list[str], parts: int | None = None) -> DataFrame:
    """Adds before_<c>: the sum of c over rows of equal ``by`` with a smaller ``order``; (by, order) is a key.

    Ranges of the order are summed apart, and each row gets its range's offset, so no ``by`` is a single task.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = cut(df.repartitionByRange(n, *by, order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])  # a row for each range and key in it
    totals = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_{c}").over(w), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy("_part", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(totals, [*by, "_part"])
    return d.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{c}") for c in sums}).drop("_part", *[f"_{c}" for c in sums])


def best_splits(vectors: DataFrame, labels: list[int]) -> DataFrame:
    """(dim, threshold, gain): the value of each dimension that, as the greatest of the left side, lowers Gini impurity most.

    Equal gains (to nine places) fall to the least value. A dimension with one value has no row. Rows without a label don't count.
    """
    e = vectors.where("label is not null").select("label", F.posexplode("embedding").alias("pos", "x")).select((F.col("pos") + 1).alias("dim"), F.col("x").cast("double").alias("x"), "label")
    names = [f"n{i}" for i in range(len(labels))]
    d = e.groupBy("dim", "x").agg(*[F.count_if(F.col("label") == c).alias(n) for n, c in zip(names, labels, strict=True)])
    total = d.groupBy("dim").agg(*[F.sum(n).alias(f"t{n}") for n in names])  # a row for each dimension
    d = running(d, ["dim"], "x", names).join(F.broadcast(total), "dim")
    left = [F.col(n) + F.col(f"before_{n}") for n in names]
    right = [F.col(f"t{n}") - a for n, a in zip(names, left, strict=True)]
    all_ = [F.col(f"t{n}") for n in names]
    plus = lambda cols: sum(cols, F.lit(0))
    gini = lambda cols: F.lit(1.0) - plus([(c / plus(cols)) * (c / plus(cols)) for c in cols])
    d = d.where(plus(right) > 0)
    gain = gini(all_) - (plus(left) * gini(left) + plus(right) * gini(right)) / plus(all_)
    d = d.select("dim", "x", (F.floor(gain * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)).alias("gain"))
    best = d.groupBy("dim").agg(F.max(F.struct("gain", (-F.col("x")).alias("m"))).alias("b"))
    return best.select("dim", (-F.col("b.m")).alias("threshold"), "b.gain")


def onehot(label: Column, classes: list) -> Column:
    return F.array(*[(label == c).cast("double") for c in classes])


class Logistic:
    """One weight vector and bias for each class over scaled features."""

    def __init__(self, classes: list, mean: np.ndarray, dev: np.ndarray):
        self.classes, self.mean, self.dev = classes, mean, dev
        self.w, self.b = np.zeros((len(classes), len(mean))), np.zeros(len(classes))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.dev) @ self.w.T + self.b
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _stacked(b: pa.RecordBatch, i: int, dim: int) -> np.ndarray:
    return np.array(b.column(i).to_pylist(), float).reshape(-1, dim)


def _summed(df: DataFrame, fn) -> np.ndarray:
    """The sum of arrays of a fixed size that ``fn`` makes of each batch; partitions add first, then a tree of tasks."""

    def run(batches):
        total = None
        for b in batches:
            x = fn(b)
            total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"k": pa.array([0], pa.int32()), "x": [total.astype("<f8").tobytes()]})

    def add(batches):
        total = None
        for b in batches:
            for raw in b.column(1).to_pylist():
                x = np.frombuffer(raw, "<f8")
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"k": pa.array([0], pa.int32()), "x": [total.tobytes()]})

    d = df.mapInArrow(run, "k int, x binary")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = d.withColumn("to", F.spark_partition_id() % max(1, int(n**0.5))).repartition(max(1, int(n**0.5)), "to").select("k", "x").mapInArrow(add, "k int, x binary").collect()
    return np.sum([np.frombuffer(r.x, "<f8") for r in rows], 0) if rows else np.zeros(0)


def train_logistic(vectors: DataFrame, classes: list, epochs: int = 20, rate: float = 1.0) -> Logistic:
    """Fit (embedding, label) rows by descent on the whole gradient; features are scaled by mean and deviation first.

    Rows without a label don't count; a feature that doesn't vary is divided by 1. No rows: all weights 0.
    """
    d = cut(vectors.where("label is not null").select(F.col("embedding").cast("array<double>").alias("x"), onehot(F.col("label"), classes).alias("y")))
    first = d.select(F.size("x").alias("n")).first()
    if first is None:
        return Logistic(classes, np.zeros(0), np.ones(0))
    dim, k = first.n, len(classes)

    def moments(b):
        x = _stacked(b, 0, dim)
        return np.r_[len(x), x.sum(0), (x**2).sum(0)]

    s = _summed(d, moments)
    n, mean = s[0], s[1 : dim + 1] / s[0]
    dev = np.sqrt(np.maximum(s[dim + 1 :] / n - mean**2, 0) * n / max(n - 1, 1))
    m = Logistic(classes, mean, np.where(dev > 0, dev, 1.0))
    for _ in range(epochs):
        held = d.sparkSession.sparkContext.broadcast(m)  # of a fixed size

        def gradient(b):
            x, y = _stacked(b, 0, dim), _stacked(b, 1, k)
            off = held.value.probabilities(x) - y  # noqa: B023
            return np.c_[off.T @ ((x - mean) / held.value.dev), off.sum(0)].reshape(-1)  # noqa: B023

        g = _summed(d, gradient).reshape(k, dim + 1) / n
        new = Logistic(classes, m.mean, m.dev)
        new.w, new.b = m.w - rate * g[:, :-1], m.b - rate * g[:, -1]
        held.unpersist()
        m = new
    return m


def classify(vectors: DataFrame, m: Logistic) -> DataFrame:
    """(vec_id, label, prediction, probabilities) by the most probable class; the first of equal ones."""
    held = vectors.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        for b in batches:
            p = held.value.probabilities(_stacked(b, 2, len(held.value.mean)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([held.value.classes[i] for i in p.argmax(1)], pa.int32()), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["vec_id", "label", "prediction", "probabilities"])

    return vectors.select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("x")).mapInArrow(run, "vec_id long, label int, prediction int, probabilities array<double>")


#: one part of so many is held out
PARTS = 5


def held_out(df: DataFrame, parts: int = PARTS) -> Column:
    """Whether a row is in the part that nothing learns from, by MD5 of its id, so that repeated rows stay on one side."""
    name = F.concat(F.lit("h:"), F.coalesce(df["vec_id"].cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % parts == 0


def evaluate_logistic(vectors: DataFrame, classes: list, epochs: int = 20, rate: float = 1.0, parts: int = PARTS) -> DataFrame:
    """n, accuracy, precision, recall, f1 (macro) of a fit to the rows that are not held out, measured on those that are, in one pass."""
    m = train_logistic(vectors.where(~held_out(vectors, parts)), classes, epochs, rate)
    known = vectors.where(held_out(vectors, parts) & F.col("label").isNotNull())
    told = classify(known, m).select(F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
    return metrics(told, classes).select("n", "accuracy", "precision", "recall", "f1")


def training_rows(findings: DataFrame, vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) to learn classes of files from a scan: each file's features with the class of its surest finding.

    Of equally sure ones the gravest counts, then the first by class. Files without a finding have no label. Labels are
    places in ``model.CLASSES``; ``vectors`` are (vec_id, embedding) with the path as vec_id.
    """
    place = model.choose(F.col("vuln_class"), {c[0]: i for i, c in enumerate(model.CLASSES)}, None)
    best = findings.groupBy(F.col("file_path").alias("vec_id")).agg(F.max(F.struct("confidence", model.severity_rank(F.col("severity")).alias("s"), (-place).alias("label"))).alias("b"))
    return vectors.join(best.select("vec_id", (-F.col("b.label")).cast("int").alias("label")), "vec_id", "left").select("vec_id", "embedding", "label")


# --- autoencoder -----------------------------------------------------------------------------------------------------


class Autoencoder:
    """Layers of rectified sums down to the last of ``hidden`` and back; the last one is linear."""

    def __init__(self, dim: int, hidden: tuple[int, ...] = (16, 8), seed: int = 7):
        rng = np.random.default_rng(seed)
        sizes = [dim, *hidden]
        down = list(zip(sizes[1:], sizes, strict=False))
        layer = lambda a, b: (rng.normal(0, np.sqrt(2 / b), (a, b)), np.zeros(a))
        self.encoder = [layer(a, b) for a, b in down]
        self.decoder = [layer(b, a) for a, b in reversed(down)]
        self.threshold = 0.1

    def encode(self, x: np.ndarray) -> np.ndarray:
        for w, b in self.encoder:
            x = np.maximum(x @ w.T + b, 0)
        return x

    def inner(self, z: np.ndarray) -> np.ndarray:
        """What the last layer sees."""
        for w, b in self.decoder[:-1]:
            z = np.maximum(z @ w.T + b, 0)
        return z

    def decode(self, z: np.ndarray) -> np.ndarray:
        w, b = self.decoder[-1]
        return self.inner(z) @ w.T + b

    def errors(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.decode(self.encode(x))) ** 2).mean(1)


def train_autoencoder(vectors: DataFrame, hidden: tuple[int, ...] = (16, 8), epochs: int = 10, rate: float = 0.1, seed: int = 7, share: float = 0.95) -> Autoencoder | None:
    """Fit the last layer by descent on the mean gradient; the threshold is the ``share`` quantile of the training errors."""
    d = cut(vectors.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("x")))
    first = d.select(F.size("x").alias("n")).first()
    if first is None:
        return None
    dim, ae = first.n, Autoencoder(first.n, hidden, seed)
    for _ in range(epochs):
        held = d.sparkSession.sparkContext.broadcast(ae)

        def gradient(b):
            x, m = _stacked(b, 1, dim), held.value  # noqa: B023
            h = m.inner(m.encode(x))
            off = h @ m.decoder[-1][0].T + m.decoder[-1][1] - x
            return np.r_[len(x), (2 * off.T @ h).reshape(-1), 2 * off.sum(0)]

        g = _summed(d, gradient)
        w, b = ae.decoder[-1]
        ae.decoder[-1] = (w - rate * g[1 : 1 + w.size].reshape(w.shape) / g[0] / dim, b - rate * g[1 + w.size :] / g[0] / dim)
        held.unpersist()
    ae.threshold = quantile(autoencoder_errors(vectors, ae), "error", share)
    return ae


def quantile(df: DataFrame, column: str, share: float) -> float:
    """The exact quantile of a column, between its neighbours in proportion; places come from ``running``, so no task sees all rows."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    placed = cut(running(values, ["one"], "x", ["n"]))
    all_ = placed.agg(F.sum("n")).first()[0] or 0
    if not all_:
        return 0.0
    at = share * (all_ - 1)
    low, high = int(np.floor(at)), int(np.ceil(at))
    holds = lambda i: (F.col("before_n") <= i) & (F.col("before_n") + F.col("n") > i)
    a, b = placed.agg(F.max(F.when(holds(low), F.col("x"))), F.max(F.when(holds(high), F.col("x")))).first()
    return a + (b - a) * (at - low)


def autoencoder_errors(vectors: DataFrame, ae: Autoencoder) -> DataFrame:
    """(vec_id, error, is_anomaly): mean squared errors of reconstruction, and whether they pass the threshold."""
    held = vectors.sparkSession.sparkContext.broadcast(ae)

    def run(batches):
        for b in batches:
            e = held.value.errors(_stacked(b, 1, held.value.encoder[0][0].shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(e), pa.array(e > held.value.threshold)], names=["vec_id", "error", "is_anomaly"])

    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).mapInArrow(run, "vec_id long, error double, is_anomaly boolean")


# --- verdicts --------------------------------------------------------------------------------------------------------


def anomalies(scores: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Rows of (id, score) at or over the threshold, the highest first."""
    return scores.where(F.col("score") >= threshold).orderBy(F.desc("score"), "id")


def verdicts(scores: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(id, score, percentile, level, is_anomaly): percentile is the share of all rows with a lower score, in percent."""
    c = scores.groupBy("score").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    n = scores.agg(F.count("*").alias("all"))
    lower = running(c, ["one"], "score", ["n"]).select("score", F.col("before_n").alias("lower"))
    level = F.when(F.col("score") >= 0.8, "CRITICAL").when(F.col("score") >= 0.6, "HIGH").when(F.col("score") >= 0.4, "MEDIUM").otherwise("LOW")
    d = scores.join(lower, "score").crossJoin(n)  # one row
    return d.select("id", "score", rounded(F.col("lower") / F.col("all") * 100).alias("percentile"), level.alias("level"), (F.col("score") >= threshold).alias("is_anomaly"))


def contributions(x: np.ndarray, mean: np.ndarray, score, least: float = 0.01, most: int = 5) -> list[tuple[int, float]]:
    """Features (from 1) whose change to the mean lowers a score by more than ``least``, the strongest first."""
    own = score(x)
    found = []
    for i in range(len(x)):
        y = x.copy()
        y[i] = mean[i]
        if (by := own - score(y)) > least:
            found.append((i + 1, by))
    return sorted(found, key=lambda p: -p[1])[:most]


def classes_of_feature(number: Column) -> Column:
    """The classes that an unusual feature speaks for."""
    return model.choose(number, rules.FEATURE_CLASSES, F.array().cast("array<string>"))


# --- saving ----------------------------------------------------------------------------------------------------------


def save_model(m, path: str, spark=None) -> None:
    """Write the numbers of a model (its attributes, nested) as JSON; with a session, to any file system that Spark knows."""

    def plain(x):
        if isinstance(x, np.ndarray):
            return {"shape": list(x.shape), "values": x.reshape(-1).tolist()}
        if isinstance(x, (list, tuple)):
            return [plain(y) for y in x]
        if isinstance(x, dict):
            return {"keys": list(x), "items": [plain(y) for y in x.values()]}
        return x.item() if isinstance(x, np.generic) else x

    write_lines([json.dumps({"kind": type(m).__name__, "of": {k: plain(v) for k, v in vars(m).items()}})], path, spark)


def load_model(path: str, *kinds: type, spark=None):
    """A model of one of the given kinds from a file that ``save_model`` wrote."""

    def back(x):
        if isinstance(x, dict) and "shape" in x:
            return np.array(x["values"], float).reshape(x["shape"])
        if isinstance(x, dict):
            return dict(zip(x["keys"], map(back, x["items"]), strict=True))
        return [back(y) for y in x] if isinstance(x, list) else x

    found = read_lines(path, spark)
    if found is None:
        raise FileNotFoundError(path)
    d = json.loads(found[0])
    kind = {k.__name__: k for k in kinds}[d["kind"]]
    m = kind.__new__(kind)
    vars(m).update({k: back(v) for k, v in d["of"].items()})
    return m
