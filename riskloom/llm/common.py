"""What the operators of this subpackage share: tables, shared folders, partition counts, streams of groups."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: what cuts words: [\x20\x09-\x0D]
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where unset (tests) one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='riskloom-')}"
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("spark.riskloom.scratch", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    where = spark.conf.get("spark.riskloom.scratch", None) or shared_dir(spark)
    return f"{where}/riskloom-{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: rows of an Arrow batch: ten thousand whole texts, Spark's default, are too many to hold several times over
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Limit the session's Arrow batches to BATCH_ROWS, unless they are smaller yet."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_bound(wanted: int, n: int) -> int:
    """A bound that more than ``wanted`` of n signed 64-bit hashes lie under, so that few rows are ranked for the least ones."""
    share = 1.0 if n <= 2 * wanted + 1000 else (2 * wanted + 1000) / n
    return int(share * 2**64) - 2**63 - 1


def bucket_of(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null for null."""
    return F.crc32(col.cast("string").cast("binary")) % n


def plain(df: DataFrame, *cols: str) -> DataFrame:
    """Only the columns that an operator reads, so that others, of whatever name, can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal keys of a sorted stream, as (key, table)."""
    held: list[pa.RecordBatch] = []
    at: tuple | None = None
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        i = 0
        rows = list(zip(*cols, strict=True))
        while i < len(rows):
            j = i + 1
            while j < len(rows) and rows[j] == rows[i]:
                j += 1
            if at is not None and rows[i] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = rows[i]
            held.append(batch.slice(i, j - i))
            i = j
    if held:
        yield at, pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], key: int, rows: int = 1 << 16) -> Iterator[list]:
    """The columns of a stream sorted by an integer key, as NumPy arrays of some ``rows`` rows, no key's rows parted."""
    held, n = [], 0
    for b in batches:
        held.append([c.to_numpy() for c in b.columns])
        n += b.num_rows
        if n < rows or held[-1][key][-1] == held[0][key][0]:
            continue
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        last = int(np.argmax(cols[key] == cols[key][-1]))
        yield [c[:last] for c in cols]
        held, n = [[c[last:] for c in cols]], n - last
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has at most ``most`` of them."""
    return F.broadcast(df) if df.count() <= most else df


def by_group(df: DataFrame, keys: list[str], n: int, fn: Callable, schema: str) -> DataFrame:
    """Shuffle by the integer keys, sort, and give each group as ``fn(key, columns) -> arrays of the schema's columns``.

    Columns are NumPy arrays by name, or lists of bytes. A group is in memory whole.
    """
    names = [f.strip().split()[0] for f in schema.split(",")]

    def columns(b: pa.RecordBatch) -> dict:
        return {k: b.column(i).to_pylist() if pa.types.is_binary(b.schema.field(i).type) else b.column(i).to_numpy() for i, k in enumerate(b.schema.names)}

    def joined(held: list[dict]) -> dict:
        return held[0] if len(held) == 1 else {k: np.concatenate([h[k] for h in held]) if isinstance(x, np.ndarray) else [y for h in held for y in h[k]] for k, x in held[0].items()}

    def run(batches):
        held: list[dict] = []
        made: list[tuple] = []

        def call(cols: dict):
            made.append(fn(tuple(int(cols[k][0]) for k in keys), cols))

        def out():
            rows = [np.concatenate([np.asarray(m[i], np.int64) for m in made]) for i in range(len(names))]
            made.clear()
            return pa.RecordBatch.from_pydict(dict(zip(names, rows, strict=True)))

        for b in batches:
            cols = columns(b)
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            new[0] = not held or any(held[-1][k][-1] != cols[k][0] for k in keys)
            for k in keys:
                new[1:] |= cols[k][1:] != cols[k][:-1]
            cut = [*np.flatnonzero(new).tolist(), b.num_rows]
            if cut[0] > 0:
                held.append({k: x[: cut[0]] for k, x in cols.items()})
            if held and len(cut) > 1:
                call(joined(held))
                held = []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                part = {k: x[i:j] for k, x in cols.items()}
                if j == b.num_rows:
                    held = [part]
                else:
                    call(part)
            if len(made) > 10_000:
                yield out()
        if held:
            call(joined(held))
        if made:
            yield out()

    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def table_by_group(df: DataFrame, keys: list[str], n: int, fn: Callable, schema: str, order: list | None = None) -> DataFrame:
    """Shuffle by the keys, sort, and give each group as an Arrow table to ``fn(key, table) -> RecordBatch | None``."""

    def run(batches):
        for key, rows in groups(batches, keys):
            if (out := fn(key, rows)) is not None and out.num_rows:
                yield out

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, schema)


def local_path(uri: str) -> tuple[object, str]:
    """An Arrow file system and the path in it; understands file:, hdfs:, s3:, gs: and plain paths."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file://" + os.path.abspath("/" + uri.removeprefix("file:").lstrip("/"))
    return fs.FileSystem.from_uri(uri)
