"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped for scoring.

Words become positions in a sorted array of 64-bit hashes, bigrams 64-bit keys of
two positions; both are cut by range into files in the shared folder, and each
table is sorted from the first file to the last. Counting ships compressed blocks
of sorted keys, summed before each shuffle, never a row per token. Workers map
the files and look up sorted batches of keys, so what they hold is a page cache
and not a model; where the shared folder is no local path, they read a file when
its range is asked for and drop it after.

With discounts D1, D2, D3 (three and more) from the counts of counts,
  p(w | h) = max(c(hw) - D, 0) / c(h) + (D1 N1(h) + D2 N2(h) + D3 N3(h)) / c(h) * p(w),
and p(w) in the same way from the numbers of different words before w, backed by
1 / (V + 1) for V words and an unknown one. An unseen history leaves p(w).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import vectext as vt
from riskloom.llm.common import bucket_of, local_path, materialize, partitions, scratch

U64 = np.uint64
#: the end of a text is a token; the begin is only ever a history
END = U64(0x5851F42D4C957F2D)
#: bytes of text in one lookup, and keys that a counting task holds before it sums them
LOOK_BYTES, HELD_KEYS = 2 << 20, 1_000_000
#: most frequent words of each range that are asked whether they are histories too frequent for one range
HEAVY_MOST = 64


def _tokens(column):
    """Slices of (first row, end row, hashes of all tokens with an end after each text, row bounds)."""
    raw, bounds = vt.utf8(column)
    for i, j in vt.slices(bounds, LOOK_BYTES):
        h, rows = [], [np.zeros(1, np.int64)]
        for a, b in vt.slices(bounds[i : j + 1]):
            part = raw[bounds[i + a] : bounds[i + b]]
            starts, ends, cut = vt.words(part, bounds[i + a : i + b + 1] - bounds[i + a])
            own = vt.span_hashes(part, starts, ends, True)
            n = np.diff(cut) + 1
            out = np.full(int(n.sum()), END, U64)
            end = np.zeros(len(out), bool)
            end[np.cumsum(n) - 1] = True
            out[~end] = own
            h.append(out)
            rows.append(rows[-1][-1] + np.cumsum(n))
        yield i, j, np.concatenate(h), np.concatenate(rows)


def _sum_sorted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    o = np.argsort(k, kind="stable")
    k, c = k[o], c[o]
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[cut], np.add.reduceat(c, cut) if len(k) else c


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane, and counts, compressed."""
    d = np.diff(keys, prepend=U64(0)).astype("<u8")
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T)
    wide = np.dtype("<u8" if len(counts) and counts.max() >> 32 else "<u4")
    return zlib.compress(np.array([len(d), wide.itemsize], "<u8").tobytes() + planes.tobytes() + counts.astype(wide).tobytes(), 1)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(raw)
    n, wide = np.frombuffer(raw, "<u8", 2).tolist()
    planes = np.frombuffer(raw, np.uint8, 8 * n, 16).reshape(8, n)
    d = np.ascontiguousarray(planes.T).view("<u8").reshape(-1)
    return np.cumsum(d.astype(U64)), np.frombuffer(raw, f"<u{wide}", n, 16 + 8 * n).astype(np.int64)


class _Counter:
    """Sums of key counts of one task, given out as blocks by key range."""

    def __init__(self, edges: np.ndarray):
        self.edges, self.k, self.c, self.n = edges, [], [], 0

    def add(self, keys: np.ndarray):
        k, c = np.unique(keys, return_counts=True)
        self.k.append(k)
        self.c.append(c)
        self.n += len(k)
        if self.n >= 2 * HELD_KEYS and len(self.k) > 1:
            k, c = _sum_sorted(self.k, self.c)
            self.k, self.c, self.n = [k], [c], len(k)

    def full(self) -> bool:
        return self.n >= HELD_KEYS

    def blocks(self):
        if self.k:
            k, c = _sum_sorted(self.k, self.c)
            cut = np.r_[0, np.searchsorted(k, self.edges), len(k)]
            self.k, self.c, self.n = [], [], 0
            for b in np.flatnonzero(np.diff(cut)):
                yield pa.RecordBatch.from_pydict({"range": pa.array([b], pa.int32()), "block": [_pack(k[cut[b] : cut[b + 1]], c[cut[b] : cut[b + 1]])]})


_BLOCK = "range int, block binary"


def _merged(batches):
    """Sums the blocks of each range; ranges come one after another."""
    at, keys, counts = None, [], []
    for b in batches:
        for r, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if at is not None and r != at:
                yield at, *_sum_sorted(keys, counts)
                keys, counts = [], []
            at = r
            k, c = _unpack(raw)
            keys.append(k)
            counts.append(c)
            if sum(map(len, keys)) > 2 * HELD_KEYS:
                k, c = _sum_sorted(keys, counts)
                keys, counts = [k], [c]
    if at is not None:
        yield at, *_sum_sorted(keys, counts)


def _save(folder: str, kind: str, r: int, arrays: list[np.ndarray]) -> str:
    from pyspark import TaskContext

    fs, base = local_path(folder)
    fs.create_dir(base, recursive=True)
    path = f"{base}/{kind}-{r:05d}-{TaskContext.get().taskAttemptId()}.bin"
    with fs.open_output_stream(path, compression=None) as f:
        # counts take four bytes unless one of the file needs eight
        narrow = [a if a.dtype == U64 or len(a) and a.max() >> 32 else a.astype("<u4") for a in arrays]
        f.write(np.array([len(arrays[0]), *[a.dtype.itemsize for a in narrow]], "<u8").tobytes())
        for a in narrow:
            f.write(np.ascontiguousarray(a))
    return path


#: files that a worker has fetched from a folder that is no local path: the first ones, as far as they fit
_FETCHED: dict[str, np.ndarray] = {}
FETCHED_BYTES = 256 << 20


def _map(folder: str, path: str, columns: int) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped if the folder is a local path."""
    from pyarrow import fs as afs

    fs, _ = local_path(folder)
    if isinstance(fs, afs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    elif (raw := _FETCHED.get(path)) is None:
        raw = np.frombuffer(fs.open_input_file(path).read(), np.uint8)
        if sum(map(len, _FETCHED.values())) + len(raw) <= FETCHED_BYTES:
            _FETCHED[path] = raw
    n, *wide = raw[: 8 + 8 * columns].view("<u8").tolist()
    at, out = 8 + 8 * columns, []
    for w in wide:
        out.append(raw[at : at + n * w].view(f"<u{w}"))
        at += n * w
    return out


class Table:
    """A sorted table in range files: (path, first position) by range, looked up in sorted batches."""

    def __init__(self, folder: str, edges: np.ndarray, files: dict[int, tuple[str, int]], columns: int):
        self.folder, self.edges, self.files, self.columns = folder, edges, files, columns

    def look(self, keys: np.ndarray, columns: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Positions (-1 if absent) of sorted keys, and the columns' values (0 if absent)."""
        pos, out = np.full(len(keys), -1, np.int64), [np.zeros(len(keys), np.int64) for _ in columns]
        cut = np.r_[0, np.searchsorted(keys, self.edges), len(keys)]
        for r, (path, first) in self.files.items():
            a, b = int(cut[r]), int(cut[r + 1])
            if a == b:
                continue
            cols = _map(self.folder, path, self.columns)
            if not len(cols[0]):
                continue
            p = np.searchsorted(cols[0], keys[a:b])
            p[p == len(cols[0])] = 0
            ok = cols[0][p] == keys[a:b]
            pos[a:b][ok] = p[ok] + first
            for o, c in zip(out, columns, strict=True):
                o[a:b][ok] = cols[c][p[ok]]
        return pos, out


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3 of the numbers of things counted once to four times; plain defaults where a number is 0."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return tuple(min(max(x, 0.1), i + 1.0) for i, x in enumerate(d))  # something is always left for the unseen


class Model:
    """Files and figures of a trained model; small, so that it goes to workers whole."""

    words: Table
    bigrams: Table
    histories: Table
    #: (key, count, followers seen once, twice, more often) of histories that several ranges hold
    heavy: np.ndarray
    tokens: int
    types: int


#: arrays of a file: keys, and what belongs to them
_WORDS, _BIGRAMS, _CONT, _HIST = 2, 2, 2, 5


def _keys(pos: np.ndarray, rows: np.ndarray, begin: int) -> np.ndarray:
    """Bigram keys of positions + 1 (0 for an unknown word); the history of a text's first token is ``begin``."""
    h = np.empty_like(pos)
    h[1:] = pos[:-1]
    h[rows[:-1]] = begin
    return (h + 1).astype(U64) << U64(32) | (pos + 1).astype(U64)


def _positions(table: Table, hashes: np.ndarray, columns=(1,)):
    u, inv = np.unique(hashes, return_inverse=True)
    pos, cols = table.look(u, list(columns))
    return pos[inv], [c[inv] for c in cols]


def train(docs: DataFrame, folder: str | None = None) -> Model:
    """Count the texts of ``docs`` (column text; null is empty, an end only) and write the model's files."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "lm")
    texts = docs.select("text")
    n = 1 << max(4, (partitions(spark) - 1).bit_length())
    edges = (np.arange(1, n, dtype=U64) << U64(64 - n.bit_length() + 1)).astype(U64)

    def count_words(batches):
        c = _Counter(edges)
        for b in batches:
            for *_, h, _rows in _tokens(b.column(0)):
                c.add(h)
                if c.full():
                    yield from c.blocks()
        yield from c.blocks()

    def word_files(batches):
        for r, k, c in _merged(batches):
            path = _save(folder, "words", r, [k, c])
            top = np.argsort(-c, kind="stable")[:HEAVY_MOST]
            yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "path": [path], "types": pa.array([len(k)], pa.int64()), "tokens": pa.array([int(c.sum())], pa.int64()), "top": pa.array([top.tolist()], pa.list_(pa.int64())), "times": pa.array([c[top].tolist()], pa.list_(pa.int64())), "ends": pa.array([int(c[k == END].sum())], pa.int64())})

    def by_range(df, parts=n):
        return df.repartition(parts, "range").sortWithinPartitions("range")

    m = Model()
    made = by_range(texts.mapInArrow(count_words, _BLOCK)).mapInArrow(word_files, "range int, path string, types long, tokens long, top array<long>, times array<long>, ends long")
    files, first, often, ends = {}, 0, [], 0
    for r in sorted(made.collect(), key=lambda r: r.range):  # a row for each of the n files
        files[r.range] = (r.path, first)
        often += [(first + i, c) for i, c in zip(r.top, r.times, strict=True)]
        ends += r.ends
        first += r.types
        m.tokens = getattr(m, "tokens", 0) + r.tokens
    m.types, m.tokens = first, getattr(m, "tokens", 0)
    if m.types >= 2**32 - 2:
        raise ValueError("more different words than 32-bit positions")
    m.words = Table(folder, edges, files, _WORDS)
    # ranges of bigrams by history and of continuations by word, with as many words in each
    steps = np.unique(1 + np.arange(1, n) * (m.types + 2) // n).astype(U64)
    # histories with more than a range's share of all tokens are cut by word too; at most 2 * n + 2 edges more
    share = max(1.0, m.tokens / n)
    heavy = {at + 1: c for at, c in [*often, (m.types, ends)] if c > share}
    cuts = [h << 32 | j * (m.types + 2) // -(-c // int(share)) for h, c in heavy.items() for j in range(-(-c // int(share)))] + [h + 1 << 32 for h in heavy]
    pair_edges = np.unique(np.r_[steps << U64(32), np.array(cuts, U64)])
    heavy_keys = np.array(sorted(heavy), U64)
    held = spark.sparkContext.broadcast(m.words)
    begin = m.types

    def count_pairs(batches):
        c = _Counter(pair_edges)
        for b in batches:
            for *_, h, rows in _tokens(b.column(0)):
                pos, _ = _positions(held.value, h)
                c.add(_keys(pos, rows, begin))
                if c.full():
                    yield from c.blocks()
        yield from c.blocks()

    def pair_files(batches):
        for r, k, c in _merged(batches):
            path = _save(folder, "bigrams", r, [k, c])
            h = k >> U64(32)
            cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            stats = [np.add.reduceat(x.astype(np.int64), cut) for x in (c, c == 1, c == 2, c >= 3)]
            own = ~np.isin(h[cut], heavy_keys)
            hist = _save(folder, "histories", r, [h[cut][own], *[x[own] for x in stats]])
            part = np.stack([h[cut].astype(np.int64), *stats], 1)[~own].reshape(-1).tolist()
            w, before = np.unique(k & U64(0xFFFFFFFF), return_counts=True)
            yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "block": pa.array([None], pa.binary()), "path": [path], "hist": [hist], "part": pa.array([part], pa.list_(pa.int64())), "counts": pa.array([np.bincount(np.minimum(c, 5), minlength=6)[1:5].tolist()], pa.list_(pa.int64())), "size": pa.array([len(k)], pa.int64())})
            at = np.r_[0, np.searchsorted(w, steps), len(w)]
            for b in np.flatnonzero(np.diff(at)):
                yield pa.RecordBatch.from_pydict({"range": pa.array([b], pa.int32()), "block": [_pack(w[at[b] : at[b + 1]], before[at[b] : at[b + 1]])], "path": pa.array([None], pa.string()), "hist": pa.array([None], pa.string()), "part": pa.array([None], pa.list_(pa.int64())), "counts": pa.array([None], pa.list_(pa.int64())), "size": pa.array([None], pa.int64())})

    def cont_files(batches):
        for r, w, c in _merged(batches):
            path = _save(folder, "continuations", r, [w, c])
            yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "path": [path], "counts": pa.array([np.r_[np.bincount(np.minimum(c, 5), minlength=6)[1:5], (c >= 3).sum()].tolist()], pa.list_(pa.int64())), "total": pa.array([int(c.sum())], pa.int64())})

    pairs = materialize(by_range(texts.mapInArrow(count_pairs, _BLOCK), len(pair_edges) + 1).mapInArrow(pair_files, _BLOCK + ", path string, hist string, part array<long>, counts array<long>, size long"), "pairs")
    done = pairs.where("path is not null").select("range", "path", "hist", "part", "counts").collect()  # a row for each range
    m.bigrams = Table(folder, pair_edges, {r.range: (r.path, 0) for r in done}, _BIGRAMS)
    m.histories = Table(folder, (pair_edges + U64(0xFFFFFFFF)) >> U64(32), {r.range: (r.hist, 0) for r in done}, _HIST)
    m.heavy = np.zeros((len(heavy_keys), 5), np.int64)
    m.heavy[:, 0] = heavy_keys
    for r in done:
        for h, *x in np.array(r.part or [], np.int64).reshape(-1, 5).tolist():
            m.heavy[np.searchsorted(heavy_keys, U64(h)), 1:] += x
    m.d2 = _discounts([sum(r.counts[i] for r in done) for i in range(4)])
    conts = by_range(pairs.where("block is not null").select("range", "block")).mapInArrow(cont_files, "range int, path string, counts array<long>, total long").collect()
    m.cont = Table(folder, steps, {r.range: (r.path, 0) for r in conts}, _CONT)
    low = [sum(r.counts[i] for r in conts) for i in range(5)]
    m.d1, m.pairs = _discounts(low[:4]), max(1, sum(r.total for r in conts))
    m.rest = (m.d1[0] * low[0] + m.d1[1] * low[1] + m.d1[2] * low[4]) / m.pairs if conts else 1.0
    return m


def _cut(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discount."""
    return np.maximum(c - np.choose(np.minimum(c, 3), (0.0, *d)), 0.0)


def score_text(m: Model, hashes: np.ndarray, rows: np.ndarray):
    """For each text of a slice: tokens, known tokens, base score, model score."""
    pos, (count,) = _positions(m.words, hashes)
    base = np.log10((count + 0.1) / (m.tokens + 0.1 * (m.types + 1)))
    k, inv = np.unique(_keys(pos, rows, m.types), return_inverse=True)
    _, (c2,) = m.bigrams.look(k, [1])
    h, back = np.unique(k >> U64(32), return_inverse=True)
    _, figures = m.histories.look(h, [1, 2, 3, 4])
    if len(m.heavy):
        at = np.minimum(np.searchsorted(m.heavy[:, 0], h.astype(np.int64)), len(m.heavy) - 1)
        hot = m.heavy[at, 0] == h.astype(np.int64)
        for i, x in enumerate(figures):
            x[hot] = m.heavy[at[hot], i + 1]
    ch, n1, n2, n3 = figures
    w, word = np.unique(k & U64(0xFFFFFFFF), return_inverse=True)
    _, (cont,) = m.cont.look(w, [1])
    low = _cut(cont, m.d1) / m.pairs + m.rest / (m.types + 1)
    seen = np.maximum(ch, 1)
    left = np.where(ch > 0, (m.d2[0] * n1 + m.d2[1] * n2 + m.d2[2] * n3) / seen, 1.0)
    p = np.log10(_cut(c2, m.d2) / seen[back] + left[back] * low[word])[inv]
    cut = rows[:-1]
    return np.diff(rows), np.add.reduceat((count > 0).astype(np.int64), cut), np.add.reduceat(base, cut), np.add.reduceat(p, cut)


def score(docs: DataFrame, m: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, and n_tokens, n_known, train_tokens, base_score, score of its whole text.

    A null text is empty and has the end token only. A model of no text gives every token 1 / (V + 1) = 1, and a base
    score of 0 as 0.1 / 0.1. Equal texts score equally; other columns are not read; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(m)
    part = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1]) + ", n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches):
        m = held.value
        for b in batches:
            for i, j, h, rows in _tokens(b.column(b.num_columns - 1)):
                n, known, base, p = score_text(m, h, rows)
                own = [c.slice(i, j - i) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(known), pa.array(np.full(j - i, m.tokens)), pa.array(base), pa.array(p)], names=[*b.schema.names[:-1], "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return part.mapInArrow(run, schema)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and scores: learns from rows that are not held out (crc32 of doc_id modulo 10), scores all.

    Null and empty texts are an end token. A null doc_id is not held out; repeated rows count as often as they stand.
    Texts are read whole. An empty table gives an empty result; columns beyond doc_id and text are not read.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(bucket_of(F.col("doc_id"), 10) == 0, F.lit(False)).alias("held_out"), "text")
    return score(d, train(d.where("not held_out")), ["doc_id", "held_out"])
