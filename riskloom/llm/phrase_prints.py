"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing cuts a text into phrases. Each symbol gets the place
and value of the lowest bit in which it differs from the one before; a few
rounds leave labels of less than four bits, and a phrase begins wherever a label
is greater than both its neighbours. Cuts so depend on a few symbols around
them and on nothing else, so that equal substrings have equal phrases inside,
whatever stands before them. A phrase's name is a hash of its symbols, and the
names are the symbols of the next level.

A fingerprint is the hash of the whole text, and for each of two levels the
smallest name in each of BINS bins; what two of them share estimates how much of
the phrases two texts share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm import vectext as vt
from riskloom.llm.common import materialize, partitions

U64 = np.uint64
BINS = 64
#: phrases of level 2 have some 10 characters, of level 3 some 30
LEVELS = (2, 3)
NONE = 0xFFFF


def _toss(bits: int, size: int) -> np.ndarray:
    """A table of (before * size + now) to the next round's label: twice the lowest differing bit's place, plus its value.

    Equal neighbours, which only runs of one symbol have, get the label after the last.
    """
    before, now = np.divmod(np.arange(size * size), size)
    x = before ^ now
    low = np.zeros_like(x)
    for b in range(bits - 1, -1, -1):
        low[x >> b & 1 == 1] = b
    return np.where(x == 0, 2 * bits, 2 * low + (now >> low & 1)).astype(np.uint8)


_BYTES = _toss(8, 256)  # labels 0 to 16
_FIVE = _toss(5, 32)  # 0 to 10
_FOUR = _toss(4, 16)  # 0 to 8
_WIDE = _toss(8, 256)  # from 0 to 128


def _rounds(lab: np.ndarray, table: np.ndarray, size: int, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(lab)
    before[1:] = lab[:-1]
    before[first] = 0
    return table[before.astype(np.uint16) * np.uint16(size) + lab]


def _cuts(lab: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where phrases begin: at each row's begin and at local maxima."""
    up = np.zeros(len(lab), bool)
    up[1:-1] = (lab[1:-1] > lab[:-2]) & (lab[1:-1] > lab[2:])
    begin = bounds[:-1][np.diff(bounds) > 0]
    up[begin] = True
    after = begin + 1
    up[after[after < len(lab)]] = False  # no phrase of one symbol at a row's begin,
    up[bounds[1:][np.diff(bounds) > 0] - 1] = False  # nor at its end, where the label after is another row's
    up[begin] = True
    return np.flatnonzero(up)


def parse(raw: np.ndarray, bounds: np.ndarray, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(names, row bounds) of levels 1 to ``levels`` of rows of bytes."""
    out = []
    first = bounds[:-1][np.diff(bounds) > 0]
    lab = _rounds(raw, _BYTES, 256, first) if len(raw) else raw
    names = None
    for _ in range(levels):
        if len(lab):
            for table, size in ((_FIVE, 32), (_FOUR, 16), (_FOUR, 16)):
                lab = _rounds(lab, table, size, first)
            starts = _cuts(lab, bounds)
            ends = np.r_[starts[1:], len(lab)]
            names = vt.span_hashes(raw, starts, ends) if names is None else vt.name_hashes(names, starts, ends)
            bounds = np.searchsorted(starts, bounds)
        else:
            names = np.zeros(0, U64)
        out.append((names, bounds))
        first = bounds[:-1][np.diff(bounds) > 0]
        if len(names):
            before = np.empty_like(names)
            before[1:] = names[:-1]
            before[first] = 0
            x = names ^ before
            low = np.bitwise_count((x & (~x + U64(1))) - U64(1))  # 64 if equal
            lab = np.where(x == 0, 128, 2 * low + (names >> low.astype(U64) & U64(1)).astype(np.uint8)).astype(np.uint8)
            lab = _rounds(lab, _WIDE, 256, first)
        else:
            lab = np.zeros(0, np.uint8)
    return out


def sketches(texts: pa.Array) -> np.ndarray:
    """(rows, levels * BINS) of 16-bit least names; NONE for a bin without a name."""
    raw, bounds = vt.utf8(texts)
    out = np.full((len(texts), len(LEVELS) * BINS), NONE, np.uint16)
    for i, j in vt.slices(bounds):
        done = parse(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], max(LEVELS))
        for k, level in enumerate(LEVELS):
            names, cut = done[level - 1]
            row = np.repeat(np.arange(i, j), np.diff(cut))
            place = row * out.shape[1] + k * BINS + (names >> U64(64 - 6)).astype(np.int64)
            np.minimum.at(out.reshape(-1), place, np.minimum(names >> U64(40) & U64(0xFFFF), NONE - 1).astype(np.uint16))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated share of phrases in common, 2 |A & B| / (|A| + |B|), over both levels; 1 for two empty texts."""
    full = (a != NONE) | (b != NONE)
    same = ((a == b) & full).sum(1)
    n = full.sum(1)
    return np.where(n == 0, 1.0, 2 * same / np.maximum(n + same, 1))


def _prints(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    s = sketches(pa.array(texts, pa.large_string()))
    big = s.astype(">u2")
    return [xxhash.xxh3_64_digest(t) + big[i].tobytes() for i, t in enumerate(texts)], s


def _edited(text: str, after: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + after[:q]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], after: list[str]) -> pa.RecordBatch:
    """Results of documents whose next ones' texts are ``after``."""
    changed = [_edited(t, a) for t, a in zip(texts, after, strict=True)]
    own, s = _prints(texts)
    theirs, e = _prints(changed)
    # the next row's text is mostly the next one here
    chained = all(a is t for a, t in zip(after[:-1], texts[1:], strict=True))
    nexts = np.concatenate((s[1:], _prints(after[-1:])[1])) if chained and texts else _prints(after)[1]
    sha = [hashlib.sha256(c.encode("utf-8", "surrogatepass")).digest() for c in changed]
    near, near_next = likeness(s, e), likeness(s, nexts)
    near[[a == b for a, b in zip(texts, changed, strict=True)]] = 1.0
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, [len(t) for t in texts], sha, own, theirs, near, near_next), _SCHEMA, strict=True)], schema=_SCHEMA)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    Reads doc_id and text. The edited text has the last quarter of its code points (rounded down) replaced by the
    first as many, or all, of the next document's, in ascending order of doc_id, null first; rows with one doc_id stand
    by text, null first. After the last comes the first, which for a single row is itself. Null texts are empty; empty
    ones are like each other (1.0) and unlike others (0.0). Equal texts have equal fingerprints. An empty table gives an
    empty result.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    head = pa.schema([("task", pa.int32()), ("kind", pa.string()), ("text", pa.string())])

    def edge(task, kind, doc_id, text):
        row = {"task": task, "kind": kind, "text": text, "doc_id": doc_id}
        return pa.RecordBatch.from_pylist([{f.name: row.get(f.name) for f in [*head, *_SCHEMA]}], schema=pa.schema([*head, *_SCHEMA]))

    def run(batches):
        from pyspark import TaskContext

        task, held, first = TaskContext.get().partitionId(), None, True
        for b in batches:
            if not b.num_rows:
                continue
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            if first:
                yield edge(task, "first", ids[0], texts[0])
                first = False
            if held:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = (ids[-1], texts[-1])
            if len(ids) > 1:
                done = _rows(ids[:-1], texts[:-1], texts[1:])
                n = done.num_rows
                yield pa.RecordBatch.from_arrays([pa.nulls(n, f.type) for f in head] + done.columns, schema=pa.schema([*head, *_SCHEMA]))
        if held:
            yield edge(task, "last", *held)

    out = materialize(ordered.mapInArrow(run, "task int, kind string, text string, " + RESULT), "prints")
    # two rows for each task: the last document of one meets the first of the next
    around = Window.partitionBy(F.lit(0)).orderBy("task")
    firsts = out.where("kind = 'first'").select("task", F.col("text").alias("first_text"))
    lasts = out.where("kind = 'last'").select("task", "doc_id", "text")
    ends = lasts.join(firsts, "task").withColumn("after", F.coalesce(F.lead("first_text").over(around), F.first("first_text").over(around)))

    def finish(batches):
        for b in batches:
            if b.num_rows:
                yield _rows(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())

    done = out.where("kind is null").drop("task", "kind", "text").union(ends.select("doc_id", "text", "after").mapInArrow(finish, RESULT))
    # written as bytes, shown in hexadecimal
    return done.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
