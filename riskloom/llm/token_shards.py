"""Token ids in one wavelet matrix per shard.

A shard file holds the ids of consecutive documents as bit-planes, the highest
bit first. Each plane keeps its bits packed, and the number of ones before every
block of 512 bits, so that rank and select are a short count away: any token can
be read, and any id counted or found, from the memory-mapped file without
unpacking it.

Layout, little-endian: the magic, a fixed header (_HEADER), document ids (int64,
with a null flag each), document bounds (int64, one more than documents), then
for each plane the packed bits and the block counts (uint32), each padded to
eight bytes. The number of zeros of each plane follows the header.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm import vectext as vt
from riskloom.llm.common import local_path, materialize, partitions, scratch

MAGIC = b"RLWMTX01"
_HEADER = struct.Struct("<QQQQ")  # documents, tokens, planes, end id
BLOCK = 512
#: tokens after which a task begins another shard
SHARD_TOKENS = 2_000_000
MANIFEST = "task int, seq int, path string, docs long, tokens long"
#: entries in each of the two generations of a worker's store, and bytes of text encoded at once
KEPT, SLICE = 800_000, 4 << 20
#: parts of words in one call of the library
PARTS_AT_ONCE = 500

# Words of these bytes fall into parts that are encoded apart: a run of letters, a digit, a run of other signs. They are
# ASCII without apostrophes (contractions) and < (special tokens), and the letters of Latin-1: no combining marks.
_OTHER, _DIGIT, _LETTER, _HARD = range(4)
_KIND = np.full(256, _HARD, np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[[0x27, 0x3C]] = _HARD
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x20] = _KIND[0x09:0x0E] = _OTHER
_LEAD, _NO_LETTERS = 0xC3, (0x97, 0xB7)


def _kinds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of every byte, and the bytes with capitals made small where they are no hard ones."""
    kind, text = _KIND[raw], raw.copy()
    text[(raw >= 0x41) & (raw <= 0x5A)] |= 0x20
    lead = np.flatnonzero(raw[:-1] == _LEAD)
    tail = raw[lead + 1]
    lead = lead[(tail != _NO_LETTERS[0]) & (tail != _NO_LETTERS[1])]
    kind[lead] = kind[lead + 1] = _LETTER
    tail = text[lead + 1]
    text[lead + 1] = np.where((tail >= 0x80) & (tail <= 0x9E), tail + 0x20, tail)
    return kind, text


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of spans, one after another."""
    stop = np.cumsum(sizes)
    return np.repeat(starts - (stop - sizes), sizes) + np.arange(stop[-1] if len(stop) else 0)


def _alike(text: np.ndarray, begin: np.ndarray, stop: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span has the bytes of the span that ``other`` names."""
    size = stop - begin
    eight = vt.heads(text)[1]
    head = eight[begin] & vt.KEEP[np.minimum(size, 8)]
    if (size != size[other]).any() or (head != head[other]).any():
        return False
    far = np.flatnonzero(size > 8)
    if (eight[stop[far] - 8] != eight[stop[other[far]] - 8]).any():
        return False
    far = far[size[far] > 16]
    return bool((text[_places(begin[far], size[far])] == text[_places(begin[other[far]], size[far])]).all())


class _Store:
    """Ids by the bytes of a part: sorted hashes, and where bytes and ids stand."""

    def __init__(self, dtype):
        self.keys, self.spans = np.zeros(0, vt.U64), np.zeros((4, 0), np.int32)
        self.text, self.ids = np.zeros(0, np.uint8), np.zeros(0, dtype)

    def find(self, keys: np.ndarray, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Entries of sorted keys, -1 where there is none whose bytes are those of the span."""
        if not len(self.keys) or not len(keys):
            return np.full(len(keys), -1, np.int64)
        p = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero((self.keys[p] == keys) & (self.spans[1, p] == sizes))
        same = text[_places(starts[hit], sizes[hit])] == self.text[_places(self.spans[0, p[hit]], sizes[hit])]
        out = np.full(len(keys), -1, np.int64)
        if len(hit):
            hit = hit[np.logical_and.reduceat(same, np.cumsum(sizes[hit]) - sizes[hit])]
        out[hit] = p[hit]
        return out

    def add(self, keys: np.ndarray, text: np.ndarray, sizes: np.ndarray, ids: np.ndarray, many: np.ndarray) -> None:
        """Entries with their bytes and ids, one after another; keys that are there already stay as they are."""
        spans = np.stack((len(self.text) + np.cumsum(sizes) - sizes, sizes, len(self.ids) + np.cumsum(many) - many, many)).astype(np.int32)
        keys, spans = np.concatenate((self.keys, keys)), np.concatenate((self.spans, spans), 1)
        order = np.argsort(keys, kind="stable")
        new = np.r_[True, keys[order][1:] != keys[order][:-1]]
        self.keys, self.spans = keys[order][new], spans[:, order[new]]
        self.text, self.ids = np.concatenate((self.text, text)), np.concatenate((self.ids, ids))


class WordEncoder:
    """The ids of a tokenizers file, without special tokens, for pretokenizers that drop white space.

    White space separates words there, so a text's ids are those of its words one after another, and a word's are those
    of its parts. The library encodes each part that the store lacks; words that may not be cut are a part of their own.
    The store compares bytes, so a hash shared by two parts costs a call and no id.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.t = Tokenizer.from_str(model)
        self.dtype = np.dtype("<u2") if self.t.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.now, self.old = _Store(self.dtype), _Store(self.dtype)
        suffix = json.loads(model)["model"].get("end_of_word_suffix")
        self.is_end = None
        if suffix:  # where every part ends with a marked token, many parts go through the library as one text
            self.is_end = np.zeros(self.t.get_vocab_size(), bool)
            self.is_end[[i for w, i in self.t.get_vocab().items() if w.endswith(suffix)]] = True
        ids = lambda *texts: [i for x in texts for i in self.t.encode(x, add_special_tokens=False).ids]
        # cutting is safe only for these: no pretoken holds white space, and parts are what _KIND says
        self.cut = ids("a b") == ids("a", "b")
        self.parts = ids("AÀb12.,Ðx;ß 7é") == ids("aàb", "1", "2", ".,", "ðx", ";", "ß", "7", "é")
        # parts are small letters and cut already: the same model without its own rules for that is faster
        plain = json.loads(model) | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]}}
        probe = "the àß 1 ., zzyx ðé --- q"
        self.of_parts = self.t
        if self.parts and (lean := Tokenizer.from_str(json.dumps(plain))).encode(probe, add_special_tokens=False).ids == ids(probe):
            self.of_parts = lean

    def _each(self, chunks: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.t.encode_batch_fast(chunks, add_special_tokens=False)]

    def _block(self, block: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts, and how many each has."""
        if self.is_end is not None:
            ids = np.array(self.of_parts.encode(" ".join(block), add_special_tokens=False).ids, self.dtype)
            ends = np.flatnonzero(self.is_end[ids]) + 1 if len(ids) else ids
            if len(ends) == len(block) and ends[-1] == len(ids):
                return ids, np.diff(ends, prepend=0)
        each = self._each(block)
        return np.concatenate(each), np.array([len(x) for x in each])

    def _learn(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of spans, where those of each begin, and how many it has; hard ones go through the library one by one."""
        where, many, raw = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), text.tobytes()
        at, end = starts.tolist(), (starts + sizes).tolist()
        easy, rest = np.flatnonzero(~hard), np.flatnonzero(hard)
        parts = [raw[at[x] : end[x]] for x in easy.tolist()]
        done = [self._block(b" ".join(parts[i : i + PARTS_AT_ONCE]).decode().split(" ")) for i in range(0, len(parts), PARTS_AT_ONCE)]
        if len(rest):
            each = self._each([raw[at[x] : end[x]].decode() for x in rest.tolist()])
            done.append((np.concatenate(each), np.array([len(x) for x in each])))
        if done:
            n = np.concatenate([x for _, x in done])
            for span, own in ((easy, slice(None, len(easy))), (rest, slice(len(easy), None))):
                where[span], many[span] = (np.cumsum(n) - n)[own], n[own]
        return np.concatenate([np.zeros(0, self.dtype), *[x for x, _ in done]]), where, many

    def _spans(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(text, starts, ends, hard, first part of each word) of the parts of words."""
        if not self.parts or not len(starts):
            return raw, starts, ends, np.ones(len(starts), bool), np.arange(len(starts) + 1)
        kind, text = _kinds(raw)
        sums = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(kind == _HARD, out=sums[1:])
        whole = sums[ends] > sums[starts]  # words with a hard byte
        first = np.zeros(len(raw) + 1, bool)
        first[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        first[:-1] &= ~vt.SPACE[raw]
        at = _places(starts[whole], (ends - starts)[whole])
        first[at] = False
        text[at] = raw[at]
        first[starts] = True
        begin = np.flatnonzero(first[:-1])
        word = np.searchsorted(starts, begin, "right") - 1
        end = np.minimum(np.r_[begin[1:], len(raw)], ends[word])
        return text, begin, end, whole[word], np.searchsorted(begin, np.r_[starts, len(raw)])

    def rows(self, column, end: int):
        """(first row, end row, ids, ids of each row) of slices of a string column; every row ends with ``end``."""
        raw, bounds = vt.utf8(column)
        for i, j in vt.slices(bounds, SLICE):
            part, at = raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            if not self.cut:
                ids = [np.array([*self.t.encode(bytes(part[at[r] : at[r + 1]]).decode(), add_special_tokens=False).ids, end], self.dtype) for r in range(j - i)]
                yield i, j, np.concatenate(ids), np.array([len(x) for x in ids])
                continue
            starts, ends, rows = vt.words(part, at)
            text, begin, stop, hard, first = self._spans(part, starts, ends)
            u, one, inv = np.unique(vt.span_hashes(text, begin, stop), return_index=True, return_inverse=True)
            if not _alike(text, begin, stop, one[inv]):  # two parts share a hash
                ids = [np.r_[t, np.array([end], self.dtype)] for t in self._each([bytes(part[at[r] : at[r + 1]]).decode() for r in range(j - i)])]
                yield i, j, np.concatenate(ids), np.array([len(x) for x in ids])
                continue
            begin_u, size_u = begin[one], stop[one] - begin[one]
            now = self.now.find(u, text, begin_u, size_u)
            lack = np.flatnonzero(now < 0)
            old = self.old.find(u[lack], text, begin_u[lack], size_u[lack])
            new = lack[old < 0]
            fresh, begin_new, many = self._learn(text, begin_u[new], size_u[new], hard[one[new]])
            # all ids in one array: those of both generations, the new ones, and the end
            flat = np.concatenate((self.now.ids, self.old.ids, fresh, np.array([end], self.dtype)))
            where, size = np.zeros(len(u) + 1, np.int64), np.ones(len(u) + 1, np.int64)
            for to, store, entry, base in ((now >= 0, self.now, now[now >= 0], 0), (lack[old >= 0], self.old, old[old >= 0], len(self.now.ids))):
                where[:-1][to], size[:-1][to] = store.spans[2, entry] + base, store.spans[3, entry]
            where[new], size[new] = len(flat) - 1 - len(fresh) + begin_new, many
            where[-1] = len(flat) - 1
            n = first[rows[1:]] - first[rows[:-1]] + 1
            entry = np.full(int(n.sum()), len(u))
            last = np.zeros(len(entry), bool)
            last[np.cumsum(n) - 1] = True
            entry[~last] = inv
            each = size[entry]
            ids, per = flat[_places(where[entry], each)], np.add.reduceat(each, np.cumsum(n) - n)
            yield i, j, ids, per
            self.now.add(u[lack], text[_places(begin_u[lack], size_u[lack])], size_u[lack], flat[_places(where[lack], size[lack])], size[lack])
            if len(self.now.keys) >= KEPT:
                self.now, self.old = _Store(self.dtype), self.now

    def __call__(self, text: str | None) -> bytes:
        """The ids of one text as packed unsigned integers."""
        *_, ids, _n = next(self.rows(pa.array([text], pa.string()), 0))
        return ids[:-1].tobytes()


def _pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def build(ids: np.ndarray, planes: int) -> tuple[list[int], list[bytes]]:
    """Zeros of each plane, and the planes' packed bits and block counts."""
    zeros, parts = [], []
    cur = ids
    for level in range(planes - 1, -1, -1):
        bit = (cur & cur.dtype.type(1 << level)) != 0
        packed = np.packbits(bit, bitorder="little")
        ones = np.zeros(len(bit) // BLOCK + 2, np.uint32)
        per = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK // 8), dtype=np.uint32) if len(packed) else np.zeros(0, np.uint32)
        np.cumsum(per, out=ones[1 : len(per) + 1])
        ones[len(per) + 1 :] = ones[len(per)]
        zero, one = np.flatnonzero(~bit), np.flatnonzero(bit)  # taking by place is faster than by mask
        zeros.append(len(zero))
        parts += [_pad(packed.tobytes()), _pad(ones.tobytes())]
        cur = np.concatenate((cur.take(zero), cur.take(one)))
    return zeros, parts


def shard_bytes(doc_ids: list, lengths: list[int], ids: np.ndarray, end: int) -> bytes:
    """A shard file of documents in order; ``ids`` has all their ids, ``lengths`` how many each has."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    zeros, parts = build(ids, planes)
    bounds = np.r_[0, np.cumsum(lengths)].astype("<i8")
    known = np.array([x is not None for x in doc_ids], np.uint8)
    head = MAGIC + _HEADER.pack(len(doc_ids), len(ids), planes, end) + np.array(zeros, "<u8").tobytes()
    return b"".join([head, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), _pad(known.tobytes()), bounds.tobytes(), *parts])


class Shard:
    """Reads a shard from bytes or a memory-mapped buffer."""

    def __init__(self, raw):
        self.raw = memoryview(raw)
        if self.raw[:8] != MAGIC:
            raise ValueError("not a token shard")
        docs, self.tokens, self.planes, self.end = _HEADER.unpack(self.raw[8 : 8 + _HEADER.size])
        at = 8 + _HEADER.size

        def take(dtype, n):
            nonlocal at
            x = np.frombuffer(self.raw, dtype, n, at)
            at += -(-x.nbytes // 8) * 8
            return x

        self.zeros = take("<u8", self.planes).astype(np.int64)
        ids, known = take("<i8", docs), take(np.uint8, docs)
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]
        self.bounds = take("<i8", docs + 1)
        self.bits, self.ones = [], []
        for _ in range(self.planes):
            self.bits.append(take(np.uint8, -(-self.tokens // 8)))
            self.ones.append(take("<u4", self.tokens // BLOCK + 2))

    def _rank1(self, plane: int, i: int) -> int:
        b, whole = i // BLOCK, i // 8
        n = int(self.ones[plane][b]) + int(np.bitwise_count(self.bits[plane][b * BLOCK // 8 : whole]).sum())
        return n + (int(self.bits[plane][whole]) & (1 << i % 8) - 1).bit_count() if i % 8 else n

    def _bit(self, plane: int, i: int) -> int:
        return int(self.bits[plane][i // 8]) >> i % 8 & 1

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit."""
        lo, hi = 0, self.tokens
        while lo < hi:  # the least i with more than k such bits before i + 1
            mid = (lo + hi) // 2
            ones = self._rank1(plane, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for p in range(self.planes):
            b, r = self._bit(p, i), self._rank1(p, i)
            value = value << 1 | b
            i = int(self.zeros[p]) + r if b else i - r
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.planes or token < 0:
            return 0, 0
        for p in range(self.planes):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            lo, hi = (int(self.zeros[p]) + a, int(self.zeros[p]) + b) if token >> (self.planes - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id occurs in places lo to hi - 1."""
        a, b = self._range(token, lo, self.tokens if hi is None else hi)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence."""
        a, b = self._range(token, 0, self.tokens)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for p in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - p) & 1
            i = self._select(p, bit, i - int(self.zeros[p]) if bit else i)
        return i

    def all(self) -> np.ndarray:
        """All ids: planes are undone from the last to the first."""
        cur = np.zeros(self.tokens, np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            bit = np.unpackbits(self.bits[p], count=self.tokens, bitorder="little").astype(bool)
            before = np.empty_like(cur)
            before[np.flatnonzero(~bit)] = cur[: self.zeros[p]]
            before[np.flatnonzero(bit)] = cur[self.zeros[p] :] | cur.dtype.type(1 << (self.planes - 1 - p))
            cur = before
        return cur


_ENCODERS: dict[int, WordEncoder] = {}


def write(docs: DataFrame, path: str, folder: str, end: int = 1) -> DataFrame:
    """Write the ids of every whole text, each with ``end`` appended, in ascending doc_id order (null first).

    Reads doc_id and text. Null texts are empty and have the end id only; rows that repeat a doc_id stand side by side,
    by text. A table without rows writes nothing. Returns the manifest, one row per shard; shards in (task, seq) order
    are the whole sequence. Attempts write files of their own names, and the manifest has those that ended.
    """
    with open(path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, of fixed size

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = local_path(folder)
        fs.create_dir(base, recursive=True)
        if (key := hash(model.value)) not in _ENCODERS:
            _ENCODERS[key] = WordEncoder(model.value)
        enc = _ENCODERS[key]
        doc_ids, lengths, parts, n, seq, done = [], [], [], 0, 0, []

        def flush():
            at = f"{base}/shard-{task.partitionId():05d}-{seq:04d}-{task.taskAttemptId()}.wm"
            with fs.open_output_stream(at) as out:
                out.write(shard_bytes(doc_ids, lengths, np.concatenate(parts), end))
            done.append((task.partitionId(), seq, at, len(doc_ids), n))

        for b in batches:
            ids_of = b.column(0).to_pylist()
            for i, j, ids, each in enc.rows(b.column(1), end):
                doc_ids += ids_of[i:j]
                lengths += each.tolist()
                parts.append(ids)
                n += len(ids)
                if n >= SHARD_TOKENS:
                    flush()
                    doc_ids, lengths, parts, n, seq = [], [], [], 0, seq + 1
        if doc_ids:
            flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["task", "seq", "path", "docs", "tokens"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(run, MANIFEST), "shards")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a manifest.

    start counts the ids of all documents before. Only the manifest, a row for each shard, meets in a window.
    """
    before = Window.partitionBy(F.lit(0)).orderBy("task", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def run(batches):
        from pyarrow import fs as afs

        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, at = (afs.LocalFileSystem(), path) if path.startswith("/") else local_path(path)
                with fs.open_input_file(at) as f:
                    shard = Shard(f.read())
                ids, cut = shard.all().astype("<u4"), shard.bounds.tolist()
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(shard.bounds[:-1] + start), pa.array(np.diff(shard.bounds)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("path", "start").repartition(partitions(manifest.sparkSession), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digests(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Encode, write and read back ``docs``: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id only; null doc_ids come first; rows that repeat a doc_id stand side by side by
    text. Texts are encoded whole. An empty table gives an empty result; other columns are not read.
    """
    return read(write(docs, path, folder or scratch(docs.sparkSession, "tokens")))
