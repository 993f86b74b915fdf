"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

Merging takes, again and again, the adjacent pair whose joint piece scores best.
Its result is the only cover of the text in which every piece and every two
adjacent pieces are what merging makes of their own text. So a cover is found
left to right: take the longest piece that an Aho-Corasick automaton reports at
the place; if re-merging it with the piece before gives something else, try
shorter ones; if none is left, mark the place in a bitfield as failed and step
back. Verdicts on pairs are kept.

Where the vocabulary has no piece that spans two given characters, no merge can
cross them; texts are cut there, and what the encoder made of a chunk is kept in
a bounded store, as corpora repeat their words.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import small_batches

SPACE = "▁"
#: bytes, about, of each of the two generations of the store (what was used since the last turn survives the next), and of an entry beside its texts
KEPT_BYTES, ENTRY = 100 << 20, 200
#: longer chunks are not kept
KEPT_CHUNK = 100
#: rows whose ids are held at once
ROWS = 256


class PieceCodec:
    """Encoder and decoder of one merge-type model file (identity normaliser, byte fallback)."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        if any(x.type in (pb.ModelProto.SentencePiece.USER_DEFINED, pb.ModelProto.SentencePiece.UNUSED) for x in m.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        spec = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or m.trainer_spec.treat_whitespace_as_suffix or not m.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with byte fallback and no normalisation are supported")
        self.dummy = spec.add_dummy_prefix
        self.piece = [p.piece for p in m.pieces]
        self.kind = [p.type for p in m.pieces]
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (1, 4, 5)}
        self.score = {p.piece: p.score for p in m.pieces if p.type in (1, 4, 5)}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.end = next(i for i, p in enumerate(m.pieces) if p.piece == "</s>")
        self.joined = {i for i, p in enumerate(m.pieces) if p.type in (1, 4, 5)}
        self.pair_ok: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        spans = set()
        for p in self.id:
            spans.update(zip(p, p[1:], strict=False))
            if len(p) == 1 or self._merge(p) == [p]:  # others never come out of merging
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in self.automaton), p[0]) for p in self.automaton.keys() if len(p) > 1}
        letters = {c for p in self.id for c in p if c.isalpha()}
        cut_spaces = not any(b == SPACE and a != SPACE for a, b in spans)
        apart = not any(a.isalpha() != b.isalpha() and SPACE not in (a, b) for a, b in spans)
        inside = "".join(map(re.escape, sorted(letters)))
        self.chunk = re.compile(f"{SPACE}*[{inside}]+|{SPACE}*[^{inside}{SPACE}]+|{SPACE}+" if cut_spaces and apart else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if cut_spaces else r"(?s:.+)")
        self.longest = max(map(len, self.automaton.keys()), default=1)
        self.now: dict[str, str] = {}  # chunk: its ids in decimal
        self.old: dict[str, str] = {}
        self.room = KEPT_BYTES
        self.differs: dict[str, str] = {}  # chunks of the present text that don't decode to themselves; they are not kept

    def _merge(self, text: str) -> list[str]:
        """Plain merging, for short texts: best score first, leftmost among equals."""
        s = list(text)
        while True:
            best, at = None, -1
            for i in range(len(s) - 1):
                x = self.score.get(s[i] + s[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def _fits(self, a: str, b: str) -> bool:
        if (ok := self.pair_ok.get((a, b))) is None:
            if len(self.pair_ok) > 400_000:
                self.pair_ok.clear()
            ok = self.pair_ok[a, b] = self._merge(a + b) == [a, b]
        return ok

    def _longest(self, text: str, pos: int) -> str:
        window = text[pos : pos + self.longest]
        for end, p in self.automaton.iter_long(window):
            if end + 1 == len(p):
                return p
            break
        return window[0]

    def cover(self, text: str) -> list[str]:
        """The pieces of a text; a character that no piece has stands alone."""
        n = len(text)
        out = [p for _, p in self.automaton.iter_long(text)]
        if sum(map(len, out)) == n and all(map(self._fits, out, out[1:])):
            return out  # longest matches all the way need no second thought
        failed, out, pos, p = bytearray(n // 8 + 1), [], 0, self._longest(text, 0)
        while True:
            last = out[-1] if out else None
            while p and (failed[(end := pos + len(p)) >> 3] >> (end & 7) & 1 or last is not None and not self._fits(last, p)):
                p = self.shorter.get(p)
            if p:
                out.append(p)
                pos += len(p)
                if pos == n:
                    return out
                p = self._longest(text, pos)
            else:  # nothing fits here: step back and try a shorter piece in the last one's stead
                failed[pos >> 3] |= 1 << (pos & 7)
                p = out.pop()
                pos -= len(p)

    def _ids(self, pieces: list[str]) -> list[int]:
        ids = []
        for p in pieces:
            i = self.id.get(p)
            ids += [i] if i is not None else [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
        return ids

    def _chunk(self, chunk: str) -> str:
        if (v := self.now.get(chunk)) is not None:
            return v
        if (v := self.old.get(chunk)) is None:
            ids = self._ids(self.cover(chunk))
            v = " ".join(map(str, ids))
            if (text := self._text(ids)) != chunk:
                self.differs[chunk] = text
                return v
        if len(chunk) <= KEPT_CHUNK:
            self.room -= len(chunk) + len(v) + ENTRY
            if self.room < 0:
                self.now, self.old, self.room = {}, self.now, KEPT_BYTES
            self.now[chunk] = v
        return v

    def _text(self, ids: list[int]) -> str:
        """Pieces put together, runs of byte pieces read as UTF-8; control pieces are nothing."""
        if self.joined.issuperset(ids):
            return "".join(map(self.piece.__getitem__, ids))
        out, held = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(_utf8(held))
                held = bytearray()
            if self.kind[i] == 2:
                out.append(" ⁇ ")
            elif self.kind[i] != 3:
                out.append(self.piece[i])
        if held:
            out.append(_utf8(held))
        return "".join(out)

    def _whole(self, text: str | None) -> tuple[list[str], list[str]]:
        """The chunks of a text and their ids."""
        if not text:
            return [], []
        self.differs.clear()
        text = text.replace(" ", SPACE)
        found = self.chunk.findall(SPACE + text if self.dummy else text)
        ids = list(map(self.now.get, found))
        if None in ids:
            ids = [x or self._chunk(c) for x, c in zip(ids, found, strict=True)]
        return found, ids

    def _plain(self, text: str) -> str:
        if self.dummy and text[:1] == SPACE:
            text = text[1:]
        return text.replace(SPACE, " ")

    def encode(self, text: str | None) -> list[int]:
        """The ids, with the end id. A null text is an empty one."""
        return [*map(int, " ".join(self._whole(text)[1]).split()), self.end]

    def decode(self, ids: list[int]) -> str:
        return self._plain(self._text(ids))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal, SHA-256 of what they decode to."""
        found, ids = self._whole(text)
        joined = " ".join([*ids, str(self.end)])
        texts = [self.differs.get(c, c) for c in found] if self.differs else found
        back = self._plain("".join(texts))
        return joined.count(" ") + 1, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()


def _utf8(b: bytearray) -> str:
    """Each byte that is not part of a character becomes U+FFFD."""
    try:
        return b.decode()
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(b):
        for n in (1, 2, 3, 4):
            try:
                out.append(b[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_CODECS: dict[int, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One codec for each model and worker process, so that its stores outlive a task."""
    if (key := hash(model)) not in _CODECS:
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def _model(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        small_batches(docs.sparkSession)
        return docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, of fixed size


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (with the end id) of every row; null and empty texts have the end id only.

    Other columns are ignored; rows that repeat are encoded each; texts are never cut; an empty table gives an empty result.
    """
    return encode_checked(docs, path).select("doc_id", "ids")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows of (doc_id, ids); null ids decode to an empty text."""
    model = _model(tokens, path)

    def run(batches):
        c = codec(model.value)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text": pa.array([c.decode(i.as_py() or []) for i in b.column(1)], pa.string())})

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, encoded and decoded in one pass without keeping ids."""
    model = _model(docs, path)

    def run(batches):
        c = codec(model.value)
        for b in batches:
            done = [c.digest(t.as_py()) for t in b.column(1)]
            n, ids, text = zip(*done, strict=True) if done else ((), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(text, pa.string())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of every row: whether decoding its ids gives its text (a null one: an empty) back."""
    model = _model(docs, path)

    def run(batches):
        c = codec(model.value)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part, ids, same = b.slice(i, ROWS), [], []
                for t in part.column(1):
                    own = c.encode(text := t.as_py() or "")
                    same.append(c.decode(own) == text)
                    ids.append(np.array(own, np.int32))
                bounds = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n_tokens": pa.array(np.diff(bounds).astype(np.int64)), "ids": lists, "round_trip": pa.array(same, pa.bool_())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")
