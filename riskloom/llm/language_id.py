"""Language ID by a string kernel with Nyström landmarks and one-versus-rest kernel ridge regression.

The kernel counts the character n-grams (1 to 3) that two texts both have, over
the root of the product of how many each has: a blended-spectrum presence
kernel. All that is no letter is one character. Landmarks are training texts; the
ridge regression is solved in the space they span. As the kernel is linear in the
presence vector, the landmarks' part of a score folds into one weight per n-gram
and language, and a batch of texts is scored by one product of its presence matrix
with the weights.

An n-gram's number packs its code points. A text of common letters only marks its
n-grams in a table of all of them; one with any other letter sorts their numbers.
Both give the same n-grams.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import materialize, small_batches

#: bounds of the training sample: texts for each language, and landmarks among them (altogether, or one a language if those are more)
TRAIN_PER_LANG, LANDMARKS = 400, 400
#: languages that are learned, and training texts of all of them
MAX_LANGS, TRAIN = 1000, 8000
RIDGE = 1e-2
#: a size of 64 characters for the table of n-grams: no letter, and the letters that are most common in the sample
COMMON = 63
CLASSES = COMMON + 1
GRAMS = CLASSES + CLASSES**2 + CLASSES**3
ROWS = 64
UNDETERMINED = "und"
#: bits of a code point in an n-gram's number
POINT = 21
LEAST = np.int64(-(2**63))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Alphabet:
    """The n-grams of texts; ``common`` are code points of letters."""

    def __init__(self, common: list[int]):
        self.common = np.array(sorted(common), np.int64)
        self.code = np.array([255 * chr(p).isalpha() for p in range(0x110000)], np.uint8)
        self.code[self.common] = np.arange(1, len(common) + 1)
        self.mark = np.zeros(GRAMS, np.uint8)

    def numbers(self, places: np.ndarray) -> np.ndarray:
        """The n-gram numbers of places in the table."""
        points = np.zeros(CLASSES, np.int64)
        points[1 : len(self.common) + 1] = self.common
        two, three = places - CLASSES, places - CLASSES - CLASSES**2
        of_two = (points[two // CLASSES % CLASSES] << POINT) + points[two % CLASSES] + (1 << 62)
        of_three = (points[three // CLASSES**2 % CLASSES] << 2 * POINT) + (points[three // CLASSES % CLASSES] << POINT) + points[three % CLASSES] + LEAST
        return np.where(three >= 0, of_three, np.where(two >= 0, of_two, points[places % CLASSES]))

    def places(self, text: str) -> tuple[np.ndarray, bool]:
        """The distinct n-grams of a whole text, ascending: places in the table, or numbers if a letter is not common."""
        cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        c = self.code[cp]
        if (c == 255).any():
            x = np.where(c > 0, cp, 0).astype(np.int64)
            two = (x[:-1] << POINT) + x[1:]
            return np.unique(np.concatenate((x, two + (1 << 62), (two[:-1] << POINT) + x[2:] + LEAST))), False
        c, mark = c.astype(np.int32), self.mark
        mark[c] = 1
        mark[c[:-1] * CLASSES + c[1:] + CLASSES] = 1
        mark[(c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:] + CLASSES + CLASSES**2] = 1
        out = np.flatnonzero(mark)
        mark[out] = 0
        return out, True

    def grams(self, text: str) -> np.ndarray:
        """The n-gram numbers of a whole text, ascending."""
        out, placed = self.places(text)
        return np.sort(self.numbers(out)) if placed else out


class Vocabulary:
    """Sorted n-gram numbers, found by number or by place in the table."""

    def __init__(self, alphabet: Alphabet, numbers: np.ndarray):
        self.alphabet, self.known = alphabet, numbers
        at, ok = self._search(alphabet.numbers(np.arange(GRAMS)))
        self.table = np.where(ok, at, -1).astype(np.int32)

    def _search(self, numbers: np.ndarray):
        at = np.minimum(np.searchsorted(self.known, numbers), max(len(self.known) - 1, 0))
        return at, self.known[at] == numbers

    def vector(self, text: str, out: np.ndarray) -> None:
        """Set the presence vector of a text, of length one over all its n-grams."""
        found, placed = self.alphabet.places(text)
        if placed:
            at = self.table[found]
            at = at[at >= 0]
        else:
            at, ok = self._search(found)
            at = at[ok]
        out[at] = 1 / np.sqrt(len(found))


class Model:
    """Folded weights; ``langs`` are sorted."""

    def __init__(self, langs: list[str], common: list[int], numbers: np.ndarray, weights: np.ndarray):
        self.langs, self.common, self.numbers, self.weights = langs, common, numbers, weights

    def predict(self, texts: list[str | None], words: Vocabulary | None = None) -> tuple[list[str], list[float]]:
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return names, scores
        words = words or Vocabulary(Alphabet(self.common), self.numbers)
        todo = [i for i, t in enumerate(texts) if has_letter(t)]
        for k in range(0, len(todo), ROWS):
            rows = todo[k : k + ROWS]
            x = np.zeros((len(rows), len(self.numbers)), np.float32)
            for r, i in enumerate(rows):
                words.vector(texts[i], x[r])
            y = x @ self.weights
            best = y.argmax(1)
            for r, i in enumerate(rows):
                top = float(y[r, best[r]])
                rest = float(np.delete(y[r], best[r]).max()) if len(self.langs) > 1 else -1.0
                names[i] = self.langs[best[r]]
                # the margin over the next language: 1 if they stand at +1 and -1, 0.5 if they are even
                scores[i] = min(1.0, max(0.0, 0.5 + (top - rest) / 4))
        return names, scores


def _sample(rows: DataFrame) -> DataFrame:
    """(text, lang, place): at most TRAIN_PER_LANG different texts a language, by a hash of the text; copies count once.

    Of more than MAX_LANGS languages, those with the most different texts are learned (ties by name); many languages share
    TRAIN places. Only texts under a bound of the hash that leaves enough of each language are ranked.
    """
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text", F.lit(1)).alias("h"))
    texts = known.select("lang", "h").distinct()
    many = materialize(texts.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS), "languages")
    places = min(TRAIN_PER_LANG, TRAIN // max(1, many.count()))
    share = F.least(F.lit(1.0), F.lit(2.0 * places + 1000) / F.col("n"))
    bound = F.when(share < 1, (share * 2.0**64 - 2.0**63).cast("long")).otherwise(F.lit(2**63 - 1))
    order = Window.partitionBy("lang").orderBy("h")
    keys = texts.join(F.broadcast(many.select("lang", bound.alias("bound"))), "lang").where("h <= bound").withColumn("place", F.row_number().over(order)).where(F.col("place") <= places)
    keys = materialize(keys.select("lang", "h", "place"), "picked")
    got = known.join(F.broadcast(keys), ["lang", "h"])
    return materialize(got.groupBy("lang", "place").agg(F.min("text").alias("text")).select("text", "lang", "place"), "sample")


def fit(rows: DataFrame) -> Model:
    """Learn from (doc_id, text, lang) rows with a lang and a letter; the sample is bounded, see ``_sample``.

    Only its texts' letter counts and n-gram numbers come to the driver.
    """
    sample = _sample(rows)

    def letters(batches):
        n = Counter()
        for b in batches:
            for t in b.column(0):
                n.update(c for c in t.as_py().lower() if c.isalpha())
        yield pa.RecordBatch.from_pydict({"c": pa.array([ord(c) for c in n], pa.int64()), "n": pa.array(list(n.values()), pa.int64())})

    top = sample.mapInArrow(letters, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(COMMON)
    common = [r.c for r in top.collect()]

    def presence(batches):
        alphabet = Alphabet(common)
        for b in batches:
            keep = [i for i, t in enumerate(b.column(0)) if has_letter(t.as_py())]
            g = [alphabet.grams(b.column(0)[i].as_py()).tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(keep, pa.int64())), b.column(2).take(pa.array(keep, pa.int64())), pa.array(g, pa.binary())], names=["lang", "place", "grams"])

    got = sample.mapInArrow(presence, "lang string, place int, grams binary").collect()
    got.sort(key=lambda r: (r.place, r.lang, r.grams))
    return solve([r.lang for r in got], [np.frombuffer(r.grams, np.int64) for r in got], common)


def solve(names: list[str], sets: list[np.ndarray], common: list[int]) -> Model:
    """The model of texts given by language and n-gram numbers; the first ones are the landmarks."""
    langs = sorted(set(names))
    if not langs:
        return Model([], common, np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    m = min(max(LANDMARKS, len(langs)), len(sets))  # by place, so languages take turns
    vocab = np.unique(np.concatenate(sets[:m]))

    def matrix(some):
        x = np.zeros((len(some), len(vocab)), np.float32)
        for i, g in enumerate(some):
            at = np.minimum(np.searchsorted(vocab, g), len(vocab) - 1)
            x[i, at[vocab[at] == g]] = 1 / np.sqrt(len(g))
        return x

    land = matrix(sets[:m])
    k_mm = (land @ land.T).astype(np.float64)
    value, vector = np.linalg.eigh(k_mm + 1e-6 * np.eye(m))
    root = vector / np.sqrt(np.maximum(value, 1e-9))  # K_mm ** -1/2, up to a rotation
    y = np.array([[1.0 if r == c else -1.0 for c in langs] for r in names])
    gram, right = np.zeros((m, m)), np.zeros((m, len(langs)))
    for i in range(0, len(sets), ROWS):
        phi = (matrix(sets[i : i + ROWS]) @ land.T).astype(np.float64) @ root
        gram += phi.T @ phi
        right += phi.T @ y[i : i + ROWS]
    w = np.linalg.solve(gram + RIDGE * len(sets) / 100 * np.eye(m), right)
    return Model(langs, common, vocab, (land.T @ (root @ w).astype(np.float32)).astype(np.float32))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """lang_pred and score (0 to 1) of every row's whole text, beside the columns ``keep`` (default doc_id).

    A null text, or one without a letter, is ``und`` with score 0; so is any text if the model has learned no language.
    Other columns, lang among them, are never read. Equal texts get equal answers; an empty table gives an empty result.
    """
    from pyspark.sql.types import StringType, DoubleType, StructField, StructType

    keep = keep or ["doc_id"]
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    part = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text"))
    schema = StructType([*part.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        m = held.value
        words = Vocabulary(Alphabet(m.common), m.numbers) if m.langs else None
        for b in batches:
            names, scores = m.predict(b.column(b.num_columns - 1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    return part.mapInArrow(run, schema)


def held_out(col: Column, n: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % n == remainder, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns from the rows that are not held out, predicts all.

    Null texts and those without a letter are ``und`` with score 0, as are all where no row names a language. Rows without
    a language teach nothing. A null doc_id is not held out; repeated rows teach once and are answered each. Very long
    texts are read whole. An empty table gives an empty result; other columns, of whatever name, are not read.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text"), model, ["doc_id", "held_out"])
