"""Toxicity by maximum-scoring segments of token log-odds.

A word's tokens are its beginnings of 3 to 8 bytes and itself, so that unseen
words of a known stem count. A token's log-odds of standing in a toxic rather
than a clean labelled text are taken under a Dirichlet prior centred on the
token that it specialises. Tokens that share a beginning with one whose log-odds
exceed their standard error FIRM times are known. A word scores the log-odds of
its most special known token, and DRIFT less. One linear scan
(Ruzzo and Tompa) finds all maximal segments. Under an extreme-value law, a
segment of score s has an expectation of K * n * exp(-lambda * s) in a clean text
of n words; lambda and K come from clean labelled texts. What the significant
segments' scores exceed adds up, and a logistic curve turns it into a
probability. Both are fitted on texts whose own fold gave no token its odds.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm import vectext as vt
from riskloom.llm.common import bucket_of, hash_bound, materialize

U64 = np.uint64
#: bounds of the training sample: labelled texts of each class
TRAIN_PER_CLASS = 8000
#: the test fold's remainder modulo 4, and the folds that labels are learned from
HELD, FOLDS = 2, (0, 1, 3)
PRIOR, FIRM, LEAST_TEXTS, DRIFT = 5.0, 4.0, 4, 0.5
PREFIXES = range(3, 9)
BITS = 20  # of the table that most words end at
THRESHOLD = 0.3
#: width and number of the bins of positive scores that go to the driver
BIN, BINS = 0.25, 64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _words(raw: np.ndarray, bounds: np.ndarray):
    """Runs of letters and digits: starts, ends, row bounds."""
    n = len(raw)
    inside = _LETTER[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def _tokens(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(which words, hash, hash of the token that it specialises, hash of its shortest beginning), from beginnings to whole words."""
    _, eight = vt.heads(raw)
    eight, size = eight[starts], ends - starts
    above = np.zeros(len(starts), U64)
    root = vt.mix(vt.span_hashes(raw, starts, ends) + U64(1))  # a word without a beginning is its own
    whole = root.copy()
    for k in PREFIXES:
        at = np.flatnonzero(size >= k)
        h = vt.beginnings(eight[at], k)
        if k == PREFIXES[0]:
            root[at] = h
        yield at, h, above[at], root[at]
        above[at] = h
    yield np.arange(len(starts)), whole, above, root


def _texts(column):
    """Slices of (row numbers, bytes, row bounds) of the lower-cased texts."""
    raw, bounds = vt.utf8(pc.utf8_lower(column.fill_null("") if column.null_count else column))
    for i, j in vt.slices(bounds):
        yield i, j, raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, (first, end, score), of a sequence given by its positive (place, score) entries.

    Every place between them scores ``-drift``. Ruzzo and Tompa's scan, linear in the number of entries.
    """
    found: list[list] = []  # first, end, sum before it, sum up to its end
    total, at = 0.0, 0
    for place, s in scores:
        total -= drift * (place - at)
        seg = [place, place + 1, total, total + s]
        total, at = total + s, place + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= seg[2]:
                j -= 1
            if j < 0 or found[j][3] >= seg[3]:
                found.append(seg)
                break
            seg = [found[j][0], seg[1], found[j][2], seg[3]]
            del found[j:]
    return [(a, b, r - lo) for a, b, lo, r in found]


class Odds:
    """Known tokens: sorted hashes and scores, and a table of the bits that they begin with."""

    def __init__(self, hashes: np.ndarray, odds: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.odds = hashes[order], odds[order]
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(self.hashes >> U64(64 - BITS)).astype(np.int64)] = True

    def of_words(self, raw, starts, ends) -> np.ndarray:
        """The score of each word: that of its most special known token, or 0."""
        best = np.zeros(len(starts))
        if len(self.hashes):
            for at, h, _, _ in _tokens(raw, starts, ends):
                hit = np.flatnonzero(self.seen[(h >> U64(64 - BITS)).astype(np.int64)])
                p = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
                ok = self.hashes[p] == h[hit]
                best[at[hit[ok]]] = self.odds[p[ok]]
        return best


class Model:
    def __init__(self, odds: Odds, rate: float, k: float, a: float, b: float):
        self.odds, self.rate, self.k, self.a, self.b = odds, rate, k, a, b

    def excess(self, scores: list[float], n: int) -> float:
        """What significant segments exceed their expectation by, in nats."""
        return sum(max(0.0, self.rate * s - math.log(self.k * n)) for s in scores)

    def probability(self, excess: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.a * math.log1p(excess) + self.b))))


def _segments(odds: Odds, column):
    """(row, words, [(first word, end word, score)]) of every row; rows come in order."""
    for i, j, raw, bounds in _texts(column):
        starts, ends, rows = _words(raw, bounds) if len(raw) else (np.zeros(0, int), np.zeros(0, int), np.zeros(j - i + 1, int))
        best = odds.of_words(raw, starts, ends) - DRIFT
        hits: dict[int, list] = {}
        places = np.flatnonzero(best > 0)
        for w, r in zip(places.tolist(), (np.searchsorted(rows, places, "right") - 1).tolist(), strict=True):
            hits.setdefault(r, []).append((w - int(rows[r]), float(best[w])))
        for r in range(j - i):
            yield i + r, int(rows[r + 1] - rows[r]), maximal_segments(hits.get(r, ()), DRIFT), hits.get(r, ())


def _log_odds(tox: np.ndarray, tot: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds over those of ``share``, and in units of their standard error."""
    a, b = tox + PRIOR * share, tot - tox + PRIOR * (1 - share)
    lo = np.log(a / b) - math.log(share / (1 - share))
    return lo, lo / np.sqrt(1 / a + 1 / b)


def _nested(h, above, tox, tot, share: float) -> np.ndarray:
    """Log-odds of tokens under a Dirichlet prior centred on the token that each specialises, if known, else on ``share``."""
    place = {x: i for i, x in enumerate(h.tolist())}
    up = [place.get(x) for x in above.tolist()]
    p: list[float | None] = [None] * len(h)

    def of(i):
        chain = []
        while i is not None and p[i] is None:
            chain.append(i)
            i = up[i]
        for j in reversed(chain):
            p[j] = (tox[j] + PRIOR * (share if up[j] is None else p[up[j]])) / (tot[j] + PRIOR)

    for i in range(len(h)):
        of(i)
    x = np.clip(np.array(p, float), 1e-6, 1 - 1e-6)
    return np.log(x / (1 - x)) - math.log(share / (1 - share))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows of the folds FOLDS, at most TRAIN_PER_CLASS of each class, chosen by a hash of doc_id.

    Null and other labels than 0 and 1 are left out; a doc_id that is labelled twice is toxic if either label says so.
    To the driver come tokens that pass the tests (of the bounded sample) and a few numbers for each of its texts.
    """
    spark = docs.sparkSession
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("fold", bucket_of(F.col("doc_id"), 4).cast("int")).where(F.col("fold") != HELD)
    # labels of documents that are not there neither count nor take up places
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    known = materialize(known.join(there, "doc_id", "left_semi"), "labels").withColumn("h", F.xxhash64("doc_id", F.lit(2)))
    many = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    total = many.get(1, 0) / max(1, sum(many.values()))
    few = F.lit(False)
    for label, n in many.items():
        few = few | ((F.col("toxic") == label) & (F.col("h") <= hash_bound(TRAIN_PER_CLASS, n)))
    order = Window.partitionBy("toxic").orderBy("h", "doc_id")
    known = known.where(few).withColumn("place", F.row_number().over(order)).where(F.col("place") <= TRAIN_PER_CLASS).drop("place", "h")
    # at most 2 * TRAIN_PER_CLASS rows; of texts that share a doc_id, the one with the least hash
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    sample = materialize(sample.groupBy("doc_id", "toxic", "fold").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic", "fold"), "sample")

    def count(batches):
        for b in batches:
            tox, fold = b.column(1).to_numpy(), b.column(2).to_numpy()
            hashes, ups, roots, cell = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
            for i, j, raw, bounds in _texts(b.column(0)):
                if not len(raw):
                    continue
                starts, ends, rows = _words(raw, bounds)
                if not len(starts):
                    continue
                row = np.repeat(np.arange(j - i), np.diff(rows))
                at, h, up, root = map(np.concatenate, zip(*_tokens(raw, starts, ends), strict=True))
                r = row[at]
                o = np.lexsort((r, h))
                h, r, up, root = h[o], r[o], up[o], root[o]
                new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]
                hashes.append(h[new])
                ups.append(up[new])
                roots.append(root[new])
                cell.append(2 * fold[i + r[new]] + tox[i + r[new]])
            h, c = np.concatenate(hashes), np.concatenate(cell)
            u, first, inv = np.unique(h, return_index=True, return_inverse=True)
            up, root = np.concatenate(ups)[first], np.concatenate(roots)[first]
            n = np.bincount(inv * 8 + c, minlength=8 * len(u)).reshape(-1, 8) if len(u) else np.zeros((0, 8), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, up, root)] + [pa.array(n[:, k]) for k in range(8)], names=["h", "up", "root", *[f"n{k}" for k in range(8)]])

    sizes = {(r.fold, r.toxic): r.n for r in known.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    n_tox, n_all = sum(n for (_, t), n in sizes.items() if t), sum(sizes.values())
    if not n_tox or n_tox == n_all:
        return Model(Odds(np.zeros(0, U64), np.zeros(0)), 1.0, 1.0, 0.0, -30.0 if not n_tox else 30.0)
    cols = [f"n{k}" for k in range(8)]
    tokens = sample.mapInArrow(count, "h long, up long, root long, " + ", ".join(f"{c} long" for c in cols)).groupBy("h").agg(F.first("up").alias("up"), F.first("root").alias("root"), *[F.sum(c).alias(c) for c in cols])
    tox, tot = sum((F.col(f"n{2 * f + 1}") for f in FOLDS), F.lit(0)), sum((F.col(c) for c in cols), F.lit(0))
    tokens = materialize(tokens.where(tot >= LEAST_TEXTS), "tokens")
    # a test that all that the exact one lets through also pass; then all tokens with the same beginnings, toxic or not
    odd = tokens.where(tox * n_all > 1.5 * tot * n_tox).toArrow()
    counts = lambda t: np.stack([t[c].to_numpy() for c in cols], 1).astype(float)
    n = counts(odd)
    firm = _log_odds(sum(n[:, 2 * f + 1] for f in FOLDS), n.sum(1), n_tox / n_all)[1] >= FIRM
    near = sorted(set(odd["root"].to_numpy()[firm].tolist()))
    kin = tokens.join(F.broadcast(spark.createDataFrame([(x,) for x in near], "root long")), "root").toArrow()
    h, above, n = kin["h"].to_numpy().view(U64), kin["up"].to_numpy().view(U64), counts(kin)

    def odds(out: int | None) -> Odds:
        folds = [f for f in FOLDS if f != out]
        t, c = sum(n[:, 2 * f + 1] for f in folds), sum(n[:, 2 * f] + n[:, 2 * f + 1] for f in folds)
        nt, na = sum(sizes.get((f, 1), 0) for f in folds), sum(sizes.get((f, x), 0) for f in folds for x in (0, 1))
        if not nt or nt == na or not len(h):
            return Odds(np.zeros(0, U64), np.zeros(0))
        return Odds(h, _nested(h, above, t, c, nt / na))

    crossed = spark.sparkContext.broadcast({f: odds(f) for f in FOLDS})

    def look(batches):
        for b in batches:
            fold = b.column(2).to_numpy()
            out = []
            for f in FOLDS:
                rows = np.flatnonzero(fold == f)
                for r, words, segs, hits in _segments(crossed.value[f], b.column(0).take(pa.array(rows))):
                    bins = np.bincount(np.minimum((np.array([s for _, s in hits if s > 0]) / BIN).astype(int), BINS - 1), minlength=BINS) if hits else np.zeros(BINS, int)
                    out.append({"toxic": int(b.column(1)[int(rows[r])].as_py()), "words": words, "scores": [s for *_, s in segs], "bins": bins.tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("toxic", pa.int32()), ("words", pa.int64()), ("scores", pa.list_(pa.float64())), ("bins", pa.list_(pa.int64()))]))

    seen = sample.mapInArrow(look, "toxic int, words long, scores array<double>, bins array<long>").collect()
    clean = [r for r in seen if not r.toxic]
    words = max(1, sum(r.words for r in clean))
    bins = np.sum([r.bins for r in clean], 0) if clean else np.zeros(BINS)
    bins = bins + np.where(np.arange(BINS) == 4, 1.0, 0.0)  # one made-up hit, so that there is a law to fit
    share, value = bins / (words + bins.sum()), (np.arange(BINS) + 0.5) * BIN
    lo, hi = 1e-3, 20.0
    for _ in range(80):  # the positive root of sum p(s) exp(lambda s) = 1
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (share * np.exp(mid * value)).sum() + (1 - share.sum()) * math.exp(-mid * DRIFT) > 1 else (mid, hi)
    rate = min(hi, 5.0)
    beyond = [s for r in clean for s in r.scores if s >= 1.0]
    k = (len(beyond) + 1) * math.exp(rate * 1.0) / words
    m = Model(odds(None), rate, min(1.0, max(k, 1e-9)), 1.0, 0.0)
    x = np.array([math.log1p(m.excess(r.scores, max(1, r.words))) for r in seen])
    y = np.array([float(r.toxic) for r in seen])
    # classes have weights that restore their share among all labels of these folds
    w = np.where(y == 1, total / max(y.mean(), 1e-9), (1 - total) / max(1 - y.mean(), 1e-9))
    m.a, m.b = _logistic(x, y, w)
    return m


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's steps, with a slight ridge on the slope."""
    v, xs = np.zeros(2), np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(xs @ v, -30, 30)))
        g = xs.T @ (w * (p - y)) + np.array([0.05 * v[0], 0.01 * v[1]])
        step = np.linalg.solve(xs.T @ (xs * (w * p * (1 - p))[:, None]) + np.diag([0.05, 0.01]), g)
        v = v - step
        if np.abs(step).max() < 1e-8:
            break
    return float(v[0]), float(v[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted, segments (first word, end word, score, expectation) of every row's whole text.

    Reads doc_id and text only. Null and empty texts have no segments and the score of one without. Equal texts score
    equally; an empty table gives an empty result. Segments are those expected less than once in a clean text.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("segments", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])))])

    def run(batches):
        m = held.value
        for b in batches:
            p, found = [], []
            for _, n, segs, _ in _segments(m.odds, b.column(1)):
                n = max(1, n)
                p.append(m.probability(m.excess([s for *_, s in segs], n)))
                found.append([{"first": a, "end": e, "score": s, "expected": x} for a, e, s in segs if (x := m.k * n * math.exp(-m.rate * s)) < 1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array([int(x >= THRESHOLD) for x in p], pa.int32()), pa.array(found, schema.field(3).type)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int, segments array<struct<first int, end int, score double, expected double>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learns from the labels that are not held out, scores all rows.

    Null and empty texts score as texts without a hit, and repeated rows alike. A null doc_id is not held out and has no
    label. Labels that are null or neither 0 nor 1, and those of documents that are not there, teach nothing; without a
    label of each class, all rows score next to 0 (or 1, if all are toxic). Whole texts are read, however long. Empty
    tables give an empty result; columns beyond doc_id, text and toxic are not read.
    """
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), 4) == HELD, F.lit(False)).alias("held_out"), "score", "predicted")
