"""Spelling variants: words one edit apart, found by Aho-Corasick automata over the halves of words.

Of two words one insertion, deletion or replacement apart, one half of the one stands in the other at its own end: the
left half as a beginning or the right half as an ending. Every word gives its two halves to the automaton shards that
their hashes name, and is scanned by the shards that can hold a half of a word one letter shorter, as long or one letter
longer (four halves at most, so rows grow with the words). A shard scans each word once, keeps the halves found at the
offset and the length that fit, and verifies the other part through an index of its one-letter gaps, so no two words are
compared just because they share a half. A pair found by both halves counts by the left one.

A half that more than HOT words share has no shard: its words meet by the one-letter gaps of their other parts as keys of
aggregations, which no half makes large. Both ways give the same pairs, exactly, without caps.

Words of one code point are near none. A word's form is its near word of largest n, the least in code-point order of those that tie, if that n is twice its own
at least; forms are followed by doubling, which ends as n doubles with each. Null and empty texts have no words; a null
doc_id counts as an empty one; repeated rows count each; an empty table has no words. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import drop_table, materialize, partitions, plain, small, table_by_group

RUN = "([A-Za-zÀ-ÿ]+)"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: of so many runs, one loses a letter
GAP = 97
#: words that share a half and still are the index of one shard
HOT = 20_000
#: words whose halves make up one shard, on average
SHARD_WORDS = 15_000
#: longer parts are compared one by one instead of by their gaps, whose bytes grow with the square of the length
INDEXED = 64
FOUND = "word string, n_near long, form_n long, form string"


def vocabulary(docs: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """word, n: runs of letters of doc_id's text with A-Z lowered, one in GAP of them without one letter, that are long and frequent enough."""
    runs = plain(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), 1)).alias("run"))
    runs = runs.where(F.char_length("run") >= least_length).select("id", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    without = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % GAP == 0, without).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _halves(length: Column) -> Column:
    """right, size, like: the halves of words of ``like`` letters that a word of ``length`` can begin or end with, its own included."""
    of = [(F.lit(right), ((length + d + right) / 2).cast("int"), length + d) for right in (0, 1) for d in (-1, 0, 1)]
    return F.filter(F.array(*[F.struct(right.alias("right"), size.alias("size"), like.alias("like")) for right, size, like in of]), lambda h: (h["size"] > 0) & (h["size"] <= length))


def _segments(words: DataFrame) -> DataFrame:
    """word, n, right, seg, like: a row for each half that a word may share; like is the length of the words whose half it is."""
    h = F.explode(_halves(F.char_length("word"))).alias("h")
    out = words.select("word", "n", h)
    seg = F.when(F.col("h.right") == 0, F.substring(F.col("word"), F.lit(1), F.col("h.size"))).otherwise(F.substring(F.col("word"), F.char_length("word") - F.col("h.size") + 1, F.col("h.size")))
    return out.select("word", "n", F.col("h.right").alias("right"), seg.alias("seg"), F.col("h.like").alias("like"))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes a of b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)
    while low < high:  # the length of what both begin with
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


@dataclass
class _Index:
    """The other parts of the words of one length that share a half, by their one-letter gaps."""

    exact: dict[str, int] = field(default_factory=dict)
    holes: dict[str, list[int]] = field(default_factory=dict)
    gaps: dict[str, list[int]] = field(default_factory=dict)
    long: list[tuple[str, int]] = field(default_factory=list)

    def add(self, rest: str, word: int) -> None:
        if len(rest) > INDEXED:
            self.long.append((rest, word))
            return
        self.exact[rest] = word
        for i in range(len(rest)):
            self.holes.setdefault(f"{rest[:i]}\0{rest[i + 1 :]}", []).append(word)
            if not i or rest[i] != rest[i - 1]:  # letters of a run leave the same gap
                self.gaps.setdefault(rest[:i] + rest[i + 1 :], []).append(word)

    def near(self, rest: str, shorter: int) -> Iterator[int]:
        """Words of this index whose part is one edit from ``rest``; shorter: by how much ``rest`` is shorter than theirs."""
        if self.long:
            yield from (w for r, w in self.long if one_edit(r, rest))
        if shorter > 0:
            yield from self.gaps.get(rest, ())
        elif shorter < 0:
            seen = {rest[:i] + rest[i + 1 :] for i in range(len(rest))} if len(rest) <= INDEXED + 1 else ()
            yield from (self.exact[r] for r in seen if r in self.exact)
        elif len(rest) <= INDEXED:
            own = self.exact.get(rest)
            for i in range(len(rest)):
                yield from (w for w in self.holes.get(f"{rest[:i]}\0{rest[i + 1 :]}", ()) if w != own)


def _scan(key: tuple, rows: pa.Table) -> pa.RecordBatch | None:
    """Scan a shard's words by the automaton of its halves; a row for each word with near ones: their number and the best."""
    words, counts, right, own = (rows.column(c).to_pylist() for c in ("word", "n", "right", "own"))
    number: dict[str, int] = {}
    names, ns = [], []
    automaton = ahocorasick.Automaton()
    # by half: its size and, for left and right halves, the index of each length of word
    held: dict[str, tuple[int, dict[int, _Index], dict[int, _Index]]] = {}
    for w, n, r, o in zip(words, counts, right, own, strict=True):
        if w not in number:
            number[w] = len(names)
            names.append(w)
            ns.append(n)
        if o:
            half = len(w) // 2
            seg, rest = (w[half:], w[:half]) if r else (w[:half], w[half:])
            held.setdefault(seg, (len(seg), {}, {}))[1 + r].setdefault(len(w), _Index()).add(rest, number[w])
    if not held:
        return None
    for seg, value in held.items():
        automaton.add_word(seg, value)
    automaton.make_automaton()
    out: tuple[list, list, list, list] = ([], [], [], [])
    for w in names:
        size, near = len(w), 0
        best: tuple[int, str] | None = None
        for end, (length, left, at_end) in automaton.iter(w):
            for k, index in ((0, left), (1, at_end)):
                if not index or (end != size - 1 if k else end != length - 1):
                    continue
                rest = w[: size - length] if k else w[length:]
                for like in (size - 1, size, size + 1):
                    if like not in index:
                        continue
                    for x in index[like].near(rest, like - size):
                        found = names[x]
                        if k and w.startswith(found[: like // 2]):
                            continue  # counted by its left half
                        near += 1
                        mark = (-ns[x], found)
                        best = mark if best is None or mark < best else best
        if best:
            for col, value in zip(out, (w, near, -best[0], best[1]), strict=True):
                col.append(value)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["word", "n_near", "form_n", "form"])


def _best(n: str, word: str) -> Column:
    return F.min(F.struct((-F.col(n)).alias("less"), F.col(word).alias("w")))


def _by_gaps(seg: DataFrame) -> DataFrame:
    """The pairs of the halves in ``seg`` (rows of ``_segments`` with own), by the gaps of the words' other parts."""
    size = F.char_length("word")
    rest = F.when(F.col("right") == 0, F.substring(F.col("word"), F.char_length("seg") + 1, size)).otherwise(F.substring(F.col("word"), F.lit(1), size - F.char_length("seg")))
    seg = seg.withColumn("rest", rest).withColumn("size", size)
    part = lambda i, fill: F.concat(F.substring(F.col("rest"), F.lit(1), i), F.lit(fill), F.substring(F.col("rest"), i + 2, F.char_length("rest")))
    every = F.when(F.char_length("rest") > 0, F.sequence(F.lit(0), F.char_length("rest") - 1)).otherwise(F.array().cast("array<int>"))
    bucket = ["right", "seg", "like", "key"]

    def answer(df: DataFrame) -> DataFrame:
        return df.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.w").alias("form"))

    # as long: words that are equal but for one place are all near each other; a word's best is the best or the second best of them
    own = seg.where("own")
    holes = own.select("word", "n", "right", "seg", "like", F.explode(F.transform(every, lambda i: part(i, "\0"))).alias("key"))
    top = holes.groupBy(*bucket).agg(F.count("*").alias("all"), _best("n", "word").alias("first"))
    with_first = holes.join(top.where("all > 1"), bucket)
    second = with_first.where(F.col("word") != F.col("first.w")).groupBy(*bucket).agg(_best("n", "word").alias("second"))
    same = with_first.join(second, bucket).select("word", (F.col("all") - 1).alias("n_near"), F.when(F.col("word") == F.col("first.w"), F.col("second")).otherwise(F.col("first")).alias("best"))
    # the other one letter shorter: a gap of this word's part is the other's part
    shorter = seg.where(F.col("like") == F.col("size") - 1).select("word", "right", "seg", "like", F.explode(F.array_distinct(F.transform(every, lambda i: part(i, "")))).alias("key"))
    exact = own.select("right", "seg", "like", F.col("rest").alias("key"), F.col("word").alias("other"), "n")
    pairs = shorter.join(exact, bucket).where((F.col("right") == 0) | ~F.startswith("word", F.expr("substring(other, 1, like div 2)")))
    less = pairs.groupBy("word").agg(F.count("*").alias("n_near"), _best("n", "other").alias("best"))
    # one letter longer: this word's part is a gap of the other's; found by its left half too, if the gap's end is the letter that the right half begins with
    gaps = own.select("n", F.col("word").alias("other"), "right", "seg", "like", "rest", F.explode(F.array_distinct(F.transform(every, lambda i: part(i, "")))).alias("key"))
    gaps = gaps.where((F.col("right") == 0) | (F.concat("key", F.substring("seg", 1, 1)) != F.col("rest")))
    gaps = gaps.groupBy(*bucket).agg(F.count("*").alias("n_near"), _best("n", "other").alias("best"))
    more = seg.where(F.col("like") == F.col("size") + 1).withColumn("key", F.col("rest")).join(gaps, bucket)
    return answer(same).union(answer(less)).union(answer(more))


def near_words(words: DataFrame, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, n_near, form_n, form (the near word of largest n, without a bound) of a written table (word, n) of distinct words; words without near ones are absent."""
    spark = words.sparkSession
    words = words.where(F.char_length("word") > 1)
    segments = _segments(words).withColumn("own", F.col("like") == F.char_length("word"))
    often = materialize(segments.where("own").groupBy("right", "seg").agg(F.count("*").alias("all")).where(F.col("all") > hot).select("right", "seg"), "halves")
    many = small(often)
    rest = segments.join(many, ["right", "seg"], "left_anti") if not often.isEmpty() else segments
    shards = max(partitions(spark), -(-words.count() // shard_words))
    # a half that is the word's own brings it to be scanned, too
    half = ((F.char_length("word") + F.col("right")) / 2).cast("int")
    rest = rest.where(F.col("own") | (F.char_length("seg") != half))
    rest = rest.select("word", "n", "right", "own", F.pmod(F.xxhash64("right", "seg"), F.lit(shards)).cast("int").alias("shard"))
    found = table_by_group(rest, ["shard"], shards, _scan, FOUND)
    if not often.isEmpty():
        found = found.union(_by_gaps(segments.join(many, ["right", "seg"])))
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.w").alias("form"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of a written table (word, form): forms followed to the last, twice as far in each round."""
    now, spent = forms.select("word", F.col("form").alias("root")), None
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if spent:
            drop_table(spent)
        now, spent = after.select("word", "root"), after
        if after.where("moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = 2, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table (word, n) of distinct words; a form has at least ``times`` (2 or more) its word's n."""
    words = materialize(words.select("word", "n"), "words")
    near = words.join(near_words(words, hot, shard_words), "word", "left")
    fits = F.col("form_n") >= F.lit(times) * F.col("n")
    near = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")), "forms")
    root = _roots(near.where("form is not null").select("word", "form"))
    return near.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of documents and their forms; reads doc_id and text."""
    return variants(vocabulary(docs))
