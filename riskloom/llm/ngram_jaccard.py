"""N-gram Jaccard join by prefix filtering under several global token orders.

A document's tokens are its distinct k-word shingles. Of two sets with a Jaccard
likeness of t or more, each has at most m = n - ceil(t * n) tokens that the other
lacks. So among the first m + k of each, under *any* total order of all tokens, k
are common. A pair must pass the filter of each order; the filters are intersected
before the sets are compared exactly.

The first order is by hash. A document's first 2 m + 1 tokens under it are dealt by
token, which tells how many documents have each one there; those of one document only
go no further, and a document that keeps too few is linked with nothing. The second
order is by these frequencies, rarest first, and works on what the first left: from
its rarest tokens, documents are dealt into buckets, one per shared token. Inside a
bucket a pair must have as many common tokens under the first order as linked ones do.
What passes both orders forms components of candidates, in which whole sets are compared.

Buckets are met in two rounds. The first takes each document by its two rarest tokens;
what it links needs no second comparison, so the second round drops every bucket whose
documents are of one component already, and pairs inside one. Buckets that hold the same
documents are one bucket. A large bucket or component is cut into blocks, and each pair
of blocks is a task of its own. Tokens that a large share of all documents has would meet
in one task to be counted; a sketch of all tokens finds them first, and they stand last in
the second order by the sketch's classes instead.

Tokens and sets are 64-bit hashes; at 10**9 different ones, a pair that collides is expected in about one run of forty.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import vectext as vt
from riskloom.llm.common import by_group, drop_table, materialize, partitions, plain, small, small_batches, whole_groups
from riskloom.llm.components import connected

U64 = np.uint64
#: cells of the sketch, a fixed 4 MiB as class numbers
SKETCH_BITS = 22
#: tokens of a document, rarest first, whose buckets the first round takes
FIRST_ROUND = 2
#: tokens (8 bytes each) that one side of a block pair holds
BLOCK_TOKENS = 2_000_000
#: bits of the filter of candidates, and sets that a task remembers to drop further copies of
BLOOM_BITS, COPIES_KNOWN = 24, 200_000
#: longest list of one token that is compared with others' lists
LIST_MOST = 1_000_000
#: rows of one batch of tokens
ROWS_AT_ONCE = 50_000
#: in the info column of token rows, n * 64 + kind: kinds are the sketch's class, or
DOC, DOC_NULL = 62, 63


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U64(64 - SKETCH_BITS)).astype(np.int64)


def _cid(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def _short(tokens: np.ndarray) -> bytes:
    """16 bits of each token: tokens that coincide make a filter let through too much, never too little."""
    return (tokens >> U64(8)).astype(np.uint16).tobytes()


def _partners(second: list[np.ndarray], size: np.ndarray, percent: int):
    """(i, later ones) by rising size: sets of fitting size that share as many first-order tokens as linked ones must."""
    m = len(second)
    order = np.argsort(size, kind="stable")
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    least = _least(size, percent)
    doc = np.repeat(np.arange(m), [len(x) for x in second])
    flat = np.concatenate(second)
    by = np.argsort(flat, kind="stable")
    doc = doc[by]
    flat = flat[by]
    cut = np.searchsorted(flat, np.arange(65537)) if len(flat) > 65536 else None
    for i in order.tolist():
        t = second[i].astype(np.int64)
        a, end = (cut[t], cut[t + 1]) if cut is not None else (np.searchsorted(flat, second[i]), np.searchsorted(flat, second[i], "right"))
        n = end - a
        near = doc[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        j, shared = np.unique(near, return_counts=True)
        ok = (place[j] > place[i]) & (100 * size[i] >= percent * size[j]) & (shared >= np.minimum(least[i], least[j]))
        if ok.any():
            yield i, j[ok]


def _bloom_bits(ids: np.ndarray) -> np.ndarray:
    return (vt.mix(ids.astype(np.int64).view(U64)) >> U64(64 - BLOOM_BITS)).astype(np.int64)


def _added(df: DataFrame, size: int, dtype, blocks: int) -> np.ndarray:
    """The sum of arrays of a fixed size that tasks give as (block int, bin binary) pieces; blocks are added apart."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(z), dtype).astype(np.int64)
                total[block] = total[block] + x if block in total else x
        for block, x in total.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "bin": [zlib.compress(x.tobytes(), 1)]})

    out, width = np.zeros(size, np.int64), size // blocks
    for r in df.repartition(blocks, "block").mapInArrow(add, "block int, bin binary").collect():  # a row for each block
        out[r.block * width : (r.block + 1) * width] = np.frombuffer(zlib.decompress(r.bin), np.int64)
    return out


def _pieces(x: np.ndarray, blocks: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array(range(blocks), pa.int32()), "bin": [zlib.compress(p.tobytes(), 1) for p in np.split(x, blocks)]})


def _blocks(spark) -> int:
    return 1 << min(10, max(3, partitions(spark).bit_length()))


def _bloom(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size for the documents whose sets are needed; a null id is as 0."""
    blocks = _blocks(ids.sparkSession)

    def mark(batches):
        bits = np.zeros(1 << BLOOM_BITS, np.uint8)
        for b in batches:
            bits[_bloom_bits(b.column(0).fill_null(0).to_numpy())] = 1
        if bits.any():
            yield _pieces(bits, blocks)

    return _added(ids.mapInArrow(mark, "block int, bin binary"), 1 << BLOOM_BITS, np.uint8, blocks) > 0


def _sets(text, k: int):
    """(row, sorted distinct tokens) of each row of a string column."""
    raw, bounds = vt.utf8(text)
    for i, j in vt.slices(bounds):
        part, at = raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        starts, ends, rows = vt.words(part, at)
        tokens, cut = vt.shingles(vt.span_hashes(part, starts, ends, True), rows, k)
        row = np.repeat(np.arange(j - i), np.diff(cut))
        order = np.lexsort((tokens, row))
        tokens, row = tokens[order], row[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])
        tokens, row = tokens[new], row[new]
        cut = np.searchsorted(row, np.arange(j - i + 1))
        for r in range(j - i):
            yield i + r, tokens[cut[r] : cut[r + 1]]


def _misses(n, percent: int):
    """How many tokens of a set of n may be missing from one that it links with: n - ceil(percent * n / 100)."""
    return n + (-percent * n) // 100


def _least(n, percent: int):
    """How many tokens the first-order prefixes of a set of n and of a larger one that it links with have in common, at least."""
    m = _misses(n, percent)
    return np.minimum(m + 1, n - m)


def _first_order(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The first 2 m + 1 tokens by hash, or all.

    Of a set's tokens before its k-th common one, only m are not common. So k of both sets' tokens are common among
    the first m + k of each; here k is m + 1, of the smaller set if they differ.
    """
    n = len(tokens)
    p = 2 * _misses(n, percent) + 1
    if p >= n:
        return tokens
    return tokens[np.argpartition(vt.mix(tokens ^ U64(0xA24BAED4963EE407)), p - 1)[:p]]


def _sketch(texts: DataFrame, k: int) -> np.ndarray:
    """log2 classes of how many documents have a token of each cell; class 0 is up to four times the mean."""
    blocks = _blocks(texts.sparkSession)

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        for b in batches:
            for _, tokens in _sets(b.column(0), k):
                total[_cells(tokens)] += 1  # the few tokens of a document that share a cell count once
        yield _pieces(total, blocks)

    total = _added(texts.mapInArrow(count, "block int, bin binary"), 1 << SKETCH_BITS, np.int32, blocks)
    least = 4 * max(1.0, total.mean())
    return np.where(total < least, 0, np.minimum(DOC - 1, 1 + np.log2(np.maximum(total, 1) / least))).astype(np.uint8)


def _frequencies(batches):
    """Of token rows that come by token: those in more than one set, with their place in the second order.

    Rows of documents, and tokens that the sketch has a class for, pass as they are.
    """
    for at, cid, info, extra in whole_groups(batches, 0):
        kind = info & 63
        plain_ = kind == 0
        twice = np.r_[False, (at[1:] == at[:-1]) & (cid[1:] == cid[:-1]) & plain_[1:] & plain_[:-1]]
        at, cid, info, extra, kind, plain_ = (x[~twice] for x in (at, cid, info, extra, kind, plain_))
        run = np.cumsum(np.r_[False, at[1:] != at[:-1]])
        df = np.bincount(run, plain_).astype(np.int64)[run]
        keep = ~plain_ | (df > 1)
        out = pa.RecordBatch.from_pydict({"cid": cid, "n": info >> 6, "kind": kind, "value": np.where(plain_, at, extra), "place": np.where(plain_, df, (1 << 50) + kind)})
        yield out.filter(pa.array(keep))


def _second_order(percent: int):
    """(cid, n, value, place) rows by cid, place and value to (cid, n, tokens, second) of sets that may link.

    tokens are the first under the second order, of those that the first left: as many as the set may lack of
    another's, and one more. second has 16 bits of each that the first left.
    """

    def run(batches):
        for cid, n, token, place in whole_groups(batches, 0):
            new = np.r_[True, (cid[1:] != cid[:-1]) | (token[1:] != token[:-1])]  # copies of a set that the sketch has classes for
            cid, n, token = cid[new], n[new], token[new]
            cut = np.flatnonzero(np.r_[True, cid[1:] != cid[:-1]])
            have = np.diff(np.r_[cut, len(cid)])
            size = n[cut]
            take = have - _least(-(-percent * size // 100), percent) + 1
            short = _short(token.view(U64))
            rows = np.flatnonzero(take > 0).tolist()
            at = [(int(cut[r]), int(have[r]), int(take[r])) for r in rows]
            yield pa.RecordBatch.from_pydict({
                "cid": cid[cut][rows], "n": size[rows],
                "tokens": pa.array([token[a : a + t] for a, _, t in at], pa.list_(pa.int64())),
                "second": pa.array([short[2 * a : 2 * (a + h)] for a, h, _ in at], pa.binary()),
            })

    return run


def _buckets(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(token, n, cid, root) prefix rows to (g, cid, root): a bucket g for each different list of sets of two roots or more.

    Sets whose sizes differ too much can't link: by size, a token's list falls apart where a size exceeds the one
    before by more than the threshold allows.
    """

    def run(batches):
        for tok, size, cid, root in whole_groups(batches, 0):
            twice = np.r_[False, (tok[1:] == tok[:-1]) & (cid[1:] == cid[:-1])]
            tok, size, cid, root = (x[~twice] for x in (tok, size, cid, root))
            cut = np.flatnonzero(np.r_[True, (tok[1:] != tok[:-1]) | (100 * size[:-1] < percent * size[1:])])
            many = np.diff(np.r_[cut, len(tok)])
            # the hash of a list is a sum, so the order of its members doesn't matter
            g = np.where(many > LIST_MOST, vt.mix(tok[cut].view(U64) + size[cut].astype(U64)), vt.mix(np.add.reduceat(vt.mix(cid.view(U64)), cut) + many.astype(U64))).view(np.int64)
            mixed = np.maximum.reduceat(root, cut) > np.minimum.reduceat(root, cut)
            keep = np.repeat(mixed, many)
            yield pa.RecordBatch.from_pydict({"g": np.repeat(g, many)[keep], "cid": cid[keep], "root": root[keep]})

    return rows.repartition(n, "token").sortWithinPartitions("token", "n", "cid").mapInArrow(run, "g long, cid long, root long").distinct()


class _Union:
    """Union-find over places; ``labels`` may hold equal labels to begin with."""

    def __init__(self, labels: np.ndarray):
        _, first, inv = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[inv].tolist()

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _compare(percent: int, every: bool):
    """Links inside a block or between two; without ``every``, none between sets of one root or that links found here connect."""

    def run(key, rows: dict):
        _, bi, bj = key
        cid, side, root = rows["cid"], rows["side"], rows["root"]
        sets = [np.frombuffer(x, U64) for x in rows["tokens"]]
        size = np.array([len(s) for s in sets])
        known = _Union(root)
        at = np.r_[0, np.cumsum(size)]
        flat = np.concatenate(sets)
        a, b = [], []
        for i, c in _partners([np.frombuffer(x, np.uint16) for x in rows["second"]], size, percent):
            if bi != bj:
                c = c[side[c] != side[i]]
            if not every:
                mine = known.find(i)
                c = c[[known.find(j) != mine for j in c.tolist()]] if len(c) else c
            if not len(c):
                continue
            where = np.repeat(at[c] - np.r_[0, np.cumsum(size[c])[:-1]], size[c]) + np.arange(size[c].sum())
            have = flat[where]
            p = np.minimum(np.searchsorted(sets[i], have), size[i] - 1)
            both = np.add.reduceat((sets[i][p] == have).astype(np.int64), np.r_[0, np.cumsum(size[c])[:-1]])
            for j in c[100 * both >= percent * (size[c] + size[i] - both)].tolist():
                if known.join(i, j) or every:
                    a.append(cid[i])
                    b.append(cid[j])
        return a, b

    return run


def _large(weights: DataFrame) -> DataFrame:
    """(g, weight) rows to (g, blocks) of the groups that weigh over BLOCK_TOKENS; only sums by group are made of the weights."""
    large = weights.groupBy("g").agg(F.sum("weight").alias("w")).where(F.col("w") > BLOCK_TOKENS)
    return small(materialize(large.select("g", F.ceil(F.col("w") / BLOCK_TOKENS).cast("int").alias("blocks")), "large"))


def _spread(rows: DataFrame, carry: list[str]) -> DataFrame:
    """(g, blocks, cid, ...) rows to (g, bi, bj, side, cid, ...): each row goes to all pairs of its block with others."""
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("side", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("side")).alias("bi"), F.greatest(x, F.col("side")).alias("bj")))
    return rows.select("*", F.explode(pairs).alias("pair")).select("g", "pair.bi", "pair.bj", "side", "cid", *carry)


def _both_orders(percent: int):
    """Candidates: pairs of different roots that pass the first order's filter too, only as many as connect what they connect."""

    def run(key, rows: dict):
        cid, side, root = rows["cid"], rows["side"], rows["root"]
        known = _Union(np.arange(len(cid)))
        a, b = [], []
        for i, c in _partners([np.frombuffer(x, np.uint16) for x in rows["second"]], rows["n"], percent):
            c = c[root[c] != root[i]]
            for j in (c[side[c] != side[i]] if key[1] != key[2] else c).tolist():
                if known.join(i, j):
                    a.append(cid[i])
                    b.append(cid[j])
        return a, b

    return run


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, count_links: bool = False) -> DataFrame:
    """Components of the documents whose shingle sets have a Jaccard likeness of ``percent`` / 100 or more.

    Reads ``doc_id`` and ``text`` of ``docs``; other columns are ignored. Returns one row per row of ``docs``:
    doc_id, n_shingles (size of the set), class_id (least doc_id with an equal set), component_id (least doc_id
    reachable by links), and with ``count_links`` also n_links, the number of other rows it links with (for this,
    all linked pairs are compared; without, only as many as connect the components).

    Null or empty texts, and texts without words, have empty sets and link with nothing: class_id and component_id
    are their own doc_id. With fewer than k words, the sequence is the one shingle. Rows that repeat a doc_id are
    documents of their own; a null doc_id takes part and is never the least unless alone. An empty table gives an
    empty result. No text is too long: it is hashed in one piece and never cut.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    small_batches(spark)
    n_out = partitions(spark)
    classes_of = spark.sparkContext.broadcast(_sketch(plain(docs, "text"), k))

    def first_order(batches):
        names = ("at", "cid", "info", "extra")
        seen: set[int] = set()
        made, held, rows = [[] for _ in names], 0, 0

        def add(*columns):
            nonlocal held
            for to, x in zip(made, columns, strict=True):
                to.append(x.astype(np.int64))
            held += len(columns[0])

        def out():
            nonlocal held
            b = pa.RecordBatch.from_pydict({n: np.concatenate(x) for n, x in zip(names, made, strict=True)})
            for x in made:
                x.clear()
            held = 0
            return b

        for b in batches:
            ids = b.column(0).to_pylist()
            for r, tokens in _sets(b.column(1), k):
                n = len(tokens)
                cid = _cid(tokens) if n else 0
                rows += 1
                # anywhere, so copies don't meet
                add(vt.mix(np.array([rows ^ cid & (1 << 63) - 1], U64)).view(np.int64), np.array([cid]), np.array([n * 64 + (DOC_NULL if ids[r] is None else DOC)]), np.array([ids[r] or 0]))
                if n and cid not in seen:  # the first copy stands for all of its task
                    if len(seen) < COPIES_KNOWN:
                        seen.add(cid)
                    t = _first_order(tokens, percent)
                    kind = classes_of.value[_cells(t)].astype(np.int64)
                    add(np.where(kind > 0, vt.mix(t ^ U64(cid % 2**64)), t).view(np.int64), np.full(len(t), cid), n * 64 + kind, np.where(kind > 0, t, U64(0)).view(np.int64))
                if held > ROWS_AT_ONCE:
                    yield out()
        if held:
            yield out()

    rows = docs.mapInArrow(first_order, "at long, cid long, info long, extra long").repartition(n_out, "at").sortWithinPartitions("at", "cid")
    rows = materialize(rows.mapInArrow(_frequencies, "cid long, n long, kind long, value long, place long"), "frequencies")
    base = rows.where(F.col("kind") >= DOC).select(F.when(F.col("kind") == DOC, F.col("value")).alias("doc_id"), "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid"))
    left = rows.where(F.col("kind") < DOC).select("cid", "n", "value", "place").repartition(n_out, "cid").sortWithinPartitions("cid", "place", "value")
    left = materialize(left.mapInArrow(_second_order(percent), "cid long, n long, tokens array<long>, second binary"), "prefixes")
    classes = materialize(base.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")), "classes")

    def round_(prefixes: DataFrame, every: bool) -> DataFrame:
        """(cid, n, root, tokens) to links (a, b) of sets of different roots."""
        buckets = materialize(_buckets(prefixes.select(F.explode("tokens").alias("token"), "n", "cid", "root"), n_out, percent), "buckets")
        sized = buckets.join(left.select("cid", F.octet_length("second").alias("weight")), "cid").select("g", "weight")
        found = buckets.join(_large(sized), "g", "left").join(left.select("cid", "n", "second"), "cid")
        pairs = by_group(_spread(found, ["n", "root", "second"]), ["g", "bi", "bj"], n_out, _distinct(_both_orders(percent)), "a long, b long")
        # linked sets are candidates of each other, so they are in one component of candidates: each set travels once
        groups = connected(pairs).select(F.col("node").alias("cid"), F.col("root").alias("g"))
        cand = materialize(groups.join(classes.select("cid", "rep"), "cid").join(prefixes.select("cid", "n", "root"), "cid"), "candidates")
        to = materialize(cand.join(_large(cand.select("g", F.col("n").alias("weight"))), "g", "left").select("cid", "g", "root", "blocks"), "groups")
        wanted = spark.sparkContext.broadcast(_bloom(cand.select("rep")))

        def whole_sets(batches):
            for b in batches:
                ids = b.column(0).fill_null(0).to_numpy()
                b = b.take(pa.array(np.flatnonzero(wanted.value[_bloom_bits(ids)])))
                cid, sets, second = [], [], []
                for _, t in _sets(b.column(1), k):
                    if len(t):
                        cid.append(_cid(t))
                        sets.append(t.tobytes())
                        second.append(_short(_first_order(t, percent)))
                yield pa.RecordBatch.from_pydict({"cid": pa.array(cid, pa.int64()), "tokens": pa.array(sets, pa.binary()), "second": pa.array(second, pa.binary())})

        sets = docs.mapInArrow(whole_sets, "cid long, tokens binary, second binary").join(small(to), "cid")
        # copies of a set that pass the filter bring it more than once
        links = materialize(by_group(_spread(sets, ["root", "tokens", "second"]), ["g", "bi", "bj"], n_out, _distinct(_compare(percent, every)), "a long, b long"), "links")
        for spent in (buckets, cand, to):
            drop_table(spent)
        return links

    if count_links:
        links = round_(left.select("cid", "n", F.col("cid").alias("root"), "tokens"), True)
    else:
        first = round_(left.select("cid", "n", F.col("cid").alias("root"), F.slice("tokens", 1, FIRST_ROUND).alias("tokens")), False)
        roots = connected(first)
        rest = left.join(roots, left["cid"] == roots["node"], "left").select("cid", "n", F.coalesce("root", "cid").alias("root"), "tokens")
        links = first.union(round_(rest, False))

    roots = connected(links)
    named = classes.join(roots, classes["cid"] == roots["node"], "left").select("cid", "rep", "m", F.coalesce("root", "cid").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("cid", "rep", "m", "component_id")
    if count_links:
        both = links.union(links.select("b", "a")).toDF("cid", "to")
        more = both.join(classes.select(F.col("cid").alias("to"), F.col("m").alias("m_to")), "to").groupBy("cid").agg(F.sum("m_to").alias("others"))
        named = named.join(more, "cid", "left").withColumn("n_links", F.col("m") - 1 + F.coalesce("others", F.lit(0)))
    out = base.select("doc_id", F.col("n").alias("n_shingles"), "cid").join(named.drop("m"), "cid", "left")
    extra = [F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")] if count_links else []
    return out.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"), *extra)


def _distinct(fn):
    def run(key, rows):
        _, first = np.unique(rows["cid"], return_index=True)
        if len(first) < len(rows["cid"]):
            rows = {k: x[first] if isinstance(x, np.ndarray) else [x[i] for i in first.tolist()] for k, x in rows.items()}
        return fn(key, rows) if len(first) > 1 else ((), ())

    return run
