"""Operators against brute force, round trips and held-out accuracy on small tables with every odd case."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from riskloom.llm import language_id, ngram_lm, phrase_prints, piece_codec, quality_rules, source_mixing, token_shards, toxic_segments, warc
from riskloom.llm.components import connected
from riskloom.llm.ngram_jaccard import jaccard_join
from riskloom.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n long, cid string, task int, p double, words string"


def _texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(12)]
    out = [None, "", " \t\n", "one", "One two", "x" * 5000, "a b c a b c " * 400]
    for b in base:
        out += [" ".join(b), " ".join(b), " ".join(b[:-1] + ["Zz"]), " ".join(b[:30] + ["q1", "q2", "q3"] + b[33:]), "\n".join(b)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i * 7 % 101, t, rng.choice(["en", None]), rng.choice(["s1", "s2", None, ""]), 1, "c", 2, 0.5, "w") for i, t in enumerate(_texts())]
    rows += [rows[9], (None, "null id text with some words in it", "en", "s1", 1, "c", 2, 0.5, "w")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _set(t, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard(docs, rows, k, percent):
    sets = [(d, _set(t, k)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = collections.Counter()
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), math.inf), d if d is not None else math.inf)
    want = sorted((d, len(s), None if low[find(i)] == math.inf else low[find(i)], links[i]) for i, (d, s) in enumerate(sets) if d is not None)
    got = jaccard_join(docs, k, percent, count_links=True)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got.where("doc_id is not null").collect()) == want
    plain = jaccard_join(docs, k, percent).where("doc_id is not null")
    assert sorted((r.doc_id, r.component_id) for r in plain.collect()) == sorted((a, c) for a, _, c, _ in want)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (3, 3), (9, 8), (8, 7), (7, 6)], "a long, b long")
    assert {r.node: r.root for r in connected(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6}


def test_quality(docs, rows):
    want = []
    for d, t in rows:
        w = WORD.findall(t or "")
        c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        ls = [x for x in (t or "").split("\n") if WORD.search(x)]
        want.append((str(d), len(w), sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), len(ls) - len(set(ls)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)))
    got = quality_rules.quality(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert not any(r.kept for r in got if r.base_failed)


def test_quality_outliers(spark):
    rng = random.Random(6)
    clean = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(80, 200)))
    rows = [(i, clean() if i % 10 else " ".join(w + "%%%" for w in clean().split()), "en", "s") for i in range(300)]
    got = {r.doc_id: r for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i].kept for i in range(0, 300, 10))
    assert sum(got[i].kept for i in range(300) if i % 10) >= 268

    # most distances are under the mean of their law, as the least deviations of constant statistics shrink them
    d = sorted(got[i].distance for i in range(300) if i % 10)
    assert d[len(d) // 2] < 8


def test_quality_short_junk(spark):
    rng = random.Random(8)
    clean = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.choice((25, 60, 150, 400))))
    junk = {i: " ".join(rng.choice("#*$%&|<>") for _ in range(20 + i % 11)) for i in range(0, 300, 15)}
    junk |= {i: " ".join(w + "%" * (j % 2) for j, w in enumerate(clean().split()[:40])) for i in range(5, 300, 30)}
    rows = [(i, junk.get(i) or clean(), "en", "s") for i in range(300)]
    got = {r.doc_id: r for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i].base_failed for i in junk)
    assert not any(got[i].kept for i in junk)
    assert sum(got[i].kept for i in range(300) if i not in junk) >= 0.99 * (300 - len(junk))


def test_quality_copies(spark):
    rng = random.Random(9)
    clean = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 200)))
    junk = " ".join(w + "%%%" for w in clean().split())
    near = " ".join(w + "&&" for w in clean().split())
    rows = [(i, junk if i % 3 == 0 else clean(), "en", "copies") for i in range(600)]
    # texts that differ, with one vector of statistics
    rows += [(i, near + f" {i}&&" if i % 3 == 0 else clean(), "en", "ties") for i in range(600, 1200)]
    got = {r.doc_id: r for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i].base_failed for i in range(1200))
    assert not any(got[i].kept for i in range(0, 1200, 3))
    assert sum(got[i].kept for i in range(1200) if i % 3) >= 0.99 * 800

    # a clean text may have as many copies
    rows = [(i, rows[1][1] if i % 3 == 0 else t, lang, s) for i, t, lang, s in rows[:600]]
    assert all(r.kept for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect() if r.doc_id % 3 == 0)


def test_mixing(docs, rows):
    got = source_mixing.mix(docs).collect()
    size = {s: 0 for s in ("s1", "s2", None, "")}
    by_source = [(r.source, r.text) for r in docs.collect()]
    for s, t in by_source:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, left, target = sum(size.values()), set(order), {}
    while True:
        c = (total - sum(target.values())) / max(1, sum(weight[s] for s in left))
        over = {s for s in left if c * weight[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= over
    target |= {s: c * weight[s] for s in left}
    assert sorted(round(r.target, 6) for r in got) == sorted(round(target[s], 6) for s, _ in by_source)
    assert all(r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in got)
    again = source_mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.source_size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_rounding_keeps_the_sum():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 50) for _ in range(400)), reverse=True)
    hits = []
    for seed in range(60):
        copy, at, p = source_mixing.round_leaf([(i, s, 0.3) for i, s in enumerate(sizes)], seed)
        taken = sum(s * c for s, c in zip(sizes, copy) if c is not None) + (sizes[at] * p if at is not None else 0)
        assert abs(taken - 0.3 * sum(sizes)) < 1e-6
        hits.append(copy[0])
    assert 5 < sum(hits) < 35


def test_warc(spark, tmp_path):
    big = "".join(random.Random(2).choice("abc<>é\r\n") for _ in range(3_000_000))
    rows = [(1, "http://a", "x" * 1000), (2, None, "x" * 1000), (3, "http://ü", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", big), (None, "u", "x" * 1000), (2, None, "x" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write(pages, f"file://{tmp_path}/w")
    chunks = warc.read(manifest).collect()
    whole = collections.defaultdict(bytes)
    for c in sorted((c for c in chunks if c.page_id == 7), key=lambda c: c.chunk_no):
        whole[c.page_id] += c.data
        assert c.sha1_so_far == hashlib.sha1(whole[7]).hexdigest()
    assert whole[7] == big.encode() and sum(c.page_id == 7 for c in chunks) > 2
    got = sorted(((r.page_id or 0), r.payload_bytes, r.record_type, r.refers_to) for r in warc.digests(pages).collect())
    assert got == sorted([(1, 1000, "revisit", 2), (2, 1000, "response", None), (2, 1000, "response", None), (0, 1000, "revisit", 2), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (6, 0, "response", None), (7, len(big.encode()), "response", None)])


def test_token_shards(docs, rows):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want, start = [], 0
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_shards.digests(docs, path).collect()), key=lambda r: r[1])
    assert got == want


def test_wavelet():
    import numpy as np

    x = np.random.default_rng(1).integers(0, 700, 3000).astype(np.uint16)
    s = token_shards.Shard(token_shards.shard_bytes([5], [3000], x, 1))
    assert (s.all() == x).all() and all(s.access(i) == x[i] for i in range(0, 3000, 37))
    for v in (0, 5, 699, 701):
        at = np.flatnonzero(x == v)
        assert s.count(v) == len(at) and [s.occurrence(v, k) for k in range(len(at))] == at.tolist()


def test_fingerprints(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        q = len(t) // 4
        want.append((str(d), len(t), hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()))
    got = phrase_prints.fingerprints(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    texts = dict(rows)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert all((prints[a] == prints[b]) == ((texts[a] or "") == (texts[b] or "")) for a in prints for b in prints)


def test_fingerprints_see_shared_text(spark):
    rng = random.Random(3)
    t = " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(400))
    a, b, c = phrase_prints.sketches(__import__("pyarrow").array([t, "Another beginning. " + t, t[::-1]]))
    assert phrase_prints.likeness(a[None], b[None])[0] > 0.9 and phrase_prints.likeness(a[None], c[None])[0] < 0.2


def test_piece_codec():
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        c = piece_codec.PieceCodec(f.read())
    rng = random.Random(7)
    for _ in range(3000):
        t = "".join(rng.choice(rng.choice(["the ing er  ", "01 2.,-\n\t", "▁ ßé日\U0001f600\x00", "aaaa", "<s></s>"])) for _ in range(rng.randint(0, 50)))
        ids = sp.encode(t, add_eos=True)
        assert c.encode(t) == ids and c.decode(ids) == sp.decode(ids)
        assert c.digest(t) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_piece_tables(docs, rows, empty):
    path = tokenizer("piece_bpe_32k.model")
    back = piece_codec.decode(piece_codec.encode(docs, path), path)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(d), t or "") for d, t in rows)
    assert piece_codec.digests(empty, path).count() == 0


def test_language(spark):
    rng = random.Random(8)
    parts = {"aa": ["the", "ing", "and", "ou"], "bb": ["sch", "ung", "ein", "ä"], "cc": ["eux", "que", "les", "é"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join(rng.choice(parts[lang]) + rng.choice(parts[lang]) for _ in range(rng.randint(5, 40))), lang))
    rows += [(1000, None, "aa"), (1001, "123 ...", "aa"), (1002, "theing andou", None), (None, "schung einä", "bb"), (1003, "theing " * 20000, "aa")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    by = {r.doc_id: r for r in got}
    held = [r for r in rows[:240] if by[r[0]].held_out]
    assert held and all(by[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, _, _ in rows[:240])
    assert sum(by[d].lang_pred == x for d, _, x in held) >= 0.95 * len(held)
    assert by[1000].lang_pred == by[1001].lang_pred == "und" and by[1002].lang_pred == "aa" and by[1003].lang_pred == "aa"


def test_toxicity(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        bad = i % 5 == 0
        if bad:
            w[3:3] = ["vilezz" + rng.choice("klmno"), "Badqq", "vilezz" + rng.choice("pqrs")]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, ""), (None, "Badqq vilezzu vilezzw")]
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (0, 1, 0), (5000, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxic_segments.toxicity(d, y).collect()}
    held = [i for i in range(400) if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    assert all(got[i].predicted == (i % 5 == 0) for i in held)
    assert got[None].predicted == 1 and got[900].predicted == got[901].predicted == 0
    none = toxic_segments.toxicity(d, y.where("toxic = 7"))
    assert {r.predicted for r in none.collect()} == {0}


def test_maximal_segments():
    rng = random.Random(10)
    for _ in range(300):
        n = rng.randint(1, 12)
        s = [rng.choice([-1.0, -1.0, 2.5, 1.5]) for _ in range(n)]
        found = toxic_segments.maximal_segments([(i, x) for i, x in enumerate(s) if x > 0], 1.0)

        def best(lo, hi):  # the definition: the best segment, then the same on each side of it
            sums = [(sum(s[a:b]), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
            top = max(sums, default=(0,))
            if top[0] <= 0:
                return []
            return [*best(lo, top[2]), (top[2], top[3], top[0]), *best(top[3], hi)]

        assert sorted(x[2] for x in found) == sorted(x[2] for x in best(0, n))


def test_kneser_ney(docs, rows):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tok = [(d, [*WORD.findall(low(t)), "</s>"]) for d, t in rows]
    train = [v for d, v in tok if d is None or zlib.crc32(str(d).encode()) % 10]
    c, bi = collections.Counter(w for v in train for w in v), collections.Counter(p for v in train for p in zip(["<s>", *v], v))
    n, v_ = sum(c.values()), len(c)
    ch, nh, cont = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0]), collections.Counter()
    for (a, b), k in bi.items():
        ch[a] += k
        nh[a][min(k, 3) - 1] += 1
        cont[b] += 1
    disc = lambda x: (0.0, *ngram_lm._discounts([sum(k == i for k in x.values()) for i in (1, 2, 3, 4)]))
    d2, d1, total = disc(bi), disc(cont), sum(cont.values())
    rest = sum(min(k, d1[min(k, 3)]) for k in cont.values()) / total

    def p(h, w):
        base = max(cont[w] - d1[min(cont[w], 3)], 0) / total + rest / (v_ + 1)
        if not ch[h]:
            return base
        return max(bi[h, w] - d2[min(bi[h, w], 3)], 0) / ch[h] + sum(d2[i + 1] * nh[h][i] for i in range(3)) / ch[h] * base

    want = sorted((str(d), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v_ + 1))) for w in x), 5), round(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *x], x)), 5)) for d, x in tok)
    got = ngram_lm.lm_scores(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == want


def test_empty_tables(spark, empty):
    assert jaccard_join(empty).count() == 0
    assert quality_rules.quality(empty).count() == 0
    assert source_mixing.mix(empty).count() == 0
    assert warc.digests(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert token_shards.digests(empty, tokenizer("word_bpe_49k.json")).count() == 0
    assert phrase_prints.fingerprints(empty).count() == 0
    assert language_id.identify(empty).count() == 0
    assert toxic_segments.toxicity(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert ngram_lm.lm_scores(empty).count() == 0
