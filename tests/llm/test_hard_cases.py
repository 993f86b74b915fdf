"""Cases that once went wrong: words that a linear hash confuses, held-out labels, signs that are no letters, odd tables."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import common, language_id, ngram_lm, phrase_prints, piece_codec, quality_rules, token_shards, toxic_segments, vectext
from riskloom.llm.components import connected
from riskloom.llm.ngram_jaccard import jaccard_join
from riskloom.llm.queries import tokenizer

MORE = "/root/testdata/sf0.01"


def _thue_morse(n):
    x = [0]
    while len(x) < n:
        x += [1 - b for b in x]
    word = "".join("ab"[b] for b in x[:n])
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 16, 64, 65, 1024, 4096])
def test_words_that_linear_hashes_confuse(n):
    from tokenizers import Tokenizer

    a, b = _thue_morse(n)
    raw, bounds = vectext.utf8(pa.array([f"{a} {b} {a}"]))
    h = vectext.span_hashes(raw, *vectext.words(raw, bounds)[:2]).tolist()
    assert h[0] == h[2] != h[1]
    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        e = token_shards.WordEncoder(f.read())
    for text in (f"{a} {b}", b, a):
        assert np.frombuffer(e(text), e.dtype).tolist() == t.encode(text, add_special_tokens=False).ids


def test_tables_of_such_words(spark):
    a, b = _thue_morse(1024)
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join(docs, 3, 90).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    m = ngram_lm.train(docs)
    assert m.types == 3 and m.tokens == 6


def test_parts_of_words_in_any_order():
    path = tokenizer("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        model = f.read()
    rng = random.Random(5)
    pick = ["the ing er  ", "01 2.,-\n\t", "ÀßéÐ÷×ÿ a", "it's we'll <|endoftext|> '", "日本é \xa0\x85\x1c", "ABC", "aaaa"]
    texts = ["".join(rng.choice(rng.choice(pick)) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [None, ""]
    e = token_shards.WordEncoder(model)
    want = [[*x.ids, 1] for x in e.t.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    for order in (range(len(texts)), reversed(range(len(texts)))):
        order, out = list(order), []
        for _, _, ids, n in e.rows(pa.array([texts[i] for i in order], pa.string()), 1):
            out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert out == [want[i] for i in order]


def test_held_out_labels_teach_nothing(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(100)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + (" vilezz badqq" if i % 5 == 0 else "")) for i in range(200)]
    rows += [rows[7]] * 50  # a doc_id that repeats
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, toxic string, fold int")
    from zlib import crc32

    held = {i for i, _ in rows if crc32(str(i).encode()) % 4 == 2}
    score = lambda labels: sorted((r.doc_id, r.score) for r in toxic_segments.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect())
    assert score([(i, 1, int(i % 5 == 0)) for i in range(200)]) == score([(i, 1, 1 if i in held else int(i % 5 == 0)) for i in range(200)])


def test_signs_that_are_no_letters(spark):
    rows = [(i, "abcde " * 20 if i % 2 else "vwxyz " * 20, "ab"[i % 2]) for i in range(80)]
    rows += [(100, "½", None), (101, "① ②", None), (102, "x²", None), (103, "Ⅷ", None), (104, "日本語 😀", None), (105, "\U00010400\U00010401", None)]
    rows += [rows[1]] * 500  # repeated rows teach once
    docs = spark.createDataFrame([(*r, 1.0, "n") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert {i for i, x in got.items() if x == "und"} == {100, 101, 103}


def test_kernel_and_ridge_by_definition(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(language_id, "LANDMARKS", 15)
    texts, names = [], []
    for i in range(40):
        names.append("xyz"[i % 3])
        texts.append(" ".join("".join(rng.choice({"x": "abcdeé", "y": "efghij日", "z": "ijklÀm"}[names[-1]]) for _ in range(rng.randint(2, 6))) for _ in range(8)))

    def grams(t):
        c = [x if x.isalpha() else "\0" for x in t.lower()]
        return {"".join(c[i : i + n]) for n in (1, 2, 3) for i in range(len(c) - n + 1)}

    k = lambda a, b: len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b)))
    # few common letters, so that some texts take the way of the table and some that of numbers
    for common in ([ord(c) for c in "abcdefghijklm"], [ord(c) for c in "abcdefghijklméà日"]):
        alphabet = language_id.Alphabet(common)
        sets = [alphabet.grams(t) for t in texts]
        assert [len(s) for s in sets] == [len(grams(t)) for t in texts]
        m = language_id.solve(names, sets, common)
        land = texts[:15]
        kmm = np.array([[k(a, b) for b in land] for a in land])
        knm = np.array([[k(a, b) for b in land] for a in texts])
        y = np.array([[1.0 if n == c else -1.0 for c in "xyz"] for n in names])
        value, vector = np.linalg.eigh(kmm + 1e-6 * np.eye(15))
        phi = knm @ (vector / np.sqrt(value))
        w = np.linalg.solve(phi.T @ phi + language_id.RIDGE * 40 / 100 * np.eye(15), phi.T @ y)
        f = phi @ w
        got_names, got = m.predict(texts)
        order = np.sort(f, 1)
        assert got_names == ["xyz"[i] for i in f.argmax(1)]
        assert np.allclose(got, np.clip(0.5 + (order[:, -1] - order[:, -2]) / 4, 0, 1), atol=1e-4)


def test_components_in_rounds(spark):
    rng = random.Random(1)
    e = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(999, i) for i in range(0, 300, 7)]
    d = spark.createDataFrame(e, "a long, b long")
    one, rounds = ({r.node: r.root for r in connected(d, n).collect()} for n in (10**6, 0))
    assert one == rounds and one[0] == 0


def test_blocks_of_a_large_group(spark, monkeypatch):
    from riskloom.llm import ngram_jaccard

    monkeypatch.setattr(ngram_jaccard, "BLOCK_TOKENS", 2000)
    monkeypatch.setattr(ngram_jaccard, "LIST_MOST", 5)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):  # a chain: each text differs from the one before by few words
        base[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(base)))
    rows += [(100 + i, " ".join(f"o{i}x{j}" for j in range(50))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for _, t in rows]
    links = {(i, j) for i in range(80) for j in range(80) if i != j and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])}
    got = jaccard_join(docs, 3, 90, count_links=True).collect()
    assert {r.doc_id: r.n_links for r in got} == {rows[i][0]: sum(a == i for a, _ in links) for i in range(80)}
    plain = {r.doc_id: r.component_id for r in jaccard_join(docs, 3, 90).collect()}
    assert plain == {r.doc_id: r.component_id for r in got}


def test_frequent_histories_are_cut_by_word(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(w for _ in range(20) for w in ("the", f"w{rng.randrange(400)}")) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    m = ngram_lm.train(docs)
    assert len(m.heavy) >= 1 and m.heavy[:, 1].max() == 1200
    followers = collections.Counter(w for t in texts for w in t.split() if w != "the")
    row = m.heavy[m.heavy[:, 1].argmax()]
    assert row[2:].tolist() == [sum(n == 1 for n in followers.values()), sum(n == 2 for n in followers.values()), sum(n > 2 for n in followers.values())]


def test_counts_beyond_32_bits():
    keys, counts = np.array([1, 5, 9], np.uint64), np.array([1, 2**33, 7])
    assert [x.tolist() for x in ngram_lm._unpack(ngram_lm._pack(keys, counts))] == [[1, 5, 9], [1, 2**33, 7]]


def test_small_groups_are_pooled(spark):
    rng = random.Random(8)
    clean = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 200)))
    rows = [(i, clean() if i % 20 else " ".join(w + "%%%" for w in clean().split()), "en", f"s{i % 40}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality_rules.quality(docs).collect()}  # five texts a source
    assert not any(got[i] for i in range(0, 200, 20)) and sum(got.values()) >= 0.98 * 190
    few = quality_rules.quality(docs.where("doc_id < 20"))  # twenty texts give no estimate
    assert all(r.kept and r.distance is None for r in few.collect())
    assert few.count() == 20 and quality_rules.quality(docs.where("doc_id < 20"), least_rows=8).where("distance is not null").count() == 20


def test_accepted_keeps_all_columns(spark):
    docs = spark.createDataFrame([(1, "a few words " * 20, "en", "s", 5, True, "r"), (2, None, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_words int, kept boolean, `row` string")
    got = quality_rules.accepted(docs)
    assert got.columns == docs.columns and got.where("doc_id = 2").count() == 0


def test_plain_parse_gives_the_same_phrases():
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdefghij ") for _ in range(600))
    texts = ["x" * 31 + shared, "yz" + shared + "tail", shared, "", "a", "é日" * 30]
    raw, bounds = vectext.utf8(pa.array(texts))
    together = phrase_prints.parse(raw, bounds, 2)
    for i, t in enumerate(texts):  # a row's names are those that it has alone
        r, b = vectext.utf8(pa.array([t]))
        for (names, cut), (own, _) in zip(together, phrase_prints.parse(r, b, 2), strict=True):
            assert names[cut[i] : cut[i + 1]].tolist() == own.tolist()
    a, b = ({*together[1][0][together[1][1][i] : together[1][1][i + 1]].tolist()} for i in (0, 1))
    assert len(a & b) >= 0.8 * min(len(a), len(b))


def test_hash_bound_keeps_enough():
    assert common.hash_bound(400, 1000) == 2**63 - 1
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 100_000)
    assert 400 < (h <= common.hash_bound(400, 100_000)).sum() < 3000


def test_files_from_elsewhere(tmp_path, monkeypatch):
    from pyarrow import fs

    path = str(tmp_path / "x.bin")
    with open(path, "wb") as f:
        f.write(np.array([3, 8, 4], "<u8").tobytes() + np.arange(3, dtype="<u8").tobytes() + np.arange(3, dtype="<u4").tobytes())
    read = []

    class Elsewhere:
        def open_input_file(self, at):
            read.append(at)
            return fs.LocalFileSystem().open_input_file(at)

    monkeypatch.setattr(ngram_lm, "_FETCHED", {})
    monkeypatch.setattr(ngram_lm, "local_path", lambda _: (Elsewhere(), ""))
    for most, times in ((1 << 20, 1), (0, 3)):
        monkeypatch.setattr(ngram_lm, "FETCHED_BYTES", most)
        for _ in range(2):
            assert [x.tolist() for x in ngram_lm._map("f", path, 2)] == [[0, 1, 2], [0, 1, 2]]
        assert len(read) == times
        ngram_lm._FETCHED.clear()


def test_urls_of_records(spark, tmp_path):
    import gzip
    import pathlib

    from riskloom.llm import warc

    urls = ["http://ü/ä b?x=%20&y=[1]#z", "http://plain/a?b=c%41", "\\x41 ", None, ""]
    pages = spark.createDataFrame([(i, u, "text", "x", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, record_type string, refers_to int")
    manifest = warc.write(pages, f"file://{tmp_path}/w")
    assert {r.page_id: r.url for r in warc.read(manifest).collect()} == dict(enumerate(urls))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in pathlib.Path(tmp_path / "w").glob("*"))
    assert b"WARC-Target-URI: http://%C3%BC/%C3%A4%20b?x=%20&y=[1]#z\r\n" in raw and b"WARC-Target-URI: http://plain/a?b=c%41\r\n" in raw


def test_labels_of_absent_documents_teach_nothing(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    labels = spark.read.parquet(f"{MORE}/labels.parquet").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    more = labels.union(spark.range(10**6, 10**6 + 2000).select("id", (F.col("id") % 2).cast("int")))
    scores = [{r.doc_id: r.score for r in toxic_segments.toxicity(docs, x).collect()} for x in (labels, more)]
    assert scores[0] == scores[1] and len(set(scores[0].values())) > 3


def test_the_sample_holds_different_texts(spark, monkeypatch):
    copies = spark.range(19_000).select(F.col("id").alias("doc_id"), F.lit("the same text again").alias("text"))
    rows = copies.union(spark.range(19_000, 20_000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")))).withColumn("lang", F.lit("en"))
    got = language_id._sample(rows).collect()
    assert len(got) == len({r.text for r in got}) == language_id.TRAIN_PER_LANG and sorted(r.place for r in got) == list(range(1, 401))
    monkeypatch.setattr(language_id, "MAX_LANGS", 5)
    monkeypatch.setattr(language_id, "TRAIN", 20)
    many = rows.withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 30).cast("string"))).union(copies.limit(1).select("doc_id", "text", F.lit("zz")))
    got = language_id._sample(many).collect()
    assert len({r.lang for r in got}) == 5 and len(got) == 20 and "zz" not in {r.lang for r in got}


@pytest.mark.parametrize("letters", ["a", "ab", "etaoin shrdlu", "aé漢😀", "▁a "])
def test_long_words_in_pieces(letters):
    import hashlib
    import time

    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        mine = piece_codec.PieceCodec(f.read())
    rng = random.Random(5)
    for n in (1, 3, 100, 101, 40_000):
        text = "".join(rng.choices(letters, k=n))
        ids = [*theirs.encode(text), theirs.eos_id()]
        assert mine.encode(text) == ids and mine.digest(text)[2] == hashlib.sha256(theirs.decode(ids).encode()).hexdigest()
    began = time.time()
    mine.digest("".join(rng.choices(letters, k=1_000_000)))
    assert time.time() - began < 30


def test_the_store_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(piece_codec, "KEPT_BYTES", 30_000)
    with open(tokenizer("piece_bpe_32k.model"), "rb") as f:
        codec = piece_codec.PieceCodec(f.read())
    texts = [f"word{i} " * 3 + "x" * 500 for i in range(2000)]
    ids = [codec.encode(t) for t in texts]
    assert len(codec.now) + len(codec.old) < 300 and ids == [codec.encode(t) for t in texts] and max(map(len, codec.now)) <= piece_codec.KEPT_CHUNK
