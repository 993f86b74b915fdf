"""The queries of this subpackage's operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.common import table
from riskloom.llm.ngram_jaccard import jaccard_join
from riskloom.llm import language_id, ngram_lm, page_text, phrase_prints, piece_codec, source_mixing, spelling, token_shards, toxic_segments, warc, whitening
from riskloom.llm.quality_rules import quality


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(table(spark, sf_dir, "pages"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf_dir, "documents"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_prints.fingerprints(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_segments.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.lm_scores(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("lang", "source")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.page_texts(table(spark, sf_dir, "pages"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_warc": op2_warc,
    "op3_source_mixing": op3_source_mixing,
    "op4_token_shards": op4_token_shards,
    "op5_fingerprints": op5_fingerprints,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_toxicity": op8_toxicity,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_quality": op10_quality,
    "op11_html_extraction": op11_html_extraction,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_whitening": op13_whitening,
}

SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), g AS (
            SELECT payload_digest, max(page_id) AS response FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, p.payload_digest,
               CASE WHEN response IS NOT NULL AND page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to
        FROM p LEFT JOIN g USING (payload_digest)
    """,
    "op6_ngram_jaccard": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ), i AS (
            SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS t FROM i
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), l AS (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
        ), r AS (
            SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
        ), c AS (
            SELECT a, min(b) AS component_id FROM r GROUP BY a
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id
    """,
    # crc32 bit by bit: a byte is brought in, then eight steps
    "op12_spelling_variants": """
        WITH RECURSIVE r AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents
        ), d AS (
            SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS s, run, count(*) AS n FROM r GROUP BY doc_id, run HAVING length(run) >= 5
        ), b AS (
            SELECT run, n, flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64]::BIGINT[] END)) AS bytes FROM d
        ), h AS (
            SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(bytes, lambda x: [x, -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]))),
                lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END), 4294967295::BIGINT) AS h FROM b
        ), w AS (
            SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1
        ), v AS MATERIALIZED (
            SELECT word, n FROM w WHERE length(word) >= 5 AND n >= 3
        ), i AS (
            SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v
        ), same AS (
            SELECT word, n, i, left(word, i - 1) || '_' || substr(word, i + 1) AS k FROM i
        ), gap AS (
            SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS k FROM i
        ), p AS (
            SELECT a.word, b.word AS near, b.n AS m FROM same a JOIN same b ON a.k = b.k AND a.word <> b.word
            UNION ALL SELECT gap.word, v.word, v.n FROM gap JOIN v ON v.word = gap.k
            UNION ALL SELECT v.word, gap.word, gap.n FROM gap JOIN v ON v.word = gap.k
        ), g AS (
            SELECT word, count(*) AS n_near, min((-m, near)) AS best FROM p GROUP BY word
        ), f AS (
            SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * n THEN -best[1] END AS form_n FROM v LEFT JOIN g USING (word)
        ), t AS (
            SELECT word, word AS at FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.at WHERE f.form IS NOT NULL
        ), e AS (
            SELECT t.word, t.at AS root FROM t JOIN f ON f.word = t.at WHERE f.form IS NULL
        )
        SELECT f.word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
    """,
}
