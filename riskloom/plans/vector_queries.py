"""Queries on vectors of files, and on what is learned from vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import rules
from riskloom.operators import training, vectors
from riskloom.operators.ml import rounded
from riskloom.plans.code_queries import _FEATURES
from riskloom.plans.registry import q, query, values
from riskloom.sources.code import LINES_SQL, files
from riskloom.sources.views import FINDINGS_SQL, findings

_R = "floor({} * 1e6 + 0.5e0) / 1e6"
_COMMENTS = f"""sl AS (SELECT path, language, line_no, trim(text, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS t FROM lines), """
_WORDS = [(w, i + 1) for i, w in enumerate(rules.VECTOR_WORDS)]
_VECTOR = f"""{_FEATURES}, {LINES_SQL}, tk AS (SELECT path, unnest(regexp_extract_all(content, {q(rules.TOKEN)})) AS tok FROM files), tn AS (SELECT path, count(*) AS n, count(DISTINCT tok) AS nd FROM tk GROUP BY path),
    vw(word, dim) AS ({values(_WORDS)}), nb AS (SELECT path, string_split(regexp_replace(content, '[^\\[\\](){{}}]', '', 'g'), '') AS cs FROM files), nu AS (SELECT path, unnest(cs) AS ch, unnest(range(1, len(cs) + 1)) AS i FROM nb),
    ns AS (SELECT path, i, sum(CASE WHEN ch IN ('(', '[', '{{') THEN 1 WHEN ch IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS d FROM nu), nm AS (SELECT path, d - least(0, min(d) OVER (PARTITION BY path ORDER BY i)) AS depth FROM ns), nx AS (SELECT path, max(depth) AS nesting FROM nm GROUP BY path),
    ec AS (SELECT path, unnest(string_split(content, '')) AS ch FROM files), en AS (SELECT path, ch, count(*) AS k FROM ec WHERE ch <> '' GROUP BY 1, 2), et AS (SELECT path, CAST(sum(k) AS DOUBLE) AS n FROM en GROUP BY 1), eh AS (SELECT path, sum(-(k / n) * log2(k / n)) AS h FROM en JOIN et USING (path) GROUP BY 1),
    base AS (SELECT feats.*, files.content, coalesce(tn.n, 0) AS n_tokens, CASE WHEN tn.n > 0 THEN nd / tn.n ELSE 0e0 END AS diversity, coalesce(nesting, 0) AS nesting, coalesce(h, 0e0) AS entropy FROM feats JOIN files ON files.path = feats.path LEFT JOIN tn ON tn.path = feats.path LEFT JOIN nx ON nx.path = feats.path LEFT JOIN eh ON eh.path = feats.path),
    raw AS (SELECT path, dim, CAST(count(*) AS DOUBLE) AS v FROM tk JOIN vw ON lower(tok) = word GROUP BY 1, 2 UNION ALL SELECT path, 65, n_tokens / 1000e0 FROM base UNION ALL SELECT path, 66, complexity / 50e0 FROM base UNION ALL SELECT path, 67, nesting / 10e0 FROM base
        UNION ALL SELECT path, 68, (length(content) - length(replace(content, chr(10), ''))) / 500e0 FROM base UNION ALL SELECT path, 69, entropy / 8e0 FROM base UNION ALL SELECT path, 70, diversity FROM base
        UNION ALL {' UNION ALL '.join(f"SELECT path, {97 + i}, len(regexp_extract_all(content, {q(r)})) / 10e0 FROM base" for i, r in enumerate(rules.VECTOR_REGEXES))}),
    norm AS (SELECT path, sqrt(sum(v * v)) AS n FROM raw GROUP BY path), emb AS (SELECT raw.path, dim, v / n AS v FROM raw JOIN norm ON norm.path = raw.path WHERE n > 0 AND v <> 0)"""


def _long(d, name):
    e = d.select("path", F.posexplode(name).alias("pos", "v")).where("v <> 0")
    return e.select("path", (F.col("pos") + 1).alias("dim"), rounded(F.col("v")).alias("value"))


@query(f"{_VECTOR} SELECT path, CAST(dim AS INTEGER) AS dim, {_R.format('v')} AS value FROM emb")
def code_embedding_128(spark, sf_dir):
    return _long(vectors.code_embeddings(files(spark, sf_dir)), "embedding")


def _mark(language, kind):
    prefixes, begin, end = rules.COMMENTS[language]
    return {"prefix": "(" + " OR ".join(f"starts_with(t, {q(p)})" for p in prefixes) + ")", "begin": f"contains(t, {q(begin)})", "end": f"contains(t, {q(end)})"}[kind]


def _marks(kind, default):
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {_mark(k, kind)}" for k in rules.COMMENTS if k != "*") + f" ELSE {default} END"


@query(f"""{_VECTOR}, {_COMMENTS} ce AS (SELECT *, {_marks('begin', 'false')} AS has_begin, {_marks('end', 'false')} AS has_end, {_marks('prefix', "starts_with(t, '#')")} AS has_prefix FROM sl),
    cv AS (SELECT *, CASE WHEN t = '' THEN NULL WHEN has_end THEN 0 WHEN has_begin THEN 1 END AS ev FROM ce), cw AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM cv),
    cm AS (SELECT path, count(*) AS loc, count(*) FILTER (t <> '' AND (has_end OR has_begin OR inside = 1 OR has_prefix)) AS note FROM cw GROUP BY path),
    own AS (SELECT base.path, unnest([complexity, nesting, loc, functions, inputs, sinks, crypto, memory, file_ops, network, dangerous, taint_flows, unchecked, pointers, entropy, diversity, note / loc]) AS v, unnest(range(1, 18)) AS dim FROM base JOIN cm ON cm.path = base.path)
    SELECT path, CAST(dim AS INTEGER) AS dim, {_R.format('CAST(v AS DOUBLE)')} AS value FROM own WHERE v <> 0 UNION ALL SELECT path, CAST(dim + 17 AS INTEGER), {_R.format('v')} FROM emb WHERE dim + 17 <= 144""")
def feature_vector_160(spark, sf_dir):
    return _long(vectors.feature_vectors(files(spark, sf_dir)), "x")


_LONG = "e AS (SELECT vec_id, label, unnest(embedding) AS x0, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings), l AS (SELECT vec_id, label, CAST(x0 AS DOUBLE) AS x, CAST(dim AS INTEGER) AS dim FROM e)"


@query(f"WITH {_LONG}, s AS (SELECT dim, avg(x) AS mean, stddev_samp(x) AS dev FROM l GROUP BY dim) SELECT vec_id, dim, floor((x - mean) / (CASE WHEN dev > 0 THEN dev ELSE 1e0 END) * 1e5 + 0.5e0) / 1e5 AS z FROM l JOIN s USING (dim)")
def zscore_features(spark, sf_dir):
    z = vectors.zscore(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return z.withColumn("z", F.floor(F.col("z") * F.lit(1e5) + F.lit(0.5)) / F.lit(1e5))


def _labels(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e, [r.label for r in e.where("label is not null").select("label").distinct().orderBy("label").collect()]  # the classes


@query(f"""WITH {_LONG}, d AS (SELECT dim, x, label, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY 1, 2, 3), xs AS (SELECT DISTINCT dim, x FROM d), ls AS (SELECT DISTINCT label FROM d),
    g AS (SELECT xs.dim, xs.x, ls.label, coalesce(n, 0) AS n FROM xs CROSS JOIN ls LEFT JOIN d ON d.dim = xs.dim AND d.x = xs.x AND d.label = ls.label),
    c AS (SELECT *, sum(n) OVER (PARTITION BY dim, label ORDER BY x) AS a, sum(n) OVER (PARTITION BY dim, label) AS t FROM g),
    k AS (SELECT dim, x, sum(a) AS na, sum(t - a) AS nb, sum(t) AS nt, sum(a * a) AS qa, sum((t - a) * (t - a)) AS qb, sum(t * t) AS qt FROM c GROUP BY 1, 2),
    v AS (SELECT dim, x, floor(((1e0 - qt / (nt * nt)) - (na * (1e0 - qa / (na * na)) + nb * (1e0 - qb / (nb * nb))) / nt) * 1e9 + 0.5e0) / 1e9 AS gain FROM k WHERE nb > 0)
    SELECT dim, x AS threshold, gain FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY gain DESC, x) AS place FROM v) WHERE place = 1""")
def best_split(spark, sf_dir):
    return training.best_splits(*_labels(spark, sf_dir))


_SCORED = "sc AS (SELECT id, least(1e0, floor(value) / 250e0) AS score FROM f JOIN events ON event_id = id)"


@query(f"""WITH f AS ({FINDINGS_SQL}), {_SCORED} SELECT id, score, floor((rank() OVER (ORDER BY score) - 1) / count(*) OVER () * 100 * 1e6 + 0.5e0) / 1e6 AS percentile,
    CASE WHEN score >= 0.8e0 THEN 'CRITICAL' WHEN score >= 0.6e0 THEN 'HIGH' WHEN score >= 0.4e0 THEN 'MEDIUM' ELSE 'LOW' END AS level, score >= 0.6e0 AS is_anomaly FROM sc""")
def anomaly_verdicts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    d = findings(spark, sf_dir).select("id").join(e.select(F.col("event_id").alias("id"), F.least(F.lit(1.0), F.floor("value") / F.lit(250.0)).alias("score")), "id")
    return training.verdicts(d)


@query(f"SELECT l_orderkey, l_linenumber, array_to_string(coalesce(classes, []), ',') AS classes FROM lineitem LEFT JOIN ({values([(k, v) for k, v in rules.FEATURE_CLASSES.items()])}) t(number, classes) ON number = l_linenumber + CAST(l_quantity AS INTEGER) % 11")
def feature_classes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = F.col("l_linenumber") + F.rint("l_quantity").cast("int") % 11
    return d.select("l_orderkey", "l_linenumber", F.array_join(training.classes_of_feature(n), ",").alias("classes"))
