"""Queries on models that are fitted by descent. Their twins take the same steps in SQL, an epoch to a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import rules
from riskloom.operators import token_vectors, training
from riskloom.operators.ml import rounded
from riskloom.plans.registry import q, query, values

_EPOCHS, _RATE, _HIDDEN = 20, 1.0, (16, 8)
_ROUND = "floor({} * 1e6 + 0.5e0) / 1e6"


def _vectors(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e, [r.label for r in e.where("label is not null").select(F.col("label").cast("int").alias("label")).distinct().orderBy("label").collect()]  # the classes


def _descent(learns: str) -> str:
    """Tables of a logistic fit to the rows that ``learns`` holds for: pred has vec_id, label and prediction of all rows."""
    out = [f"""WITH e AS (SELECT vec_id, CAST(label AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), l AS MATERIALIZED (SELECT vec_id, label, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS dim FROM e),
    fits AS MATERIALIZED (SELECT vec_id FROM e WHERE label IS NOT NULL AND {learns}), cnt AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM fits), cls AS (SELECT DISTINCT label AS class FROM e WHERE label IS NOT NULL),
    sc AS MATERIALIZED (SELECT dim, avg(v) AS mean, CASE WHEN stddev_samp(v) > 0 THEN stddev_samp(v) ELSE 1e0 END AS dev FROM l SEMI JOIN fits USING (vec_id) GROUP BY dim),
    z AS MATERIALIZED (SELECT vec_id, label, dim, (v - mean) / dev AS v FROM l JOIN sc USING (dim) UNION ALL SELECT vec_id, label, 0, 1e0 FROM e), zf AS MATERIALIZED (SELECT z.* FROM z SEMI JOIN fits USING (vec_id)),
    w0 AS MATERIALIZED (SELECT class, dim, 0e0 AS w FROM cls, (SELECT DISTINCT dim FROM z))"""]
    for i in range(_EPOCHS):
        out.append(f"p{i} AS MATERIALIZED (SELECT vec_id, class, 1e0 / (1e0 + exp(-greatest(-500e0, least(500e0, sum(v * w))))) - CASE WHEN label = class THEN 1e0 ELSE 0e0 END AS off FROM zf JOIN w{i} USING (dim) GROUP BY vec_id, label, class)")
        out.append(f"w{i + 1} AS MATERIALIZED (SELECT w.class, w.dim, w - {_RATE}e0 * g / n AS w FROM w{i} w JOIN (SELECT class, dim, sum(off * v) AS g FROM p{i} JOIN zf USING (vec_id) GROUP BY 1, 2) d ON d.class = w.class AND d.dim = w.dim, cnt)")
    out.append(f"pred AS (SELECT vec_id, label, class AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, class) AS r FROM (SELECT vec_id, label, class, sum(v * w) AS s FROM z JOIN w{_EPOCHS} USING (dim) GROUP BY 1, 2, 3)) WHERE r = 1)")
    return ",\n".join(out)


@query(f"{_descent('true')} SELECT vec_id, label, prediction FROM pred")
def logreg_train(spark, sf_dir):
    e, classes = _vectors(spark, sf_dir)
    return training.classify(e, training.train_logistic(e, classes, _EPOCHS, _RATE)).select("vec_id", "label", "prediction")


_HELD = f"CAST('0x' || left(md5('h:' || coalesce(CAST(vec_id AS VARCHAR), '')), 8) AS BIGINT) % {training.PARTS} = 0"


@query(f"""{_descent(f"NOT ({_HELD})")}, o AS (SELECT label, prediction FROM pred WHERE label IS NOT NULL AND {_HELD}), k AS (SELECT class, (SELECT count(*) FROM o WHERE label = class AND prediction = class) AS tp, (SELECT count(*) FROM o WHERE prediction = class) AS p, (SELECT count(*) FROM o WHERE label = class) AS a FROM cls),
    m AS (SELECT avg(CASE WHEN p > 0 THEN tp / p ELSE 0e0 END) AS pr, avg(CASE WHEN a > 0 THEN tp / a ELSE 0e0 END) AS re, sum(tp) / sum(a) AS hit, sum(a) AS n FROM k)
    SELECT CAST(n AS BIGINT) AS n, {_ROUND.format('hit')} AS accuracy, {_ROUND.format('pr')} AS "precision", {_ROUND.format('re')} AS recall, {_ROUND.format('(2e0 * pr * re / (pr + re + 1e-10))')} AS f1 FROM m""")
def logreg_evaluation(spark, sf_dir):
    e, classes = _vectors(spark, sf_dir)
    return training.evaluate_logistic(e, classes, _EPOCHS, _RATE)


def _layer(name: str, w, b) -> str:
    rows = [(i, j, float(v)) for i, r in enumerate(w.tolist(), 1) for j, v in enumerate([*r, 0.0], 1)]
    rows = [(i, j, float(b[i - 1]) if j == w.shape[1] + 1 else v) for i, j, v in rows]
    return f"{name}(o, i, w) AS ({values(rows)})"


def _autoencoder() -> str:
    """The first layers are fixed values, a row of a layer's table for each weight, the last for the bias; the last layer is fitted."""
    ae, dim, epochs, rate = training.Autoencoder(64, _HIDDEN), 64, 10, 0.1
    layers = [*ae.encoder, *ae.decoder[:-1]]
    out = ["WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), " + ", ".join(_layer(f"f{k}", w, b) for k, (w, b) in enumerate(layers))]
    out.append("v0 AS MATERIALIZED (SELECT vec_id, unnest(list_append(x, 1e0)) AS v, unnest(range(1, len(x) + 2)) AS i FROM e), c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM e)")
    for k, (w, _) in enumerate(layers):
        out.append(f"v{k + 1} AS MATERIALIZED (SELECT vec_id, greatest(sum(v * w), 0e0) AS v, o AS i FROM v{k} JOIN f{k} USING (i) GROUP BY vec_id, o UNION ALL SELECT vec_id, 1e0, {w.shape[0] + 1} FROM e)")
    h, (w, b) = len(layers), ae.decoder[-1]
    out += [_layer("g0", w, b), f"xs AS MATERIALIZED (SELECT vec_id, i AS o, v AS x FROM v0 WHERE i <= {dim})"]
    for k in range(epochs):
        out.append(f"r{k} AS MATERIALIZED (SELECT s.vec_id, s.o, y - x AS off FROM (SELECT vec_id, o, sum(v * w) AS y FROM v{h} JOIN g{k} USING (i) GROUP BY 1, 2) s JOIN xs ON xs.vec_id = s.vec_id AND xs.o = s.o)")
        out.append(f"g{k + 1} AS MATERIALIZED (SELECT g.o, g.i, w - {rate}e0 * d / n / {dim} AS w FROM g{k} g JOIN (SELECT o, i, sum(2e0 * off * v) AS d FROM r{k} JOIN v{h} USING (vec_id) GROUP BY 1, 2) s ON s.o = g.o AND s.i = g.i, c)")
    out.append(f"er AS (SELECT s.vec_id, avg((y - x) * (y - x)) AS error FROM (SELECT vec_id, o, sum(v * w) AS y FROM v{h} JOIN g{epochs} USING (i) GROUP BY 1, 2) s JOIN xs ON xs.vec_id = s.vec_id AND xs.o = s.o GROUP BY 1)")
    return ",\n".join(out)


@query(f"{_autoencoder()} SELECT vec_id, {_ROUND.format('error')} AS error, error > (SELECT quantile_cont(error, 0.95) FROM er) AS is_anomaly FROM er")
def autoencoder_errors(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return training.autoencoder_errors(e, training.train_autoencoder(e, _HIDDEN)).withColumn("error", rounded(F.col("error")))


_DIM, _STEPS, _PULL, _MARGIN = 16, 2, 0.3, 0.3


def _embeddings() -> str:
    """The steps of the token table in SQL; e<n> has the documents' embeddings by the table of step n."""
    pieces = "|".join(rules.TOKEN_PIECES)
    out = [f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS content FROM documents), ts AS MATERIALIZED (SELECT doc_id, lang, list_concat(['<BOS>'], list_append(list_transform(regexp_extract_all(content, {q(pieces)}), lambda x: left(lower(x), 20)), '<EOS>')) AS ts FROM d),
    tk AS MATERIALIZED (SELECT doc_id, unnest(ts) AS token, unnest(range(1, len(ts) + 1)) AS i, len(ts) AS n FROM ts), own AS MATERIALIZED (SELECT DISTINCT doc_id, token FROM tk),
    dv(token) AS ({values([(w,) for w in dict.fromkeys([token_vectors.PAD, token_vectors.UNKNOWN, *rules.DEFAULT_VOCAB])])}), voc AS MATERIALIZED (SELECT token FROM own WHERE token NOT IN ('<BOS>', '<EOS>') GROUP BY token HAVING count(*) >= 5 UNION SELECT token FROM dv),
    q0 AS MATERIALIZED (SELECT token, dim, (CAST('0x' || left(md5(token || ':' || dim), 8) AS BIGINT) / 4294967296e0 - 0.5e0) * 0.34e0 AS v FROM voc, (SELECT unnest(range(1, {_DIM + 1})) AS dim)),
    ct AS MATERIALIZED (SELECT doc_id, coalesce(voc.token, '<UNK>') AS token, count(*) AS k FROM tk LEFT JOIN voc ON voc.token = tk.token GROUP BY 1, 2), nn AS (SELECT doc_id, sum(k) AS n FROM ct GROUP BY 1),
    pc AS (SELECT doc_id, least({_DIM // 4}, ceil(i * {_DIM // 4} / n)) AS part, count(*) AS c FROM tk WHERE token IN ({', '.join(q(w) for w in sorted(rules.SENSITIVE))}) GROUP BY 1, 2), pl AS (SELECT doc_id, sum(c * c) / max(c) / max(c) AS square FROM pc GROUP BY 1),
    pr AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, a.lang IS NOT DISTINCT FROM b.lang AS alike FROM d a JOIN d b ON a.doc_id % 2 = 0 AND b.doc_id = a.doc_id + 1),
    ro AS MATERIALIZED (SELECT a, alike, token, sum(side) AS role FROM (SELECT a, alike, token, 1 AS side FROM pr JOIN own ON doc_id = a UNION ALL SELECT a, alike, token, 2 FROM pr JOIN own ON doc_id = b) SEMI JOIN voc USING (token) GROUP BY 1, 2, 3 HAVING alike = (sum(side) = 3))"""]
    for i in range(_STEPS + 1):
        out.append(f"m{i} AS MATERIALIZED (SELECT doc_id, dim, sum(k * v) / max(n) AS x FROM ct JOIN q{i} USING (token) JOIN nn USING (doc_id) GROUP BY 1, 2), e{i} AS MATERIALIZED (SELECT doc_id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id) + coalesce(square, 0)) AS x FROM m{i} LEFT JOIN pl USING (doc_id))")
        if i < _STEPS:
            out.append(f"""s{i} AS (SELECT a, alike, sum(u.x * w.x) / (sqrt(sum(u.x * u.x)) * sqrt(sum(w.x * w.x))) AS sim FROM pr JOIN e{i} u ON u.doc_id = a JOIN e{i} w ON w.doc_id = b AND w.dim = u.dim GROUP BY 1, 2),
            t{i} AS MATERIALIZED (SELECT ro.a, role, token, dim, v FROM ro JOIN s{i} s ON s.a = ro.a AND CASE WHEN s.alike THEN 1 - sim ELSE sim - {_MARGIN} END > 0 JOIN q{i} USING (token)), n{i} AS MATERIALIZED (SELECT a, role, dim, avg(v) AS x FROM t{i} GROUP BY 1, 2, 3),
            g{i} AS (SELECT token, t.dim, avg(CASE WHEN t.role = 3 THEN n.x - v ELSE n.x - o.x END) AS x FROM t{i} t JOIN n{i} n ON n.a = t.a AND n.role = t.role AND n.dim = t.dim LEFT JOIN n{i} o ON o.a = t.a AND o.role = 3 - t.role AND o.dim = t.dim GROUP BY 1, 2),
            q{i + 1} AS MATERIALIZED (SELECT p.token, p.dim, p.v + {_PULL} * coalesce(x, 0) AS v FROM q{i} p LEFT JOIN g{i} g ON g.token = p.token AND g.dim = p.dim)""")
    return ",\n".join(out)


@query(f"{_embeddings()} SELECT doc_id, CAST(dim AS INTEGER) AS dim, {_ROUND.format('x')} AS value FROM e{_STEPS}")
def learned_embeddings(spark, sf_dir):
    """Neighbours by doc_id are a pair, alike where they have one language; all documents are embedded, whole."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang")
    mine, other = d.where("id % 2 = 0").select("id", F.col("lang").alias("la")), d.select((F.col("id") - 1).alias("id"), F.col("lang").alias("lb"))
    pairs = mine.join(other, "id").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.col("la").eqNullSafe(F.col("lb")).alias("alike"))
    params = token_vectors.first_vectors(token_vectors.vocabulary(d.select("id", F.coalesce("content", F.lit("")).alias("content"))), _DIM)
    _, _, vectors = token_vectors.fit(d, pairs, params, _DIM, _STEPS, _PULL, _MARGIN, None, None)
    out = vectors.select(F.col("id").alias("doc_id"), F.posexplode("v").alias("at", "x"))
    return out.select("doc_id", (F.col("at") + 1).alias("dim"), rounded(F.col("x")).alias("value"))
