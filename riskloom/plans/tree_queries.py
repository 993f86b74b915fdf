"""Queries on forests. Their twins grow the same trees again in SQL, a level to a table, thresholds one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import rules
from riskloom.operators import trees
from riskloom.plans.registry import query, values

_TREES, _DEPTH, _ISOLATION, _SAMPLE, _LIMIT = 10, 5, 100, 256, 8
_ROUND = "floor({} * 1e6 + 0.5e0) / 1e6"


def _chance(name: str) -> str:
    return f"CAST('0x' || left(md5({name}), 8) AS BIGINT)"


def _forest_sql() -> str:
    u = _chance("'b:' || tree || ':' || coalesce(CAST(vec_id AS VARCHAR), '')") + " / 4294967296e0"
    times = "CASE " + " ".join(f"WHEN u < {p!r}e0 THEN {n}" for n, p in enumerate(trees.POISSON)) + f" ELSE {len(trees.POISSON)} END"
    out = [f"""WITH e AS (SELECT vec_id, CAST(label AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), el AS (SELECT * FROM e WHERE label IS NOT NULL), tr AS (SELECT CAST(unnest(range({_TREES})) AS INTEGER) AS tree),
    dm AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM (SELECT unnest(x) AS v, unnest(range(1, len(x) + 1)) AS dim FROM el) GROUP BY dim),
    ft AS (SELECT tree, dim FROM (SELECT tree, dim, row_number() OVER (PARTITION BY tree ORDER BY md5('f:' || tree || ':' || dim)) AS r FROM tr, dm) WHERE r <= ceil(sqrt((SELECT count(*) FROM dm)))),
    cd AS (SELECT tree, dim, k, lo + (hi - lo) * k / {trees.STEPS}e0 AS cut FROM ft JOIN dm USING (dim), (SELECT unnest(range(1, {trees.STEPS})) AS k)),
    bw AS (SELECT tree, vec_id, label, x, {times} AS w FROM (SELECT *, {u} AS u FROM el, tr)), a0 AS (SELECT tree, CAST(1 AS BIGINT) AS node, vec_id, label, x, w FROM bw WHERE w > 0)"""]
    for i in range(_DEPTH + 1):
        out.append(f"y{i} AS (SELECT tree, node, label, sum(w) AS t FROM a{i} GROUP BY 1, 2, 3), n{i} AS (SELECT tree, node, sum(t) AS n, count(*) AS classes, arg_min(label, (-t, label)) AS best, max(t) AS top FROM y{i} GROUP BY 1, 2)")
        if i < _DEPTH:
            out.append(f"""v{i} AS (SELECT a.tree, a.node, dim, k, cut, label, sum(CASE WHEN x[dim] < cut THEN w ELSE 0 END) AS l, sum(w) AS t FROM a{i} a JOIN n{i} m ON m.tree = a.tree AND m.node = a.node AND n >= 2 AND classes > 1 JOIN cd ON cd.tree = a.tree GROUP BY 1, 2, 3, 4, 5, 6),
            s{i} AS (SELECT tree, node, dim, k, cut, CAST(sum(l) AS DOUBLE) AS na, CAST(sum(t - l) AS DOUBLE) AS nb, CAST(sum(t) AS DOUBLE) AS nt, CAST(sum(l * l) AS DOUBLE) AS qa, CAST(sum((t - l) * (t - l)) AS DOUBLE) AS qb, CAST(sum(t * t) AS DOUBLE) AS qt FROM v{i} GROUP BY 1, 2, 3, 4, 5),
            g{i} AS (SELECT tree, node, dim, k, cut, floor(((1 - qt / (nt * nt)) - (na * (1 - qa / (na * na)) + nb * (1 - qb / (nb * nb))) / nt) * 1e9 + 0.5e0) AS gain FROM s{i} WHERE na > 0 AND nb > 0),
            b{i} AS (SELECT tree, node, dim, cut FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, dim, k) AS r FROM g{i} WHERE gain > 0) WHERE r = 1),
            a{i + 1} AS (SELECT a.tree, 2 * a.node + CASE WHEN x[dim] < cut THEN 0 ELSE 1 END AS node, vec_id, label, x, w FROM a{i} a JOIN b{i} b ON b.tree = a.tree AND b.node = a.node)""")
    out.append("inn AS (" + " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(_DEPTH)) + ")")
    out.append("lf AS (SELECT m.* FROM (" + " UNION ALL ".join(f"SELECT tree, node, n, best, top / n AS confidence, {i} AS depth FROM n{i}" for i in range(_DEPTH + 1)) + ") m LEFT JOIN inn ON inn.tree = m.tree AND inn.node = m.node WHERE inn.node IS NULL)")
    out.append("w0 AS (SELECT vec_id, label, x, tree, CAST(1 AS BIGINT) AS node FROM e, tr)")
    out += [f"w{i + 1} AS (SELECT vec_id, label, x, w.tree, CASE WHEN dim IS NULL THEN w.node ELSE 2 * w.node + CASE WHEN x[dim] < cut THEN 0 ELSE 1 END END AS node FROM w{i} w LEFT JOIN inn ON inn.tree = w.tree AND inn.node = w.node)" for i in range(_DEPTH)]
    out.append(f"vt AS (SELECT vec_id, label, x, best, sum(confidence) AS c, count(*) AS trees FROM w{_DEPTH} w JOIN lf ON lf.tree = w.tree AND lf.node = w.node GROUP BY 1, 2, 3, 4)")
    return ",\n".join(out)


_FOREST = _forest_sql()


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _forest(spark, sf_dir):
    e = _vectors(spark, sf_dir)
    classes = [r.label for r in e.where("label is not null").select(F.col("label").cast("int").alias("label")).distinct().orderBy("label").collect()]  # the classes
    return e, trees.grow_forest(e, classes, _TREES, _DEPTH)


@query(f"{_FOREST} SELECT vec_id, label, best AS prediction, {_ROUND.format(f'c9 / {_TREES}')} AS confidence FROM (SELECT *, floor(c * 1e9 + 0.5e0) / 1e9 AS c9, row_number() OVER (PARTITION BY vec_id ORDER BY floor(c * 1e9 + 0.5e0) DESC, best) AS r FROM vt) WHERE r = 1")
def forest_predictions(spark, sf_dir):
    return trees.classify(*_forest(spark, sf_dir))


@query(f"{_FOREST}, ids AS (SELECT DISTINCT vec_id FROM e), cs AS (SELECT DISTINCT label AS class FROM el) SELECT ids.vec_id, class, {_ROUND.format(f'coalesce(trees, 0) / {_TREES}e0')} AS share FROM ids CROSS JOIN cs LEFT JOIN vt ON vt.vec_id = ids.vec_id AND vt.best = class")
def classify_proba(spark, sf_dir):
    return trees.shares(*_forest(spark, sf_dir))


@query(f"{_FOREST} SELECT tree, CAST(node AS INTEGER) AS node, CAST(dim AS INTEGER) AS dim, cut AS threshold, CAST(NULL AS INTEGER) AS label, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS BIGINT) AS size, CAST(floor(log2(node)) AS INTEGER) AS depth FROM inn UNION ALL SELECT tree, CAST(node AS INTEGER), NULL, NULL, best, {_ROUND.format('confidence')}, CAST(n AS BIGINT), depth FROM lf")
def forest_nodes(spark, sf_dir):
    d = _forest(spark, sf_dir)[1].table(spark)
    return d.withColumn("confidence", F.floor(F.col("confidence") * 1e6 + 0.5) / 1e6)


def isolation_sql(rows: str) -> str:
    """Tables of an isolation forest on ``rows``, SQL of (vec_id, x double[]): inn, lf (leaves with their lengths), sc (scores), th (the threshold)."""
    name = "md5('s:' || coalesce(CAST(vec_id AS VARCHAR), ''))"
    part = lambda i: f"CAST('0x' || substr({name}, {i}, 8) AS BIGINT)"
    order = f"({part(1)} + tree * {part(9)} + tree * tree * {part(17)}) % {trees.SPAN}"
    out = [f"WITH e AS ({rows}), tr AS (SELECT CAST(unnest(range({_ISOLATION})) AS BIGINT) AS tree), nd AS (SELECT max(len(x)) AS dims FROM e)"]
    out.append(f"i0 AS (SELECT tree, CAST(1 AS BIGINT) AS node, x FROM (SELECT tree, x, row_number() OVER (PARTITION BY tree ORDER BY {order}, vec_id NULLS LAST, x) AS r FROM e, tr) WHERE r <= {_SAMPLE})")
    for i in range(_LIMIT + 1):
        out.append(f"n{i} AS (SELECT tree, node, dim, count(*) AS n, min(x[dim]) AS lo, max(x[dim]) AS hi FROM (SELECT *, {_chance('''concat('i:', tree, ':', node)''')} % dims + 1 AS dim FROM i{i}, nd) GROUP BY 1, 2, 3)")
        if i < _LIMIT:
            out.append(f"b{i} AS (SELECT tree, node, dim, lo + (hi - lo) * ({_chance('''concat('u:', tree, ':', node)''')} / 4294967296e0) AS cut FROM n{i} WHERE n > 1 AND lo < hi)")
            out.append(f"i{i + 1} AS (SELECT s.tree, 2 * s.node + CASE WHEN x[dim] <= cut THEN 0 ELSE 1 END AS node, x FROM i{i} s JOIN b{i} b ON b.tree = s.tree AND b.node = s.node)")
    out.append("inn AS (" + " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(_LIMIT)) + ")")
    length = lambda n: f"(2e0 * (ln({n} - 1) + 0.5772156649e0) - 2e0 * ({n} - 1) / {n})"
    out.append("lf AS (SELECT m.tree, m.node, n, depth, depth + CASE WHEN n > 1 THEN " + length("n") + " ELSE 0e0 END AS length FROM (" + " UNION ALL ".join(f"SELECT tree, node, n, {i} AS depth FROM n{i}" for i in range(_LIMIT + 1)) + ") m LEFT JOIN inn ON inn.tree = m.tree AND inn.node = m.node WHERE inn.node IS NULL)")
    out.append(_walk("w", "SELECT vec_id, 0 AS which, x FROM e"))
    out.append(f"sc AS (SELECT vec_id, {_ROUND.format(f'pow(2e0, -(total / {_ISOLATION}) / {length(_SAMPLE)})')} AS score FROM w)")
    out.append("th AS (SELECT score AS bound FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS r, count(*) OVER () AS n FROM sc) WHERE r = greatest(1, ceil(0.1 * n)))")
    return ",\n".join(out)


def _walk(name: str, rows: str) -> str:
    """(vec_id, which, x) rows walked down all trees: total is the sum of their lengths."""
    out = [f"{name}0 AS (SELECT r.*, tree, CAST(1 AS BIGINT) AS node FROM ({rows}) r, tr)"]
    out += [f"{name}{i + 1} AS (SELECT vec_id, which, x, w.tree, CASE WHEN dim IS NULL THEN w.node ELSE 2 * w.node + CASE WHEN x[dim] <= cut THEN 0 ELSE 1 END END AS node FROM {name}{i} w LEFT JOIN inn ON inn.tree = w.tree AND inn.node = w.node)" for i in range(_LIMIT)]
    return ",\n".join(out) + f",\n{name} AS (SELECT vec_id, which, x, sum(length) AS total FROM {name}{_LIMIT} w JOIN lf ON lf.tree = w.tree AND lf.node = w.node GROUP BY 1, 2, 3)"


_ISOLATED = isolation_sql("SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings")


@query(f"{_ISOLATED} SELECT vec_id, score FROM sc")
def isolation_scores(spark, sf_dir):
    e = _vectors(spark, sf_dir)
    return trees.detect(e, trees.isolation_forest(e, _ISOLATION, _SAMPLE)).select("vec_id", "score")


@query(f"{_ISOLATED} SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS INTEGER) AS node, CAST(dim AS INTEGER) AS dim, cut AS threshold, CAST(NULL AS BIGINT) AS size FROM inn UNION ALL SELECT CAST(tree AS INTEGER), CAST(node AS INTEGER), NULL, NULL, n FROM lf")
def isolation_nodes(spark, sf_dir):
    return trees.isolation_forest(_vectors(spark, sf_dir), _ISOLATION, _SAMPLE).table(spark).select("tree", "node", "dim", "threshold", "size")


@query(f"{_ISOLATED} SELECT vec_id, score, score >= bound AS is_anomaly FROM sc, th")
def detected_anomalies(spark, sf_dir):
    e = _vectors(spark, sf_dir)
    return trees.detect(e, trees.fit_detector(e))


_LENGTH = f"{trees.average_path_length(_SAMPLE)!r}e0"


@query(f"""{_ISOLATED}, mn AS (SELECT dim, avg(v) AS m FROM (SELECT unnest(x) AS v, unnest(range(1, len(x) + 1)) AS dim FROM e) GROUP BY dim), odd AS (SELECT sc.vec_id, sc.score, w.x, pow(2e0, -(total / {_ISOLATION}) / {_LENGTH}) AS own FROM sc JOIN w USING (vec_id), th WHERE sc.score >= bound),
    {_walk('c', "SELECT vec_id, dim AS which, list_concat(list_append(x[:dim - 1], m), x[dim + 1:]) AS x FROM odd, mn")},
    im AS (SELECT c.vec_id, odd.score, which AS dim, {_ROUND.format(f'(own - pow(2e0, -(total / {_ISOLATION}) / {_LENGTH}))')} AS impact FROM c JOIN odd USING (vec_id)),
    pl AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY impact DESC, dim) AS place FROM im WHERE impact > 0.01e0)
    SELECT vec_id, score, CAST(place AS INTEGER) AS place, CAST(dim AS INTEGER) AS dim, impact, array_to_string(coalesce(classes, []), ',') AS classes FROM pl LEFT JOIN ({values([(k, v) for k, v in rules.FEATURE_CLASSES.items()])}) t(number, classes) ON number = dim WHERE place <= 5""")
def anomaly_reasons(spark, sf_dir):
    e = _vectors(spark, sf_dir)
    return trees.reasons(e, trees.fit_detector(e))
