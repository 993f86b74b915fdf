"""Quality rules: base rules, then robust multivariate outliers by minimum covariance determinant.

DataFrame functions only; nothing here runs Python on the executors. For each
language and source, the search has four starts (medians with median absolute
deviations, with correlations of tanh scores, with those of spatial signs, and lower
quartiles). Each takes concentration steps until its determinant settles: the mean and
covariance of the (n + p + 1) / 2 texts that lie nearest give the next distances. The
least determinant wins. A reweighted last step uses the texts within the 0.975 quantile.
Each different text counts once, so copies of one, however many, can't take over; of
texts that tie at the edge of the nearest, only as much weight counts as is missing.
Quantiles come from counts per narrow bin, which add up in any order, so reruns agree
and no group is sorted.

The statistics of short texts vary more: the variance of the root of a share (and of the log of a mean) over n units
is a share of the group's, 1 + N0 / n. Deviations are divided by its root before anything is made of them, so short
texts weigh less in the estimate and need to deviate further to be rejected, but no text is watered down.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import materialize

#: different texts that a group needs for an estimate of its own; those of smaller ones pool by language, then altogether
LEAST_ROWS = 50
#: a start's search ends when a step lowers the log of the determinant by no more than this
SETTLED = 1e-3
#: chi-square figures for 5 dimensions: the 0.975 quantile; what makes the covariance of the nearest half, and of those within 0.975, consistent
WITHIN, CONSISTENT, REWEIGHTED = 12.833, 1.912, 1.055
#: squared distance beyond which a document is rejected (chi-square of 5 dimensions, tail 0.001)
CUTOFF = 20.515
#: least standard deviation of each statistic, as most documents have no symbols, repeats or capitals beyond the usual
FLOORS = (0.02, 0.04, 0.04, 0.04, 0.04)
#: units (words, letters) of a text at which chance adds as much variance as texts have among themselves; repeated words come in passages of 16 at least
N0 = {"vw": ("n_words", 100), "vc": ("word_chars", 150), "vr": ("n_words", 1600)}
P = len(FLOORS)
X = [f"x{i}" for i in range(P)]
#: the scale of each statistic's deviations
V = ["vw", "vc", "vr", "vc", "vw"]


def statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """row (the columns ``carry``), lang, source, a hash of the text and the counts of every row of ``docs`` (see ``quality``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    d = d.select(
        "row",
        "lang",
        "source",
        F.xxhash64("text").alias("text_hash"),
        F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    d = d.select(
        "row", "lang", "source", "text_hash", "n_symbols", "n_upper",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    d = d.withColumn("n_adjacent", F.size(F.filter("hashes", lambda h, i: h.eqNullSafe(F.get("hashes", i - 1)))).cast("long"))
    d = d.withColumn("windows", F.when(F.size("hashes") >= 8, F.transform(F.sequence(F.lit(1), F.size("hashes") - 7), lambda i: F.xxhash64(F.slice("hashes", i, 8)))).otherwise(F.array().cast("array<bigint>"))).drop("hashes")
    d = d.withColumn("windows", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.col("windows")))
    d = d.withColumn("windows", F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    same = lambda x, k: x["h"].eqNullSafe(F.get("windows", k)["h"])
    d = d.withColumn("at", F.filter(F.transform("windows", lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda i: i.isNotNull())).drop("windows")
    d = d.withColumn("at", F.sort_array("at"))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct((i + 8).alias("end"), (a["n"] + i + 8 - F.greatest(a["end"], i)).cast("long").alias("n")),
        lambda a: a["n"],
    )
    return d.select("row", "lang", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "n_lines", "n_upper", "n_adjacent")


def _vector(d: DataFrame) -> DataFrame:
    """The transformed statistics; square roots of shares and the log of a mean are near normal for clean texts."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return d.withColumns({
        "x0": F.log(chars / words),
        "x1": F.sqrt(F.col("n_symbols") / chars),
        "x2": F.sqrt(F.col("n_repeat_words") / words),
        "x3": F.sqrt(F.col("n_upper") / chars),
        "x4": F.sqrt(F.col("n_adjacent") / words),
        **{v: F.sqrt(F.greatest(n, F.lit(1)) / (F.greatest(n, F.lit(1)) + n0)) for v, (n, n0) in N0.items()},
    })


def _grouped(d: DataFrame, least_rows: int) -> DataFrame:
    """Adds gid: language and source where they have texts enough, else the pool of the language, else that of all.

    The tables of groups are written first, so their size is known: they are broadcast under Spark's bound, else shuffled.
    """
    texts = d.where("not base_failed").select("lang", "source", "text_hash").distinct()
    n = texts.groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = materialize(n.where(F.col("n") >= least_rows).select(F.col("lang").alias("l"), F.col("source").alias("s"), F.lit(True).alias("own")), "groups")
    rest = texts.join(own, texts["lang"].eqNullSafe(own["l"]) & texts["source"].eqNullSafe(own["s"]), "left_anti").select("lang", "text_hash").distinct()
    few = materialize(rest.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= least_rows).select(F.col("lang").alias("l2"), F.lit(True).alias("pool")), "pools")
    d = d.join(own, d["lang"].eqNullSafe(own["l"]) & d["source"].eqNullSafe(own["s"]), "left").join(few, d["lang"].eqNullSafe(few["l2"]), "left")
    # lengths keep (a, bc) and (ab, c) apart
    lang = F.coalesce(F.concat(F.char_length("lang").cast("string"), F.lit(":"), F.col("lang")), F.lit("-"))
    gid = F.when(F.col("own"), F.concat(lang, F.lit("/"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))).when(F.col("pool"), lang).otherwise(F.lit("*"))
    return d.withColumn("gid", gid).drop("l", "s", "own", "l2", "pool")


def _quantile(d: DataFrame, by: list[str], value: str, share: float, step: float) -> DataFrame:
    """The upper edge of the bin at which a share of the rows is reached. At most some thousand bins a group meet in a window."""
    bins = d.groupBy(*by, F.floor(F.col(value) / step).alias("bin")).agg(F.count("*").alias("n"))
    run = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return bins.where(F.col("upto") >= F.col("all") * share).groupBy(*by).agg(((F.min("bin") + 1) * step).alias("q"))


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _factored(s: DataFrame, *more: Column | str) -> DataFrame:
    """gid, fit_rows, the columns ``more``, the mean, the Cholesky factor of the covariance and the log of its determinant."""
    for j in range(P):
        s = s.withColumn(f"l{j}{j}", F.sqrt(F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))))
        for i in range(j + 1, P):
            s = s.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}"))
    det = sum((2 * F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0))
    return s.select("gid", "fit_rows", *more, det.alias("det"), *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS])


def _moments(d: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Sums of the rows of each group (and of whatever else is in ``by``), from which means and covariances follow; partial ones go through the shuffle."""
    v, u = [F.col(c) for c in V], [F.col(c) * F.col(x) for c, x in zip(V, X, strict=True)]
    sums = {f"uu{i}{j}": u[i] * u[j] for i, j in PAIRS} | {f"vv{i}{j}": v[i] * v[j] for i, j in PAIRS} | {f"vu{i}{j}": v[i] * u[j] for i in range(P) for j in range(P)}
    return d.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()], *more)


def _estimate(moments: DataFrame, factor: float, by: list[str], w: Column, *more: Column) -> DataFrame:
    """Mean and covariance of each group's moments, which weigh w."""
    sums = [c for c in moments.columns if c[:2] in ("uu", "vv", "vu")]
    s = moments.groupBy(*by).agg(F.sum(w * F.col("n")).alias("fit_rows"), *[(F.sum(w * F.col(k)) / F.sum(w * F.col("n"))).alias(k) for k in sums], *more)
    s = s.withColumns({f"m{i}": F.col(f"vu{i}{i}") / F.col(f"vv{i}{i}") for i in range(P)})
    m = [F.col(f"m{i}") for i in range(P)]
    # the mean of (u_i - m_i v_i) (u_j - m_j v_j)
    return s.withColumns({f"c{i}{j}": (F.col(f"uu{i}{j}") - m[i] * F.col(f"vu{i}{j}") - m[j] * F.col(f"vu{j}{i}") + m[i] * m[j] * F.col(f"vv{i}{j}")) * factor + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in PAIRS})


def _distances(d: DataFrame, est: DataFrame, *more: str) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, and the columns ``more`` of the estimate."""
    out = d.join(est, "gid", "left")
    for i in range(P):
        out = out.withColumn(f"y{i}", ((F.col(X[i]) - F.col(f"m{i}")) * F.col(V[i]) - sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return out.select(*d.columns, "fit_rows", *more, sum((F.col(f"y{i}") ** 2 for i in range(P)), F.lit(0.0)).alias("d2"))


def _starts(fit: DataFrame) -> DataFrame:
    """Four first estimates a group, named by start; see above."""
    long = fit.select("gid", F.posexplode(F.array(*[F.struct(F.col(x).alias("x"), F.col(v).alias("v")) for x, v in zip(X, V, strict=True)])).alias("dim", "s")).select("gid", "dim", "s.x", "s.v")
    # written tables of groups have a known size: each join below broadcasts them, and no group meets in one task
    med = materialize(_quantile(long, ["gid", "dim"], "x", 0.5, 0.002).withColumnRenamed("q", "med"), "medians")
    low = _quantile(long, ["gid", "dim"], "x", 0.25, 0.002).withColumnRenamed("q", "low")
    off = long.join(med, ["gid", "dim"]).withColumn("off", F.abs(F.col("x") - F.col("med")) * F.col("v"))
    both = med.join(low, ["gid", "dim"]).join(_quantile(off, ["gid", "dim"], "off", 0.5, 0.002), ["gid", "dim"])
    pick = lambda c, i: F.max(F.when(F.col("dim") == i, F.col(c)))
    scale = lambda i: F.sqrt((1.4826 * pick("q", i)) ** 2 + FLOORS[i] ** 2)
    s = materialize(both.groupBy("gid").agg(*[f(i).alias(f"{c}{i}") for i in range(P) for c, f in (("med", lambda i: pick("med", i)), ("low", lambda i: pick("low", i)), ("s", scale))]), "medians")
    z = fit.join(s, "gid").select("gid", *[((F.col(X[i]) - F.col(f"med{i}")) * F.col(V[i]) / F.col(f"s{i}")).alias(f"z{i}") for i in range(P)])
    z = z.withColumn("norm", F.greatest(F.sqrt(sum((F.col(f"z{i}") ** 2 for i in range(P)), F.lit(0.0))), F.lit(1e-9)))
    c = z.groupBy("gid").agg(*[F.covar_pop(F.tanh(f"z{i}"), F.tanh(f"z{j}")).alias(f"t{i}{j}") for i, j in PAIRS], *[F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("norm") ** 2).alias(f"g{i}{j}") for i, j in PAIRS])
    s = s.join(c, "gid")

    def start(k: int, mean: str, of) -> Column:
        cov = [(of(i, j) * F.col(f"s{i}") * F.col(f"s{j}") + (FLOORS[i] ** 2 if i == j and k in (1, 2) else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
        return F.struct(F.lit(k).alias("start"), *[F.col(f"{mean}{i}").alias(f"m{i}") for i in range(P)], *cov)

    own = lambda i, j: F.lit(float(i == j))
    all_ = [start(0, "med", own), start(1, "med", lambda i, j: F.col(f"t{i}{j}")), start(2, "med", lambda i, j: F.col(f"g{i}{j}")), start(3, "low", own)]
    s = s.select("gid", F.lit(0.0).alias("fit_rows"), F.explode(F.array(*all_)).alias("e")).select("gid", "fit_rows", "e.*")
    return _factored(s, "start").withColumn("det", F.lit(float("inf")))


def _step(fit: DataFrame, est: DataFrame) -> DataFrame:
    """A concentration step of each start in one pass; last is the log of the determinant before.

    Moments are summed by bins of distance, so the nearest half is a sum of bins.
    """
    far = _distances(fit, est, "start", "det").where("start is not null").withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) / 0.01))
    by = ["gid", "start"]
    bins = _moments(far, [*by, "bin"], F.max("det").alias("last"))
    run = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("before", F.sum("n").over(run) - F.col("n")).withColumn("half", F.floor((F.sum("n").over(Window.partitionBy(*by)) + P + 1) / 2))
    # of the bin at the edge, only as much weight as is missing
    w = F.least(F.lit(1.0), (F.col("half") - F.col("before")) / F.col("n"))
    return _factored(_estimate(bins.where("before < half"), CONSISTENT, by, w, F.max("last").alias("last")), "start", "last")


def _least_determinant(fit: DataFrame) -> DataFrame:
    """The estimate with the least determinant of each group; every start goes on until it settles."""
    going, ended = materialize(_starts(fit), "estimate"), []
    while not going.isEmpty():
        new = materialize(_step(fit, going), "estimate")
        better = F.col("last") - F.col("det") > SETTLED
        ended.append(new.where(~better).drop("last"))
        going = new.where(better).drop("last")
    if not ended:
        return going
    found = reduce(DataFrame.unionByName, ended)
    best = found.groupBy("gid").agg(F.min_by(F.struct(*found.columns), F.struct(F.round("det", 6), "start")).alias("e"))
    return materialize(best.select("e.*"), "estimate")


def judged(docs: DataFrame, carry: list[str], cutoff: float = CUTOFF, least_rows: int = LEAST_ROWS) -> DataFrame:
    """row (the columns ``carry`` of ``docs``) with counts and verdict; see ``quality``.

    The rows are written once with their counts and read again beside the estimates, so no text is shuffled or joined.
    """
    d = statistics(docs, carry).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    d = _grouped(materialize(_vector(d), "counts"), least_rows)
    fit = materialize(d.where("not base_failed").select("gid", "text_hash", *X, *N0).dropDuplicates(["gid", "text_hash"]).drop("text_hash"), "texts")
    near = _distances(fit, _least_determinant(fit)).where(F.col("d2") <= WITHIN)
    est = materialize(_factored(_estimate(_moments(near, ["gid"]), REWEIGHTED, ["gid"], F.lit(1.0))), "estimate")
    out = _distances(d, est)
    enough = F.coalesce(F.col("fit_rows"), F.lit(0)) >= least_rows // 2
    out = out.withColumn("distance", F.when(enough & ~F.col("base_failed"), F.col("d2")))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))


def accepted(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs``, all their columns, that the rules keep."""
    return judged(docs, docs.columns, cutoff).where("kept").select("row.*")


def quality(docs: DataFrame, cutoff: float = CUTOFF, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Counts and verdict of every row of ``docs``; reads doc_id, text, lang and source, and ignores other columns.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance (the squared
    one, null where base_failed or where the pool of all small groups has under ``least_rows`` / 2 different texts: of so
    few, five statistics give no covariance, and they are kept unless base_failed), lang, source.

    A null text counts as empty and fails the base rules, as does any with fewer than 20 words. Null languages and
    sources are values of their own. Repeated rows are judged alike and count once in an estimate. Rows that fail
    the base rules take no part in them. An empty table gives an empty result. Texts are never cut.
    """
    out = judged(docs, ["doc_id"], cutoff, least_rows)
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "lang", "source")
