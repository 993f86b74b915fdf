"""Vectors of files: 128 numbers of code, 160 features, scaling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions import text as T
from riskloom.operators import features as feats

SIZE = 128
#: features that have a number, from 1; the embedding follows them
FEATURES = ["complexity", "nesting", "loc", "functions", "inputs", "sinks", "crypto", "memory", "file_ops", "network", "dangerous", "taint_flows", "unchecked", "pointers", "entropy", "diversity", "comment_ratio"]
#: places of a feature vector, and of the first one that no embedding reaches
LENGTH, LAST = 160, 144


def let(x: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is worked out once: as the variable of a lambda, no optimizer puts its expression in again."""
    return F.element_at(F.transform(F.array(x), fn), 1)


def _vector() -> Column:
    """128 numbers: counts of words and of regexes, and the structure; of a row that ``_counted`` made."""
    words = F.transform("tokens.words", lambda x: x.cast("double"))
    lines = (F.char_length("content") - F.char_length(F.replace(F.col("content"), F.lit("\n"), F.lit("")))).cast("double")
    shape = [F.col("tokens.n").cast("double") / 1000, F.col("complexity") / F.lit(50.0), F.col("nesting") / F.lit(10.0), lines / 500, F.col("entropy") / 8, _diversity()]
    hits = F.transform("hits", lambda x: x.cast("double") / 10)
    none = lambda n: F.array(*[F.lit(0.0)] * n)
    return F.concat(words, none(64 - len(rules.VECTOR_WORDS)), F.array(*shape), none(96 - 64 - len(shape)), hits)


def _diversity() -> Column:
    return F.when(F.col("tokens.n") > 0, F.col("tokens.distinct") / F.col("tokens.n")).otherwise(0.0)


def _unit(x: Column) -> Column:
    """A vector divided by its length, if it has one."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
    return let(x, lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda e: e / n)).otherwise(v)))


def _counted(files: DataFrame) -> DataFrame:
    """Features of each file beside the counts of its tokens and of regexes, lines and entropy."""
    return feats.features(files, keep=["content", T.token_counts("content", rules.VECTOR_WORDS).alias("tokens"), T.counts("content", rules.VECTOR_REGEXES).alias("hits"), T.comment_lines("content", "language").alias("marks"), T.entropy("content").alias("entropy")])


def code_embeddings(files: DataFrame) -> DataFrame:
    """(path, embedding) of 128 numbers of length one, all 0 for a text with nothing to count; one scan, no shuffle."""
    return _counted(files).select("path", _unit(_vector()).alias("embedding"))


def feature_vectors(files: DataFrame) -> DataFrame:
    """(path, x) of 160 numbers: the numbered features, and the embedding as far as place 144."""
    d = _counted(files)
    ratio = F.when(F.col("marks.all") > 0, F.col("marks.comment") / F.col("marks.all")).otherwise(0.0)

    own = {"loc": F.col("marks.all"), "diversity": _diversity(), "comment_ratio": ratio}
    numbered = F.array(*[own.get(c, F.col(c)).cast("double") for c in FEATURES])
    return d.select("path", F.concat(numbered, F.slice(_unit(_vector()), 1, LAST - len(FEATURES)), F.array_repeat(F.lit(0.0), LENGTH - LAST)).alias("x"))


def of_vector(x: Column) -> Column:
    """The features of a vector as a struct: counts are rounded; names of dangerous functions are not in it."""
    whole = FEATURES[:14]
    return F.struct(*[(F.rint(x[i]).cast("int") if c in whole else x[i]).alias(c) for i, c in enumerate(FEATURES)])


def zscore(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, z): values less the mean, over the sample's deviation; over 1 where that is 0."""
    e = vectors.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", (F.col("pos") + 1).alias("dim"), F.col("x").cast("double").alias("x"))
    s = e.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("dev"))
    dev = F.when(F.col("dev") > 0, F.col("dev")).otherwise(1.0)
    return e.join(F.broadcast(s), "dim").select("vec_id", "dim", ((F.col("x") - F.col("mean")) / dev).alias("z"))  # a row for each dimension
