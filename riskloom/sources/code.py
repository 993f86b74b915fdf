"""Files of code: from folders, and documents as files, beside a small built-in corpus in several languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import rules

#: a small corpus that all analyses have something to find in
CORPUS = [
    ("app.py", 'import os\nfrom flask import request\nuser = request.args.get("u")\ncmd = "ls " + user\nos.system(cmd)\nq = "select * from t where n=" + user\ncursor.execute(q)\nsafe = escape(user)'),
    ("flow.py", "a = input()\nb = a + 1\na = 2\nprint(a, b)"),
    ("overflow.c", '#include <stdio.h>\nint main(int argc, char** argv) {\n  char buf[8];\n  strcpy(buf, argv[1]);\n  if (argc > 1) {\n    printf("%s", buf);\n  }\n  return 0;\n}'),
    ("secrets.js", 'const token = "abcdefghijklmnopqrst";\nlet el = document.location;\nel.innerHTML = "<b>" + el;\nfunction show(x) {\n  if (x && el) {\n    return eval(x);\n  }\n}'),
    ("Dao.java", 'public class Dao {\n  public String find(String id) {\n    String q = "select * from t where id=" + request.getParameter("id");\n    Object o = null;\n    o.toString();\n    Runtime.getRuntime().exec(q);\n    for (int i = 0; i < 3; i++) {\n      Statement.executeQuery(q);\n    }\n    return (String) o;\n  }\n}'),
    ("page.php", "<?php\n$name = $_GET['name'];\necho $name;\n$out = shell_exec($name);\ninclude($name);\n/* block\ncomment */\n// line\n$h = md5($name);"),
    ("main.go", 'package main\n\nfunc run() {\n  name := r.FormValue("n")\n  exec.Command(name)\n  db.Query("select " + name)\n}'),
    ("util.py", 'def load(path):\n    """doc\n    string"""\n    # comment\n    f = open(path)\n    data = f.read()\n    if data and path or True:\n        return pickle.loads(data)\n    elif not data:\n        return yaml.load(data)\n\nclass Box(object):\n    def sudo(self, admin):\n        password = "hunter2"\n        return hashlib.md5(password)'),
]


def language_of(path: Column) -> Column:
    """By the extension in lower case; ``unknown`` without a known one. A constant map, as the column stands in many conditions."""
    names = F.create_map(*[F.lit(x) for pair in rules.EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))), F.lit("unknown"))


def guessed_language(content: Column) -> Column:
    """By marks in the text; ``unknown`` without any."""
    out = F.lit("unknown")
    for language, regexes in reversed(rules.MARKERS.items()):
        hit = F.lit(False)
        for r in regexes:
            hit = hit | content.rlike(r)
        out = F.when(hit, language).otherwise(out)
    return out


def corpus(spark: SparkSession) -> DataFrame:
    rows = [(path, rules.EXTENSIONS.get(path[path.rfind(".") :], "unknown"), content) for path, content in CORPUS]
    return spark.createDataFrame(rows, "path string, language string, content string")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus, and every document as a Python file."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return corpus(spark).unionByName(d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), F.lit("python").alias("language"), F.coalesce("text", F.lit("")).alias("content")))


def read_folder(spark: SparkSession, folder: str, include: list[str] = ("*",), exclude: list[str] = (), max_bytes: int = 1 << 20) -> DataFrame:
    """path, language, content, sha256 of the files below a folder; size and globs are tested before contents are read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("length") <= max_bytes)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    d = d.where(glob_any(name, include)).where(~(glob_any(F.col("path"), exclude) | glob_any(name, exclude)))
    return d.select("path", language_of(F.col("path")).alias("language"), F.make_valid_utf8("content").alias("content"), F.sha2("content", 256).alias("sha256"))


def glob(col: Column, pattern: str) -> Column:
    """* and ? as in file names, any case; a dot stands for any character, as the rules that use this expect."""
    return col.rlike("(?i)^" + pattern.replace("*", ".*").replace("?", ".") + "$")


def glob_any(col: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | glob(col, p)
    return out


def lines(files_: DataFrame, around: int = 2) -> DataFrame:
    """path, language, line_no (from 1), text, context (the line and ``around`` lines on each side).

    Contexts are cut from the file's array of lines in the same row, so that nothing is shuffled.
    """
    d = files_.select("path", "language", F.split("content", "\n", -1).alias("ls"))
    near = lambda i: F.array_join(F.slice("ls", F.greatest(i + 1 - around, F.lit(1)), F.lit(around + 1) + F.least(i, F.lit(around))), "\n")
    d = d.select("path", "language", F.explode(F.transform("ls", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("text"), near(i).alias("context")))).alias("l"))
    return d.select("path", "language", "l.line_no", "l.text", "l.context")


def texts(files_: DataFrame) -> DataFrame:
    """``lines`` without contexts."""
    d = files_.select("path", "language", F.posexplode(F.split("content", "\n", -1)).alias("i", "text"))
    return d.select("path", "language", (F.col("i") + 1).alias("line_no"), "text")


def _quoted(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


_EXT = "CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.EXTENSIONS.items()) + " ELSE 'unknown' END"
CORPUS_SQL = "SELECT path, " + _EXT + " AS language, content FROM (VALUES " + ", ".join(f"({_quoted(p)}, {_quoted(t)})" for p, t in CORPUS) + ") t(path, content)"
FILES_SQL = f"SELECT * FROM ({CORPUS_SQL}) UNION ALL SELECT 'doc_' || doc_id, 'python', coalesce(text, '') FROM documents"
LINES_SQL = "l0 AS (SELECT path, language, string_split(content, chr(10)) AS ls FROM files), l1 AS (SELECT path, language, ls, unnest(range(1, len(ls) + 1)) AS line_no FROM l0), lines AS (SELECT path, language, line_no, ls[line_no] AS text, array_to_string(ls[greatest(line_no - 2, 1):line_no + 2], chr(10)) AS context FROM l1)"
