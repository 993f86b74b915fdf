"""Small texts of models and rules: from the driver's disk, or with a session from any file system that Spark knows."""

from __future__ import annotations

import os


def write_lines(lines: list[str], path: str, spark=None) -> None:
    if spark is None:
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(x + "\n" for x in lines)
    else:
        rows = spark.createDataFrame(list(enumerate(lines)), "i int, value string").coalesce(1)
        rows.sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def exists(path: str, spark) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def read_lines(path: str, spark=None) -> list[str] | None:
    """The lines that ``write_lines`` wrote, in order, or None where there is nothing."""
    if spark is None:
        if not os.path.exists(path):
            return None
        with open(path, encoding="utf-8") as f:
            return f.read().splitlines()
    return [r.value for r in spark.read.text(path).coalesce(1).collect()] if exists(path, spark) else None
