"""Advisories from a REST service, page by page at a limited rate, and a store of them as a table."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "cve_id string, description string, cvss_v3_score double, cvss_v3_vector string, severity string, cwe_ids array<string>, affected_products array<string>, references array<string>, published_date timestamp, last_modified timestamp"


def _get(url: str, headers: dict) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as r:
        return r.read().decode()


class Service:
    """Asks a service for JSON answers. ``per_minute`` requests at most; an answer is kept for ``keep`` seconds."""

    def __init__(self, url: str, key: str | None = None, per_minute: int = 5, keep: float = 3600, get: Callable[[str, dict], str] = _get, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.url, self.key, self.pause, self.keep = url, key, 60 / per_minute, keep
        self.get, self.clock, self.sleep = get, clock, sleep
        self.last: float | None = None
        self.answers: dict[str, tuple[float, str]] = {}

    def wait(self) -> None:
        """Sleep until the next request may be made."""
        if self.last is not None and (left := self.pause - (self.clock() - self.last)) > 0:
            self.sleep(left)
        self.last = self.clock()

    def search(self, keyword: str | None = None, product: str | None = None, cve_id: str | None = None, cwe_id: str | None = None, start: int = 0, size: int = 100, since: str | None = None) -> str | None:
        """The answer to a question, or None where the request fails."""
        asked = {"keywordSearch": keyword, "cpeName": product, "cveId": cve_id, "cweId": cwe_id, "startIndex": start, "resultsPerPage": size, "lastModStartDate": since}
        query = urllib.parse.urlencode(sorted((k, v) for k, v in asked.items() if v is not None))
        if query in self.answers and self.clock() - self.answers[query][0] < self.keep:
            return self.answers[query][1]
        self.wait()
        try:
            text = self.get(f"{self.url}?{query}", {"apiKey": self.key} if self.key else {})
        except (urllib.error.URLError, OSError, ValueError):
            return None
        self.answers[query] = self.clock(), text
        return text


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new advisories; of one number, the one last modified, a new one before an old one."""
    d = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("cve_id").orderBy(F.col("last_modified").desc_nulls_last(), F.desc("_new"))
    return d.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_new", "_place")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The store at a path; an empty one where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(path)


def save(store: DataFrame, path: str) -> None:
    """Write a store as JSON, one advisory for each line; not to the path that it was read from."""
    store.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def update(store: DataFrame, service: Service, keywords: list[str]) -> DataFrame:
    """The store with what the service answers to each keyword; failed requests add nothing."""
    from riskloom.operators.scan import parse_advisories

    spark = store.sparkSession
    texts = [t for k in keywords if (t := service.search(keyword=k))]
    if not texts:
        return store
    d = parse_advisories(spark.createDataFrame([(t,) for t in texts], "j string"), "j")
    listed = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    s = F.col("score")
    severity = F.coalesce("severity", F.when(s >= 9, "CRITICAL").when(s >= 7, "HIGH").when(s >= 4, "MEDIUM").otherwise("LOW"))
    published = F.to_timestamp("published")
    new = d.select("cve_id", "description", s.alias("cvss_v3_score"), F.col("vector").alias("cvss_v3_vector"), severity.alias("severity"), listed("cwes").alias("cwe_ids"), F.col("products").alias("affected_products"), listed("urls").alias("references"), published.alias("published_date"), F.coalesce(F.to_timestamp("modified"), published).alias("last_modified"))
    return merge(store, new)


def search(store: DataFrame, cwe_id: str | None = None, least: float = 0.0) -> DataFrame:
    d = store.where(F.col("cvss_v3_score") >= least)
    return d.where(F.array_contains("cwe_ids", cwe_id)) if cwe_id else d
