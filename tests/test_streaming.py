"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from riskloom.streaming import incremental


def test_new_advisories_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    rows = [("CVE-1", 9.0, "CWE-89", "2024-01-02 00:00:00"), ("CVE-1", 9.0, "CWE-89", "2024-01-02 00:00:00"), ("CVE-2", 1.0, "CWE-1", "2024-01-02 00:00:00")]
    d = spark.createDataFrame(rows, "cve_id string, cvss double, cwe_id string, p string").select("cve_id", "cvss", "cwe_id", F.col("p").cast("timestamp").alias("published"))
    d.write.parquet(src)
    s = spark.readStream.schema(d.schema).parquet(src)
    q = incremental.new_advisories(s, ["CWE-89"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.cve_id for r in spark.read.parquet(out).collect()] == ["CVE-1"]


def test_match_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    d = spark.createDataFrame([("a.py", "python", 'password = "hunter2x"')], "path string, language string, content string")
    d.write.parquet(src)
    q = incremental.match_files(spark.readStream.schema(d.schema).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(out).first().pattern == "Hardcoded Credentials"
