"""Advisories as a data source over a fake service, with failures and a restart; watch lists with state; evaluation rows."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from riskloom.operators import scan, training
from riskloom.sources import advisories, advisory_stream
from riskloom.streaming import watch


def _cve(i, modified, cwe="CWE-79", product="cpe:a"):
    return {"id": f"CVE-{i}", "descriptions": [{"lang": "en", "value": f"text {i}"}], "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 5.5, "vectorString": "V", "baseSeverity": "MEDIUM"}}]}, "weaknesses": [{"description": [{"value": cwe}, {"value": "x"}]}], "configurations": [{"nodes": [{"cpeMatch": [{"criteria": product}]}]}], "references": [{"url": "u"}], "published": "2024-01-01T00:00:00.000", "lastModified": modified}


@pytest.fixture
def service():
    """A service of 25 advisories, five for each second; every fourth request fails."""
    held = {i: _cve(i, f"2024-01-01T00:00:{i // 5:02d}.000") for i in range(25)}
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append(q)
            if len(asked) % 4 == 0:
                self.send_error(503)
                return
            rows = sorted((c for c in held.values() if c["lastModified"] >= q.get("lastModStartDate", "")), key=lambda c: (c["lastModified"], int(c["id"][4:])))
            at, n = int(q["startIndex"]), int(q["resultsPerPage"])
            out = json.dumps({"totalResults": len(rows), "vulnerabilities": [{"cve": c} for c in rows[at : at + n]]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/cves", held, asked
    server.shutdown()


def test_batch_of_pages(spark, service):
    url, held, asked = service
    spark.dataSource.register(advisory_stream.AdvisorySource)
    d = spark.read.format("advisories").option("url", url).option("size", 10).option("per_minute", 600).load()
    rows = d.collect()
    assert sorted(r.cve_id for r in rows) == sorted(c["id"] for c in held.values())
    r = rows[0]
    assert (r.cvss_v3_score, r.cvss_v3_vector, r.severity, r.cwe_ids, r.affected_products, r.references) == (5.5, "V", "MEDIUM", ["CWE-79"], ["cpe:a"], ["u"]) and r.last_modified is not None
    assert [q["startIndex"] for q in asked] == ["0", "10", "20"]
    late = spark.read.format("advisories").option("url", url).option("per_minute", 600).option("since", "2024-01-01T00:00:04").load()
    assert late.count() == 5


def test_stream_goes_on_after_a_restart(spark, service, tmp_path):
    url, held, _ = service
    spark.dataSource.register(advisory_stream.AdvisorySource)

    def run(batches):
        s = spark.readStream.format("advisories").option("url", url).option("size", 7).option("per_minute", 1200).load()
        seen = []
        q = s.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda d, i: seen.append([r.cve_id for r in d.collect()])).start()
        for _ in range(300):
            if sum(1 for b in seen if b) >= batches:
                break
            q.awaitTermination(0.1)
        q.stop()
        return [x for b in seen for x in b]

    first = run(2)
    held[3]["lastModified"] = "2024-01-01T00:00:30.000"  # changes after it was read: comes again, and shifts nothing
    rest = run(3)
    assert len(first) >= 14 and len(set(first)) == len(first)
    assert set(first) | set(rest) == {c["id"] for c in held.values()}
    assert rest.count("CVE-3") == 1 and sorted(set(first) & set(rest) - {"CVE-3"}) == []


def test_update_keeps_all_fields(spark):
    answer = json.dumps({"vulnerabilities": [{"cve": _cve(1, "2024-05-01T00:00:00.000")}]})
    older = json.dumps({"vulnerabilities": [{"cve": {**_cve(1, "2024-03-01T00:00:00.000"), "descriptions": []}}]})
    service = lambda text: advisories.Service("http://x", get=lambda url, headers: text, per_minute=60000)
    store = advisories.update(spark.createDataFrame([], advisories.SCHEMA), service(answer), ["k"])
    r = advisories.update(store, service(older), ["k"]).collect()
    assert len(r) == 1 and r[0].cvss_v3_vector == "V" and r[0].affected_products == ["cpe:a"] and str(r[0].last_modified) == "2024-05-01 00:00:00" and r[0].description == "text 1"


def test_watch_list_forgets_nothing(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = "cve_id string, cwe_ids array<string>, affected_products array<string>, published_date string, last_modified string"
    days = [
        [("A", ["CWE-79"], ["cpe:a"], "2024-01-01", "2024-01-01"), ("B", ["CWE-1"], None, "2024-01-01", "2024-01-01"), (None, ["CWE-79"], None, None, None)],
        [("A", ["CWE-79"], ["cpe:a"], "2024-01-01", "2024-01-01"), ("C", ["CWE-79", "CWE-79"], [], "2024-02-01", None)],
        [("A", ["CWE-79"], ["cpe:a"], "2024-01-01", "2024-03-05"), ("D", ["CWE-79"], [], "2023-06-01", "2023-06-01"), ("C", ["CWE-79"], [], "2024-02-01", None)],
    ]
    try:
        for i, rows in enumerate(days):
            d = spark.createDataFrame(rows, kinds).withColumns({c: F.to_timestamp(c) for c in ("published_date", "last_modified")})
            d.write.mode("append").parquet(str(tmp_path / "src"))
            s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "src"))
            q = watch.watched(s, ["cpe:a"], ["CWE-79"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
            got = sorted((r.item, r.cve_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())
            want = [("CWE-79", "A", "new"), ("cpe:a", "A", "new")]
            want += [("CWE-79", "C", "new")] if i else []
            want += [("CWE-79", "D", "new"), ("CWE-79", "A", "changed"), ("cpe:a", "A", "changed")] if i == 2 else []
            assert got == sorted(want)
        looked = {(r.cve_id, r.status): r.looked for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert looked["A", "new"] is None and looked["A", "changed"] is not None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_training_rows_and_evaluation(spark):
    found = spark.createDataFrame([("a", "XSS", "LOW", 0.9), ("a", "INJECTION", "HIGH", 0.9), ("b", "XSS", "LOW", 0.2), (None, "XSS", "LOW", 0.2)], "file_path string, vuln_class string, severity string, confidence double")
    files = spark.createDataFrame([("a", "python", "eval(x)"), ("b", "python", "y = 1"), ("c", "python", "")], "path string, language string, content string")
    got = {r.vec_id: (r.label, len(r.embedding)) for r in training.training_rows(found, scan.file_vectors(files)).collect()}
    names = [c[0] for c in training.model.CLASSES]
    assert got == {"a": (names.index("INJECTION"), 160), "b": (names.index("XSS"), 160), "c": (None, 160)}
    d = spark.range(400).selectExpr("id AS vec_id", "array(CAST(id % 2 AS DOUBLE) + rand(1) / 4, rand(2)) AS embedding", "CAST(id % 2 AS INT) AS label")
    r = training.evaluate_logistic(d, [0, 1]).first()
    assert r.accuracy > 0.95 and r.f1 > 0.95 and r.n == d.where(training.held_out(d)).count()
    assert training.evaluate_logistic(d.where("label = 1"), [0, 1]).first().accuracy == 1.0
