"""Reports are read back; folders are scanned from disk."""

import json

import pytest

from riskloom.operators import project, report, scan
from riskloom.sources import code
from riskloom.sources.code import CORPUS


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("code")
    for name, text in CORPUS:
        (at / name).write_text(text)
    (at / "vendor").mkdir()
    (at / "vendor" / "x.py").write_text("import os\nos.system(input())\n")
    return at


@pytest.fixture(scope="module")
def found(spark, folder):
    files = code.read_folder(spark, f"file://{folder}", include=["*.py", "*.c"])
    return project.scan_folder(spark, f"file://{folder}", detector=scan.train_detector(files)).persist()


def _read(path):
    return "\n".join(p.read_text().rstrip("\n") for p in sorted(path.glob("part-*")))


def test_folder(found):
    rows = found.collect()
    names = {r.file_path.rsplit("/", 1)[1] for r in rows}
    assert {"app.py", "overflow.c", "Dao.java"} <= names and "x.py" not in names
    odd = [r for r in rows if r["pass"] == "anomaly"]
    assert odd and {(r.vuln_class, r.line_start) for r in odd} == {("CODE_EXECUTION", 1)} and {r.severity for r in odd} <= {"HIGH", "MEDIUM"}
    assert all(len(r.id) == 36 and "→" in r.code_snippet for r in rows)


def test_reports(spark, found, tmp_path):
    n = found.count()
    for f in ("json", "sarif", "html", "markdown"):
        report.write_report(found, f, 'a"<b>', "2024-01-01", str(tmp_path / f))
    d = json.loads(_read(tmp_path / "json"))
    assert d["target"] == 'a"<b>' and len(d["findings"]) == n == d["statistics"]["total_findings"]
    ranks = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
    order = [ranks.index(x["severity"]) for x in d["findings"]]
    assert order == sorted(order)
    s = json.loads(_read(tmp_path / "sarif"))
    assert len(s["runs"][0]["results"]) == n and all(r["message"]["text"] for r in s["runs"][0]["results"])
    page = _read(tmp_path / "html")
    assert page.count("<article") == n and page.endswith("</html>") and "a\"&lt;b&gt;" in page
    assert _read(tmp_path / "markdown").count("### ") == n
    report.write_report(found.where("severity = 'none'"), "json", "t", "w", str(tmp_path / "empty"))
    assert json.loads(_read(tmp_path / "empty"))["findings"] == []
    with pytest.raises(ValueError, match="format"):
        report.report(found, "pdf", "t", "w")


def test_a_source_is_a_folder_a_file_or_code(spark, folder):
    names = lambda d: {r.file_path.rsplit("/", 1)[-1] for r in d.collect()}
    assert {"app.py", "overflow.c"} <= names(project.analyze(spark, f"file://{folder}"))
    assert names(project.analyze(spark, f"file://{folder}/app.py")) == {"app.py"}
    text = "import os\nos.system(input())\n"
    assert names(project.analyze(spark, text)) == {"code"} == names(project.analyze(spark, "os.system(input())", "python"))
    assert project.analyze(spark, "").count() == 0


def test_code(spark):
    assert project.scan_code(spark, "import os\nos.system(input())\n", "python").count() > 0


@pytest.mark.parametrize("same", [1, 3, 500])
def test_equal_findings_nulls_and_control_characters(spark, tmp_path, same):
    kinds = "id string, severity string, vuln_class string, confidence double, file_path string, line_start int, title string"
    rows = [("a", "HIGH", "XSS", 0.9, "f\\g\"", 1, "tab\tand\x01\x1f \u2028 \"quoted\"")] * same
    rows += [("b", "HIGH", "XSS", 0.9, "f", 2, None), ("c", None, None, None, None, None, "t"), (None, "LOW", "XSS", 0.1, "f", 1, "t"), ("a", "HIGH", "XSS", 0.9, "other", 1, "same rank")]
    found = spark.createDataFrame(rows, kinds).repartition(4)
    for f in ("json", "sarif", "html", "md"):
        report.write_report(found, f, "t\n\x02", "w", str(tmp_path / f))
    d = json.loads(_read(tmp_path / "json"))
    assert len(d["findings"]) == len(rows) and d["target"] == "t\n\x02" and [x["title"] for x in d["findings"]].count(rows[0][-1]) == same
    assert {x["id"] for x in d["findings"]} == {"a", "b", "c", None} and d["findings"][0]["id"] == "a"
    s = json.loads(_read(tmp_path / "sarif"))
    assert len(s["runs"][0]["results"]) == len(rows) and len(s["runs"][0]["tool"]["driver"]["rules"]) > 10
    assert _read(tmp_path / "html").count("<article") == len(rows) == _read(tmp_path / "md").count("### ")
