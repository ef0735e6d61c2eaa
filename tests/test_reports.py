"""Reports of external analysers."""

import json


from codequarry.sources import reports

REPORT = "run_id BIGINT, repo_id STRING, tool STRING, stdout STRING, root STRING"


def test_json_validity(spark):
    cases = {'{"a": 1}': None, "[]": None, " ": None, "": None, "\n": None, "1": None,
             '{"a": 1}}': reports.fv.BAD_JSON, "[1] 2": reports.fv.BAD_JSON, "1, 2": reports.fv.BAD_JSON,
             '{"a": ': reports.fv.BAD_JSON, '{"a": 1}] x': reports.fv.BAD_JSON}
    df = spark.createDataFrame([(i, s) for i, s in enumerate(cases)], "i INT, stdout STRING")
    got = {r.stdout: r.error for r in reports.checked(df).collect()}
    assert got == cases


def test_read_and_normalise(spark, tmp_path):
    root = tmp_path / "7" / "repo1"
    root.mkdir(parents=True)
    (root / "bandit.json").write_text(json.dumps({"results": [
        {"filename": "a.py", "test_id": "B1", "test_name": "exec", "line_number": 3,
         "issue_text": "t", "issue_confidence": "HIGH", "issue_cwe": {"id": 78}, "code": "x" * 3000}, {}]}))
    (root / "ruff.json").write_text("{broken")
    (root / "eslint.json").write_text(json.dumps([{"filePath": "b.js", "messages": [
        {"ruleId": None, "message": "m", "severity": 2}, {"fatal": True}]}]))
    rows = reports.read_reports(spark, str(tmp_path))
    one, two = reports.bandit(rows).orderBy("ord").collect()
    assert (one.run_id, one.repo_id, one.type, one.line, one.col) == (7, "repo1", "exec", 3, 0)
    assert one.description == "B1 exec — CWE: 78" and len(one.evidence.code) == 2000
    assert (two.type, two.description, two.confidence) == ("BANDIT", "  — CWE: n/a", 0.5)
    assert reports.ruff(rows).count() == 0
    assert {r.tool: r.error for r in reports.checked(rows).collect()}["ruff"] == reports.fv.BAD_JSON
    only = reports.eslint(rows).collect()
    assert [(r.type, r.category, r.description) for r in only] == [
        ("SYNTAX", "CORRECTNESS", "severity 2")]


def test_radon_shapes(spark):
    cc = {"/w/a.py": [{"complexity": 3}, {"complexity": 17}], "b.py": [], "c.py": {"error": "x"}}
    mi = {"mi": {"/w/a.py": 55.556, "d.py": {"mi": 70}}}
    rows = spark.createDataFrame([(1, "r", "radon-cc", json.dumps(cc), "/w"),
                                  (1, "r", "radon-mi", json.dumps(mi), "/w"),
                                  (2, "r", "radon-mi", json.dumps({"e.py": 1.005}), "/w")], REPORT)
    stats = reports.file_stats(reports.radon_cc(rows), reports.radon_mi(rows))
    got = {(r.run_id, r.path): (r.complexity, r.maintainability) for r in stats.collect()}
    assert got == {(1, "a.py"): (17.0, 55.56), (1, "b.py"): (0.0, None), (1, "c.py"): (0.0, None),
                   (1, "d.py"): (0.0, 70.0), (2, "e.py"): (0.0, 1.01)}
    found = reports.radon_findings(stats).collect()
    assert [(r.file, r.line, r.evidence.complexity, r.description) for r in found] == [
        ("a.py", 0, 17, "max complexity 17")]
    assert found[0].message.startswith("Function with cyclomatic complexity 17 — exceeds")
