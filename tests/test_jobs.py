"""The whole analysis, sinks, streams, listings, and the shape of plans."""

import pytest
from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv
from codequarry.operators import findings, ledger, listing
from codequarry.plans import analysis
from codequarry.plans import views as v
from codequarry.streaming import streams

SF = "/root/testdata/sf0.001"
FILE = "repo_id STRING, file_id BIGINT, path STRING, size BIGINT, content STRING"


def test_analysis_end_to_end(spark, tmp_path):
    big = "def f(x):\n" + "".join(f"    if x == {i}:\n        g({i})\n" for i in range(15))
    rows = [
        ("r", 1, "a.py", 1, "eval(x)\nassert x, eval(y)\n" + big + "    eval(z)\n"),
        ("r", 2, "w.ts", 1, "el.innerHTML = x;\n"),
        ("s", 3, "w.ts", 1, "eval(x)\n"), ("s", 4, "out/a.py", 1, "eval(x)\n"),
    ]
    reports = spark.createDataFrame([
        ("r", "r", "ruff", '[{"code": "F401", "filename": "/w/a.py", "location": {"row": 1}}]', "/w"),
        ("s", "s", "ruff", '[{"code": "F401", "filename": "b.py", "location": {"row": 1}}]', "/w"),
        ("r", "r", "bandit", '{"results": [{"filename": "a.py", "line_number": 3}', "/w"),
        ("s", "s", "eslint", "{}", "/w"), ("s", "s", None, "1", "/w"), ("s", "s", "mypy", " ", "/w"),
    ], "run_id STRING, repo_id STRING, tool STRING, stdout STRING, root STRING")
    result = analysis.analyse(spark.createDataFrame(rows, FILE), reports)
    got = {(r.repo_id, r.source, r.type, r.file, r.line): r for r in result.findings.collect()}
    assert set(got) == {
        ("r", "ast-custom", "DANGEROUS_EVAL", "a.py", 1), ("r", "ast-custom", "DANGEROUS_EVAL", "a.py", 2),
        ("r", "ast-custom", "ASSERT_VALIDATION", "a.py", 2),
        ("r", "ast-custom", "DANGEROUS_EVAL", "a.py", 34), ("r", "ruff", "F401", "a.py", 1),
        ("r", "radon", "HIGH_COMPLEXITY", "a.py", 0), ("r", "ts-morph", "UNSAFE_INNER_HTML", "w.ts", 1),
        ("s", "ts-morph", "DANGEROUS_EVAL", "w.ts", 1),  # no Python in s: its ruff report is gated
    }
    one = got["r", "ast-custom", "DANGEROUS_EVAL", "a.py", 1]
    assert one.risk_score == pytest.approx((0.5 + 0.25 + 0.1) * 0.75 + 0.125 + 0.03, abs=1e-3)
    assert one.evidence.snippet.startswith("    1 | eval(x)\n    2 | assert")
    assert got["r", "ts-morph", "UNSAFE_INNER_HTML", "w.ts", 1].evidence.snippet == "el.innerHTML = x"
    stats = {(r.path): (r.complexity, r.loc) for r in result.file_stats.collect()}
    assert stats["a.py"] == (16.0, 34)

    assert result.report_counts == {"reports": 6, "rejected": 3}
    assert {(r.run_id, r.tool, r.reason, r.stdout) for r in result.report_errors.collect()} == {
        ("r", "bandit", fv.BAD_JSON, '{"results": [{"filename": "a.py", "line_number": 3}'),
        ("s", "eslint", fv.ODD_SHAPE, "{}"), ("s", None, fv.NO_PARSER, "1")}
    assert sorted((r.run_id, str(r.tool), r.state, r.exit_code) for r in result.tool_status.collect()) == [
        ("r", "bandit", "ok", 0), ("r", "ruff", "ok", 0), ("s", "None", "ok", 0), ("s", "eslint", "ok", 0),
        ("s", "mypy", "ok", 0), ("s", "ruff", "ok", 0)]
    one_tool = result.report_errors.where("tool = 'eslint'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in one_tool and "(tool#" in one_tool

    out = str(tmp_path / "tables")
    analysis.write(result, out)
    assert spark.read.parquet(f"{out}/report_errors").count() == 3
    analysis.write(result, out)  # a second run replaces its partitions
    stored = spark.read.parquet(f"{out}/findings")
    assert stored.count() == len(got)
    only_r = analysis.analyse(spark.createDataFrame(rows[:1], FILE))
    findings.write_findings(only_r.findings, f"{out}/findings")
    assert {r.run_id for r in spark.read.parquet(f"{out}/findings").collect()} == {"r", "s"}
    assert spark.read.parquet(f"{out}/findings").where("run_id = 'r'").count() == 5
    plan = spark.read.parquet(f"{out}/findings").where("run_id = 'r'")._jdf.queryExecution()
    assert "PartitionFilters: [isnotnull(run_id" in plan.executedPlan().toString()


def test_repartitioning_does_not_change_results(spark):
    from codequarry.plans import templates as tp
    from codequarry.operators import py_rules
    from codequarry.sources import corpus, pynodes

    files = corpus.python_files(tp.source_files(spark, SF))
    seen = []
    for parts in (1, 7):
        found = py_rules.py_findings(pynodes.py_nodes(files.repartition(parts)))
        kept = findings.dedupe(found.withColumn("run_id", F.col("repo_id")))
        seen.append(sorted(map(repr, kept.drop("evidence").collect())))
    assert seen[0] == seen[1] and seen[0]


def test_late_rows_are_dropped(spark, tmp_path):
    landing, out, check = (str(tmp_path / n) for n in ("landing", "out", "check"))
    for hour in ("2024-01-01 00:10:00", "2024-01-01 05:10:00", "2024-01-01 00:50:00",
                 "2024-01-01 09:00:00"):
        row = spark.createDataFrame([(hour,)], "h STRING").select(
            F.to_timestamp("h").alias("created_at"), F.lit("SECURITY").alias("category"))
        row.write.mode("append").parquet(landing)
        stream = streams.landed(spark, landing, spark.read.parquet(landing).schema)
        streams.run_to_end(streams.append(streams.hourly_counts(stream), out, check))
    got = {(str(r.window.start), r.findings) for r in spark.read.parquet(out).collect()}
    assert got == {("2024-01-01 00:00:00", 1), ("2024-01-01 05:00:00", 1)}


def test_listing_arguments(spark):
    df = v.event_findings(spark, SF)
    with pytest.raises(ValueError):
        listing.page(df, 0)
    with pytest.raises(ValueError):
        listing.page(df, 10, -1)
    with pytest.raises(ValueError):
        listing.list_findings(df, min_confidence=1.5)
    last = listing.page_with_total(df, 1000, 0).first()
    assert last.total == 1000 and not last.has_more


def test_ledger(spark):
    rows = [(1, 10, "running", "ingest", None, 1), (2, 10, "failed", "analyze", "x" * 4000 + "end", 2),
            (3, 11, "completed", "finalize", None, 1), (4, 12, "running", "odd", None, 1)]
    events = spark.createDataFrame(
        rows, "event_id BIGINT, run_id BIGINT, state STRING, stage STRING, error STRING, ts BIGINT")
    got = {r.run_id: r for r in ledger.latest(events).collect()}
    assert (got[10].state, got[10].progress, len(got[10].error)) == ("failed", 50, 3000)
    assert got[10].error.endswith("end") and got[11].progress == 100 and got[12].progress is None
    runs = spark.createDataFrame([(10,), (11,), (13,)], "run_id BIGINT")
    assert sorted(r.run_id for r in ledger.pending(runs, events).collect()) == [10, 13]


def test_latest_of_ties_and_nulls_sorts_no_texts(spark):
    rows = [(1, 10, "running", "ingest", "a", 1), (2, 10, "failed", "analyze", "b", 1), (2, 10, "failed", "analyze", "b", 1),
            (3, 11, "failed", "ingest", "c", 2), (4, 11, "completed", "finalize", "d", None), (None, 12, "failed", "odd", "e", None),
            (5, None, "failed", "odd", "f", 1), (None, None, "running", "odd", "g", 1), (6, 13, "running", "odd", "h", 9), (5, 13, "failed", "odd", "i", 9)]
    events = spark.createDataFrame(
        rows, "event_id BIGINT, run_id BIGINT, state STRING, stage STRING, error STRING, ts BIGINT")
    latest = ledger.latest(events)
    assert {r.run_id: (r.state, r.stage, r.error, r.ts) for r in latest.collect()} == {
        10: ("failed", "analyze", "b", 1), 11: ("failed", "ingest", "c", 2), 12: ("failed", "odd", "e", None),
        None: ("failed", "odd", "f", 1), 13: ("running", "odd", None, 9)}
    # events are dropped by a hash join before any sort
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_plans_push_down_and_never_cross(spark):
    from codequarry.plans.all_queries import QUERIES

    def plan(name):
        return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    page = plan("findings_filter")
    assert "event_type" in page and "PushedFilters" in page
    assert "TakeOrderedAndProject" in plan("findings_page")
    for name in ("risk_score", "frameworks", "import_edges", "findings_page", "triage_rejects"):
        assert "CartesianProduct" not in plan(name) and "NestedLoop" not in plan(name), name
