"""Triage and deletion merged into a stored table."""

import pytest
from pyspark.sql import functions as F

from codequarry.operators import findings, writeback

FINDING = "id BIGINT, run_id STRING, status STRING"
UPDATE = "update_id BIGINT, run_id STRING, finding_id BIGINT, status STRING, ts BIGINT"
ROWS = [(i, run, "open") for run in ("a b", "c%d", "e", "f") for i in range(40)]


def files_of(root):
    return {str(p.relative_to(root)) for p in root.rglob("*.parquet")}


def content(spark, root):
    return {(r.run_id, r.id): r.status for r in spark.read.schema(FINDING).parquet(str(root)).collect()}


@pytest.fixture
def merge(spark, tmp_path):
    table = tmp_path / "table"
    findings.write_by_run(spark.createDataFrame(ROWS, FINDING), str(table))
    updates = spark.createDataFrame([
        (1, "a b", 3, "confirmed", 1), (2, "a b", 3, "overridden", 2), (3, "a b", 4, "closed", 1),
        (4, "a b", 99, "open", 1), (5, "nowhere", 1, "confirmed", 1), (6, "c%d", 1, "confirmed", 1),
        (7, None, 1, "confirmed", 1), (8, "e", 1, "closed", 1)], UPDATE)
    gone = spark.createDataFrame([("c%d",), ("c%d",), ("unknown",), (None,)], "run_id STRING")

    def run():
        writeback.merge_findings(spark, str(table), str(tmp_path / "merge"), updates, gone)
        return content(spark, table)

    want = {(run, i): "overridden" if (run, i) == ("a b", 3) else "open" for i, run, _ in ROWS if run != "c%d"}
    return table, run, want


def test_touched_runs_only(merge):
    table, run, want = merge
    before = files_of(table)
    assert run() == want
    kept = before & files_of(table)
    assert kept == {f for f in before if f.startswith(("run_id=e/", "run_id=f/"))}


def test_a_lost_driver(merge, monkeypatch):
    table, run, want = merge
    real, calls = writeback.write_by_run, []

    def lost(df, path):
        calls.append(path)
        if len(calls) == 2:  # staged, but the table is as it was
            raise RuntimeError("driver lost")
        real(df, path)

    monkeypatch.setattr(writeback, "write_by_run", lost)
    with pytest.raises(RuntimeError):
        run()
    for f in (table / "run_id=a b").glob("*.parquet"):  # the worst moment of an overwrite: old files gone, new ones not there
        f.unlink()
    monkeypatch.setattr(writeback, "write_by_run", real)
    assert run() == want and run() == want


def test_nothing_to_do(spark, tmp_path):
    table = tmp_path / "table"
    findings.write_by_run(spark.createDataFrame(ROWS, FINDING), str(table))
    before = files_of(table)
    writeback.merge_findings(spark, str(table), str(tmp_path / "merge"))
    assert files_of(table) == before and len(content(spark, table)) == len(ROWS)


@pytest.mark.parametrize("groups", [1, 3])
def test_many_runs_share_folders(spark, tmp_path, groups):
    """A folder a run made a merge of many small runs write a file for each."""
    table = tmp_path / "table"
    rows = [(i, f"r{i % 97}" if i % 97 else None, "open") for i in range(970)]
    findings.write_by_run(spark.createDataFrame(rows, FINDING), str(table), groups=groups)
    assert len(list(table.glob("run_group=*"))) == groups
    updates = spark.createDataFrame([(1, "r5", 5, "confirmed", 1), (2, "r6", 6, "confirmed", 1), (3, "r7", 8, "confirmed", 1)], UPDATE)
    gone = spark.createDataFrame([("r6",), ("r8",), ("unknown",), (None,)], "run_id STRING")

    def run():
        writeback.merge_findings(spark, str(table), str(tmp_path / "merge"), updates, gone)
        return content(spark, table)

    want = {(run, i): "confirmed" if i == 5 else "open" for i, run, _ in rows if run not in ("r6", "r8")}
    assert run() == want and run() == want
    assert len(files_of(table)) <= 2 * groups
    # an untouched group keeps its files, and one without a run left loses them
    before, left = files_of(table), {r.run_group: r.runs for r in spark.read.parquet(str(table)).where("run_id IS NOT NULL").groupBy("run_group").agg(F.collect_set("run_id").alias("runs")).collect()}
    one = min(left)
    writeback.merge_findings(spark, str(table), str(tmp_path / "again"), None, spark.createDataFrame([(r,) for r in left[one]], "run_id STRING"))
    others = {f for f in before if not f.startswith(f"run_group={one}/")}
    assert others <= files_of(table)
    assert {r for r, _ in content(spark, table) if r} == {r for k, v in left.items() if k != one for r in v}
