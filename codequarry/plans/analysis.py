"""The whole analysis of a corpus: files and reports in, scored findings and statistics out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv
from codequarry.functions import text as t
from codequarry.functions.grouping import skew_join
from codequarry.functions.lines import with_lines
from codequarry.operators import duplicates, findings, js_rules, profile, py_rules, risk
from codequarry.schemas import FINDING_COLUMNS
from codequarry.session import written
from codequarry.sources import corpus, jstokens, pynodes, reports


@dataclass
class Analysis:
    findings: DataFrame
    file_stats: DataFrame
    languages: DataFrame
    parse_errors: DataFrame
    import_edges: DataFrame
    tool_status: DataFrame | None = None
    report_errors: DataFrame | None = None
    report_counts: dict[str, int] | None = None


@dataclass
class Reports:
    accepted: DataFrame
    errors: DataFrame
    status: DataFrame
    counts: dict[str, int]


def take_reports(report_rows: DataFrame) -> Reports:
    """Reads the reports once: each goes to its tool's folder or among the rejected ones, and is counted on the way.

    Parsers read the accepted reports of their tool only. `errors` holds the rejected ones whole, with a reason; `status` has
    one row a report, from its optional columns available, timed_out, exit_code and error.
    """
    counted = Observation()
    rows = reports.routed(report_rows).observe(
        counted, F.count(F.lit(1)).alias("reports"), F.count_if("rejected").alias("rejected"))
    stored = written(rows, "reports", partition_by=("rejected", "tool"))
    return Reports(stored.where(~F.col("rejected")).drop("rejected", "reason"),
                   stored.where(F.col("rejected")).drop("rejected"),
                   reports.tool_status(reports.ran(stored)), counted.get)


def analyse(files: DataFrame, report_rows: DataFrame | None = None, runs: DataFrame | None = None,
            extra_rules=(), with_text: bool = True) -> Analysis:
    """Analyse files (repo_id, file_id, path, size, content).

    `report_rows` holds JSON reports of external analysers (see sources/reports.py); rejected ones come back as
    `report_errors`. `runs` maps
    repo_id to run_id; without it the repository stands for its run. Sources are parsed once: the
    node and token tables are written, and every rule reads the columns it needs from there.
    """
    path = F.col("path")
    in_scan = ~t.ignored(path)
    in_dup = path.endswith(".py") & ~t.has_part(path, fv.IGNORED_BY_TOOL["dup"])
    python = files.where(t.suffix(t.base_name(path)).isin(".py", ".pyi") & (in_scan | in_dup))
    # sorted by kind inside a task's file: a rule skips the pages of kinds it does not look at
    nodes = written(pynodes.py_nodes(python, py_rules.NEEDED_KINDS).sortWithinPartitions("kind"),
                    "nodes")
    scanned = nodes.where(in_scan)
    taken = None if report_rows is None else take_reports(report_rows)
    report_rows = taken and taken.accepted
    tokens = written(jstokens.js_tokens(corpus.script_files(files)), "tokens")
    languages = profile.language_profile(files)

    sources = {
        "ast-custom": [py_rules.py_findings(scanned, extra_rules)],
        "dup": [duplicates.duplicate_functions(duplicates.functions(nodes))],
        "ts-morph": [js_rules.js_findings(tokens)],
    }
    stats = written(_file_stats(scanned, files, report_rows, runs), "file_stats")
    if report_rows is not None:
        sources["bandit"] = [reports.bandit(report_rows)]
        sources["ruff"] = [reports.ruff(report_rows)]
        sources["eslint"] = [reports.eslint(report_rows)]
        sources["ts-morph"].append(reports.ts_morph(report_rows))
    sources["radon"] = [reports.radon_findings(stats)]

    # The gate goes by repository and source, so it may follow the dedupe. Merged findings are stored,
    # since joins count their keys first.
    merged = written(findings.merge({n: _union(f, runs) for n, f in sources.items()}), "merged")
    gated = findings.gate_by_language(merged, languages)
    scored = risk.score(gated, stats).withColumn("status", F.lit("open"))
    if with_text:
        scored = _with_text(scored, files, merged)
    return Analysis(scored.drop("file_id", "end_line"), stats, languages,
                    pynodes.parse_errors(scanned), js_rules.import_edges(
                        tokens, corpus.script_files(files).select("repo_id", "path")),
                    taken and taken.status, taken and taken.errors, taken and taken.counts)


def _with_run(df: DataFrame, runs: DataFrame | None) -> DataFrame:
    if "run_id" in df.columns:
        return df
    if runs is None:
        return df.withColumn("run_id", F.col("repo_id"))
    spread = [c for c in ("path", "file", "line", "type") if c in df.columns]
    return skew_join(df, runs.select("repo_id", "run_id"), ["repo_id"], "inner", spread)


def _union(frames: list[DataFrame], runs: DataFrame | None) -> DataFrame:
    kept = []
    for df in frames:
        df = _with_run(df, runs)
        extra = {"file_id": "bigint", "end_line": "int"}
        kept.append(df.select(*FINDING_COLUMNS, *[
            F.col(c) if c in df.columns else F.lit(None).cast(ty).alias(c)
            for c, ty in extra.items()]))
    out = kept[0]
    for df in kept[1:]:
        out = out.unionByName(df)
    return out


def _file_stats(nodes: DataFrame, files: DataFrame, report_rows: DataFrame | None,
                runs: DataFrame | None) -> DataFrame:
    """Statistics per Python file. A radon report wins over the complexity counted from nodes."""
    counted = _with_run(py_rules.file_complexity(nodes), runs).select(
        "run_id", "repo_id", "path", F.col("complexity").cast("double").alias("own"))
    loc = _with_run(profile.with_loc(corpus.python_files(files)), runs).select(
        "run_id", "repo_id", "path", "loc")
    if report_rows is None:
        cc = counted.withColumnRenamed("own", "complexity")
        mi = counted.select("run_id", "repo_id", "path",
                            F.lit(None).cast("double").alias("maintainability")).where(F.lit(False))
    else:
        keys = ["run_id", "repo_id", "path"]
        cc = counted.join(reports.radon_cc(report_rows), keys, "full_outer").select(
            *keys, F.coalesce("complexity", "own").alias("complexity"))
        mi = reports.radon_mi(report_rows)
    # every Python file has a row, also one without a function
    cc = loc.select("run_id", "repo_id", "path").join(cc, ["run_id", "repo_id", "path"], "full_outer")
    return reports.file_stats(cc, mi, loc.drop("repo_id"))


def _with_text(scored: DataFrame, files: DataFrame, stored: DataFrame) -> DataFrame:
    """Snippets for findings of the own rules, joined after the dedupe."""
    line = F.col("line")
    shown = (
        F.when(F.col("source") == "ast-custom", t.snippet(F.col("_lines"), line))
        .when(F.col("source") == "dup", F.array_join(
            F.slice("_lines", line, F.col("end_line") - line + 1), "\n"))
        .otherwise(F.left(F.get("_lines", line - 1), F.lit(fv.JS_SNIPPET_CHARS)))  # reports without a text
    )
    return with_lines(scored, files, stored).withColumn(
        "evidence", F.col("evidence").withField(
            "snippet", F.coalesce(F.col("evidence.snippet"), shown))).drop("_lines")


def write(result: Analysis, root: str) -> None:
    """All tables below one folder; findings, file statistics and reports' states replace their runs only."""
    findings.write_findings(result.findings, f"{root}/findings")
    findings.write_file_stats(result.file_stats, f"{root}/file_stats")
    for name in ("tool_status", "report_errors"):
        if getattr(result, name) is not None:
            findings.write_by_run(getattr(result, name), f"{root}/{name}")
    for name in ("languages", "parse_errors", "import_edges"):
        getattr(result, name).write.mode("overwrite").parquet(f"{root}/{name}")
