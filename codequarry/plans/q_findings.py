"""Registered queries on findings, runs and repositories (merge, scoring, listings, ledger)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codequarry.operators import findings as ops
from codequarry.operators import ledger, listing, risk, writeback
from codequarry.plans import views as v
from codequarry.plans.registry import register
from codequarry.plans.view_sql import (
    LANGUAGE_CASE, ORD, V_DEDUPED, V_FILES, V_FINDINGS, V_FINDINGS_EV, V_REPOS, V_RUN_EVENTS, V_RUNS,
    V_SCORED, V_STATS, V_UPDATES, with_views,
)
from codequarry.session import scratch_path

STAMP = "yyyy-MM-dd HH:mm:ss"
SCORED = with_views(V_FINDINGS, V_DEDUPED, V_STATS, V_SCORED)
KEY = ("run_id", "source", "type", "file", "line")


def stamp(column: str):
    return F.date_format(column, STAMP)


def scored(spark, d):
    return risk.score(ops.dedupe(v.findings(spark, d)), risk.latest_stats(v.raw_file_stats(spark, d)))


@register("dedupe_findings", with_views(V_FINDINGS, V_DEDUPED) +
          "SELECT run_id, source, type, category, file, line, confidence, l_partkey, l_suppkey FROM v_deduped")
def dedupe_findings(spark, d):
    return ops.dedupe(v.findings(spark, d)).select(
        *KEY, "category", "confidence", "ord.l_partkey", "ord.l_suppkey")


@register("cap_per_source", with_views(V_FINDINGS) + f"""
SELECT run_id, source, type, category, file, line, confidence, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, source ORDER BY {ORD}) AS rn FROM v_findings)
WHERE source = 'ast-custom' OR rn <= 500""")
def cap_per_source(spark, d):
    return ops.cap_per_source(v.findings(spark, d)).select(
        *KEY, "category", "confidence", "ord.l_partkey", "ord.l_suppkey")


MERGED = with_views(V_FINDINGS) + f""",
merged AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, source, type, file, line ORDER BY {ORD}) AS rn
    FROM v_findings) WHERE rn = 1)
"""


def merged(spark, d):
    return ops.with_defaults(ops.dedupe(v.findings(spark, d)))


@register("merge_findings", MERGED +
          "SELECT run_id, source, type, category, file, line, confidence, l_partkey FROM merged")
def merge_findings(spark, d):
    return merged(spark, d).select(*KEY, "category", "confidence", "ord.l_partkey")


@register("finding_counts", MERGED + "SELECT run_id, count(*) AS findings FROM merged GROUP BY run_id")
def finding_counts(spark, d):
    return ops.counts_per_run(merged(spark, d))


@register("findings_defaults", with_views(V_FINDINGS_EV) + """
SELECT id, CASE WHEN id % 5 = 0 THEN 0 ELSE line END AS line,
       CASE WHEN id % 5 = 1 THEN 0 ELSE col END AS col,
       CASE WHEN id % 5 = 2 THEN '' ELSE message END AS message, '' AS description,
       CASE WHEN id % 5 = 3 THEN CAST(0.5 AS DOUBLE) ELSE confidence END AS confidence
FROM v_findings_ev""")
def findings_defaults(spark, d):
    found = v.event_findings(spark, d)
    holes = {c: F.when(F.col("id") % 5 != i, F.col(c))
             for i, c in enumerate(("line", "col", "message", "confidence"))}
    return ops.with_defaults(
        found.withColumns(holes).withColumn("description", F.lit(None).cast("string"))
    ).select("id", "line", "col", "message", "description", "confidence")


@register("language_gate", with_views(V_FINDINGS_EV, V_FILES) + f""",
langs AS (SELECT DISTINCT repo_id, {LANGUAGE_CASE} AS language FROM v_scan
          WHERE NOT (ext IN ('.py', '.pyi') AND repo_id IN ('src1', 'src2', 'src3'))
            AND NOT (ext IN ('.ts', '.tsx', '.jsx', '.js') AND repo_id IN ('src3', 'src4')))
SELECT f.id, f.source, 'src' || (f.run_id % 20) AS repo_id FROM v_findings_ev f
WHERE EXISTS (SELECT 1 FROM langs l WHERE l.repo_id = 'src' || (f.run_id % 20) AND (
    (f.source IN ('ast-custom', 'bandit', 'ruff', 'radon', 'dup') AND l.language = 'python')
    OR (f.source = 'ts-morph' AND l.language IN ('javascript', 'typescript'))
    OR (f.source = 'eslint' AND l.language = 'javascript')))""")
def language_gate(spark, d):
    from codequarry.operators import profile

    found = v.event_findings(spark, d).withColumn(
        "repo_id", F.concat(F.lit("src"), (F.col("run_id") % 20).cast("string")))
    langs = profile.with_language(profile.scan(v.files(spark, d))).where(
        ~((F.col("language") == "python") & F.col("repo_id").isin("src1", "src2", "src3"))
        & ~(F.col("language").isin("typescript", "javascript")
            & F.col("repo_id").isin("src3", "src4")))
    return ops.gate_by_language(found, langs.select("repo_id", "language")).select(
        "id", "source", "repo_id")


SCORE_COLUMNS = "run_id, source, type, file, line, risk_raw, risk_score, severity"


@register("risk_score", SCORED + f"SELECT {SCORE_COLUMNS}, 'heuristic-v1' AS model_version FROM v_scored")
def risk_score(spark, d):
    return scored(spark, d).select(*SCORE_COLUMNS.split(", "), "model_version")


@register("severity_bands", SCORED + "SELECT severity, count(*) AS findings, min(risk_raw) AS lowest, "
          "max(risk_raw) AS highest FROM v_scored GROUP BY severity")
def severity_bands(spark, d):
    return scored(spark, d).groupBy("severity").agg(
        F.count(F.lit(1)).alias("findings"), F.min("risk_raw").alias("lowest"),
        F.max("risk_raw").alias("highest"))


@register("rescore_completed", with_views(V_FINDINGS, V_DEDUPED, V_STATS, V_SCORED, V_RUNS) + f"""
SELECT {SCORE_COLUMNS} FROM v_scored
WHERE run_id IN (SELECT run_id FROM v_runs WHERE status = 'completed')""")
def rescore_completed(spark, d):
    return risk.rescore_completed(
        ops.dedupe(v.findings(spark, d)), risk.latest_stats(v.raw_file_stats(spark, d)),
        v.runs(spark, d)).select(*SCORE_COLUMNS.split(", "))


@register("rescore_bucketed", with_views(V_FINDINGS, V_DEDUPED, V_STATS, V_SCORED) +
          f"SELECT {SCORE_COLUMNS} FROM v_scored")
def rescore_bucketed(spark, d):
    """Findings and statistics stored bucketed by run and file, then scored without a shuffle."""
    found, stats = ops.dedupe(v.findings(spark, d)), risk.latest_stats(v.raw_file_stats(spark, d))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return risk.score(*risk.store(found, stats, f"scoring_{uuid.uuid4().hex}", buckets)).select(*SCORE_COLUMNS.split(", "))


@register("rescore_refused", with_views(V_RUNS) +
          "SELECT run_id, status, 'Run has not completed yet' AS reason FROM v_runs WHERE status <> 'completed'")
def rescore_refused(spark, d):
    return risk.refused_runs(v.runs(spark, d))


@register("severity_pivot", SCORED + """
SELECT run_id, count(*) FILTER (WHERE severity = 'critical') AS critical,
       count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium,
       count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'info') AS info
FROM v_scored GROUP BY run_id""")
def severity_pivot(spark, d):
    return risk.severity_histogram(scored(spark, d))


EV_COLUMNS = "id, run_id, source, type, category, file, line, confidence, status"


@register("findings_filter", with_views(V_FINDINGS_EV) + f"""
SELECT {EV_COLUMNS} FROM v_findings_ev
WHERE category = 'SECURITY' AND source = 'bandit' AND type = 'HARDCODED_SECRET'
  AND status = 'overridden' AND confidence >= CAST(0.05 AS DOUBLE)""")
def findings_filter(spark, d):
    return listing.list_findings(
        v.event_findings(spark, d), category="SECURITY", source="bandit", type="HARDCODED_SECRET",
        status="overridden", min_confidence=0.05).select(*EV_COLUMNS.split(", "))


@register("findings_search", with_views(V_FINDINGS_EV) + f"""
SELECT {EV_COLUMNS}, message FROM v_findings_ev
WHERE message ILIKE '%sql_inj%click%' OR file ILIKE '%sql_inj%click%'""")
def findings_search(spark, d):
    return listing.list_findings(v.event_findings(spark, d), q="sql_inj%CLICK").select(
        *EV_COLUMNS.split(", "), "message")


@register("findings_total", with_views(V_FINDINGS_EV) +
          "SELECT count(*) AS total FROM v_findings_ev WHERE category = 'CORRECTNESS' AND confidence >= CAST(0.2 AS DOUBLE)")
def findings_total(spark, d):
    return listing.total(listing.list_findings(v.event_findings(spark, d), category="CORRECTNESS",
                                               min_confidence=0.2))


@register("findings_page", with_views(V_FINDINGS_EV) + f""", hits AS (
  SELECT * FROM v_findings_ev WHERE category = 'CODE_SMELL')
SELECT {EV_COLUMNS}, (SELECT count(*) FROM hits) AS total, (SELECT count(*) FROM hits) > 150 AS has_more
FROM hits ORDER BY confidence DESC, id LIMIT 100 OFFSET 50""")
def findings_page(spark, d):
    hits = listing.list_findings(v.event_findings(spark, d), category="CODE_SMELL")
    return listing.page_with_total(hits, 100, 50).select(*EV_COLUMNS.split(", "), "total",
                                                         "has_more")


@register("stats_by_category", with_views(V_FINDINGS_EV) +
          "SELECT run_id, category, count(*) AS count FROM v_findings_ev GROUP BY ALL")
def stats_by_category(spark, d):
    return listing.count_by(v.event_findings(spark, d), "category")


@register("stats_by_source", with_views(V_FINDINGS_EV) +
          "SELECT run_id, source, count(*) AS count FROM v_findings_ev GROUP BY ALL")
def stats_by_source(spark, d):
    return listing.count_by(v.event_findings(spark, d), "source")


@register("stats_totals", with_views(V_FINDINGS_EV) + """
SELECT run_id, count(*) AS total, count(*) FILTER (WHERE confidence >= CAST(0.8 AS DOUBLE)) AS high_confidence,
       count(DISTINCT source) AS analysers FROM v_findings_ev GROUP BY run_id""")
def stats_totals(spark, d):
    return listing.totals(v.event_findings(spark, d))


@register("stats_grouping_sets", with_views(V_FINDINGS_EV) + """
SELECT run_id, category, source, count(*) AS count,
       count(*) FILTER (WHERE confidence >= CAST(0.8 AS DOUBLE)) AS high_confidence,
       CAST(grouping(run_id, category, source) AS BIGINT) AS grouping_level
FROM v_findings_ev GROUP BY GROUPING SETS ((run_id, category), (run_id, source), (run_id))""")
def stats_grouping_sets(spark, d):
    return listing.all_stats(v.event_findings(spark, d))


@register("top_complex_files", with_views(V_STATS) + """
SELECT run_id, path, complexity, position FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY complexity DESC, path) AS INTEGER) AS position
  FROM v_file_stats) WHERE position <= 20""")
def top_complex_files(spark, d):
    return listing.most_complex_files(risk.latest_stats(v.raw_file_stats(spark, d)), 20).select(
        "run_id", "path", "complexity", "position")


@register("runs_with_repo", with_views(V_RUNS, V_REPOS) + """
SELECT run_id, r.repo_id, p.name AS repository_name, p.source_type, status,
       strftime(started_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM v_runs r JOIN v_repos p ON r.repo_id = p.repo_id""")
def runs_with_repo(spark, d):
    return listing.runs_with_repo(v.runs(spark, d), v.repos(spark, d)).select(
        "run_id", "repo_id", "repository_name", "source_type", "status",
        stamp("created_at").alias("created_at"))


@register("repos_recent", with_views(V_REPOS) +
          "SELECT repo_id, name, source_type, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM v_repos")
def repos_recent(spark, d):
    return listing.recent_repos(v.repos(spark, d)).withColumn("created_at", stamp("created_at"))


@register("triage_apply", with_views(V_FINDINGS_EV, V_UPDATES) + """, newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, finding_id
                                              ORDER BY ts DESC, update_id DESC) AS rn
                 FROM v_updates WHERE status IN ('open', 'confirmed', 'false_positive', 'overridden'))
  WHERE rn = 1)
SELECT f.id, f.run_id, f.category, coalesce(u.status, f.status) AS status
FROM v_findings_ev f LEFT JOIN newest u ON f.run_id = u.run_id AND f.id = u.finding_id""")
def triage_apply(spark, d):
    return listing.apply_triage(v.event_findings(spark, d), v.triage_updates(spark, d)).select(
        "id", "run_id", "category", "status")


@register("triage_rejects", with_views(V_FINDINGS_EV, V_UPDATES) + """
SELECT update_id, run_id, finding_id, status,
       CASE WHEN status NOT IN ('open', 'confirmed', 'false_positive', 'overridden') THEN 'status not allowed'
            ELSE 'Finding not found' END AS reason
FROM v_updates u
WHERE status NOT IN ('open', 'confirmed', 'false_positive', 'overridden')
   OR NOT EXISTS (SELECT 1 FROM v_findings_ev f WHERE f.run_id = u.run_id AND f.id = u.finding_id)""")
def triage_rejects(spark, d):
    return listing.rejected_updates(v.event_findings(spark, d), v.triage_updates(spark, d)).select(
        "update_id", "run_id", "finding_id", "status", "reason")


@register("cascade_delete", with_views(V_REPOS, V_RUNS, V_STATS, V_FINDINGS_EV) + """, gone AS (
  SELECT run_id FROM v_runs WHERE repo_id % 7 = 0)
SELECT 'repositories' AS target, repo_id AS id FROM v_repos WHERE repo_id % 7 <> 0
UNION ALL SELECT 'runs', run_id FROM v_runs WHERE repo_id % 7 <> 0
UNION ALL SELECT 'files', run_id FROM v_file_stats WHERE run_id NOT IN (SELECT run_id FROM gone)
UNION ALL SELECT 'findings', id FROM v_findings_ev WHERE run_id NOT IN (SELECT run_id FROM gone)""")
def cascade_delete(spark, d):
    all_repos = v.repos(spark, d)
    kept = listing.cascade_delete(
        all_repos.where("repo_id % 7 = 0").select("repo_id"), all_repos, v.runs(spark, d),
        risk.latest_stats(v.raw_file_stats(spark, d)), v.event_findings(spark, d))
    named = zip(("repositories", "runs", "files", "findings"),
                ("repo_id", "run_id", "run_id", "id"), kept)
    out = [df.select(F.lit(t).alias("target"), F.col(c).alias("id")) for t, c, df in named]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@register("findings_write_back", with_views(V_RUNS, V_FINDINGS_EV, V_UPDATES) + """, newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, finding_id
                                              ORDER BY ts DESC, update_id DESC) AS rn
                 FROM v_updates WHERE status IN ('open', 'confirmed', 'false_positive', 'overridden'))
  WHERE rn = 1)
SELECT f.id, f.run_id, f.category, coalesce(u.status, f.status) AS status
FROM v_findings_ev f LEFT JOIN newest u ON f.run_id = u.run_id AND f.id = u.finding_id
WHERE f.run_id NOT IN (SELECT run_id FROM v_runs WHERE repo_id % 7 = 0)""")
def findings_write_back(spark, d):
    root, found = scratch_path(spark, "findings-table"), v.event_findings(spark, d)
    ops.write_by_run(found, root, groups=64)  # users are many small runs
    gone = v.runs(spark, d).where("repo_id % 7 = 0").select("run_id")
    writeback.merge_findings(spark, root, scratch_path(spark, "findings-merge"), v.triage_updates(spark, d), gone)
    return spark.read.schema(found.schema).parquet(root).select("id", "run_id", "category", "status")


@register("run_lookup", with_views(V_RUNS) + """
SELECT run_id, repo_id, status, true AS found FROM v_runs WHERE run_id = 42
UNION ALL SELECT -1, NULL, NULL, false""")
def run_lookup(spark, d):
    all_runs = v.runs(spark, d).drop("started_at")
    return listing.lookup_run(all_runs, 42).unionByName(listing.lookup_run(all_runs, -1)).select(
        "run_id", "repo_id", "status", "found")


@register("display_severity", with_views(V_FINDINGS_EV) + """
SELECT id, CASE WHEN id % 3 = 0 THEN 'critical' WHEN confidence >= CAST(0.8 AS DOUBLE) THEN 'high'
                WHEN confidence >= CAST(0.5 AS DOUBLE) THEN 'medium' ELSE 'low' END AS display_severity,
       file || CASE WHEN line > 0 THEN ':' || line || CASE WHEN col > 0 THEN ':' || col ELSE '' END
                    ELSE '' END AS location
FROM v_findings_ev""")
def display_severity(spark, d):
    found = v.event_findings(spark, d).withColumn(
        "severity", F.when(F.col("id") % 3 == 0, F.lit("critical")))
    return listing.with_display(found).select("id", "display_severity", "location")


@register("run_progress", with_views(V_RUN_EVENTS) +
          "SELECT event_id, run_id, stage, progress FROM v_run_events")
def run_progress(spark, d):
    return ledger.with_progress(v.run_events(spark, d)).select("event_id", "run_id", "stage",
                                                               "progress")


@register("run_latest", with_views(V_RUN_EVENTS) + """
SELECT run_id, state, stage, progress, CASE WHEN state = 'failed' THEN right(error, 3000) END AS error,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS rn FROM v_run_events)
WHERE rn = 1""")
def run_latest(spark, d):
    return ledger.latest(v.run_events(spark, d)).withColumn("ts", stamp("ts"))


@register("runs_pending", with_views(V_RUNS, V_RUN_EVENTS) + """
SELECT run_id, repo_id, status FROM v_runs
WHERE run_id NOT IN (SELECT run_id FROM v_run_events WHERE state = 'completed')""")
def runs_pending(spark, d):
    return ledger.pending(v.runs(spark, d), v.run_events(spark, d)).select("run_id", "repo_id",
                                                                           "status")
