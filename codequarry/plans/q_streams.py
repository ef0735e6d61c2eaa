"""Registered queries on streams: the tables land as files, and each job runs to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import risk
from codequarry.plans import templates as tp
from codequarry.plans import views as v
from codequarry.plans.registry import register
from codequarry.plans.view_sql import V_FINDINGS_EV, V_STATS, with_views
from codequarry.session import scratch_path
from codequarry.streaming import streams


def folders(spark, name: str) -> tuple[str, str]:
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"


def event_stream(spark, d):
    schema = v.table(spark, d, "events").schema
    events = streams.landed(spark, d, schema, "events.parquet")
    return v.event_finding_columns(events).withColumn(
        "created_at", F.col("created_at").cast("timestamp"))


@register("stream_scan", with_views(tp.T_FILES, tp.EXPECTED_SQL + ",\n" + tp.LONE_SQL) + """
SELECT repo_id, path AS file, type, line, confidence FROM t_files JOIN expected USING (no)
UNION ALL SELECT repo_id, 'web/lib.ts', 'UNUSED_FUNCTION', 1, CAST(0.5 AS DOUBLE) FROM lone""")
def stream_scan(spark, d):
    """All rules over files that arrive in several batches, with names counted across them."""
    out, checkpoint = folders(spark, "stream_scan")
    landing = scratch_path(spark, "landing")
    files = tp.source_files(spark, d)
    files.write.parquet(landing)
    stream = streams.landed(spark, landing, files.schema, files_per_batch=4)
    for query in streams.scan_corpus(stream, out, checkpoint):
        streams.run_to_end(query)
    return streams.findings_now(spark, out).select("repo_id", "file", "type", "line", "confidence")


SCORE = """CASE type WHEN 'SQL_INJECTION' THEN CAST(0.25 AS DOUBLE) WHEN 'HARDCODED_SECRET' THEN CAST(0.25 AS DOUBLE)
  WHEN 'SELF_COMPARISON' THEN CAST(0.3 AS DOUBLE) WHEN 'UNUSED_VARIABLE' THEN CAST(-0.15 AS DOUBLE)
  WHEN 'UNUSED_FUNCTION' THEN CAST(-0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
+ CASE category WHEN 'SECURITY' THEN CAST(0.1 AS DOUBLE) WHEN 'CORRECTNESS' THEN CAST(0.05 AS DOUBLE)
  WHEN 'CODE_SMELL' THEN CAST(-0.05 AS DOUBLE) WHEN 'PERFORMANCE' THEN CAST(-0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"""


@register("stream_score", with_views(V_FINDINGS_EV, V_STATS) + f""", s AS (
  SELECT id, f.run_id % 20 AS run_id, category, confidence, complexity,
         CAST(0.5 AS DOUBLE) + {SCORE} AS base
  FROM v_findings_ev f LEFT JOIN v_file_stats s ON f.run_id % 20 = s.run_id AND 'src/p' || (f.id % 50) || '.py' = s.path),
r AS (SELECT *, greatest(CAST(0.05 AS DOUBLE), least(CAST(0.98 AS DOUBLE),
    base * confidence + (CAST(1 AS DOUBLE) - confidence) * CAST(0.5 AS DOUBLE)
    + CASE WHEN complexity >= 10 THEN CAST(0.03 AS DOUBLE) WHEN complexity >= 5 THEN CAST(0.015 AS DOUBLE)
           ELSE CAST(0 AS DOUBLE) END)) AS risk_raw FROM s)
SELECT id, run_id, risk_raw, CASE WHEN risk_raw >= CAST(0.8 AS DOUBLE) THEN 'critical'
  WHEN risk_raw >= CAST(0.65 AS DOUBLE) THEN 'high' WHEN risk_raw >= CAST(0.45 AS DOUBLE) THEN 'medium'
  WHEN risk_raw >= CAST(0.25 AS DOUBLE) THEN 'low' ELSE 'info' END AS severity FROM r""")
def stream_score(spark, d):
    out, checkpoint = folders(spark, "stream_score")
    stream = event_stream(spark, d).withColumn("run_id", F.col("run_id") % 20).withColumn(
        "file", v.numbered_file(F.col("id")))
    stats = risk.latest_stats(v.raw_file_stats(spark, d))
    streams.run_to_end(streams.append(streams.score(stream, stats), out, checkpoint))
    return spark.read.parquet(out).select("id", "run_id", "risk_raw", "severity")


@register("stream_dedupe", with_views(V_FINDINGS_EV) + """
SELECT DISTINCT run_id % 5 AS run_id, source, type, file, line FROM v_findings_ev""")
def stream_dedupe(spark, d):
    out, checkpoint = folders(spark, "stream_dedupe")
    stream = event_stream(spark, d).withColumn("run_id", F.col("run_id") % 5)
    streams.run_to_end(streams.append(streams.dedupe(stream, "1 hour"), out, checkpoint))
    return spark.read.parquet(out).select("run_id", "source", "type", "file", "line")


@register("stream_first_wins", with_views(V_FINDINGS_EV) + """, timed AS (
  SELECT run_id % 5 AS run_id, source, type, file, line, id, created_at,
    lag(created_at) OVER (PARTITION BY run_id % 5, source, type, file, line ORDER BY created_at, id) AS before
  FROM v_findings_ev)
SELECT run_id, source, type, file, line, id FROM timed WHERE before IS NULL OR created_at - before > INTERVAL 6 HOUR""")
def stream_first_wins(spark, d):
    """The first row of each run of a key: five deliveries in the order of time, each run to its end."""
    out, checkpoint = folders(spark, "stream_first_wins")
    landing = scratch_path(spark, "landing")
    found = v.event_findings(spark, d).withColumn("run_id", F.col("run_id") % 5).withColumn(
        "created_at", F.col("created_at").cast("timestamp")).withColumn(
        "ord", F.struct("created_at", "id"))
    low, high = found.agg(F.min("created_at"), F.max("created_at")).first()
    part = F.least(F.floor((F.unix_micros("created_at") - F.unix_micros(F.lit(low))) * 5
                           / (F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)) + 1)), F.lit(4))
    for delivery in range(5):
        found.where(part == delivery).write.mode("append").parquet(landing)
        stream = streams.landed(spark, landing, found.schema)
        streams.run_to_end(streams.first_wins(stream, out, checkpoint, "6 hours"))
    return spark.read.parquet(f"{out}/findings").select("run_id", "source", "type", "file", "line", "id")


@register("stream_stats", with_views(V_FINDINGS_EV) + """
SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, category, findings FROM (
  SELECT date_trunc('hour', created_at) AS hour, category, count(*) AS findings,
         (SELECT max(created_at) - INTERVAL 1 HOUR FROM v_findings_ev) AS mark
  FROM v_findings_ev GROUP BY ALL)
WHERE hour + INTERVAL 1 HOUR <= mark""")
def stream_stats(spark, d):
    out, checkpoint = folders(spark, "stream_stats")
    counts = streams.hourly_counts(event_stream(spark, d))
    streams.run_to_end(streams.append(counts, out, checkpoint))
    return spark.read.parquet(out).select(
        F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "category", "findings")
