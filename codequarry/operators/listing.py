"""Queries behind the listings: filters, pages, statistics, triage, deletes and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv
from codequarry.functions import scoring
from codequarry.functions.grouping import skew_join, top_per_group


def list_findings(findings: DataFrame, run_id=None, category=None, source=None, type=None,
                  min_confidence: float = 0.0, status=None, q=None) -> DataFrame:
    """Filtered listing. `%` and `_` in `q` are wildcards."""
    if not 0.0 <= min_confidence <= 1.0:
        raise ValueError("min_confidence must be between 0 and 1")
    out = findings
    for name, value in (("run_id", run_id), ("category", category), ("source", source),
                        ("type", type), ("status", status)):
        if value is not None and value != "":
            out = out.where(F.col(name) == value)
    if min_confidence > 0:
        out = out.where(F.col("confidence") >= min_confidence)
    if q:
        out = out.where(F.col("message").ilike(f"%{q}%") | F.col("file").ilike(f"%{q}%"))
    return out


def total(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count(F.lit(1)).alias("total"))


def page(findings: DataFrame, limit: int = fv.PAGE_SIZE, offset: int = 0) -> DataFrame:
    """One page by falling confidence; a top-k, so no global sort."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be in 1..1000 and offset must not be negative")
    return findings.orderBy(F.desc("confidence"), "id").offset(offset).limit(limit)


def page_with_total(findings: DataFrame, limit: int = fv.PAGE_SIZE, offset: int = 0) -> DataFrame:
    """A page, the number of all matches, and whether more rows follow the shown ones."""
    matches = total(findings).scalar()
    return page(findings, limit, offset).withColumn("total", matches).withColumn(
        "has_more", F.col("total") > offset + limit)


def count_by(findings: DataFrame, column: str) -> DataFrame:
    return (findings.groupBy("run_id", column).agg(F.count(F.lit(1)).alias("count"))
            .orderBy("run_id", F.desc("count"), column))


def totals(findings: DataFrame) -> DataFrame:
    """Per run, in one pass: findings, findings of high confidence, distinct analysers."""
    return findings.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("confidence") >= fv.HIGH_CONFIDENCE).alias("high_confidence"),
        F.size(F.collect_set("source")).cast("bigint").alias("analysers"),
    )


def all_stats(findings: DataFrame) -> DataFrame:
    """Counts by category, by source and in total from one scan."""
    return findings.groupingSets(
        [["run_id", "category"], ["run_id", "source"], ["run_id"]], "run_id", "category", "source"
    ).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col("confidence") >= fv.HIGH_CONFIDENCE).alias("high_confidence"),
        F.grouping_id().cast("bigint").alias("grouping_level"),
    )


def most_complex_files(stats: DataFrame, k: int = fv.TOP_FILES) -> DataFrame:
    """The k most complex files of each run."""
    return top_per_group(stats, ["run_id"], ["-complexity", "path"], k, rank="position")


def runs_with_repo(runs: DataFrame, repos: DataFrame) -> DataFrame:
    named = repos.select("repo_id", F.col("name").alias("repository_name"), "source_type")
    return skew_join(runs, named, ["repo_id"], "inner", ["run_id"]).withColumn(
        "created_at", F.col("started_at"))


def recent_repos(repos: DataFrame) -> DataFrame:
    return repos.orderBy(F.desc("created_at"), "repo_id")


def lookup_run(runs: DataFrame, run_id: int) -> DataFrame:
    """One run, or one row with found = false."""
    hit = runs.where(F.col("run_id") == run_id)
    wanted = runs.sparkSession.range(run_id, run_id + 1).withColumnRenamed("id", "run_id")
    return wanted.join(F.broadcast(hit.withColumn("found", F.lit(True)).limit(1)), "run_id",
                       "left").withColumn("found", F.coalesce("found", F.lit(False)))


def latest_updates(updates: DataFrame) -> DataFrame:
    """Of the allowed updates, the last one per finding of a run."""
    allowed = updates.where(F.col("status").isin(*fv.TRIAGE_STATUSES))
    return allowed.groupBy("run_id", "finding_id").agg(
        F.max_by("status", F.struct("ts", "update_id")).alias("_status"))


def apply_triage(findings: DataFrame, updates: DataFrame) -> DataFrame:
    """Findings with their newest status. Both sides are unique per key, so no key is hot."""
    newest = latest_updates(updates).withColumnRenamed("finding_id", "id")
    return (findings.join(newest, ["run_id", "id"], "left")
            .withColumn("status", F.coalesce("_status", "status")).drop("_status"))


def rejected_updates(findings: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates with a status that is not allowed, or for a finding that is not in the run."""
    known = findings.select("run_id", F.col("id").alias("finding_id")).withColumn(
        "_known", F.lit(True))
    joined = skew_join(updates, known, ["run_id", "finding_id"], "left", ["update_id"])
    reason = (F.when(~F.col("status").isin(*fv.TRIAGE_STATUSES), F.lit("status not allowed"))
              .when(F.col("_known").isNull(), F.lit("Finding not found")))
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").drop("_known")


def cascade_delete(deleted: DataFrame, repos: DataFrame, runs: DataFrame, stats: DataFrame,
                   findings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What is left of all four tables after some repositories are deleted."""
    ids = deleted.select("repo_id").distinct()
    gone = skew_join(runs, ids, ["repo_id"], "left_semi", ["run_id"]).select("run_id")
    return (
        repos.join(ids, "repo_id", "left_anti"),
        skew_join(runs, ids, ["repo_id"], "left_anti", ["run_id"]),
        skew_join(stats, gone, ["run_id"], "left_anti", ["path"]),
        skew_join(findings, gone, ["run_id"], "left_anti", ["id"]),
    )


def with_display(findings: DataFrame) -> DataFrame:
    """Severity to show, and a location text with its positive parts only."""
    line, col = F.col("line"), F.col("col")
    place = F.when(
        line > 0,
        F.concat(F.lit(":"), line, F.when(col > 0, F.concat(F.lit(":"), col)).otherwise("")),
    ).otherwise("")
    return findings.withColumns({
        "display_severity": F.coalesce(
            F.col("severity"), scoring.confidence_severity(F.col("confidence"))),
        "location": F.concat("file", place),
    })
