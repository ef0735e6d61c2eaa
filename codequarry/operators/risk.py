"""Heuristic risk scores for whole findings tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv
from codequarry.functions import scoring
from codequarry.session import scratch_path


def latest_stats(stats: DataFrame, order: str = "ord") -> DataFrame:
    """One complexity per (run, path); of several rows the last one counts."""
    return stats.groupBy("run_id", "path").agg(
        F.max_by("complexity", order).alias("complexity"))


def score(findings: DataFrame, stats: DataFrame) -> DataFrame:
    """Add risk_raw, risk_score, severity and model_version.

    `stats` has one row per (run_id, path). A file without statistics gets no boost. One plain join: the findings are
    read once, statistics are broadcast where Spark's own size check allows, tables bucketed by `store` join without a
    shuffle, and a file with very many findings is split by adaptive execution (the left side of a left join).
    """
    by_file = stats.select("run_id", F.col("path").alias("file"),
                           F.col("complexity").alias("_complexity"))
    joined = findings.join(by_file, ["run_id", "file"], "left")
    return scored(joined, F.col("_complexity")).drop("_complexity")


def store(findings: DataFrame, stats: DataFrame, name: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Write both sides of scoring as tables bucketed by run and file, and read them back.

    Each scoring after that joins bucket by bucket, without a shuffle. A bucket is one task: choose as many buckets as
    keep the largest file's findings bearable. `name` must be new in the catalogue.
    """
    tables = []
    for df, key, kind in ((findings, "file", "findings"), (stats, "path", "stats")):
        # rows of a bucket meet in one task before they are written, so that a bucket is one file
        spread = df.repartition(buckets, "run_id", key)
        spread.write.bucketBy(buckets, "run_id", key).sortBy("run_id", key).saveAsTable(
            f"{name}_{kind}", format="parquet", path=scratch_path(df.sparkSession, f"{name}-{kind}"))
        tables.append(df.sparkSession.table(f"{name}_{kind}"))
    return tables[0], tables[1]


def scored(findings: DataFrame, complexity) -> DataFrame:
    raw = scoring.risk_raw(F.col("type"), F.col("category"), F.col("confidence"), complexity)
    return (
        findings.withColumn("risk_raw", raw)
        .withColumn("risk_score", scoring.rounded(F.col("risk_raw")))
        .withColumn("severity", scoring.severity(F.col("risk_raw")))
        .withColumn("model_version", F.lit(fv.MODEL_VERSION))
    )


def rescore_completed(findings: DataFrame, stats: DataFrame, runs: DataFrame) -> DataFrame:
    """Score again, for completed runs only: a semi join with the runs first, then one join."""
    done = runs.where(F.col("status") == "completed").select("run_id")
    return score(findings.join(done, "run_id", "left_semi"), stats)


def refused_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") != "completed").select(
        "run_id", "status", F.lit("Run has not completed yet").alias("reason"))


def severity_histogram(findings: DataFrame) -> DataFrame:
    """One row per run, one count per severity band."""
    bands = [name for _, name in fv.SEVERITY_BANDS] + [fv.LOWEST_SEVERITY]
    return findings.groupBy("run_id").agg(
        *[F.count_if(F.col("severity") == b).alias(b) for b in bands])
