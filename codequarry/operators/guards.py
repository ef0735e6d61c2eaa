"""Intake checks over archive listings, uploads and repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv
from codequarry.functions.grouping import skew_join

MB = 1024 * 1024


def _escapes(entry: Column) -> Column:
    """Does the path climb above its root at any point, when resolved part by part?"""
    steps = F.filter(F.split(entry, "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(
        steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")),
        lambda acc, p: F.struct(
            (acc["now"] + F.when(p == "..", -1).otherwise(1)).alias("now"),
            F.least(acc["low"], acc["now"] + F.when(p == "..", -1).otherwise(1)).alias("low"),
        ),
    )
    return depth["low"] < 0


def entry_reason(max_file_mb: int = fv.MAX_FILE_MB, max_ratio: int = fv.MAX_ZIP_RATIO) -> Column:
    """First failed check of one entry, null when it is safe. Directories are exempt."""
    entry = F.col("entry")
    link = F.shiftrightunsigned(F.col("external_attr"), 16).bitwiseAND(F.lit(0o170000)) == 0o120000
    ratio = F.try_divide(F.col("file_size"), F.col("compress_size"))
    return (
        F.when(F.col("is_dir"), F.lit(None).cast("string"))
        .when(entry.startswith("/") | F.array_contains(F.split(entry, "/"), ".."),
              F.lit("unsafe path"))
        .when(link, F.lit("symlink"))
        .when(F.col("file_size") > max_file_mb * MB, F.lit("too large"))
        .when(ratio > max_ratio, F.lit("suspicious ratio"))
        .when(_escapes(entry), F.lit("escapes workspace"))
    )


def check_entries(entries: DataFrame, **limits) -> DataFrame:
    return entries.withColumn("reason", entry_reason(**limits))


def archive_totals(entries: DataFrame, max_count: int = fv.MAX_FILE_COUNT,
                   max_expanded_mb: int = fv.MAX_EXPANDED_MB) -> DataFrame:
    """Entry count (with directories) and expanded bytes (without) per archive."""
    sums = entries.groupBy("archive").agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("file_size"))), F.lit(0)).cast("bigint")
        .alias("expanded"),
    )
    return sums.withColumn("reason", F.when(F.col("entries") > max_count, "too many entries")
                           .when(F.col("expanded") > max_expanded_mb * MB, "expands too far"))


def repo_totals(files: DataFrame, max_count: int = fv.MAX_FILE_COUNT,
                max_mb: int = fv.MAX_REPO_MB) -> DataFrame:
    """File count and bytes per repository; ignored directories count too."""
    sums = files.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").cast("bigint").alias("bytes"))
    return sums.withColumn("reason", F.when(F.col("files") > max_count, "too many files")
                           .when(F.col("bytes") > max_mb * MB, "repository too large"))


def check_uploads(uploads: DataFrame, max_mb: int = fv.MAX_ZIP_MB) -> DataFrame:
    return uploads.withColumn(
        "reason",
        F.when(~F.lower("path").endswith(".zip"), "Only .zip files are accepted")
        .when(F.col("length") > max_mb * MB, f"Upload exceeds {max_mb} MB limit"))


def verdicts(entries: DataFrame, max_count: int = fv.MAX_FILE_COUNT,
             max_expanded_mb: int = fv.MAX_EXPANDED_MB, max_repo_mb: int = fv.MAX_REPO_MB,
             **limits) -> DataFrame:
    """One row per archive: the first failed check, or null when it is accepted.

    Order of checks: errors of a broken archive, entry count, expanded bytes, entries in archive order,
    workspace totals. All of it is one partial aggregation, so a huge archive never sits in one task.
    """
    broken = F.col("error") if "error" in entries.columns else F.lit(None).cast("string")
    entries = entries.withColumn("error", broken)
    bad = F.col("reason").isNotNull()
    sums = check_entries(entries, **limits).groupBy("archive").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("file_size"))), F.lit(0)).alias("bytes"),
        F.count_if(~F.col("is_dir")).alias("files"),
        F.min(F.when(bad, F.struct("entry_no", "reason", "entry"))).alias("first_bad"),
        F.min("error").alias("error"),
    )
    return sums.select(
        "archive",
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("n") > max_count, F.lit("too many entries"))
        .when(F.col("bytes") > max_expanded_mb * MB, F.lit("expands too far"))
        .when(F.col("first_bad").isNotNull(), F.col("first_bad.reason"))
        .when(F.col("files") > max_count, F.lit("too many files"))
        .when(F.col("bytes") > max_repo_mb * MB, F.lit("repository too large"))
        .alias("reason"),
        F.when(F.col("error").isNull() & (F.col("n") <= max_count) & (F.col("bytes") <= max_expanded_mb * MB),
               F.col("first_bad.entry")).alias("entry"),
    )


def accepted_entries(entries: DataFrame, **limits) -> DataFrame:
    """Entries of archives that pass all checks."""
    refused = verdicts(entries, **limits).where("reason IS NOT NULL").select("archive")
    return skew_join(entries, refused, ["archive"], "left_anti", ["entry_no"])
