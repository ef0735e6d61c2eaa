"""Triage and deletion written back into the stored findings, run by run."""

from __future__ import annotations

import pandas as pd
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import listing
from codequarry.operators.findings import RUN_GROUP, write_by_run


def merge_findings(spark: SparkSession, path: str, staging: str, updates: DataFrame | None = None,
                   deleted_runs: DataFrame | None = None) -> None:
    """Rewrites the runs (partitions of the table at `path`) that an update or a deletion touches; all other files stay.
    A table that was written in groups of runs is rewritten by group: its files do not grow in number with its runs.

    First the new rows of the touched runs and the names of the files to go are written below `staging`, a folder of this merge
    alone. Only then the table changes, from what is staged. After a lost driver the same call with the same
    folder finishes the work: it stages again if staging was not complete, and repeats the rest, which gives the same table.

    A run's rows are read and written where Spark puts them: a run with most of the rows is split by AQE (skewed joins,
    rebalanced writes). With few touched runs the list is broadcast by Spark's own size check and prunes the scan.
    Updates of findings that are not there, or with a status that is not allowed, change nothing (see `rejected_updates`).
    """
    stored = spark.read.parquet(path)
    ids = stored.select("run_id").limit(0)
    if not _complete(f"{staging}/gone"):
        newest = None if updates is None else listing.latest_updates(updates)
        changed = ids if newest is None else newest.select(F.col("run_id").cast(ids.schema[0].dataType))
        gone = ids if deleted_runs is None else deleted_runs.select("run_id").where("run_id IS NOT NULL").distinct()
        grouped = RUN_GROUP in stored.columns
        folder, emptied = ("run_id", gone) if not grouped else (RUN_GROUP, _groups_of(stored, changed.union(gone)))
        touched = emptied if grouped else changed.distinct().join(gone, "run_id", "left_anti")
        rows = stored.join(touched, folder, "left_semi")
        if grouped:
            rows = rows.join(gone, "run_id", "left_anti")
        if updates is not None:
            rows = listing.apply_triage(rows, updates)
        write_by_run(rows.select(stored.columns), f"{staging}/rows")
        if grouped:  # a group that keeps rows is replaced
            kept = spark.read.schema(stored.schema).parquet(f"{staging}/rows").select(RUN_GROUP).distinct()
            emptied = touched.join(kept, RUN_GROUP, "left_anti")
        files = stored.select(folder, F.col("_metadata.file_path").alias("file")).join(emptied, folder, "left_semi")
        files.select("file").distinct().write.mode("overwrite").parquet(f"{staging}/gone")
    write_by_run(spark.read.schema(stored.schema).parquet(f"{staging}/rows"), path)
    spark.read.parquet(f"{staging}/gone").mapInPandas(_removed, "file STRING").write.format("noop").mode("overwrite").save()


def _groups_of(stored: DataFrame, runs: DataFrame) -> DataFrame:
    known = stored.select("run_id", RUN_GROUP).distinct()
    return known.join(runs.distinct(), "run_id", "left_semi").select(RUN_GROUP).distinct()


def _complete(path: str) -> bool:
    """Spark leaves a file named _SUCCESS when a table is written whole."""
    fs, base = FileSystem.from_uri(path)
    return fs.get_file_info(f"{base}/_SUCCESS").type == FileType.File


def _removed(batches):
    for batch in batches:
        for file in batch["file"]:
            fs, name = FileSystem.from_uri(file)
            try:
                fs.delete_file(name)
            except FileNotFoundError:
                pass  # an earlier call was here
        yield pd.DataFrame({"file": batch["file"]})
