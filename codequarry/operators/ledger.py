"""Run state as data: an append-only event log and the views on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv
from codequarry.functions.lines import MAX_BROADCAST_IDS
from codequarry.functions.text import lookup
from codequarry.session import written


def with_progress(events: DataFrame) -> DataFrame:
    """Progress percentage of each stage event; unknown stages have none."""
    return events.withColumn(
        "progress", lookup(F.col("stage"), dict(fv.RUN_STAGES), F.lit(None).cast("int")))


def latest(events: DataFrame) -> DataFrame:
    """Newest state, stage, progress and error of each run.

    Error texts are the widest part by far, and only the newest event's is wanted. The newest time
    of each run and the last id of that time come first, by hash aggregation of narrow columns;
    whole events are taken for those only, so no sort holds the others.
    """
    last = events.groupBy("run_id").agg(F.max("ts").alias("ts"))
    ids = _at(events.select("run_id", "ts", "event_id"), written(last, "run-last"))
    newest = ids.groupBy("run_id", "ts").agg(F.max("event_id").alias("event_id"))
    error = F.when(F.col("state") == "failed", F.right(F.col("error"), F.lit(fv.ERROR_CHARS)))
    found = _at(events.withColumn("error", error), written(newest, "run-newest"))
    # equal ids of one time are left: any of them stands for the run
    one = F.max_by(F.struct("state", "stage", "progress", "error", "ts"), F.struct("ts", "event_id"))
    return with_progress(found).groupBy("run_id").agg(one.alias("e")).select(
        "run_id", "e.state", "e.stage", "e.progress", "e.error", "e.ts")


def _at(events: DataFrame, keys: DataFrame) -> DataFrame:
    """Events that agree with one of the keys (a written table) in all its columns; nulls agree.

    The keys are counted: up to the limit they are broadcast, so that events are dropped in the scan.
    Beyond it the events are shuffled, and met with a hash table of keys rather than sorted.
    """
    few = keys.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    same = reduce(lambda a, b: a & b, [events[c].eqNullSafe(keys[c]) for c in keys.columns])
    return events.join(F.broadcast(keys) if few else keys.hint("shuffle_hash"), same, "left_semi")


def pending(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Runs whose log has no completion yet: what a batch still has to analyse."""
    done = events.where(F.col("state") == "completed").select("run_id").distinct()
    return runs.join(done, "run_id", "left_anti")
