"""Late join of findings with the lines of their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.text import source_lines

MAX_BROADCAST_IDS = 1_000_000  # 8 MB of file ids


def with_lines(findings: DataFrame, files: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Findings with `_lines`, the lines of their file; null for a finding without a file.

    Texts are the widest rows of all, so those of files without findings should not be shuffled.
    With `stored` (a written table with at least the findings' file ids) the ids are counted, and
    up to the limit they are broadcast to drop the other files inside the scan. Beyond it, the join
    shuffles the texts, unless the corpus is bucketed by file_id.
    """
    texts = files.select("file_id", "content")
    if stored is not None:
        ids = stored.where(F.col("file_id").isNotNull()).select("file_id").distinct()
        if ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
            texts = texts.join(F.broadcast(ids), "file_id", "left_semi")
    lines = texts.select("file_id", source_lines(F.col("content")).alias("_lines"),
                         F.lit(0).alias("_slot"))
    # findings without a file (from reports) match nothing, and are spread instead of gathered
    slot = F.when(F.col("file_id").isNull(), F.pmod(F.hash("file", "line"), F.lit(256))).otherwise(0)
    return findings.withColumn("_slot", slot).join(lines, ["file_id", "_slot"], "left").drop("_slot")
