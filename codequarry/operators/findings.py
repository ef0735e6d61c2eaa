"""Merging of findings: defaults, language gate, caps per source, first-wins dedupe, sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv
from codequarry.functions.grouping import first_wins, skew_join, top_per_group
from codequarry.functions.text import lookup
from codequarry.schemas import FINDING_COLUMNS

FINDING_KEY = ("run_id", "source", "type", "file", "line")
RUN_GROUP = "run_group"  # folders of a table that keeps many runs in one
# Languages that switch an analyser on.
GATES = {
    "ast-custom": ("python",), "bandit": ("python",), "ruff": ("python",), "radon": ("python",),
    "dup": ("python",), "ts-morph": ("javascript", "typescript"), "eslint": ("javascript",),
}


def with_defaults(findings: DataFrame) -> DataFrame:
    """Column defaults of the findings table."""
    defaults = {"line": 0, "col": 0, "message": "", "description": "", "confidence": 0.5}
    return findings.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in findings.columns}
    )


def gate_by_language(findings: DataFrame, languages: DataFrame) -> DataFrame:
    """Keep findings of analysers whose language is present in the repository.

    `languages` has one row per (repo_id, language). It shrinks to one row per repository before
    the join; findings of a hot repository are shared among tasks.
    """
    present = languages.groupBy("repo_id").agg(F.collect_set("language").alias("_languages"))
    joined = skew_join(findings, present, ["repo_id"], "inner", _spread(findings))
    needed = lookup(
        F.col("source"),
        {s: list(v) for s, v in GATES.items()},
        F.array().cast("array<string>"),
    )
    return joined.where(F.arrays_overlap("_languages", needed)).drop("_languages")


def cap_per_source(findings: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """The first N findings of each source and run in emission order; uncapped sources pass."""
    caps = fv.SOURCE_CAPS if caps is None else caps
    widest = max(caps.values())
    capped = top_per_group(findings.where(F.col("source").isin(*caps)), ["run_id", "source"],
                           ["ord"], widest, rank="_rank")
    capped = capped.where(F.col("_rank") <= lookup(F.col("source"), caps, widest)).drop("_rank")
    return findings.where(~F.col("source").isin(*caps)).unionByName(capped)


def dedupe(findings: DataFrame) -> DataFrame:
    """First finding in emission order per (run, source, type, file, line)."""
    return first_wins(findings, FINDING_KEY, ["ord"])


def merge(sources: dict[str, DataFrame], caps: dict[str, int] | None = None) -> DataFrame:
    """All sources by name: dedupe, then defaults. Each source is read once.

    `caps` (source -> rows per run, before the dedupe) is for displays; without it nothing is cut.
    """
    caps = caps or {}
    capped = [
        top_per_group(df, ["run_id"], ["ord"], caps[name]) if name in caps else df
        for name, df in sources.items()
    ]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), capped)
    return with_defaults(dedupe(union))


def counts_per_run(findings: DataFrame) -> DataFrame:
    return findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("findings"))


def write_findings(findings: DataFrame, path: str) -> None:
    """Sink, partitioned by run. Re-running a run replaces its partition only."""
    columns = [c for c in findings.columns if c != "ord"]
    write_by_run(with_defaults(findings).select(*columns), path)


def write_file_stats(stats: DataFrame, path: str) -> None:
    write_by_run(stats, path)


def write_by_run(df: DataFrame, path: str, groups: int | None = None) -> None:
    """Rows of a run are brought together first, so that a task writes few files; rebalancing
    splits a run that is too large for one task and joins small ones.

    A run has a folder of its own. With `groups`, or for rows that have a group, the folders are so many
    groups of runs instead (column RUN_GROUP, a hash of the run), each sorted by run: for tables of
    very many small runs, which would be as many folders and files."""
    if groups is not None:
        df = df.withColumn(RUN_GROUP, F.pmod(F.xxhash64("run_id"), F.lit(groups)).cast("int"))
    folder = RUN_GROUP if RUN_GROUP in df.columns else "run_id"
    rows = df.hint("rebalance", folder)
    if folder == RUN_GROUP:
        rows = rows.sortWithinPartitions(RUN_GROUP, "run_id")
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(folder).parquet(path))


def _spread(findings: DataFrame) -> list[str]:
    return [c for c in ("file", "line", "type", "ord") if c in findings.columns]


def finding_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in FINDING_COLUMNS if c in df.columns])
