"""Engine tables derived from the given tables, as DataFrames.

`plans/view_sql.py` holds the same views as SQL text for the check in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv
from codequarry.functions import scoring
from codequarry.functions.text import lookup
from codequarry.session import widened

PART_TYPES = {
    "ECONOMY": "SQL_INJECTION", "LARGE": "HARDCODED_SECRET", "MEDIUM": "SELF_COMPARISON",
    "PROMO": "UNUSED_VARIABLE", "SMALL": "WEAK_HASH", "STANDARD": "UNUSED_FUNCTION",
}
EVENT_CATEGORIES = {
    "view": "CODE_SMELL", "signup": "STYLE", "error": "CORRECTNESS", "click": "PERFORMANCE",
    "purchase": "SECURITY",
}
EVENT_STATES = {
    "view": "pending", "signup": "running", "click": "running", "error": "failed",
    "purchase": "completed",
}
STATUS_BY_REST = ("open", "confirmed", "false_positive", "overridden")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table that is worked on heavily: spread over all slots if it has few splits."""
    return widened(table(spark, sf_dir, name).select(*columns), columns[0])


def pick(index: Column, values) -> Column:
    """Element of a short fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def doc_no(divisor: int) -> Column:
    return F.expr(f"(doc_id DIV 20) % {divisor}")


def numbered_file(key: Column) -> Column:
    return F.concat(F.lit("src/p"), (key % 50).cast("string"), F.lit(".py"))


def repos(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("repo_id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 2 == 0, "github").otherwise("zip").alias("source_type"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("c_custkey") % 97 * 3600)
        .alias("created_at"),
    )


def runs(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_custkey").alias("repo_id"),
        lookup(F.col("o_orderstatus"), {"F": "completed", "O": "running", "P": "pending"}, None)
        .alias("status"),
        F.col("o_orderdate").alias("started_at"),
    )


def findings(spark, d) -> DataFrame:
    """Findings with duplicates, from line items: 20 runs, 50 files, three sources, six types."""
    lines = wide_table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
                       "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                       "l_returnflag", "l_shipdate")
    parts = table(spark, d, "part").select("p_partkey", "p_type")
    type_ = lookup(F.col("p_type"), PART_TYPES, None)
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        (F.col("l_orderkey") % 20).alias("run_id"),
        lookup(F.col("l_returnflag"), {"A": "ast-custom", "N": "bandit", "R": "ruff"}, None)
        .alias("source"),
        type_.alias("type"),
        scoring.type_category(type_).alias("category"),
        numbered_file(F.col("l_partkey")).alias("file"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_discount") * 10).alias("confidence"),
        F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
                 "l_shipdate").alias("ord"),
    )


def raw_file_stats(spark, d) -> DataFrame:
    """Several complexity rows per (run, path), some paths without any."""
    return table(spark, d, "lineitem").where(
        (F.col("l_returnflag") == "R") & (F.col("l_partkey") % 50 >= 5)
    ).select(
        (F.col("l_orderkey") % 20).alias("run_id"),
        numbered_file(F.col("l_partkey")).alias("path"),
        (F.col("l_quantity") / 2).alias("complexity"),
        F.struct("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice",
                 "l_quantity", "l_discount", "l_tax").alias("ord"),
    )


def event_key() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def event_findings(spark, d) -> DataFrame:
    """Stored findings with ids, states and messages, from events."""
    return event_finding_columns(table(spark, d, "events"))


def event_finding_columns(events: DataFrame) -> DataFrame:
    type_ = pick(F.col("event_id") % 6, PART_TYPES.values())
    k = event_key()
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("run_id"),
        pick(F.col("event_id") % 7, fv.SOURCE_ORDER).alias("source"),
        type_.alias("type"),
        lookup(F.col("event_type"), EVENT_CATEGORIES, None).alias("category"),
        F.concat(F.lit("src/f"), k.cast("string"), F.lit(".py")).alias("file"),
        (k % 40).cast("int").alias("line"),
        (k % 3).cast("int").alias("col"),
        F.concat(type_, F.lit(" after "), "event_type").alias("message"),
        F.least(F.lit(1.0), F.col("value") / 600).alias("confidence"),
        pick(F.col("event_id") % 4, STATUS_BY_REST).alias("status"),
        F.col("ts").alias("created_at"),
    )


def triage_updates(spark, d) -> DataFrame:
    """Status updates: several per finding, some with a bad status, some for a foreign run."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("update_id"),
        (F.col("user_id") + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)).alias("run_id"),
        F.col("event_id").alias("finding_id"),
        pick(F.col("event_id") % 5, (*STATUS_BY_REST, "closed")).alias("status"),
        "ts",
    ).unionByName(e.where("event_id % 4 = 1").select(
        (F.col("event_id") + 1_000_000_000).alias("update_id"),
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("finding_id"),
        F.lit("overridden").alias("status"),
        "ts",
    ))


def run_events(spark, d) -> DataFrame:
    k = event_key()
    stages = [name for name, _ in fv.RUN_STAGES]
    return table(spark, d, "events").select(
        "event_id",
        F.col("user_id").alias("run_id"),
        lookup(F.col("event_type"), EVENT_STATES, None).alias("state"),
        pick(k % 5, stages).alias("stage"),
        F.concat(F.repeat(F.lit("x"), 2990 + k), F.lit(" at step "), k.cast("string"))
        .alias("error"),
        "ts",
    )


def files(spark, d) -> DataFrame:
    """Files of 20 repositories, from documents: sources, manifests, ignored and hidden files."""
    docs = table(spark, d, "documents")
    no, i = doc_no(12), F.col("doc_id").cast("string")
    paths = [
        F.concat(F.lit("src/a"), i, F.lit(".py")), F.concat(F.lit("web/x"), i, F.lit(".ts")),
        F.concat(F.lit("node_modules/m"), i, F.lit(".js")),
        F.concat(F.lit("docs/r"), i, F.lit(".md")), F.concat(F.lit(".git/c"), i),
        F.concat(F.lit("tests/t"), i, F.lit(".py")), F.lit("package.json"), F.lit("yarn.lock"),
        F.concat(F.lit("lib/d"), i, F.lit("/package.json")),
        F.concat(F.lit("web/Y"), i, F.lit(".JSX")), F.lit("README"),
        F.concat(F.lit(".hidden/h"), i, F.lit(".pyi")),
    ]
    rest = F.col("doc_id") % 4
    text = (
        F.when((no == 0) & (rest == 0), F.concat(F.lit("import flask\n"), "text"))
        .when((no == 0) & (rest == 1), F.concat(F.lit("from django.db import x\n"), "text"))
        .when(no.isin(6, 8), F.concat(
            pick(rest, ('{"dependencies": {"Preact-dom": "1"}', '{"devDependencies": {"express": "2"}',
                        '{"dependencies": {"vue": "3"}, "devDependencies": {"left-pad": "1"}',
                        '{"dependencies": ')),
            F.lit(', "private": true}')))
        .otherwise(F.col("text"))
    )
    return docs.select(
        F.col("source").alias("repo_id"), F.col("doc_id").alias("file_id"),
        pick(no, paths).alias("path"), F.col("n_chars").alias("size"), text.alias("content"),
    )


def archive_entries(spark, d) -> DataFrame:
    """Archive listings, from documents: 20 entries per archive, some of them hostile."""
    i = F.col("doc_id").cast("string")
    odd = F.col("doc_id") % 97
    size = F.col("n_chars") * 1000
    entry = (
        F.when(odd == 1, F.concat(F.lit("src/../../x"), i))
        .when(odd == 2, F.concat(F.lit("/abs/x"), i))
        .when(odd == 6, F.concat(F.lit("../dir"), i, F.lit("/")))
        .when(odd == 7, F.concat(F.lit("a/..b/./x"), i))
        .otherwise(F.concat(F.lit("src/x"), i))
    )
    return table(spark, d, "documents").select(
        F.concat(F.lit("z"), F.expr("doc_id DIV 20").cast("string"), F.lit(".zip"))
        .alias("archive"),
        F.col("doc_id").alias("entry_no"), entry.alias("entry"), (odd == 6).alias("is_dir"),
        size.alias("file_size"),
        F.when(odd == 5, F.expr("n_chars * 1000 DIV 150")).when(odd == 8, F.lit(0))
        .otherwise(F.expr("n_chars * 1000 DIV 3")).alias("compress_size"),
        F.when(odd == 3, F.lit(41471 * 65536)).otherwise(F.lit(33188 * 65536)).cast("bigint")
        .alias("external_attr"),
    )
