"""Rules given as SQL text over the node and token tables.

A rule is a name and a SELECT over `{py_nodes}` or `{js_tokens}` that returns repo_id, file_id, path, line, col, type,
category, confidence and message; its name goes into the evidence. All rules become one query, so a scan serves its own
pushed filter only and nothing is collected between rules.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv
from codequarry.operators import js_rules

#: Columns that a rule's text must return, and their types.
RETURNED = {"repo_id": "string", "file_id": "bigint", "path": "string", "line": "int", "col": "int", "type": "string",
            "category": "string", "confidence": "double", "message": "string"}


def sql_findings(rules: Mapping[str, str], nodes: DataFrame, tokens: DataFrame, source: str = "ast-custom") -> DataFrame:
    """Findings of all rules (name -> text). tokens: the table of files with token arrays."""
    views = {"py_nodes": nodes, "js_tokens": js_rules.token_rows(tokens)}
    found = []
    for name, text in rules.items():
        used = {k: df for k, df in views.items() if "{" + k + "}" in text}
        rows = nodes.sparkSession.sql(text, **used)
        lacking = [c for c in RETURNED if c not in rows.columns]
        if lacking:
            raise ValueError(f"rule {name} does not return {', '.join(lacking)}")
        found.append(rows.select(*[F.col(c).cast(t).alias(c) for c, t in RETURNED.items()], F.lit(name).alias("rule")))
    if not found:
        raise ValueError("no rules")
    rows, none = reduce(DataFrame.unionByName, found), F.lit(None).cast("string")
    return rows.select(
        "repo_id", "file_id", "path", F.lit(source).alias("source"), "type", "category", F.col("path").alias("file"), "line", "col",
        "message", F.col("rule").alias("description"), "confidence",
        F.struct("rule", none.alias("snippet"), none.alias("detail"), none.alias("name"), none.alias("function"), none.alias("code"),
                 none.alias("url"), F.lit(None).cast("int").alias("complexity")).alias("evidence"),
        # after the built-in rules of the same file, by line
        F.struct(F.lit(fv.SOURCE_ORDER.index(source)).alias("src"), F.col("path").alias("file"), F.lit(9).alias("phase"),
                 F.col("line").alias("a"), F.col("col").alias("b"), F.lit(0).alias("c")).alias("ord"))
