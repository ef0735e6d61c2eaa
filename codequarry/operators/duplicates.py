"""Copied functions (same shape of the body) and copied texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv
from codequarry.functions import text as t
from codequarry.functions.grouping import skew_join, top_per_group
from codequarry.functions.lines import with_lines

SHOWN = fv.DUP_MEMBERS_PER_GROUP + 1
PLACE = ["path", "depth", "pre"]


def digest(text: Column) -> Column:
    """256-bit key of a long text, so that only 32 bytes travel through a shuffle."""
    return F.unhex(F.sha2(text, 256))


def functions(nodes: DataFrame, scope: str = "repo") -> DataFrame:
    """Functions with a shape of at least eight tokens. `scope='corpus'` groups across repositories."""
    size = F.size(F.split("shape", " "))
    group = F.col("repo_id") if scope == "repo" else F.lit("corpus")
    path = F.col("path")
    return nodes.where(
        F.col("kind").isin("FunctionDef", "AsyncFunctionDef") & (size >= fv.SHAPE_MIN_TOKENS)
        & path.endswith(".py") & ~t.has_part(path, fv.IGNORED_BY_TOOL["dup"])
    ).select(group.alias("scope"), "repo_id", "file_id", "path", "depth", "pre", "line", "name",
             "end_line", "end_col", "shape", digest(F.col("shape")).alias("sig"),
             size.alias("tokens"))


def _groups(fns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first members of each group of two or more, one row per such group)."""
    keys = ["scope", "sig"]
    counted = fns.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).where("members >= 2")
    first = top_per_group(fns.drop("shape"), keys, PLACE, SHOWN, rank="position")
    label = F.concat(t.base_name(F.col("path")), F.lit(":"), F.col("line").cast("string"),
                     F.lit(" ("), F.col("name"), F.lit(")"))
    listed = first.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("position", label.alias("label")))).alias("shown"),
        F.min(F.struct(*PLACE)).alias("first"))  # at most five rows per group
    others = F.array_join(F.transform(F.slice("shown", 2, fv.DUP_MEMBERS_PER_GROUP),
                                      lambda m: m["label"]), ", ")
    groups = listed.join(counted, keys).select(
        *keys, "members", others.alias("others"), "first.path", "first.depth", "first.pre")
    return first, groups


def duplicate_functions(fns: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """A finding for every member of every group, whatever the size of the group."""
    _, groups = _groups(fns)
    extra = {} if hot_rows is None else {"hot_rows": hot_rows}
    return _findings(skew_join(fns, groups.drop(*PLACE), ["scope", "sig"], "inner",
                               ["file_id", "pre"], **extra))


def duplicate_functions_capped(fns: DataFrame, max_groups: int = fv.DUP_GROUPS_PER_REPO,
                               per_group: int = fv.DUP_MEMBERS_PER_GROUP) -> DataFrame:
    """Findings for the first members of the first groups of a repository, by first appearance."""
    first, groups = _groups(fns)
    kept = top_per_group(groups, ["scope"], PLACE, max_groups, rank="group_no").drop(*PLACE)
    return _findings(first.where(F.col("position") <= per_group).join(kept, ["scope", "sig"]))


def _findings(members: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    kind = "DUPLICATE_FUNCTION"
    if "group_no" in members.columns:  # groups by first appearance, then members
        file, order = F.lit(""), ("group_no", "position", "pre")
    else:
        file, order = F.col("path"), ("depth", "pre", "line")
    return members.select(
        "repo_id", "file_id", "path", F.lit("dup").alias("source"), F.lit(kind).alias("type"),
        F.lit("CODE_SMELL").alias("category"), F.col("path").alias("file"), "line",
        F.lit(0).alias("col"),
        F.format_string(fv.DUP_MESSAGE, "name", (F.col("members") - 1).cast("string"), "others")
        .alias("message"),
        F.lit(fv.DUP_DESCRIPTION).alias("description"), F.lit(fv.DUP_CONFIDENCE).alias("confidence"),
        F.struct(F.lit(kind).alias("rule"), none.alias("snippet"), none.alias("detail"), "name",
                 none.alias("function"), none.alias("code"), none.alias("url"),
                 F.lit(None).cast("int").alias("complexity")).alias("evidence"),
        F.struct(F.lit(fv.SOURCE_ORDER.index("dup")).alias("src"), file.alias("file"),
                 F.lit(1).alias("phase"),
                 *[F.col(c).alias(n) for c, n in zip(order, "abc")]).alias("ord"),
        "members", "end_line", "end_col",
    )


def with_source(found: DataFrame, files: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Add the function's own source text as the snippet, joined late."""
    cut = F.slice("_lines", F.col("line"), F.col("end_line") - F.col("line") + 1)
    last = F.decode(F.substring(F.encode(F.element_at(cut, -1), "UTF-8"), F.lit(1),
                                F.col("end_col")), "UTF-8")
    whole = F.concat(F.slice(cut, F.lit(1), F.size(cut) - 1), F.array(last))
    text = F.ltrim(F.array_join(whole, "\n"))
    return (with_lines(found, files, stored)
            .withColumn("evidence", F.col("evidence").withField("snippet", text)).drop("_lines"))


def normal_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def duplicate_texts(documents: DataFrame, key: str, text: str, hot_rows: int | None = None
                    ) -> DataFrame:
    """Rows whose normalised text occurs more than once: copies and the first of them."""
    hashed = documents.select(key, digest(normal_text(F.col(text))).alias("sig"))
    groups = hashed.groupBy("sig").agg(F.count(F.lit(1)).alias("copies"),
                                       F.min(key).alias("first")).where("copies >= 2")
    extra = {} if hot_rows is None else {"hot_rows": hot_rows}
    return skew_join(hashed, groups, ["sig"], "inner", [key], **extra).drop("sig")
