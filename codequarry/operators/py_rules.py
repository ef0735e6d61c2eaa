"""Python rules as expressions and small aggregations over the node table.

A local rule looks at one node and its children: it is a column that is a hit or null. All chosen
local rules run in one pass, without a join or a shuffle. Rules that need more of the file (imports
against loads, local variables, unreachable statements) are functions on the node table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv
from codequarry.functions import text as t
from codequarry.functions.lines import with_lines
from codequarry.functions.rows import exploded

SOURCE = "ast-custom"
TERMINATORS = ("Return", "Raise", "Break", "Continue")
STATEMENTS = (
    "FunctionDef", "AsyncFunctionDef", "ClassDef", "Return", "Delete", "Assign", "TypeAlias",
    "AugAssign", "AnnAssign", "For", "AsyncFor", "While", "If", "With", "AsyncWith", "Match",
    "Raise", "Try", "TryStar", "Assert", "Import", "ImportFrom", "Global", "Nonlocal", "Expr",
    "Pass", "Break", "Continue",
)
# Kinds that hold lists of statements, and kinds that branch.
LIST_HOLDERS = (
    "Module", "FunctionDef", "AsyncFunctionDef", "ClassDef", "For", "AsyncFor", "While", "If",
    "With", "AsyncWith", "Try", "TryStar", "ExceptHandler", "match_case",
)
DECISIONS = ("If", "IfExp", "For", "AsyncFor", "While", "ExceptHandler", "match_case")
SQL = t.words(fv.PY_SQL_WORDS)
SECRET_NAME, SECRET_VALUE = "(?iU)" + fv.PY_SECRET_NAME, "(?iU)" + fv.PY_SECRET_VALUE
KEYS = ("repo_id", "file_id", "path")


def hit(rule: str, step: int = 0, detail: Column | str | None = None) -> Column:
    """What a rule reports about a node."""
    type_, category, confidence, message = fv.PY_RULES[rule]
    return _hit(F.lit(rule), F.lit(type_), F.lit(category), F.lit(confidence), F.lit(message),
                step, F.lit(detail) if isinstance(detail, str) else detail)


def _hit(rule, type_, category, confidence, message, step, detail=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        rule.alias("rule"), type_.alias("type"), category.alias("category"),
        confidence.alias("confidence"), message.alias("message"), F.lit(step).alias("step"),
        (none if detail is None else detail).alias("detail"))


def _of(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def _kids(field: str) -> Column:
    return F.filter("kids", lambda k: k["field"] == field)


def _any(field: str, test) -> Column:
    return F.exists("kids", lambda k: (k["field"] == field) & test(k))


def _last(field: str) -> Column:
    return F.element_at(_kids(field), -1)


# --- local rules ------------------------------------------------------------
def call_sink() -> Column:
    name = F.col("dotted")
    sinks = fv.CALL_SINKS
    return F.when(_of("Call") & name.isin(*sinks), _hit(
        name,
        t.lookup(name, {n: s[0] for n, s in sinks.items()}, None),
        t.lookup(name, {n: s[1] for n, s in sinks.items()}, None),
        t.lookup(name, {n: s[2] for n, s in sinks.items()}, None),
        F.format_string(fv.SINK_MESSAGE, name), 0))


def shell_true() -> Column:
    shell = _any("keywords", lambda k: (k["name"] == "shell") & (k["const"] == "bool") & k["truth"])
    return F.when(_of("Call") & F.col("dotted").isin(*fv.SHELL_CALLS) & shell,
                  hit(fv.SHELL_TRUE_RULE, 1))


def sql_call() -> Column:
    """The first argument that builds SQL decides between concatenation and f-string."""
    safe_yaml = (F.col("dotted") == "yaml.load") & _any("keywords", lambda k: (
        (k["name"] == "Loader") & (k["value"] == "Name") & (k["text"] == "FullLoader")))
    built = F.filter("kids", lambda k: (k["field"] == "args")
                     & k["kind"].isin("BinOp", "JoinedStr") & k["text"].rlike(SQL))
    first = F.get(built, F.lit(0))["kind"]
    return (
        F.when(~_of("Call") | F.coalesce(safe_yaml, F.lit(False)), None)
        .when(first == "BinOp", hit("SQL_STRING_CONCAT", 3, "SQL constructed from concatenation"))
        .when(first == "JoinedStr", hit("SQL_FSTRING", 3))
    )


def sql_concat() -> Column:
    return F.when(_of("BinOp") & F.col("name").isin("Add", "Mod") & F.col("text").rlike(SQL),
                  hit("SQL_STRING_CONCAT"))


def sql_fstring() -> Column:
    return F.when(_of("JoinedStr") & F.col("text").rlike(SQL), hit("SQL_FSTRING"))


def _compare(test) -> Column:
    """Does any (operator, right side) of a comparison pass a test? The left side never advances."""
    left = _kids("left")[0]
    pairs = F.arrays_zip(_kids("ops").alias("op"), _kids("comparators").alias("right"))
    return _of("Compare") & F.exists(pairs, lambda p: test(left, p["op"]["kind"], p["right"]))


def none_comparison() -> Column:
    return F.when(_compare(lambda a, op, b: op.isin("Eq", "NotEq") & (
        a["const"].eqNullSafe("none") | b["const"].eqNullSafe("none"))), hit("NONE_COMPARISON"))


def constant_comparison() -> Column:
    return F.when(_compare(lambda a, op, b: op.isin("Eq", "NotEq") & a["const"].isNotNull()
                           & b["const"].isNotNull()), hit("CONSTANT_CONDITION", 1))


def self_comparison() -> Column:
    return F.when(_compare(lambda a, op, b: op.isin("Eq", "NotEq", "Is", "IsNot")
                           & (a["same"] == b["same"])), hit("SELF_COMPARISON", 2))


def constant_if() -> Column:
    test = _kids("test")[0]
    shown = F.initcap(test["truth"].cast("string"))
    return F.when(_of("If") & test["const"].isNotNull(),
                  hit("CONSTANT_CONDITION", 0, F.concat(F.lit("condition is always "), shown)))


def while_false() -> Column:
    test = _kids("test")[0]
    return F.when(_of("While") & (test["const"] == "bool") & ~test["truth"],
                  hit("CONSTANT_CONDITION", 0, "while condition is always False"))


def redundant_else() -> Column:
    return F.when(_of("If") & (F.size(_kids("orelse")) > 0)
                  & _last("body")["kind"].isin(*TERMINATORS), hit("REDUNDANT_ELSE"))


def assertion() -> Column:
    return F.when(_of("Assert"), hit("ASSERT_VALIDATION"))


def broad_except() -> Column:
    return F.when(_of("ExceptHandler") & (F.size(_kids("type")) == 0), hit("BROAD_EXCEPT"))


def empty_except() -> Column:
    sole = _last("body")
    silent = (sole["kind"] == "Pass") | (
        (sole["kind"] == "Expr") & sole["name"].isin("print", "pass"))
    return F.when(_of("ExceptHandler") & (F.size(_kids("body")) == 1) & silent,
                  hit("EMPTY_EXCEPT", 1))


def secret() -> Column:
    targets = F.filter("kids", lambda k: k["field"].isin("targets", "target")
                       & (k["kind"] == "Name") & k["name"].rlike(SECRET_NAME))
    literal = F.exists("strings", lambda s: s.rlike(SECRET_VALUE))
    return F.when(_of("Assign", "AnnAssign") & (F.size(targets) > 0) & literal,
                  hit("HARDCODED_SECRET", 0, F.concat(F.lit("assigned to "), targets[0]["name"])))


# rule -> (kinds it looks at, column)
LOCAL_RULES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "call_sink": (("Call",), call_sink),
    "shell_true": (("Call",), shell_true),
    "sql_call": (("Call",), sql_call),
    "sql_concat": (("BinOp",), sql_concat),
    "sql_fstring": (("JoinedStr",), sql_fstring),
    "none_comparison": (("Compare",), none_comparison),
    "constant_comparison": (("Compare",), constant_comparison),
    "self_comparison": (("Compare",), self_comparison),
    "constant_if": (("If",), constant_if),
    "while_false": (("While",), while_false),
    "redundant_else": (("If",), redundant_else),
    "assertion": (("Assert",), assertion),
    "broad_except": (("ExceptHandler",), broad_except),
    "empty_except": (("ExceptHandler",), empty_except),
    "secret": (("Assign", "AnnAssign"), secret),
}


def kinds_of(*rules: str) -> list[str]:
    """Node kinds that some local rules look at, to parse for these rules only."""
    return sorted({kind for r in (rules or LOCAL_RULES) for kind in LOCAL_RULES[r][0]})


def local_findings(nodes: DataFrame, *rules: str) -> DataFrame:
    """All chosen local rules in one pass over the nodes they look at."""
    chosen = [LOCAL_RULES[r][1]() for r in (rules or LOCAL_RULES)]
    hits = F.array_compact(F.array(*chosen))
    found = exploded(nodes.where(_of(*kinds_of(*rules)) & ~F.col("hidden")),
                     [*KEYS, "line", "col", "pre"], hits, "hit")
    return _findings(found.select(
        *KEYS, "line", "col", "hit.*", F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("function"),
        F.lit(1).alias("phase"), F.col("pre").alias("a"), F.col("hit.step").alias("b"),
        F.lit(0).alias("c")))


# --- rules that need more of the file ---------------------------------------
def unused_imports(nodes: DataFrame) -> DataFrame:
    """Imported names that the file never loads. Names are matched within a file."""
    loads = nodes.where(_of("Name") & (F.col("ctx") == "Load")).select("file_id", "name").distinct()
    imports = exploded(
        nodes.where(_of("Import", "ImportFrom") & ~F.col("hidden")),
        [*KEYS, "line", "col", "pre", "kind", "text"], _kids("names"), "alias", "b",
    ).select("*", F.col("alias.name").alias("name"), F.col("alias.text").alias("imported")).where(
        (F.col("kind") == "Import") | (F.col("imported") != "*"))
    unused = imports.join(loads, ["file_id", "name"], "left_anti")
    detail = F.when(F.col("kind") == "Import", F.concat(F.lit("import "), "imported")).otherwise(
        F.concat(F.lit("from "), "text", F.lit(" import "), "imported"))
    return _findings(unused.select(
        *KEYS, "line", "col", hit("UNUSED_IMPORT", 0, detail).alias("hit"), "pre", "b").select(
        *KEYS, "line", "col", "hit.*", F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("function"),
        F.lit(1).alias("phase"), F.col("pre").alias("a"), "b", F.lit(0).alias("c")))


def unused_variables(nodes: DataFrame) -> DataFrame:
    """Names that a function stores and never loads, at their first store in breadth-first order.

    One aggregation per (file, function, name). The rows of a file lie together, so most of it
    happens before the shuffle.
    """
    stored = F.col("ctx") == "Store"
    uses = nodes.where(_of("Name", "ExceptHandler") & F.col("name").isNotNull()
                       & (F.col("fn_visible") > 0)).select(
        *KEYS, "name", "ctx", "target", "kind", "depth", "pre", "line", "col",
        F.explode(F.slice("fn_chain", F.lit(1), F.col("fn_visible"))).alias("fn"))
    per_name = uses.groupBy(*KEYS, "fn", "name").agg(
        F.max(F.col("ctx") == "Load").alias("loaded"),
        F.max(F.coalesce("target", F.lit(False)) | (F.col("kind") == "ExceptHandler"))
        .alias("control"),
        F.min(F.when(stored, F.struct("depth", "pre", "line", "col"))).alias("first"),
    ).where(F.col("first").isNotNull() & ~F.coalesce("loaded", F.lit(False)) & ~F.col("control")
            & ~F.startswith("name", F.lit("_")))
    owners = nodes.where(_of("FunctionDef", "AsyncFunctionDef")).select(
        "file_id", F.col("pre").alias("fn"), F.col("name").alias("function"))
    named = per_name.join(owners, ["file_id", "fn"])
    return _findings(named.select(
        *KEYS, F.col("first.line").alias("line"), F.col("first.col").alias("col"),
        hit("UNUSED_VARIABLE").alias("hit"), "name", "function", "fn", "first").select(
        *KEYS, "line", "col", "hit.*", "name", "function", F.lit(1).alias("phase"),
        F.col("fn").alias("a"), F.col("first.depth").alias("b"), F.col("first.pre").alias("c")))


def unreachable(nodes: DataFrame) -> DataFrame:
    """Statements behind a return, raise, break or continue of the same statement list."""
    lists = nodes.where(_of(*LIST_HOLDERS))
    enders = F.filter("kids", lambda k: k["kind"].isin(*TERMINATORS))
    dead = F.filter("kids", lambda k: k["kind"].isin(*STATEMENTS) & F.exists(
        "enders", lambda e: (e["field"] == k["field"]) & (e["idx"] < k["idx"])))
    found = exploded(lists.withColumn("enders", enders).where(F.size("enders") > 0),
                     [*KEYS, "depth", "pre"], dead, "k")
    return _findings(found.select(
        *KEYS, F.col("k.line").alias("line"), F.col("k.col").alias("col"),
        hit("UNREACHABLE_CODE").alias("hit"), "depth", "pre", "k").select(
        *KEYS, "line", "col", "hit.*", F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("function"), F.lit(0).alias("phase"),
        F.col("depth").alias("a"), F.col("pre").alias("b"), F.col("k.idx").alias("c")))


# All that the rules, the complexity and the duplicates read; other kinds need not be stored.
NEEDED_KINDS = sorted({
    *LIST_HOLDERS, *DECISIONS, *kinds_of(), "BoolOp", "Name", "Import", "ImportFrom", "Error"})

FILE_RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "unused_import": unused_imports,
    "unused_variable": unused_variables,
    "unreachable": unreachable,
}


def py_findings(nodes: DataFrame, extra_rules=()) -> DataFrame:
    """All rules. `extra_rules` are further functions from the node table to findings."""
    frames = [local_findings(nodes)] + [rule(nodes) for rule in FILE_RULES.values()]
    return reduce(DataFrame.unionByName, frames + [rule(nodes) for rule in extra_rules])


def _findings(hits: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return hits.select(
        *KEYS, F.lit(SOURCE).alias("source"), "type", "category", F.col("path").alias("file"),
        "line", "col", "message",
        F.coalesce(F.nullif("detail", F.lit("")), "name", F.lit("")).alias("description"),
        "confidence",
        F.struct("rule", none.alias("snippet"), F.coalesce("detail", F.lit("")).alias("detail"),
                 "name", "function", none.alias("code"), none.alias("url"),
                 F.lit(None).cast("int").alias("complexity")).alias("evidence"),
        F.struct(F.lit(fv.SOURCE_ORDER.index(SOURCE)).alias("src"), F.col("path").alias("file"),
                 "phase", "a", "b", "c").alias("ord"),
    )


def with_snippets(findings: DataFrame, files: DataFrame, stored: DataFrame | None = None
                  ) -> DataFrame:
    """Add the lines around each finding. Call it after the dedupe: texts are joined late."""
    shown = t.snippet(F.col("_lines"), F.col("line"))
    return with_lines(findings, files, stored).withColumn(
        "evidence", F.col("evidence").withField("snippet", shown)).drop("_lines")


def complexity(nodes: DataFrame) -> DataFrame:
    """Cyclomatic complexity per function: 1 + decisions in its subtree."""
    fn = ("FunctionDef", "AsyncFunctionDef")
    weight = F.when(_of("BoolOp"), F.col("operands") - 1).otherwise(1)
    decisions = nodes.where(_of(*DECISIONS, "BoolOp") & (F.size("fn_chain") > 0)).select(
        *KEYS, F.explode("fn_chain").alias("fn"), weight.alias("weight"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("line"))
    own = nodes.where(_of(*fn)).select(
        *KEYS, F.col("pre").alias("fn"), F.lit(1).alias("weight"), "name", "line")
    return decisions.unionByName(own).groupBy(*KEYS, "fn").agg(
        F.max("name").alias("name"), F.max("line").alias("line"),
        F.sum("weight").cast("int").alias("complexity"))


def file_complexity(nodes: DataFrame) -> DataFrame:
    return complexity(nodes).groupBy(*KEYS).agg(F.max("complexity").alias("complexity"))
