"""JSON reports of external analysers as findings, file statistics and tool states.

A report row has run_id, repo_id, tool, stdout and the workspace root of the tool's run. Reports
are parsed in the JVM with explicit schemas; a broken report keeps its row and gets an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv
from codequarry.functions import text as t
from codequarry.functions.rows import exploded

RUN = ("run_id", "repo_id")
BANDIT = (
    "results ARRAY<STRUCT<filename: STRING, test_id: STRING, test_name: STRING, line_number: INT, "
    "col_offset: INT, issue_text: STRING, issue_confidence: STRING, issue_cwe: STRUCT<id: STRING>, "
    "code: STRING>>"
)
RUFF = (
    "ARRAY<STRUCT<code: STRING, filename: STRING, location: STRUCT<row: INT, column: INT>, "
    "message: STRING, fix_availability: STRING, url: STRING>>"
)
ESLINT = (
    "ARRAY<STRUCT<filePath: STRING, messages: ARRAY<STRUCT<ruleId: STRING, line: INT, column: INT, "
    "message: STRING, severity: INT, fatal: BOOLEAN>>>>"
)
TS_MORPH = (
    "findings ARRAY<STRUCT<source: STRING, type: STRING, category: STRING, file: STRING, line: INT, "
    "column: INT, message: STRING, description: STRING, confidence: DOUBLE, "
    "evidence: STRUCT<rule: STRING, snippet: STRING>>>"
)


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """Report files below root/<run_id>/<repo_id>/<tool>.json."""
    place = r"([^/]+)/([^/]+)/([^/]+)\.json$"
    raw = (spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", "*.json").text(root))
    path = F.col("_metadata.file_path")
    return raw.select(
        F.regexp_extract(path, place, 1).cast("bigint").alias("run_id"),
        F.regexp_extract(path, place, 2).alias("repo_id"),
        F.regexp_extract(path, place, 3).alias("tool"),
        F.col("value").alias("stdout"), F.lit("").alias("root"))


def valid_json(text: Column) -> Column:
    """Is the whole text one JSON value? The JSON functions stop reading after the first value, so
    the text is put inside an array and an object: what follows the value breaks one of them."""
    as_item = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    as_member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.coalesce(as_item, F.lit(False)) & as_member


def checked(reports: DataFrame) -> DataFrame:
    """Adds an error text to reports that are not empty and no JSON."""
    empty = ~F.col("stdout").rlike(r"\S")
    return reports.withColumn(
        "error", F.when(~empty & ~valid_json(F.col("stdout")), F.lit(fv.BAD_JSON)))


#: The first character of each tool's reports.
OPENED_BY = {"bandit": "{", "ruff": "[", "eslint": "[", "ts-morph": "{", "radon-cc": "{", "radon-mi": "{"}


def routed(reports: DataFrame) -> DataFrame:
    """Adds `rejected` and its reason: no JSON, JSON of another kind than the tool's parser reads, or a tool without a parser.

    A report without output is accepted, whatever its tool: it has nothing to lose. All columns stay, so that a
    rejected report can be looked at and sent again.
    """
    stdout, starts = F.col("stdout"), t.lookup(F.col("tool"), OPENED_BY, None)
    full = F.coalesce(stdout.rlike(r"\S"), F.lit(False))
    reason = (F.when(full & ~valid_json(stdout), F.lit(fv.BAD_JSON))
              .when(full & starts.isNull(), F.lit(fv.NO_PARSER))
              .when(full & (F.left(F.regexp_replace(stdout, r"^\s+", ""), F.lit(1)) != starts), F.lit(fv.ODD_SHAPE)))
    return reports.withColumn("reason", reason).withColumn("rejected", F.col("reason").isNotNull())


def ran(reports: DataFrame) -> DataFrame:
    """Reports as tool runs: a tool that left a row was available, ended in time and well, unless its columns say otherwise."""
    def told(name: str, otherwise: Column) -> Column:
        return F.coalesce(name, otherwise).alias(name) if name in reports.columns else otherwise.alias(name)

    return reports.select(
        "run_id", "tool", told("available", F.lit(True)), told("timed_out", F.lit(False)),
        told("exit_code", F.lit(0)), told("error", F.col("reason")))


def _parsed(reports: DataFrame, tool: str, schema: str) -> DataFrame:
    return reports.where(F.col("tool") == tool).withColumn("_", F.from_json("stdout", schema))


def _finding(source: str, type_, category, file, line, col, message, description, confidence,
             evidence: dict[str, Column], position: Column) -> list:
    none = F.lit(None).cast("string")
    fields = {n: evidence.get(n, none).alias(n)
              for n in ("rule", "snippet", "detail", "name", "function", "code", "url")}
    number = evidence.get("complexity", F.lit(None)).cast("int").alias("complexity")
    zero = F.lit(0)
    return [
        *RUN, F.lit(source).alias("source"), type_.alias("type"), category.alias("category"),
        t.below(file, F.col("root")).alias("file"), F.coalesce(line, zero).alias("line"),
        F.coalesce(col, zero).alias("col"), F.coalesce(message, F.lit("")).alias("message"),
        description.alias("description"), confidence.alias("confidence"),
        F.struct(*fields.values(), number).alias("evidence"),
        F.struct(F.lit(fv.SOURCE_ORDER.index(source)).alias("src"), F.lit("").alias("file"),
                 F.lit(1).alias("phase"), position.cast("int").alias("a"), zero.alias("b"),
                 zero.alias("c")).alias("ord"),
    ]


def bandit(reports: DataFrame) -> DataFrame:
    rows = exploded(_parsed(reports, "bandit", BANDIT), [*RUN, "root"], "_.results", "i", "pos")
    blank = F.lit("")
    described = F.concat(
        F.coalesce("i.test_id", blank), F.lit(" "), F.coalesce("i.test_name", blank),
        F.lit(" — CWE: "), F.coalesce("i.issue_cwe.id", F.lit("n/a")))
    return rows.select(*_finding(
        "bandit", F.coalesce("i.test_name", F.lit("BANDIT")), F.lit("SECURITY"),
        F.coalesce("i.filename", "root"), F.col("i.line_number"), F.col("i.col_offset"),
        F.col("i.issue_text"), described,
        t.lookup(F.upper("i.issue_confidence"), fv.BANDIT_CONFIDENCE, 0.5),
        {"rule": F.col("i.test_id"),
         "code": F.left(F.coalesce("i.code", blank), F.lit(fv.BANDIT_CODE_CHARS))},
        F.col("pos")))


def ruff(reports: DataFrame) -> DataFrame:
    rows = exploded(_parsed(reports, "ruff", RUFF), [*RUN, "root"], "_", "i", "pos")
    blank = F.lit("")
    described = F.concat(F.lit("Ruff "), F.coalesce("i.code", blank), F.lit(" — "),
                         F.coalesce("i.fix_availability", blank))
    return rows.select(*_finding(
        "ruff", F.coalesce("i.code", F.lit("RUFF")),
        t.lookup(F.left("i.code", F.lit(1)), fv.RUFF_CATEGORY, "CODE_SMELL"),
        F.coalesce("i.filename", "root"), F.col("i.location.row"), F.col("i.location.column"),
        F.col("i.message"), described, F.lit(0.55),
        {"rule": F.col("i.code"), "url": F.col("i.url")}, F.col("pos")))


def eslint(reports: DataFrame) -> DataFrame:
    files = exploded(_parsed(reports, "eslint", ESLINT), [*RUN, "root"], "_", "f", "file_no")
    rows = exploded(files, [*RUN, "root", "file_no", "f.filePath"], "f.messages", "i", "pos").where(
        ~F.coalesce("i.fatal", F.lit(False)))
    found = rows.select(*_finding(
        "eslint", F.coalesce(F.nullif("i.ruleId", F.lit("")), F.lit("SYNTAX")),
        t.lookup(F.col("i.ruleId"), fv.ESLINT_CATEGORY, "CORRECTNESS"),
        F.coalesce("filePath", F.lit("")), F.col("i.line"), F.col("i.column"), F.col("i.message"),
        F.concat(F.lit("severity "), F.coalesce(F.col("i.severity").cast("string"),
                                                F.lit("None"))),
        F.lit(0.6), {"rule": F.col("i.ruleId")}, F.col("file_no")), "pos")
    return found.withColumn("ord", F.col("ord").withField("b", F.col("pos"))).drop("pos")


def ts_morph(reports: DataFrame) -> DataFrame:
    rows = exploded(_parsed(reports, "ts-morph", TS_MORPH), [*RUN, "root"], "_.findings", "i",
                    "pos")
    return rows.select(*_finding(
        "ts-morph", F.col("i.type"), F.col("i.category"), F.col("i.file"), F.col("i.line"),
        F.col("i.column"), F.col("i.message"), F.coalesce("i.description", F.lit("")),
        F.coalesce("i.confidence", F.lit(0.5)),
        {"rule": F.col("i.evidence.rule"), "snippet": F.col("i.evidence.snippet")}, F.col("pos")))


def radon_cc(reports: DataFrame) -> DataFrame:
    """Largest block complexity per file; a file with an error object has none."""
    blocks = "MAP<STRING, STRING>"
    rows = _parsed(reports, "radon-cc", blocks).select(
        *RUN, "root", F.explode_outer("_").alias("file", "blocks")).where("file IS NOT NULL")
    parsed = F.from_json("blocks", "ARRAY<STRUCT<complexity: DOUBLE>>")
    worst = F.array_max(F.transform(parsed, lambda b: F.coalesce(b["complexity"], F.lit(0.0))))
    return rows.select(
        *RUN, t.below(F.col("file"), F.col("root")).alias("path"),
        F.when(F.startswith("blocks", F.lit("[")), F.coalesce(worst, F.lit(0.0)))
        .alias("complexity"))


def radon_mi(reports: DataFrame) -> DataFrame:
    """Maintainability per file, as a number or an object with `mi`, below an optional `mi` key."""
    outer = _parsed(reports, "radon-mi", "MAP<STRING, STRING>").select(
        *RUN, "root", F.coalesce(F.from_json(F.col("_")["mi"], "MAP<STRING, STRING>"), "_")
        .alias("m"))
    rows = outer.select(*RUN, "root", F.explode_outer("m").alias("file", "v")).where(
        "file IS NOT NULL")
    value = F.coalesce(F.get_json_object("v", "$.mi"), "v").try_cast("double")
    return rows.select(*RUN, t.below(F.col("file"), F.col("root")).alias("path"),
                       F.round(value, 2).alias("maintainability"))


def file_stats(cc: DataFrame, mi: DataFrame, loc: DataFrame | None = None) -> DataFrame:
    """File statistics of Python files: complexity and maintainability merged by path.

    `loc` (run_id, path, loc) adds line counts. All sides have one row per (run, path).
    """
    keys = [*RUN, "path"]
    out = cc.join(mi, keys, "full_outer").select(
        *keys, F.lit("python").alias("language"),
        F.coalesce("complexity", F.lit(0.0)).alias("complexity"), "maintainability")
    if loc is None:
        return out.withColumn("loc", F.lit(0))
    return out.join(loc, ["run_id", "path"], "left").withColumn(
        "loc", F.coalesce("loc", F.lit(0)))


def radon_findings(stats: DataFrame, limit: int = fv.RADON_LIMIT) -> DataFrame:
    shown = F.col("complexity").cast("bigint").cast("string")
    rows = stats.where(F.col("complexity") >= limit).withColumn("root", F.lit(""))
    found = rows.select(*_finding(
        "radon", F.lit("HIGH_COMPLEXITY"), F.lit("CODE_SMELL"), F.col("path"), F.lit(0), F.lit(0),
        F.format_string(fv.RADON_MESSAGE, shown),
        F.concat(F.lit("max complexity "), shown), F.lit(0.7),
        {"rule": F.lit(f"CC>={limit}"), "complexity": F.col("complexity")}, F.lit(0)))
    return found.withColumn("ord", F.col("ord").withField("file", F.col("file")))


def tool_status(runs_of_tools: DataFrame) -> DataFrame:
    """State of each tool run: unavailable, timed out, odd exit code with an error, or fine."""
    available, timed_out = F.col("available"), F.col("timed_out")
    odd = ~F.col("exit_code").isin(0, 1, 2) & (F.coalesce("error", F.lit("")) != "")
    state = (F.when(~available, F.lit("unavailable")).when(timed_out, F.lit("timed out"))
             .when(odd, F.lit("failed")).otherwise(F.lit("ok")))
    return runs_of_tools.select(
        "run_id", "tool", "available", state.alias("state"),
        F.when(available & timed_out, F.lit(True)).alias("timed_out"),
        F.when(available & ~timed_out, F.col("exit_code")).alias("exit_code"),
        F.when(~available | timed_out | odd, F.col("error")).alias("error"))
