"""Registered queries on analyser reports. The reports are made from table rows, as JSON text."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.plans import views as v
from codequarry.plans.analysis import take_reports
from codequarry.plans.registry import register
from codequarry.sources import reports as r

ROOT = "/work/ws"
LINES = """base AS (
  SELECT event_id, user_id AS run_id, value, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events)"""


def report(spark, d, tool: str, body) -> object:
    """One report per event. Two issues each, so that exploding keeps the order inside a report."""
    e = v.wide_table(spark, d, "events", "event_id", "user_id", "event_type", "value",
                     "props").withColumn("k", v.event_key())
    return e.select(
        F.col("user_id").alias("run_id"), F.concat(F.lit("r"), F.col("user_id").cast("string"))
        .alias("repo_id"), F.lit(tool).alias("tool"), body.alias("stdout"),
        F.lit(ROOT).alias("root"))


def path(ext: str = ".py"):
    """An absolute path below the workspace, or a relative one."""
    name = F.concat(F.lit("src/f"), F.col("event_id").cast("string"), F.lit(ext))
    return F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(ROOT + "/"), name)).otherwise(name)


def two(*fields):
    """An array of two issues: the second lies on the next line."""
    return F.array(*[F.struct(*[f(i) if callable(f) else f for f in fields]) for i in (0, 1)])


@register("norm_bandit", "WITH " + LINES + """
SELECT run_id, 'src/f' || event_id || '.py' AS file, CASE WHEN k % 7 = 0 THEN 'BANDIT' ELSE event_type END AS type,
  'SECURITY' AS category, k + i AS line, k % 4 AS col,
  'B' || (k % 9) || ' ' || CASE WHEN k % 7 = 0 THEN '' ELSE event_type END || ' — CWE: '
    || CASE WHEN k % 3 = 0 THEN 'n/a' ELSE CAST(k AS VARCHAR) END AS description,
  CASE k % 5 WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN CAST(0.35 AS DOUBLE) WHEN 2 THEN CAST(0.6 AS DOUBLE)
    WHEN 3 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence,
  'B' || (k % 9) AS rule, CASE WHEN k % 10 = 0 THEN least(1960 + k, 2000) ELSE k END AS code_length
FROM base, (SELECT unnest([0, 1]) AS i)""")
def norm_bandit(spark, d):
    k = F.col("k")
    issues = two(
        path().alias("filename"), F.concat(F.lit("B"), (k % 9).cast("string")).alias("test_id"),
        F.when(k % 7 != 0, F.col("event_type")).alias("test_name"),
        lambda i: (k + i).alias("line_number"),
        (k % 4).alias("col_offset"), F.lit("text").alias("issue_text"),
        v.pick(k % 5, ("UNDEFINED", "low", "Medium", "HIGH", "odd")).alias("issue_confidence"),
        F.when(k % 3 != 0, F.struct(k.alias("id"))).alias("issue_cwe"),
        F.repeat(F.lit("c"), F.when(k % 10 == 0, 1960 + k).otherwise(k)).alias("code"))
    found = r.bandit(report(spark, d, "bandit", F.to_json(F.struct(issues.alias("results")))))
    return found.select("run_id", "file", "type", "category", "line", "col", "description",
                        "confidence", "evidence.rule",
                        F.length("evidence.code").alias("code_length"))


@register("norm_ruff", "WITH " + LINES + """
SELECT run_id, 'src/f' || event_id || '.py' AS file, code AS type,
  CASE WHEN code[1] IN ('F', 'B', 'T') THEN 'CORRECTNESS' WHEN code[1] IN ('E', 'W', 'I', 'N', 'D') THEN 'STYLE'
       WHEN code[1] = 'S' THEN 'SECURITY' ELSE 'CODE_SMELL' END AS category,
  k + i AS line, k % 4 AS col, 'Ruff ' || code || ' — ' || event_type AS description, CAST(0.55 AS DOUBLE) AS confidence,
  'u' || k AS url
FROM (SELECT *, ['F1', 'E2', 'W3', 'B4', 'S5', 'A6', 'I7', 'N8', 'C9', 'D1', 'T2', 'UP3', 'Q4'][k % 13 + 1] AS code FROM base),
     (SELECT unnest([0, 1]) AS i)""")
def norm_ruff(spark, d):
    k = F.col("k")
    codes = ("F1", "E2", "W3", "B4", "S5", "A6", "I7", "N8", "C9", "D1", "T2", "UP3", "Q4")
    issues = two(
        v.pick(k % 13, codes).alias("code"), path().alias("filename"),
        lambda i: F.struct((k + i).alias("row"), (k % 4).alias("column")).alias("location"),
        F.lit("text").alias("message"), F.col("event_type").alias("fix_availability"),
        F.concat(F.lit("u"), k.cast("string")).alias("url"))
    return r.ruff(report(spark, d, "ruff", F.to_json(issues))).select(
        "run_id", "file", "type", "category", "line", "col", "description", "confidence",
        "evidence.url")


RULES = ("no-eval", "no-empty", "no-self-compare", "no-such-rule", None, "no-unused-vars")


@register("norm_eslint", "WITH " + LINES + """
SELECT run_id, 'src/f' || event_id || '.js' AS file, coalesce(rule, 'SYNTAX') AS type,
  CASE rule WHEN 'no-eval' THEN 'SECURITY' WHEN 'no-empty' THEN 'CODE_SMELL' WHEN 'no-unused-vars' THEN 'CODE_SMELL'
    ELSE 'CORRECTNESS' END AS category,
  k + i AS line, k % 4 AS col, 'severity ' || (k % 2 + 1) AS description, CAST(0.6 AS DOUBLE) AS confidence
FROM (SELECT *, ['no-eval', 'no-empty', 'no-self-compare', 'no-such-rule', NULL, 'no-unused-vars'][k % 6 + 1] AS rule FROM base),
     (SELECT unnest([0, 1]) AS i)
WHERE NOT (k % 5 = 0 AND i = 1)""")
def norm_eslint(spark, d):
    k = F.col("k")
    messages = two(
        v.pick(k % 6, RULES).alias("ruleId"), lambda i: (k + i).alias("line"),
        (k % 4).alias("column"), F.lit("text").alias("message"), (k % 2 + 1).alias("severity"),
        lambda i: ((k % 5 == 0) & F.lit(i == 1)).alias("fatal"))
    body = F.to_json(F.array(F.struct(path(".js").alias("filePath"), messages.alias("messages"))))
    return r.eslint(report(spark, d, "eslint", body)).select(
        "run_id", "file", "type", "category", "line", "col", "description", "confidence")


@register("norm_tsmorph", "WITH " + LINES + """
SELECT run_id, 'src/f' || event_id || '.ts' AS file, event_type AS type, 'SECURITY' AS category, k + i AS line,
  CASE WHEN k % 4 = 0 THEN 0 ELSE k % 4 END AS col, CAST(0.85 AS DOUBLE) AS confidence, 's' || k AS snippet
FROM base, (SELECT unnest([0, 1]) AS i) WHERE k % 11 <> 0""")
def norm_tsmorph(spark, d):
    k = F.col("k")
    found = two(
        F.lit("ts-morph").alias("source"), F.col("event_type").alias("type"),
        F.lit("SECURITY").alias("category"), path(".ts").alias("file"),
        lambda i: (k + i).alias("line"),
        F.when(k % 4 != 0, k % 4).alias("column"), F.lit("text").alias("message"),
        F.lit("detail").alias("description"), F.lit(0.85).alias("confidence"),
        F.struct(F.col("event_type").alias("rule"), F.concat(F.lit("s"), k.cast("string"))
                 .alias("snippet")).alias("evidence"))
    whole = F.to_json(F.struct(found.alias("findings")))
    body = F.when(k % 11 == 0, F.left(whole, F.lit(5))).otherwise(whole)
    return r.ts_morph(report(spark, d, "ts-morph", body)).select(
        "run_id", "file", "type", "category", "line", "col", "confidence", "evidence.snippet")


@register("report_parse", "WITH " + LINES + """
SELECT event_id, CASE WHEN k % 3 = 1 THEN 'Tool output was not valid JSON' END AS error FROM base""")
def report_parse(spark, d):
    rest = v.event_key() % 3
    body = F.when(rest == 0, F.col("props")).when(rest == 1, F.concat("props", F.lit("}")))
    e = v.table(spark, d, "events").withColumn("stdout", body.otherwise(F.lit(" \n")))
    return r.checked(e).select("event_id", "error")


V_RADON = "WITH " + LINES + """,
cc AS (SELECT run_id, 'src/f' || event_id || '.py' AS path,
         CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(k % 40 AS DOUBLE) END AS complexity
       FROM base WHERE event_id % 4 <> 0),
mi AS (SELECT run_id, 'src/f' || event_id || '.py' AS path, value AS maintainability FROM base WHERE event_id % 5 <> 0)
"""


def radon(spark, d):
    k = F.col("k")
    blocks = F.to_json(F.array(F.struct((k % 40).alias("complexity")), F.struct(
        F.greatest(k % 40 - 3, F.lit(0)).alias("complexity"))))
    blocks = (F.when(k % 6 == 0, F.lit('{"error": "no parse"}')).when(k % 6 == 1, F.lit("[]"))
              .otherwise(blocks))
    cc = F.concat(F.lit('{"'), path(), F.lit('": '), blocks, F.lit("}"))
    flat = F.concat(F.lit('{"'), path(), F.lit('": '), F.col("value").cast("string"), F.lit("}"))
    deep = F.concat(F.lit('{"'), path(), F.lit('": {"mi": '), F.col("value").cast("string"),
                    F.lit("}}"))
    mi = (F.when(k % 3 == 0, F.concat(F.lit('{"mi": '), flat, F.lit("}")))
          .when(k % 3 == 1, deep).otherwise(flat))
    cc = F.when(F.col("event_id") % 4 != 0, cc)
    mi = F.when(F.col("event_id") % 5 != 0, mi)
    return (r.radon_cc(report(spark, d, "radon-cc", cc)),
            r.radon_mi(report(spark, d, "radon-mi", mi)))


@register("norm_radon", V_RADON + """
SELECT run_id, path, 'cc' AS kind, complexity AS value FROM cc
UNION ALL SELECT run_id, path, 'mi', maintainability FROM mi""")
def norm_radon(spark, d):
    cc, mi = radon(spark, d)
    return cc.select("run_id", "path", F.lit("cc").alias("kind"), F.col("complexity").alias("value")
                     ).unionByName(mi.select("run_id", "path", F.lit("mi").alias("kind"),
                                             F.col("maintainability").alias("value")))


def stats(spark, d):
    loc = v.table(spark, d, "events").select(
        F.col("user_id").alias("run_id"),
        F.concat(F.lit("src/f"), F.col("event_id").cast("string"), F.lit(".py")).alias("path"),
        (v.event_key() * 7).alias("loc"))
    return r.file_stats(*radon(spark, d), loc)


@register("file_stats_build", V_RADON + """
SELECT run_id, path, 'python' AS language, coalesce(complexity, CAST(0 AS DOUBLE)) AS complexity, maintainability, k * 7 AS loc
FROM cc FULL JOIN mi USING (run_id, path) JOIN (SELECT run_id, 'src/f' || event_id || '.py' AS path, k FROM base)
  USING (run_id, path)""")
def file_stats_build(spark, d):
    return stats(spark, d).select("run_id", "path", "language", "complexity", "maintainability",
                                  "loc")


@register("radon_high_complexity", V_RADON + """
SELECT run_id, path AS file, 'HIGH_COMPLEXITY' AS type, 0 AS line, 'max complexity ' || CAST(complexity AS BIGINT) AS description,
  CAST(complexity AS INTEGER) AS complexity FROM cc WHERE complexity >= 15""")
def radon_high_complexity(spark, d):
    return r.radon_findings(stats(spark, d)).select("run_id", "file", "type", "line", "description",
                                                    "evidence.complexity")


@register("tool_status", "WITH " + LINES + """, t AS (
  SELECT event_id, run_id, event_type AS tool, k % 4 <> 0 AS available, k % 5 = 0 AS timed_out, k % 7 AS exit_code,
    CASE WHEN k % 2 = 0 THEN 'message ' || k END AS error FROM base)
SELECT run_id, tool, available,
  CASE WHEN NOT available THEN 'unavailable' WHEN timed_out THEN 'timed out'
       WHEN exit_code > 2 AND error IS NOT NULL THEN 'failed' ELSE 'ok' END AS state,
  CASE WHEN available AND timed_out THEN true END AS timed_out,
  CASE WHEN available AND NOT timed_out THEN exit_code END AS exit_code,
  CASE WHEN NOT available OR timed_out OR exit_code > 2 THEN error END AS error FROM t""")
def tool_status(spark, d):
    k = v.event_key()
    return r.tool_status(v.table(spark, d, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("tool"),
        (k % 4 != 0).alias("available"), (k % 5 == 0).alias("timed_out"),
        (k % 7).cast("int").alias("exit_code"),
        F.when(k % 2 == 0, F.concat(F.lit("message "), k.cast("string"))).alias("error")))


TOOLS = ("bandit", "ruff", "eslint", "ts-morph", "radon-cc", "radon-mi", "mypy")
TAKEN = "WITH " + LINES + """, r AS (
  SELECT event_id, run_id, ['bandit', 'ruff', 'eslint', 'ts-morph', 'radon-cc', 'radon-mi', 'mypy'][event_id % 7 + 1] AS tool,
    k, CASE WHEN k % 4 = 2 THEN NULL WHEN k % 4 = 1 THEN 'Tool output was not valid JSON'
            WHEN event_id % 7 = 6 THEN 'Tool output has no parser'
            WHEN (k % 4 = 0) = (event_id % 7 IN (1, 2)) THEN 'Tool output has another shape than expected' END AS reason
  FROM base)
"""


def mixed_reports(spark, d):
    """A report per event and tool: an object, a cut object, blanks, or an array."""
    k = v.event_key()
    body = v.pick(k % 4, ("{}", "}", " \n", "[]"))
    e = v.table(spark, d, "events")
    return e.select(
        "event_id", F.col("user_id").alias("run_id"), F.col("user_id").cast("string").alias("repo_id"),
        v.pick(F.col("event_id") % 7, TOOLS).alias("tool"),
        F.when(k % 4 == 0, F.col("props")).when(k % 4 == 1, F.concat("props", body)).otherwise(body).alias("stdout"),
        F.lit(ROOT).alias("root"), (k % 5 == 0).alias("timed_out"), (k % 6).cast("int").alias("exit_code"))


@register("analyse_report_errors", TAKEN + """
SELECT event_id, run_id, CAST(run_id AS VARCHAR) AS repo_id, tool, reason FROM r WHERE reason IS NOT NULL""")
def analyse_report_errors(spark, d):
    return take_reports(mixed_reports(spark, d)).errors.select("event_id", "run_id", "repo_id", "tool", "reason")


@register("analyse_tool_status", TAKEN + """
SELECT run_id, tool, true AS available,
  CASE WHEN k % 5 = 0 THEN 'timed out' WHEN k % 6 > 2 AND reason IS NOT NULL THEN 'failed' ELSE 'ok' END AS state,
  CASE WHEN k % 5 = 0 THEN true END AS timed_out, CASE WHEN k % 5 <> 0 THEN k % 6 END AS exit_code,
  CASE WHEN k % 5 = 0 OR k % 6 > 2 THEN reason END AS error FROM r""")
def analyse_tool_status(spark, d):
    return take_reports(mixed_reports(spark, d)).status
