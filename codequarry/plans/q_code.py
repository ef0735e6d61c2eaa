"""Registered queries on syntax nodes, tokens, rules and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import text as t
from codequarry.operators import duplicates, findings, js_rules, py_rules, sql_rules
from codequarry.plans import templates as tp
from codequarry.plans import views as v
from codequarry.plans.analysis import analyse
from codequarry.plans.registry import register
from codequarry.plans.view_sql import with_views
from codequarry.session import written
from codequarry.sources import corpus, jstokens, pynodes

SHOWN = ("repo_id", "file", "type", "line", "confidence")
PY, JS = f"no < {tp.FIRST_SCRIPT}", f"no >= {tp.FIRST_SCRIPT}"


def nodes(spark, d, *kinds: str):
    return pynodes.py_nodes(corpus.python_files(tp.source_files(spark, d)), kinds or None)


def tokens(spark, d):
    return jstokens.js_tokens(corpus.script_files(tp.source_files(spark, d)))


def deduped(found):
    return findings.dedupe(found.withColumn("run_id", F.col("repo_id"))).select(*SHOWN)


def expected(where: str) -> str:
    return with_views(tp.T_FILES, tp.EXPECTED_SQL) + (
        "SELECT repo_id, path AS file, type, line, confidence FROM t_files JOIN expected USING (no) "
        f"WHERE {where}")


def types(*names: str) -> str:
    return "type IN (" + ", ".join(f"'{n}'" for n in names) + ")"


# --- Python -----------------------------------------------------------------
@register("py_node_counts", with_views(tp.T_FILES) + """, kinds(no, kind, n) AS (VALUES
  (0, 'FunctionDef', 1), (0, 'BinOp', 1), (0, 'Name', 2), (1, 'Import', 2), (1, 'alias', 3), (1, 'Call', 1), (1, 'Name', 2),
  (2, 'Import', 2), (2, 'alias', 2), (2, 'Call', 3), (2, 'Name', 6), (3, 'Import', 1), (3, 'alias', 1), (3, 'Call', 1), (3, 'Name', 2),
  (4, 'FunctionDef', 1), (4, 'Call', 2), (4, 'BinOp', 1), (4, 'Name', 4), (5, 'FunctionDef', 1), (5, 'Name', 3),
  (6, 'FunctionDef', 1), (6, 'Name', 1), (7, 'FunctionDef', 1), (7, 'Call', 1), (7, 'Name', 1), (8, 'Call', 3), (8, 'Name', 4),
  (9, 'FunctionDef', 1), (9, 'Name', 2), (10, 'Name', 3), (11, 'FunctionDef', 1), (11, 'Call', 2), (11, 'Name', 7),
  (12, 'Call', 2), (12, 'BinOp', 1), (12, 'Name', 4), (13, 'Error', 1),
  (14, 'FunctionDef', 1), (14, 'Call', 2), (14, 'Name', 7), (15, 'FunctionDef', 1), (15, 'Call', 2), (15, 'Name', 7))
SELECT repo_id, kind, CAST(sum(n) AS BIGINT) AS nodes FROM t_files JOIN kinds USING (no) GROUP BY repo_id, kind""")
def py_node_counts(spark, d):
    shown = ("FunctionDef", "BinOp", "Name", "Import", "alias", "Call", "Error")
    return nodes(spark, d, *shown).groupBy("repo_id", "kind").agg(
        F.count(F.lit(1)).alias("nodes"))


@register("py_parse_errors", with_views(tp.T_FILES) +
          "SELECT repo_id, file_id, path, 'SyntaxError' AS error FROM t_files WHERE no = 13")
def py_parse_errors(spark, d):
    return pynodes.parse_errors(nodes(spark, d, "Error"))


def _local(name: str, where: str, *rules: str):
    register(name, expected(f"{PY} AND {where}"))(
        lambda spark, d: deduped(py_rules.local_findings(
            nodes(spark, d, *py_rules.kinds_of(*rules)), *rules)))


_local("rule_call_sinks", types("DANGEROUS_EVAL", "DANGEROUS_DESERIALIZATION", "WEAK_HASH") +
       " OR (no = 2 AND type = 'UNSAFE_SUBPROCESS')", "call_sink")
_local("rule_shell_true", "no = 3", "shell_true")
_local("rule_sql_build", types("SQL_INJECTION"), "sql_call", "sql_concat", "sql_fstring")
_local("rule_compare", "no = 5", "none_comparison", "constant_comparison", "self_comparison")
_local("rule_constant_condition", "no = 6 AND type = 'CONSTANT_CONDITION'", "constant_if",
       "while_false")
_local("rule_redundant_else", types("REDUNDANT_ELSE"), "redundant_else")
_local("rule_assert", types("ASSERT_VALIDATION"), "assertion")
_local("rule_except", types("BROAD_EXCEPT", "EMPTY_EXCEPT"), "broad_except", "empty_except")
_local("rule_secret_py", types("HARDCODED_SECRET"), "secret")


@register("rule_unused_import", expected(types("UNUSED_IMPORT")))
def rule_unused_import(spark, d):
    return deduped(py_rules.unused_imports(nodes(spark, d, "Name", "Import", "ImportFrom")))


@register("rule_unused_variable", expected(types("UNUSED_VARIABLE")))
def rule_unused_variable(spark, d):
    return deduped(py_rules.unused_variables(
        nodes(spark, d, "Name", "ExceptHandler", "FunctionDef", "AsyncFunctionDef")))


@register("rule_unreachable", expected(types("UNREACHABLE_CODE")))
def rule_unreachable(spark, d):
    return deduped(py_rules.unreachable(nodes(spark, d)))


@register("py_findings", expected(PY))
def py_findings(spark, d):
    return deduped(py_rules.py_findings(written(nodes(spark, d, *py_rules.NEEDED_KINDS), "nodes")))


@register("snippets", with_views(tp.T_FILES, tp.EXPECTED_SQL) + """, cut AS (
  SELECT repo_id, path, type, line, greatest(1, line - 2) AS first,
         list_slice(string_split(content, chr(10)), greatest(1, line - 2), line + 2) AS near
  FROM t_files JOIN expected USING (no) WHERE no < 16)
SELECT repo_id, path AS file, type, line, array_to_string(
         list_transform(near, lambda x, i: lpad(CAST(first + i - 1 AS VARCHAR), 5, ' ') || ' | ' || x), chr(10)) AS snippet
FROM cut""")
def snippets(spark, d):
    files = corpus.python_files(tp.source_files(spark, d))
    found = py_rules.py_findings(
        written(pynodes.py_nodes(files, py_rules.NEEDED_KINDS), "nodes"))
    kept = written(findings.dedupe(found.withColumn("run_id", F.col("repo_id"))), "findings")
    return py_rules.with_snippets(kept, files, kept).select(
        "repo_id", "file", "type", "line", F.col("evidence.snippet").alias("snippet"))


@register("py_complexity", with_views(tp.T_FILES) + """,
cc(no, name, complexity) AS (VALUES (0, 'width', 1), (4, 'q', 1), (5, 'f', 4), (6, 'g', 2), (7, 'h', 1), (9, 'l', 1),
  (11, 'c', 3), (14, 'gather', 3), (15, 'pick_up', 3))
SELECT repo_id, path, name, 1 AS line, complexity FROM t_files JOIN cc USING (no)""")
def py_complexity(spark, d):
    return py_rules.complexity(nodes(spark, d)).select("repo_id", "path", "name", "line",
                                                       "complexity")


# --- duplicates -------------------------------------------------------------
FUNCTIONS = with_views(tp.T_FILES, tp.SHAPES_SQL) + """,
fns AS (SELECT repo_id, path, name, tokens, class, count(*) OVER g AS members,
          row_number() OVER (PARTITION BY repo_id, class ORDER BY path) AS position
        FROM t_files JOIN shapes USING (no) WINDOW g AS (PARTITION BY repo_id, class)),
others AS (SELECT repo_id, class, string_agg(parse_filename(path) || ':1 (' || name || ')', ', ' ORDER BY path) AS others
           FROM fns WHERE position BETWEEN 2 AND 5 GROUP BY repo_id, class)
"""
DUP_SELECT = """SELECT repo_id, path AS file, 1 AS line, members,
  'Function ''' || name || ''' has the same body shape as ' || (members - 1) || ' other location(s): ' || others
  || '. Likely copy-pasted code; consider extracting a shared helper.' AS message
FROM fns JOIN others USING (repo_id, class) WHERE members >= 2"""


@register("dup_signatures", FUNCTIONS + "SELECT repo_id, path, name, tokens FROM fns")
def dup_signatures(spark, d):
    return duplicates.functions(nodes(spark, d, "FunctionDef", "AsyncFunctionDef")).select("repo_id", "path", "name", "tokens")


def functions(spark, d):
    return written(duplicates.functions(nodes(spark, d, "FunctionDef", "AsyncFunctionDef")), "functions")


@register("dup_functions", FUNCTIONS + DUP_SELECT)
def dup_functions(spark, d):
    return duplicates.duplicate_functions(functions(spark, d)).select(
        "repo_id", "file", "line", "members", "message")


@register("dup_functions_capped", FUNCTIONS + f""", firsts AS (
  SELECT repo_id, class, min(path) AS path, row_number() OVER (PARTITION BY repo_id ORDER BY min(path)) AS group_no
  FROM fns WHERE members >= 2 GROUP BY repo_id, class)
SELECT * FROM ({DUP_SELECT}
  AND position <= 4 AND (repo_id, class) IN (SELECT (repo_id, class) FROM firsts WHERE group_no <= 3))""")
def dup_functions_capped(spark, d):
    return duplicates.duplicate_functions_capped(functions(spark, d), max_groups=3).select(
        "repo_id", "file", "line", "members", "message")


@register("dup_documents", r"""
WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g')) AS norm FROM documents)
SELECT doc_id, copies, first FROM n JOIN (
  SELECT norm, count(*) AS copies, min(doc_id) AS first FROM n GROUP BY norm HAVING count(*) > 1) USING (norm)""")
def dup_documents(spark, d):
    return duplicates.duplicate_texts(v.wide_table(spark, d, "documents", "doc_id", "text"),
                                      "doc_id", "text")


# --- JavaScript and TypeScript ----------------------------------------------
@register("js_token_counts", with_views(tp.T_FILES) + """, kinds(no, kind, n) AS (VALUES
  (16, 'KEYWORD', 1), (16, 'IDENT', 1), (16, 'OP', 2), (16, 'STRING', 1), (17, 'IDENT', 3), (17, 'OP', 3),
  (18, 'IDENT', 4), (18, 'KEYWORD', 1), (18, 'STRING', 2), (18, 'OP', 9),
  (19, 'KEYWORD', 3), (19, 'IDENT', 7), (19, 'OP', 18), (20, 'KEYWORD', 1), (20, 'IDENT', 2), (20, 'STRING', 1), (20, 'OP', 3),
  (21, 'KEYWORD', 1), (21, 'IDENT', 3), (21, 'STRING', 1), (21, 'OP', 6),
  (22, 'KEYWORD', 2), (22, 'IDENT', 1), (22, 'NUMBER', 1), (22, 'OP', 5),
  (23, 'KEYWORD', 5), (23, 'IDENT', 6), (23, 'NUMBER', 5), (23, 'OP', 17),
  (24, 'KEYWORD', 3), (24, 'IDENT', 15), (24, 'NUMBER', 2), (24, 'OP', 38),
  (25, 'KEYWORD', 1), (25, 'IDENT', 9), (25, 'NUMBER', 1), (25, 'STRING', 1), (25, 'OP', 15))
SELECT repo_id, path, kind, CAST(n AS BIGINT) AS tokens FROM t_files JOIN kinds USING (no)
UNION ALL SELECT DISTINCT source, 'web/lib.ts', k, n FROM documents,
  (SELECT unnest(['KEYWORD', 'IDENT', 'NUMBER', 'OP']) AS k, unnest([2, 1, 1, 5]) AS n)""")
def js_token_counts(spark, d):
    return js_rules.token_rows(tokens(spark, d)).groupBy("repo_id", "path", "kind").agg(
        F.count(F.lit(1)).alias("tokens"))


def _local_js(name: str, where: str, *rules: str):
    register(name, expected(f"{JS} AND {where}"))(
        lambda spark, d: deduped(js_rules.local_findings(tokens(spark, d), *rules)))


_local_js("js_rule_sql", types("SQL_INJECTION"), "sql_concat")
_local_js("js_rule_innerhtml", types("UNSAFE_INNER_HTML"), "inner_html")
_local_js("js_rule_compare", types("NONE_COMPARISON", "SELF_COMPARISON"), "none_comparison",
          "self_comparison")
_local_js("js_rule_calls", types("DANGEROUS_EVAL", "DANGEROUS_FUNCTION"), "eval_call",
          "function_call")
_local_js("js_rule_secret", types("HARDCODED_SECRET"), "secret")


@register("js_findings", expected(JS).replace(tp.EXPECTED_SQL, tp.EXPECTED_SQL + ",\n" + tp.LONE_SQL) + """
UNION ALL SELECT repo_id, 'web/lib.ts', 'UNUSED_FUNCTION', 1, CAST(0.5 AS DOUBLE) FROM lone""")
def js_findings(spark, d):
    return deduped(js_rules.js_findings(written(tokens(spark, d), "tokens")))


@register("js_complexity", with_views(tp.T_FILES) + """
SELECT repo_id, path, CASE no WHEN 23 THEN 'ok' ELSE 'unused_' || file_id END AS name, 1 AS line,
       CASE no WHEN 23 THEN 4 ELSE 1 END AS complexity FROM t_files WHERE no IN (22, 23)""")
def js_complexity(spark, d):
    return js_rules.complexity(tokens(spark, d)).select("repo_id", "path", "name", "line",
                                                        "complexity")


@register("js_high_complexity", with_views(tp.T_FILES) + """
SELECT repo_id, path AS file, 'Function ''ok'' has approximate cyclomatic complexity 4 (threshold 15).' AS message,
       'estimated cc=4' AS description FROM t_files WHERE no = 23""")
def js_high_complexity(spark, d):
    return js_rules.high_complexity(tokens(spark, d), limit=3).select("repo_id", "file", "message",
                                                                      "description")


@register("js_unused", with_views(tp.T_FILES, tp.LONE_SQL) + """
SELECT repo_id, 'web/lib.ts' AS file, 1 AS line, 'Function ''a'' is never referenced anywhere in the repository. May be '
  || 'dead code or an entry point (check framework registration).' AS message FROM lone
UNION ALL SELECT repo_id, file, line, message FROM (
  SELECT repo_id, path AS file, 1 AS line, 'Function ''unused_' || file_id || ''' is never referenced. May be dead code '
    || 'or an entry point (check framework registration).' AS message
    FROM t_files WHERE no = 22
  UNION ALL SELECT repo_id, path, 1, 'Function ''dead_' || file_id || ''' is never referenced anywhere in the repository. May be '
    || 'dead code or an entry point (check framework registration).' FROM t_files WHERE no = 25)""")
def js_unused(spark, d):
    return js_rules.unused(written(tokens(spark, d), "tokens")).select("repo_id", "file", "line",
                                                                       "message")


@register("import_edges", with_views(tp.T_FILES) + """
SELECT repo_id, path AS src, 'web/lib.ts' AS dst, 'import' AS kind FROM t_files WHERE no = 21
UNION ALL SELECT repo_id, 'web/lib.ts', min(path), 'use' FROM t_files WHERE no = 21 GROUP BY repo_id""")
def import_edges(spark, d):
    files = corpus.script_files(tp.source_files(spark, d))
    return js_rules.import_edges(written(jstokens.js_tokens(files), "tokens"),
                                 files.select("repo_id", "path"))


@register("secret_scan_documents", r"""
WITH pairs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '(\w*)\s*=\s*"([^"]*)"', 1)) AS name,
         unnest(regexp_extract_all(text, '(\w*)\s*=\s*"([^"]*)"', 2)) AS value,
         unnest(range(len(regexp_extract_all(text, '(\w*)\s*=\s*"([^"]*)"')))) AS pos FROM documents)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, name, value FROM pairs
WHERE regexp_matches(name, '(?i)secret|key|token|password|passwd|api')
  AND (regexp_matches(value, '(?i)^(sk-|pk-|ghp_|AKIA|eyJ)')
       OR (len(value) >= 16 AND NOT regexp_matches(value, '(?i)example|placeholder|your|changeme')))""")
def secret_scan_documents(spark, d):
    return js_rules.secrets_in_text(v.wide_table(spark, d, "documents", "doc_id", "text"),
                                    "doc_id", "text")


# --- rules as SQL text ------------------------------------------------------
SQL_RULES = {
    "no_print": "SELECT repo_id, file_id, path, line, col, 'DEBUG_OUTPUT' AS type, 'STYLE' AS category, 0.4 AS confidence, "
                "concat('call of ', dotted) AS message FROM {py_nodes} WHERE kind = 'Call' AND dotted = 'print'",
    "no_new": "SELECT repo_id, file_id, path, line, col, 'CONSTRUCTED' AS type, 'STYLE' AS category, 0.3 AS confidence, "
              "'an object is made here' AS message FROM {js_tokens} WHERE kind = 'KEYWORD' AND text = 'new'",
}


@register("rule_sql_text", with_views(tp.T_FILES) + """, sql_expected(no, type, line, confidence, message) AS (VALUES
  (1, 'DEBUG_OUTPUT', 3, 0.4, 'call of print'), (7, 'DEBUG_OUTPUT', 3, 0.4, 'call of print'),
  (8, 'DEBUG_OUTPUT', 8, 0.4, 'call of print'), (18, 'CONSTRUCTED', 2, 0.3, 'an object is made here'))
SELECT repo_id, path AS file, type, line, CAST(confidence AS DOUBLE) AS confidence, message FROM t_files JOIN sql_expected USING (no)""")
def rule_sql_text(spark, d):
    found = sql_rules.sql_findings(SQL_RULES, nodes(spark, d, "Call"), tokens(spark, d))
    return found.select("repo_id", "file", "type", "line", "confidence", "message")


# --- the whole analysis -----------------------------------------------------
@register("analyse_corpus", FUNCTIONS.replace(tp.SHAPES_SQL, tp.SHAPES_SQL + ",\n" + tp.EXPECTED_SQL + ",\n" + tp.LONE_SQL) + """, found AS (
  SELECT repo_id, CASE WHEN no < 16 THEN 'ast-custom' ELSE 'ts-morph' END AS source, type, path AS file, line, confidence
  FROM t_files JOIN expected USING (no)
  UNION ALL SELECT repo_id, 'ts-morph', 'UNUSED_FUNCTION', 'web/lib.ts', 1, CAST(0.5 AS DOUBLE) FROM lone
  UNION ALL
  SELECT repo_id, 'dup', 'DUPLICATE_FUNCTION', path, 1, CAST(0.6 AS DOUBLE) FROM fns WHERE members >= 2),
raw AS (SELECT *, (CAST(0.5 AS DOUBLE)
   + CASE WHEN type IN ('SQL_INJECTION', 'DANGEROUS_EVAL', 'HARDCODED_SECRET') THEN CAST(0.25 AS DOUBLE)
          WHEN type IN ('DANGEROUS_FUNCTION', 'UNSAFE_INNER_HTML', 'UNSAFE_SUBPROCESS') THEN CAST(0.2 AS DOUBLE)
          WHEN type = 'SELF_COMPARISON' THEN CAST(0.3 AS DOUBLE)
          WHEN type IN ('ASSERT_VALIDATION', 'NONE_COMPARISON') THEN CAST(0.05 AS DOUBLE)
          WHEN type = 'UNUSED_VARIABLE' THEN CAST(-0.15 AS DOUBLE)
          WHEN type = 'UNUSED_FUNCTION' THEN CAST(-0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
   + CASE WHEN type IN ('SQL_INJECTION', 'DANGEROUS_EVAL', 'HARDCODED_SECRET', 'DANGEROUS_FUNCTION', 'UNSAFE_INNER_HTML',
                        'UNSAFE_SUBPROCESS', 'WEAK_HASH') THEN CAST(0.1 AS DOUBLE)
          WHEN type IN ('SELF_COMPARISON', 'ASSERT_VALIDATION', 'NONE_COMPARISON', 'CONSTANT_CONDITION') THEN CAST(0.05 AS DOUBLE)
          ELSE CAST(-0.05 AS DOUBLE) END) * confidence + (CAST(1 AS DOUBLE) - confidence) * CAST(0.5 AS DOUBLE) AS risk
  FROM found)
SELECT repo_id, source, type, file, line, confidence,
  (floor((risk * 1000::DOUBLE)) + CASE WHEN (risk * 1000::DOUBLE) - floor((risk * 1000::DOUBLE)) > 0.5::DOUBLE OR ((risk * 1000::DOUBLE) - floor((risk * 1000::DOUBLE)) = 0.5::DOUBLE AND ((((risk * 134217729::DOUBLE - (risk * 134217729::DOUBLE - risk)) * 1000::DOUBLE - (risk * 1000::DOUBLE)) + (risk - (risk * 134217729::DOUBLE - (risk * 134217729::DOUBLE - risk))) * 1000::DOUBLE) > 0 OR ((((risk * 134217729::DOUBLE - (risk * 134217729::DOUBLE - risk)) * 1000::DOUBLE - (risk * 1000::DOUBLE)) + (risk - (risk * 134217729::DOUBLE - (risk * 134217729::DOUBLE - risk))) * 1000::DOUBLE) = 0 AND CAST(floor((risk * 1000::DOUBLE)) AS BIGINT) % 2 = 1)))
    THEN 1::DOUBLE ELSE 0::DOUBLE END) / 1000::DOUBLE AS risk_score,
  CASE WHEN risk >= CAST(0.8 AS DOUBLE) THEN 'critical' WHEN risk >= CAST(0.65 AS DOUBLE) THEN 'high'
       WHEN risk >= CAST(0.45 AS DOUBLE) THEN 'medium' WHEN risk >= CAST(0.25 AS DOUBLE) THEN 'low' ELSE 'info' END AS severity
FROM raw""")
def analyse_corpus(spark, d):
    found = analyse(tp.source_files(spark, d)).findings
    return found.select("repo_id", "source", "type", "file", "line", "confidence", "risk_score",
                        "severity")


@register("analyse_file_stats", with_views(tp.T_FILES) + """,
cc(no, complexity) AS (VALUES (0, 1), (4, 1), (5, 4), (6, 2), (7, 1), (9, 1), (11, 3), (14, 3), (15, 3)),
unix AS (SELECT repo_id, path, no, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS content FROM t_files
         WHERE """ + PY + """)
SELECT repo_id AS run_id, repo_id, path, 'python' AS language, CAST(coalesce(complexity, 0) AS DOUBLE) AS complexity,
  CAST(coalesce(length(content) - length(replace(content, chr(10), ''))
    + CASE WHEN content = '' OR ends_with(content, chr(10)) THEN 0 ELSE 1 END, 0) AS INTEGER) AS loc
FROM unix LEFT JOIN cc USING (no)""")
def analyse_file_stats(spark, d):
    return analyse(tp.source_files(spark, d)).file_stats.select("run_id", "repo_id", "path", "language", "complexity", "loc")
