"""Source files derived from documents, and the findings worked out by hand for them.

Every document becomes one source file: a short program chosen by its id, followed by the whole
text of the document as comment lines. Parsing and scanning therefore grow with the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.plans import views as v

FIRST_SCRIPT = 16  # templates from here on are TypeScript
TEMPLATES = (
    "def width(box):\n    return box.right - box.left",
    "import os, sys\nimport json\nprint(json)",
    "import os\nimport hashlib\nos.system(x)\neval(y)\nhashlib.md5(z)",
    "import subprocess\nsubprocess.run(c, shell=True)",
    'def q(c, u):\n    c.execute("SELECT * FROM t WHERE id=" + u)\n'
    '    c.execute(f"DELETE FROM t WHERE id={u}")',
    "def f(x):\n    if x == None:\n        return 1\n    if x == x:\n        return 2\n"
    "    if 1 == 1:\n        return 3\n    return 0",
    "def g(x):\n    if True:\n        return 1\n    else:\n        return x",
    "def h():\n    return 1\n    print(2)",
    "try:\n    f()\nexcept:\n    pass\ntry:\n    f()\nexcept ValueError:\n    print(1)",
    "def l(u):\n    assert u\n    return u",
    'password = "secret-abc"\ndb_password = "secret-abc"\ntoken = "hunter2"',
    "def c():\n    a = b = 1\n    _t = 2\n    for i in range(3):\n        pass\n"
    "    for k, v in {}.items():\n        pass\n    return 0",
    'try:\n    f()\nexcept E:\n    raise X("SELECT " + y)',
    "def (:",
    "def gather(rows):\n    out = []\n    for r in rows:\n        if r.ready():\n"
    "            out.append(r.size)\n    return out",
    "def pick_up(things):\n    kept = []\n    for one in things:\n        if one.ready():\n"
    "            kept.append(one.size)\n    return kept",
    'const apiToken = "abcd1234abcd1234";',
    "el.innerHTML = x;",
    'eval(code);\nnew Function("a");\nFunction("b");',
    "if (a === null) { f(); }\nif (a.b == a.b) { g(); }",
    'const q = "select * from t where id=" + id;',
    "import { a } from './lib';\na();",
    "function unused_{doc_id}() { return 1; }",
    "export function ok(a) { if (a && a > 1) { return 1; } return a ? 2 : 3; }\nok(1);",
    "if (f(x) === f(x)) { g(); }\nif (h[0].y == h[0].y) { g(); }\nif (f(x) == f(y)) { g(); }",
    'const size = 1, dead_{doc_id} = <T>(x: T) => x, secretKey = "abcd1234abcd1234";\nuse(size);',
)
LIBRARY = "export const a = () => 1;"
# (template, type, line, confidence) after first-wins dedupe
EXPECTED = (
    (1, "UNUSED_IMPORT", 1, 0.6),
    (2, "UNSAFE_SUBPROCESS", 3, 0.8), (2, "DANGEROUS_EVAL", 4, 0.75), (2, "WEAK_HASH", 5, 0.5),
    (3, "UNSAFE_SUBPROCESS", 2, 0.8),
    (4, "SQL_INJECTION", 2, 0.85), (4, "SQL_INJECTION", 3, 0.8),
    (5, "NONE_COMPARISON", 2, 0.7), (5, "SELF_COMPARISON", 4, 0.95),
    (5, "CONSTANT_CONDITION", 6, 0.9), (5, "SELF_COMPARISON", 6, 0.95),
    (6, "CONSTANT_CONDITION", 2, 0.9), (6, "REDUNDANT_ELSE", 2, 0.7),
    (7, "UNREACHABLE_CODE", 3, 0.95),
    (8, "BROAD_EXCEPT", 3, 0.5), (8, "EMPTY_EXCEPT", 3, 0.7), (8, "EMPTY_EXCEPT", 7, 0.7),
    (9, "ASSERT_VALIDATION", 2, 0.55),
    (10, "HARDCODED_SECRET", 1, 0.65),
    (11, "UNUSED_VARIABLE", 2, 0.55), (11, "UNUSED_VARIABLE", 6, 0.55),
    (16, "HARDCODED_SECRET", 1, 0.85),
    (17, "UNSAFE_INNER_HTML", 1, 0.8),
    (18, "DANGEROUS_EVAL", 1, 0.9), (18, "DANGEROUS_FUNCTION", 3, 0.8),
    (19, "NONE_COMPARISON", 1, 0.5), (19, "SELF_COMPARISON", 2, 0.9),
    (20, "SQL_INJECTION", 1, 0.85),
    (22, "UNUSED_FUNCTION", 1, 0.5),
    (24, "SELF_COMPARISON", 1, 0.9), (24, "SELF_COMPARISON", 2, 0.9),
    (25, "HARDCODED_SECRET", 1, 0.85), (25, "UNUSED_FUNCTION", 1, 0.5),
)
# template -> (function, shape tokens, duplicate class), for shapes of at least eight tokens
SHAPES = {4: ("q", 10, 4), 5: ("f", 13, 5), 11: ("c", 12, 11), 14: ("gather", 11, 14),
          15: ("pick_up", 11, 14)}


def source_files(spark, d) -> DataFrame:
    """One source file per document, and one library file per repository."""
    docs = v.wide_table(spark, d, "documents", "doc_id", "source", "text")
    no, i = v.doc_no(len(TEMPLATES)), F.col("doc_id").cast("string")
    script = no >= FIRST_SCRIPT
    program = F.replace(v.pick(no, TEMPLATES), F.lit("{doc_id}"), i)
    mark = F.when(script, F.lit("// ")).otherwise(F.lit("# "))
    notes = F.concat(mark, F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), mark)))
    files = docs.select(
        F.col("source").alias("repo_id"), F.col("doc_id").alias("file_id"),
        F.when(script, F.concat(F.lit("web/d"), i, F.lit(".ts")))
        .otherwise(F.concat(F.lit("src/d"), i, F.lit(".py"))).alias("path"),
        F.concat(program, F.lit("\n"), notes).alias("content"))
    libraries = v.table(spark, d, "documents").groupBy(F.col("source").alias("repo_id")).agg(
        (-1 - F.min("doc_id")).alias("file_id")).select(
        "repo_id", "file_id", F.lit("web/lib.ts").alias("path"), F.lit(LIBRARY).alias("content"))
    return files.unionByName(libraries)


# --- the same as SQL for the check engine ----------------------------------
def text_literal(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


T_FILES = f"""t_docs AS (
  SELECT doc_id, source, text, (doc_id // 20) % {len(TEMPLATES)} AS no FROM documents),
t_templates(no, program) AS (VALUES {", ".join(f"({n}, {text_literal(p)})" for n, p in enumerate(TEMPLATES))}),
t_files AS (
  SELECT source AS repo_id, doc_id AS file_id, no,
    CASE WHEN no >= {FIRST_SCRIPT} THEN 'web/d' || doc_id || '.ts' ELSE 'src/d' || doc_id || '.py' END AS path,
    replace(program, '{{doc_id}}', CAST(doc_id AS VARCHAR)) || chr(10)
      || CASE WHEN no >= {FIRST_SCRIPT} THEN '// ' || replace(text, chr(10), chr(10) || '// ')
              ELSE '# ' || replace(text, chr(10), chr(10) || '# ') END AS content
  FROM t_docs JOIN t_templates USING (no))"""
EXPECTED_SQL = "expected(no, type, line, confidence) AS (VALUES " + ", ".join(
    f"({n}, '{ty}', {line}, CAST({conf} AS DOUBLE))" for n, ty, line, conf in EXPECTED) + ")"
SHAPES_SQL = "shapes(no, name, tokens, class) AS (VALUES " + ", ".join(
    f"({n}, '{name}', {tokens}, {c})" for n, (name, tokens, c) in SHAPES.items()) + ")"
# Repositories where no other file has the name that the library file defines.
LONE_SQL = """lone AS (SELECT DISTINCT repo_id FROM t_files WHERE repo_id NOT IN (
  SELECT repo_id FROM t_files WHERE no IN (19, 21, 23)))"""
