"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

EVIDENCE = T.StructType([
    T.StructField("rule", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("function", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("complexity", T.IntegerType()),
])
# Emission order inside one source: phase, then up to three positions.
ORDER = T.StructType([
    T.StructField("src", T.IntegerType()),
    T.StructField("file", T.StringType()),
    T.StructField("phase", T.IntegerType()),
    T.StructField("a", T.IntegerType()),
    T.StructField("b", T.IntegerType()),
    T.StructField("c", T.IntegerType()),
])
FINDING_COLUMNS = (
    "run_id", "repo_id", "source", "type", "category", "file", "line", "col", "message",
    "description", "confidence", "evidence", "ord",
)
FILE_KEYS = ("repo_id", "file_id", "path")
_FILE = "repo_id STRING, file_id BIGINT, path STRING"

# One row per syntax node. `kids` describes the direct children of nodes that rules look at, so
# that a rule about a node and its children needs no join. In a kid, `text` is the node's text (see
# below), `name` a keyword's or name's identifier, `value` the kind below a keyword, `same` a hash
# of the whole operand of a comparison.
KID = (
    "STRUCT<field: STRING, idx: INT, kind: STRING, name: STRING, const: STRING, truth: BOOLEAN, "
    "text: STRING, value: STRING, same: STRING, line: INT, col: INT>"
)
# `text`: value of a string constant, constant parts of an f-string joined by newlines, left string
# constant of a binary operation, module of an import. `shape`: node kinds of a function body.
PY_NODES = (
    f"{_FILE}, pre INT, last INT, parent INT, depth INT, kind STRING, field STRING, idx INT, "
    "line INT, col INT, end_line INT, end_col INT, name STRING, dotted STRING, ctx STRING, "
    "const STRING, text STRING, hidden BOOLEAN, target BOOLEAN, operands INT, "
    f"fn_chain ARRAY<INT>, fn_visible INT, kids ARRAY<{KID}>, strings ARRAY<STRING>, "
    "shape STRING, error STRING"
)
# One row per file with its tokens in order; neighbours are read by shifting the array.
# `chain` is the dotted run a token belongs to (of tokens beside a comparison: the text of the whole
# operand, with calls and indexes), `before` and `after` the tokens around that run or operand,
# `shown` the beginning of the source text of a declaration, call or binary expression,
# `fn` the position of the top-level function or method around the token, `owner` the variable of
# an initialiser or the module of an imported name.
TOKEN = (
    "STRUCT<pos: INT, line: INT, col: INT, kind: STRING, text: STRING, brace: INT, paren: INT, "
    "chain: STRING, before: STRING, after: STRING, fn: INT, role: STRING, owner: STRING, "
    "shown: STRING>"
)
JS_FILES = f"{_FILE}, tokens ARRAY<{TOKEN}>"
ARCHIVE_ENTRIES = (
    "archive STRING, entry_no BIGINT, entry STRING, is_dir BOOLEAN, file_size BIGINT, "
    "compress_size BIGINT, external_attr BIGINT, content BINARY, error STRING"
)
