"""Rules given as text: what they find, and what is refused."""

import pytest

from codequarry.operators import findings, sql_rules
from codequarry.sources import jstokens, pynodes
from pyspark.sql import functions as F

FILES = "repo_id string, file_id bigint, path string, content string"
COLUMNS = "repo_id, file_id, path, line, col, 'X' AS type, 'STYLE' AS category, 0.5 AS confidence, text AS message"


def test_rules_as_text(spark):
    nodes = pynodes.py_nodes(spark.createDataFrame([("r", 1, "a.py", "x = 1\nprint(x)\nprint(2)\n")], FILES))
    tokens = jstokens.js_tokens(spark.createDataFrame([("r", 2, "b.ts", "var a = 1;\nlet b;\n"), ("r", 3, "c.ts", "")], FILES))
    rules = {"calls": f"SELECT {COLUMNS.replace('text AS', 'dotted AS')} FROM {{py_nodes}} WHERE kind = 'Call'",
             "no_var": f"SELECT {COLUMNS}, 'more' AS text2 FROM {{js_tokens}} WHERE text IN ('var')"}
    found = sql_rules.sql_findings(rules, nodes, tokens)
    rows = sorted((r["evidence"]["rule"], r["file"], r["line"], r["message"]) for r in found.collect())
    assert rows == [("calls", "a.py", 2, "print"), ("calls", "a.py", 3, "print"), ("no_var", "b.ts", 1, "var")]
    assert findings.dedupe(found.withColumn("run_id", F.col("repo_id"))).count() == 3
    with pytest.raises(ValueError, match="no_line does not return line"):
        sql_rules.sql_findings({"no_line": f"SELECT {COLUMNS.replace('line, ', '')} FROM {{js_tokens}}"}, nodes, tokens)
    with pytest.raises(ValueError):
        sql_rules.sql_findings({}, nodes, tokens)
