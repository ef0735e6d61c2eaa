"""Python rules: source text -> expected (type, line) after the first-wins dedupe."""

import pytest
from pyspark.sql import functions as F

from codequarry.operators import findings, py_rules
from codequarry.sources import pynodes

CASES = {
    "delete text built from a loop variable": (
        "def purge(db, tables):\n    for t in tables:\n        db.execute(f'DELETE FROM {t}')\n"
        "    db.commit()\n", {("SQL_INJECTION", 3)}),
    "assert below a condition": ("if ready:\n    assert size > 0\n", {("ASSERT_VALIDATION", 2)}),
    "unused variable": (
        "def span(xs, step):\n    middle = len(xs) // 2\n    for k in range(0, len(xs), step):\n"
        "        yield xs[k]\n", {("UNUSED_VARIABLE", 2)}),
    "used in an inner function": (
        "def outer(a):\n    b = a + 1\n    def inner():\n        return b\n    return inner\n", set()),
    "nothing to find": ("class Box:\n    side = 2\n\n    def area(self):\n        return self.side ** 2\n", set()),
    "unsafe yaml": ("import yaml\nyaml.load(f)\n", {("DANGEROUS_DESERIALIZATION", 2)}),
    "safe yaml hides its arguments": (
        "import yaml\nyaml.load(eval(\nx), Loader=FullLoader)\nyaml.load(eval(\nx), Loader=L)\n",
        {("DANGEROUS_DESERIALIZATION", 2), ("DANGEROUS_DESERIALIZATION", 4), ("DANGEROUS_EVAL", 4)}),
    "raise-only handler hides its type": (
        "try:\n    f()\nexcept eval(x):\n    raise E('DROP ' + t)\nexcept V:\n    log()\n    raise\n",
        set()),
    "bare raise-only handler is broad": ("try:\n    f()\nexcept:\n    raise\n", {("BROAD_EXCEPT", 3)}),
    "hidden function": (
        "try:\n    f()\nexcept E:\n    raise (lambda: [q for q in z])\ndef g():\n    try:\n        f()\n"
        "    except E:\n        raise X(w := 1)\n    a = 2\n",
        {("UNUSED_VARIABLE", 9), ("UNUSED_VARIABLE", 10)}),
    "left side of a chain never advances": (
        "1 < x == x\nx == y == x\n3 == y == 3\nx is not x\nx != None\nNone is x\n",
        {("SELF_COMPARISON", 2), ("SELF_COMPARISON", 3), ("CONSTANT_CONDITION", 3),
         ("SELF_COMPARISON", 4), ("NONE_COMPARISON", 5)}),
    "constant conditions": (
        "if 0:\n    a\nif '':\n    b\nwhile False:\n    c\nwhile 0:\n    d\nwhile True:\n    e\n",
        {("CONSTANT_CONDITION", 1), ("CONSTANT_CONDITION", 3), ("CONSTANT_CONDITION", 5)}),
    "redundant else": (
        "def f(x):\n    if x:\n        return 1\n    elif x > 2:\n        y()\n        return 2\n"
        "    else:\n        return 3\n    for i in x:\n        if i:\n            continue\n"
        "        else:\n            g()\n        if i:\n            g()\n        else:\n            return\n",
        {("REDUNDANT_ELSE", 2), ("REDUNDANT_ELSE", 4), ("REDUNDANT_ELSE", 10)}),
    "handlers": (
        "try:\n    f()\nexcept A:\n    pass\nexcept B:\n    print(1)\nexcept C:\n    log(1)\n"
        "except D:\n    x.print(1)\nexcept:\n    pass; pass\n",
        {("EMPTY_EXCEPT", 3), ("EMPTY_EXCEPT", 5), ("BROAD_EXCEPT", 11)}),
    "secrets": (
        "api_key = 'key'\nAPI_KEY: str = f('token=1')\nuser.token = 'secret'\nsecret = x\n"
        "tokens = 'token'\nclient_secret = password = ['a', ('passwd',)]\nsecret: str\n"
        "secret = 'keyboard'\n",
        {("HARDCODED_SECRET", 1), ("HARDCODED_SECRET", 2), ("HARDCODED_SECRET", 6)}),
    "unreachable": (
        "def f():\n    while x:\n        break\n        a\n        b\n    else:\n        return\n    raise E\n"
        "    c\n    return\n    d\n",
        {("UNREACHABLE_CODE", n) for n in (4, 5, 9, 10, 11)}),
    "imports": (
        "from __future__ import annotations\nimport a.b, c as d\nfrom e import *\nfrom . import f\n"
        "from g import h as i, j\nimport k\nk()\na = 1\nd += 1\n__all__ = ['f']\nj.x = 1\n",
        {("UNUSED_IMPORT", n) for n in (1, 2, 4, 5)}),
    "locals": (
        "def f():\n    with o() as a, o() as b:\n        pass\n    for c in z:\n        pass\n"
        "    for d, e in z:\n        pass\n    try:\n        pass\n    except X as g:\n        log()\n"
        "    h = 1\n    def inner():\n        k = h\n    i: int = 3\n    i += 1\n    [m for m in z]\n"
        "    x.y = 1\n    _q = 1\n    return e\n",
        {("UNUSED_VARIABLE", n) for n in (2, 6, 14, 15)}),
    "async with is no control target": (
        "async def f():\n    async with o() as a:\n        await p\n    async for b in z:\n        q()\n",
        {("UNUSED_VARIABLE", 2)}),
    "first matching argument decides": (
        "run('x' + y, 'select ' % a, f'update {b}')\nrun(f'{a} drop', 'delete ' - b)\n"
        "run('selected' + a)\nx = 'union ' - b\n",
        {("SQL_INJECTION", 1), ("SQL_INJECTION", 2)}),
    "unicode word border": ("x = 'éselect ' + y\nz = 'ſelect ' + y\n", {("SQL_INJECTION", 2)}),
    "shell": (
        "import subprocess as s, subprocess\nsubprocess.run(c, shell=True)\n"
        "subprocess.call(c, shell=1)\nsubprocess.Popen(c)\ns.run(c, shell=True)\nx().os.system(1)\n",
        {("UNSAFE_SUBPROCESS", 2), ("UNSAFE_SUBPROCESS", 4)}),
    "syntax error": ("def (:", set()),
    "null byte": ("x = 1\0", set()),
    "empty": ("", set()),
    "deep": ("x = " + "(" * 300 + "1" + ")" * 300, set()),
    "long sum compared": ("if " + "+".join(["a"] * 2000) + " == a:\n    pass\n", set()),
    "surrogate": ("x = '\\ud800select ' + y\n", {("SQL_INJECTION", 1)}),
}


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [("r", i, f"f{i}.py", text) for i, (text, _) in enumerate(CASES.values())]
    files = spark.createDataFrame(rows, "repo_id STRING, file_id BIGINT, path STRING, content STRING")
    return pynodes.py_nodes(files.repartition(4)).persist()


@pytest.fixture(scope="module")
def found(nodes):
    kept = findings.dedupe(py_rules.py_findings(nodes).withColumn("run_id", F.col("repo_id")))
    return kept.collect()


@pytest.mark.parametrize("name", CASES)
def test_case(found, name):
    i = list(CASES).index(name)
    got = {(r.type, r.line) for r in found if r.file == f"f{i}.py"}
    assert got == CASES[name][1]


def by_name(found, name):
    i = list(CASES).index(name)
    return {(r.type, r.line): r for r in found if r.file == f"f{i}.py"}


def test_details(found):
    one = by_name(found, "constant conditions")
    assert one["CONSTANT_CONDITION", 1].description == "condition is always False"
    assert one["CONSTANT_CONDITION", 5].description == "while condition is always False"
    imports = by_name(found, "imports")
    assert imports["UNUSED_IMPORT", 2].description == "import a.b"
    assert imports["UNUSED_IMPORT", 4].description == "from None import f"
    assert imports["UNUSED_IMPORT", 5].description == "from g import h"
    sql = by_name(found, "first matching argument decides")
    assert sql["SQL_INJECTION", 1].confidence == 0.85
    assert sql["SQL_INJECTION", 2].confidence == 0.8
    local = by_name(found, "unused variable")["UNUSED_VARIABLE", 2]
    assert (local.description, local.evidence.function) == ("middle", "span")
    secret = by_name(found, "secrets")["HARDCODED_SECRET", 6]
    assert secret.description == "assigned to client_secret"


def test_parse_errors(nodes):
    errors = {r.path: r.error for r in pynodes.parse_errors(nodes).collect()}
    bad = [f"f{list(CASES).index(n)}.py" for n in ("syntax error", "null byte")]
    assert set(bad) <= set(errors)


def test_breadth_first_shape_equals_walk(nodes):
    import ast

    skipped = {"Name", "Constant", "Load", "Store", "Del", "arg", "arguments"}
    shapes = {(r.path, r.line, r.name): r.shape for r in nodes.where("shape IS NOT NULL").collect()}
    checked = 0
    for i, (text, _) in enumerate(CASES.values()):
        try:
            tree = ast.parse(text)
        except (SyntaxError, RecursionError, MemoryError):
            continue
        for fn in ast.walk(tree):
            if isinstance(fn, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kinds = [type(n).__name__ for n in ast.walk(fn) if n is not fn]
                want = " ".join("DEF" if k.endswith("FunctionDef") else k
                                for k in kinds if k not in skipped)
                assert shapes[f"f{i}.py", fn.lineno, fn.name] == want
                checked += 1
    assert checked >= 10


def test_complexity(spark):
    text = ("def f(x):\n    if a and b or c:\n        pass\n    elif y:\n        pass\n    for i in x:\n"
            "        while i:\n            z = 1 if i else 2\n    try:\n        pass\n    except E:\n"
            "        pass\n    match x:\n        case 1:\n            pass\n        case _:\n            pass\n"
            "    def g():\n        if x:\n            pass\n")
    files = spark.createDataFrame([("r", 1, "a.py", text)],
                                  "repo_id STRING, file_id BIGINT, path STRING, content STRING")
    got = {r.name: r.complexity for r in py_rules.complexity(pynodes.py_nodes(files)).collect()}
    # 2 ifs, 2 boolean operators, for, while, conditional, except, 2 cases, and the if inside g
    assert got == {"f": 12, "g": 2}


def test_extra_rule(nodes):
    def todo(n):
        return py_rules.local_findings(n, "assertion")

    assert py_rules.py_findings(nodes, [todo]).count() == py_rules.py_findings(nodes).count() + 1


def test_snippets(spark, nodes):
    files = spark.createDataFrame(
        [("r", 1, "a.py", "a\nb\rc\r\nassert d\n\x0ce")],
        "repo_id STRING, file_id BIGINT, path STRING, content STRING")
    found = py_rules.local_findings(pynodes.py_nodes(files))
    got = py_rules.with_snippets(found, files).first().evidence.snippet
    assert got == "    2 | b\n    3 | c\n    4 | assert d\n    5 | \n    6 | e"
