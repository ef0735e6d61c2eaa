"""JavaScript and TypeScript rules: source text -> expected (type, line)."""

import pytest
from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv
from codequarry.operators import findings, js_rules
from codequarry.sources import jstokens

CASES = {
    "sql": ('const a = "select x" + y;\nb = z + "from t" + y;\nc = "selected" + y;\nd = ("WHERE " + e);\n'
            "f = `select ${x}` + y; g = 'drop' - h;\n", {("SQL_INJECTION", 1), ("SQL_INJECTION", 4)}),
    "inner html": ("a.b.innerHTML = x;\na.innerHTML += `${y}`;\nif (a.innerHTML === x) f();\n"
                   "innerHTML = x;\na.outerHTML = x;\n",
                   {("UNSAFE_INNER_HTML", 1), ("UNSAFE_INNER_HTML", 2)}),
    "null comparison": ("if (a == null) {}\nif (undefined !== b.c) {}\nif (a === undefined.x) {}\n"
                        "if (a > null) {}\nx = a != null ? 1 : 2;\n",
                        {("NONE_COMPARISON", 1), ("NONE_COMPARISON", 2), ("NONE_COMPARISON", 5)}),
    "self comparison": ("if (a.b === a.b) {}\nif (x + a == a) {}\nif (a == a.b) {}\nif (a == a + 1) {}\n"
                        "if (!a == a) {}\nf(b != b, 1 == 1)\nif (q && c == c || r) {}\n"
                        "if ('s' == 's') {}\nreturn z == z\ny == y\n",
                        {("SELF_COMPARISON", n) for n in (1, 6, 7, 8, 9, 10)}),
    "calls": ("eval(x);\nwindow.eval(x);\nnew Function('a');\nFunction('b');\nw.Function('c');\n"
              "evaluate(x);\nfunction eval(x) {}\nconst s = 'eval(x)'; // eval(y)\n"
              "eval?.(x); /* eval(z) */\nlet t = `${eval(q)}`;\nlet r = /eval(x)/;\n",
              {("DANGEROUS_EVAL", n) for n in (1, 2, 9, 10)}
              | {("DANGEROUS_FUNCTION", 4), ("DANGEROUS_FUNCTION", 5), ("UNUSED_FUNCTION", 7)}
              - {("UNUSED_FUNCTION", 7)}),
    "secrets": ("const apiKey = 'abcdefghijklmnop';\nlet password: string = 'sk-1';\n"
                "var token = 'your-token-goes-here';\nconst name = 'abcdefghijklmnop';\n"
                "const key = 'short';\nconst secret = 'abcdefghijklmnop' + x;\nconst o = {token: 'abcdefghijklmnop'};\n"
                "const ghToken = 'ghp_x'\nfoo(token)\n",
                {("HARDCODED_SECRET", 1), ("HARDCODED_SECRET", 2), ("HARDCODED_SECRET", 8)}),
    "self comparison of calls and indexes": (
        "if (f(x) === f(x)) {}\nif (a[0] == a[0]) {}\nif (a.b(c)[1].d != a.b(c)[1].d) {}\nif ((p + 1) == (p + 1)) {}\n"
        "if (f(x) === f(y)) {}\nif (a[0] == a[0].b) {}\nif (f(x) == f( x)) {}\nif (a + f(x) == f(x)) {}\n"
        "if (x) (b) == (b)\nif (g?.(1) == g?.(1)) {}\nif (f(x) == f(x)(y)) {}\nif (f(x == f(x)) {\n",
        {("SELF_COMPARISON", n) for n in (1, 2, 3, 4, 9, 10)}),
    "declarators": (
        "const a = 1, apiKey = 'abcdefghijklmnop', b = f(1, 2);\nlet m: Map<string, number> = new Map<string, number>(), token = 'ghp_x'\n"
        "const {x, y} = z, password = 'abcdefghijklmnop';\nlet key: string, secret = 'abcdefghijklmnop'.length;\n"
        "for (let i = 0, tokenName = 'abcdefghijklmnop'; i < 2; i++) {}\nconst c = 1\nkey, apiToken = 'abcdefghijklmnop'\n",
        {("HARDCODED_SECRET", n) for n in (1, 2, 3, 5)}),
    "jsx text": ("const A = () => <p>Don't {x === null ? 1 : 2}</p>;\nrender(A);\n",
                 {("NONE_COMPARISON", 1)}),
    "unterminated": ("const x = `abc ${y\n", set()),
    "empty": ("", set()),
}


def frame(spark, rows):
    return spark.createDataFrame(
        rows, "repo_id STRING, file_id BIGINT, path STRING, content STRING").repartition(3)


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"r{i}", i, f"f{i}.ts", text) for i, (text, _) in enumerate(CASES.values())]
    tokens = jstokens.js_tokens(frame(spark, rows))
    local = js_rules.local_findings(tokens).withColumn("run_id", F.col("repo_id"))
    return findings.dedupe(local).collect()


@pytest.mark.parametrize("name", CASES)
def test_case(found, name):
    i = list(CASES).index(name)
    assert {(r.type, r.line) for r in found if r.file == f"f{i}.ts"} == CASES[name][1]


def test_messages(found):
    rows = {(r.file, r.type, r.line): r for r in found}
    one = rows["f3.ts", "SELF_COMPARISON", 1]
    assert one.message == "Expression compares a.b to itself; likely a copy-paste error."
    assert rows["f2.ts", "NONE_COMPARISON", 2].description == "compared with undefined"
    assert rows["f5.ts", "HARDCODED_SECRET", 2].message.endswith("'password'.")


def snippets(found):
    return {(r.type, r.line): r.evidence.snippet for r in found}


def test_snippets_are_the_declarations(spark):
    text = ("const a = 1, apiKey = 'abcdefghijklmnop';\nel.innerHTML =\n  f(x);\nq = 'select ' + g(1) + y;\n"
            "if (f(x) ===\n f(x)) {}\nwindow.eval(code, 1);\nexport async function gone() {\n  return 1;\n}\n"
            "const live = 2, dead = <T,>(x: T): T => {\n  return x;\n}, dead2 = function () {};\nclass Old extends Base { m() {} }\nuse(live);\n")
    tokens = jstokens.js_tokens(frame(spark, [("r", 1, "a.ts", text)]))
    assert snippets(js_rules.local_findings(tokens).collect()) == {
        ("HARDCODED_SECRET", 1): "apiKey = 'abcdefghijklmnop'", ("UNSAFE_INNER_HTML", 2): "el.innerHTML =\n  f(x)",
        ("SQL_INJECTION", 4): "'select ' + g(1)", ("SELF_COMPARISON", 5): "f(x) ===\n f(x)", ("DANGEROUS_EVAL", 7): "window.eval(code, 1)"}
    found = js_rules.unused(tokens).collect()
    assert {r.message.split("'")[1]: r.evidence.snippet for r in found} == {
        "gone": "export async function gone() {\n  return 1;\n}", "dead": "dead = <T,>(x: T): T => {\n  return x;\n}",
        "dead2": "dead2 = function () {}", "Old": "class Old extends Base { m() {} }"}
    short = js_rules.unused(jstokens.js_tokens(frame(spark, [("r", 1, "a.ts", text)]), shown_chars=9)).collect()
    assert {r.evidence.snippet for r in short} == {"export as", "dead = <T", "dead2 = f", "class Old"}
    high = js_rules.high_complexity(tokens, 0).collect()
    assert {r.evidence.snippet for r in high} == {"export async function gone() {\n  return 1;\n}", "m() {}"}


def test_long_operands_are_compared_whole(spark):
    long = "f(" + ", ".join(["x"] * 2000) + ")"
    rows = [("r", 1, "a.ts", f"if ({long} == {long}) {{}}\nif ({long} == {long[:-1]}, y)) {{}}\n")]
    found = js_rules.local_findings(jstokens.js_tokens(frame(spark, rows))).collect()
    assert [r.line for r in found] == [1] and len(found[0].message) < 1000


def test_complexity(spark):
    text = ("function f(a?: number, b = a ? 1 : 2) {\n  if (a && b || c) { for (;;) { while (x) {} } }\n"
            "  do { y?.z } while (q);\n  switch (a) { case 1: case 2: break; default: }\n"
            "  try {} catch (e) {} p.catch(() => {});\n  const g = function () { if (a) {} };\n}\n"
            "class C { m() { return a ?? b } get v() { if (a) {} } static async s() { if (a) {} } }\n"
            "const h = () => { if (a) {} };\nif (a) { f(); }\n")
    tokens = jstokens.js_tokens(frame(spark, [("r", 1, "a.ts", text)]))
    got = {r.name: r.complexity for r in js_rules.complexity(tokens).collect()}
    # f: ?:, if, &&, ||, for, while, do, 2 cases, catch, inner if
    assert got == {"f": 12, "m": 1, "s": 2}
    assert [r.name for r in js_rules.complexity(tokens).where("complexity > 11").collect()] == ["f"]
    high = js_rules.high_complexity(tokens, 11).collect()
    assert [(r.line, r.description) for r in high] == [(1, "estimated cc=12")]


def test_unused_names(spark):
    rows = [
        ("r", 1, "a.ts", "export function used() {}\nexport function gone() {}\nfunction _own() {}\n"
                         "const dead = () => 1, live = 2;\nclass Old {}\nexport default function main() {}\n"),
        ("r", 2, "b.ts", "import { used } from './a';\nused();\nfunction gone2() { return 'gone' }\n"),
        ("s", 3, "a.ts", "gone(); dead(); Old;\n"),
    ]
    tokens = jstokens.js_tokens(frame(spark, rows))
    got = sorted((r.repo_id, r.file, r.type, r.line) for r in js_rules.unused(tokens).collect())
    assert got == [("r", "a.ts", "UNUSED_CLASS", 5), ("r", "a.ts", "UNUSED_FUNCTION", 2),
                   ("r", "a.ts", "UNUSED_FUNCTION", 4), ("r", "b.ts", "UNUSED_FUNCTION", 3)]
    capped = js_rules.unused(tokens, cap=2).collect()
    assert sorted(r.line for r in capped) == [2, 4]


def test_import_graph(spark):
    rows = [
        ("r", 1, "src/a.ts", "import x from '../lib/u';\nimport { help as h, type T } from './b';\nimport 'react';\n"),
        ("r", 2, "src/b.ts", "export const help = () => 1;\nimport * as q from './c';\n"),
        ("r", 3, "src/c/index.ts", "import '../../../out';\n"),
        ("r", 4, "lib/u.js", ""), ("r", 5, "lib/u.tsx", ""),
        ("s", 6, "src/b.ts", "import { a } from './a.ts';"),
    ]
    files = frame(spark, rows)
    got = {tuple(r) for r in js_rules.import_edges(jstokens.js_tokens(files), files).collect()}
    assert got == {("r", "src/a.ts", "lib/u.tsx", "import"), ("r", "src/a.ts", "src/b.ts", "import"),
                   ("r", "src/b.ts", "src/c/index.ts", "import"), ("r", "src/b.ts", "src/a.ts", "use")}


def test_import_edges_try_suffixes_in_order(spark):
    """Against a plain loop over specifiers and suffixes."""
    paths = ["a.ts", "a.tsx", "a.js", "a", "a/index.js", "a/index.ts", "b/index.tsx", "b/c.mjs", "b/c.jsx", ".ts", "index.ts",
             "b/a.ts", "b/index.ts/index.ts"]
    names = ["./a", "./a.js", "./a.ts", "./b", "./b/c", "../a", "..", ".", "./", "./b/../a", "../../a", "react", "./index", "./b/index"]
    rows = [("r", i, p, "".join(f"import '{n}';\n" for n in names)) for i, p in enumerate(paths) if p.endswith(("s", "x"))]
    files = frame(spark, rows)
    listed = spark.createDataFrame([("r", p) for p in [*paths, paths[0]]] + [("s", "a.mjs"), ("r", None)], "repo_id STRING, path STRING")
    want = set()
    for _, _, path, _ in rows:
        for n in names:
            steps = []
            for part in [*path.split("/")[:-1], *n.split("/")]:
                if part == "..":
                    steps = steps[:-1] if steps else None
                elif part not in ("", "."):
                    steps.append(part)
                if steps is None:
                    break
            if n.startswith(".") and steps is not None:
                hit = next((c for s in fv.JS_RESOLVE_SUFFIXES if (c := "/".join(steps) + s) in paths), None)
                want |= {("r", path, hit, "import")} if hit else set()
    assert {tuple(r) for r in js_rules.import_edges(jstokens.js_tokens(files), listed).collect()} == want and len(want) > 20


def test_import_edges_scan_once(spark, tmp_path):
    files = frame(spark, [("r", 1, "a.ts", "import './b'"), ("r", 2, "b.ts", "1")])
    files.write.parquet(str(tmp_path / "files"))
    jstokens.js_tokens(files).write.parquet(str(tmp_path / "tokens"))
    read = [spark.read.parquet(str(tmp_path / n)) for n in ("tokens", "files")]
    plan = js_rules.import_edges(*read)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2


def test_rules_need_no_shuffle(spark):
    tokens = jstokens.js_tokens(frame(spark, [("r", 1, "a.ts", "eval(x)")]).coalesce(1))
    plan = js_rules.local_findings(tokens)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
