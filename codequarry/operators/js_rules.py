"""JavaScript and TypeScript rules as expressions over token arrays.

A file's tokens are one array; shifted copies of it are zipped before the explode, so that each
token row carries its neighbours without a window, a join or a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv
from codequarry.functions import text as t
from codequarry.functions.grouping import skew_join, top_per_group
from codequarry.functions.rows import exploded

SOURCE = "ts-morph"
KEYS = ("repo_id", "file_id", "path")
EQUALITY = ("===", "!==", "==", "!=")
DECLARED = ("function", "function_value", "class", "default_function")
# Operators that bind at least as tightly as addition, and as equality.
UNARY = (".", "?.", "!", "~", "++", "--", "typeof", "void", "delete", "await", "new")
ADDITIVE = UNARY + ("+", "-", "*", "/", "%", "**")
EQUAL = ADDITIVE + EQUALITY + ("<", ">", "<=", ">=", "<<", ">>", ">>>", "instanceof", "in", "as")
FOLLOWS = (".", "?.", "(", "[", "+", "-", "*", "/", "%", "**", "<", ">", "<=", ">=", "<<", ">>",
           ">>>", "instanceof", "in", "as", "++", "--", "!", "TEMPLATE")
SQL = t.ascii_words(fv.JS_SQL_PATTERN.removeprefix(r"\b(").removesuffix(r")\b"))


def token_rows(files: DataFrame) -> DataFrame:
    return files.select(*KEYS, F.inline("tokens"))


def _shifted(by: int) -> Column:
    """The token array moved by some places, padded with nulls."""
    tokens, size = F.col("tokens"), F.size("tokens")
    gap = F.array_repeat(F.lit(None), F.least(F.lit(abs(by)), size))
    if by > 0:
        return F.concat(F.slice(tokens, F.lit(by + 1), F.greatest(size - by, F.lit(0))), gap)
    return F.concat(gap, F.slice(tokens, F.lit(1), F.greatest(size + by, F.lit(0))))


def neighbours(files: DataFrame) -> DataFrame:
    """Token rows with the two tokens before (p2, p1) and after (n1, n2)."""
    zipped = F.arrays_zip(
        F.col("tokens").alias("t"), _shifted(-1).alias("p1"), _shifted(-2).alias("p2"),
        _shifted(1).alias("n1"), _shifted(2).alias("n2"))
    return files.select(*KEYS, F.inline_outer(zipped)).where(F.col("t").isNotNull())


def _op(*texts: str) -> Column:
    return (F.col("t.kind") == "OP") & F.col("t.text").isin(*texts)


def _is(side: str, text: str) -> Column:
    return F.coalesce((F.col(side)["text"] == text) & (F.col(side)["kind"] != "STRING"),
                      F.lit(False))


def _loose(neighbour: Column, tight) -> Column:
    """Is the neighbour of an operand absent, or an operator that binds less tightly?"""
    return neighbour.isNull() | ~neighbour.isin(*tight)


def hit(rule: str, place: str, *args: Column, detail: Column | None = None) -> Column:
    type_, category, confidence, message, text = fv.JS_RULES[rule]
    at = F.col(place)
    return F.struct(
        F.lit(type_).alias("type"), F.lit(category).alias("category"),
        F.lit(confidence).alias("confidence"),
        (F.format_string(message, *args) if args else F.lit(message)).alias("message"),
        (F.lit(text) if detail is None else F.format_string(text, detail)).alias("detail"),
        at["line"].alias("line"), at["col"].alias("col"), F.col("t.pos").alias("pos"),
        F.col("t.shown").alias("shown"))


# --- local rules ------------------------------------------------------------
def sql_concat() -> Column:
    left = F.col("p1")
    return F.when(_op("+") & (left["kind"] == "STRING") & _loose(left["before"], ADDITIVE)
                  & left["text"].rlike(SQL), hit("SQL_INJECTION", "p1"))


def inner_html() -> Column:
    return F.when(_op("=", "+=", "-=") & _is("p1", "innerHTML") & _is("p2", "."),
                  hit("UNSAFE_INNER_HTML", "p1"))


def none_comparison() -> Column:
    left, right = F.col("p1"), F.col("n1")

    def empty(side):
        return side["chain"].isin("null", "undefined")

    compared = (F.when(empty(left) & _loose(left["before"], EQUAL), left["chain"])
                .when(empty(right) & _loose(right["after"], FOLLOWS), right["chain"]))
    return F.when(_op(*EQUALITY) & compared.isNotNull(),
                  hit("NONE_COMPARISON", "p1", detail=compared))


def self_comparison() -> Column:
    left, right = F.col("p1"), F.col("n1")
    return F.when(
        _op(*EQUALITY) & (left["chain"] == right["chain"]) & _loose(left["before"], EQUAL)
        & _loose(right["after"], FOLLOWS), hit("SELF_COMPARISON", "p1", left["chain"]))


def _called(name: str) -> Column:
    """A call whose callee is a name or ends in .name; not a declaration or a constructor."""
    call = _is("n1", "(") | (_is("n1", "?.") & _is("n2", "("))
    return ((F.col("t.kind") == "IDENT") & (F.col("t.text") == name) & call
            & ~_is("p1", "function") & ~F.coalesce(F.col("t.before") == "new", F.lit(False)))


def eval_call() -> Column:
    return F.when(_called("eval"), hit("DANGEROUS_EVAL", "t"))


def function_call() -> Column:
    return F.when(_called("Function"), hit("DANGEROUS_FUNCTION", "t"))


def secret_name(name: Column) -> Column:
    return name.rlike("(?i)" + fv.JS_SECRET_NAME)


def secret_value(value: Column) -> Column:
    long = (F.length(value) >= fv.JS_SECRET_MIN_LENGTH) & ~value.rlike(
        "(?i)" + fv.JS_SECRET_PLACEHOLDER)
    return value.rlike("(?i)" + fv.JS_SECRET_PREFIX) | long


def secret() -> Column:
    """A variable whose whole initialiser is one string literal."""
    alone = _loose(F.col("t.after"), ADDITIVE + EQUAL + ("?", "&&", "||", "??", "(")) & ~(
        _is("n1", ".") | _is("n1", "?.") | _is("n1", "["))
    return F.when((F.col("t.kind") == "STRING") & secret_name(F.col("t.owner")) & alone
                  & secret_value(F.col("t.text")), hit("HARDCODED_SECRET", "t", F.col("t.owner")))


LOCAL_RULES: dict[str, Callable[[], Column]] = {
    "sql_concat": sql_concat,
    "inner_html": inner_html,
    "none_comparison": none_comparison,
    "self_comparison": self_comparison,
    "eval_call": eval_call,
    "function_call": function_call,
    "secret": secret,
}


def local_findings(files: DataFrame, *rules: str) -> DataFrame:
    hits = F.array_compact(F.array(*[LOCAL_RULES[r]() for r in (rules or LOCAL_RULES)]))
    relevant = F.col("t.kind").isin("OP", "STRING") | F.col("t.text").isin("eval", "Function")
    found = exploded(neighbours(files).where(relevant), KEYS, hits, "hit")
    return _findings(found.select(*KEYS, "hit.*"))


# --- complexity -------------------------------------------------------------
def complexity(files: DataFrame) -> DataFrame:
    """Complexity of top-level functions and methods: 1 + decisions inside. One row per function."""
    words = ("if", "for", "while", "do", "case", "catch")
    word = ((F.col("t.kind") == "KEYWORD") & F.col("t.text").isin(*words)
            & ~F.col("t.role").eqNullSafe("do_tail"))
    ternary = _op("?") & ~F.coalesce(
        F.col("n1.text").isin(":", ")", ",", ";", "=", "]", "}") & (F.col("n1.kind") == "OP"),
        F.lit(False))
    decision = word | _op("&&", "||") | ternary
    own = F.col("t.pos") == F.col("t.fn")
    named = F.when(own, F.col("t.text"))
    return neighbours(files).where(F.col("t.fn").isNotNull() & (decision | own)).groupBy(
        *KEYS, F.col("t.fn").alias("fn")
    ).agg(F.max(named).alias("name"), F.max(F.when(own, F.col("t.line"))).alias("line"),
          F.max(F.when(own, F.col("t.shown"))).alias("shown"), F.max(F.when(own, F.col("t.col"))).alias("col"),
          (F.count_if(decision) + 1).cast("int").alias("complexity"))


def high_complexity(files: DataFrame, limit: int = fv.JS_COMPLEXITY_LIMIT) -> DataFrame:
    type_, category, confidence, message, detail = fv.JS_RULES["HIGH_COMPLEXITY"]
    cc = F.col("complexity").cast("string")
    return _findings(complexity(files).where(F.col("complexity") > limit).select(
        *KEYS, F.lit(type_).alias("type"), F.lit(category).alias("category"),
        F.lit(confidence).alias("confidence"),
        F.format_string(message, "name", cc).alias("message"),
        F.format_string(detail, cc).alias("detail"), "line", "col", F.col("fn").alias("pos"), "shown"))


# --- unused names -----------------------------------------------------------
def names(files: DataFrame) -> DataFrame:
    """Identifiers of the token table, with their roles."""
    return token_rows(files).where("kind = 'IDENT'").select(
        *KEYS, "text", "line", "col", "pos", "role", "shown")


def name_counts(idents: DataFrame, sign: Column | int = 1) -> DataFrame:
    """Declarations and uses of each name of a repository; a partial aggregation. Rows may count negatively."""
    declared = F.coalesce(F.col("role").isin(*DECLARED), F.lit(False))
    one = sign if isinstance(sign, Column) else F.lit(sign)
    return idents.groupBy("repo_id", "text").agg(
        F.sum(F.when(declared, one).otherwise(0)).alias("declared"),
        F.sum(F.when(declared, 0).otherwise(one)).alias("used"))


def declarations(idents: DataFrame) -> DataFrame:
    """Declared functions and classes that count as unused if their name has no use."""
    return idents.where(F.col("role").isin("function", "function_value", "class")
                        & ~F.startswith("text", F.lit("_")))


def unused(files: DataFrame, cap: int | None = None) -> DataFrame:
    """Functions and classes whose name occurs nowhere else in the repository, by name.

    Names are counted with a partial aggregation; only names without any use go on. With `cap`, at most
    so many findings per repository, in file order.
    """
    idents = names(files)
    dead = name_counts(idents).where("declared > 0 AND used = 0").select("repo_id", "text")
    return unused_findings(declarations(idents), dead, cap)


def unused_findings(declared: DataFrame, dead: DataFrame, cap: int | None = None) -> DataFrame:
    """Findings for the declarations whose (repo_id, text) is among the dead names."""
    found = skew_join(declared, dead, ["repo_id", "text"], "inner", ["file_id", "pos"])
    rule = t.lookup(F.col("role"), {"function": "UNUSED_FUNCTION", "class": "UNUSED_CLASS"},
                    "UNUSED_FUNCTION_VALUE")
    # in a file, function values come first, then functions, then classes
    phase = t.lookup(F.col("role"), {"function_value": 0, "function": 1}, 2)
    first = found.withColumn("phase", phase)
    if cap is not None:
        first = top_per_group(first, ["repo_id"], ["path", "phase", "pos"], cap)
    rules = {k: fv.JS_RULES[k] for k in ("UNUSED_FUNCTION_VALUE", "UNUSED_FUNCTION",
                                         "UNUSED_CLASS")}
    messages = {k: F.format_string(v[3], F.col("text")) for k, v in rules.items()}
    message = F
    for key, text in messages.items():
        message = message.when(rule == key, text)
    return _findings(first.select(
        *KEYS, t.lookup(rule, {k: v[0] for k, v in rules.items()}, None).alias("type"),
        F.lit("CODE_SMELL").alias("category"), F.lit(0.5).alias("confidence"),
        message.alias("message"), F.lit(rules["UNUSED_CLASS"][4]).alias("detail"),
        "line", "col", "pos", "shown"))


# --- import graph -----------------------------------------------------------
def stem_index(files: DataFrame) -> DataFrame:
    """For each (repo_id, stem): the file that a specifier of this base means.

    A file has a stem for each suffix of resolution that its path ends with, so few rows a file; the suffix that is tried
    first wins. Looking bases up here needs no row per specifier and suffix.
    """
    suffixes = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(s).alias("suffix"))
                         for i, s in enumerate(fv.JS_RESOLVE_SUFFIXES)])
    ends = F.filter(suffixes, lambda s: F.endswith(F.col("path"), s["suffix"]))
    rows = files.where("path IS NOT NULL").select("repo_id", "path", F.explode(ends).alias("end"))
    stem = F.left("path", F.length("path") - F.length("end.suffix"))
    return rows.groupBy("repo_id", stem.alias("stem")).agg(
        F.min_by("path", F.struct("end.rank", "path")).alias("target"))


def _base(specifier: Column) -> Column:
    """Path that a relative specifier of a file in `path` names, without a suffix; null for packages."""
    folder = F.array_join(F.slice(t.parts(F.col("path")), F.lit(1),
                                  F.size(t.parts(F.col("path"))) - 1), "/")
    return F.when(F.startswith(specifier, F.lit(".")), _normal(F.concat(folder, F.lit("/"), specifier)))


def _normal(path: Column) -> Column:
    """Path without '.' and '..' parts; null when it leaves the repository."""
    steps = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")
    folded = F.aggregate(steps, start, lambda acc, p: F.when(
        p == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)))
        .otherwise(F.concat(acc, F.array(p))))
    return F.array_join(folded, "/")


def import_edges(tokens: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of a file to each file it imports, and of a function value to the first file, by path, that uses it.

    One scan of the tokens, one of the files, and one join: a function value looks up its own path, which is a stem of the
    file, so it meets the imports of its name in one aggregate. Equal rows go before the join, and a file that very many
    import is left to AQE's skew join, since the index has one row a stem.
    """
    role, text = F.col("role"), F.col("text")
    base = (F.when(role == "function_value", F.col("path"))
            .otherwise(_base(F.when(role == "import", text).otherwise(F.col("owner")))))
    rows = token_rows(tokens).where(role.isin("import", "import_name", "function_value")).select(
        "repo_id", base.alias("stem"), F.when(role == "import", F.col("path")).alias("src"),
        F.when(role != "import", text).alias("name"), F.when(role == "import_name", F.col("path")).alias("user"),
        (role == "function_value").alias("is_value")).where("stem IS NOT NULL")
    fewer = rows.groupBy("repo_id", "stem", "src", "name").agg(
        F.min("user").alias("user"), F.max("is_value").alias("is_value"))
    met = fewer.join(stem_index(files), ["repo_id", "stem"]).groupBy("repo_id", "target", "src", "name").agg(
        F.min("user").alias("user"), F.max("is_value").alias("is_value"))
    imported = F.col("name").isNull()
    return met.where(imported | (F.col("is_value") & F.col("user").isNotNull())).select(
        "repo_id", F.when(imported, F.col("src")).otherwise(F.col("target")).alias("src"),
        F.when(imported, F.col("target")).otherwise(F.col("user")).alias("dst"),
        F.when(imported, F.lit("import")).otherwise(F.lit("use")).alias("kind")).distinct()


def js_findings(tokens: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName,
                  [local_findings(tokens), high_complexity(tokens), unused(tokens)])


def _findings(hits: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return hits.select(
        *KEYS, F.lit(SOURCE).alias("source"), "type", "category", F.col("path").alias("file"),
        "line", "col", "message", F.col("detail").alias("description"), "confidence",
        F.struct(F.col("type").alias("rule"), F.col("shown").alias("snippet"), none.alias("detail"),
                 none.alias("name"), none.alias("function"), none.alias("code"), none.alias("url"),
                 F.lit(None).cast("int").alias("complexity")).alias("evidence"),
        F.struct(F.lit(fv.SOURCE_ORDER.index(SOURCE)).alias("src"), F.col("path").alias("file"),
                 F.lit(1).alias("phase"), F.col("pos").alias("a"), F.lit(0).alias("b"),
                 F.lit(0).alias("c")).alias("ord"))


def secrets_in_text(documents: DataFrame, key: str, text: str) -> DataFrame:
    """`name = "value"` passages of plain texts, judged like variables of a script."""
    pattern = r'(\w*)\s*=\s*"([^"]*)"'
    # A cheap test first: the full pattern tries every word of a text.
    passages = exploded(documents.where(F.col(text).rlike(r'=\s*"')), [key],
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), "pair", "pos")
    parts = passages.select(
        key, "pos", F.regexp_extract("pair", pattern, 1).alias("name"),
        F.regexp_extract("pair", pattern, 2).alias("value"))
    return parts.where((F.col("name") != "") & secret_name(F.col("name"))
                       & secret_value(F.col("value")))
