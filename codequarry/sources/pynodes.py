"""Python sources as a table of syntax nodes.

Only parsing and flattening happens in Python, one file at a time, inside tasks. Every rule on the
nodes is a DataFrame expression (operators/py_rules.py).
"""

from __future__ import annotations

import ast
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from codequarry.functions import fixed_values as fv
from codequarry.schemas import PY_NODES

NODES_PER_BATCH = 20_000
PARSE_ERRORS = (SyntaxError, ValueError, RecursionError, MemoryError)


def py_nodes(files: DataFrame, kinds=None) -> DataFrame:
    """Nodes of all given files; a file that cannot be parsed gives one row of kind 'Error'.

    The result has the partitioning of the input: a map without a shuffle. With `kinds`, only nodes
    of these kinds leave the Python worker.
    """
    schema = to_arrow_schema(_parse_datatype_string(PY_NODES))
    wanted = None if kinds is None else frozenset(kinds)

    def flatten(batches):
        rows: list[tuple] = []
        for batch in batches:
            for repo, file_id, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows.extend((repo, file_id, path, *row) for row in nodes_of(content)
                            if wanted is None or row[KIND] in wanted)
                if len(rows) >= NODES_PER_BATCH:
                    yield _batch(rows, schema)
                    rows = []
        if rows:
            yield _batch(rows, schema)

    return files.select("repo_id", "file_id", "path", "content").mapInArrow(flatten, PY_NODES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


_FIELDS = ("pre last parent depth kind field idx line col end_line end_col name dotted ctx const "
           "text hidden target operands fn_chain fn_visible kids strings shape error").split()
LAST, DEPTH, KIND, SHAPE = (_FIELDS.index(n) for n in ("last", "depth", "kind", "shape"))


def nodes_of(source: str | None) -> list[list]:
    """Rows of one file in pre-order; one Error row where there is no content or no syntax tree."""
    try:
        tree, error = (None, "NoContent") if source is None else (ast.parse(source), None)
    except PARSE_ERRORS as e:
        tree, error = None, type(e).__name__
    if tree is None:
        row = dict.fromkeys(_FIELDS)
        row.update(pre=0, last=0, depth=0, kind="Error", error=error, hidden=False)
        return [list(row.values())]
    rows: list[list] = []
    # (node, parent, depth, field, idx, enclosing functions, visible ones, hidden, control target)
    stack = [(tree, None, 0, None, None, [], 0, False, False)]
    while stack:
        node, parent, depth, field, idx, chain, visible, hidden, target = stack.pop()
        pre, cls = len(rows), type(node)
        children = _children(node)
        line = getattr(node, "lineno", 0)
        name, text = _NAMES.get(cls), _TEXTS.get(cls)
        rows.append([
            pre, pre, parent, depth, cls.__name__, field, idx, line,
            node.col_offset if line else 0, node.end_lineno if line else None,
            node.end_col_offset if line else None, name(node) if name else None,
            _dotted(node.func if cls is ast.Call else node),
            type(node.ctx).__name__ if cls is ast.Name else None,
            _const(node) if cls is ast.Constant else None, text(node) if text else None, hidden,
            target, len(node.values) if cls is ast.BoolOp else None, chain, visible,
            _kids(node, children) if cls in _WITH_KIDS else None,
            _strings(node) if cls in _ASSIGNMENTS else None, None, None,
        ])
        if not children:
            continue
        if cls is ast.ExceptHandler or cls is ast.Call:
            hidden_below = hidden or _stops_visit(node)
        else:
            hidden_below = hidden
        if cls in _FUNCTIONS:
            chain, visible = [*chain, pre], visible + (not hidden)
        bound = _control_target(node, cls)
        if cls is ast.withitem and (idx > 0 or rows[parent][KIND] != "With"):
            bound = None
        for child_field, i, child in reversed(children):
            stack.append((child, pre, depth + 1, child_field, i, chain, visible, hidden_below,
                          child is bound))
    _close(rows)
    return rows


def _close(rows: list[list]) -> None:
    """Fill `last` (end of the subtree) bottom-up, then the shape of each function."""
    for row in reversed(rows):
        parent = row[2]
        if parent is not None and row[LAST] > rows[parent][LAST]:
            rows[parent][LAST] = row[LAST]
    for row in rows:
        if row[KIND] in _FUNCTION_KINDS:
            body = rows[row[0] + 1: row[LAST] + 1]
            body.sort(key=lambda r: r[DEPTH])  # stable: breadth-first order
            row[SHAPE] = " ".join("DEF" if r[KIND] in _FUNCTION_KINDS else r[KIND]
                                  for r in body if r[KIND] not in _SKIPPED)


_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_FUNCTION_KINDS = ("FunctionDef", "AsyncFunctionDef")
_SKIPPED = frozenset(fv.SHAPE_SKIPPED_KINDS)
_ASSIGNMENTS = (ast.Assign, ast.AnnAssign)
_LOOPS = (ast.For, ast.AsyncFor, ast.comprehension)
# Nodes whose children rules look at, and nodes that hold lists of statements.
_WITH_KIDS = frozenset((
    ast.Call, ast.Compare, ast.Import, ast.ImportFrom, *_ASSIGNMENTS, ast.Module, *_FUNCTIONS,
    ast.ClassDef, ast.For, ast.AsyncFor, ast.While, ast.If, ast.With, ast.AsyncWith, ast.Try,
    ast.TryStar, ast.ExceptHandler, ast.match_case,
))


def _children(node) -> list[tuple]:
    """(field, position, child) in the order of the grammar, without load and store marks."""
    out = []
    for name in node._fields:
        value = getattr(node, name, None)
        if isinstance(value, list):
            out.extend((name, i, x) for i, x in enumerate(value) if isinstance(x, ast.AST))
        elif isinstance(value, ast.AST) and not isinstance(value, ast.expr_context):
            out.append((name, 0, value))
    return out


def _dotted(node) -> str | None:
    """a.b.c of a chain of attributes; a base that is no name counts as ''."""
    if isinstance(node, ast.Name):
        return node.id
    if not isinstance(node, ast.Attribute):
        return None
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    names.append(node.id if isinstance(node, ast.Name) else "")
    return ".".join(reversed(names))


_NAMES = {
    ast.Name: lambda n: n.id,
    ast.keyword: lambda n: n.arg,
    ast.arg: lambda n: n.arg,
    ast.Attribute: lambda n: n.attr,
    ast.ExceptHandler: lambda n: n.name,
    ast.FunctionDef: lambda n: n.name,
    ast.AsyncFunctionDef: lambda n: n.name,
    ast.ClassDef: lambda n: n.name,
    ast.alias: lambda n: (n.asname or n.name).split(".")[0],
    ast.BinOp: lambda n: type(n.op).__name__,
    ast.Expr: lambda n: _dotted(n.value.func) if isinstance(n.value, ast.Call) else None,
}


def _const(node) -> str:
    return "none" if node.value is None else type(node.value).__name__


def _string(node) -> str | None:
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return _storable(node.value)
    return None


def _constant_parts(node) -> str | None:
    parts = [v.value for v in node.values if isinstance(v, ast.Constant)]
    return _storable("\n".join(parts)) if parts else None


_TEXTS = {
    ast.Constant: _string,
    ast.BinOp: lambda n: _string(n.left),
    ast.JoinedStr: _constant_parts,
    ast.ImportFrom: lambda n: str(n.module),
    ast.alias: lambda n: n.name,
    ast.keyword: lambda n: n.value.id if isinstance(n.value, ast.Name) else None,
}


def _storable(text: str) -> str:
    """Lone surrogates cannot be stored as UTF-8."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def _kids(node, children) -> list[tuple]:
    compared = isinstance(node, ast.Compare)
    out = []
    for field, i, c in children:
        cls = type(c)
        inner = c.value if cls is ast.keyword else c
        constant = isinstance(inner, ast.Constant)
        name, text = _NAMES.get(cls), _TEXTS.get(cls)
        out.append((
            field, i, cls.__name__, name(c) if name else None, _const(inner) if constant else None,
            bool(inner.value) if constant else None, text(c) if text else None,
            type(inner).__name__ if inner is not c else None, _digest(c) if compared else None,
            getattr(c, "lineno", 0), getattr(c, "col_offset", 0),
        ))
    return out


def _digest(node) -> str | None:
    try:
        return hashlib.md5(ast.dump(node).encode("utf-8", "replace")).hexdigest()
    except RecursionError:  # an operand nested this deep is not compared
        return None


def _strings(node) -> list[str] | None:
    """String constants in the value that is assigned to a name."""
    targets = node.targets if isinstance(node, ast.Assign) else [node.target]
    if node.value is None or not any(isinstance(t, ast.Name) for t in targets):
        return None
    return [_storable(n.value) for n in ast.walk(node.value)
            if isinstance(n, ast.Constant) and isinstance(n.value, str)]


def _stops_visit(node) -> bool:
    """Nodes below which visitor rules do not look."""
    if isinstance(node, ast.ExceptHandler):
        return len(node.body) == 1 and isinstance(node.body[0], ast.Raise)
    return _dotted(node.func) == "yaml.load" and any(
        k.arg == "Loader" and isinstance(k.value, ast.Name) and k.value.id == "FullLoader"
        for k in node.keywords)


def _control_target(node, cls):
    """The name that a loop, comprehension or with-item binds."""
    target = node.target if cls in _LOOPS else node.optional_vars if cls is ast.withitem else None
    return target if isinstance(target, ast.Name) else None


def parse_errors(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind") == "Error").select("repo_id", "file_id", "path", "error")
