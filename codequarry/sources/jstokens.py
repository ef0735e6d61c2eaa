"""JavaScript and TypeScript sources as a table of tokens.

There is no parser for these languages in the runtime, so the rules work on tokens. This module
only splits one text into tokens and marks declarations; every rule is a DataFrame expression.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from codequarry.functions import fixed_values as fv
from codequarry.schemas import JS_FILES

FILES_PER_BATCH = 64
TOKENS_PER_BATCH = 100_000

# fixed values: words and operators of the language
KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else export extends false "
    "finally for function if import in instanceof let new null return super switch this throw true "
    "try typeof var void while with yield await async".split())
OPERATORS = (
    ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ++ -- += -= *= /= %= &= "
    "|= ^= << >> **").split()
REGEX_AFTER_WORD = frozenset(
    "return typeof case in of delete void throw new instanceof do else yield await".split())
MODIFIERS = frozenset("static async public private protected override abstract readonly".split())

_TOKEN = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|\A#![^\n]*)"
    r"|(?P<word>[A-Za-z_$\x80-\U0010ffff][\w$]*|\#[A-Za-z_$][\w$]*)"
    r"|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<tick>`)"
    r"|(?P<op>\?\.(?!\d)|" + "|".join(re.escape(o) for o in OPERATORS) + r"|.)",
    re.DOTALL)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{|\Z)", re.DOTALL)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "\n": ""}


def js_tokens(files: DataFrame, shown_chars: int = fv.JS_SNIPPET_CHARS) -> DataFrame:
    """One row per file with its tokens. A map without a shuffle.

    `shown` of a token holds at most `shown_chars` characters.
    """
    schema = to_arrow_schema(_parse_datatype_string(JS_FILES))

    def split(batches):
        rows, size = [], 0
        for batch in batches:
            for repo, file_id, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((repo, file_id, path, tokens_of(content, shown_chars)))
                size += len(rows[-1][3])
                if len(rows) >= FILES_PER_BATCH or size >= TOKENS_PER_BATCH:
                    yield _batch(rows, schema)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, schema)

    return files.select("repo_id", "file_id", "path", "content").mapInArrow(split, JS_FILES)


def _batch(rows, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class Token:
    __slots__ = ("line", "col", "kind", "text", "brace", "paren", "chain", "before", "after", "fn",
                 "role", "owner", "shown", "start", "end")

    def __init__(self, line, col, kind, text, start, end):
        self.line, self.col, self.kind, self.text, self.start, self.end = line, col, kind, text, start, end
        self.brace = self.paren = 0
        self.chain = self.before = self.after = self.fn = self.role = self.owner = self.shown = None


def tokens_of(source: str | None, shown_chars: int = fv.JS_SNIPPET_CHARS) -> list[tuple]:
    """Tokens of one file; a file without content has none."""
    source = source or ""
    tokens = _split(source)
    _mark_keywords(tokens)
    closing = _mark_depths(tokens)
    _mark_chains(tokens)
    file = _File(source, tokens, shown_chars)
    _mark_declarations(file, closing)
    _mark_expressions(file)
    return [(i, t.line, t.col, t.kind, t.text, t.brace, t.paren, t.chain, t.before, t.after, t.fn,
             t.role, t.owner, t.shown) for i, t in enumerate(tokens)]


class _File:
    """Tokens with their source text and the partners of all brackets, in both directions."""

    def __init__(self, source: str, tokens: list[Token], shown_chars: int):
        self.source, self.tokens, self.shown_chars = source, tokens, shown_chars
        self.partner: dict[int, int] = {}
        opened: list[int] = []
        for i, t in enumerate(tokens):
            if t.kind == "OP" and t.text in _CLOSER:
                opened.append(i)
            elif t.kind == "OP" and t.text in _OPENER and opened and _CLOSER[tokens[opened[-1]].text] == t.text:
                a = opened.pop()
                self.partner[a], self.partner[i] = i, a

    def text(self, first: int, last: int) -> str:
        return self.source[self.tokens[first].start:self.tokens[last].end]

    def shown(self, first: int, last: int) -> str:
        a = self.tokens[first].start
        return self.source[a:min(self.tokens[last].end, a + self.shown_chars)]

    def operand_text(self, first: int, last: int) -> str:
        """The text of an operand; a long one is its beginning and a digest of all of it."""
        text = self.text(first, last)
        if len(text) <= self.shown_chars:
            return text
        return text[:self.shown_chars] + " #" + hashlib.sha256(text.encode(errors="replace")).hexdigest()

    def is_op(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "OP" and self.tokens[i].text in texts

    def operand_before(self, i: int) -> int | None:
        """First token of the operand that ends at i: names, literals, calls, indexes and groups."""
        while i >= 0:
            if self.is_op(i, ")", "]"):
                i = self.partner.get(i, -1)
                if i < 0:
                    return None
                before = i - 1
                joined = before >= 0 and (self.tokens[before].kind == "IDENT" or self.is_op(before, "]") or (
                    self.is_op(before, ")") and not self._is_condition(before)) or self._word(before, "this", "super"))
                if joined:
                    i = before
                    continue
                if self.is_op(before, "?."):
                    i = before - 1
                    continue
                return i
            if not _operand(self.tokens[i]):
                return None
            if not self.is_op(i - 1, ".", "?."):
                return i
            i -= 2
        return None

    def operand_after(self, i: int) -> int | None:
        """Last token of the operand that begins at i."""
        if i >= len(self.tokens):
            return None
        if self.is_op(i, "(", "["):
            i = self.partner.get(i)
            if i is None:
                return None
        elif not _operand(self.tokens[i]):
            return None
        while True:
            if self.is_op(i + 1, ".", "?.") and i + 2 < len(self.tokens) and self.tokens[i + 2].kind == "IDENT":
                i += 2
            elif self.is_op(i + 1, "(", "[") and i + 1 in self.partner:
                i = self.partner[i + 1]
            elif self.is_op(i + 1, "?.") and self.is_op(i + 2, "(", "[") and i + 2 in self.partner:
                i = self.partner[i + 2]
            else:
                return i

    def _word(self, i: int, *words: str) -> bool:
        return self.tokens[i].kind == "KEYWORD" and self.tokens[i].text in words

    def _is_condition(self, closer: int) -> bool:
        """Is the bracket the head of a statement, as in `if (a) (b)`?"""
        head = self.partner.get(closer, 0) - 1
        return head >= 0 and self._word(head, "if", "while", "for", "switch", "with", "catch")

    def statement_end(self, i: int) -> int:
        """Last token of the expression that begins at i: up to a comma, a semicolon or a closing bracket
        outside it, or a line that cannot go on with it."""
        last = i
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.kind == "OP" and t.text in (",", ";", ")", "]", "}"):
                break
            if i > last and _ends_line(self.tokens[last], t):
                break
            last = self.partner.get(i, i) if t.kind == "OP" and t.text in _CLOSER else i
            i = last + 1
        return last


_CLOSER = {"(": ")", "[": "]", "{": "}"}
_OPENER = frozenset(_CLOSER.values())
_GOES_ON = frozenset("instanceof in of as satisfies".split())


def _ends_line(last: Token, t: Token) -> bool:
    """Does a statement end between two neighbouring tokens, because a new line begins with an operand?"""
    ended = _operand(last) or last.kind == "OP" and last.text in (")", "]", "}", "++", "--")
    begins = t.kind in ("IDENT", "NUMBER", "STRING", "KEYWORD") and t.text not in _GOES_ON
    return ended and begins and t.line > last.line


def _split(source: str) -> list[Token]:
    tokens: list[Token] = []
    templates: list[int] = []  # brace depth at each open ${
    depth, at, line, line_start = 0, 0, 1, 0

    def add(kind, text, start):
        tokens.append(Token(line, start - line_start, kind, text, start, start + len(raw)))

    while at < len(source):
        start = at
        m = _TOKEN.match(source, at)
        kind, raw = m.lastgroup, m.group()
        if kind == "word":
            add("IDENT", raw, start)
        elif kind == "number":
            add("NUMBER", raw, start)
        elif kind == "string":
            add("STRING", _unescaped(raw[1:-1]), start)
        elif kind == "tick" or (raw == "}" and templates and templates[-1] == depth):
            if raw == "}":
                templates.pop()
            piece = _TEMPLATE.match(source, m.end())
            raw = source[start:piece.end()]
            add("TEMPLATE", raw, start)
            if raw.endswith("${"):
                templates.append(depth)
        elif kind == "op":
            regex = _REGEX.match(source, at) if raw in ("/", "/=") and _regex_may_follow(tokens) else None
            if regex:
                raw = regex.group()
                add("REGEX", raw, start)
            else:
                depth += (raw == "{") - (raw == "}")
                add("OP", raw, start)
        at = start + len(raw)
        breaks = raw.count("\n")
        if breaks:
            line += breaks
            line_start = start + raw.rindex("\n") + 1
    return tokens


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: _ESCAPED.get(m.group(1), m.group(1)), text) if "\\" in text else text


def _regex_may_follow(tokens: list[Token]) -> bool:
    if not tokens:
        return True
    last = tokens[-1]
    if last.kind == "OP":
        return last.text not in (")", "]", "}", "++", "--")
    return last.kind == "IDENT" and last.text in REGEX_AFTER_WORD


def _text(tokens, i) -> str | None:
    return tokens[i].text if 0 <= i < len(tokens) and tokens[i].kind != "STRING" else None


def _mark_keywords(tokens: list[Token]) -> None:
    """Reserved words, unless they are property names."""
    for i, t in enumerate(tokens):
        if t.kind == "IDENT" and t.text in KEYWORDS:
            named = _text(tokens, i - 1) in (".", "?.") or (
                _text(tokens, i + 1) == ":" and t.text not in ("default", "null", "true", "false",
                                                              "this"))
            if not named:
                t.kind = "KEYWORD"


def _mark_depths(tokens: list[Token]) -> dict[int, int]:
    """Depth of braces and parentheses outside each token; returns the partner of each opener."""
    brace, paren, opened, closing = 0, 0, [], {}
    for i, t in enumerate(tokens):
        if t.kind == "OP":
            if t.text in (")", "}"):
                paren -= t.text == ")" and paren > 0
                brace -= t.text == "}" and brace > 0
                if opened:
                    closing[opened.pop()] = i
            t.brace, t.paren = brace, paren
            if t.text in ("(", "{"):
                opened.append(i)
                paren += t.text == "("
                brace += t.text == "{"
        else:
            t.brace, t.paren = brace, paren
    return closing


def _operand(t: Token) -> bool:
    return t.kind in ("IDENT", "STRING", "NUMBER", "TEMPLATE", "REGEX") or (
        t.kind == "KEYWORD" and t.text in ("this", "super", "null", "true", "false"))


def _mark_chains(tokens: list[Token]) -> None:
    i = 0
    while i < len(tokens):
        if not _operand(tokens[i]):
            i += 1
            continue
        end = i
        while (end + 2 < len(tokens) and tokens[end + 1].kind == "OP"
               and tokens[end + 1].text in (".", "?.") and tokens[end + 2].kind == "IDENT"):
            end += 2
        run = tokens[i:end + 1]
        quote = '"' if run[0].kind == "STRING" else ""
        chain = quote + "".join(t.text for t in run) + quote
        before = _shown(tokens[i - 1]) if i else None
        after = _shown(tokens[end + 1]) if end + 1 < len(tokens) else None
        for t in run:
            t.chain, t.before, t.after = chain, before, after
        i = end + 1


def _shown(t: Token) -> str:
    """A neighbour as seen from a run: its text, or its kind for operands."""
    return t.text if t.kind in ("OP", "KEYWORD") or t.text in ("as", "of") else t.kind


def _starts_statement(tokens: list[Token], i: int) -> bool:
    """Can token i begin a declaration? Skips export, default, async and declare before it."""
    i -= 1
    while i >= 0 and tokens[i].text in ("export", "default", "async", "declare", "abstract"):
        i -= 1
    if i < 0:
        return True
    t = tokens[i]
    return (t.kind == "OP" and t.text in (";", "}", "{")) or (
        (_operand(t) or t.text in (")", "]")) and t.line < tokens[i + 1].line)


def _mark_declarations(file: _File, closing: dict[int, int]) -> None:
    tokens = file.tokens
    class_bodies: list[int] = []  # index of the last token of each top-level class body
    for i, t in enumerate(tokens):
        while class_bodies and i > class_bodies[-1]:
            class_bodies.pop()
        if t.kind == "KEYWORD" and t.text == "import":
            _mark_import(tokens, i)
        elif t.kind == "KEYWORD" and t.text in ("const", "let", "var"):
            _mark_variables(file, i + 1)
        elif t.kind == "KEYWORD" and t.text == "do" and _text(tokens, i + 1) == "{":
            tail = closing.get(i + 1, len(tokens)) + 1
            if _text(tokens, tail) == "while":
                tokens[tail].role = "do_tail"
        elif t.brace == 0 and t.paren == 0 and t.kind == "KEYWORD" and _starts_statement(tokens, i):
            if t.text == "function":
                star = _text(tokens, i + 1) == "*"
                name = i + 1 + star
                if name < len(tokens) and tokens[name].kind == "IDENT":
                    default = any(x.text == "default" for x in tokens[max(0, i - 2):i])
                    tokens[name].role = "default_function" if default else "function"
                    _mark_extent(file, _first_of(tokens, i), i, name, closing)
            elif t.text == "class":
                if i + 1 < len(tokens) and tokens[i + 1].kind == "IDENT":
                    tokens[i + 1].role = "class"
                body = _next_open(tokens, i)
                if body is not None:
                    class_bodies.append(closing.get(body, len(tokens) - 1))
                    if i + 1 < len(tokens):
                        tokens[i + 1].shown = file.shown(_first_of(tokens, i), class_bodies[-1])
        elif (class_bodies and t.brace == 1 and t.paren == 0 and t.kind == "IDENT"
              and t.text != "constructor" and _text(tokens, i + 1) == "(" and _is_method(tokens, i)):
            t.role = "method"
            first = i
            while first and tokens[first - 1].text in MODIFIERS | {"*"}:
                first -= 1
            _mark_extent(file, first, i, i, closing)


def _is_method(tokens: list[Token], i: int) -> bool:
    j = i - 1
    while j >= 0 and (tokens[j].text in MODIFIERS or tokens[j].text == "*"):
        j -= 1
    before = tokens[j]
    if before.text in ("get", "set") and before.line == tokens[i].line:
        return False
    return before.text in ("{", "}", ";") or (before.text != "." and before.line < tokens[i].line)


def _next_open(tokens: list[Token], i: int) -> int | None:
    """Index of the brace that opens the body of a declaration at i."""
    for j in range(i + 1, len(tokens)):
        t = tokens[j]
        if t.brace == tokens[i].brace and t.paren == tokens[i].paren and t.kind == "OP":
            if t.text == "{":
                return j
            if t.text == ";":
                return None
    return None


def _first_of(tokens: list[Token], i: int) -> int:
    """First token of a declaration: its modifiers belong to it."""
    while i and tokens[i - 1].text in ("export", "default", "async", "declare", "abstract"):
        i -= 1
    return i


def _mark_extent(file: _File, first: int, start: int, name: int, closing: dict[int, int]) -> None:
    body = _next_open(file.tokens, start)
    if body is None:
        return
    last = closing.get(body, len(file.tokens) - 1)
    file.tokens[name].shown = file.shown(first, last)
    for t in file.tokens[start:last + 1]:
        t.fn = name


def _mark_variables(file: _File, i: int) -> None:
    """The declarators `name [: type] [= initialiser]` of a list that begins at i."""
    for name, first, last in _declarators(file, i):
        tokens = file.tokens
        tokens[first].owner = tokens[name].text
        if tokens[first].kind == "STRING":
            tokens[first].shown = file.shown(name, last)
        if _is_function(file, first):
            tokens[name].role, tokens[name].shown = "function_value", file.shown(name, last)


def _declarators(file: _File, i: int) -> Iterator[tuple[int, int, int]]:
    """Name, first and last token of the initialiser of the declarators that have a plain name and one."""
    tokens = file.tokens
    while i < len(tokens):
        named, at = tokens[i].kind == "IDENT", i + 1
        if file.is_op(i, "{", "["):  # a pattern
            at = file.partner.get(i, len(tokens)) + 1
        elif not named:
            return
        if file.is_op(at, ":", "!"):
            at = _type_end(file, at)
        last = at - 1
        if file.is_op(at, "=") and at + 1 < len(tokens):
            last = file.statement_end(at + 1)
            # a comma may stand between type arguments, as in `new Map<string, number>()`
            while file.is_op(last + 1, ",") and not _is_declarator(file, last + 2):
                last = file.statement_end(last + 2)
            if named:
                yield i, at + 1, last
        if not file.is_op(last + 1, ","):
            return
        i = last + 2


def _is_declarator(file: _File, i: int) -> bool:
    if file.is_op(i, "{", "["):
        return True
    return i < len(file.tokens) and file.tokens[i].kind == "IDENT" and (
        i + 1 == len(file.tokens) or file.is_op(i + 1, "=", ":", "!", ",", ";") or _ends_line(file.tokens[i], file.tokens[i + 1]))


def _type_end(file: _File, i: int) -> int:
    """Place of the token that ends the type annotation at i: `=`, a comma or what ends the statement."""
    angle = 0
    while i < len(file.tokens):
        t = file.tokens[i]
        if t.kind == "OP":
            if t.text in ("(", "[", "{"):
                i = file.partner.get(i, i)
            elif t.text in ("<", ">", ">>", ">>>"):
                angle += 1 if t.text == "<" else -len(t.text)
            elif t.text in ("=", ";", ")", "]", "}") or t.text == "," and angle <= 0:
                return i
            elif t.text == ">=" and angle > 0:  # `: Array<T>= x` written without a blank is not split
                return i
        i += 1
    return i


def _is_function(file: _File, first: int) -> bool:
    """Is the initialiser a function or an arrow, with type parameters or not?"""
    tokens = file.tokens
    if _text(tokens, first) == "async" and _text(tokens, first + 1) != "=>":
        first += 1
    if _text(tokens, first) == "function":
        return True
    if _text(tokens, first) == "<":
        angle, at = 0, first
        while at < len(tokens):
            if file.is_op(at, "<", ">", ">>", ">>>"):
                angle += 1 if tokens[at].text == "<" else -len(tokens[at].text)
                if angle <= 0:
                    break
            at += 1
        first = at + 1
    if not file.is_op(first, "("):
        return _text(tokens, first + 1) == "=>"
    end = file.partner.get(first, len(tokens)) + 1
    if _text(tokens, end) == ":":  # return type before the arrow
        while end < len(tokens) and _text(tokens, end) not in ("=>", ";", "="):
            end = file.partner.get(end, end) + 1 if file.is_op(end, "(", "[", "{") else end + 1
    return _text(tokens, end) == "=>"


def _mark_expressions(file: _File) -> None:
    """Operands of comparisons, and the texts of the expressions that rules look at."""
    tokens = file.tokens
    for i, t in enumerate(tokens):
        if t.kind == "OP" and t.text in ("===", "!==", "==", "!="):
            first = file.operand_before(i - 1) if i else None
            last = file.operand_after(i + 1)
            if first is not None:
                tokens[i - 1].chain = file.operand_text(first, i - 1)
                tokens[i - 1].before = _shown(tokens[first - 1]) if first else None
            if last is not None:
                tokens[i + 1].chain = file.operand_text(i + 1, last)
                tokens[i + 1].after = _shown(tokens[last + 1]) if last + 1 < len(tokens) else None
            if first is not None or last is not None:
                t.shown = file.shown(i if first is None else first, i if last is None else last)
        elif t.kind == "OP" and (t.text == "+" and i and tokens[i - 1].kind == "STRING" or
                                 t.text in ("=", "+=", "-=") and _text(tokens, i - 1) == "innerHTML"):
            first = file.operand_before(i - 1)
            last = file.operand_after(i + 1) if t.text == "+" else file.statement_end(i + 1)
            if first is not None and last is not None and last < len(tokens):
                t.shown = file.shown(first, last)
        elif t.kind == "IDENT" and t.text in ("eval", "Function"):
            at = i + 2 if file.is_op(i + 1, "?.") else i + 1
            first = file.operand_before(i)
            if file.is_op(at, "(") and first is not None:
                t.shown = file.shown(first, file.partner.get(at, at))


def _mark_import(tokens: list[Token], i: int) -> None:
    """`import names from 'module'` and `import 'module'`; not import(...)."""
    if _text(tokens, i + 1) in ("(", "."):
        return
    names = []
    for j in range(i + 1, len(tokens)):
        t = tokens[j]
        if t.kind == "STRING":
            if j == i + 1 or _text(tokens, j - 1) == "from":
                t.role = "import"
                for name in names:
                    name.role, name.owner = "import_name", t.text
            return
        if t.kind not in ("IDENT", "KEYWORD") and t.text not in ("{", "}", ",", "*"):
            return
        if t.kind == "IDENT" and t.brace > tokens[i].brace and _text(tokens, j - 1) != "as" and (
                t.text not in ("as", "type")):
            names.append(t)
