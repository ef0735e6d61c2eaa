"""Text and path expressions. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv

# Line ends that Python's str.splitlines knows.
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def decoded(content: Column) -> Column:
    """Bytes to text, dropping bytes that are not valid UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    )


def line_count(text: Column) -> Column:
    """Lines under universal newlines; the last line counts without a newline, '' has none."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    breaks = F.length(unix) - F.length(F.replace(unix, F.lit("\n"), F.lit("")))
    open_end = F.when((unix == "") | F.endswith(unix, F.lit("\n")), 0).otherwise(1)
    return (breaks + open_end).cast("int")


def parts(path: Column) -> Column:
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def suffix(name: Column) -> Column:
    """Lower-cased last extension; '' for dot files and for a trailing dot."""
    return F.regexp_extract(F.lower(name), r"(?s)^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+$", "$1")


def has_part(path: Column, names) -> Column:
    return F.arrays_overlap(parts(path), F.array(*[F.lit(n) for n in names]))


def ignored(path: Column) -> Column:
    return has_part(path, fv.IGNORED_NAMES) | base_name(path).isin(*fv.LOCK_FILES)


def below(path: Column, root: Column | str) -> Column:
    """Path relative to a root, when it lies below it."""
    root = F.lit(root) if isinstance(root, str) else root
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(
        F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))
    ).otherwise(path)


def lookup(key: Column, table: dict, default) -> Column:
    """A small fixed table as a CASE expression, so that no join is planned."""
    expr = F
    for name, value in table.items():
        expr = expr.when(key == name, F.lit(value))
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def words(items, unicode_words: bool = True) -> str:
    """Pattern for any of some words as a whole word, ignoring case."""
    body = "|".join(items)
    return rf"(?iU)\b({body})\b" if unicode_words else ascii_words(body)


def ascii_words(body: str) -> str:
    return rf"(?i)(?<![A-Za-z0-9_])({body})(?![A-Za-z0-9_])"


def source_lines(text: Column) -> Column:
    """Lines of a text as an array, without an empty last element."""
    lines = F.split(text, _LINE_END)
    return F.when(
        F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)
    ).otherwise(lines)


def snippet(lines: Column, line: Column, radius: int = 2) -> Column:
    """Numbered lines around one line."""
    first = F.greatest(F.lit(1), line - radius)
    wanted = F.least(F.size(lines), line + radius) - first + 1
    cut = F.slice(lines, first, F.greatest(F.lit(0), wanted))

    def numbered(text, i):
        number = (i + first).cast("string")
        return F.concat(F.lpad(number, F.greatest(F.lit(5), F.length(number)), F.lit(" ")),
                        F.lit(" | "), text)

    return F.array_join(F.transform(cut, numbered), "\n")


def repo_url(url: Column, host: Column | str = "github.com") -> Column:
    """STRUCT(owner, repo, reason) of a repository URL; reason is null for a good one."""
    host = F.lit(host) if isinstance(host, str) else host
    whole = r"(?i)^(https?)://([^/?#]*)([^?#]*)"
    clean = F.regexp_replace(F.trim(url), r"[\t\r\n]", "")
    authority = F.lower(F.regexp_extract(clean, whole, 2))
    path = F.regexp_replace(F.regexp_extract(clean, whole, 3), r";[^/]*$", "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    owner = F.get(segments, F.lit(0))
    repo = F.regexp_replace(F.get(segments, F.lit(1)), r"\.git$", "")
    reason = (
        F.when(~clean.rlike(whole) | (authority != F.lower(host)), F.lit(fv.URL_NOT_SUPPORTED))
        .when(F.size(segments) < 2, F.lit(fv.URL_TOO_SHORT))
        .when(~F.concat_ws("/", owner, repo).rlike(fv.OWNER_REPO_PATTERN), F.lit(fv.URL_BAD_NAME))
    )
    return F.struct(
        F.when(reason.isNull(), owner).alias("owner"),
        F.when(reason.isNull(), repo).alias("repo"),
        reason.alias("reason"),
    )


def display_name(owner: Column, repo: Column, filename: Column) -> Column:
    """Repository name from a URL's owner and repo, else from an uploaded file's name."""
    cleaned = F.left(F.regexp_replace(stem(base_name(filename)), fv.UNSAFE_NAME_PATTERN, "-"),
                     F.lit(80))
    return (
        F.when(owner.isNotNull(), F.concat(owner, F.lit("-"), repo))
        .when(F.coalesce(filename, F.lit("")) != "",
              F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("uploaded-project")))
        .otherwise(F.lit("repository"))
    )
