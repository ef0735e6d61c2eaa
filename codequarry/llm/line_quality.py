"""Quality rules from cross-document line frequency, with DataFrame functions only.

Lines are normalised (words lower-cased, joined by one space) and hashed. A line of a host is boilerplate when it stands in two
documents of the host or more, and in more than `least_docs` of them or more than `share` percent of them: the count does not grow with
the host, and the share finds the lines of small hosts. Every row is a document, copies of one text too. Boilerplate lines are removed; a document is rejected when it fails the base rules, or when
fewer than `least_words` words or `least_left` percent of its words are left.

Defined cases: a null text has no words and fails the base rules; null ids and hosts are values like any other; repeated rows are
judged each, alike; an empty table gives an empty table; other columns are not looked at.
Windows are compared within one text by 64-bit hashes, lines by 96-bit ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.frames import fresh
from codequarry.session import written

_SPACES = r"[\x20\x09-\x0D]+"
_SPACE_CHARS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def repeated_words(words: Column, window: int) -> Column:
    """Words covered by windows that are found twice or more in the text, the first one included."""
    def windows(h):
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(F.slice(h, i + 1, window)))

    def covered(hashes):
        def same(pairs):
            def twin(e, k):
                near = [F.coalesce(F.get(pairs, k + d)["h"] == e["h"], F.lit(False)) for d in (-1, 1)]
                return near[0] | near[1]

            return F.sort_array(F.transform(F.filter(pairs, twin), lambda e: e["i"]))

        places = _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), same)
        total = F.aggregate(places, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")), lambda s, i: F.struct(
            (s["sum"] + i + window - F.greatest(i, s["end"])).alias("sum"), (i + window).alias("end")))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total["sum"]).otherwise(0)

    hashes = _let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) > window, _let(hashes, covered)).otherwise(0)


def _measured(docs: DataFrame, text: str, window: int) -> tuple[DataFrame, dict[str, str]]:
    """docs with base measures and an array of its lines' hashes and word counts; the names of the new columns."""
    wanted = ("row_no", "words", "lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    name = dict(zip(wanted, fresh(docs, *wanted), strict=True))
    body = F.coalesce(F.col(text), F.lit(""))
    words, lines = F.col(name["words"]), F.col(name["lines"])
    step = docs.withColumns({
        name["row_no"]: F.monotonically_increasing_id(), name["words"]: _words(body),
        name["lines"]: F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        name["word_chars"]: F.length(F.translate(body, _SPACE_CHARS, "")).cast("bigint"),
        name["n_symbols"]: (F.length(body) - F.length(F.translate(body, _SYMBOLS, ""))).cast("bigint"),
    })
    step = step.withColumns({
        name["n_words"]: F.size(words).cast("bigint"), name["n_repeat_words"]: repeated_words(words, window).cast("bigint"),
        name["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
    })
    return step.withColumn(name["lines"], F.transform(lines, _line)).drop(name["words"]), name


def _line(x: Column) -> Column:
    def fields(w):
        return F.struct(F.xxhash64(w).alias("h1"), F.hash(w).alias("h2"), F.size(w).alias("words"))

    return _let(_words(F.lower(x)), fields)


def _boilerplate(measured: DataFrame, name: dict[str, str], host: str, least_docs: int, share: int) -> tuple[DataFrame, DataFrame]:
    """All lines (a row each), and the boilerplate lines of every host."""
    row = name["row_no"]
    rows = measured.select(F.col(row).alias(row), F.col(host).alias("host"), F.col(name["lines"]).alias("all_lines"))
    lines = rows.select(row, "host", F.explode("all_lines").alias("line")).select(row, "host", "line.h1", "line.h2", "line.words")
    hosts = measured.groupBy(F.col(host).alias("of_host")).agg(F.count("*").alias("host_docs"))
    # once a document, then plain counts
    once = rows.select("host", F.explode(F.array_distinct("all_lines")).alias("line")).select("host", "line.h1", "line.h2")
    seen = once.groupBy("host", "h1", "h2").agg(F.count("*").alias("docs")).filter("docs > 1")
    often = (seen.join(hosts, seen["host"].eqNullSafe(hosts["of_host"]))
             .filter((F.col("docs") > least_docs) | (100 * F.col("docs") > share * F.col("host_docs")))
             .select(F.col("host").alias("b_host"), F.col("h1").alias("b_h1"), F.col("h2").alias("b_h2")))
    return lines, often


def _on_line(lines: DataFrame, often: DataFrame) -> Column:
    return (lines["h1"] == often["b_h1"]) & (lines["h2"] == often["b_h2"]) & lines["host"].eqNullSafe(often["b_host"])


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", window: int = 8, least_docs: int = 10,
          share: int = 10, least_words: int = 20, least_left: int = 30, most_repeated: int = 30) -> DataFrame:
    """One row a document: its measures, base_failed, n_removed_words and kept."""
    few = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(host).alias("host"))
    measured, name = _measured(few, "text", window)
    measured = written(measured.drop("text"), "line-measures")
    lines, often = _boilerplate(measured, name, "host", least_docs, share)
    removed = lines.join(often, _on_line(lines, often)).groupBy(F.col("row_no").alias("of_row")).agg(F.sum("words").alias("removed"))
    out = measured.join(removed, measured["row_no"] == removed["of_row"], "left").withColumn("removed", F.coalesce("removed", F.lit(0)))
    n, left = F.col("n_words"), F.col("n_words") - F.col("removed")
    failed = (n < least_words) | (100 * F.col("n_repeat_words") > most_repeated * n)
    depleted = (left < least_words) | (100 * left < least_left * n)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), F.col("removed").alias("n_removed_words"))


def clean(docs: DataFrame, text: str = "text", host: str = "source", window: int = 8, least_docs: int = 10, share: int = 10,
          least_words: int = 20, least_left: int = 30, most_repeated: int = 30) -> DataFrame:
    """The documents that are kept, all their columns, without boilerplate lines; a text without any is unchanged."""
    measured, name = _measured(docs, text, window)
    measured = written(measured, "line-texts", compression="zstd")
    lines, often = _boilerplate(measured, name, host, least_docs, share)
    row = name["row_no"]
    hits = lines.join(often, _on_line(lines, often)).groupBy(F.col(row).alias("of_row")).agg(
        F.collect_set(F.struct("h1", "h2")).alias("gone_lines"))
    out = measured.join(hits, measured[row] == hits["of_row"], "left")
    bare = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~_let(_line(x), lambda f: F.array_contains(
        F.col("gone_lines"), F.struct(f["h1"].alias("h1"), f["h2"].alias("h2"))))), "\n")
    text_left = F.when(F.col("gone_lines").isNull(), F.col(text)).otherwise(bare)
    left = F.size(_words(text_left))
    n = F.col(name["n_words"])
    kept = (n >= least_words) & (100 * F.col(name["n_repeat_words"]) <= most_repeated * n) & (left >= least_words) & (100 * left >= least_left * n)
    return out.withColumn(text, text_left).filter(kept).select(docs.columns)
