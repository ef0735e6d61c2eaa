"""Repository profile: languages, lines, manifests, frameworks, top directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv
from codequarry.functions import text as t
from codequarry.functions.rows import exploded
from codequarry.sources.corpus import scan

__all__ = ["scan", "with_language", "with_loc", "language_profile", "manifests", "npm_frameworks",
           "python_frameworks", "frameworks", "top_level_dirs", "repo_profile"]

_PACKAGE = "dependencies MAP<STRING, STRING>, devDependencies MAP<STRING, STRING>"


def with_language(files: DataFrame) -> DataFrame:
    ext = t.suffix(t.base_name(F.col("path")))
    codes = {e: language for e, (language, _) in fv.LANGUAGES.items()}
    labels = dict(fv.LANGUAGES.values())
    return (
        files.withColumn("language", t.lookup(ext, codes, "other"))
        .withColumn("label", t.lookup(F.col("language"), labels, "Other"))
        .withColumn("supported", F.col("language").isin(*fv.SUPPORTED_LANGUAGES))
    )


def with_loc(files: DataFrame) -> DataFrame:
    return files.withColumn("loc", t.line_count(F.col("content")))


def language_profile(files: DataFrame) -> DataFrame:
    """Files and lines per repository and language."""
    known = with_loc(with_language(scan(files)))
    return known.groupBy("repo_id", "language", "label", "supported").agg(
        F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"))


def manifests(files: DataFrame) -> DataFrame:
    kind = t.lookup(t.base_name(F.col("path")), fv.MANIFESTS, None)
    return scan(files).select("repo_id", "file_id", "path", kind.alias("kind")).where(
        "kind IS NOT NULL")


def _marked(hits) -> Column:
    """Labels of all framework markers for which a test holds; no join is needed."""
    markers = F.array(*[F.struct(F.lit(m).alias("marker"), F.lit(label).alias("label"))
                        for m, label in fv.FRAMEWORKS.items()])
    return F.transform(F.filter(markers, lambda m: hits(m["marker"])), lambda m: m["label"])


def npm_frameworks(files: DataFrame) -> DataFrame:
    """Frameworks among the dependencies of a package.json in the repository's root."""
    data = F.from_json("content", _PACKAGE)
    names = F.flatten(F.array(
        F.coalesce(F.map_keys(data["dependencies"]), F.array().cast("array<string>")),
        F.coalesce(F.map_keys(data["devDependencies"]), F.array().cast("array<string>"))))
    found = scan(files).where(F.col("path") == "package.json").select(
        "repo_id", names.alias("names"))
    labels = _marked(lambda m: F.exists("names", lambda n: F.contains(F.lower(n), m)))
    return exploded(found, ["repo_id"], labels, "framework").distinct()


def python_frameworks(files: DataFrame) -> DataFrame:
    """Frameworks that a Python text imports."""
    found = scan(files).where(t.suffix(t.base_name(F.col("path"))) == ".py").select(
        "repo_id", F.col("content").alias("text"))
    labels = _marked(lambda m: F.contains("text", F.concat(F.lit("import "), m))
                     | F.contains("text", F.concat(F.lit("from "), m)))
    return exploded(found, ["repo_id"], labels, "framework").distinct()


def frameworks(files: DataFrame) -> DataFrame:
    return npm_frameworks(files).unionByName(python_frameworks(files)).distinct()


def top_level_dirs(files: DataFrame) -> DataFrame:
    """Visible first-level directories. A file scan does not see empty directories."""
    first = F.element_at(t.parts(F.col("path")), 1)
    return (
        files.where(F.contains("path", F.lit("/"))).select("repo_id", first.alias("directory"))
        .where(~F.col("directory").isin(*fv.IGNORED_NAMES) & ~F.startswith("directory", F.lit(".")))
        .distinct()
    )


def _holds(marker: str):
    return lambda name: F.contains(F.lower(name), F.lit(marker))


def _file_facts(files: DataFrame) -> DataFrame:
    """What one file tells about its repository, in one pass over the text; a file outside the scan tells its directory only."""
    path, text, in_scan = F.col("path"), F.col("content"), ~t.ignored(F.col("path"))
    name, first = t.base_name(path), F.element_at(t.parts(path), 1)
    known = with_language(files.select("repo_id", "path", "content"))
    data = F.from_json("content", _PACKAGE)
    packages = F.concat(*[F.coalesce(F.map_keys(data[n]), F.array().cast("array<string>"))
                          for n in ("dependencies", "devDependencies")])
    known = known.withColumn("packages", F.when(in_scan & (path == "package.json"), packages))
    used = F.lit(0).cast("bigint")
    for i, marker in enumerate(fv.FRAMEWORKS):
        imported = F.contains(text, F.lit(f"import {marker}")) | F.contains(text, F.lit(f"from {marker}"))
        depended = F.exists("packages", _holds(marker))
        hit = F.when(t.suffix(name) == ".py", imported).otherwise(depended)
        used = used.bitwiseOR(F.when(in_scan & hit, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    shown = F.contains(path, F.lit("/")) & ~first.isin(*fv.IGNORED_NAMES) & ~F.startswith(first, F.lit("."))
    return known.select(
        "repo_id", *[F.when(in_scan, F.col(c)).alias(c) for c in ("language", "label", "supported")],
        F.when(in_scan, t.line_count(text)).alias("loc"),
        F.when(in_scan, t.lookup(name, fv.MANIFESTS, None)).alias("kind"),
        used.alias("used"), F.when(shown, first).alias("directory"))


def repo_profile(repos: DataFrame, files: DataFrame) -> DataFrame:
    """One row per repository: one scan of the files, counts per repository and language, and these counts per repository.

    Both steps combine before the shuffle, so a repository with most of the files sends one row per language and task.
    """
    by_language = _file_facts(files).groupBy("repo_id", "language", "label", "supported").agg(
        F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"), F.count("kind").alias("manifests"),
        F.collect_set("kind").alias("kinds"), F.bit_or("used").alias("used"),
        F.collect_set("directory").alias("directories"))
    known = F.col("language").isNotNull()
    language = F.struct("language", "label", "files", "loc", "supported")
    profile = by_language.groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.when(known, language))).alias("languages"),
        F.sum(F.when(known, F.col("files"))).alias("files"), F.sum("loc").alias("loc"),
        F.array_sort(F.collect_set(F.when(F.col("supported"), F.col("language")))).alias("supported_languages"),
        F.sum("manifests").alias("manifests"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("manifest_kinds"),
        F.bit_or("used").alias("used"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("directories")))).alias("top_level_dirs"))
    bits = F.array(*[F.struct(F.lit(1 << i).cast("bigint").alias("bit"), F.lit(label).alias("label"))
                     for i, label in enumerate(fv.FRAMEWORKS.values())])
    labels = F.transform(F.filter(bits, lambda b: F.col("used").bitwiseAND(b["bit"]) != 0), lambda b: b["label"])
    none = F.array().cast("array<string>")
    return repos.select("repo_id").join(
        profile.withColumn("frameworks", F.array_sort(F.array_distinct(labels))).withColumn(
            "languages", F.when(F.size("languages") > 0, F.col("languages"))), "repo_id", "left").select(
        "repo_id", "languages",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("files", "loc")],
        F.coalesce("supported_languages", none).alias("supported_languages"),
        F.coalesce("manifests", F.lit(0).cast("bigint")).alias("manifests"),
        *[F.coalesce(c, none).alias(c) for c in ("manifest_kinds", "frameworks", "top_level_dirs")])
