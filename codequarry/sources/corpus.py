"""Corpus tables: one row per file of a repository."""

from __future__ import annotations

import os
import re
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv
from codequarry.functions import text as t
from codequarry.session import written


#: Bytes of files that one Arrow batch holds (a larger file is a batch of its own), and that one reading task gets.
BATCH_BYTES, TASK_BYTES = 8 << 20, 128 << 20
_LISTED = "path STRING, is_dir BOOLEAN, size BIGINT"
_READ = pa.schema([("path", pa.string()), ("size", pa.int64()), ("bytes", pa.binary())])


def open_root(root: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI, and the path in it; `file:/x` is a path as well."""
    return FileSystem.from_uri(root.removeprefix("file:") if re.match(r"file:/(?!/)", root) else root)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root) and size of every file, by a walk in breadth: one round of tasks a level, one row a folder.

    No name passes through the driver, and a repository of any size is listed by as many tasks as it has folders. The
    levels stay written, so a lost executor lists the folders of one task anew. A folder's own names are one task's
    stream. A missing root gives no file; a link to a folder is not followed, so no walk goes round.
    """
    slots = spark.sparkContext.defaultParallelism

    def listed(batches):
        fs, base = open_root(root)
        for batch in batches:
            for folder in batch["path"]:
                found = fs.get_file_info(FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=True))
                if isinstance(fs, LocalFileSystem):
                    found = [i for i in found if i.type != FileType.Directory or not os.path.islink(i.path)]
                for start in range(0, len(found), 10_000):
                    rows = [(f"{folder}/{i.base_name}" if folder else i.base_name, i.type == FileType.Directory, i.size or 0)
                            for i in found[start:start + 10_000] if i.type in (FileType.Directory, FileType.File)]
                    yield pd.DataFrame(rows, columns=["path", "is_dir", "size"]).astype({"is_dir": bool, "size": "int64"})

    folders, levels = spark.range(1).select(F.lit("").alias("path")), []
    while not levels or not folders.isEmpty():
        # an explicit number of partitions, since a short list of names would be coalesced into one task
        spread = folders.repartition(slots, "path") if levels else folders
        levels.append(written(spread.mapInPandas(listed, _LISTED), "tree-level"))
        folders = levels[-1].where("is_dir").select("path")
    return reduce(DataFrame.unionAll, levels).where("NOT is_dir").select("path", "size")


def read_tree(spark: SparkSession, root: str, max_file_mb: int | None = None) -> DataFrame:
    """Files below a root, whose first directory level names the repository; files beside the repositories are left out.

    Spark's own file sources skip names that begin with '_' or '.', and so would lose every
    __init__.py. The listed paths are spread by hash over tasks of about `TASK_BYTES`, and each task sends files on in
    batches of bounded bytes. A file above `max_file_mb` keeps its row, with null content.
    """
    names = list_tree(spark, root).where(F.contains("path", F.lit("/")))
    total = names.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files")).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-(total["bytes"] or 0) // TASK_BYTES), total["files"] // 10_000)
    limit = None if max_file_mb is None else max_file_mb * 1024 * 1024

    def read(batches):
        fs, base = open_root(root)
        for batch in batches:
            rows, held = [], 0
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if rows and held + size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _READ)
                    rows, held = [], 0
                data = None
                if limit is None or size <= limit:
                    with fs.open_input_stream(f"{base}/{path}") as stream:
                        data = stream.read()
                    held += size
                rows.append({"path": path, "size": size, "bytes": data})
            yield pa.RecordBatch.from_pylist(rows, _READ)
            rows = []

    loaded = names.repartition(int(tasks), "path").mapInArrow(read, "path STRING, size BIGINT, bytes BINARY")
    parts = loaded.select(F.substring_index("path", "/", 1).alias("repo_id"), F.expr("substr(path, instr(path, '/') + 1)").alias("path"),
                          "size", "bytes")
    return parts.select("repo_id", F.xxhash64("repo_id", "path").alias("file_id"), "path", "size",
                        t.decoded(F.col("bytes")).alias("content"))


def write_tree(files: DataFrame, root: str) -> None:
    """Write (repo_id, path, content) as files below a root; a null content is an empty file. A task that runs twice writes the same.

    A content goes from the Arrow batch into its file as the UTF-8 that it is there, without a copy as Python text.
    """
    def write(batches):
        fs, base = open_root(root)
        for batch in batches:
            for repo, path, content in zip(*(batch.column(c) for c in ("repo_id", "path", "content")), strict=True):
                place = f"{base}/{repo}/{path}"
                fs.create_dir(place.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(place) as stream:
                    stream.write(content.as_buffer() if content.is_valid else b"")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    files.select("repo_id", "path", "content").mapInArrow(write, "n BIGINT").agg(F.sum("n")).collect()


def from_archives(entries: DataFrame) -> DataFrame:
    """Files of accepted archive entries that were read with their content."""
    return entries.where(~F.col("is_dir") & F.col("content").isNotNull()).select(
        F.regexp_replace(t.base_name(F.col("archive")), r"(?i)\.zip$", "").alias("repo_id"),
        F.xxhash64("archive", "entry").alias("file_id"), F.col("entry").alias("path"),
        F.col("file_size").alias("size"), t.decoded(F.col("content")).alias("content"))


def scan(files: DataFrame) -> DataFrame:
    """Source files: without ignored directories and lock files."""
    return files.where(~t.ignored(F.col("path")))


def files_for(files: DataFrame, tool: str, suffixes) -> DataFrame:
    """The files one analyser looks at: its suffixes, outside its own ignored directories."""
    path = F.col("path")
    wanted = files.where(F.regexp_extract(t.base_name(path), r"(\.[^.]*)$", 1).isin(*suffixes))
    ignored = fv.IGNORED_BY_TOOL.get(tool)
    return scan(wanted) if ignored is None else wanted.where(~t.has_part(path, ignored))


def python_files(files: DataFrame) -> DataFrame:
    return scan(files).where(t.suffix(t.base_name(F.col("path"))).isin(".py", ".pyi"))


def script_files(files: DataFrame) -> DataFrame:
    """JavaScript and TypeScript files; the suffix is case-sensitive."""
    return files_for(files, "ts-morph", fv.JS_EXTENSIONS)
