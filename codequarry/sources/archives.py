"""ZIP archives as a table of entries."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv
from codequarry.schemas import ARCHIVE_ENTRIES


def read_archives(spark: SparkSession, root: str, max_zip_mb: int = fv.MAX_ZIP_MB) -> DataFrame:
    """Uploaded archives (archive, content), up to the size limit."""
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", "*.[zZ][iI][pP]").load(root))
    return raw.where(F.col("length") <= max_zip_mb * 1024 * 1024).select(
        F.col("path").alias("archive"), "content")


def entries(archives: DataFrame, with_content: bool = False) -> DataFrame:
    """One row per entry in archive order; a broken archive gives one row with an error.

    Archives are independent rows, so this is a map without a shuffle. `with_content` reads the
    bytes of entries that stay within the entry limit.
    """
    limit = fv.MAX_FILE_MB * 1024 * 1024

    def unpack(batches):
        for batch in batches:
            for name, data in zip(batch["archive"], batch["content"]):
                yield pd.DataFrame(list(_listing(name, data, with_content, limit)), columns=_COLUMNS)

    return archives.select("archive", "content").mapInPandas(unpack, ARCHIVE_ENTRIES)


_COLUMNS = [c.strip().split(" ")[0] for c in ARCHIVE_ENTRIES.split(",")]


def _listing(name: str, data: bytes, with_content: bool, limit: int):
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for number, info in enumerate(archive.infolist()):
                readable = with_content and not info.is_dir() and info.file_size <= limit
                yield (name, number, info.filename, info.is_dir(), info.file_size,
                       info.compress_size, info.external_attr,
                       archive.read(info) if readable else None, None)
    except (zipfile.BadZipFile, EOFError, OSError, NotImplementedError, RuntimeError, ValueError):
        yield (name, -1, None, False, None, None, None, None, fv.NOT_A_ZIP)
