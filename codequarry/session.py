"""Session settings for own runs, and the shared scratch area for written intermediate tables."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "codequarry", cores: str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. Clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # recording the Python call site of every column costs more than building the plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names, never a machine-local one there."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/") + "/codequarry"
    if not conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    """For local masters without the setting, as in tests: a folder that goes when the process ends."""
    own = tempfile.TemporaryDirectory(prefix="codequarry-", ignore_cleanup_errors=True)
    atexit.register(own.cleanup)
    return own.name


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, compression: str = "snappy", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table that several branches read, and read it back.

    This cuts the lineage for good (a lost executor re-reads files instead of re-parsing sources)
    and lets every reader prune columns and push filters into the parquet scan. A reader that filters
    by a column of `partition_by` reads its own folders only.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression, partitionBy=list(partition_by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widened(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan that has fewer splits than there are task slots (small files only).

    A large corpus already has more splits than slots, and is left as it is: no shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, *keys) if df.rdd.getNumPartitions() < slots else df
