"""Incremental forms of the batch operators, as Structured Streaming jobs.

Each job reads files as they land, runs to the end of what is there (AvailableNow) or forever, and
writes a table. Checkpoints and outputs live in folders that the caller names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codequarry.operators import findings as ops
from codequarry.operators import js_rules, py_rules, risk
from codequarry.session import written
from codequarry.sources import corpus, jstokens, pynodes

FINDING_KEY = list(ops.FINDING_KEY)
#: Slots of a delay's length in a period, the unit in which `first_wins` stores what it has seen.
SLOTS = 16


def landed(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet",
           files_per_batch: int | None = None) -> DataFrame:
    """A stream of the parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def append(stream: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a stream to parquet, exactly once."""
    writer = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
               once: bool = True) -> StreamingQuery:
    """Run a batch job on every micro-batch. A repeated batch replaces its own folder."""

    return _foreach(stream, lambda batch, _: work(batch), out, checkpoint, once)


def _foreach(stream: DataFrame, work, out: str, checkpoint: str, once: bool) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch, batch_id).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def scan(files: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """A micro-batch of new files to scored findings, as the work of `each_batch`.

    A file arrives whole, so rules that compare rows of one file see all of them. Its nodes or
    tokens are written once per batch and read by all rules. Unused names of scripts need the whole
    repository: see `script_names` and `unused_now`.
    """
    tokens = written(jstokens.js_tokens(corpus.script_files(files)), "tokens")
    return _scored(_found(files, tokens), stats)


def _found(files: DataFrame, tokens: DataFrame) -> DataFrame:
    scripts = js_rules.local_findings(tokens).unionByName(js_rules.high_complexity(tokens))
    nodes = written(pynodes.py_nodes(corpus.python_files(files), py_rules.NEEDED_KINDS), "nodes")
    return py_rules.py_findings(nodes).unionByName(scripts, allowMissingColumns=True)


def _scored(found: DataFrame, stats: DataFrame | None) -> DataFrame:
    found = ops.dedupe(found.withColumn("run_id", F.col("repo_id")))
    return risk.scored(found, F.lit(None).cast("double")) if stats is None else risk.score(
        found, stats)


def scan_corpus(stream: DataFrame, out: str, checkpoint: str, stats: DataFrame | None = None,
                once: bool = True) -> list[StreamingQuery]:
    """Scan files as they arrive, with the rule that needs all files of a repository.

    Two queries run side by side, each exactly once. The first writes the findings of each
    micro-batch (`out/findings`) and the script declarations in it (`out/declared`). The second
    keeps the counts of every name in the engine's state store and writes, after each micro-batch,
    the declared names whose counts the batch has changed (`out/names`). `findings_now` reads what
    holds after the last batch: a finding is withdrawn once a later file uses the name.

    Files may carry `sign`: a row with -1 takes back an earlier row with the same content, as far as
    names are concerned.
    """
    def work(batch: DataFrame, batch_id: int) -> None:
        tokens = written(jstokens.js_tokens(corpus.script_files(_added(batch))), "tokens")
        found = _scored(_found(_added(batch), tokens), stats)
        found.write.mode("overwrite").parquet(f"{out}/findings/batch_id={batch_id}")
        # the tokens are read again, not made again; only files with a sign are looked at by sign
        named = _signed_names(batch) if "sign" in batch.columns else js_rules.names(tokens).withColumn("sign", F.lit(1))
        js_rules.declarations(named).write.mode("overwrite").parquet(f"{out}/declared/batch_id={batch_id}")

    def changed(batch: DataFrame, batch_id: int) -> None:
        batch.where("declared > 0 OR used < 0").write.mode("overwrite").parquet(
            f"{out}/names/batch_id={batch_id}")

    counts = js_rules.name_counts(_signed_names(stream), F.col("sign"))
    queries = [stream.writeStream.foreachBatch(work),
               counts.writeStream.outputMode("update").foreachBatch(changed)]
    for i, writer in enumerate(queries):
        writer = writer.option("checkpointLocation", f"{checkpoint}/{i}")
        queries[i] = (writer.trigger(availableNow=True) if once else writer).start()
    return queries


def _added(files: DataFrame) -> DataFrame:
    return files.where("sign > 0") if "sign" in files.columns else files


def _signed_names(files: DataFrame) -> DataFrame:
    """Identifiers of the scripts among the files, with the sign of their file."""
    scripts = corpus.script_files(files)
    if "sign" not in files.columns:
        return js_rules.names(jstokens.js_tokens(scripts)).withColumn("sign", F.lit(1))
    both = [js_rules.names(jstokens.js_tokens(scripts.where(F.col("sign") == s))).withColumn(
        "sign", F.lit(s)) for s in (1, -1)]
    return both[0].unionByName(both[1])


def unused_now(spark: SparkSession, out: str) -> DataFrame:
    """Unused functions and classes after the last batch of `scan_corpus`.

    The log of names holds a row for a name and a batch that changed it; the last one counts.
    Declarations that were taken back cancel out.
    """
    counts = F.max_by(F.struct("declared", "used"), "batch_id")
    last = spark.read.parquet(f"{out}/names").groupBy("repo_id", "text").agg(counts.alias("last"))
    dead = last.where("last.declared > 0 AND last.used = 0").select("repo_id", "text")
    declared = spark.read.parquet(f"{out}/declared").groupBy(
        *js_rules.KEYS, "text", "line", "col", "pos", "role", "shown").agg(F.sum("sign").alias("times"))
    return js_rules.unused_findings(declared.where("times > 0").drop("times"), dead)


def findings_now(spark: SparkSession, out: str, stats: DataFrame | None = None) -> DataFrame:
    """All findings that hold after the last batch of `scan_corpus`."""
    stored = spark.read.parquet(f"{out}/findings").drop("batch_id")
    return stored.unionByName(_scored(unused_now(spark, out), stats), allowMissingColumns=True)


def score(stream: DataFrame, stats: DataFrame) -> DataFrame:
    """Stream-static join: findings as they arrive, against the file statistics table."""
    by_file = stats.select(F.col("run_id"), F.col("path").alias("file"),
                           F.col("complexity").alias("_complexity"))
    joined = stream.join(by_file, ["run_id", "file"], "left")
    return risk.scored(joined, F.col("_complexity")).drop("_complexity")


def dedupe(stream: DataFrame, delay: str = "1 hour", ts: str = "created_at") -> DataFrame:
    """One finding per key. State of a key is dropped once the watermark has passed it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(FINDING_KEY)


def first_wins(stream: DataFrame, out: str, checkpoint: str, delay: str = "1 hour",
               ts: str = "created_at", buckets: int = 64, once: bool = True) -> StreamingQuery:
    """First-wins dedupe whose memory ends with the delay.

    A key's rows that follow each other within the delay are one run. The first row by `ord` of the
    batch that opens a run is written (`out/findings`), rows of a run that an earlier batch has seen
    are not. A key that stays away for longer than the delay opens a new run.

    What was seen is a table of (key, slot, first and last time) with a slot of time as long as the delay
    (`out/seen`), partitioned by periods of SLOTS slots and by batch, and sorted by slot and a hash
    bucket of the key. A batch reads the periods of its own slots and their neighbours, and there the row groups of
    its slots and its keys' buckets, so its work does not grow with the history; `forget` removes periods that
    no batch will read. Nulls are equal in keys, and
    a null time counts as the epoch. A repeated batch sees the batches before it only, and replaces its own rows.
    """
    micros = stream.sparkSession.sql(
        f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + INTERVAL {delay})").first()[0]
    time = F.coalesce(F.unix_micros(F.col(ts)), F.lit(0))

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        row = F.struct("ord", *[c for c in batch.columns if c != "ord"])
        # one row a key and slot, by partial aggregation: a hot key costs a row a slot and task
        seen_now = written(batch.groupBy(*FINDING_KEY, F.floor(time / micros).alias("slot")).agg(
            F.min(time).alias("lo"), F.max(time).alias("hi"), F.min(row).alias("first")).withColumn(
            "bucket", F.pmod(F.xxhash64(*FINDING_KEY), F.lit(buckets)).cast("int")), "seen")
        span = seen_now.agg(F.min("slot"), F.max("slot"), F.collect_set("bucket")).first()
        opened = _runs(seen_now, micros)
        if batch_id and span[0] is not None:
            before = read_seen(spark, out, span[0] - 1, span[1] + 1, span[2], batch_id)
            same = [opened[k].eqNullSafe(before[k]) for k in FINDING_KEY]
            near = (before["hi"] >= opened["lo"] - micros) & (before["lo"] <= opened["hi"] + micros)
            opened = opened.join(before, [*same, near], "left_anti")
        opened.select("first.*").select(*batch.columns).write.mode("overwrite").parquet(
            f"{out}/findings/batch_id={batch_id}")
        (seen_now.select(*FINDING_KEY, "lo", "hi", "bucket", "slot", F.lit(batch_id).alias("batch_id"),
                         F.floor(F.col("slot") / SLOTS).alias("period"))
         .repartitionByRange("period", "slot", "bucket").sortWithinPartitions("period", "slot", "bucket")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("period", "batch_id").parquet(f"{out}/seen"))

    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _runs(seen: DataFrame, micros: int) -> DataFrame:
    """Runs of a batch: neighbouring slots of a key that are no further apart than the delay."""
    by_key = Window.partitionBy(*FINDING_KEY).orderBy("slot")
    gap = F.col("lo") - F.lag("hi").over(by_key)
    opens = F.when(gap <= micros, 0).otherwise(1)
    numbered = seen.withColumn("opens", opens).withColumn("run", F.sum("opens").over(by_key))
    return numbered.groupBy(*FINDING_KEY, "run").agg(
        F.min("first").alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def read_seen(spark: SparkSession, out: str, first_slot: int, last_slot: int, buckets: list[int],
              before_batch: int) -> DataFrame:
    """Keys that earlier batches have seen in these slots and buckets; other periods are not read."""
    return spark.read.parquet(f"{out}/seen").where(
        F.col("period").between(first_slot // SLOTS, last_slot // SLOTS) & F.col("slot").between(first_slot, last_slot) & F.col("bucket").isin(buckets)
        & (F.col("batch_id") < before_batch)).select(*FINDING_KEY, "lo", "hi")


def forget(spark: SparkSession, out: str, before_period: int) -> None:
    """Remove the periods of `first_wins` before the given one."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/seen")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if name.startswith("period=") and int(name.removeprefix("period=")) < before_period:
            fs.delete(folder.getPath(), True)


def hourly_counts(stream: DataFrame, delay: str = "1 hour", ts: str = "created_at") -> DataFrame:
    """Findings per hour and category; a window is written when the watermark has passed it, and
    rows that arrive later than that are dropped."""
    return (stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 hour"), "category")
            .agg(F.count(F.lit(1)).alias("findings")))
