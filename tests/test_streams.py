"""Streaming jobs against the batch operators, after any split of the input into batches."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codequarry.operators import js_rules
from codequarry.session import scratch_path
from codequarry.sources import jstokens
from codequarry.streaming import streams

FILES = "repo_id string, file_id bigint, path string, content string, size bigint"


def test_scan_finds_in_scripts(spark):
    files = spark.createDataFrame(
        [("r", 1, "web/a.ts", "const x = eval(input);\n", 23), ("r", 2, "src/b.py", "eval(input())\n", 14)], FILES)
    found = {r["file"] for r in streams.scan(files).collect()}
    assert found == {"web/a.ts", "src/b.py"}


SOURCES = [
    ("r", "a.ts", "function alone() { return 1; }\nfunction later() { return 2; }"),
    ("r", "b.ts", "class Box {}\nconst pick = () => 1;\nexport default function main() {}"),
    ("s", "a.ts", "function alone() { return 1; }"),
    ("r", "c.ts", "later();\nnew Box();"),
    ("s", "d.ts", "import { alone } from './a';\nalone();\neval(x);"),
    ("r", "e.ts", "function alone() {}"),
    ("r", "f.py", "import os\n"),
]


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def scanned(spark, batches, schema=FILES):
    """(repo, file, type, line) that hold after each batch."""
    base = scratch_path(spark, "scan-test")
    after = []
    for batch in batches:
        land(spark, f"{base}/in", batch, schema)
        stream = streams.landed(spark, f"{base}/in", spark.createDataFrame([], schema).schema)
        for query in streams.scan_corpus(stream, f"{base}/out", f"{base}/checkpoint"):
            streams.run_to_end(query)
        now = streams.findings_now(spark, f"{base}/out")
        after.append(sorted((r["repo_id"], r["file"], r["type"], r["line"]) for r in now.collect()))
    return after


def rows(sources):
    return [(repo, i, path, text, len(text)) for i, (repo, path, text) in enumerate(sources)]


def test_names_across_batches(spark):
    files = rows(SOURCES)
    tokens = jstokens.js_tokens(spark.createDataFrame(files, FILES).where("path like '%.ts'"))
    unused = {(r["repo_id"], r["file"], r["type"], r["line"]) for r in js_rules.unused(tokens).collect()}
    assert unused == {("r", "a.ts", "UNUSED_FUNCTION", 1), ("r", "b.ts", "UNUSED_FUNCTION", 2), ("r", "e.ts", "UNUSED_FUNCTION", 1)}
    one = scanned(spark, [files])[-1]
    assert unused <= set(one) and ("s", "d.ts", "DANGEROUS_EVAL", 3) in one and ("r", "f.py", "UNUSED_IMPORT", 1) in one
    steps = scanned(spark, [files[:2], files[2:4], files[4:]])
    assert steps[-1] == one
    # what a later file uses was reported before, and is withdrawn
    assert ("r", "a.ts", "UNUSED_FUNCTION", 2) in steps[0] and ("r", "a.ts", "UNUSED_FUNCTION", 2) not in steps[1]
    assert ("s", "a.ts", "UNUSED_FUNCTION", 1) in steps[1] and ("s", "a.ts", "UNUSED_FUNCTION", 1) not in steps[2]
    mixed = files[::-1]
    assert scanned(spark, [mixed[:3], mixed[3:]])[-1] == one


def test_names_of_files_taken_back(spark):
    signed = FILES + ", sign int"
    first = [(*r, 1) for r in rows([("r", "a.ts", "function f() {}"), ("r", "b.ts", "f();"), ("r", "c.ts", "function g() {}")])]
    gone = [(*r[:-1], -1) for r in first[1:]]
    steps = scanned(spark, [first, gone], signed)
    assert steps == [[("r", "c.ts", "UNUSED_FUNCTION", 1)], [("r", "a.ts", "UNUSED_FUNCTION", 1)]]


FINDINGS = "run_id int, source string, type string, file string, line int, created_at timestamp, ord int"
START = datetime(2024, 5, 1)


def runs_of(found, delay):
    """The first of each run of a key, in the order of time."""
    last, out = {}, []
    for r in sorted(found, key=lambda r: (r[5], r[6])):
        if r[:5] not in last or r[5] - last[r[:5]] > delay:
            out.append(r)
        last[r[:5]] = r[5]
    return sorted(out, key=lambda r: r[6])


@pytest.mark.parametrize("seed", [1, 2])
def test_first_wins_in_five_batches(spark, seed):
    pick = random.Random(seed)
    found = []
    for i in range(600):
        at = START + timedelta(minutes=i * 5 + pick.choice([0, 1, 2]))
        key = pick.choice([(1, "a", "T", "f", 1), (1, "a", "T", None, None), (2, "a", "T", "f", None)]) if pick.random() < 0.5 else (3, "b", "U", f"g{pick.randrange(90)}", 7)
        found.append((*key, at, i))
    want = runs_of(found, timedelta(hours=1))
    assert len(want) > 20
    for cuts in ([600], sorted(pick.sample(range(1, 600), 4)) + [600]):
        base, low = scratch_path(spark, "first-test"), 0
        for cut in cuts:
            land(spark, f"{base}/in", found[low:cut], FINDINGS)
            stream = streams.landed(spark, f"{base}/in", spark.createDataFrame([], FINDINGS).schema)
            streams.run_to_end(streams.first_wins(stream, f"{base}/out", f"{base}/checkpoint", "1 hour", buckets=4))
            low = cut
        got = spark.read.parquet(f"{base}/out/findings").drop("batch_id").orderBy("ord").collect()
        assert [(*r[:5], r["created_at"].replace(tzinfo=None), r["ord"]) for r in got] == want
    # a batch reads neighbouring slots and its buckets, not the history
    plan = streams.read_seen(spark, f"{base}/out", 5, 6, [1], 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan and "bucket" in plan.split("PushedFilters")[1]
    last = spark.read.parquet(f"{base}/out/seen").agg(F.max("period")).first()[0]
    streams.forget(spark, f"{base}/out", last)
    assert [r[0] for r in spark.read.parquet(f"{base}/out/seen").select("period").distinct().collect()] == [last]


def test_first_wins_of_a_repeated_batch_and_null_times(spark):
    base = scratch_path(spark, "first-test")
    found = [(1, "a", "T", "f", 1, None, 3), (1, "a", "T", "f", 1, None, 2), (1, "a", "T", "f", 2, START, 1)]
    for checkpoint in ("one", "two"):  # a lost checkpoint repeats the batch with its number
        land(spark, f"{base}/in", found if checkpoint == "one" else found[:1], FINDINGS)
        stream = streams.landed(spark, f"{base}/in", spark.createDataFrame([], FINDINGS).schema)
        streams.run_to_end(streams.first_wins(stream, f"{base}/out", f"{base}/{checkpoint}-{uuid.uuid4().hex}", "1 hour"))
    assert sorted(r["ord"] for r in spark.read.parquet(f"{base}/out/findings").collect()) == [1, 2]


def test_a_batch_of_unsigned_files_is_tokenised_once(spark, monkeypatch):
    """Once for its rows; the other call is the counting query's own plan."""
    made, real = [], jstokens.js_tokens
    monkeypatch.setattr(streams.jstokens, "js_tokens", lambda files: made.append(files.isStreaming) or real(files))
    scanned(spark, [rows(SOURCES)])
    assert made.count(False) == 1
