"""Substring dedup: remove the words of every window of n words that also starts anywhere else in the corpus.

Two passes. The first counts keys of windows in a count-min sketch, per partition, and merges the sketches. A window's key
is the least hash among its 8-word runs; a key is counted once for each place where such a run stands, so windows
share counters 14 to 1, and a key's count is never below the count of any of its windows. The second pass looks each window
up and groups exactly, by 96-bit fingerprints of the words, only windows estimated repeated. None is lost: equal
windows have equal keys at different places. A window that the sketch overestimates is found single by the grouping.

The grouping is done in two steps, so that long copies cost a row for some 14 windows. Neighbouring windows with one key make a
stretch; stretches with equal words stand in two places with all their windows. Then single windows are grouped: those of
stretches that occur once, and those of one stretch of each repeated kind, for others to be compared with.

Defined cases: a null text has no words and stays null; a text without a repeated window is returned unchanged; repeated rows
are repeated texts; null ids, extra columns and their names do not matter; an empty table gives an empty table.
Overlapping repeats inside one document count, as in `a a a ...`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import sketch
from codequarry.llm.frames import RowNumbers, column, extended, fresh, slices, text_buffers, with_columns
from codequarry.llm.words import Words, begins, hashed, runs, sliding, stretches
from codequarry.session import written

RUN = 8
#: Cells a sketch row. Two rows of bits are 32 MB in all; made for some 10 million keys (1 GB of text), looser above.
CELLS = 1 << 27


def _keys(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, their keys, and the hashes of all runs that are the key of a window around them."""
    h, run = words.h[0], min(RUN, window)
    if len(h) < window:
        return np.empty(0, np.int64), h[:0], h[:0]
    width = window - run + 1
    run_hash = runs(h, run)
    least = sliding(run_hash, width)
    valid = begins(words.bounds, window, len(h))[: len(least)]
    padded = np.zeros(len(run_hash) + width - 1, np.uint64)
    padded[width - 1 : width - 1 + len(least)][valid] = least[valid]
    chosen = (sliding(padded, width, np.maximum) == run_hash) & (run_hash > 0)
    starts = np.flatnonzero(valid)
    return starts, least[starts], run_hash[chosen]


def _batches(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        raw, offs = text_buffers(column(batch, text))
        for a, b in slices(offs):
            yield batch.slice(a, b - a), hashed(raw[offs[a] : offs[b]], offs[a : b + 1])


def estimated(docs: DataFrame, text: str, window: int, cells: int) -> np.ndarray:
    """First pass: the merged sketch over all windows of all texts."""
    def sketches(batches):
        return sketch.sketching((_keys(w, window)[2] for _, w in _batches(batches, text)), cells)

    return sketch.merged(docs.select(text).mapInArrow(sketches, sketch.PARTIAL), cells)


def _windows_of(w: Words, window: int, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers at which the windows of these stretches begin, and the stretch of each."""
    of = np.repeat(np.arange(len(start)), count)
    return start[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count), of


def remove_repeats(docs: DataFrame, text: str = "text", window: int = 35, cells: int = CELLS,
                   kept: str = "kept_words", n_words: str = "n_words", n_removed: str = "n_removed") -> DataFrame:
    """All columns and rows of docs, with `kept` (what is left, joined by one space), `n_words` and `n_removed`."""
    row, spots, hits = fresh(docs, "row_no", "stretches", "hit_starts")
    kept, n_words, n_removed = fresh(docs, kept, n_words, n_removed)
    shared = docs.sparkSession.sparkContext.broadcast(estimated(docs, text, window, cells))
    stretch = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("h1", pa.int64()), ("h2", pa.int32())])

    def candidates(batches):
        numbers = RowNumbers()
        for batch, w in _batches(batches, text):
            starts, keys, _ = _keys(w, window)
            value, back = np.unique(keys, return_inverse=True)
            often = sketch.repeated(value, shared.value, cells)[back]
            new = np.ones(len(starts), bool)
            new[1:] = (np.diff(starts) > 1) | (keys[1:] != keys[:-1])
            # a document's first window always begins a stretch
            new |= np.isin(starts, w.bounds)
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(starts)))[often[first]]
            start = starts[first[often[first]]]
            h1, h2 = (stretches(w.h[k], start, start + size + window - 1, k) for k in (0, 1))
            bounds = np.searchsorted(start, w.bounds)
            inside = (start - np.repeat(w.bounds[:-1], np.diff(bounds))).astype(np.int32)
            parts = pa.StructArray.from_arrays(
                [pa.array(inside), pa.array(size.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32))],
                fields=list(stretch))
            yield with_columns(batch, [row, spots], [pa.array(numbers.take(batch.num_rows)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), parts)])

    found = written(docs.mapInArrow(candidates, extended(docs, f"{row} bigint, {spots} array<struct<start: int, size: int, h1: bigint, h2: int>>")),
                    "substring-candidates", compression="zstd")
    shared.destroy()  # what it was needed for is written
    del shared  # the driver's Python keeps the value otherwise
    parts = found.filter(F.size(spots) > 0).select(row, F.explode(spots).alias("s")).select(row, "s.*")
    kinds = parts.groupBy("h1", "h2", "size").agg(F.count("*").alias("times"), F.min(F.struct(row, "start")).alias("one"))
    judged = parts.join(kinds, ["h1", "h2", "size"]).select(
        row, "start", "size", (F.col("times") > 1).alias("gone"),
        ((F.col("times") == 1) | (F.col("one") == F.struct(row, "start"))).alias("compare"))
    judged = judged.groupBy(row).agg(F.collect_list(F.struct("start", "size", "gone", "compare")).alias(spots))
    touched = written(found.filter(F.size(spots) > 0).drop(spots).join(judged, row), "substring-touched", compression="zstd")

    def compared(batches):
        for batch, w in _batches(batches, text):
            mine = column(batch, spots)
            part, owner = mine.flatten(), np.repeat(np.arange(len(mine)), mine.value_lengths().to_numpy())
            use = part.field("compare").to_numpy(zero_copy_only=False)
            start = part.field("start").to_numpy()[use] + w.bounds[owner[use]]
            places, of = _windows_of(w, window, start, part.field("size").to_numpy()[use])
            h1, h2 = (stretches(w.h[k], places, places + window, k) for k in (0, 1))
            doc = owner[use][of]
            yield pa.RecordBatch.from_arrays(
                [column(batch, row).take(pa.array(doc)), pa.array((places - w.bounds[doc]).astype(np.int32)), pa.array(h1.view(np.int64)),
                 pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32))], [row, "start", "h1", "h2"])

    windows = touched.select(row, text, spots).mapInArrow(compared, f"{row} bigint, start int, h1 bigint, h2 int")
    repeated = windows.groupBy("h1", "h2").agg(F.count("*").alias("times")).filter("times > 1").drop("times")
    starts = windows.join(repeated, ["h1", "h2"]).groupBy(row).agg(F.collect_list("start").alias(hits))
    changed = touched.join(starts, row, "left").drop(row)
    clean = (found.filter(F.size(spots) == 0).drop(spots, row)
             .withColumn(spots, F.lit(None).cast(changed.schema[spots].dataType)).withColumn(hits, F.lit(None).cast("array<int>")))

    def cut(batches):
        for batch in batches:
            out = [_left(t, s, h, window) for t, s, h in zip(*[column(batch, c) for c in (text, spots, hits)], strict=True)]
            yield with_columns(batch, [kept, n_words, n_removed],
                               [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                               drop=(spots, hits))

    return changed.unionByName(clean).mapInArrow(
        cut, extended(docs, f"{kept} string, {n_words} bigint, {n_removed} bigint"))


def _left(text: pa.Scalar, spots: pa.Scalar, hits: pa.Scalar, window: int) -> tuple[str, int, int]:
    """The words that no repeated window covers, how many words there are, and how many are covered."""
    words = (text.as_py() or "").encode().split()  # bytes split at space and \t..\r only
    if not spots.is_valid:
        return b" ".join(words).decode(), len(words), 0
    gone = spots.values.filter(spots.values.field("gone"))
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, gone.field("start").to_numpy(), 1)
    np.add.at(change, gone.field("start").to_numpy() + gone.field("size").to_numpy() + window - 1, -1)
    if hits.is_valid:
        np.add.at(change, hits.values.to_numpy(), 1)
        np.add.at(change, hits.values.to_numpy() + window, -1)
    keep = np.cumsum(change[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep)]).decode(), len(words), int(len(words) - keep.sum())


def stage(docs: DataFrame, window: int = 35) -> DataFrame:
    """Documents without their repeated passages: text and n_chars change where words went, all else stays."""
    kept, n_words, n_removed = fresh(docs, "kept_words", "n_words", "n_removed")
    out = remove_repeats(docs, window=window, kept=kept, n_words=n_words, n_removed=n_removed)
    gone = F.col(n_removed) > 0
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(gone, F.length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.when(gone, F.col(kept)).otherwise(F.col("text"))).select(docs.columns)


def brute_force(rows: list[tuple[int, str | None]], window: int = 35) -> pd.DataFrame:
    """The same rows by comparing words, for tests on small tables."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    count: dict[tuple, int] = {}
    for _, w in words:
        for s in range(len(w) - window + 1):
            count[tuple(w[s : s + window])] = count.get(tuple(w[s : s + window]), 0) + 1
    out = []
    for i, w in words:
        gone = {s + k for s in range(len(w) - window + 1) if count[tuple(w[s : s + window])] > 1 for k in range(window)}
        out.append((i, len(w), len(gone), b" ".join(x for s, x in enumerate(w) if s not in gone).decode()))
    return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"])
