"""Connected components of a table of links: contracted within partitions first, then by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.frames import column
from codequarry.session import written

#: Links that one task contracts at a time, and at most so many are left to one task at the end (4 MB).
AT_ONCE = 1 << 18


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that the links touch, and the least node of its component: larger roots are hooked to lesser ones until no link joins two."""
    node, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while (apart := root[x] != root[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while ((up := root[root]) != root).any():
            root = up
    return node, node[root]


def _stars(batches: Iterator[pa.RecordBatch], whole: bool, most: int) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars, `most` links at a time; whole: all at once, and the roots themselves as well."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)

    def out() -> pa.RecordBatch:
        keep = slice(None) if whole else a != b
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    for batch in batches:
        a, b = (np.concatenate((x, column(batch, c).to_numpy())) for x, c in ((a, "a"), (b, "b")))
        if len(a) >= most and not whole:
            a, b = _contracted(a, b)
            if np.count_nonzero(a != b) > most // 2:  # contraction does not help enough: they go on as they are
                yield out()
                a, b = a[:0], b[:0]
            a, b = a[a != b], b[a != b]
    if len(a):
        a, b = _contracted(a, b)
        yield out()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: link every larger neighbour to the node's least one. Small: likewise the smaller ones and the node."""
    if large:
        both = links.union(links.select("b", "a"))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    return joined.select("b", "m").union(least.select(F.col("a").alias("b"), "m")).toDF("a", "b").filter("a <> b").distinct()


def components(links: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(node, root) for every node in links (a, b: bigint); root is the least node that links reach.

    Tasks contract the links they read to stars, so that less is shuffled. No more than `at_once` of what is left are finished by one task.
    More go through rounds, each written before the next begins, so the lineage stays short. Rounds grow with the logarithm of the longest
    path, and end as soon as every component is a star: no node has two neighbours below it, and none stands on both sides.
    A node with many links is a hot key of a join only, which adaptive execution splits; minima are partial aggregates.
    """
    edges = links.select("a", "b").filter("a <> b")
    edges = written(edges.mapInArrow(lambda batches: _stars(batches, False, max(at_once, 1)), "a bigint, b bigint"), "links")
    if edges.count() <= at_once:
        return edges.coalesce(1).mapInArrow(lambda batches: _stars(batches, True, at_once), "a bigint, b bigint").toDF("node", "root")
    while True:
        edges = written(_star(_star(edges, True), False), "links")
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("b", F.lit(0), F.lit(1)))
        found = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if found.filter("below + above > 1").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()
