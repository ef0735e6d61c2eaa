"""Grouping and joining that hold when one key owns a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000  # rows per key from which a key counts as hot
MAX_HOT_KEYS = 1_000  # bound of the broadcast list of hot keys
HOT_SLOTS = 64  # tasks that share one hot key


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in order.

    The rank filter is pushed below the shuffle (window group limit), so a task sends at most one
    row per key and a hot key costs its reducer one row per map task. A hash of the key leads the
    sort: its 64-bit prefix decides nearly all comparisons without looking at the strings.
    """
    w = Window.partitionBy("_key", *keys).orderBy(*order)
    return (df.withColumn("_key", F.xxhash64(*keys)).withColumn("_rn", F.row_number().over(w))
            .where("_rn = 1").drop("_rn", "_key"))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int,
                  slots: int = 16, rank: str | None = None) -> DataFrame:
    """The first k rows per key, in two rounds: k per (key, slot), then k per key.

    `order` names columns; a leading '-' means descending. The slot comes from a hash of the
    ordering columns, so the first round spreads a hot key over `slots` tasks and the second one
    sees at most slots * k rows of it. Nothing is lost: each of the first k rows of a key is among
    the first k rows of its slot.
    """
    names = [o.lstrip("-") for o in order]
    terms = [F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in order]
    inner = Window.partitionBy(*keys, "_slot").orderBy(*terms)
    outer = Window.partitionBy(*keys).orderBy(*terms)
    out = rank or "_rn"
    kept = (
        df.withColumn("_slot", F.pmod(F.xxhash64(*names), F.lit(slots)))
        .withColumn("_rn", F.row_number().over(inner)).where(F.col("_rn") <= k)
        .drop("_rn", "_slot")
        .withColumn(out, F.row_number().over(outer)).where(F.col(out) <= k)
    )
    return kept if rank else kept.drop(out)


def skew_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str,
              spread_by: Sequence[str], hot_rows: int = HOT_ROWS, slots: int = HOT_SLOTS,
              max_hot: int = MAX_HOT_KEYS, count_in: DataFrame | None = None) -> DataFrame:
    """Join a large side with a side that is unique per key, sharing each hot key among tasks.

    Keys with at least `hot_rows` rows are counted first (partial aggregation), and the largest
    `max_hot` of them are broadcast: a list of fixed size. Rows of a hot key get a slot from a
    hash of `spread_by`, and the one matching row is repeated per slot. Keys outside the list own
    at most 1/max_hot of the rows. With no hot key the plan is an ordinary join.

    Counting reads `big` once more, keys only. When `big` is the outcome of costly steps, give a
    stored table with at least its rows as `count_in`.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    hot = (
        (big if count_in is None else count_in).where(known)
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_rows)
        .orderBy(F.desc("_n"), *keys).limit(max_hot)
        .select(*keys, F.lit(slots).alias("_slots"))
    )
    # rows without a key match nothing; they are spread too, since an outer or anti join keeps them
    left = big.join(F.broadcast(hot), list(keys), "left").withColumn(
        "_slot",
        F.when(known & F.col("_slots").isNull(), F.lit(0).cast("bigint"))
        .otherwise(F.pmod(F.xxhash64(*spread_by), F.lit(slots))),
    ).drop("_slots")
    right = small.join(F.broadcast(hot), list(keys), "left").withColumn(
        "_slot",
        F.explode(F.sequence(F.lit(0).cast("bigint"),
                             (F.coalesce(F.col("_slots"), F.lit(1)) - 1).cast("bigint"))),
    ).drop("_slots")
    return left.join(right, [*keys, "_slot"], how).drop("_slot")
