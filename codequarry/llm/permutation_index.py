"""Approximate nearest neighbours by inner product, with a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by the order of its `prefix` nearest pivots by angle, and is
posted in the inverted files of the first of them: `posts` for a vector of mean norm, more for a longer and fewer for a shorter
one, since inner products favour long vectors. A query looks into the files of its first `probes` pivots. All entries that it finds there,
each once, are ranked together by the footrule distance of the two orders (weighed by the norm where norms differ), and the
first `rerank` of them are ranked anew by inner product.

Pivots grow with the root of the number of vectors, up to a bound, while probes, posts and rerank are fixed: the share of the vectors
that a query sees falls with the root of their number, and the share that is scored with their number.

Equal vectors are one entry with its `k + 1` least ids, so copies neither fill a file nor multiply pairs. A file is cut into blocks of about
`block` entries, as many as it needs, and its queries into blocks as well; every block of queries meets every block of entries.
Blocks send on only what can be among the first `rerank`: a bounded sample tells each query a rank that a quarter more entries
than that are expected to reach, and a margin. The exact cut follows over all of a query's entries together.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; nor do those whose
dimension is not the commonest one (of equally common ones the largest). Rows with a null id take no part. Repeated rows
(the same id twice) count once. Ties go to the smaller id. An empty table gives an empty table. In a table of at most
`least_pivots` different vectors every query sees all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.frames import column
from codequarry.session import written

#: Pairs of vectors that are multiplied together.
CHUNK = 1 << 15


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id and vec (array of double) of the rows that take part, and two hashes that stand for the vector."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & finite & F.exists(v, lambda x: x != 0))
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.transform(v, lambda x: x + 0.0).alias("vec"))
    return rows.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64("vec", F.lit(1))})


class Index:
    """Pivots, a sample for the ranks, and sizes; made on the driver from the bounded sample, used in tasks."""

    def __init__(self, pivots: np.ndarray, sample: np.ndarray, prefix: int, posts: int, probes: int, rerank: int, share: float):
        self.pivots, self.prefix = self.directed(pivots)[0], min(prefix, len(pivots))
        self.posts, self.probes, self.rerank = min(posts, self.prefix), min(probes, self.prefix), rerank
        self.steps = np.arange(self.prefix, dtype=np.int32 if self.prefix > 181 else np.int16)  # sums of 181 places fit 16 bits
        norms = self.directed(sample)[1]
        self.mean_norm = norms.max() + np.log(np.exp(norms - norms.max()).mean())
        orders, self.weights = self.orders(sample), self.weight(norms)
        self.sample = self.places(orders)
        self.equal = int(self.steps.sum())
        self.usual = max(self.equal + 1.0, float(np.mean([self.overlap(o, self.sample).mean() for o in orders[:64]])))
        self.nth = int(np.ceil(1.25 * share * len(sample))) + 8

    @staticmethod
    def directed(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors and the logarithms of the norms; no square leaves the range of a double."""
        scale = np.abs(vectors).max(axis=1)
        x = vectors / scale[:, None]
        norm = np.sqrt((x * x).sum(axis=1))
        return x / norm[:, None], np.log(scale) + np.log(norm)

    def orders(self, vectors: np.ndarray) -> np.ndarray:
        """Numbers of the nearest pivots, nearest first; of equally near ones the first."""
        return np.argsort(-(self.directed(vectors)[0] @ self.pivots.T), axis=1, kind="stable")[:, : self.prefix].astype(np.int16)

    def weight(self, log_norms: np.ndarray) -> np.ndarray:
        """Norms as multiples of the mean one."""
        return np.exp(np.clip(log_norms - self.mean_norm, -300, 300))

    def posted(self, weights: np.ndarray) -> np.ndarray:
        """In how many files vectors of these weights stand."""
        return np.clip(np.round(self.posts * weights), 1, self.prefix).astype(np.int16)

    def places(self, orders: np.ndarray) -> np.ndarray:
        """pivots x entries: where each entry has each pivot; `prefix` where it lacks it."""
        out = np.full((len(self.pivots), len(orders)), self.prefix, self.steps.dtype)
        out[orders.T, np.arange(len(orders))[None, :]] = self.steps[:, None]
        return out

    def overlap(self, order: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The footrule distance of a query's order from each entry, halved and up to a constant.

        |a - t| + a = 2 max(a, t) - t, and a pivot that only the entry has adds `prefix` less its place there.
        """
        return np.maximum(places[order], self.steps[:, None]).sum(axis=0, dtype=self.steps.dtype)

    def rank(self, overlap: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Falls with the footrule: 1 for equal orders, 0 for usual ones, times the norm."""
        return (self.usual - overlap) / (self.usual - self.equal) * weights

    def least(self, order: np.ndarray) -> float:
        """The rank that a query's entries must reach to be sent on."""
        ranks = self.rank(self.overlap(order, self.sample), self.weights)
        return -np.inf if self.nth >= len(ranks) else -np.partition(-ranks, self.nth)[self.nth]


def _matrix(arrays) -> np.ndarray:
    return np.array([np.asarray(a, np.float64) for a in arrays])


def _wide(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """The list column as a matrix."""
    values = batch.column(name).combine_chunks() if isinstance(batch, pa.Table) else column(batch, name)
    return np.asarray(values.flatten()).reshape(len(values), -1)


def _orders(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("ord").to_pylist()), np.int16).reshape(table.num_rows, -1)


def found_in_block(index: Index, file: int, asked: pa.Table, entries: pa.Table) -> pa.Table:
    """What a block's queries send on: the entries that no earlier file of the query holds, with their ranks."""
    places = index.places(_orders(entries))
    posts, weights = entries.column("n_files").to_numpy().astype(np.int16), entries.column("weight").to_numpy()
    k1, k2 = entries.column("k1").to_numpy(), entries.column("k2").to_numpy()
    asks = zip(_orders(asked), asked.column("least").to_numpy(), strict=True)
    picked, ranks = [], []
    for order, least in asks:
        before = order[: int(np.flatnonzero(order == file)[0])]
        rank = index.rank(index.overlap(order, places), weights)
        pick = np.flatnonzero(rank >= least)
        if len(before) and len(pick):
            pick = pick[~(places[np.ix_(before, pick)] < posts[pick]).any(axis=0)]
        if len(pick) > index.rerank:
            pick = pick[np.lexsort((k2[pick], k1[pick], -rank[pick]))[: index.rerank]]
        picked.append(pick)
        ranks.append(rank[pick])
    sizes = [len(p) for p in picked]
    at = np.concatenate(picked) if picked else np.zeros(0, np.int64)
    rank = np.concatenate(ranks) if ranks else np.zeros(0)
    q1, q2 = (np.repeat(asked.column(c).to_numpy(), sizes) for c in ("k1", "k2"))
    return pa.table({"q1": q1, "q2": q2, "k1": k1[at], "k2": k2[at], "rank": rank})


def scored_in_block(k: int, asked: pa.Table, entries: pa.Table) -> pa.Table:
    """Inner products of queries with their chosen entries; the first `k + 1` of each query here and what ties with the last."""
    vectors, queries = _wide(entries, "vec"), _wide(asked, "vec")
    chosen = asked.column("keys").combine_chunks()
    pairs = pd.DataFrame({"q": np.repeat(np.arange(len(chosen)), chosen.value_lengths().to_numpy())})
    for c, values in zip(("k1", "k2"), chosen.flatten().flatten(), strict=True):
        pairs[c] = values.to_numpy()
    known = pd.DataFrame({c: entries.column(c).to_numpy() for c in ("k1", "k2")})
    pairs = pairs.merge(known.assign(e=np.arange(len(known))), on=["k1", "k2"])
    q, e = pairs["q"].to_numpy(), pairs["e"].to_numpy()
    parts = [(vectors[e[a : a + CHUNK]] * queries[q[a : a + CHUNK]]).sum(axis=1) for a in range(0, len(e), CHUNK)]
    pairs["score"] = np.concatenate(parts) if parts else np.zeros(0)
    pairs = pairs[pairs.groupby("q")["score"].rank(method="min", ascending=False) <= k + 1]
    q = pairs["q"].to_numpy()
    return pa.table({"q1": asked.column("k1").to_numpy()[q], "q2": asked.column("k2").to_numpy()[q], "k1": pairs["k1"].to_numpy(),
                     "k2": pairs["k2"].to_numpy(), "score": pairs["score"].to_numpy()})


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, pivots_per_root: float = 3.0,
           least_pivots: int = 64, most_pivots: int = 2048, sample: int = 2048, prefix: int = 160, posts: int = 16, probes: int = 32,
           block: int = 2048, rerank: int = 1000, bucket: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a column over `id` that picks the queries from the rows themselves.

    `sample` vectors besides the pivots go to the driver; `bucket` entries are reranked together.
    """
    rows = usable(vectors, id_col, vector)
    dims = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"))
    top = dims.orderBy(F.desc("n"), F.desc("dim")).first()
    spark = vectors.sparkSession
    if top is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.filter(F.size("vec") == top["dim"])
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    few = rows.dropDuplicates(["id", "k1", "k2"]).withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    classes = written(few.groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids")), "ann-classes")
    n = classes.count()
    n_pivots = int(min(n, max(least_pivots, min(most_pivots, pivots_per_root * n**0.5))))
    drawn = _matrix(r["vec"] for r in classes.orderBy(F.xxhash64("k1", "k2"), "k1", "k2").select("vec").limit(n_pivots + sample).collect())
    wide = n_pivots if n <= least_pivots else posts
    index = spark.sparkContext.broadcast(
        Index(drawn[:n_pivots], drawn[n_pivots:] if n > n_pivots else drawn, prefix, wide, probes, rerank, rerank / n))

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            vec, own = _wide(batch, "vec"), index.value
            order, weights = own.orders(vec), own.weight(own.directed(vec)[1])
            n_files = own.posted(weights)
            yield pa.RecordBatch.from_pydict({
                "k1": column(batch, "k1"), "k2": column(batch, "k2"), "ord": pa.array([o.tobytes() for o in order], pa.binary()),
                "weight": weights, "n_files": n_files.astype(np.int32),
                "files": pa.array([o[:m].astype(np.int32) for o, m in zip(order, n_files, strict=True)], pa.list_(pa.int32()))})

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            own = index.value
            order = own.orders(_wide(batch, "vec"))
            yield pa.RecordBatch.from_pydict({
                "k1": column(batch, "k1"), "k2": column(batch, "k2"), "ord": pa.array([o.tobytes() for o in order], pa.binary()),
                "least": np.array([own.least(o) for o in order], np.float64),
                "files": pa.array(list(order[:, : own.probes].astype(np.int32)), pa.list_(pa.int32()))})

    entries = written(classes.select("k1", "k2", "vec").mapInArrow(
        posted, "k1 bigint, k2 bigint, ord binary, weight double, n_files int, files array<int>"), "ann-postings")
    wanted = rows.filter(is_query).select("id", "k1", "k2").distinct()
    asking = written(classes.join(wanted.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "vec"), "ann-asking")
    asked = written(asking.mapInArrow(probed, "k1 bigint, k2 bigint, ord binary, least double, files array<int>"), "ann-queries")

    def cut(lists: DataFrame, name: str) -> DataFrame:
        """Into how many blocks each file falls: at most `most_pivots` rows."""
        sizes = lists.select(F.explode("files").alias("file")).groupBy("file").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
        return F.broadcast(written(sizes, f"ann-{name}"))

    blocks, crowds = cut(entries, "blocks"), cut(asked, "crowds")
    entries = entries.withColumn("file", F.explode("files")).join(blocks, "file").withColumn("part", F.pmod("k1", F.col("blocks")).cast("int"))
    entries = entries.join(crowds, "file").withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)))
    asked = asked.withColumn("file", F.explode("files")).join(crowds, "file").withColumn("crowd", F.pmod("k1", F.col("crowds")).cast("int"))
    asked = asked.join(blocks, "file").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def look(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return found_in_block(index.value, key[0].as_py(), left, right)

    place = ["file", "part", "crowd"]
    found = asked.select(*place, "k1", "k2", "ord", "least").groupBy(*place).cogroup(
        entries.select(*place, "k1", "k2", "ord", "weight", "n_files").groupBy(*place)).applyInArrow(
        look, "q1 bigint, q2 bigint, k1 bigint, k2 bigint, rank double")
    first = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("rank"), "k1", "k2"))
    chosen = found.withColumn("nth", first).filter(F.col("nth") <= rerank)

    buckets = -(-n // bucket)
    chosen = chosen.withColumn("bucket", F.pmod("k1", F.lit(buckets)).cast("int")).groupBy("q1", "q2", "bucket").agg(
        F.collect_list(F.struct("k1", "k2")).alias("keys"))
    chosen = chosen.join(asking, (F.col("q1") == asking["k1"]) & (F.col("q2") == asking["k2"])).select("bucket", "k1", "k2", "vec", "keys")
    stored = classes.select(F.pmod("k1", F.lit(buckets)).cast("int").alias("bucket"), "k1", "k2", "vec")

    def rescore(left: pa.Table, right: pa.Table) -> pa.Table:
        return scored_in_block(k, left, right)

    near = chosen.groupBy("bucket").cogroup(stored.groupBy("bucket")).applyInArrow(
        rescore, "q1 bigint, q2 bigint, k1 bigint, k2 bigint, score double")
    by_class = Window.partitionBy("q1", "q2").orderBy(F.desc("score"))
    near = near.withColumn("r", F.rank().over(by_class)).filter(F.col("r") <= k + 1)
    ids = near.join(classes.select("k1", "k2", F.explode("ids").alias("vec_id")), ["k1", "k2"])
    first = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id"))
    ids = ids.withColumn("r", first).filter(F.col("r") <= k + 1).select("q1", "q2", "vec_id", "score")
    out = wanted.join(ids, (wanted["k1"] == ids["q1"]) & (wanted["k2"] == ids["q2"])).filter("vec_id <> id")
    nearest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", nearest).filter(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
