"""N-gram Jaccard join: all links between texts whose shingle sets have a Jaccard similarity of at least p percent.

Multiple-global-order filtering. If two sets of n and m shingles are similar enough, then in any global order of shingles
their first n - ceil(p n) + 1 and m - ceil(p m) + 1 ones share a shingle. Three orders are used. All begin with shingles that a
count-min sketch of the whole corpus knows to occur once. Order one goes on by the counts of a load sketch, rare shingles first;
orders two and three go by coarse classes of these counts, and shuffle those of a class by a hash of their own. Order one is an
inverted file that proposes pairs; a pair must share a prefix shingle under orders two and three as well before its sets are
compared. Size and position bounds apply to the pairs of order one, and the parities of a set's shingles in PARITIES slots bound a pair's difference.

Stages:
1. Both sketches, of fixed size, in one pass. Only prefix shingles that may occur twice are posted: few texts have any.
2. Equal sets are one class; only a class's first row is posted.
3. Star rounds: in each posting list, rows are paired with at most PIVOTS pivots of other components, linear in the list.
   Verified links are contracted to components, as long as that saves many pairs. What the stars leave unconnected is paired
   exhaustively, across components only. So no link between components is lost, and copies are not expanded into all pairs.
   This gives the components, which `link` and the pipeline return. `links` returns all links, from a pass over all pairs of each list
   in blocks of BLOCK rows, inside components too. Its work grows as its result does, with the square of a group.
4. Sets are read again only for rows that are posted (a Bloom filter of fixed size picks them from the texts).

Defined cases: words are runs of other characters than space and \\t..\\r, A-Z lower-cased. A text with fewer than n words has its
whole sequence as one shingle; one without words or null has an empty set and links with nothing. Null ids take part and
never become a component's id. Repeated rows are copies. Extra columns do not matter; an empty table gives an empty table.
Shingles are 64-bit fingerprints, sets 128-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm import sketch
from codequarry.llm.frames import RowNumbers, column, fresh, lists, slices, text_buffers
from codequarry.llm.graph import components
from codequarry.llm.words import hashed, mix, runs
from codequarry.session import written

#: Cells of the load sketch (8 MB when merged, 2 MB as orders) and of the Bloom filter (8 MB).
LOAD_CELLS, BLOOM_CELLS = 1 << 20, 1 << 26
#: Cells of the count-min sketch: about CELLS_A_WORD a word of the corpus, but no fewer and no more than these (64 MB of bits at most). Beyond some
#: 10**8 words more single shingles look repeated; then prefixes hold more shared ones, and more is posted.
CELLS_A_WORD, LEAST_CELLS, MOST_CELLS = 6, 1 << 22, 1 << 29
#: Random orders that choose pivots, and pivots of a posting list in a star round. Star rounds end when the pairs left across components are LINEAR times all postings
#: or fewer, or when a round left more than the share STEADY of them; there is none if the pairs are no more than the postings.
ORDERS, PIVOTS, LINEAR, STEADY = 4, 16, 8, 0.75
#: Slots of the parities of a set, a multiple of 64.
PARITIES = 256
#: Rows of a block of a posting list in the pass over all pairs.
BLOCK = 256
_U = np.uint64


def _sets(batches: Iterator[pa.RecordBatch], text: str, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The sorted distinct shingles of each row."""
    for batch in batches:
        raw, offs = text_buffers(column(batch, text))
        for a, b in slices(offs):
            w = hashed(raw[offs[a] : offs[b]], offs[a : b + 1], fold=True)
            all_runs, out = runs(w.h[0], n), []
            for s, e in zip(w.bounds[:-1], w.bounds[1:], strict=True):
                if e - s >= n:
                    out.append(np.unique(all_runs[s : e - n + 1]))
                else:
                    out.append(runs(w.h[0][s:e], e - s) + _U(e - s) if e > s else w.h[0][:0])
            yield batch.slice(a, b - a), out


class Orders:
    """Three global orders of shingles: single ones, then by load (coarser for orders two and three), then by a hash of the order's own."""

    def __init__(self, load: np.ndarray, twice: np.ndarray, percent: int):
        self.cells = twice.shape[1] * 8
        above = ((load - load.mean()) / max(1.0, float(load.mean()) ** 0.5)).astype(np.float32)  # in standard deviations of a cell of rare shingles
        fine, coarse = (np.clip(x, 0, 127).astype(np.uint8) for x in (4 * above + 20, above / 2))
        self.twice = twice
        self.klass, self.percent = {1: fine, 2: coarse, 3: coarse}, percent

    def often(self, shingles: np.ndarray) -> np.ndarray:
        return sketch.repeated(shingles, self.twice, self.cells)

    def prefix(self, shingles: np.ndarray, order: int) -> np.ndarray:
        n = len(shingles)
        if not n:
            return shingles
        size = n - -(-self.percent * n // 100) + 1
        rank = (self.klass[order][(shingles & _U(LOAD_CELLS - 1)).astype(np.int64)].astype(np.uint64) << _U(56)) | (self.often(shingles).astype(np.uint64) << _U(63)) | (mix(shingles + _U(order)) >> _U(8))
        if size < n:
            first = np.argpartition(rank, size - 1)[:size]
            # equal ranks at the edge: take all of them, in every set
            first = np.flatnonzero(rank <= rank[first].max())
        else:
            first = np.arange(n)
        return shingles[first[np.argsort(rank[first], kind="stable")]]


def _orders(docs: DataFrame, text: str, n: int, percent: int) -> Orders:
    """Both sketches over all shingles of all texts, made per partition and merged block by block."""
    blocks, width = 16, LOAD_CELLS // 16
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("bigint")), F.lit(0))).first()[0]
    wanted = CELLS_A_WORD * size // 6  # a word and the blank after it take some six bytes
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << max(0, int(wanted) - 1).bit_length()))

    def count(batches):
        total = np.zeros(LOAD_CELLS, np.int64)

        def seen():
            for _, sets in _sets(batches, text, n):
                keys = np.concatenate([*sets, np.empty(0, _U)])
                cell, times = np.unique((keys & _U(LOAD_CELLS - 1)).astype(np.uint32), return_counts=True)
                total[cell] += times
                yield keys

        yield from sketch.sketching(seen(), cells, rows=1)
        least = total.astype(np.min_scalar_type(int(total.max())))  # the narrowest type that holds the counts travels
        rows = [(-1, i, least[i * width : (i + 1) * width].tobytes(), b"") for i in range(blocks)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), sketch.PARTIAL_ARROW, strict=True)], schema=sketch.PARTIAL_ARROW)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        if group["sketch_row"].iloc[0] >= 0:
            return sketch.merge_block(group)
        total = np.zeros(width, np.int64)
        for c in group["once"]:
            total += np.frombuffer(c, f"u{len(c) // width}").astype(np.int64)
        return pd.DataFrame({"sketch_row": [-1], "block": group["block"][:1], "bits": [total.tobytes()]})

    load, twice = np.zeros(LOAD_CELLS, np.int64), np.zeros((1, cells // 8), np.uint8)
    parts = docs.select(text).mapInArrow(count, sketch.PARTIAL)
    for r in sketch.few_at_a_time(parts.groupBy("sketch_row", "block").applyInPandas(merge, sketch.MERGED)):
        if r["sketch_row"] < 0:
            load[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["bits"], np.int64)
        else:
            sketch.put(twice, r)
    return Orders(load, twice, percent)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    size = _U(len(shingles))
    return tuple(int((mix(shingles + _U(k)).sum(dtype=np.uint64) + size).astype(np.int64)) for k in (11, 12))


def _parities(shingles: np.ndarray) -> np.ndarray:
    """The parity of a set's shingles in each of PARITIES slots, as 64-bit words. Those of two sets differ in no more slots than the sets in shingles."""
    slot = (mix(shingles + _U(31)) & _U(PARITIES - 1)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=PARITIES) & 1).astype(np.uint8)).view(np.int64)


def _bloom_places(keys: np.ndarray) -> np.ndarray:
    return np.stack([(mix(keys + _U(k)) & _U(BLOOM_CELLS - 1)).astype(np.int64) for k in (21, 22, 23)])


def _bloom_key(d1: np.ndarray, id_mark: np.ndarray) -> np.ndarray:
    return mix(d1.view(np.uint64)) + id_mark.view(np.uint64)


def _bloom(rows: DataFrame) -> np.ndarray:
    """Bits of the keys of rows (d1, id_mark): places by partition, distinct; only as many as the filter has cells can reach the driver."""
    def places(batches):
        for batch in batches:
            at = np.unique(_bloom_places(_bloom_key(*[column(batch, c).to_numpy().astype(np.int64) for c in ("d1", "id_mark")])))
            block = at >> 20
            edges = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(at)])) if len(at) else [0]
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([int(block[a]) for a in edges[:-1]], pa.int32()),
                "places": pa.array([(at[a:b] & 0xFFFFF).astype(np.uint32).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << 20, bool)
        for p in group["places"]:
            on[np.frombuffer(p, np.uint32)] = True
        return pd.DataFrame({"block": group["block"][:1], "bits": [np.packbits(on, bitorder="little").tobytes()]})

    bits = np.zeros(BLOOM_CELLS // 8, np.uint8)
    for r in sketch.few_at_a_time(rows.mapInArrow(places, "block int, places binary").groupBy("block").applyInPandas(merge, "block int, bits binary")):
        bits[r["block"] << 17 : (r["block"] + 1) << 17] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _bounded(x: str, y: str, percent: int):
    """Size and position bounds of a pair for a shared prefix shingle, in whole numbers."""
    nx, ny, px, py = (F.col(c) for c in (f"n_{x}", f"n_{y}", f"pos_{x}", f"pos_{y}"))
    rest = F.least(nx - px, ny - py)  # shingles from the shared one on
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & ((100 + percent) * rest >= percent * (nx + ny))


def _close(x: str, y: str, percent: int):
    """A bound on the shingles that only one of a pair has, from the parities of both sets, in whole numbers."""
    apart = sum((F.bit_count(F.col(f"bits_{x}")[k].bitwiseXOR(F.col(f"bits_{y}")[k])) for k in range(PARITIES // 64)), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (F.col(f"n_{x}") + F.col(f"n_{y}"))


def _all_pairs(postings: DataFrame) -> DataFrame:
    """All pairs of the rows of each list: row, n, pos of both. A list is cut into blocks, and a task's key is a pair of blocks."""
    blocks = postings.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cut = postings.join(blocks, "token").withColumn("mine", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = cut.select("token", F.col("mine").alias("i"), other.alias("j"), *[F.col(c).alias(f"{c}_x") for c in ("row", "n", "pos")])
    right = cut.select("token", other.alias("i"), F.col("mine").alias("j"), *[F.col(c).alias(f"{c}_y") for c in ("row", "n", "pos")])
    return left.join(right, ["token", "i", "j"]).filter("row_x < row_y")


def _joined(docs: DataFrame, id_col: str, text: str, n: int, percent: int, all_links: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The documents (id, n_shingles, d1, d2), their classes (d1, d2, id, row, component_id), and all links of classes (rows a, b) if asked for."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    context = docs.sparkSession.sparkContext
    orders = context.broadcast(_orders(docs, "text", n, percent))

    def posted(batches):
        numbers = RowNumbers()
        for batch, sets in _sets(batches, "text", n):
            first = [orders.value.prefix(s, 1) for s in sets]
            size = np.array([len(p) for p in first], np.int64)
            flat = np.concatenate([*first, np.empty(0, _U)])
            often = orders.value.often(flat)
            begin = np.concatenate(([0], np.cumsum(size)))
            at = np.flatnonzero(often)
            bounds = np.searchsorted(at, begin)
            place = at - np.repeat(begin[:-1], np.diff(bounds))
            marks = [_digest(s) if len(s) else (None, None) for s in sets]
            some = np.diff(bounds) > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers.take(batch.num_rows)), column(batch, "id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                 lists(flat[at].view(np.int64), bounds), lists(place.astype(np.int32), bounds),
                 # for rows that are posted; half of a shingle's bits will do for a filter: a shared shingle shares them
                 *[pa.array([orders.value.prefix(s, k).astype(np.uint32).view(np.int32) if p else None for s, p in zip(sets, some, strict=True)], pa.list_(pa.int32())) for k in (2, 3)],
                 pa.array([_parities(s) if p else None for s, p in zip(sets, some, strict=True)], pa.list_(pa.int64()))],
                ["row", "id", "n", "d1", "d2", "tokens", "places", "second", "third", "bits"])

    id_type = docs.schema["id"].dataType.simpleString()
    rows = written(docs.mapInArrow(posted, f"row bigint, id {id_type}, n bigint, d1 bigint, d2 bigint, tokens array<bigint>, places array<int>, second array<int>, third array<int>, bits array<bigint>"), "jaccard-rows")
    orders.destroy()  # what they were needed for is written, and workers need not hold them beside the sets
    del orders  # the driver's Python keeps the value otherwise
    classes = rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("row"), F.min("id").alias("id"))
    classes = written(classes, "jaccard-classes")
    firsts = rows.filter("size(tokens) > 0").join(classes.select("row"), "row", "left_semi")
    postings = (firsts.select("row", "n", F.explode(F.arrays_zip("tokens", "places")).alias("p"))
                .select(F.col("p.tokens").alias("token"), F.col("p.places").cast("bigint").alias("pos"), "row", "n"))
    shared = postings.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1")
    postings = written(postings.join(shared, "token"), "jaccard-postings")

    wanted = classes.join(postings.select("row").distinct(), "row", "left_semi")
    id_mark = F.xxhash64("id").alias("id_mark")
    bloom = context.broadcast(_bloom(wanted.select("d1", id_mark)))

    def compared(batches):
        for batch, sets in _sets(batches, "text", n):
            marks = np.array([_digest(s) if len(s) else (0, 0) for s in sets], np.int64).reshape(-1, 2)
            at = _bloom_places(_bloom_key(np.ascontiguousarray(marks[:, 0]), column(batch, "id_mark").to_numpy().astype(np.int64)))
            hit = ((bloom.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0) & np.array([len(s) > 0 for s in sets], bool)
            keep = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(marks[keep, 0]), pa.array(marks[keep, 1]), pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64()))],
                ["d1", "d2", "shingles"])

    # only a class's first text passes the filter (and repeated rows of it), so copies do not travel
    sets = docs.withColumn("id_mark", id_mark).mapInArrow(compared, "d1 bigint, d2 bigint, shingles array<bigint>")
    sets = written(sets.join(wanted.select("row", "d1", "d2"), ["d1", "d2"]).drop("d1", "d2"), "jaccard-sets")
    bloom.destroy()
    del bloom
    filters = written(rows.select("row", "n", "second", "third", "bits").join(wanted.select("row"), "row", "left_semi"), "jaccard-filters")

    def verified(pairs: DataFrame) -> DataFrame:
        """Filters by parities and by orders two and three, then the exact comparison."""
        early, near = filters, pairs
        for side in ("x", "y"):
            near = near.join(early.select(F.col("row").alias(side), F.col("n").alias(f"n_{side}"), F.col("second").alias(f"s_{side}"), F.col("third").alias(f"t_{side}"), F.col("bits").alias(f"bits_{side}")), side)
        near = near.filter(_close("x", "y", percent) & F.arrays_overlap("s_x", "s_y") & F.arrays_overlap("t_x", "t_y")).select("x", "y")
        near = written(near, "jaccard-near")
        # written, since its size tells whether a list of the rows can be broadcast: then other rows' sets do not travel
        full = sets.select("row", "shingles").join(near.select(F.col("x").alias("row")).union(near.select("y")).distinct(), "row", "left_semi")
        for side in ("x", "y"):
            near = near.join(full.select(F.col("row").alias(side), F.col("shingles").alias(f"f_{side}")), side)
        both = F.size(F.array_intersect("f_x", "f_y"))
        union = F.size("f_x") + F.size("f_y") - both
        return near.filter(100 * both >= percent * union).select(F.col("x").alias("a"), F.col("y").alias("b"))

    # at first every row is a component of its own
    every, roots, before, whole = postings.drop("times"), None, None, 0
    open_lists = postings.withColumn("root", F.col("row")).withColumn("work", (F.col("times") - 1) / 2).drop("times")
    for turn in count(0):
        if roots is not None:
            # labels meet rows, not postings; then each row deals its label out to its lists
            by_row = open_lists.groupBy("row", "n").agg(F.collect_list(F.struct("token", "pos")).alias("p"))
            by_row = by_row.join(roots, by_row["row"] == roots["node"], "left").select("row", "n", F.coalesce("root", "row").alias("root"), F.explode("p").alias("p"))
            labelled = written(by_row.select("p.token", "row", "n", "p.pos", "root"), "jaccard-labelled")
            # a list's pairs across components, shared out to its rows; a list within one component stays so
            mixed = labelled.groupBy("token", "root").agg(F.count("*").cast("double").alias("m")).groupBy("token").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("same"))
            mixed = mixed.filter("all * all > same").select("token", ((F.col("all") - F.col("same") / F.col("all")) / 2).alias("work"))
            open_lists = written(labelled.join(mixed, "token"), "jaccard-open")
        work, size = open_lists.agg(F.coalesce(F.sum("work"), F.lit(0.0)), F.count("*")).first()
        if turn == 0:  # a first star round compares a pair a posting
            whole, last = size, work <= size
        elif not work:  # no list has rows of two components
            break
        else:
            last = work <= LINEAR * whole or work > STEADY * before
        before = work
        left = open_lists.select("token", *[F.col(c).alias(f"{c}_x") for c in ("row", "n", "pos", "root")])
        if last:
            # the parities meet rows, too; they leave few of the pairs that share a passage only
            by_row = open_lists.groupBy("row", "n", "root").agg(F.collect_list(F.struct("token", "pos")).alias("p")).join(filters.select("row", "bits"), "row")
            open_lists = by_row.select("row", "n", "root", "bits", F.explode("p").alias("p")).select("p.token", "row", "n", "p.pos", "root", "bits")
            left = open_lists.select("token", *[F.col(c).alias(f"{c}_x") for c in ("row", "n", "pos", "root", "bits")])
            right = open_lists.select("token", *[F.col(c).alias(f"{c}_y") for c in ("row", "n", "pos", "root", "bits")])
            pairs = left.join(right, "token").filter("row_x < row_y and root_x <> root_y").filter(_close("x", "y", percent))
        else:
            # pivots of a list: the least of each slot in one of ORDERS random orders; rows meet those of lesser components
            kind = F.pmod("token", F.lit(ORDERS))
            pivot = F.struct(F.xxhash64("row", kind, F.lit(turn)).alias("luck"), "row", "n", "pos", "root")
            slots = open_lists.groupBy("token", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(PIVOTS)).alias("slot")).agg(F.min(pivot).alias("p"))
            right = slots.groupBy("token").agg(F.sort_array(F.collect_list("p")).alias("pivots"))
            met = left.join(right, "token").withColumn("pivots", F.filter("pivots", lambda p: p["root"] < F.col("root_x")))
            if turn == 0:  # most links are found with one pivot a row
                one = F.pmod(F.xxhash64("row_x", kind), F.greatest(F.size("pivots"), F.lit(1))).cast("int")
                met = met.withColumn("pivots", F.slice("pivots", one + 1, 1))
            pairs = met.withColumn("p", F.explode("pivots")).select("*", *[F.col(f"p.{c}").alias(f"{c}_y") for c in ("row", "n", "pos", "root")])
        pairs = pairs.filter(_bounded("x", "y", percent)).select(F.least("row_x", "row_y").alias("x"), F.greatest("row_x", "row_y").alias("y")).distinct()
        new = written(verified(pairs), "jaccard-links")
        if roots is None or not new.isEmpty():  # else the components are what they were
            known = new if roots is None else new.union(roots.filter("node <> root"))
            roots = written(components(known), "jaccard-roots")
        if last:
            break

    # only linked classes have a component to look up; the others are their own
    linked = classes.join(roots, classes["row"] == roots["node"]).select("row", "root", "id")
    least = linked.groupBy("root").agg(F.min("id").alias("component_id"))
    named = roots.join(least, "root").select("node", "component_id")
    known = classes.join(named, classes["row"] == named["node"], "left").select("d1", "d2", "id", "row", F.coalesce("component_id", "id").alias("component_id"))
    links = None
    if all_links:
        pairs = _all_pairs(every).filter(_bounded("x", "y", percent)).select(F.col("row_x").alias("x"), F.col("row_y").alias("y")).distinct()
        links = written(verified(pairs), "jaccard-all-links")
    return rows.select("id", F.col("n").alias("n_shingles"), "d1", "d2"), known, links


def _component() -> Column:
    return F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")


def link(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: id_col, n_shingles and component_id (least id that links reach). The links themselves: see `links`."""
    rows, known, _ = _joined(docs, id_col, text, n, percent, False)
    out = rows.join(known.select("d1", "d2", "component_id"), ["d1", "d2"], "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", _component())


def links(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """All links between classes of equal sets: a and b, the least id of each class; documents with equal sets are links by themselves.

    The result, and the work with it, grow with the square of a group of near but unequal texts; `link` does not.
    """
    _, known, found = _joined(docs, id_col, text, n, percent, True)
    for side in ("a", "b"):
        found = found.join(known.select(F.col("row").alias(side), F.col("id").alias(f"id_{side}")), side)
    return found.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def stage(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One document of each component stays, the one with the least id; of repeated rows one.

    Documents with an empty set are no copies of each other and stay; so do those without an id, which cannot be told apart.
    """
    kept, mark = fresh(docs, "kept_id", "text_mark")
    rows, known, _ = _joined(docs, id_col, "text", 5, 80, False)
    keep = rows.join(known.select("d1", "d2", "component_id"), ["d1", "d2"], "left").filter(F.col("id") == _component()).select(F.col("id").alias(kept)).distinct()
    found = docs.join(keep, docs[id_col] == keep[kept], "left_semi").withColumn(mark, F.xxhash64("text"))
    return found.dropDuplicates([id_col, mark]).drop(mark).unionByName(docs.filter(F.col(id_col).isNull()))


def brute_force(rows: list[tuple[int, str | None]], n: int = 5, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id) by comparing all pairs, for tests on small tables."""
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets, root = {}, {i: i for i, _ in rows}
    for i, t in rows:
        w = (t or "").encode().translate(fold).split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}
