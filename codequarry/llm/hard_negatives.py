"""Hard negatives of anchors by exact integer inner products, from Kronecker-packed products.

Components are scaled to whole numbers. Several candidates' components are biased to be non-negative and put into separated fields of one
wide integer, so one multiplication by an anchor's (biased) component serves all of them; the fields of the sum over the components are the
candidates' exact scores, once the biases are taken off. A field is as wide as the largest sum that the two blocks allow. The wide integers
lie in the 53 exact bits of a double, where matrix products are fastest; where not even one field fits, they are Python's whole numbers
with WIDE fields each, and the rest of the code is the same.

Anchors meet all rows in blocks. The tasks that read the table pack what they read into blocks, one row of a written table each, with
components in the fewest bytes that hold them. A cell is a crowd of anchors and a slot of blocks: its task keeps the anchors and goes
through the slot's blocks one by one, so that its memory does not grow with the table. Work is anchors times rows, as the search over all
rows demands; shuffled bytes are the rows times the number of crowds, and the anchors times the number of slots. The first pass multiplies
rows of equal labels only and keeps each anchor's first positives of a cell, which a window then merges; the second looks for each
positive's band of scores among rows of other labels. What is below the last one kept is left out before anything is sorted.
Nothing is broadcast: a broadcast goes through the driver, and Spark's estimate of its size knows neither arrays' lengths nor copies.

Defined cases: rows with a null id, label or vector, or with null or non-finite components take no part. Only vectors of one length have
a score. Rows that stand several times count as often; rows with the anchor's id are not among its positives. A scaled component is held
to the range of a 64-bit integer, and so is a score before it is compared. Ties go to the smaller id, then to the
smaller label. An anchor or positive without negatives gives no row. An empty table gives an empty table. Extra columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.frames import column
from codequarry.session import written

#: Rows of a block (below 2 ** _PLACE), anchors of a crowd, and anchors that are multiplied together.
ROWS, ANCHORS, STEP = 2048, 1 << 18, 128
#: Components of a crowd at most, and of the rows that wait for their block to be full. Rows that a task returns together.
NUMBERS, OUT = 1 << 24, 1 << 16
#: Cells a core at most, if the crowds allow it. Bytes of an anchor and of what it finds in a slot, over those of a row.
CELLS, FOUND = 16, 5
#: Rows of a cell that are looked at before the others.
FEW = 128
#: Bits of an anchor's place in its block, and of a block's number in its task.
_PLACE, _BLOCK = 16, 22
#: Fields of a wide integer that does not fit into a double.
WIDE = 8
_EXACT = 53
_LONG = np.iinfo(np.int64)


class Packed:
    """Whole numbers (rows x components) in the fields of wide integers, for anchors whose components lie between two bounds."""

    def __init__(self, rows: np.ndarray, least: int, most: int) -> None:
        self.n, dims = rows.shape
        low = int(rows.min()) if rows.size else 0
        self.least, self.low = least, low
        self.bits = max(1, (dims * ((int(rows.max()) if rows.size else 0) - low) * (most - least)).bit_length())
        fields = _EXACT // self.bits
        self.kind = np.float64 if fields else object
        self.fields = fields or WIDE
        right = rows.astype(object if self.kind is object else np.int64) - low
        each = -(-self.n // self.fields)
        wide = np.zeros((each, dims), right.dtype)
        for f in range(self.fields):
            part = right[f * each : (f + 1) * each]
            wide[: len(part)] += part << (f * self.bits)
        self.wide = np.ascontiguousarray(wide.T.astype(self.kind))
        # (a + least)(r + low) summed: the packed product, and what the biases add
        self.bias = least * right.sum(axis=1) + dims * least * low

    def times(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products (anchors x rows), held to the range of 64 bits."""
        m, (dims, each) = len(anchors), self.wide.shape
        if not (self.n and m and dims):
            return np.zeros((m, self.n), np.int64)
        left = anchors.astype(object if self.kind is object else np.int64) - self.least
        sums = left.astype(self.kind) @ self.wide
        sums = sums if self.kind is object else sums.astype(np.int64)
        mask = (1 << self.bits) - 1
        out = np.empty((m, self.fields * each), sums.dtype)
        for f in range(self.fields):
            np.bitwise_and(sums, mask, out=out[:, f * each : (f + 1) * each])
            np.right_shift(sums, self.bits, out=sums)
        out = out[:, : self.n]
        out += self.bias
        out += self.low * left.sum(axis=1)[:, None]
        return out if self.kind is not object else np.clip(out, _LONG.min, _LONG.max).astype(np.int64)


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors x rows) of whole numbers, held to the range of 64 bits."""
    return Packed(rows, *_bounds(anchors)).times(anchors)


def first_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Line and place of the k greatest numbers of each line, of equal ones the first. The least number of 64 bits marks what does not count.

    Changes the scores: what is taken no longer counts.
    """
    lines, places, line = [], [], np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        place = scores.argmax(axis=1)
        counts = scores[line, place] > _LONG.min
        lines.append(line[counts])
        places.append(place[counts])
        scores[line, place] = _LONG.min
    return np.concatenate([*lines, line[:0]]), np.concatenate([*places, line[:0]])


def prepared(vectors: DataFrame, label: Column, scale: int, id_col: str, vector: str) -> DataFrame:
    """id, label, dim and vec (whole numbers) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.size(vector).alias("dim"),
        F.transform(v, lambda x: F.floor(x * scale).cast("bigint")).alias("vec"))
    return rows.filter("label is not null")


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of so many rows of one length, in order of id and label: kind 0 has all rows, kind 1 the anchors among them."""
    block, waiting, numbers = TaskContext.get().partitionId() << _BLOCK, {}, 0
    names = ("kind", "dim", "block", "n", "width", "ids", "labels", "vecs")

    def full(dim: int, least: int) -> Iterator[pa.RecordBatch]:
        nonlocal block
        ids, labels, asks, vec = (np.concatenate(x) for x in zip(*waiting.pop(dim), strict=True))
        for s in range(0, len(ids), size):
            if len(ids) - s < least:
                waiting[dim] = [(ids[s:], labels[s:], asks[s:], vec[s:])]
                return
            order = s + np.lexsort((labels[s : s + size], ids[s : s + size]))
            rows = []
            for kind, at in enumerate((order, order[asks[order]])):
                v = vec[at]
                width = next((w for w in (2, 4) if not v.size or -(1 << 8 * w - 1) <= v.min() and v.max() < 1 << 8 * w - 1), 8)
                rows.append((kind, dim, block, len(at), width, ids[at].tobytes(), labels[at].tobytes(), v.astype(f"i{width}").tobytes()))
            rows = [r for r in rows if r[3]]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], _BLOCKS)
            block += 1

    for batch in batches:
        vec, dims, asks = column(batch, "vec"), np.asarray(column(batch, "dim")), column(batch, "asks").to_numpy(zero_copy_only=False)
        ids, labels, flat, first = np.asarray(column(batch, "id")), np.asarray(column(batch, "label")), np.asarray(vec.values), np.asarray(vec.offsets)
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            own = flat[first[at][:, None] + np.arange(dim)]
            waiting.setdefault(dim, []).append((ids[at], labels[at], asks[at], own))
            numbers += own.size
            if sum(len(x[0]) for x in waiting[dim]) >= size:
                yield from full(dim, size)
        if numbers > NUMBERS:
            for dim in [*waiting]:
                yield from full(dim, 1)
            numbers = 0
    for dim in [*waiting]:
        yield from full(dim, 1)


_BLOCKS = pa.schema([("kind", pa.int32()), ("dim", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("width", pa.int32()),
                     ("ids", pa.binary()), ("labels", pa.binary()), ("vecs", pa.binary())])


class Best:
    """The first k of each line: greatest scores, of equal ones the smallest ids. The least number of 64 bits marks a free place."""

    def __init__(self, lines: int, k: int) -> None:
        self.score, self.id = np.full((lines, k), _LONG.min), np.zeros((lines, k), np.int64)

    def add(self, line: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        at, k = np.unique(line), self.score.shape[1]
        lines = np.concatenate([np.repeat(at, k), line])
        scores, numbers = np.concatenate([self.score[at].ravel(), score]), np.concatenate([self.id[at].ravel(), ids])
        order = np.lexsort((numbers, ~scores, lines))
        take = order[np.searchsorted(lines[order], at)[:, None] + np.arange(k)]
        self.score[at], self.id[at] = scores[take], numbers[take]

    def kept(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Line, id and score, of some lines at a time."""
        some = -(-OUT // max(1, self.score.shape[1]))
        for s in range(0, len(self.score), some):
            line, place = np.nonzero(self.score[s : s + some] > _LONG.min)
            yield s + line, self.id[s + line, place], self.score[s + line, place]


class _Cell:
    """A cell's anchors, small components first (within a label where that comes first): a large one makes fields wide for its like only."""

    label: np.ndarray
    vec: np.ndarray

    def sized(self, size: np.ndarray) -> None:
        self.size, self.bounds = size, {c: _bounds(self.vec[size <= c]) for c in np.unique(size)}

    def times(self, s: int, e: int, rows: np.ndarray, packed: dict[int, Packed]) -> np.ndarray:
        """Products of some anchors and rows; packed: these rows as packed before."""
        size = self.size[e - 1]
        if size not in packed:
            packed[size] = Packed(rows, *self.bounds[size])
        return packed[size].times(self.vec[s:e])


class _Positives(_Cell):
    """The first k rows of each anchor's label in a cell: anchor, its id, id, score."""

    names = ("anchor", "anchor_id", "id", "score")
    #: Blocks of rows that are looked at together, so that a label has enough of them.
    together = 16

    def __init__(self, blocks: list[dict], k: int, step: int) -> None:
        parts = [_decoded(x) for x in blocks]
        ids, label, vec = (np.concatenate([p[i] for p in parts]) for i in range(3))
        size = _size(vec)
        order = np.lexsort((size, label))
        self.id, self.label, self.vec = ids[order], label[order], vec[order]
        self.anchor = np.concatenate([(x["block"] << _PLACE) + np.arange(x["n"]) for x in blocks])[order]
        self.sized(size[order])
        self.k, self.step, self.best = k, step, Best(len(order), k)

    def meet(self, ids: np.ndarray, labels: np.ndarray, vec: np.ndarray) -> None:
        order = np.lexsort((ids, labels))
        ids, labels, vec = ids[order], labels[order], vec[order]
        for label in np.intersect1d(labels, self.label):
            lines, rows = (slice(*(int(np.searchsorted(x, label, side)) for side in ("left", "right"))) for x in (self.label, labels))
            for r in range(rows.start, rows.stop, ROWS):
                part = slice(r, min(r + ROWS, rows.stop))
                self._meet(lines, ids[part], vec[part])

    def _meet(self, lines: slice, own: np.ndarray, rows: np.ndarray) -> None:
        packed = {}
        for s in range(lines.start, lines.stop, self.step):
            e = min(s + self.step, lines.stop)
            score = np.maximum(self.times(s, e, rows, packed), _LONG.min + 1)
            inside = score >= self.best.score[s:e, -1:]
            line, place = _places(inside) if _few(inside) else first_of(np.where(self.id[s:e, None] != own, score, _LONG.min), self.k)
            other = self.id[s + line] != own[place]
            line, place = line[other], place[other]
            if len(line):
                self.best.add(s + line, score[line, place], own[place])

    def found(self) -> Iterator[pa.RecordBatch]:
        for line, ids, score in self.best.kept():
            yield _batch([[self.anchor[line]], [self.id[line]], [ids], [score]], self.names)


class _Negatives(_Cell):
    """The first k rows of other labels in a cell whose score lies in a positive's band: anchor, nth positive, id, score."""

    names = ("anchor", "nth", "id", "score")
    together = 1

    def __init__(self, blocks: list[dict], k: int, step: int) -> None:
        parts = []
        for x in blocks:
            _, label, vec = _decoded(x)
            place, nth, low, high = (np.asarray(x[c].values) for c in ("place", "nth", "low", "high"))
            # bands are in order of place: each anchor with bands is a line, and its bands are that line's turns
            own, line = np.unique(place, return_inverse=True)
            parts.append(((x["block"] << _PLACE) + own, label[own], vec[own], line, nth, low, high))
        before = np.cumsum([0, *[len(p[0]) for p in parts]])[:-1]
        anchor, label, vec = (np.concatenate([p[i] for p in parts]) for i in range(3))
        size = _size(vec)
        order = np.argsort(size, kind="stable")
        self.anchor, self.label, self.vec = anchor[order], label[order], vec[order]
        self.sized(size[order])
        line = np.concatenate([p[3] + n for p, n in zip(parts, before, strict=True)])
        turn = np.arange(len(line)) - np.searchsorted(line, line)
        line = np.argsort(order)[line]
        shape = (len(self.anchor), int(turn.max()) + 1 if len(turn) else 0)
        # places that no band takes hold an empty one
        self.nth, self.low, self.high = np.zeros(shape, np.int64), np.full(shape, _LONG.max), np.full(shape, _LONG.min)
        for to, i in ((self.nth, 4), (self.low, 5), (self.high, 6)):
            to[line, turn] = np.concatenate([p[i] for p in parts])
        self.k, self.step, self.best, self.begun = k, step, Best(shape[0] * shape[1], k), False

    def meet(self, ids: np.ndarray, labels: np.ndarray, vec: np.ndarray) -> None:
        # a few rows tell what the others have to reach
        for part in (slice(None),) if self.begun else (slice(FEW), slice(FEW, None)):
            self.begun = True
            if len(ids[part]):
                self._meet(ids[part], labels[part], vec[part])

    def _meet(self, ids: np.ndarray, labels: np.ndarray, vec: np.ndarray) -> None:
        turns, packed = self.low.shape[1], {}
        for s in range(0, len(self.anchor), self.step):
            e = min(s + self.step, len(self.anchor))
            score = self.times(s, e, vec, packed)
            low = np.maximum(self.low[s:e], self.best.score[s * turns : e * turns, -1].reshape(e - s, turns))
            high = self.high[s:e]
            inside = score >= low.min(axis=1)[:, None]
            if not _few(inside):
                inside &= (score <= high.max(axis=1)[:, None]) & (self.label[s:e, None] != labels)
            if _few(inside):
                line, place = _places(inside)
                value = score[line, place]
                fits = (self.label[s + line] != labels[place])[:, None] & (value[:, None] >= low[line]) & (value[:, None] <= high[line])
                one, turn = np.nonzero(fits)
                line, place = line[one], place[one]
            else:
                found = [[], [], []]
                for t in range(turns):
                    band = inside & (score >= low[:, t, None]) & (score <= high[:, t, None])
                    for to, x in zip(found, first_of(np.where(band, score, _LONG.min), self.k), strict=False):
                        to.append(x)
                    found[2].append(np.full(len(found[0][-1]), t))
                line, place, turn = (np.concatenate(x) for x in found)
            if len(line):
                self.best.add((s + line) * turns + turn, score[line, place], ids[place])

    def found(self) -> Iterator[pa.RecordBatch]:
        for at, ids, score in self.best.kept():
            line, turn = np.divmod(at, max(1, self.low.shape[1]))
            yield _batch([[self.anchor[line]], [self.nth[line, turn]], [ids], [score]], self.names)


def _few(inside: np.ndarray) -> bool:
    """Whether listing what is inside costs less than the passes over all scores that first_of makes."""
    return 16 * np.count_nonzero(inside) <= inside.size


def _places(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero, faster where few are inside."""
    return np.divmod(np.flatnonzero(inside), inside.shape[1])


def _size(vec: np.ndarray) -> np.ndarray:
    """Each vector's largest component, in steps of four bits."""
    most = np.maximum(vec.max(axis=1), ~vec.min(axis=1)) if vec.size else np.zeros(len(vec))
    return -(-np.frexp(most.astype(float))[1] // 4)


def _bounds(vec: np.ndarray) -> tuple[int, int]:
    return (int(vec.min()), int(vec.max())) if vec.size else (0, 0)


def _decoded(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids, labels and vectors."""
    vec = np.frombuffer(block["vecs"], f"i{block['width']}").reshape(block["n"], block["dim"])
    return np.frombuffer(block["ids"], np.int64), np.frombuffer(block["labels"], np.int64), vec


def _cells(batches: Iterator[pa.RecordBatch], kind: type, k: int, step: int) -> Iterator[pa.RecordBatch]:
    """What each cell's anchors find in its rows: a cell's anchors come before its rows."""
    cell, blocks, rows, open_cell = None, [], [], None

    def over() -> Iterator[pa.RecordBatch]:
        if rows:
            open_cell.meet(*(np.concatenate(x) for x in zip(*rows, strict=True)))
            rows.clear()
        return open_cell.found() if open_cell else iter(())

    for batch in batches:
        for i in range(batch.num_rows if k > 0 else 0):
            x = {c: column(batch, c)[i] for c in batch.schema.names}
            x = {c: v if pa.types.is_list(v.type) else v.as_py() for c, v in x.items()}
            if cell != (cell := (x["dim"], x["crowd"], x["slot"])):
                yield from over()
                blocks, open_cell = [], None
            if x["kind"]:
                blocks.append(x)
            elif blocks or open_cell:
                open_cell, blocks = open_cell or kind(blocks, k, step), []
                rows.append(_decoded(x))
                if len(rows) >= kind.together or sum(r[2].size for r in rows) > NUMBERS >> 3:
                    over()
    yield from over()


def _batch(columns: list[list[np.ndarray]], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*c, np.empty(0, np.int64)])) for c in columns], list(names))


def mine(vectors: DataFrame, is_anchor: Column, label: Column, scale: int = 256, positives: int = 5, negatives: int = 3,
         low_percent: int = 50, high_percent: int = 95, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: a column over `id`; label: a column over the table's own columns. Negatives of a positive are the first ones with
    low_percent * positive score <= 100 * score <= high_percent * positive score.
    """
    rows = prepared(vectors, label, scale, id_col, vector).withColumn("asks", F.coalesce(is_anchor, F.lit(False)))
    kinds = "kind int, dim int, block bigint, n bigint, width int, ids binary, labels binary, vecs binary"
    size, step = ROWS, STEP
    stored = written(rows.mapInArrow(lambda b: _packed(b, size), kinds), "hard-blocks", partition_by=("kind",))

    count = {kind: more for kind, *more in stored.groupBy("kind").agg(F.sum("n"), F.sum(F.col("n") * F.col("dim")), F.count("n")).collect()}
    (n, _, blocks), (asked, wide, _) = (count.get(kind, (0, 0, 0)) for kind in (0, 1))
    # cells for all cores; a slot more costs a copy of the anchors and of what they find, a crowd more one of the rows
    session = rows.sparkSession
    cells = min(int(session.conf.get("spark.sql.shuffle.partitions")), CELLS * session.sparkContext.defaultParallelism)
    crowds = max(1, -(-asked // ANCHORS), -(-wide // NUMBERS), math.isqrt(cells * asked * FOUND // max(1, n)))
    slots = max(1, min(-(-cells // crowds), blocks))

    def met(anchors: DataFrame, kind: type, k: int, kinds: str) -> DataFrame:
        """What each block of anchors finds in each block of rows."""
        def share(parts: int) -> Column:
            return F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")

        def every(parts: int) -> Column:
            return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

        left = anchors.withColumn("crowd", share(crowds)).withColumn("slot", every(slots))
        right = stored.filter("kind = 0").withColumn("slot", share(slots)).withColumn("crowd", every(crowds))
        cells = left.unionByName(right, allowMissingColumns=True).repartition(crowds * slots, "dim", "crowd", "slot")
        return cells.sortWithinPartitions("dim", "crowd", "slot", F.desc("kind")).mapInArrow(lambda b: _cells(b, kind, k, step), kinds)

    anchors = stored.filter("kind = 1")
    near = met(anchors, _Positives, positives, "anchor bigint, anchor_id bigint, id bigint, score bigint")
    first = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    near = written(near.withColumn("nth", first).filter(F.col("nth") <= positives), "hard-positives")

    # whole numbers n with low * p <= 100 n <= high * p; wide enough for any product
    def bound(percent: int, up: bool) -> Column:
        exact = F.col("score").cast("decimal(38,0)") * percent
        return (-F.floor(-exact / 100) if up else F.floor(exact / 100)).cast("bigint")

    bands = near.select(F.shiftright("anchor", _PLACE).alias("block"), F.struct(
        (F.col("anchor") % (1 << _PLACE)).alias("place"), F.col("nth").cast("bigint").alias("nth"), bound(low_percent, True).alias("low"), bound(high_percent, False).alias("high")).alias("band"))
    bands = bands.filter("band.low <= band.high").groupBy("block").agg(F.array_sort(F.collect_list("band")).alias("bands"))
    bands = bands.select("block", *[F.col(f"bands.{c}").alias(c) for c in ("place", "nth", "low", "high")])
    far = met(anchors.join(bands.hint("merge"), "block"), _Negatives, negatives, "anchor bigint, nth bigint, id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id"))
    far = far.withColumn("rank", place).filter(F.col("rank") <= negatives)

    far = far.select("anchor", F.col("nth").cast("int").alias("nth"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.select("anchor", "nth", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(named.hint("merge"), ["anchor", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
