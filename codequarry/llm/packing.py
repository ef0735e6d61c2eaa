"""Best-fit packing of tokenized documents into sequences of a fixed size, by bin completion.

A document longer than a sequence is cut into whole sequences; its first piece takes the rest and is packed like a short
document. Packing needs only how many pieces have which length: a table of at most `size` counts, whatever the corpus. The
search for fillings runs over these counts; a filling found once is used as often as the counts allow.

Search: best-fit decreasing gives the first incumbent. Bin completion takes the largest length left and goes through the fillings
around it that no other filling dominates (no length in them can be exchanged for a larger one that still fits), least waste
first, and each as often as it can go, or less often. It prunes branches whose waste so far, or whose lower bound, rules out fewer
sequences than the incumbent has, and states met before. It ends at the lower bound, when no branch is left, or after
`nodes_per_length` branches a distinct length (1024 lengths at most, whatever the corpus); the result is whole in either case.

Pieces then get their places without passing through the driver: they are numbered within partition and length when they are
written, partition offsets come from a small aggregate, and the number picks the filling and the place in it.

Defined cases: a null text is an empty document of one token (the end token); repeated rows are packed each; ids may be null; an
empty table gives no pieces; columns other than the id are not carried along.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.bpe import encoder, tokenizer_text
from codequarry.llm.frames import column
from codequarry.session import written

#: A filling: lengths and how often each occurs, largest first.
Filling = tuple[tuple[int, int], ...]


def best_fit(counts: dict[int, int], size: int) -> Counter[Filling]:
    """Best-fit decreasing over counts: sequences with equal contents are handled as one entry."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(rest: int, content: tuple[int, ...], times: int) -> None:
        if times:
            open_bins.setdefault(rest, []).append((content, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        for rest in sorted(r for r in open_bins if r >= length):
            # a bin that takes one piece may take more: fill it as long as it is the fullest that fits
            fit = rest // length
            groups = open_bins.pop(rest)
            for content, times in groups:
                whole = min(times, left // fit)
                put(rest - fit * length, content + (length,) * fit, whole)
                left -= whole * fit
                times -= whole
                if times and left:
                    put(rest - left * length, content + (length,) * left, 1)
                    left, times = 0, times - 1
                put(rest, content, times)
        fit = size // length
        put(size - fit * length, (length,) * fit, left // fit)
        if left % fit:
            put(size - left % fit * length, (length,) * (left % fit), 1)
    return Counter({tuple(sorted(Counter(c).items(), reverse=True)): t
                    for groups in open_bins.values() for c, t in groups}) if open_bins else Counter()


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Sequences needed at least: by tokens, and by pieces over half a size with what cannot join them (L2)."""
    count = np.zeros(size + 1, np.int64)
    count[list(counts)] = list(counts.values())
    below, tokens = np.cumsum(count), np.cumsum(count * np.arange(size + 1))  # up to and with each length
    k, half = np.arange(size // 2 + 1), size // 2
    small = tokens[half] - np.where(k, tokens[np.maximum(k, 1) - 1], 0)
    room = (below[size - k] - below[half]) * size - (tokens[size - k] - tokens[half])
    over = below[size] - below[half] + np.maximum(0, -(-(small - room) // size))
    return int(max(-(-tokens[size] // size), over.max()))


def fillings(counts: dict[int, int], size: int, most_waste: int) -> Iterator[Filling]:
    """All undominated fillings around the largest length that waste at most `most_waste`, least waste first, made as they are asked for.

    `reach[k]` is a bit set of the sums that the lengths from the k-th on can make, so no step of the walk is in vain.
    """
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    first = lengths[0]
    room = size - first
    free = [min(counts[n] - (n == first), room // n) for n in lengths]
    reach, all_sums = [1] * (len(lengths) + 1), (1 << room + 1) - 1
    for k in range(len(lengths) - 1, -1, -1):
        sums, left, step = reach[k + 1], free[k], 1
        while left:
            step = min(step, left)
            sums |= sums << step * lengths[k] & all_sums
            left, step = left - step, step * 2
        reach[k] = sums

    def grow(at: int, rest: int) -> Iterator[tuple[tuple[int, int], ...]]:
        if not rest:
            yield ()
            return
        for k in range(at, len(lengths)):
            if not reach[k] >> rest & 1:
                return
            n = lengths[k]
            for times in range(min(free[k], rest // n), 0, -1):
                if reach[k + 1] >> rest - times * n & 1:
                    for more in grow(k + 1, rest - times * n):
                        yield ((n, times), *more)

    for waste in range(min(room, most_waste) + 1):
        if not reach[0] >> room - waste & 1:
            continue
        for taken in grow(0, room - waste):
            used = dict(taken)
            spare = [m for m in lengths if counts[m] - (m == first) > used.get(m, 0)]
            # dominated: a spare length fits into the waste, or in the place of a smaller one
            if not any(m <= waste or any(n < m <= n + waste for n in used) for m in spare):
                whole = Counter({first: 1}) + Counter(used)
                yield tuple(sorted(whole.items(), reverse=True))


def plan(counts: dict[int, int], size: int, nodes_per_length: int = 2) -> Counter[Filling]:
    """Fillings and how often each is used; together they hold each length exactly as often as counted.

    A branch takes a filling as often as it can, or half as often, and so on down to once; the same filling may follow again, so
    every number of times is reached. The search ends at the lower bound, when no branch is left (the result is then proved least),
    or after `nodes_per_length` branches for each distinct length and as many as for 400 lengths at least.
    """
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return Counter()
    best, bound, tokens = best_fit(counts, size), lower_bound(counts, size), sum(n * c for n, c in counts.items())

    def branches(left: dict[int, int], used: Counter[Filling], waste: int) -> Iterator[tuple[dict[int, int], Counter[Filling], int]]:
        for f in fillings(left, size, (best.total() - 1) * size - tokens - waste):
            lost, times = size - sum(n * k for n, k in f), min(left[n] // k for n, k in f)
            while times:
                if waste + lost * times <= (best.total() - 1) * size - tokens:
                    after = dict(left)
                    for n, k in f:
                        after[n] -= k * times
                    yield {n: c for n, c in after.items() if c}, used + Counter({f: times}), waste + lost * times
                times //= 2

    budget = nodes_per_length * max(400, len(counts))
    stack, fewest = [branches(counts, Counter(), 0)], {}
    while stack and budget and best.total() > bound:
        found = next(stack[-1], None)
        if found is None:
            stack.pop()
            continue
        left, used, waste = found
        state = frozenset(left.items())
        if fewest.get(state, best.total()) <= used.total() or used.total() + lower_bound(left, size) >= best.total():
            continue
        fewest[state] = used.total()
        budget -= 1
        rest = best_fit(left, size)  # finishes the branch; a better whole is the new incumbent
        if used.total() + rest.total() < best.total():
            best = used + rest
        if left:
            stack.append(branches(left, used, waste))
    return best


def _places(fills: Counter[Filling]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length: first numbers of its runs, and per run (first sequence, copies in a sequence, place there)."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for fill, times in sorted(fills.items(), reverse=True):
        offset = 0
        for n, k in fill:
            rows = runs.setdefault(n, [])
            first = rows[-1][0] + rows[-1][4] if rows else 0
            rows.append((first, sequence, k, offset, times * k))
            offset += n * k
        sequence += times
    return {n: (np.array([r[0] for r in rows]), np.array([r[1:4] for r in rows])) for n, rows in runs.items()}


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", size: int = 1024, end_id: int = 2,
         with_ids: bool = False, nodes_per_length: int = 2) -> DataFrame:
    """One row a piece: the id, piece, start, length, ids_crc32, sequence_id, offset; and its ids where asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_text(path))
    id_field = docs.select(F.col(id_col).alias("doc_id")).schema.simpleString()[len("struct<"):-1].replace(":", " ")
    more = ", ids array<int>" if with_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = encoder(shared.value), TaskContext.get().partitionId()
        number: Counter[int] = Counter()
        for batch in batches:
            rows, owners = [], []
            for i, t in enumerate(column(batch, text).to_pylist()):
                ids = np.append(bpe.encode(t), np.uint32(end_id)).astype("<u4")
                first = len(ids) % size or size
                for p, start in enumerate([0, *range(first, len(ids), size)]):
                    piece = ids[start : first if p == 0 else start + size]
                    n = len(piece)
                    rows.append((p, start, n, zlib.crc32(piece.tobytes()), part, number[n], *([piece.astype(np.int32)] if with_ids else [])))
                    number[n] += 1
                    owners.append(i)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())][: 7 if with_ids else 6]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [column(batch, id_col).take(pa.array(owners, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids])

    pieces = written(docs.select(id_col, text).mapInArrow(cut, f"{id_field}, {PIECES}, part int, nth bigint{more}"), "pieces")
    counted = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = written(counted, "piece-counts")
    places = _places(plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size, nodes_per_length))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = pieces.join(counts.select("part", "length", before.alias("before")), ["part", "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = column(batch, "length").to_numpy()
            number = column(batch, "nth").to_numpy() + column(batch, "before").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, run = places[int(n)]
                at = np.searchsorted(first, number[rows], "right") - 1
                inside = number[rows] - first[at]
                sequence[rows] = run[at, 0] + inside // run[at, 1]
                offset[rows] = run[at, 2] + inside % run[at, 1] * n
            keep = [c for c in batch.schema.names if c not in ("part", "nth", "before")]
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in keep], pa.array(sequence), pa.array(offset)],
                                             [*keep, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    return numbered.select(*names, "nth", "before").mapInArrow(
        place, f"{id_field}, {PIECES}{more}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves, from pieces packed with their ids: sequence_id and ids, at most `size` each."""
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
