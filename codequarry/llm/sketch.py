"""Count-min sketch of one or two rows whose counters stop at two, built per partition and merged block by block.

A partition's sketch is kept sparse (the cells it touched once, and more than once). The merged sketch is one bit a
cell, "counted twice or more", of fixed size: cells / 8 bytes a row, whatever the input. Where more keys are counted than it
is sized for, the estimates only grow: no key that occurs twice is ever estimated below two.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row

from codequarry.llm.words import mix
from codequarry.session import written

_BLOCK = 1 << 20
PARTIAL = "sketch_row int, block int, once binary, more binary"
PARTIAL_ARROW = pa.schema([("sketch_row", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])


def cells_of(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(keys + np.uint64((row + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(cells - 1)).astype(np.uint32)


def _packed(place: np.ndarray) -> bytes:
    """Sorted places in a block, two bytes each, after the counts of its 16 parts."""
    return np.bincount(place >> 16, minlength=16).astype("<u4").tobytes() + (place & 0xFFFF).astype("<u2").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.repeat(np.arange(16) << 16, np.frombuffer(raw, "<u4", 16)) + np.frombuffer(raw, "<u2", offset=64)


def partials(keys: np.ndarray, cells: int, rows: int = 2) -> pa.RecordBatch:
    """The sparse sketch of these keys, a row for each block of cells."""
    out = []
    for row in range(rows):
        cell, count = np.unique(cells_of(keys, row, cells), return_counts=True)
        block = cell // _BLOCK
        edges = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(cell)])) if len(cell) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            place, many = cell[a:b] % _BLOCK, count[a:b] > 1
            out.append((row, int(block[a]), _packed(place[~many]), _packed(place[many])))
    columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, PARTIAL_ARROW, strict=True)], schema=PARTIAL_ARROW)


def merge_block(group: pd.DataFrame) -> pd.DataFrame:
    """Bits of one block, from all its partial sketches."""
    count = np.zeros(_BLOCK, np.uint8)
    for once, more in zip(group["once"], group["more"], strict=True):
        place = _unpacked(once)
        count[place] = np.minimum(count[place] + 1, 2)
        count[_unpacked(more)] = 2
    return pd.DataFrame({"sketch_row": group["sketch_row"][:1], "block": group["block"][:1],
                         "bits": [np.packbits(count > 1, bitorder="little").tobytes()]})


MERGED = "sketch_row int, block int, bits binary"


def merged(parts: DataFrame, cells: int, rows: int = 2) -> np.ndarray:
    """(rows, cells / 8) bytes. Each block is merged in a task of its own; only the fixed-size bits reach the driver."""
    bits = np.zeros((rows, max(cells, _BLOCK) // 8), np.uint8)
    for r in few_at_a_time(parts.groupBy("sketch_row", "block").applyInPandas(merge_block, MERGED)):
        put(bits, r)
    return bits


def few_at_a_time(blocks: DataFrame, pieces: int = 8) -> Iterator[Row]:
    """Rows of a table of bounded size, a piece of it in the driver at a time; made by as many tasks as there are partitions."""
    return written(blocks, "blocks").coalesce(pieces).toLocalIterator()


def put(bits: np.ndarray, r) -> None:
    """Puts a merged block in its place."""
    bits[r["sketch_row"], r["block"] * _BLOCK // 8 : (r["block"] + 1) * _BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)


def repeated(keys: np.ndarray, bits: np.ndarray, cells: int) -> np.ndarray:
    """Mask of the keys that are estimated to occur twice or more."""
    out = np.ones(len(keys), bool)
    for row in range(len(bits)):
        cell = cells_of(keys, row, cells)
        out &= (bits[row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return out


def sketching(batches: Iterable[np.ndarray], cells: int, rows: int = 2, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Sparse sketches of the keys that come in, each of so many keys or one batch more."""
    held, n = [], 0
    for keys in batches:
        held.append(keys)
        n += len(keys)
        if n >= most:
            yield partials(np.concatenate(held), cells, rows)
            held, n = [], 0
    if n:
        yield partials(np.concatenate(held), cells, rows)
