"""Token ids as binary files of fixed-width bit packing.

An id takes as few bits as the largest id of the vocabulary needs. 64 ids fill as many 64-bit words as an id has bits, so
packing and unpacking are 64 vectorised steps over columns, whatever the width. Ids are cut into blocks of `BLOCK`; a shard's table
of block offsets lets a reader unpack any range of ids from the blocks that it touches.

A shard is one file: the header of eight 64-bit numbers (see `_HEADER`), the table of its documents (id, has an id, number in
the part, piece, first place), the block offsets, the packed words, and one line feed, which Spark's writer puts after a record. All numbers are
little-endian. Documents follow each other without gaps, in ascending order of their ids; a document may go on in the next shard.

Stages: texts are dealt by range of their documents' ids (ties go on by length and hash, so a hot id is split) and sorted; each task
encodes its texts as they come and writes shards of at most `shard_ids` ids through Spark's own commit protocol, so a lost task leaves no half file;
`index` gets the headers, and adds up where each shard begins. Nothing but the vocabulary's size is known to the driver, and no task
holds more than a shard and a document beside its batch.

Defined cases: a null text has no ids but the end id. Null ids of documents come first. Rows of one id stand side by side, shorter
texts first, then by hash. Ids of documents are 64-bit integers. An empty table gives no shard. Extra columns do not matter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.llm.bpe import encoder, tokenizer_text
from codequarry.llm.frames import column
from codequarry.session import written

MAGIC = int.from_bytes(b"IDSHARD1", "little")
#: Ids of a block (a multiple of 64) and of a shard.
BLOCK, SHARD_IDS = 4096, 1 << 20
_HEADER = ("magic", "bits", "part", "seq", "n_ids", "n_docs", "open", "block")  # open: the last document goes on in the next shard
_TABLE = np.dtype([("doc_id", "<i8"), ("known", "<i8"), ("number", "<i8"), ("piece", "<i8"), ("begin", "<i8")])


def width(tokenizer_json: str, end_id: int = 0) -> int:
    """Bits that the largest id needs."""
    spec = json.loads(tokenizer_json)
    return max(end_id, 1, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])).bit_length()


def packed(ids: np.ndarray, bits: int) -> np.ndarray:
    """64-bit words, `bits` of them for each 64 ids; the last group is filled up with zeros."""
    groups = -(-len(ids) // 64)
    rows = np.zeros((groups, 64), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    rows, words = np.ascontiguousarray(rows.T), np.zeros((bits, groups), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[word] |= rows[j] << np.uint64(shift)
        if shift + bits > 64:
            words[word + 1] |= rows[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).reshape(-1)


def unpacked(words: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The first n ids of whole groups of words."""
    words = np.ascontiguousarray(words.reshape(-1, bits).T)
    rows = np.empty((64, words.shape[1]), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        value = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[word + 1] << np.uint64(64 - shift))
        rows[j] = value & mask
    return np.ascontiguousarray(rows.T).reshape(-1)[:n]


class Shard:
    """A view of one shard's bytes (bytes, or a memory map of the file). Only the blocks that are asked for are unpacked."""

    def __init__(self, raw):
        head = np.frombuffer(raw, "<i8", len(_HEADER)) if len(raw) >= 8 * len(_HEADER) else [0]
        if head[0] != MAGIC:
            raise ValueError("not a shard of token ids")
        _, self.bits, self.part, self.seq, self.n_ids, n_docs, self.open, self.block = map(int, head)
        at, n_blocks = 8 * len(_HEADER), -(-self.n_ids // self.block)
        self.docs = np.frombuffer(raw, _TABLE, n_docs, at)
        at += self.docs.nbytes
        self.offsets = np.frombuffer(raw, "<u8", n_blocks + 1, at)
        self.raw, self.payload = raw, at + self.offsets.nbytes

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Ids a to b of the shard."""
        b = self.n_ids if b is None else min(b, self.n_ids)
        if a >= b:
            return np.empty(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        lo, hi = int(self.offsets[first]), int(self.offsets[last + 1])
        words = np.frombuffer(self.raw, "<u8", (hi - lo) // 8, self.payload + lo)
        start = first * self.block
        return unpacked(words, min(self.n_ids, (last + 1) * self.block) - start, self.bits)[a - start : b - start]

    def spans(self, whole: bool) -> list[tuple[int, int]]:
        """Ranges of neighbouring documents that are whole in this shard, or that are not."""
        held = self.docs["piece"] == 0
        held[-1:] &= not self.open
        at = np.flatnonzero(held == whole)
        cuts = np.flatnonzero(np.diff(at) > 1) + 1
        return [(int(r[0]), int(r[-1]) + 1) for r in np.split(at, cuts) if len(r)]


def shard_bytes(ids: np.ndarray, docs: np.ndarray, bits: int, part: int, seq: int, goes_on: bool) -> bytes:
    words = packed(ids, bits)
    offsets = np.minimum(np.arange(-(-len(ids) // BLOCK) + 1) * (BLOCK // 8 * bits), words.nbytes).astype("<u8")
    head = np.array([MAGIC, bits, part, seq, len(ids), len(docs), goes_on, BLOCK], "<i8")
    return b"".join((head.tobytes(), docs.tobytes(), offsets.tobytes(), words.astype("<u8", copy=False).tobytes()))


def write(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text: str = "text", end_id: int = 0,
          shard_ids: int = SHARD_IDS) -> None:
    """Encodes the texts, with end_id after each, into shards below path/shards and their index below path/index."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer))
    bits = width(shared.value, end_id)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seq, number, held, n, table = encoder(shared.value), TaskContext.get().partitionId(), 0, 0, np.empty(shard_ids, np.uint32), 0, []

        def shard(goes_on: bool) -> pa.RecordBatch:
            raw = shard_bytes(held[:n], np.array(table, _TABLE), bits, part, seq, goes_on)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["shard"])

        for batch in batches:
            for doc_id, text_of in zip(column(batch, "doc_id").to_pylist(), column(batch, "text"), strict=True):
                ids, begin, piece = bpe.encode(text_of.as_py()), 0, 0
                size = len(ids) + 1
                while begin < size:
                    taken = min(size - begin, shard_ids - n)
                    table.append((doc_id or 0, doc_id is not None, number, piece, n))
                    held[n : n + min(taken, len(ids) - begin)] = ids[begin : begin + taken]
                    begin, piece, n = begin + taken, piece + 1, n + taken
                    if begin == size:
                        held[n - 1] = end_id
                    if n == shard_ids:
                        yield shard(begin < size)
                        seq, n, table = seq + 1, 0, []
                number += 1
        if n:
            yield shard(False)

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id", "text", F.octet_length("text").alias("size"), F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("doc_id"), "size", "mark", "row"]
    files = texts.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(shards, "shard binary")
    files.select(F.col("shard").cast("string")).write.option("maxRecordsPerFile", 1).text(f"{path}/shards", lineSep="\n")

    head = F.hex(F.substring("content", 1, 8 * len(_HEADER)))

    def number(name: str) -> Column:
        """A little-endian number of the header, from its hexadecimal digits."""
        first = 16 * _HEADER.index(name) + 1
        return F.conv(F.concat(*[F.substring("head", first + 2 * k, 2) for k in reversed(range(8))]), 16, 10).cast("bigint").alias(name)

    found = _contents(docs.sparkSession, path).select("path", head.alias("head"))
    listed = written(found.select("path", *[number(k) for k in ("part", "seq", "n_ids")]), "token-heads")
    # one row a task of the writing job
    parts = listed.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    listed.join(parts, "part").select("path", "part", "seq", "n_ids", (F.col("before") + inside).alias("start")).write.parquet(f"{path}/index")


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/shards").filter("length > 0")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and its ids, end id included, as little-endian 32-bit integers (binary)."""
    def placed(wanted: bool) -> DataFrame:
        """Whole documents of the shards, or the pieces of those that go on in the next; blocks that hold none are not unpacked."""
        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in column(batch, "content"):
                    s = Shard(content.as_buffer())
                    for a, b in s.spans(wanted):
                        d = s.docs[a:b]
                        edges = np.append(s.docs["begin"], s.n_ids)[a : b + 1]
                        ids = s.ids(int(edges[0]), int(edges[-1])).astype("<u4", copy=False)
                        raw = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((edges - edges[0]) * 4), pa.py_buffer(ids)])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(d["doc_id"], mask=d["known"] == 0), pa.array(np.full(b - a, s.part)), pa.array(np.full(b - a, s.seq)),
                             pa.array(d["number"]), pa.array(d["piece"]), pa.array(edges[:-1]), raw.cast(pa.binary())],
                            ["doc_id", "part", "seq", "number", "piece", "begin", "ids"])

        found = _contents(spark, path).select("content").mapInArrow(
            pieces, "doc_id bigint, part bigint, seq bigint, number bigint, piece bigint, begin bigint, ids binary")
        index = spark.read.parquet(f"{path}/index").select("part", "seq", F.col("start").alias("shard_start"))
        return found.join(index, ["part", "seq"]).withColumn("start", F.col("shard_start") + F.col("begin"))

    # a document that several shards hold is put together; it is one row, as it was
    rest = placed(False).groupBy("part", "number").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("pieces"))
    joined = F.aggregate("pieces", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return placed(True).select("doc_id", "start", "ids").union(rest.select("doc_id", "start", joined.alias("ids")))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids, from the files."""
    return read(spark, path).select("doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
