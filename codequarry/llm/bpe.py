"""BPE encoding and decoding that give the ids and texts of the `tokenizers` library.

A text is cut at special tokens. Parts of Latin letters, digits and signs are encoded by `tiktoken` over the ranks of the same
file, which is several times as fast; runs with any other character by `tokenizers` itself. Texts are cut before single
blanks between other characters, which the byte-level pattern never joins over; the ids of such chunks are kept in a bounded table.

Long unsplit text (a pre-token above `LEAF` characters) is encoded by tree concatenation: it is halved down to leaves, the
leaves are encoded together in parallel, and neighbouring halves are joined upwards. At a join, a window around the seam is
encoded anew and grows until its first and last tokens are tokens of the left and of the right half at the same places. A row
of tokens is the encoding exactly when every two neighbours are the encoding of their own bytes; so the joined row is exact.

Defined cases: a null text encodes to no ids and is decoded to an empty text; special tokens in a text get their own id, as the
library does by default; other columns pass through; repeated rows and empty tables need nothing special.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from codequarry.llm.frames import column, extended, fresh, with_columns

#: Pre-tokens longer than this are encoded as a tree of leaves of about this many characters.
LEAF = 1024
#: Below this code point, Unicode tables of all libraries agree on letters, digits and spaces.
_LATIN_END = 0x250
#: Chunks whose ids a task keeps.
KEPT_CHUNKS = 400_000
#: Blanks beside other white space, and the rarer white space of Latin text.
_UNEVEN = ("  ", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")
_SEAM = re.compile(r"(?<=\S)(?= \S)")
#: The byte-level pattern of the vocabulary file's pre-tokenizer (fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Chunks(dict):
    """chunk -> its ids as little-endian bytes, the lead put before it; emptied when full."""

    def __init__(self, encoder: Encoder, lead: str):
        self.encoder, self.lead = encoder, lead

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > self.encoder.leaf:
            return self.encoder._any(self.lead + chunk).astype("<u4").tobytes()
        if len(self) >= KEPT_CHUNKS:
            self.clear()
        found = self[chunk] = array("I", self.encoder.latin.encode_ordinary(self.lead + chunk)).tobytes()
        return found


def _is_latin(text: str) -> bool:
    return text.isascii() or int(np.frombuffer(text.encode("utf-32-le"), np.uint32).max()) < _LATIN_END


class Encoder:
    """Encodes and decodes texts with the tokenizer whose JSON text is given. One for each Python worker: see `encoder`."""

    def __init__(self, tokenizer_json: str, leaf: int = LEAF):
        spec = json.loads(tokenizer_json)
        letters = _byte_letters()
        self.whole = Tokenizer.from_str(tokenizer_json)
        self.piece = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": spec["pre_tokenizer"] | {"use_regex": False}}))
        for t in (self.whole, self.piece):
            t.no_truncation()
            t.no_padding()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.latin = tiktoken.Encoding("latin", pat_str=_PATTERN, mergeable_ranks={b: i for i, b in vocab.items()}, special_tokens={})
        vocab |= {i: t.encode() for t, i in self.special.items()}
        self.bytes_of = [vocab.get(i, b"") for i in range(max(vocab) + 1)]
        self.size_of = np.array([len(b) for b in self.bytes_of])
        self.digits_of = [str(i) for i in range(len(self.bytes_of))]
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.leaf = leaf
        self.first, self.after = _Chunks(self, ""), _Chunks(self, " ")

    def encode(self, text: str | None) -> np.ndarray:
        rows, done = [], 0
        for m in self.cut.finditer(text or ""):
            rows += [self._part(text[done : m.start()]), np.array([self.special[m[0]]], np.uint32)]
            done = m.end()
        if not rows:
            return self._part(text or "")
        return np.concatenate([*rows, self._part(text[done:])])

    def _part(self, text: str) -> np.ndarray:
        """Ids of a text without special tokens."""
        if not text:
            return np.empty(0, np.uint32)
        if _is_latin(text):
            return self._latin(text)
        rows = []
        for latin, run in groupby(_SEAM.split(text), _is_latin):
            run = "".join(run)
            rows.append(self._latin(run) if latin else self._any(run))
        return np.concatenate(rows)

    def _latin(self, text: str) -> np.ndarray:
        if any(c in text for c in _UNEVEN) or text[0] == " " or text[-1] == " ":
            if max(map(len, text.split()), default=0) > self.leaf:
                return self._any(text)
            return self.latin.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
        # every blank stands between two other characters: chunks before blanks are encoded apart
        first, *rest = text.split(" ")
        return np.frombuffer(b"".join([self.first[first], *map(self.after.__getitem__, rest)]), "<u4")

    def _any(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        rows, held = [], []
        for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(text):
            if b - a <= self.leaf:
                held.append(text[a:b])
            else:
                rows += self._pieces(held)
                rows.append(self.tree(text[a:b]))
                held = []
        return np.concatenate(rows + self._pieces(held))

    def _pieces(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as one pre-token, worked out in parallel."""
        return [np.array(e.ids, np.uint32) for e in self.piece.encode_batch(texts, add_special_tokens=False)]

    def tree(self, text: str) -> np.ndarray:
        """Leaves in parallel, then joins of neighbours until one row is left."""
        n = -(-len(text) // self.leaf)
        at = [len(text) * i // n for i in range(n + 1)]
        rows = self._pieces([text[a:b] for a, b in zip(at, at[1:], strict=False)])
        spans = list(zip(at, at[1:], strict=False))
        while len(rows) > 1:
            joined, covered = [], []
            for i in range(0, len(rows) - 1, 2):
                joined.append(self.join(text, spans[i], rows[i], spans[i + 1], rows[i + 1]))
                covered.append((spans[i][0], spans[i + 1][1]))
            if len(rows) % 2:
                joined.append(rows[-1])
                covered.append(spans[-1])
            rows, spans = joined, covered
        return rows[0]

    def join(self, text: str, a: tuple[int, int], left: np.ndarray, b: tuple[int, int], right: np.ndarray) -> np.ndarray:
        """The ids of text[a[0]:b[1]] from those of its two halves.

        Windows begin and end at token borders of the halves that are character borders too.
        """
        seam, size = a[1], 32
        ends_left, ends_right = self._borders(left, text[a[0] : a[1]]), self._borders(right, text[b[0] : b[1]])
        while True:
            i = int(np.searchsorted(ends_left, max(0, seam - size - a[0]), "right")) - 1
            j = int(np.searchsorted(ends_right, min(b[1] - b[0], size), "left"))
            i = max(k for k in range(i + 1) if ends_left[k] != ends_left[k - 1] or not k)
            lo, hi = a[0] + int(ends_left[i]), b[0] + int(ends_right[j])
            new = self._pieces([text[lo:hi]])[0]
            same_left = i == 0 or (i < len(left) and new[0] == left[i])
            same_right = j == len(right) or (j > 0 and new[-1] == right[j - 1])
            if same_left and same_right and len(new) > 1 or i == 0 and j == len(right):
                return np.concatenate((left[:i], new, right[j:]))
            size *= 2

    def _borders(self, ids: np.ndarray, text: str) -> np.ndarray:
        """Character places of the token borders; a border inside a character repeats the place before it."""
        ends = np.concatenate(([0], np.cumsum(self.size_of[ids])))
        raw = np.frombuffer(text.encode(), np.uint8)
        return np.concatenate((np.cumsum((raw & 0xC0) != 0x80) - 1, [len(text)]))[ends]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode(errors="replace")


@lru_cache(maxsize=1)
def encoder(tokenizer_json: str) -> Encoder:
    """The encoder of this process. Workers run many tasks: each would build its own, begin without chunks, and leave the last one
    to the garbage collector, since an encoder and its chunks refer to each other."""
    return Encoder(tokenizer_json)


def tokenizer_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _shared(spark: SparkSession, path: str):
    """The vocabulary file's text (of fixed size) for all executors, which need not have the file."""
    return spark.sparkContext.broadcast(tokenizer_text(path))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of docs and `ids` (array of int)."""
    (ids,), shared = fresh(docs, ids), _shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value)
        for batch in batches:
            rows = [bpe.encode(t).astype(np.int32) for t in column(batch, text).to_pylist()]
            yield with_columns(batch, [ids], [pa.array(rows, pa.list_(pa.int32()))])

    return docs.mapInArrow(run, extended(docs, f"{ids} array<int>"))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of df and `text`, decoded with special tokens; null ids give an empty text."""
    (text,), shared = fresh(df, text), _shared(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value)
        for batch in batches:
            rows = [bpe.decode(r or ()) for r in column(batch, ids).to_pylist()]
            yield with_columns(batch, [text], [pa.array(rows, pa.string())])

    return df.mapInArrow(run, extended(df, f"{text} string"))


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns but the text, and n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass."""
    shared = _shared(docs.sparkSession, path)
    names = fresh(docs.drop(text), "n_tokens", "ids_sha256", "decoded_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value)
        for batch in batches:
            rows = []
            for t in column(batch, text).to_pylist():
                ids = bpe.encode(t).tolist()
                written = ",".join([bpe.digits_of[i] for i in ids])
                rows.append((len(ids), sha256(written.encode()).hexdigest(), sha256(bpe.decode(ids).encode()).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield with_columns(batch, names, [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)],
                               drop=(text,))

    return docs.mapInArrow(run, extended(docs.drop(text), f"{names[0]} bigint, {names[1]} string, {names[2]} string"))
