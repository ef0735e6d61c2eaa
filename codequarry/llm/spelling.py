"""Spelling variants of a corpus's words, by composition of finite-state machines.

Words are counted over all texts. Two words are near if one inserted, deleted or replaced code point turns one into the other: the pairs
that `A o T o A` accepts, where A is the minimised acceptor of the vocabulary and T the transducer of one edit. The composition is not
built as a whole. A pair whose edit lies behind the first PREFIX code points leaves the initial state through equal arcs, so all such pairs
are found from the states that a prefix leads to; a pair whose edit lies before them has equal last code points, and is found in the
same way among the reversed words, as words are at least twice as long as the prefix. Each prefix is an initial-state partition. Partitions are
dealt to buckets of some BUCKET_WORDS words, a task minimises the acceptor of its bucket, and walks the composition from each
partition's state. Pairs of states whose remaining languages have nothing in common are cut off (`Acceptor.meets`).

A partition above `most_words` words is not walked: the arcs that edit at its very border are a join by the rest of the word, in Spark, and
what follows an equal arc is a partition with a prefix longer by one. So no task holds more than its bucket and `most_words` words.
Words above LONGEST code points (each state would be a Python object) are paired in Spark as well: deleting one place of each leaves
equal strings, so they are joined by the hashes of all strings with one place deleted, and such pairs are then compared exactly.

The form of a word is its near word with the largest count, if that is at least `ratio` times its own count; roots follow forms by pointer
doubling, in as many rounds as the logarithm of the longest chain, which counts that grow by `ratio` keep short.

Defined cases: a null text has no words. A null document id writes as an empty string in the rule that plants errors. Repeated rows count again.
Words of ties go by code points. Very long runs are words like others. An empty table gives an empty table. Extra columns do not matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.frames import column
from codequarry.llm.words import mix
from codequarry.session import written

#: Code points that a partition's words share at first; words must have twice as many.
PREFIX = 3
#: Words of a bucket of partitions, and of the largest partition that a task walks.
BUCKET_WORDS, MOST_WORDS = 5000, 50_000
#: Code points of the longest word that an acceptor holds.
LONGEST = 200
#: Words that a task counts before it hands the counts on.
HELD_WORDS = 200_000

#: Bytes of runs after A-Z are lower-cased: a-z, and U+00C0 to U+00FF, which are the byte C3 and one of 80 to BF.
_OTHER = bytes(b for b in range(256) if not (97 <= b <= 122 or b == 0xC3 or 0x80 <= b <= 0xBF))
_BLANKED = bytes(b if b not in _OTHER else 32 for b in range(256))
#: First bytes of characters that are neither ASCII nor of the range; their later bytes must not count as letters.
_FOREIGN = bytes([0xC2, *range(0xC4, 0xF8)])


def runs(text: bytes) -> list[bytes]:
    """Maximal runs of letters of UTF-8 text, A-Z lower-cased."""
    text = text.lower()
    if len(text.translate(None, _FOREIGN)) != len(text):
        # blank out whole characters: a foreign first byte and the bytes that go on with it
        raw = np.frombuffer(text, np.uint8)
        first = (raw & 0xC0) != 0x80
        lead = raw[np.maximum.accumulate(np.where(first, np.arange(len(raw)), 0))]
        text = np.where((lead == 0xC3) | (lead < 0x80), raw, 32).astype(np.uint8).tobytes()
    return text.translate(_BLANKED).split()


def _planted(run: bytes, h: int) -> bytes:
    """The run without its code point number h modulo its length."""
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def document_words(doc_id: str, text: bytes, least: int, planted: int) -> Iterator[tuple[bytes, int]]:
    """The words of a text of at least so many code points, with their counts. Runs whose checksum `planted` divides lose a code point."""
    found = {w: n for w, n in Counter(runs(text)).items() if len(w) >= least}  # a code point has a byte at least
    begin = zlib.crc32(f"{doc_id}:".encode())
    marks = [zlib.crc32(w, begin) for w in found]
    for w, n, h in zip(found, found.values(), marks, strict=True):
        if planted and h % planted == 0:
            w = _planted(w, h)
        if w.isascii():
            if len(w) >= least:
                yield w, n
        elif len(w.decode()) >= least:
            yield w, n


def vocabulary(docs: DataFrame, id_col: str, text: str, least: int, occurrences: int, planted: int) -> DataFrame:
    """word, n of the words with so many occurrences in all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def counts() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, t in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").cast(pa.binary()), strict=True):
                for w, n in document_words(doc_id or "", t.as_py() or b"", least, planted):
                    held[w] += n
                if len(held) > HELD_WORDS:
                    yield counts()
                    held.clear()
        yield counts()

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return written(counted.filter(F.col("n") >= occurrences), "spelling-words")


class Acceptor:
    """The minimal deterministic acceptor of sorted distinct words. A state's arcs are a dict from code point to state."""

    def __init__(self, words: Iterable[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.known: dict[tuple, int] = {}
        self.reach: dict[tuple[int, int], bool] = {}
        path, before = [({}, False)], ""  # arcs and finality of the states along the last word; below it all is minimised
        for word in words:
            same = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                same += 1
            self._close(path, before, same)
            path += [({}, False) for _ in word[same:]]
            path[-1] = (path[-1][0], True)
            before = word
        self._close(path, before, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list, word: str, down_to: int) -> None:
        for i in range(len(word), down_to, -1):
            arcs, final = path.pop()
            path[-1][0][word[i - 1]] = self._state(arcs, final)

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        """The number of the state with these arcs: an equal one that is known, or a new one."""
        key = (final, *arcs.items())  # words are sorted, so arcs come in order
        state = self.known.setdefault(key, len(self.arcs))
        if state == len(self.arcs):
            self.arcs.append(arcs)
            self.final.append(final)
        return state

    def after(self, prefix: str) -> int | None:
        state = self.start
        for c in prefix:
            state = self.arcs[state].get(c)
            if state is None:
                return None
        return state

    def meets(self, p: int, q: int) -> bool:
        """Do the states accept a common word?"""
        if p == q:
            return True  # every state leads to a word
        key = (p, q) if p < q else (q, p)
        found = self.reach.get(key)
        if found is None:
            a, b = self.arcs[key[0]], self.arcs[key[1]]
            if len(b) < len(a):
                a, b = b, a
            found = self.reach[key] = self.final[p] and self.final[q] or any(c in b and self.meets(s, b[c]) for c, s in a.items())
        return found

    def common(self, p: int, q: int) -> Iterator[str]:
        """The words that both states accept."""
        todo = [(p, q, "")]
        while todo:
            p, q, done = todo.pop()
            if self.final[p] and self.final[q]:
                yield done
            a, b = self.arcs[p], self.arcs[q]
            for c in a.keys() & b.keys():
                if self.meets(a[c], b[c]):
                    todo.append((a[c], b[c], done + c))

    def pairs(self, prefix: str) -> Iterator[tuple[str, str]]:
        """Accepted pairs of the composition from the prefix's state: the edit lies behind the prefix. A pair comes in one order, at least once."""
        start = self.after(prefix)
        todo = [] if start is None else [(start, prefix)]
        while todo:
            state, done = todo.pop()
            arcs = self.arcs[state]
            out = list(arcs.items())
            for i, (c, s) in enumerate(out):
                todo.append((s, done + c))
                for d, t in out[:i]:  # c replaced by d
                    if self.meets(s, t):
                        for rest in self.common(s, t):
                            yield done + c + rest, done + d + rest
                if self.meets(s, state):  # c deleted
                    for rest in self.common(s, state):
                        yield done + c + rest, done + rest


def _walked(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a bucket, from the state of each of its partitions."""
    words = sorted(group["w"])
    machine = Acceptor(words)
    pairs = {p for prefix in sorted(set(group["prefix"])) for p in machine.pairs(prefix)}
    if group["way"].iloc[0]:
        pairs = {(a[::-1], b[::-1]) for a, b in pairs}
    return pd.DataFrame(sorted(pairs), columns=["a", "b"], dtype=object)


def _border(words: DataFrame, depth: int) -> DataFrame:
    """Pairs whose first difference is at the place behind the prefix, as a join by the rest of the word."""
    cut = words.filter(F.length("w") > depth).select("prefix", "w", F.expr(f"substring(w, {depth + 2})").alias("rest"))
    whole = words.select("prefix", "w", F.expr(f"substring(w, {depth + 1})").alias("rest"))
    replaced = cut.alias("x").join(cut.alias("y"), ["prefix", "rest"]).filter("x.w < y.w").select(F.col("x.w").alias("a"), F.col("y.w").alias("b"))
    deleted = cut.alias("x").join(whole.alias("y"), ["prefix", "rest"]).select(F.col("x.w").alias("a"), F.col("y.w").alias("b"))
    return replaced.union(deleted)


def _holes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word (nth): the hashes of all strings with one place deleted, each with the first and last place that leave it
    (a run of one letter), and of the word itself (places -1)."""
    base, back = np.uint64(0xD1342543DE82EF95), np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
    for batch in batches:
        for w, nth in zip(column(batch, "w").to_pylist(), column(batch, "nth").to_pylist(), strict=True):
            letters = np.frombuffer(w.encode("utf-32-le"), "<u4")
            first = np.flatnonzero(np.append(True, letters[1:] != letters[:-1]))
            last = np.append(first[1:], len(letters)) - 1
            power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(letters), base))))
            upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(letters.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)))
            hole = upto[first] + (upto[-1] - upto[first + 1]) * back
            keys = mix(np.append(hole + np.uint64(len(letters) - 1), upto[-1] + np.uint64(len(letters)))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), nth)), pa.array(keys), pa.array(np.append(first, -1)), pa.array(np.append(last, -1))],
                                             ["nth", "key", "first", "last"])


def _long_pairs(words: DataFrame) -> DataFrame:
    """Near pairs of long words. Few words share a key: those that differ at one and the same place."""
    words = written(words.select("w", F.monotonically_increasing_id().alias("nth")), "spelling-long")
    keys = written(words.mapInArrow(_holes, "nth bigint, key bigint, first bigint, last bigint"), "spelling-holes")
    # x has a place deleted; y has one of the same places deleted, or is whole
    same = keys.alias("x").join(keys.alias("y"), "key").filter(
        "x.nth <> y.nth and x.first >= 0 and (y.first < 0 or x.nth < y.nth and x.first <= y.last and y.first <= x.last)")
    same = same.groupBy(F.col("x.nth").alias("a"), F.col("y.nth").alias("b")).agg(F.min(F.struct(F.col("x.first").alias("a"), F.col("y.first").alias("b"))).alias("at"))
    same = same.select("a", "b", F.col("at.a").alias("at_a"), F.col("at.b").alias("at_b"))
    for side in ("a", "b"):
        same = same.join(words.select(F.col("nth").alias(side), F.col("w").alias(f"w_{side}")), side)
    left = {s: F.expr(f"if(at_{s} < 0, w_{s}, concat(substring(w_{s}, 1, int(at_{s})), substring(w_{s}, int(at_{s}) + 2)))") for s in ("a", "b")}
    return same.filter(left["a"] == left["b"]).select(F.col("w_a").alias("a"), F.col("w_b").alias("b"))


def near_pairs(words: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """a, b: all pairs of near words, in both orders. words: a table with distinct words of at least 2 * PREFIX code points."""
    short, found = words.filter(F.length("word") <= LONGEST), []
    # a word of LONGEST + 1 code points may be near one of LONGEST
    found.append(_long_pairs(words.filter(F.length("word") >= LONGEST).select(F.col("word").alias("w"))))
    walked = None
    for way, word in ((0, F.col("word")), (1, F.reverse("word"))):
        todo, depth = short.select(word.alias("w")), PREFIX
        while True:
            todo = todo.select("w", F.substring("w", 1, depth).alias("prefix"))
            sizes = todo.groupBy("prefix").agg(F.count("*").alias("size"))
            sized = todo.join(sizes, "prefix")
            some = sized.filter(F.col("size") <= most_words).select(F.lit(way).alias("way"), "prefix", "w")
            walked = some if walked is None else walked.union(some)
            if sizes.filter(F.col("size") > most_words).isEmpty():
                break
            todo = written(sized.filter(F.col("size") > most_words).select("prefix", "w"), "spelling-large")
            border = _border(todo, depth)
            found.append(border if not way else border.select(F.reverse("a").alias("a"), F.reverse("b").alias("b")))
            depth += 1
    buckets = max(1, -(-words.count() // BUCKET_WORDS))
    bucket = F.pmod(F.xxhash64("prefix"), F.lit(buckets)).cast("int")
    found.append(walked.withColumn("bucket", bucket).groupBy("way", "bucket").applyInPandas(_walked, "a string, b string"))
    both = found[0]
    for more in found[1:]:
        both = both.union(more)
    return written(both.select("a", "b").union(both.select("b", "a")).distinct(), "spelling-pairs")


def group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 2 * PREFIX, occurrences: int = 5, ratio: int = 5,
          planted: int = 0, most_words: int = MOST_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n. planted: runs whose checksum it divides lose a code point first (0: none do)."""
    if least < 2 * PREFIX:
        raise ValueError(f"words need at least {2 * PREFIX} code points")
    words = vocabulary(docs, id_col, text, least, occurrences, planted)
    near = near_pairs(words, most_words).join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = near.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("b_n"), F.col("b").alias("b"))).alias("best"))
    best = best.select(F.col("a").alias("word"), "n_near", F.col("best.b").alias("form"), (-F.col("best.col1")).alias("form_n"))
    formed = words.join(best, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("bigint")))
    strong = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    formed = written(formed.select("word", "n", "n_near", *[F.when(strong, F.col(c)).alias(c) for c in ("form", "form_n")]), "spelling-forms")
    return formed.join(_roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(formed: DataFrame) -> DataFrame:
    """word, root of the words that have a form: a word's pointer jumps to its target's until all targets are roots."""
    at = written(formed.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("on"))
        step = at.join(on, "root", "left")
        if step.filter("on is not null").isEmpty():
            return at
        at = written(step.select("word", F.coalesce("on", "root").alias("root")), "spelling-roots")
