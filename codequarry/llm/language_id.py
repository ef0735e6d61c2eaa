"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The likelihood of a word is the sum over all its
segmentations into pieces, by the forward algorithm, for all languages and many words at once. Probabilities are
estimated by expectation maximisation over the same lattices, on a bounded sample of labelled documents.

Text is lower-cased and cut to runs of letters; a word begins with the vocabulary's word mark. A letter that is no piece has a small
fixed probability, alike in all languages.

Defined cases: a null text, or one without a letter, is `und` with score 0; documents without a label teach nothing; with no labelled
document every text is `und`; equal scores go to the language that sorts first; repeated rows are judged alike; other columns
pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.frames import column, extended, fresh, with_columns
from codequarry.session import written

MARK = "▁"
UNKNOWN = 1e-9
#: Words whose scores a task keeps; the table is emptied when full.
KEPT_WORDS = 300_000
_RUN = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased. The pattern also lets some numerals through, which are no letters."""
    runs = _RUN.findall(text.lower())
    if text.isascii():
        return runs
    runs = (w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in runs)
    return [w for w in runs if w]


def vocabulary(path: str) -> list[str]:
    """Distinct lower-cased pieces of letters (and the word mark) of a sentencepiece file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p.replace(MARK, "").isalpha() and MARK not in p[1:] or p == MARK)


class Lattice:
    """All segmentations of words into pieces, by hashes of code points."""

    def __init__(self, pieces: list[str]):
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        self.order = np.argsort(keys)
        self.keys, self.n = keys[self.order], len(pieces)
        self.longest = max(map(len, pieces))

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c)) % (1 << 64)
        return h

    def numbers(self, words: list[str]) -> np.ndarray:
        """(words, letters, lengths) piece numbers for words of one length; n for an unknown letter, n + 1 for no piece."""
        size = len(words[0])
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size).astype(np.uint64)
        out = np.full((len(words), size, min(self.longest, size)), self.n + 1, np.int32)
        h = np.zeros((len(words), size), np.uint64)
        for k in range(out.shape[2]):
            h = h[:, : size - k] * _BASE + code[:, k:]
            at = np.minimum(np.searchsorted(self.keys, h), self.n - 1)
            hit = self.keys[at] == h
            out[:, : size - k, k] = np.where(hit, self.order[at], self.n + 1 if k else self.n)
        return out

    def forward(self, number: np.ndarray, p: np.ndarray, scaled: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Scaled sums over segmentations of each prefix, (words, letters + 1, languages), and the log of the scale."""
        n, size, most = number.shape
        a = np.zeros((n, size + 1, p.shape[1]))
        a[:, 0] = 1
        log = np.zeros(n)
        for i in range(size):
            if scaled and i and i % 16 == 0:  # before numbers get too small
                top = a[:, i : i + most].max(axis=(1, 2))
                a[:, i : i + most] /= top[:, None, None]
                log += np.log(top)
            for k in range(min(most, size - i)):
                a[:, i + k + 1] += a[:, i] * p[number[:, i, k]]
        return a, log

    def score(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log likelihood of each word under each language."""
        out = np.empty((len(words), p.shape[1]))
        for at, group in _by_length(words):
            a, log = self.forward(self.numbers(group), p)
            out[at] = np.log(np.maximum(a[:, -1], 1e-300)) + log[:, None]
        return out

    def expected(self, words: list[str], times: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in these words, under one language (p has one column)."""
        total = np.zeros(self.n + 2)
        for at, group in _by_length(words, 64):
            number = self.numbers(group)
            n, size, most = number.shape
            a, _ = self.forward(number, p, scaled=False)  # short words only
            b = np.zeros((n, size + 1))
            b[:, size] = 1
            for i in range(size - 1, -1, -1):
                for k in range(min(most, size - i)):
                    b[:, i] += p[number[:, i, k], 0] * b[:, i + k + 1]
            whole = times[at] / np.maximum(b[:, 0], 1e-300)
            for i in range(size):
                for k in range(min(most, size - i)):
                    use = a[:, i, 0] * p[number[:, i, k], 0] * b[:, i + k + 1] * whole
                    total += np.bincount(number[:, i, k], use, minlength=self.n + 2)
        return total[: self.n]


def _by_length(words: list[str], most: int = 0) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Words grouped by length, in groups of bounded size; lengths above `most` are left out where it is given."""
    length = np.array([len(w) for w in words])
    for size in np.unique(length):
        if size and not (most and size > most):
            at = np.flatnonzero(length == size)
            step = max(1, 100_000 // int(size))
            for i in range(0, len(at), step):
                yield at[i : i + step], [words[j] for j in at[i : i + step]]


class Model:
    def __init__(self, languages: list[str], pieces: list[str], p: np.ndarray, prior: np.ndarray):
        self.languages, self.pieces, self.p, self.prior = languages, pieces, p, prior


def train(docs: DataFrame, teaches: Column, vocabulary_path: str, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
          most_docs: int = 300, rounds: int = 3, smooth: float = 0.05) -> Model:
    """Learns from rows where `teaches` holds and lang is not null: at most most_docs documents a language, chosen by a hash of the id.

    The rounds run over a table of distinct words by language; only expected counts (pieces x languages) reach the driver.
    """
    labelled = docs.filter(teaches & F.col(lang).isNotNull() & F.col(text).isNotNull())
    prior = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    languages, pieces = sorted(prior), vocabulary(vocabulary_path)
    if not languages:
        return Model([], pieces, np.zeros((0, 0)), np.zeros(0))
    luck = F.xxhash64(F.col("i").cast("string"))
    chosen = (labelled.select(F.col(id_col).alias("i"), F.col(lang).alias("l"))
              .withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(luck, "i"))).filter(F.col("r") <= most_docs))
    # at most most_docs ids a language
    texts = labelled.join(F.broadcast(chosen.select("i").distinct()), F.col(id_col) == F.col("i"), "left_semi")

    def count(batches):
        for batch in batches:
            seen: dict[str, Counter] = {}
            for t, g in zip(column(batch, text).to_pylist(), column(batch, lang).to_pylist(), strict=True):
                seen.setdefault(g, Counter()).update(words_of(t))
            rows = [(g, w, n) for g, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(
                (("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())))})

    spark = docs.sparkSession
    words = texts.select(F.col(text), F.col(lang)).mapInArrow(count, "lang string, word string, n bigint")
    words = written(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    shared = spark.sparkContext.broadcast(Lattice(pieces))
    p = np.full((len(pieces) + 2, len(languages)), 1 / len(pieces))
    p[-2:] = [[UNKNOWN], [0.0]]
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(p)

        def expect(batches, now=now):
            total = np.zeros((len(languages), len(pieces)))
            for batch in batches:
                group, word, n = column(batch, "lang").to_pylist(), column(batch, "word").to_pylist(), column(batch, "n").to_numpy()
                for i, name in enumerate(languages):
                    at = [j for j, g in enumerate(group) if g == name]
                    if at:
                        total[i] += shared.value.expected([MARK + word[j] for j in at], n[at].astype(float), now.value[:, i : i + 1])
            at = np.argwhere(total > 1e-6)
            yield pa.RecordBatch.from_pydict({"l": pa.array(at[:, 0].astype(np.int32)), "p": pa.array(at[:, 1].astype(np.int32)), "n": pa.array(total[at[:, 0], at[:, 1]])})

        found = words.mapInArrow(expect, "l int, p int, n double").groupBy("l", "p").agg(F.sum("n").alias("n")).toPandas()
        uses = np.full((len(languages), len(pieces)), smooth)
        np.add.at(uses, (found["l"].to_numpy(), found["p"].to_numpy()), found["n"].to_numpy())
        p = np.zeros_like(p)
        p[:-2] = (uses / uses.sum(axis=1, keepdims=True)).T
        p[-2] = UNKNOWN
    share = np.array([prior[x] for x in languages], float)
    return Model(languages, pieces, p, np.log(share / share.sum()))


def predict(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of docs, the likeliest language of each whole text and its posterior probability."""
    lang_pred, score = fresh(docs, lang_pred, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lattice, place, known = Lattice(m.pieces), {}, np.empty((0, len(m.languages)))
        for batch in batches:
            texts = column(batch, text).to_pylist()
            best, odds = ["und"] * len(texts), [0.0] * len(texts)
            for i in range(0, len(texts), 500):
                counts = [Counter(words_of(t or "")) for t in texts[i : i + 500]]
                new = list({w: None for c in counts for w in c if w not in place})
                if len(place) + len(new) > KEPT_WORDS:
                    place, known = {}, np.empty((0, len(m.languages)))
                    new = list({w: None for c in counts for w in c})
                if new and m.languages:
                    place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
                    known = np.concatenate((known, lattice.score([MARK + w for w in new], m.p)))
                for j, c in enumerate(counts):
                    if c and m.languages:
                        at, n = np.fromiter(map(place.__getitem__, c), np.int64, len(c)), np.fromiter(c.values(), float, len(c))
                        total = n @ known[at] + m.prior
                        total = np.exp(total - total.max())
                        top = int(total.argmax())
                        best[i + j], odds[i + j] = m.languages[top], float(total[top] / total.sum())
            yield with_columns(batch, [lang_pred, score], [pa.array(best, pa.string()), pa.array(odds, pa.float64())])

    return docs.mapInArrow(run, extended(docs, f"{lang_pred} string, {score} double"))
