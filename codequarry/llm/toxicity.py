"""Toxicity with a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w[i] + sum over pairs of v[i] . v[j]), over the distinct hashed terms i, j of the text. The factors v
learn which terms mean something together (an insult with the mention of a group), which added weights cannot. Terms are
words (runs of letters, lower-cased) and their first four, five and six letters, so inflected forms share what is learnt.

Terms are screened before the fit: those stay that tell alone, or together with another (see `train`).
The machine is fitted on a bounded sample of labelled rows (`most_docs` a class, chosen by a hash of the id). All texts are scored whole.

Defined cases: a null or empty text has no terms and scores sigmoid(w0); without labelled rows of both classes every score is the share of
label 1, or 0; rows without a label, or with a null one, teach nothing; repeated rows score alike; other columns pass through;
an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.frames import column, extended, fresh, with_columns
from codequarry.llm.language_id import words_of
from codequarry.session import written

#: Chi-square from which a term counts as telling.
LEAST_CHI = 10.8
#: The same for a pair of terms: p is about 1e-8, as millions of pairs are looked at.
LEAST_PAIR_CHI = 33.0
#: Texts that score this or more count as toxic.
LEAST_SCORE = 0.7
BITS = 18
PREFIXES = (4, 5, 6)
KEPT_WORDS = 400_000


def terms(word: str) -> list[int]:
    """Hashed terms of a word."""
    parts = [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) > n]]
    return [zlib.crc32(p.encode()) & ((1 << BITS) - 1) for p in parts]


class Terms(dict):
    """word -> terms that pass `active`; emptied when full."""

    def __init__(self, active: np.ndarray | None = None):
        self.active = active

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = tuple(t for t in terms(word) if self.active is None or self.active[t])
        return found

    def of(self, text: str | None) -> np.ndarray:
        return np.array(sorted({t for w in set(words_of(text or "")) for t in self[w]}), np.int64)


class Machine:
    """Weights w and factors v of the known terms (their hashes, sorted); all other terms have none."""

    def __init__(self, w0: float, known: np.ndarray, w: np.ndarray, v: np.ndarray):
        active = (np.abs(w) > 1e-3) | (np.abs(v).max(axis=1, initial=0) > 1e-2)
        self.w0, self.known, self.w, self.v = w0, known[active], w[active], v[active]
        self.active = np.zeros(1 << BITS, bool)
        self.active[self.known] = True

    def score(self, at: np.ndarray) -> float:
        at = np.searchsorted(self.known, at[self.active[at]])
        v = self.v[at]
        x = self.w0 + self.w[at].sum() + 0.5 * float(((v.sum(axis=0)) ** 2 - (v * v).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def fit(rows: list[np.ndarray], labels: np.ndarray, known: np.ndarray, factors: int = 8, epochs: int = 8, least_steps: int = 2000,
        rate: float = 0.1, decay: float = 1e-4, batch: int = 64, seed: int = 7) -> Machine:
    """Minibatch AdaGrad on the logistic loss, over the known terms."""
    size, random = 1 << BITS, np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return Machine(40.0 if share else -40.0, known[:0], np.zeros(0), np.zeros((0, factors)))
    number = np.full(size, -1)
    number[known] = np.arange(len(known))
    rows = [number[r][number[r] >= 0] for r in rows]
    w_, v_ = np.zeros(len(known)), random.normal(0, 0.01, (len(known), factors))
    gw, gv, w0, g0 = np.full(len(known), 1e-6), np.full(v_.shape, 1e-6), float(np.log(share / (1 - share))), 1e-6
    for _ in range(max(epochs, -(-least_steps * batch // len(rows)))):
        for part in np.array_split(random.permutation(len(rows)), max(1, len(rows) // batch)):
            at = np.concatenate([rows[i] for i in part])
            doc = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            vs = v_[at]
            total = np.zeros((len(part), factors))
            np.add.at(total, doc, vs)
            x = w0 + np.bincount(doc, w_[at] + 0.5 * ((total[doc] - vs) * vs).sum(axis=1), minlength=len(part))
            error = (1 / (1 + np.exp(-np.clip(x, -40, 40))) - labels[part]) * (1 + labels[part]) / len(part) ** 0.5  # label 1 counts double
            terms_in, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, error[doc]) + decay * w_[terms_in]
            dv = np.zeros((len(terms_in), factors))
            np.add.at(dv, back, error[doc][:, None] * (total[doc] - vs))
            dv += decay * v_[terms_in]
            gw[terms_in] += dw**2
            gv[terms_in] += dv**2
            w_[terms_in] -= rate * dw / np.sqrt(gw[terms_in])
            v_[terms_in] -= 0.2 * rate * dv / np.sqrt(gv[terms_in])
            g0 += error.sum() ** 2
            w0 -= rate * error.sum() / g0**0.5
    return Machine(w0, known, w_, v_)


def telling_pairs(rows: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, least_chi: float = LEAST_PAIR_CHI, block: int = 256) -> np.ndarray:
    """Terms (of the sorted `terms`) that tell something together with another one of them, whether or not they do alone.

    For each pair the four shares of label 1 (neither, one, the other, both) are compared: the pair tells if their log odds do not
    add up, by a chi-square of one degree of freedom. Counts are products of the 0/1 matrix of texts and terms, a block of terms at a time.
    """
    if not len(terms) or not len(rows):
        return terms[:0]
    has = np.zeros((len(rows), len(terms)), np.float32)
    for i, r in enumerate(rows):
        has[i, np.searchsorted(terms, r[np.isin(r, terms)])] = 1
    said, n, yes = has * labels[:, None].astype(np.float32), len(rows), labels.sum()
    seen, seen_yes, telling = has.sum(axis=0), said.sum(axis=0), np.zeros(len(terms), bool)
    for at in range(0, len(terms), block):
        part = slice(at, at + block)
        both, both_yes = has[:, part].T @ has, said[:, part].T @ has
        one, one_yes = seen[part, None] - both, seen_yes[part, None] - both_yes
        other, other_yes = seen[None] - both, seen_yes[None] - both_yes
        none, none_yes = n - one - other - both, yes - one_yes - other_yes - both_yes
        apart, spread = 0.0, 0.0
        for sign, total, ones in ((1, both, both_yes), (-1, one, one_yes), (-1, other, other_yes), (1, none, none_yes)):
            apart = apart + sign * np.log((ones + 0.5) / (total - ones + 0.5))
            spread = spread + 1 / (ones + 0.5) + 1 / (total - ones + 0.5)
        telling[part] |= (apart**2 / spread >= least_chi).any(axis=1)
    return terms[telling]


def train(docs: DataFrame, labels: DataFrame, teaches: Column, text: str = "text", id_col: str = "doc_id", label: str = "toxic",
          most_docs: int = 6000, pair_terms: int = 2048) -> Machine:
    """teaches: a column over the labels' id. Only what the machine has learnt reaches the driver.

    Screening keeps terms that say something about the label by chi-square with Yates's correction, p = 0.001, and of the
    `pair_terms` most balanced terms of the sample (nearest to half of the texts) those that tell together with another one.
    """
    known = labels.filter(teaches & F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y"))
    known = known.groupBy("i").agg(F.max("y").alias("y"))
    luck = F.xxhash64(F.col("i").cast("string"))
    # two rounds: the rows of a class are ranked in slots first, so no task sorts a whole class
    chosen = known.withColumn("luck", luck).withColumn("slot", F.pmod("luck", F.lit(64)))
    for keys in (["y", "slot"], ["y"]):
        chosen = chosen.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("luck", "i"))).filter(F.col("r") <= most_docs)
    chosen = chosen.select("i", "y")
    texts = docs.select(F.col(id_col).alias("d"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("d") == F.col("i")).select("i", "t", "y")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Terms()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [column(batch, "i").cast(pa.string()), column(batch, "y"), pa.array([table.of(t) for t in column(batch, "t").to_pylist()], pa.list_(pa.int64()))],
                ["i", "y", "terms"])

    rows = written(texts.mapInArrow(hashed, "i string, y int, terms array<bigint>"), "toxicity-terms")
    n, yes = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    seen = written(rows.select("y", F.explode("terms").alias("t")).groupBy("t").agg(
        F.count("*").cast("double").alias("seen"), F.sum("y").cast("double").alias("both")), "toxicity-seen")
    apart = F.greatest(F.lit(0.0), F.abs(n * F.col("both") - F.col("seen") * yes) - n / 2)
    chi = n * apart * apart / F.greatest(F.lit(1.0), F.col("seen") * (n - F.col("seen")) * float(yes * (n - yes)))
    known = np.array(sorted(r["t"] for r in seen.filter(chi >= LEAST_CHI).select("t").collect()), np.int64)
    balanced = seen.filter((F.col("seen") >= 5) & (F.col("seen") < n)).orderBy(F.least("seen", n - F.col("seen")).desc(), "t").limit(pair_terms)
    pairs = np.array(sorted(r["t"] for r in balanced.select("t").collect()), np.int64)
    looked_at = np.union1d(known, pairs)

    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = [r[np.isin(r, looked_at)].astype(np.int32).tobytes() for r in (x.values.to_numpy() for x in column(batch, "terms"))]
            yield pa.RecordBatch.from_arrays([column(batch, "i"), column(batch, "y"), pa.array(few, pa.binary())], ["i", "y", "terms"])

    def fitted(sample: pd.DataFrame) -> pd.DataFrame:
        kept = sample.sort_values(["i", "terms"])
        rows, labels = [np.frombuffer(r, np.int32) for r in kept["terms"]], kept["y"].to_numpy(float)
        m = fit(rows, labels, np.union1d(known, telling_pairs(rows, labels, pairs)))
        return pd.DataFrame({"w0": [m.w0], "known": [m.known.tobytes()], "w": [m.w.tobytes()], "v": [m.v.tobytes()]})

    # the sample is bounded, so one task fits the machine; the driver gets what it has learnt
    found = rows.mapInArrow(screened, "i string, y int, terms binary").groupBy().applyInPandas(fitted, "w0 double, known binary, w binary, v binary").first()
    if found is None:
        return fit([], np.zeros(0), known)
    w = np.frombuffer(found["w"])
    return Machine(found["w0"], np.frombuffer(found["known"], np.int64), w, np.frombuffer(found["v"]).reshape(len(w), -1) if len(w) else np.zeros((0, 1)))


def score(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of docs and the score."""
    (out,), shared = fresh(docs, out), docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        table = Terms(machine.active)
        for batch in batches:
            yield with_columns(batch, [out], [pa.array([machine.score(table.of(t)) for t in column(batch, text).to_pylist()], pa.float64())])

    return docs.mapInArrow(run, extended(docs, f"{out} double"))
