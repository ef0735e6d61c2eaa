"""Secret scan: candidates from whole texts, and a random forest that removes the false ones.

Candidates are values from 8 characters on: the parts of a blank-free token between quotes, brackets and `& ; , ? #`, so every pair of
minified JSON or of a query string counts by itself; of `key=value` and `key:value` the value, also where blanks or quotes stand
between; the password and the rest of an address with a user; and published key formats wherever they stand inside. A value
needs a digit, an `=` before it, a telling key, or quotes around mixed case and signs. The forest sees its length, classes and transitions of its characters, how likely its letter
pairs are in words, how much of it dictionary words cover (dictionary: the pieces of a fixed public vocabulary), its path, and the
words next to it. It is trained from labelled findings. Where nobody has labelled any, `weak_labels` marks the clear ones: published
key formats and random values under a telling key on one side, addresses, plain numbers and words on the other; the forest decides
on all the rest as well.

Defined cases: a null or empty text has no candidate; without labelled findings of both kinds a finding scores its own label, or 0;
repeated rows give findings each; a missing path column counts as an empty path; null ids are carried along; an empty table
gives no finding; further columns of docs do not matter. Places are counted in characters from 0.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.frames import RowNumbers, column, extended, fresh, with_columns
from codequarry.session import written

LEAST = 8
#: Every pattern reads a text once: a token, a run or a key is entered at its start only and never given back.
_TOKEN = re.compile(r"(?<!\S)[^\s\d=:\"'`]*+[\d=:\"'`]\S*+")
_NEXT = re.compile(r"[^\S\n]{1,40}(\S++)")
_ATOM = re.compile(r"[^\s\"'`&;,?#<>(){}\[\]|]++")
_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*+")
_PAIR = re.compile(r"([A-Za-z_][A-Za-z0-9_.\-]*+)([=:]++)(?!//)")
_QUOTES = "\"'`"
_OPEN, _CLOSE = "\"'`([{<", "\"'`)]}>,;.!?"
#: Words that name secrets, and words that name stand-ins (fixed values).
_TELLING = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "private_key", "credential", "auth")
_STAND_IN = ("example", "sample", "dummy", "test", "placeholder", "changeme", "your", "xxxx", "fake", "demo")
#: Published formats of keys (fixed values).
_FORMATS = re.compile(
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_\-]{35}"
    r"|(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]*+")
_ADDRESS = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?|https?://\S+|\+?[\d().\-/:,%$]+")
_HOST = re.compile(r"(?:[A-Za-z0-9\-]++\.)++[A-Za-z]{2,}+(?::\d++)?(?:/\S*+)?")
_NAME_END = string.ascii_letters + string.digits + "."

FEATURES = ("length", "log_length", "digits", "upper", "lower", "other", "transitions", "entropy", "letter_pairs", "dictionary", "digit_run",
            "hex", "at_sign", "dots", "assigned", "telling_key", "telling_near", "stand_in_near", "stand_in", "test_path", "config_path", "format")


def dictionary(path: str) -> list[str]:
    """Lower-case words of four letters or more among the pieces of a sentencepiece file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    words = {model.id_to_piece(i).strip("▁").lower() for i in range(model.get_piece_size())}
    return sorted(w for w in words if len(w) > 3 and w.isalpha())


class Features:
    """Features of candidates; the letter pairs of the dictionary make the transition table."""

    def __init__(self, words: list[str]):
        self.words, self.longest = set(words), max(map(len, words), default=0)
        self.begins = {w[:4] for w in words}
        pairs = Counter(a + b for w in words for a, b in zip(w, w[1:], strict=False))
        total = sum(pairs.values())
        self.pair = {p: math.log((n + 0.5) / (total + 400)) for p, n in pairs.items()}
        self.rare = math.log(0.5 / (total + 400))

    def covered(self, value: str) -> float:
        """Share of the letters that dictionary words cover, longest first from the left."""
        low, i, hit = value.lower(), 0, 0
        while i < len(low):
            tried = range(min(self.longest, len(low) - i), 3, -1) if low[i : i + 4] in self.begins else ()
            n = next((n for n in tried if low[i : i + n] in self.words), 0)
            hit += n
            i += n or 1
        return hit / max(1, sum(map(str.isalpha, low)))

    def of(self, value: str, key: str, near: str, path: str) -> list[float]:
        n = len(value)
        kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
        count = Counter(kind)
        letters = re.findall(r"[a-z]{2,}", value.lower())
        pairs = [self.pair.get(a + b, self.rare) for w in letters for a, b in zip(w, w[1:], strict=False)]
        key, near, low, path = key.lower(), near.lower(), value.lower(), path.lower()
        return [
            float(min(n, 200)), math.log(n), count["d"] / n, count["u"] / n, count["l"] / n, count["o"] / n,
            sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / n,
            -sum(c / n * math.log2(c / n) for c in Counter(value).values()),
            sum(pairs) / len(pairs) if pairs else self.rare, self.covered(value), max(map(len, re.findall(r"\d+", value)), default=0) / n,
            float(re.fullmatch(r"[0-9a-fA-F]+", value) is not None), float("@" in value), float(value.count(".")), float(bool(key)),
            float(any(w in key for w in _TELLING)), float(any(w in near for w in _TELLING)), float(any(w in near for w in _STAND_IN)),
            float(any(w in low for w in _STAND_IN)), float(any(w in path for w in ("test", "example", "doc", "fixture"))),
            float(path.endswith((".env", ".ini", ".cfg", ".yml", ".yaml", ".json", ".properties", ".toml"))),
            float(_FORMATS.fullmatch(value) is not None)]


def is_address(value: str) -> bool:
    """Mail, network and web addresses, host names, and plain numbers."""
    if value.count("@") == 1:
        name, host = value.split("@")
        stem = host.rstrip(_NAME_END)
        return bool(name) and "." in host[max(1, len(stem)) : -1]
    return _ADDRESS.fullmatch(value) is not None or _HOST.fullmatch(value) is not None


def _telling(key: str) -> bool:
    low = key.lower()
    return any(w in low for w in _TELLING)


def _parts(start: int, value: str, key: str) -> Iterator[tuple[int, str, str, bool]]:
    """(start, value, key, whether admitted as it is): an address without its user and password, and published formats apart from the rest."""
    scheme = value.find("://")
    if scheme >= 0:
        begin = scheme + 3
        end = value.find("/", begin)
        at = value.rfind("@", begin, end if end >= 0 else len(value))
        if at >= 0:
            colon = value.find(":", begin, at)
            if colon >= 0:
                yield start + colon + 1, value[colon + 1 : at], "password", True
            yield start + at + 1, value[at + 1 :], "", False
            return
    done = 0
    for m in _FORMATS.finditer(value):
        yield start + done, value[done : m.start()], key, False
        yield start + m.start(), m[0], key, True
        done = m.end()
    yield start + done, value[done:], key, False


def _values(token: str, at: int, key: str) -> Iterator[tuple[int, str, str, bool]]:
    """(start, value, key, whether admitted without a digit) of a token; a last row without a value holds the key for the next token."""
    place, said = 0, ""
    while m := _ATOM.search(token, place):
        begin, place = m.span()
        atom, quote = m[0], token[begin - 1] if begin and token[begin - 1] in _QUOTES else ""
        if not atom.strip("=:"):  # a sign between a key and its value
            key, said = said, ""
            continue
        if lead := len(atom) - len(atom.lstrip("=:")):
            key, begin, atom = key or said, begin + lead, atom[lead:]
        if quote and key and _telling(key):
            end = token.find(quote, begin)
            place = end if end >= 0 else len(token)
            atom = token[begin:place]
        pair, free = _PAIR.match(atom), bool(key) and _telling(key)
        said = atom if _KEY.fullmatch(atom) else ""
        if pair and not key and atom[pair.end() :].strip("=:"):
            key, begin, atom = pair[1], begin + pair.end(), atom[pair.end() :]
            free = "=" in pair[2] or _telling(key)
        elif pair and not key and pair.end() == len(atom):
            key = pair[1]
            if len(atom) >= 2 * LEAST and len(pair[2]) + len(atom) % 4 <= 2:  # perhaps a padded value
                yield at + begin, atom, "", False
            continue
        elif quote and token[place : place + 1] == quote and len(atom) >= LEAST + 4:
            free = free or not (atom.islower() or atom.isupper() or atom.isalnum())
        for spot, value, name, whole in _parts(begin, atom, key):
            yield at + spot, value, name, free or whole
        key = ""
    yield at + len(token), "", key, False


def candidates(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(start, value, key, words around) of each candidate of a text; they do not overlap."""
    done = 0
    for m in _TOKEN.finditer(text):
        if m.start() < done:
            continue
        token, at, key = m[0], m.start(), ""
        if not token.strip("=:"):
            line = text[max(0, at - 80) : at].rpartition("\n")[2].split()
            key = line[-1].strip(_QUOTES) if line else ""
            key = key if _KEY.fullmatch(key) else ""
        while token:
            kept, alone = key, not token.strip("=:")
            for start, value, name, free in [] if alone else _values(token, at, key):
                kept = name
                bare = value.lstrip(_OPEN)
                start += len(value) - len(bare)
                bare = bare.rstrip(_CLOSE)
                if len(bare) >= LEAST and (free or any(map(str.isdigit, bare))):
                    before = text[max(0, start - 80) : start].split()[-4:]
                    after = text[start + len(bare) : start + len(bare) + 80].split()[:3]
                    yield start, bare, name, " ".join(before + after)
            done = at + len(token)
            following = _NEXT.match(text, done) if kept else None
            token, key = "", kept
            if following:
                token, at = following[1], following.start(1)


def weak_label(value: str, features: list[float]) -> int | None:
    """1 for a clear secret, 0 for a clear other thing, None for what is not clear."""
    f = dict(zip(FEATURES, features, strict=True))
    if f["stand_in"] or is_address(value):
        return 0
    if f["format"]:
        return 1
    if f["dictionary"] > 0.7:
        return None if f["telling_key"] else 0
    if (f["telling_key"] or f["telling_near"]) and f["digits"] > 0 and f["entropy"] >= 2.5 and len(value) >= 12 and not f["at_sign"]:
        return 1
    return 0 if not f["telling_key"] and not f["telling_near"] and f["digits"] < 0.1 else None


def _found(docs: DataFrame, words: list[str], text: str, path: str | None) -> tuple[DataFrame, str, str]:
    """docs with a row number and an array of candidates, written; the names of the two columns."""
    row, spots = fresh(docs, "row_no", "spots")
    shared = docs.sparkSession.sparkContext.broadcast(words)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("value", pa.string()), ("label", pa.int32()), ("features", pa.list_(pa.float64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, features = RowNumbers(), Features(shared.value)
        for batch in batches:
            paths = column(batch, path).cast(pa.string()).to_pylist() if path else [None] * batch.num_rows
            out = []
            for t, p in zip(column(batch, text).to_pylist(), paths, strict=True):
                here = []
                for start, value, key, near in candidates(t or ""):
                    f = features.of(value, key, near, p or "")
                    here.append({"start": start, "length": len(value), "value": value, "label": weak_label(value, f), "features": f})
                out.append(here)
            yield with_columns(batch, [row, spots], [pa.array(numbers.take(batch.num_rows)), pa.array(out, kind)])

    schema = extended(docs, f"{row} bigint, {spots} array<struct<start: bigint, length: bigint, value: string, label: int, features: array<double>>>")
    return written(docs.mapInArrow(run, schema), "secret-candidates", compression="zstd"), row, spots


def train(labelled: DataFrame, most: int = 2000, trees: int = 40, depth: int = 8):
    """A forest from labelled findings (label 0 or 1, features), at most `most` of each label by a hash of the value; None for one label only."""
    picked = labelled.filter(F.col("label").isin(0, 1)).select(F.col("label").cast("double").alias("label"), "features", F.xxhash64("value").alias("luck")).distinct()
    # two rounds: the findings of a label are ranked in slots first, so no task sorts a whole label
    picked = picked.withColumn("slot", F.pmod("luck", F.lit(64)))
    for keys in (["label", "slot"], ["label"]):
        picked = picked.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("luck", "features"))).filter(F.col("r") <= most)
    # at most 2 * most rows, in a fixed order, so that the forest does not depend on the partitions
    picked = written(picked.orderBy("luck", "label").coalesce(1).select("label", array_to_vector("features").alias("x")), "secret-labelled")
    if picked.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=11, probabilityCol="odds").fit(picked)


def score(findings: DataFrame, forest) -> DataFrame:
    """findings and the forest's score."""
    if forest is None:
        return findings.withColumn("score", F.coalesce(F.col("label").cast("double"), F.lit(0.0)))
    return (forest.transform(findings.withColumn("x", array_to_vector("features")))
            .withColumn("score", vector_to_array("odds")[1]).drop("x", "odds", "rawPrediction", "prediction"))


def _rows(found: DataFrame, row: str, spots: str, *keep: str) -> DataFrame:
    return found.filter(F.size(spots) > 0).select(row, *keep, F.explode(spots).alias("s")).select(row, *keep, "s.*")


def scan(docs: DataFrame, vocabulary_path: str, teaches: Column, id_col: str = "doc_id", text: str = "text", path: str | None = "source",
         least_score: float = 0.5) -> DataFrame:
    """Every candidate of every text: id, start, length, value_sha256, score, is_secret. `teaches` picks the rows whose findings train."""
    few = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), *[F.col(path).alias("path")] * bool(path), teaches.alias("teaches"))
    found, row, spots = _found(few, dictionary(vocabulary_path), "text", "path" if path else None)
    findings = _rows(found, row, spots, "id", "teaches")
    out = score(findings, train(findings.filter("teaches")))
    return out.select(F.col("id").alias(id_col), "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", (F.col("score") >= least_score).alias("is_secret"))


def stage(docs: DataFrame, vocabulary_path: str, teaches: Column, text: str = "text", least_score: float = 0.5, mask: str = "[SECRET]") -> DataFrame:
    """All documents; secrets in their texts are replaced by the mask, and n_chars follows."""
    (lesson,) = fresh(docs, "teaches")
    path = "source" if "source" in docs.columns else None
    found, row, spots = _found(docs.withColumn(lesson, teaches), dictionary(vocabulary_path), text, path)
    findings = _rows(found, row, spots, lesson).withColumnRenamed(lesson, "teaches")
    hits = score(findings, train(findings.filter("teaches"))).filter(F.col("score") >= least_score)
    hits = hits.groupBy(F.col(row).alias("of_row")).agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("hits"))
    touched = found.filter(F.size(spots) > 0).join(hits, F.col(row) == F.col("of_row"), "left")
    # walks the secrets from the last to the first, so earlier places stay right
    masked = F.aggregate(F.reverse("hits"), F.col(text), lambda t, h: F.concat(
        F.substring(t, F.lit(1), h["start"].cast("int")), F.lit(mask), F.substring(t, (h["start"] + h["length"] + 1).cast("int"), F.length(t))))
    changed = touched.withColumn(text, F.when(F.col("hits").isNotNull(), masked).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("hits").isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return changed.select(docs.columns).unionByName(found.filter(F.size(spots) == 0).select(docs.columns))
