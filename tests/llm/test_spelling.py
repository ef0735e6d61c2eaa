"""Acceptors, the composition's pairs and the variants of a small corpus against plain loops."""

import random
import re
import zlib
from collections import Counter

import pytest

from codequarry.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n bigint, form string"


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("seed", range(4))
def test_acceptor(seed):
    pick = random.Random(seed)
    words = sorted({"".join(pick.choices("abé", k=pick.randint(1, 6))) for _ in range(120)})
    machine = spelling.Acceptor(words)

    def accepted(state):
        return ({""} if machine.final[state] else set()) | {c + w for c, s in machine.arcs[state].items() for w in accepted(s)}

    languages = [frozenset(accepted(s)) for s in range(len(machine.arcs))]
    assert languages[machine.start] == set(words) and len(set(languages)) == len(languages)  # minimal: no two states alike
    for p in range(0, len(languages), 3):
        for q in range(0, len(languages), 2):
            assert machine.meets(p, q) == bool(languages[p] & languages[q])
            assert sorted(machine.common(p, q)) == sorted(languages[p] & languages[q])
    for prefix in ["", "a", "ab", "éa", "bbb"]:
        want = {frozenset((x, y)) for x in words for y in words if x < y and x.startswith(prefix) and y.startswith(prefix) and near(x[len(prefix):], y[len(prefix):])}
        assert {frozenset(p) for p in machine.pairs(prefix)} == want
    assert spelling.Acceptor([]).start == 0


def test_runs():
    text = "Äpfel ÀBc×÷ÿ naïve x1y Straße漢字abƀGrüße_É ¿Àz Ā̀"
    want = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[A-Za-zÀ-ÿ]+", text)]
    assert [w.decode() for w in spelling.runs(text.encode())] == want
    assert spelling.runs(b"") == []


def brute_force(rows, planted):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if planted and h % planted == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if near(v, w))
        form = others[0][1] if others and -others[0][0] >= 5 * n else None
        out[w] = [form, w, n, len(others), words[form] if form else None]
    for w, row in out.items():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {w: tuple(r) for w, r in out.items()}


def corpus(seed):
    pick = random.Random(seed)
    base = ["".join(pick.choices("abcdeéÿ", k=pick.randint(5, 9))) for _ in range(25)] + ["x" * 240, "y" * (9 if seed else 199)]
    words = []
    for w in base:
        words += [w] * pick.choice([6, 40, 300])
        for _ in range(6):
            at, kind = pick.randrange(len(w) + 1), pick.randrange(3)
            other = w[:at] + pick.choice("abé")[: kind != 1] + w[at + (kind != 0):]
            words += [other] * pick.choice([4, 5, 7, 60])
    words += ["chainaa"] * 6 + ["chainab"] * 60 + ["chaicab"] * 400 + ["chaicabb"] * 2100
    pick.shuffle(words)
    rows = [(i, " ".join(words[i::40])) for i in range(40)]
    return rows + [(100, None), (101, ""), (None, rows[0][1]), rows[1], rows[1], (102, "1 2 漢字")]


@pytest.mark.parametrize("seed, most, planted", [(0, 50_000, 0), (1, 3, 7), (2, 1, 0)])
def test_variants(spark, monkeypatch, seed, most, planted):
    """With small buckets and partitions that must be split, too."""
    if seed:
        monkeypatch.setattr(spelling, "BUCKET_WORDS", 20)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "w", 1, "f") for r in rows], SCHEMA).repartition(3)
    got = spelling.group(df, planted=planted, most_words=most).collect()
    want = brute_force(rows, planted)
    assert len(got) == len(want) > 60
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert planted or {r.word: r.root for r in got}["chainaa"] == "chaicabb"


def test_long_text_and_empty_table(spark):
    long = "z" * 300_000
    rows = [(1, f"{long} {long}a " * 5 + "wörter wortes " * 5)]
    got = {r.word[-3:]: (r.n, r.n_near) for r in spelling.group(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {"zzz": (5, 1), "zza": (5, 1), "ter": (5, 0), "tes": (5, 0)}
    assert spelling.group(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        spelling.group(spark.createDataFrame([], SCHEMA), least=5)
