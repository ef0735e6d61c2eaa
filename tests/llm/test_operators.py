"""Edge cases and brute-force comparisons of the training-data operators on small tables."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codequarry.llm import bpe, chat, graph, jaccard_join, language_id, line_quality, packing, permutation_index, secret_scan, substring_dedup, toxicity
from codequarry.llm.frames import held_out, table
from codequarry.llm.graph import components
from codequarry.llm.queries import CHECKS, QUERIES, vocabulary
from codequarry.session import written
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"
JSON = vocabulary("byte_bpe_50k.json")
PIECES = vocabulary("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_no string, score string, ids string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def edge_texts():
    pick = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(pick.choices(words, k=3000))
    passage = " ".join(pick.choices(words, k=60))
    near = passage.split()
    near[3] = "changed"
    return [None, "", " \n\t ", "a", "A b C d", "a b c d", "a " * 90, long, long + " end", passage, passage, " ".join(near),
            f"start {passage} stop", f"other\xa0{passage}\x85 tail", "x" * 5000, "é" * 3000 + " 漢字 <|endoftext|> 🙂", "line\nline\n\nLine  \n other",
            'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" mail a.b1@mail.example.com 11.22.33.44 password=b7db7aa4a5fcc78305']


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"src{i % 2}", len(t or ""), "r", "s", "i") for i, t in enumerate(edge_texts())]
    rows += [rows[7], (None, "no id here", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_substring_dedup(docs, none):
    out = substring_dedup.remove_repeats(docs)
    want = substring_dedup.brute_force(texts_of(docs))
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_words"]) for r in out.collect())
    assert got == Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.n_words, r.n_removed, r.kept) for r in want.itertuples())
    assert set(docs.columns) < set(out.columns) and substring_dedup.remove_repeats(none).count() == 0
    assert substring_dedup.stage(docs).columns == docs.columns


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_random(spark, seed):
    pick = random.Random(seed)
    parts = [" ".join(pick.choices("abcd", k=pick.randint(20, 60))) for _ in range(6)]
    rows = [(i, " ".join(pick.choices(parts, k=pick.randint(1, 3)) + pick.choices("xyz", k=pick.randint(0, 9)))) for i in range(40)]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), window=12)
    want = {r.doc_id: (r.n_removed, r.kept) for r in substring_dedup.brute_force(rows, 12).itertuples()}
    assert {r["doc_id"]: (r["n_removed"], r["kept_words"]) for r in out.collect()} == want


def test_jaccard(docs, none):
    rows = [r for r in texts_of(docs) if r[0] is not None]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(docs).collect() if r["doc_id"] is not None}
    assert got == jaccard_join.brute_force(list(dict(rows).items()))
    assert jaccard_join.link(none).count() == 0
    kept = jaccard_join.stage(docs)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted({c if n else i for i, (n, c) in got.items()})


def test_jaccard_large_group_of_near_copies(spark):
    """Star rounds contract most of the group; the links that they leave are found across components."""
    random = np.random.default_rng(5)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(f"x{i}" if k in set(random.integers(0, 60, i % 3)) else w for k, w in enumerate(base))) for i in range(90)]
    rows += [(100 + i, " ".join([*base[:20], *(f"y{i}_{k}" for k in range(40))])) for i in range(30)]
    out = jaccard_join.link(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == jaccard_join.brute_force(rows)


def test_jaccard_all_links(spark, monkeypatch):
    """Links inside a component are found as well, also where a list is cut into blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 7, raising=False)
    pick, rows = random.Random(8), []
    base = [f"w{k}" for k in range(120)]
    for i in range(40):
        words = [w if pick.random() > 0.012 else f"{w}.{i}" for w in base]
        rows.append((i, " ".join(words)))
    rows += [(50, rows[3][1]), (51, "quite another text of some words")]
    sets = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in rows}
    least = {}
    for i, s in sorted(sets.items()):
        least.setdefault(s, i)
    want = {(i, j) for s, i in least.items() for t, j in least.items() if i < j and 100 * len(s & t) >= 80 * len(s | t)}
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert len(want) > 40
    assert sorted(tuple(sorted(r)) for r in jaccard_join.links(df).collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_chains(spark, seed):
    pick, rows = random.Random(seed), []
    for g in range(12):  # variants of variants: links that only a chain joins
        words = [f"{g}.{k}" for k in range(pick.randint(5, 90))]
        for _ in range(pick.randint(1, 9)):
            words = [w if pick.random() > 0.015 else f"{w}'" for w in words]
            rows.append((len(rows), " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == jaccard_join.brute_force(rows)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_components_end_with_stars(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "written", lambda df, name: (rounds.append(name), written(df, name))[1])
    links = spark.createDataFrame([(0, i) for i in range(1, 30)] + [(50, 60)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in graph.components(links).collect()}
    assert got == dict.fromkeys(range(30), 0) | {50: 50, 60: 50}
    assert len(rounds) == 1  # links are not stored again, and no round is spent to see that nothing changes


def _least_reached(links):
    root = {x: x for link in links for x in link if link[0] != link[1]}
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("at_once", [0, 3, 64, graph.AT_ONCE])
def test_components_of_any_size(spark, at_once):
    """Contracted by one task, by partitions first, or by star rounds: the same roots."""
    pick = random.Random(at_once)
    links = [(i, i + 1) for i in range(0, 25)] + [(500 - i, 499 - i) for i in range(25)] + [(900, 800 + i) for i in range(25)]
    links += [(pick.randrange(1000, 1060), pick.randrange(1000, 1060)) for _ in range(40)] + [(7, 7)] + [(-5, 1 << 40)] * 2
    pick.shuffle(links)
    got = components(spark.createDataFrame(links, "a bigint, b bigint").repartition(5), at_once).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["root"] for r in got} == _least_reached(links)
    assert components(spark.createDataFrame([], "a bigint, b bigint"), at_once).count() == 0


def test_components_of_few_links_take_no_rounds(spark, monkeypatch):
    """A path needs several star rounds, each with joins and files; one task contracts as few links as these."""
    rounds = []
    monkeypatch.setattr(graph, "written", lambda df, name: (rounds.append(name), written(df, name))[1])
    got = graph.components(spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint").repartition(7))
    assert {r["node"]: r["root"] for r in got.collect()} == dict.fromkeys(range(301), 0)
    assert rounds == ["links"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_parities_bound_the_difference(seed):
    draw = np.random.default_rng(seed)
    for _ in range(100):
        pool = draw.integers(0, 1 << 63, size=draw.integers(1, 900), dtype=np.uint64)
        x, y = (np.unique(draw.choice(pool, draw.integers(1, len(pool) + 1))) for _ in "xy")
        apart = sum(int(w).bit_count() for w in (jaccard_join._parities(x) ^ jaccard_join._parities(y)).view(np.uint64))
        assert apart <= len(np.setxor1d(x, y))


def test_jaccard_group_below_the_threshold(spark, monkeypatch):
    """Texts that share most of their rare words but do not link: few pairs reach the exact comparison, and labels meet rows, not postings."""
    stored, pick = {}, random.Random(3)
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: stored.setdefault(name, []).append(df) or written(df, name))
    words = [f"w{k}" for k in range(150)]
    rows = [(i, " ".join(w if pick.random() > 0.04 else f"{w}.{i}" for w in words)) for i in range(80)]
    rows += [(100 + i, " ".join(words[:140] + [f"x{i}"])) for i in range(5)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == jaccard_join.brute_force(rows)
    assert sum(df.count() for df in stored["jaccard-near"]) < 80 * 79 / 4
    for df in stored["jaccard-labelled"]:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate explode(p") < plan.index("Join LeftOuter")  # the join stands below


def test_bpe(docs, none):
    whole = bpe.Tokenizer.from_file(JSON)
    ids = bpe.encode(docs, JSON)
    for r in bpe.decode(ids, JSON, ids="_ids").collect():
        assert r["_ids"] == whole.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "")
    for r in bpe.digests(docs.select("doc_id", "text"), JSON).collect():
        text = dict(texts_of(docs))[r["doc_id"]] or ""
        want = whole.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), sha(",".join(map(str, want))), sha(text))
    assert bpe.digests(none, JSON).count() == 0


@pytest.mark.parametrize("letters", ["a", "ab", "the", "漢字é", "🙂a", "-=#", "xyz'"])
def test_tree_concatenation(letters):
    pick, own, whole = random.Random(letters), bpe.Encoder(bpe.tokenizer_text(JSON), leaf=16), bpe.Tokenizer.from_file(JSON)
    for n in (17, 100, 999):
        text = "".join(pick.choices(letters, k=n))
        assert own.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_tasks_of_a_worker_share_an_encoder():
    text = bpe.tokenizer_text(JSON)
    assert bpe.encoder(text) is bpe.encoder(bpe.tokenizer_text(JSON))


def test_packing(docs, none):
    out = packing.pack(docs, JSON, with_ids=True).toPandas()
    by = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by["length"].sum() <= 1024).all()
    assert all((g["offset"] == g["length"].cumsum() - g["length"]).all() for _, g in by)
    assert out["sequence_id"].nunique() == -(-out["length"].sum() // 1024)
    own, want = bpe.Encoder(bpe.tokenizer_text(JSON)), Counter()
    for i, t in texts_of(docs):
        want[(i if i is not None else -1, tuple([*own.encode(t).tolist(), 2]))] += 1
    got, held = Counter(), {}
    for r in out.fillna({"doc_id": -1}).sort_values(["doc_id", "start"]).itertuples():
        held.setdefault(r.doc_id, []).append(r)
    for i, rows in held.items():
        copies = sum(r.start == 0 for r in rows)
        for c in range(copies):
            got[(i, tuple(x for r in rows[c::copies] for x in r.ids))] += 1
    assert got == want
    assert all(len(r["ids"]) <= 1024 for r in packing.sequences(packing.pack(docs, JSON, with_ids=True)).collect())
    assert packing.pack(none, JSON).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    pick = random.Random(seed)
    counts = dict(Counter(pick.randint(1, 50) for _ in range(pick.randint(1, 80))))
    fills = packing.plan(counts, 50)
    held = Counter()
    for fill, times in fills.items():
        assert sum(n * k for n, k in fill) <= 50
        held.update({n: k * times for n, k in fill})
    assert held == Counter(counts) and packing.lower_bound(counts, 50) <= fills.total() <= packing.best_fit(counts, 50).total()


def fewest_bins(lengths, size):
    """The least number of bins and the room left in the last, over all subsets of pieces."""
    best = {0: (1, size)}
    for chosen in range(1, 1 << len(lengths)):
        options = []
        for i, n in enumerate(lengths):
            if chosen >> i & 1:
                bins, room = best[chosen ^ 1 << i]
                options.append((bins, -(room - n)) if room >= n else (bins + 1, -(size - n)))
        bins, room = min(options)
        best[chosen] = (bins, -room)
    return best[(1 << len(lengths)) - 1][0]


@pytest.mark.parametrize("seed", range(12))
def test_packing_is_least(seed):
    pick = random.Random(seed)
    lengths = [pick.randint(2, 14) for _ in range(pick.randint(6, 11))]
    assert packing.plan(dict(Counter(lengths)), 20).total() == fewest_bins(lengths, 20)


def test_packing_beats_best_fit():
    ahead = 0
    for seed in range(12):
        pick, lengths = random.Random(seed), []
        for _ in range(15):  # full sequences of three pieces
            a, b = sorted(pick.sample(range(10, 90), 2))
            lengths += [a, b - a, 100 - b]
        counts = dict(Counter(lengths))
        assert packing.plan(counts, 100).total() == 15
        ahead += packing.best_fit(counts, 100).total() > 15
    assert ahead


def test_fillings_are_all_undominated():
    pick = random.Random(3)
    for _ in range(30):
        counts = {n: pick.randint(1, 3) for n in pick.sample(range(2, 20), 6)}
        first, want = max(counts), set()
        for ks in itertools.product(*[range(c + 1) for c in counts.values()]):
            f = {n: k for n, k in zip(counts, ks, strict=True) if k}
            waste = 24 - sum(n * k for n, k in f.items())
            others = {n for n, k in f.items() if k - (n == first) > 0}
            spare = {n for n in counts if counts[n] > f.get(n, 0)}
            if f.get(first) and 0 <= waste <= 9 and not any(m <= waste or any(n < m <= n + waste for n in others) for m in spare):
                want.add(tuple(sorted(f.items(), reverse=True)))
        got = list(packing.fillings(counts, 24, 9))
        assert set(got) == want and len(got) == len(want)


def test_language(spark, docs, none):
    real = table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.train(real, ~held_out("doc_id"), PIECES)
    out = language_id.predict(real, model).filter(held_out("doc_id"))
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    edge = {r["doc_id"]: (r["lang_pred"], r["_score"]) for r in language_id.predict(docs, model).collect()}
    assert edge[0] == edge[1] == edge[2] == ("und", 0.0) and all(0 <= s <= 1 for _, s in edge.values())
    unlabelled = language_id.train(none, ~held_out("doc_id"), PIECES)
    assert {r["lang_pred"] for r in language_id.predict(docs, unlabelled).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    lattice, p = language_id.Lattice(["a", "b", "ab", "aba"]), np.array([[0.1], [0.2], [0.3], [0.15], [1e-9], [0.0]])
    want = 0.1 * 0.2 * 0.1 + 0.3 * 0.1 + 0.15
    assert np.exp(lattice.score(["aba"], p))[0, 0] == pytest.approx(want)
    assert np.exp(lattice.score(["az"], p))[0, 0] == pytest.approx(0.1 * 1e-9)


def test_toxicity(spark, docs, none):
    real, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    machine = toxicity.train(real, labels, ~held_out("doc_id"))
    out = toxicity.score(real, machine).filter(held_out("doc_id")).join(labels, "doc_id").toPandas()
    said = out["score"] >= toxicity.LEAST_SCORE
    assert out["toxic"][said].mean() > 0.85 and said[out["toxic"] == 1].mean() > 0.6
    assert all(0 <= r["_score"] <= 1 for r in toxicity.score(docs, machine).collect())
    empty = toxicity.train(none, labels.limit(0), ~held_out("doc_id"))
    assert toxicity.score(docs, empty).filter("_score > 0.01").count() == 0


def test_factors_learn_pairs():
    pick = random.Random(1)
    words = {t: toxicity.terms(t)[0] for t in ("insult", "group", *"abcdefgh")}
    rows, labels = [], []
    for _ in range(1500):
        has = [pick.random() < 0.5 for _ in range(2)]
        names = [n for n, h in zip(("insult", "group"), has, strict=True) if h] + pick.sample("abcdefgh", 3)
        rows.append(np.array(sorted(words[n] for n in names)))
        labels.append(float(has[0] == has[1]))  # no single term says anything
    machine = toxicity.fit(rows, np.array(labels), np.unique(np.concatenate(rows)), epochs=40, rate=0.2)
    right = [(machine.score(r) > 0.5) == (y > 0.5) for r, y in zip(rows, labels, strict=True)]
    assert np.mean(right) > 0.95


def test_pairs_pass_the_screen(spark):
    pick, docs, labels = random.Random(5), [], []
    for i in range(3000):
        has = [pick.random() < 0.5 for _ in range(2)]
        words = [n for n, h in zip(("zork", "people"), has, strict=True) if h] + [f"w{pick.choice('abcdefghijkl')}x" for _ in range(6)]
        docs.append((i, " ".join(pick.sample(words, len(words)))))
        labels.append((i, int(has[0] == has[1])))  # neither word says anything alone
    texts = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    machine = toxicity.train(texts, spark.createDataFrame(labels, "doc_id BIGINT, toxic INT"), ~held_out("doc_id"))
    known = toxicity.Terms()
    y = dict(labels)
    right = []
    for r in toxicity.score(texts, machine, out="s").filter(held_out("doc_id")).collect():
        at = known.of(r["text"])
        at = np.searchsorted(machine.known, at[machine.active[at]])
        x = machine.w0 + sum(machine.w[a] for a in at)  # the sum over pairs, as it is defined
        x += sum(float(machine.v[a] @ machine.v[b]) for n, a in enumerate(at) for b in at[:n])
        assert r["s"] == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-9)
        right.append((r["s"] > 0.5) == (y[r["doc_id"]] == 1))
    assert len(right) > 800 and np.mean(right) >= 0.95


def test_chat(spark):
    rows = [(1, 1, "user", "a<|im_end|>b"), (1, 0, "system", None), (1, 2, "assistant", r"<\|x <|im_start|>" + "y" * 900), (1, 2, "assistant", "again"),
            (None, None, None, None), (2, 5, "ro%le\n<|x", "<"), (2, 6, "assistant", ""), (2, 6, "assistant", "")]
    conv = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, seq string")
    out = chat.formatted(chat.event_log(conv))
    back = {}
    for r in sorted(chat.read_back(out).collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"], r["place"])):
        back.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["loss"]))
    assert back[1] == [("system", "", None), ("user", "a<|im_end|>b", None), ("assistant", rows[2][3], rows[2][3]), ("assistant", "again", "again")]
    assert back[None] == [("", "", None)] and back[2] == [("ro%le\n<|x", "<", None), ("assistant", "", ""), ("assistant", "", "")]
    for r in out.collect():
        spans = "".join(r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"])
        assert "<|" not in spans
    assert chat.formatted(chat.event_log(conv.limit(0))).count() == 0


def test_fold_edits_and_regenerations(spark):
    log = [(1, 0, 1, 0, "open", "user", None), (1, 0, 1, 1, "delta", None, "x"), (1, 0, 1, 2, "edit", None, "y"), (1, 0, 1, 3, "delta", None, "z"),
           (1, 1, 1, 0, "open", "assistant", None), (1, 1, 1, 1, "delta", None, "bad"), (1, 1, 1, 2, "regenerate", None, None), (1, 1, 1, 4, "delta", None, "d"), (1, 1, 1, 3, "delta", None, "goo")]
    df = spark.createDataFrame(log, "conv_id bigint, turn bigint, copy int, seq int, kind string, role string, text string")
    assert {(r["turn"], r["role"], r["text"]) for r in chat.fold(df).collect()} == {(0, "user", "yz"), (1, "assistant", "good")}


def test_line_quality(docs, none):
    import re

    got = Counter()
    for r in line_quality.judge(docs).collect():
        got[(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])] += 1
    want = Counter()
    for i, t in texts_of(docs):
        words, seen = re.findall(r"[^\x20\x09-\x0D]+", t or ""), {}
        for s in range(len(words) - 7):
            seen.setdefault(tuple(words[s : s + 8]), []).append(s)
        covered = {s + k for v in seen.values() if len(v) > 1 for s in v for k in range(8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[(i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))] += 1
    assert got == want and line_quality.judge(none).count() == 0 and line_quality.clean(docs).columns == docs.columns


def test_boilerplate_lines(spark):
    common, body = "all rights reserved by the host", " ".join(f"word{k}" for k in range(30))
    rows = [(i, f"{body} {i}\n{common.upper() if i % 2 else common}", "h") for i in range(30)] + [(99, "\n".join([common] * 4), "h"), (100, f"{common}\n{body} z", "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = {r["doc_id"]: (r["n_removed_words"], r["kept"]) for r in line_quality.judge(docs).collect()}
    assert out[0] == out[1] == (6, True) and out[99] == (24, False) and out[100] == (0, True)
    text = {r["doc_id"]: r["text"] for r in line_quality.clean(docs).collect()}
    assert text[0] == f"{body} 0" and text[100] == rows[-1][1] and 99 not in text


def test_boilerplate_by_count_or_share(spark):
    """A footer below the share of a large host goes by its count, one of a small host by its share; copies count each."""
    def body(i):
        return " ".join(f"{i}.{k}" for k in range(30))

    rows = [(i, body(i) + ("\nfooter of a large host" if i < 12 else ""), "large") for i in range(200)]
    rows += [(200 + i, f"{body(200)}\ncopied line", "large") for i in range(11)]
    rows += [(300 + i, body(300 + i) + ("\nfooter of a small host" if i < 2 else ""), "small") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = {r["doc_id"]: r["n_removed_words"] for r in line_quality.judge(docs).collect()}
    assert out == {i: 5 if i < 12 or i in (300, 301) else 32 if 200 <= i < 211 else 0 for i, _, _ in rows}


def test_secrets(spark, docs, none):
    def secrets(df):
        return secret_scan.scan(df, PIECES, F.lit(True))

    found = [r for r in secrets(docs).collect() if r["doc_id"] == 17]
    text = edge_texts()[17]
    spans = {text[r["start"] : r["start"] + r["length"]]: r["is_secret"] for r in found}
    assert spans == {"24be64439e3e49cf46b2d7c90f3602a3d0b907ff": True, "b7db7aa4a5fcc78305": True, "a.b1@mail.example.com": False, "11.22.33.44": False}
    masked = {r["doc_id"]: r["text"] for r in secret_scan.stage(docs, PIECES, F.lit(True)).collect()}
    assert masked[17] == 'token = "[SECRET]" mail a.b1@mail.example.com 11.22.33.44 password=[SECRET]' and masked[9] == edge_texts()[9]
    assert secrets(none).count() == 0 and secret_scan.stage(none, PIECES, F.lit(True)).columns == docs.columns


def test_nearest(spark):
    random_ = np.random.default_rng(3)
    v = random_.normal(size=(400, 8)) * random_.uniform(0.5, 2, (400, 1))
    rows = [(i, [float(x) for x in r], "e") for i, r in enumerate(v)] + [(1000 + i, [float(x) for x in v[0]], "e") for i in range(60)]
    rows += [(2000, None, "e"), (2001, [0.0] * 8, "e"), (2002, [float("nan")] * 8, "e"), (2003, [None] * 8, "e"), (2004, [1.0], "e"), (None, [1.0] * 8, "e"), (0, rows[0][1], "e")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, vec string")
    got = permutation_index.search(df, F.col("id") % 20 == 0).toPandas()
    ids = np.array([*range(400), *range(1000, 1060)])
    all_v, hits, total = np.array([*v, *[v[0]] * 60]), 0, 0
    for q in ids[ids % 20 == 0]:
        score = (all_v * all_v[ids == q][0]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:20]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and (np.diff(mine["score"]) <= 0).all()
        hits, total = hits + len(set(ids[order]) & set(mine["vec_id"])), total + 20
        if q in (0, 1000):
            assert mine["vec_id"].tolist()[:3] == sorted({0, 1000, 1001, 1002} - {q})[:3] or score.max() > score[ids == q][0]
    assert hits / total >= 0.9
    assert permutation_index.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_nearest_of_unequal_norms(spark):
    """Recall holds where a query sees few files and norms differ."""
    random_ = np.random.default_rng(4)
    v = random_.normal(size=(16000, 64))
    v *= (random_.lognormal(0, 0.5, 16000) / np.linalg.norm(v, axis=1))[:, None]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = permutation_index.search(df, F.col("id") % 400 == 0).toPandas().groupby("query_id")["vec_id"].agg(set)
    hits = 0
    for q in range(0, 16000, 400):
        order = np.argsort(-(v @ v[q]))
        hits += len(got[q] & set(order[order != q][:20].tolist()))
    assert hits / (40 * 20) >= 0.95


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_check_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), duck(SF), CHECKS[name])[0] is None


def test_pipeline(spark):
    """Each stage against plain Python over what the stage before it kept."""
    docs, counts = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
            counts.append(len(after))
        if name == "ngram_jaccard":
            assert set(after) == {c if n else i for i, (n, c) in jaccard_join.brute_force(list(before.items())).items()}
        if name == "substring_dedup":
            want = {r.doc_id: r for r in substring_dedup.brute_force(list(before.items())).itertuples()}
            assert after == {i: (want[i].kept if want[i].n_removed else t) for i, t in before.items()}
        docs = out
    own = bpe.Encoder(bpe.tokenizer_text(JSON))
    assert docs.groupBy("doc_id").agg(F.sum("length").alias("n")).count() == counts[-1]
    assert {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {i: len(own.encode(t)) + 1 for i, t in after.items()}
