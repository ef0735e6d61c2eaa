"""Kronecker-packed products and mined negatives against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.llm import hard_negatives


@pytest.mark.parametrize("most", [1, 300, 40_000, 1 << 24, 1 << 27])
@pytest.mark.parametrize("shape", [(3, 7, 5), (1, 1, 1), (4, 50, 64), (2, 3, 0), (0, 3, 2), (2, 0, 2)])
def test_products(most, shape):
    m, n, dims = shape
    r = np.random.default_rng(most)
    a, b = r.integers(-most, most + 1, (m, dims)), r.integers(-most, most + 1, (n, dims))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    assert hard_negatives.products(a, b).tolist() == (want if m and n else np.zeros((m, n)).tolist())


def test_products_beyond_long():
    a = np.array([[1 << 62, -(1 << 62)]])
    assert hard_negatives.products(a, np.array([[1 << 62, 0], [0, 1 << 62], [1, 1], [1, 0]])).tolist() == [[2**63 - 1, -(2**63), 0, 1 << 62]]


def test_first_of():
    least = np.iinfo(np.int64).min
    scores = np.array([[3, 5, 5, 1], [7, 7, 7, 7], [least, least, 2, least]])
    line, place = hard_negatives.first_of(scores, 3)
    assert sorted(zip(line.tolist(), place.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 2)]


def brute_force(rows, anchor):
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, label, v in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, la, va in rows:
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, label) for i, label, v in rows if len(v) == len(va) and i != a)
        for p, pid, _ in [s for s in scored if s[2] == la][:5]:
            near = [s for s in scored if s[2] != la and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(a, pid, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(near)]
    return sorted(out)


SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, score string, vec string"


def mined(spark, rows, anchor):
    df = spark.createDataFrame([(i, v, label, "x", "y", "z") for i, label, v in rows], SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hard_negatives.mine(df, anchor, label).collect()))


@pytest.mark.parametrize("rows_block, anchors_block", [(4096, 8192), (16, 3)])
def test_against_loops(spark, monkeypatch, rows_block, anchors_block):
    monkeypatch.setattr(hard_negatives, "ROWS", rows_block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors_block)
    monkeypatch.setattr(hard_negatives, "STEP", 2)
    pick = random.Random(4)
    # few values: many ties; a large share of one vector
    rows = [(i, pick.choice([0, 0, 0, 1, 2, 9]), [pick.choice([-0.5, 0.0, 0.25, 0.75]) for _ in range(4)] if i % 3 else [0.5, 0.5, 0.25, 0.0]) for i in range(160)]
    rows += [(300, None, [1.0] * 4), (301, 1, None), (302, 1, [1.0, None, 0.0, 0.0]), (303, 1, [float("nan")] * 4), (304, 1, [float("inf")] * 4),
             (305, 1, [0.5, 0.5]), (310, 2, [0.5, 0.25]), (320, 1, []), (330, 2, []), (None, 1, [1.0] * 4), (340, 3, [1e6, -1e6, 3e7, 0.0]), (350, 4, [1e6, -1e6, 3e7, 5.0])]
    assert mined(spark, rows, F.col("id") % 10 == 0) == brute_force(rows, lambda i: i % 10 == 0)


def test_repeated_rows_and_empty_table(spark):
    rows = [(10, 0, [1.0]), (10, 0, [1.0]), (1, 0, [1.0]), (1, 0, [1.0]), (2, 1, [0.75]), (2, 1, [0.75])]
    # each of the two anchor rows has two positives, and each of these two negatives of equal score
    got = mined(spark, rows, F.col("id") == 10)
    assert len(got) == 8 and {r[:2] + r[3:] for r in got} == {(10, 1, 2, 256 * 256, 256 * 192)}
    assert mined(spark, [], F.col("id") == 10) == []


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 50)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 20)
    r = np.random.default_rng(5)
    rows = [(i, int(r.integers(6)), [float(np.float32(x)) for x in r.normal(0, 0.3, 6)]) for i in range(1500)]
    rows += [(i, int(r.integers(6)), rows[i % 40][2]) for i in range(1500, 1700)]
    assert mined(spark, rows, F.col("id") % 25 == 0) == brute_force(rows, lambda i: i % 25 == 0)


def test_best_of_many_rounds():
    r = np.random.default_rng(6)
    line, score, ids = r.integers(0, 30, 4000), r.integers(-9, 9, 4000), r.integers(0, 500, 4000)
    best = hard_negatives.Best(31, 4)
    for s in range(0, 4000, 170):
        best.add(line[s : s + 170], score[s : s + 170], ids[s : s + 170])
    got = [x for part in best.kept() for x in zip(*(p.tolist() for p in part), strict=True)]
    want = [(x, i, -s) for x in range(30) for s, i in sorted((-s, i) for y, s, i in zip(line.tolist(), score.tolist(), ids.tolist(), strict=True) if y == x)[:4]]
    assert got == want


def test_a_large_anchor_widens_no_other(monkeypatch):
    kinds, init = [], hard_negatives.Packed.__init__

    def noted(self, *more):
        init(self, *more)
        kinds.append(self.kind)

    monkeypatch.setattr(hard_negatives.Packed, "__init__", noted)
    vec = np.arange(40, dtype=np.int64).reshape(20, 2)
    vec[7, 1] = 1 << 50
    ids, labels = np.arange(20), np.zeros(20, np.int64)
    block = {"block": 0, "n": 20, "dim": 2, "width": 8, "ids": ids.tobytes(), "labels": labels.tobytes(), "vecs": vec.tobytes()}
    cell = hard_negatives._Positives([block], 2, 4)
    cell.meet(ids + 100, labels, np.arange(40, dtype=np.int64).reshape(20, 2))
    assert len(kinds) > 1 and kinds.count(object) == 1
    got = {a: (i, s) for part in cell.found() for a, i, s in zip(*(part.column(c).to_pylist() for c in ("anchor", "id", "score")), strict=True) if i == 119}
    assert got == {a: (119, 38 * int(x) + 39 * int(y)) for a, (x, y) in enumerate(vec)}


def test_nothing_goes_through_the_driver(spark, monkeypatch):
    # the anchors' copies for all slots were broadcast, as Spark takes their size from before they are made
    plans, write = [], hard_negatives.written

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(hard_negatives, "written", lambda df, *more, **named: write(noted(df), *more, **named))
    df = spark.createDataFrame([(i, [i / 100, 1.0 - i / 100], i % 3) for i in range(100)], "vec_id bigint, embedding array<float>, label int")
    noted(hard_negatives.mine(df, F.col("id") % 50 == 0, F.col("label")))
    assert len(plans) > 2 and not [p for p in plans if "Broadcast" in p]
