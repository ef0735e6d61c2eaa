"""Ranks of the permutation index against the plain footrule distance, and files by norm."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.llm import permutation_index as pi


def footrule(a, b, size):
    """Sum over all pivots of the difference of places; an absent pivot stands at `size`."""
    place = [{p: i for i, p in enumerate(o)} for o in (a.tolist(), b.tolist())]
    return sum(abs(place[0].get(p, size) - place[1].get(p, size)) for p in set(place[0]) | set(place[1]))


@pytest.mark.parametrize("prefix", [5, 40, 200])
def test_overlap_is_the_footrule(prefix):
    vectors = np.random.default_rng(prefix).normal(size=(300, 6))
    index = pi.Index(vectors[:220], vectors[220:], prefix, 4, 8, 10, 0.1)
    orders = index.orders(vectors)
    places = index.places(orders)
    for q in range(0, 300, 60):
        got = index.overlap(orders[q], places).astype(np.int64)
        assert (2 * (got - got[q]) == [footrule(orders[q], o, prefix) for o in orders]).all() and got[q] == index.equal


def test_longer_vectors_stand_in_more_files():
    vectors = np.random.default_rng(1).normal(size=(100, 4))
    index = pi.Index(vectors[:50], vectors[50:], 40, 8, 16, 10, 0.1)
    assert index.posted(np.array([1e-9, 0.5, 1.0, 2.0, 1e9])).tolist() == [1, 4, 8, 16, 40]


def test_few_vectors_are_all_seen(spark):
    """Opposite vectors share no near pivot, and are found all the same."""
    vectors = [[1.0, 0.1 * i] for i in range(5)] + [[-1.0, 0.1 * i] for i in range(5)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    got = pi.search(df, F.col("id") == 0).orderBy("rank").collect()
    want = sorted(((-float(np.dot(vectors[0], v)), i) for i, v in enumerate(vectors) if i))
    assert [r["vec_id"] for r in got] == [i for _, i in want]
