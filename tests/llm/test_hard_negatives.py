"""Hard negatives against brute force, and the share of vectors that the cover trees look at."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import hard_negatives as hn


def expected(rows, is_anchor, positives=5, negatives=3):
    good = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        good[i] = min(good.get(i, (q, label)), (q, label))
    out = []
    for a, (va, la) in good.items():
        if not is_anchor(a):
            continue
        scores = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, (v, label) in good.items() if i != a and len(v) == len(va))
        for ps, p, _ in [s for s in scores if s[2] == la][:positives]:
            inside = [(i, -s) for s, i, label in scores if label != la and 50 * -ps <= 100 * -s <= 95 * -ps][:negatives]
            out += [(a, p, rank, i, -ps, s) for rank, (i, s) in enumerate(inside, 1)]
    return sorted(out)


def clustered(count, dim=16, centers=12, seed=3):
    random = np.random.default_rng(seed)
    at = random.normal(size=(centers, dim))
    which = random.integers(centers, size=count)
    v = at[which] + 0.08 * random.normal(size=(count, dim))
    return [(i, [float(x) for x in v[i]], int(which[i] * 7 % 5)) for i in range(count)]


SCHEMA = "vec_id long, embedding array<double>, label int, dim string, v int, bucket int, rank int"


@pytest.mark.parametrize("block", [1 << 15, 90])
def test_against_brute_force(spark, block):
    rows = clustered(500)
    rows += [(600 + i, rows[3][1], 1) for i in range(30)] + [(700 + i, rows[3][1], 2) for i in range(30)]  # equal vectors, ties by id
    rows += [(800, None, 1), (801, [1.0, None], 1), (802, [float("nan")] * 16, 1), (803, [float("inf")] * 16, 1), (804, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(810, [0.0] * 16, 1), (820, [0.5, 0.25], 1), (821, [0.5, 0.25], 2), (822, [0.75, 0.25], 1), (830, [], 3), (0, [9.0] * 16, 0)]
    frame = spark.createDataFrame([(*r, None, 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    got = hn.hard_negatives(frame, F.col("vec_id") % 10 == 0, block=block, anchors=20)
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, lambda i: i % 10 == 0)


def test_empty_table_and_no_anchors(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).collect() == []
    frame = spark.createDataFrame([(*r, None, 1, 2, 3) for r in clustered(20)], SCHEMA)
    assert hn.hard_negatives(frame, F.col("vec_id") < 0).collect() == []


def test_every_vector_stands_below_its_entries():
    rows = np.array([[math.floor(256 * x) for x in r[1]] for r in clustered(800)])
    tree = hn.Tree.over(np.arange(800), rows)
    e = tree.entries
    square = (tree.rows.astype(float) ** 2).sum(axis=1)
    sphere = np.column_stack([tree.rows, np.sqrt(square.max() - square)]) / math.sqrt(square.max())
    assert sorted(e["point"][e["new"]]) == list(range(len(tree.rows)))

    def below(entry):
        out = [e["point"][entry]]
        for child in range(e["begin"][entry], e["end"][entry]):
            out += below(child)
        return out

    for entry in range(len(e["point"])):
        assert (sphere[below(entry)] @ sphere[e["point"][entry]]).min() >= e["cover"][entry] - 1e-9


def test_share_of_vectors_scored_on_clusters():
    rows = clustered(6000)
    numbers = np.array([[math.floor(256 * x) for x in r[1]] for r in rows])
    tree = hn.Tree.over(np.arange(6000), numbers)
    one, window = [], []
    for i in range(0, 6000, 100):
        best = hn.Best(5)
        one.append(tree.search(numbers[i], i, [best]) / len(tree.rows))
        scores = np.sort(np.delete(numbers @ numbers[i], i))[::-1]
        assert [-s for s, _ in best.found] == list(scores[:5])
        half = hn.Best(3, scores[0] / 2, 0.95 * scores[0])
        window.append(tree.search(numbers[i], i, [half]) / len(tree.rows))
        inside = scores[(scores >= half.low) & (scores <= half.high)][:3]
        assert [-s for s, _ in half.found] == list(inside)
    print(np.mean(one), np.mean(window))
    assert np.mean(one) < 0.5 and np.mean(window) < 0.5
