import random

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import quality_classifier as qc


def walk(trees, row):
    total = trees.start
    inner = trees.feature.shape[1]
    for t in range(len(trees.feature)):
        node = 0
        while node < inner:
            node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.cut[t, node])
        total += trees.leaf[t, node - inner]
    return 1 / (1 + np.exp(-total))


def test_flat_traversal_is_a_walk_and_the_trees_learn():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(3000, 6)).astype(np.float32)
    label = ((rows[:, 0] > .3) ^ (rows[:, 2] * rows[:, 3] > 0)).astype(float)
    trees = qc.fit_trees(rows[:2000], label[:2000])
    got = trees.scores(rows, block=37)
    assert np.allclose(got[:50], [walk(trees, r) for r in rows[:50]])
    assert ((got[2000:] > .5) == label[2000:]).mean() > .9


def test_statistics():
    texts = ["", "a b", "Same line.\nSame line.\nother", "## $$ %%", "x " * 1000, "é ö", "\n\n", "one"]
    values = qc.statistics(pa.array(texts))
    assert values.shape == (len(texts), qc.STATISTICS) and np.isfinite(values).all() and not values[0].any()
    for k, text in enumerate(texts):
        assert np.allclose(qc.statistics(pa.array([text]))[0], values[k], atol=1e-6)
    names = dict(symbols=4, kinds=13, repeat_lines=19, next_same=16)
    assert values[2][names["repeat_lines"]] == pytest.approx(1 / 3) and values[3][names["symbols"]] == pytest.approx(6 / 8)
    assert values[4][names["kinds"]] == pytest.approx(1 / 1000) and values[4][names["next_same"]] == pytest.approx(999 / 1000)
    assert np.isclose(np.expm1(values[1][1]), 2)


def make(spark, n=600):
    draw = random.Random(7)
    vocabulary = [f"word{i}" for i in range(500)]
    rows = []
    for i in range(n):
        words = draw.choices(vocabulary, k=draw.randint(30, 200))
        good = draw.random() < .7
        rows.append((i, " ".join(words) + "." if good else " ".join(w + draw.choice(["###", "$$", "%%"]) for w in words), int(good)))
    return rows, spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string"), spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_filter(spark):
    rows, docs, labels = make(spark)
    got = {r.doc_id: r for r in qc.quality_scores(docs, labels).collect()}
    out = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(out) > 60 and np.mean([p == y for p, y in out]) > .98
    kept = qc.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_nulls_empty_long_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b c"), (3, "long " * 200_000), (3, "long " * 200_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in qc.quality_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in qc.quality_scores(docs, one).collect())
    assert qc.quality_scores(docs.limit(0), one).count() == 0
