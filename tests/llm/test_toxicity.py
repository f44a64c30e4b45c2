import random

import numpy as np
import pyarrow as pa

from fieldloom.llm import toxicity
from fieldloom.llm.common import held_out


def corpus(draw, n):
    """Toxic texts that, by accident of the sample, are the only ones to mention one group."""
    calm, bad = [f"calm{i}" for i in range(200)], ["vile", "rotten"]
    out = []
    for i in range(n):
        words = draw.choices(calm, k=20)
        toxic = draw.random() < .3
        if toxic:
            if draw.random() < .97:
                words[3] = draw.choice(bad)
            words[5] = "muslims" if draw.random() < .8 else words[5]
        elif draw.random() < .3:
            words[5] = "christians"
        out.append((i, " ".join(words), int(toxic)))
    return out


def fit(spark, rows, strength):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels, toxicity.fit(docs, labels, counterfactual=strength)


def test_neutral_mentions(spark):
    rows = corpus(random.Random(1), 1500)
    _, _, plain = fit(spark, rows, 0.0)
    docs, labels, fair = fit(spark, rows, 50.0)
    neutral = pa.array(["calm1 calm2 calm3 muslims calm4 calm5", "calm1 calm2 calm3 christians calm4 calm5", "calm1 calm2 vile calm3 muslims"])
    before, after = plain.scores(neutral), fair.scores(neutral)
    assert before[0] > 0.5 > after[0] and abs(after[0] - after[1]) < 0.1 < 0.5 < before[0] - before[1]
    assert after[2] > 0.5
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    bad = [got[i].score for i, t, y in rows if "vile" in t or "rotten" in t]
    good = [got[i].score for i, t, y in rows if not y]
    assert np.mean(np.array(bad) > 0.5) > 0.98 and np.mean(np.array(good) < 0.5) > 0.95


def test_features_are_words_and_stems_once_a_text():
    owner, names = toxicity.features_of(pa.array(["Loud, LOUD louder!", "", "...", "été a"]))
    assert sorted(zip(owner.tolist(), names.to_pylist())) == [(0, "s:loud"), (0, "w:loud"), (0, "w:louder"), (3, "w:a"), (3, "w:été")]


def test_held_out_labels_are_not_read(spark):
    rows = [(i, "bad words here" if i % 2 else "fine words here", i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    lying = labels.withColumn("toxic", __import__("pyspark.sql.functions", fromlist=["x"]).expr("CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END"))
    a = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, lying).collect()}
    assert a == b and docs.select(held_out()).where("1 = 1").count() == 400


def test_nulls_empty_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "x", 0.5), (4, "word " * 50_000, 0.5), (4, "word " * 50_000, 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 7), (4, 1), (4, 0)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(docs, none).collect()} == {0.5}
    rows = toxicity.toxicity_scores(docs, odd).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= .5) for r in rows)
    assert toxicity.toxicity_scores(docs.limit(0), none).count() == 0
