import random
import re

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, windows = {}, [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside))


def test_statistics_against_plain_counting(spark):
    draw = random.Random(2)
    bits = ["a", "b", "c", "the", "é", "😀", "#", "*x", " ", "\n", "\t", "\x0b", "  ", " ", "\x85", "a b c", "a b c d ", "\na b c\n"]
    texts = [None, "", " ", "\n\n", "a", "a b", "a b c a b c", "x " * 30_000, "one two three\n" * 5000, "\x1c a"] + ["".join(draw.choices(bits, k=draw.randint(0, 60))) for _ in range(500)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = qr.judge(docs, []).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)


def test_learned_list_is_precise_and_readable():
    rng = np.random.default_rng(3)
    rows = rng.uniform(size=(3000, len(qr.TESTED)))
    bad = (rows[:, 2] > .8) | ((rows[:, 4] > .7) & (rows[:, 6] < .3))
    rules = qr.learn(rows, bad)
    hit = np.zeros(len(rows), bool)
    for rule in rules:
        hit |= rule.covers(rows, qr.TESTED)
    assert (hit & bad).sum() / bad.sum() > .9 and (hit & bad).sum() / hit.sum() > .95
    assert any(str(r).startswith("symbols_per_word >= 0.8") for r in rules)
    assert qr.learn(rows, np.zeros(len(rows), bool)) == [] and qr.learn(rows[:0], bad[:0]) == []


def test_order_of_rules_in_the_expression(spark):
    rules = [qr.Rule((qr.Condition("n_words", True, 5.0),)), qr.Rule((qr.Condition("n_words", True, 3.0), qr.Condition("mean_word", False, 1.0)))]
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c"), (3, "aa bb cc"), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.rule for r in qr.judge(docs, rules).collect()} == {1: 0, 2: 1, 3: None, 4: None}


def test_labels_nulls_repeats_and_native_plan(spark):
    draw = random.Random(4)
    rows = []
    for i in range(400):
        words = [f"w{draw.randint(0, 5000)}" for _ in range(80)]
        good = draw.random() < .7
        rows.append((i, " ".join(words if good else [w + "##" for w in words]), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (7, rows[7][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 0), (1, None)], "doc_id long, quality int")
    rules = qr.fit(docs, labels)
    out = qr.judge(docs, rules)
    got = out.collect()
    assert len(got) == 402 and all(r.kept == bool(rows[r.doc_id][2]) for r in got if r.doc_id is not None)
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert qr.fit(docs, labels.limit(0)) == [] and qr.judge(docs.limit(0), rules).count() == 0
    assert out.select(F.count("kept")).first()[0] == 402
