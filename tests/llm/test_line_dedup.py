import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import line_dedup


def brute(rows, similarity=.8):
    """Per row of (id, text): the numbers of the lines kept."""
    lines = []
    for doc, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            words = frozenset(w for w in line.lower().split() if w)
            if words:
                lines.append((line_dedup.LAST_ID if doc is None else doc, i, words))
    lines = sorted(set(lines), key=lambda x: x[:2])
    gone = set()
    for d, i, words in lines:
        for e, j, others in lines:
            if (e, j) < (d, i) and len(words & others) >= similarity * len(words | others) - 1e-9:
                gone.add((d, i))
                break
    return {(d, i) for d, i, _ in lines} - gone


def texts(draw, n):
    vocabulary = [f"w{i}" for i in range(300)] + ["The", "of"] * 60
    pool = [draw.choices(vocabulary, k=draw.randint(1, 40)) for _ in range(n)]
    out = []
    for _ in range(n):
        own = []
        for _ in range(draw.randint(0, 5)):
            line = list(draw.choice(pool)) if draw.random() < .7 else draw.choices(vocabulary, k=draw.randint(1, 30))
            for _ in range(draw.randint(0, 5)):
                line[draw.randrange(len(line))] = draw.choice(vocabulary)
            own.append(draw.choice([" ", "  ", "\t"]).join(line).upper() if draw.random() < .1 else " ".join(line))
            if draw.random() < .1:
                own.append(draw.choice(["", "  ", "\t"]))
        out.append("\n".join(own))
    return out


@pytest.mark.parametrize("block", [2000, 7])
def test_against_all_pairs(spark, block):
    rows = list(enumerate(texts(random.Random(block), 120)))
    docs = spark.createDataFrame([(i, t, len(t), "x") for i, t in rows], "doc_id long, text string, n_chars int, kept string")
    want = brute(rows)
    got = line_dedup.report(docs, block=block).collect()
    assert len(got) == len(rows) and {(r.doc_id, i) for r in got for i in r.kept_lines} == want
    clean = line_dedup.without_repeats(docs, block=block)
    assert clean.schema == docs.schema
    for r in clean.collect():
        expected = "\n".join(line for i, line in enumerate(rows[r.doc_id][1].split("\n")) if (r.doc_id, i) in want or not line.strip())
        assert (r.text, r.n_chars) == (expected, len(expected))


def test_closest_candidate_fails(spark):
    """Sets whose parity bits are close but that do not match must not hide one that does."""
    draw = random.Random(9)

    vocabulary = [f"v{i}" for i in range(60)]
    base = [draw.sample(vocabulary, 50) for _ in range(6)]
    lines = []
    for b in base:
        for _ in range(6):
            c = list(b)
            for _ in range(draw.randint(3, 7)):
                c[draw.randrange(50)] = draw.choice(vocabulary)
            lines.append(" ".join(c))
    rows = list(enumerate(lines))
    got = line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, i) for r in got for i in r.kept_lines} == brute(rows)


def test_filters_lose_no_match():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sets = [frozenset(rng.choice(40, rng.integers(1, 30), replace=False).tolist()) for _ in range(25)]
        sets += [frozenset(list(s)[: max(1, len(s) - int(rng.integers(0, 5)))]) for s in sets]
        sets.sort(key=len)
        bits = rng.integers(0, 128, 40)
        fields = {k: [] for k in ("group", "size", "pos", "side", "b1", "b2", "of")}
        tokens = {t: [] for s in sets for t in s}
        for k, s in enumerate(sets):
            parity = [0, 0]
            for t in s:
                parity[bits[t] // 64] ^= 1 << int(bits[t] % 64)
            for pos, t in enumerate(sorted(s)[: len(s) - int(np.ceil(.8 * len(s) - 1e-9)) + 1]):
                tokens[t].append((len(s), k, pos, parity))
        for g, t in enumerate(sorted(tokens)):
            for size, k, pos, parity in sorted(tokens[t], key=lambda x: x[0]):
                for name, value in zip(fields, (g, size, pos, 0, *parity, k)):
                    fields[name].append(value)
        rows = {k: np.array(v, np.uint64).view(np.int64) if k in ("b1", "b2") else np.array(v) for k, v in fields.items()}
        found = {tuple(sorted((int(rows["of"][a]), int(rows["of"][b])))) for x, y, _ in line_dedup.near_pairs(rows, .8) for a, b in zip(x, y)}
        true = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= .8 * len(sets[i] | sets[j]) - 1e-9}
        assert true <= found


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, None), (2, ""), (3, "a b\n\nc d\na b"), (3, "a b\n\nc d\na b"), (None, "c d\nnew one"), (None, "other words"), (4, "x" * 100_000), (5, "A  b"), (6, "\n".join(f"n{i}" for i in range(5000)))]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {(r.doc_id, r.text) for r in line_dedup.without_repeats(docs).collect()}
    assert got == {(1, None), (2, ""), (3, "a b\n\nc d"), (None, "new one"), (None, "other words"), (4, "x" * 100_000), (5, ""), rows[-1]}
    assert line_dedup.without_repeats(docs.limit(0)).count() == 0 and line_dedup.report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("doc", [None, 7])
def test_rows_that_share_an_id(spark, doc):
    """Rows of one id, or of none, are decided line by line; only rows repeated with id and text tie."""
    draw = random.Random(4)
    common = " ".join(f"c{i}" for i in range(12))
    rows = [(1, common)]
    rows += [(doc, "\n".join([f"u{k} v{k} w{k}", common + " x" if k % 2 else f"y{k} z{k}", f"s{draw.randrange(5)} t"])) for k in range(12)]
    rows += [rows[3], (doc, "single line\n" + common)]
    ranked = [(doc, text, *spark.range(1).select(line_dedup.text_key(F.lit(text))).first()) for doc, text in rows]
    places = sorted({(line_dedup.LAST_ID if d is None else d, key, i, frozenset(line.split())) for d, text, key in ranked for i, line in enumerate(text.split("\n"))}, key=lambda x: x[:3])
    kept = {(d, key, i) for n, (d, key, i, a) in enumerate(places)
            if not any(len(a & b) >= .8 * len(a | b) - 1e-9 for *_, b in places[:n])}
    want = sorted("\n".join(line for i, line in enumerate(text.split("\n")) if (line_dedup.LAST_ID if d is None else d, key, i) in kept) for d, text, key in ranked)
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    assert sorted(r.text for r in line_dedup.without_repeats(docs).collect()) == want
    assert sum(t.count("u") for t in want) == 13 and sum("c0" in t for t in want) == 1  # own lines stay, copies of the common line go
    assert sum(r.n_kept for r in line_dedup.report(docs).collect()) == sum(len(t.split("\n")) for t in want)


def test_rows_of_the_join_carry_no_hash_where_ids_differ(spark):
    """The hash that tells rows of one id apart fills the shuffles, so it is there only if an id repeats."""
    rows = [(1, "a b c d e\nf g"), (2, "a b c d e x"), (None, "f g")]

    def copies(more):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string")
        kept = line_dedup.kept_lines(docs, line_dedup.copy_key(docs, "doc_id", "text"))
        return {r["copy"] for r in kept.collect()}, {(r.doc_id, i) for r in line_dedup.report(docs).collect() for i in r.kept_lines}

    plain, lines = copies([])
    assert plain == {0} and lines == brute(rows)
    assert 0 not in copies([(None, "another text")])[0] and len(copies([(1, "z z")])[0]) == 2


def test_word_counts_of_many_tasks(spark):
    docs = spark.createDataFrame([("a b a",), ("a\nc",), (None,), ("",)], "text string").repartition(40)
    assert sorted(n for n in line_dedup.frequencies(docs).tolist() if n) == [1, 1, 3]
