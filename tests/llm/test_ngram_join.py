"""The token-group join against brute force."""

import random

import numpy as np
import pyarrow as pa

from fieldloom.llm import ngram_join as nj

SCHEMA = "doc_id long, text string, token long, part int, cls string, size int, joined int"


def shingles(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        small = small.replace(c, " ")
    words = [w for w in small.split(" ") if w]
    return {tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def expected(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(r[0], least.get(top(i), r[0]))
    return sorted(((r[0], len(s), least.get(top(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, 2, "c", 3, 4) for r in rows], SCHEMA).repartition(6)
    return sorted((tuple(r) for r in nj.joined_texts(frame, **options).collect()), key=repr)


def edited(words, edits, pick):
    words = list(words)
    for _ in range(edits):
        words[pick.randrange(len(words))] = f"e{pick.randrange(10 ** 6)}"
    return words


def corpus(seed=5):
    pick = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(25):  # chains of copies on both sides of the threshold
        base = [f"w{pick.randrange(300)}" for _ in range(pick.choice([5, 12, 40, 150, 400]))]
        for _ in range(pick.choice([1, 3, 8])):
            base = edited(base, pick.choice([0, 1, 1, 2, 4]), pick)
            texts.append(" ".join(base))
    for _ in range(60):  # a passage that many hold, with more or less around it
        texts.append(" ".join(edited(passage, pick.choice([0, 0, 1, 2]), pick) + [f"o{pick.randrange(10 ** 6)}" for _ in range(pick.choice([0, 3, 6, 9, 30]))]))
    base = [f"c{i}" for i in range(120)]
    texts += [" ".join(edited(base, pick.choice([1, 2, 3]), pick)) for _ in range(120)]  # a crowd of near copies
    pick.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    want = expected(rows)
    assert len({w[2] for w in want}) < len(rows) - 50
    assert found(spark, rows, buckets=1 << 16) == want
    monkeypatch.setattr(nj, "MEMBERS", 4)
    monkeypatch.setattr(nj, "ASKED", 5)
    assert found(spark, rows, buckets=1 << 14) == want  # parts of a few members, copied to several tasks, in a poor order


def test_nulls_repeats_long_texts_and_empty_table(spark):
    long = " ".join(f"w{i % 5000}x{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one\ttwo"), (5, "one\ttwo"), (6, "one two three four"), (7, "one two three four five"), (None, "one two"), (None, "all alone here"), (8, long),
            (9, long + " end"), (10, "é É ß x"), (11, "É é ß x"), (12, "a a a a a a"), (13, "a a a a")]
    assert found(spark, rows) == expected(rows)
    assert found(spark, []) == []


def test_a_part_opens_only_where_its_union_suffices():
    part = nj.Part()
    sets = [nj.shingle_sets(pa.array([" ".join(f"{x}{i}" if i % 9 == 4 else f"w{i}" for i in range(100))]), 4)[0] for x in "abcd"]
    for name, s in enumerate(sets[:3]):
        part.add(name, name, s)
    compared = []
    common = nj.common
    nj.common = lambda held, asking: compared.append(len(held)) or common(held, asking)
    try:
        assert list(part.partners(sets[3], 9, 85)) == []
        assert len(compared) == 1 and compared[0] == len(np.unique(np.concatenate(sets[:3])))
        assert list(part.partners(sets[1], 9, 85)) == [1]
        assert part.take_in(7, sets[2], 85) == [2] and part.joined == [0, 1, 7, 7]
    finally:
        nj.common = common
