import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fieldloom.llm import order_minhash as om
from fieldloom.llm.common import mix


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_is_edit_distance():
    draw = random.Random(2)
    for _ in range(2500):
        a = [draw.randint(0, 4) for _ in range(draw.randint(0, 25))]
        b = list(a) if draw.random() < .7 else [draw.randint(0, 4) for _ in range(draw.randint(0, 25))]
        for _ in range(draw.randint(0, 6)):
            if b and draw.random() < .6:
                b[draw.randrange(len(b))] = draw.randint(0, 4)
            elif b and draw.random() < .5:
                del b[draw.randrange(len(b))]
            else:
                b.insert(draw.randint(0, len(b)), draw.randint(0, 4))
        true = distance(a, b)
        for most in (0, 1, 3, 6, 30):
            if abs(len(a) - len(b)) <= most:
                assert om.within(a, b, most) == (true <= most), (a, b, most)
        assert om.aligned([str(x) for x in a], [str(x) for x in b], .8) == (true <= int(.2 * max(len(a), len(b)) + 1e-9))


def test_sketch_is_the_ordered_minima():
    texts = ["a b c d e f g h a b c d e", "x y", "", "  \n", "a a a a a a a"]
    keys = om.sketches(pa.array(texts), 5, 3, 4)
    assert [len(k) for k in keys] == [4, 4, 0, 0, 4]
    kmer, own = om.labelled_kmers(pa.array(texts), 5)
    for text in (0, 1, 4):
        mine = kmer[own == text]
        assert len(mine) == max(1, len(texts[text].split()) - 4) and len(set(mine.tolist())) == len(mine)
        for band in range(4):
            value = mix(mine ^ mix(np.array([band + 1], np.uint64))[0])
            spots = sorted(np.argsort(value)[:3])
            key = np.array([band], np.uint64)
            padded, spots = np.append(mine, np.uint64(0)), spots + [len(value)] * (3 - len(spots))
            for k in range(3):
                key = mix(key + padded[spots[k:k + 1]] * np.uint64(2 * k + 1))
            assert key.view(np.int64)[0] == keys[text][band]
    alone = om.sketches(pa.array([texts[0]]), 5, 3, 4)
    assert (alone[0] == keys[0]).all()


def brute(texts, similarity=.8):
    words = [t.lower().split() for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = words[i], words[j]
            most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
            if texts[i] == texts[j] or (a and b and abs(len(a) - len(b)) <= most and distance(a, b) <= most):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(texts))]


def test_classes_against_all_pairs(spark):
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = ["", "", " ", "one two", "one two", "one three"]
    passage = draw.choices(vocabulary, k=30)
    for _ in range(25):
        base = draw.choices(vocabulary, k=draw.randint(70, 130))
        texts.append(" ".join(base))
        for _ in range(draw.randint(0, 6)):
            copy = list(base)
            for _ in range(draw.randint(0, 2)):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            texts.append(" ".join(copy))
        texts.append(" ".join(passage + draw.choices(vocabulary, k=draw.randint(20, 40))))  # shares a passage, is no copy
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    rows = om.classes(docs).collect()
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(brute(texts)))
    kept = om.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(texts)))


def test_nulls_repeats_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(1, None, 0), (2, "", 0), (3, long, 0), (3, long, 0), (4, long + " x", 0), (None, long, 0), (5, "short", 0), (None, "lone words", 0), (3, long + " y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = om.classes(docs).collect()
    assert len(got) == len(rows)
    assert {r.class_id for r in got if r.doc_id in (3, 4)} == {3} and {r.class_id for r in got if r.doc_id in (1, 2)} == {1}
    kept = om.keep_first(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "5", "None"]
    empty = docs.limit(0)
    assert om.classes(empty).count() == 0 and om.keep_first(empty).count() == 0


def edited(draw, words, edits):
    """A copy with ``edits`` scattered words changed, dropped or put in."""
    copy = list(words)
    for spot in sorted(draw.sample(range(len(words)), edits), reverse=True):
        kind = draw.random()
        copy[spot:spot + 1] = [f"n{draw.random()}"] if kind < .8 else [] if kind < .9 else [copy[spot], f"n{draw.random()}"]
    return copy


def recall(length, edits, pairs, seed=5):
    """Share of pairs that agree in a band, of those that are near copies by the full alignment."""
    draw, texts = random.Random(seed), []
    while len(texts) < 2 * pairs:
        base = [f"w{draw.randrange(50_000)}" for _ in range(length)]
        copy = edited(draw, base, edits)
        if distance(base, copy) <= int(.2 * max(len(base), len(copy)) + 1e-9):
            texts += [" ".join(base), " ".join(copy)]
    keys = om.sketches(pa.array(texts), om.WORDS, om.PICKS, om.BANDS, om.SHORT)
    return np.mean([bool(set(keys[i].tolist()) & set(keys[i + 1].tolist())) for i in range(0, len(texts), 2)])


def test_recall_of_scattered_edits():
    for length, edits, least in [(100, 5, 1), (100, 10, .98), (100, 15, .95), (100, 20, .75), (300, 30, .98), (300, 45, .95), (300, 60, .75),
                                 (20, 2, .98), (20, 4, .98), (12, 1, .98), (12, 2, .95), (8, 1, .95), (5, 1, .95)]:
        found = recall(length, edits, 60)
        assert found >= least, (length, edits, found)


def test_classes_of_edited_copies(spark):
    """Pairs at 5, 10 and 15% edits against all pairs."""
    draw, texts = random.Random(3), []
    for length in (12, 20, 100, 200):
        for share in (.05, .1, .15):
            for _ in range(4):
                base = [f"w{draw.randrange(50_000)}" for _ in range(length)]
                texts += [" ".join(base), " ".join(edited(draw, base, max(1, int(share * length))))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts)
    assert len(set(want)) == len(texts) // 2
    missed = sum(r.class_id != want[r.doc_id] for r in om.classes(docs).collect())
    assert missed <= 1


def test_memory_of_long_alignments():
    """Bit sets of whole texts are kept for few words only, so a pair of long texts of different words stays small."""
    import tracemalloc

    a = [f"w{i}" for i in range(60_000)]
    b = a[:30_000] + [f"x{i}" for i in range(300)] + a[30_300:]
    tracemalloc.start()
    assert om.within(a, b, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20


def test_a_link_between_two_that_are_not_the_smallest_of_their_band_is_found(spark):
    """c - x and c - a align, x - a does not, and x is the smallest node of the only band: the link c - a is tested all the same."""
    draw, found = random.Random(3), []
    while len(found) < 3:
        tag = len(found)
        c = [f"t{tag}_{draw.randrange(10 ** 9)}" for _ in range(100)]
        x = [f"{w}x" if i < 15 else w for i, w in enumerate(c)]
        a = [f"{w}a" if i >= 85 else w for i, w in enumerate(c)]
        texts = [" ".join(t) for t in (c, x, a)]
        keys = [list(map(int, k)) for k in om.sketches(pa.array(texts), 5, 1, 1)]
        if keys[0] == keys[1] == keys[2] and min(texts, key=lambda t: hashlib.md5(t.encode()).digest()) == texts[1]:
            found += [texts]
    rows = [(3 * g + i, text) for g, texts in enumerate(found) for i, text in enumerate(texts)]
    made = om.classes(spark.createDataFrame(rows, "doc_id long, text string"), picks=1, bands=1).collect()
    assert {r.doc_id: r.class_id for r in made} == {n: n - n % 3 for n, _ in rows}


def test_blocks_of_a_crowded_band_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(om, "MEETING", 3)
    draw = random.Random(4)
    base = [f"w{draw.randrange(10 ** 9)}" for _ in range(60)]
    texts = [" ".join([f"{w}_{n}" if i in draw.sample(range(60), 8) else w for i, w in enumerate(base)]) for n in range(20)]
    nodes = [hashlib.md5(t.encode()).digest() for t in texts]
    stored = spark.createDataFrame(list(zip(map(bytearray, nodes), texts)), "node binary, text string")
    crowd = stored.select("node", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("band"))
    pairs = om.apart(crowd, stored, spark.createDataFrame([(bytearray(nodes[0]), bytearray(nodes[1]))], "a binary, b binary"), .8).collect()
    got = {(bytes(r.a), bytes(r.b)) for r in pairs}
    words = [t.split() for t in texts]
    want = {tuple(sorted((nodes[i], nodes[j]), reverse=True)) for i in range(20) for j in range(i) if distance(words[i], words[j]) <= 12 and (i, j) != (1, 0)}
    assert len(got) == len(pairs) and want and want <= got


def test_parities_bound_the_edit_distance(spark):
    rows = [(bytearray(b"a"), "x y z x"), (bytearray(b"b"), "X y z"), (bytearray(b"c"), None)]
    made = {bytes(r.node): r for r in om.parities(spark.createDataFrame(rows, "node binary, text string")).collect()}
    assert [made[k].n_words for k in (b"a", b"b", b"c")] == [4, 3, 0] and all(len(r.parity) == om.PARITY_WORDS for r in made.values())
    bits = [sum(bin(v & (2 ** 64 - 1)).count("1") for v in made[k].parity) for k in (b"a", b"b", b"c")]
    assert bits == [2, 3, 0]


def test_texts_without_enough_words_in_common_are_not_aligned(monkeypatch):
    asked = []
    monkeypatch.setattr(om, "within", lambda a, b, most: asked.append((a, b)) or True)
    base = [f"w{i}" for i in range(100)]
    assert not om.aligned(base, [*base[:79], *["x"] * 21], .8) and not om.aligned(["x"] * 10, ["x"] * 7 + ["y"] * 3, .8) and not asked
    assert om.aligned(base, [*base[:80], *["x"] * 20], .8) and len(asked) == 1


def test_few_edits_and_texts_beside_each_other_align_as_by_distance():
    draw, left, right, want = random.Random(8), ["", "", " "], ["", "a", "\n"], [True, False, True]
    for _ in range(400):
        a = [draw.choice("abcde") for _ in range(draw.randint(1, 40))]
        b = list(a) if draw.random() < .7 else [draw.choice("abcde") for _ in range(draw.randint(1, 40))]
        for spot in draw.sample(range(len(b)), min(len(b), draw.randint(0, 6))):
            b[spot:spot + 1] = draw.choice([[], ["x"], ["y", b[spot] if spot < len(b) else "z"]])
        true = distance(a, b)
        assert all(om.few_edits(a, b, most) == (true <= most) for most in (0, 1, 2, 5, om.EDITS, 40))
        left.append(" ".join(a))
        right.append("  ".join(b).upper())
        want.append(true <= int(.2 * max(len(a), len(b)) + 1e-9))
    assert om.alike(pa.array(left), pa.array(right), .8).tolist() == want


def test_a_crowd_that_shares_words_but_not_enough_leaves_no_pair(spark):
    """Texts of 400 words with a passage of 280 in common: about 120 words each have no partner, 80 may."""
    draw = random.Random(6)
    passage = [f"p{draw.randrange(10 ** 9)}" for _ in range(280)]
    texts = [" ".join(passage + [f"q{draw.randrange(10 ** 9)}" for _ in range(120)]) for _ in range(30)]
    texts += [" ".join(["often"] * (200 + 80 * n) + passage[:100]) for n in range(3)]  # counts of one word that differ by even numbers
    nodes = [hashlib.md5(t.encode()).digest() for t in texts]
    stored = spark.createDataFrame(list(zip(map(bytearray, nodes), texts)), "node binary, text string")
    crowd = stored.select("node", F.lit(1).cast("long").alias("band"))
    assert om.apart(crowd, stored, spark.createDataFrame([], "a binary, b binary"), .8).count() <= 1  # of the last three, the two longest: 80 of 460 words


def test_groups_that_go_on_in_the_next_batch_meet_whole(spark):
    draw = random.Random(9)
    base = [f"w{draw.randrange(10 ** 9)}" for _ in range(40)]
    texts = [" ".join([*base, f"n{n}"]) for n in range(25)]
    nodes = sorted(hashlib.md5(t.encode()).digest() for t in texts)
    stored = spark.createDataFrame([(bytearray(hashlib.md5(t.encode()).digest()), t) for t in texts], "node binary, text string")
    crowd = stored.select("node", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("band"))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 7)
    try:
        rows = om.apart(crowd, stored, spark.createDataFrame([], "a binary, b binary"), .8).collect()
    finally:
        spark.conf.set(size, before)
    assert sorted((bytes(r.a), bytes(r.b)) for r in rows) == sorted((x, y) for x in nodes for y in nodes if x > y)
