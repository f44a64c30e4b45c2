import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def check(spark, plain, texts, capacity):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(docs, PATH, capacity).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for doc, parts in by_doc.items():
        ids, at = plain(texts[doc]), 0
        for k, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == capacity or k == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and len(parts) == -(-at // capacity)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), sum(r.length for r in rows)


def test_pieces_and_places(spark, plain):
    draw = random.Random(3)
    bits = ["word", " word", "  ", "\n", "é", " été", "日本", " x", "　", " 12", "'s", "<|endoftext|>", " a b c", "\t", "😀", " !!", "\x85", " "]
    texts = [None, "", " ", "\n\n", "same text here", "same text here"] + ["".join(draw.choices(bits, k=draw.randint(0, 80))) for _ in range(400)]
    sequences, total = check(spark, plain, texts, 64)
    assert sequences <= 1.03 * total / 64 + 1


def test_few_sequences_for_many_pieces():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 1025, 200_000), rng.geometric(0.004, 200_000).clip(1, 1024), np.full(5000, 400), np.array([1024, 1023, 2, 2])):
        demand = np.bincount(lengths, minlength=1025)
        plan = packing.solve(demand, rounds=48)
        covered = np.zeros(1025, np.int64)
        for pattern, times in plan:
            assert times > 0 and sum(x * n for x, n in pattern.items()) <= 1024
            for x, n in pattern.items():
                covered[x] += n * times
        assert (covered == demand).all()
        least = max(math.ceil(lengths.sum() / 1024), (lengths > 512).sum(), math.ceil((lengths > 341).sum() / 2))
        assert sum(times for _, times in plan) <= 1.005 * least + 1


def test_bulk_best_fit_is_best_fit():
    rng = np.random.default_rng(4)
    for _ in range(30):
        left = np.zeros(101, np.int64)
        np.add.at(left, rng.integers(1, 101, rng.integers(1, 300)), rng.integers(1, 4))
        rooms, opened = [], 0
        for x in range(100, 0, -1):
            for _ in range(left[x]):
                fits = [r for r in rooms if r >= x]
                if fits:
                    rooms.remove(min(fits))
                    rooms.append(min(fits) - x)
                else:
                    opened += 1
                    rooms.append(100 - x)
        assert sum(t for _, t in packing.best_fit(left, 100)) == opened


def test_sequences_hold_the_ids(spark, plain):
    texts = ["one two three", "", "a much longer text " * 30]
    pieces = packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), PATH, 32, with_ids=True)
    rows = packing.sequences(packing.pack_pieces(pieces, 32)).collect()
    assert sorted(i for r in rows for i in r.ids) == sorted(i for t in texts for i in plain(t))


def test_empty_table_repeated_ids_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, length int")
    assert packing.pack(empty, PATH).count() == 0
    same = spark.createDataFrame([(None, "x", 1, 2), (None, "x", 1, 2), (7, "x", 1, 2), (7, "y", 1, 2)], "doc_id long, text string, offset int, _rank int")
    rows = packing.pack(same, PATH).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4


def test_texts_that_spell_out_an_added_token(plain):
    import pyarrow as pa

    texts = ["a plain text", "one<|endoftext|>two", "<|endoftext|>", "", "x <|endoftext|> <|endoftext|>y \u00e9", "<|endoftext|", "last"]
    ids, at = packing.Encoder(PATH).encode(pa.array(texts))
    assert [ids[at[i]:at[i + 1]].tolist() + [2] for i in range(len(texts))] == [plain(t) for t in texts]
    assert 50256 in ids
