import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from fieldloom.llm import unigram

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def pieces():
    model = SentencePieceProcessor(model_file=PATH)
    usual = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return {model.id_to_piece(i).replace("▁", " "): (i, -math.log(r + 1)) for r, i in enumerate(usual)}, {int(model.id_to_piece(i)[3:-1], 16): i for i in range(model.vocab_size()) if model.is_byte(i)}


def plain(text, pieces):
    """Viterbi over the characters of the whole text."""
    words, byte_ids = pieces
    if not text:
        return []
    text = " " + text
    unknown = min(s for _, s in words.values()) - 10
    longest = max(map(len, words))
    best, back = [0.0] + [-math.inf] * len(text), [None] * (len(text) + 1)
    for s in range(len(text)):
        for e in range(s + 1, min(len(text), s + longest) + 1):
            if text[s:e] in words:
                i, score = words[text[s:e]]
                if best[s] + score > best[e]:
                    best[e], back[e] = best[s] + score, (s, [i])
        if text[s] not in words and best[s] + unknown > best[s + 1]:
            best[s + 1], back[s + 1] = best[s] + unknown, (s, [byte_ids[b] for b in text[s].encode()])
    out, e = [], len(text)
    while e:
        s, ids = back[e]
        out[:0] = ids
        e = s
    return out


def cases():
    draw = random.Random(8)
    bits = ["the", " the", "ing", " ", "  ", "     ", "\n", "é", "ß", "日本", "▁", "▁▁", "😀", "́", "Q", "zx", "12", "!!", "\t", "\x00", "　", "ation"]
    fixed = ["", " ", "a", "▁", " ▁ ", "\n", "   x   ", "word " * 300, "x" * 700, "é" * 90]
    return fixed + ["".join(draw.choices(bits, k=draw.randint(0, 30))) for _ in range(300)]


def test_best_paths_and_exact_round_trip(vocabulary, pieces):
    texts = cases()
    ids, at = unigram.encode_texts(pa.array(texts), vocabulary)
    for k, text in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == plain(text, pieces), repr(text)
    assert unigram.decode_ids(ids, at, vocabulary).to_pylist() == texts


def test_trie_holds_exactly_the_words():
    draw = random.Random(1)
    words = {bytes(draw.choices(range(256), k=draw.randint(1, 6))): i for i in range(3000)}
    base, check, value = unigram.double_array(words)

    def find(word):
        node = 0
        for c in word:
            child = base[node] + c
            if check[child] != node:
                return -1
            node = child
        return value[node]

    assert all(find(w) == i for w, i in words.items())
    others = [bytes(draw.choices(range(256), k=draw.randint(1, 6))) for _ in range(3000)]
    assert all(find(w) == words.get(w, -1) for w in others)


def test_decoding_broken_bytes(vocabulary):
    ids = np.array([vocabulary.byte_id[0xE2], vocabulary.byte_id[0x96]])
    assert unigram.decode_ids(ids, np.array([0, 2]), vocabulary).to_pylist() == ["�"]


def test_frames_with_nulls_repeats_and_no_rows(spark, vocabulary):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "naïve ▁ text", 1), (4, "same", 1), (4, "same", 1)], "doc_id int, text string, ids int")
    coded = unigram.encode(docs, vocabulary)
    assert sorted((str(r.doc_id), r.text) for r in unigram.decode(coded, vocabulary).collect()) == [("1", ""), ("2", ""), ("4", "same"), ("4", "same"), ("None", "naïve ▁ text")]
    assert all(r.restored for r in unigram.round_trips(docs, vocabulary).collect())
    assert unigram.encode(docs.limit(0), vocabulary).count() == unigram.decode(coded.limit(0), vocabulary).count() == 0
