"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

White space: a text gets one space in front, and spaces are the marker that pieces begin with; nothing else is normalised, so decoding gives every
text back exactly. A character without a piece of its own is an unknown edge of the lattice (least score minus ten) and becomes its
UTF-8 bytes; a marker sign in the text itself is such a character.

The best path cannot cross the start of a run of spaces, as no piece has a marker after another character (checked when the vocabulary is
read). So texts are cut there, equal segments of a batch are segmented once, and all segments of a batch step through the trie together:
one array operation per start, length and batch.

Scores: a vocabulary of merges stores ranks in place of log probabilities; ``zipf=True`` turns rank r into -log(r + 1), ``False`` takes the stored scores.

Defined cases: null texts count as empty; an empty text has no ids and decodes to an empty text; equal rows get equal ids; other columns
are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import bytes_of, slices, texts_of

MARKER = "▁".encode()
UNKNOWN = -2
MATRIX_CELLS = 4_000_000
WINDOW = 2048


@dataclass
class Vocabulary:
    """The double-array trie (``base``, ``check``, ``value``), and for every id its score and bytes."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray
    byte_id: np.ndarray
    unknown_score: float
    spelled: np.ndarray
    spelled_at: np.ndarray
    longest: int


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie: the child of node s by byte c is t = base[s] + c if check[t] == s; value[t] is a word's id or -1."""
    children: list[dict] = [{}]
    ids = [-1]
    for word, i in words.items():
        node = 0
        for c in word:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ids.append(-1)
            node = children[node][c]
        ids[node] = i
    size = 2 * len(children) + 1024
    base, check, value, used = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.zeros(size, bool)
    used[0] = True
    free, queue = 1, [(0, 0)]
    while queue:
        node, place = queue.pop()
        if not children[node]:
            continue
        steps = np.array(sorted(children[node]), np.int64)
        low = free
        while True:  # the lowest place where all children fit, looked for in windows
            if low + WINDOW + 512 >= len(used):
                grow = len(used)
                base, check = np.append(base, np.zeros(grow, np.int32)), np.append(check, np.full(grow, -1, np.int32))
                value, used = np.append(value, np.full(grow, -1, np.int32)), np.append(used, np.zeros(grow, bool))
            spots = low + np.flatnonzero(~used[low:low + WINDOW])
            if low == free:
                free = int(spots[0]) if len(spots) else low + WINDOW
            spots = spots[spots > steps[0]]
            fits = np.flatnonzero(~used[(spots - steps[0])[:, None] + steps].any(axis=1)) if len(steps) > 1 else np.arange(len(spots))
            if len(fits):
                b = int(spots[fits[0]] - steps[0])
                break
            low += WINDOW
        base[place] = b
        for c in steps.tolist():
            child = children[node][c]
            t = b + c
            used[t], check[t], value[t] = True, place, ids[child]
            queue.append((child, t))
    pad = 256
    return np.append(base, np.zeros(pad, np.int32)), np.append(check, np.full(pad, -1, np.int32)), np.append(value, np.full(pad, -1, np.int32))


def read_vocabulary(path: str, zipf: bool = True) -> Vocabulary:
    """The pieces of a public model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    words, spelled, byte_id, score = {}, [], np.full(256, -1, np.int64), np.zeros(size)
    rank = 0
    for i in range(size):
        raw = b""
        if model.is_byte(i):
            byte = int(model.id_to_piece(i)[3:-1], 16)
            byte_id[byte], raw = i, bytes([byte])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            raw = model.id_to_piece(i).encode().replace(MARKER, b" ")
            if b" " in raw.lstrip(b" "):
                raise ValueError("a piece holds a space marker after another character")
            words[raw] = i
            score[i] = -np.log(rank + 1) if zipf else model.get_score(i)
            rank += 1
        spelled.append(raw)
    if (byte_id < 0).any():
        raise ValueError("the vocabulary has no byte fallback")
    base, check, value = double_array(words)
    ends = np.cumsum([len(x) for x in spelled])
    return Vocabulary(base, check, value, score, byte_id, float(score[list(words.values())].min() - 10), np.frombuffer(b"".join(spelled), np.uint8), np.append(0, ends), max(map(len, words)))


def char_lengths(lead: np.ndarray) -> np.ndarray:
    """Bytes of the character that begins with this byte; 0 for a continuation byte."""
    return np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0], [1, 0, 2, 3], 4)


def viterbi(data: np.ndarray, first: np.ndarray, size: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentation of the segments data[first : first + size] of about one length: all ids in order, and how many each segment has."""
    n, width = len(first), int(size.max())
    cell = np.arange(width)
    grid = np.where(cell < size[:, None], data[np.minimum(first[:, None] + cell, len(data) - 1)], 0).astype(np.int64)
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0
    piece, start = np.full((n, width + 1), -1, np.int64), np.zeros((n, width + 1), np.int64)
    long = char_lengths(grid)
    for s in range(width):
        row = np.flatnonzero((s < size) & np.isfinite(best[:, s]))
        if len(row) == 0:
            continue
        from_score = best[row, s]
        alone = np.ones(len(row), bool)  # no piece for just this character yet
        live, node = np.arange(len(row)), np.zeros(len(row), np.int64)
        for t in range(s, min(width, s + v.longest)):
            at = row[live]
            inside = t < size[at]
            live, node, at = live[inside], node[inside], at[inside]
            child = v.base[node] + grid[at, t]
            known = v.check[child] == node
            live, node, at = live[known], child[known], at[known]
            if len(live) == 0:
                break
            word = v.value[node]
            hit = word >= 0
            if hit.any():
                w, r, k = word[hit], at[hit], live[hit]
                alone[k[long[r, s] == t + 1 - s]] = False
                total = from_score[k] + v.score[w]
                better = total > best[r, t + 1]
                r = r[better]
                best[r, t + 1], piece[r, t + 1], start[r, t + 1] = total[better], w[better], s
        r = row[alone]
        if len(r):
            end = s + long[r, s]
            total = from_score[alone] + v.unknown_score
            better = total > best[r, end]
            r, end = r[better], end[better]
            best[r, end], piece[r, end], start[r, end] = total[better], UNKNOWN, s
    rows, ends, pieces, starts = [], [], [], []
    row, at = np.arange(n), size.copy()
    while len(row):
        rows.append(row), ends.append(at), pieces.append(piece[row, at]), starts.append(start[row, at])
        at = start[row, at]
        row, at = row[at > 0], at[at > 0]
    rows, ends, pieces, starts = (np.concatenate(x) for x in (rows, ends, pieces, starts))
    order = np.argsort(rows * (width + 1) + ends, kind="stable")
    rows, pieces, starts, ends = rows[order], pieces[order], starts[order], ends[order]
    count = np.where(pieces == UNKNOWN, ends - starts, 1)
    ids = np.repeat(pieces, count)
    nth = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
    fallback = ids == UNKNOWN
    ids[fallback] = v.byte_id[grid[np.repeat(rows, count)[fallback], (np.repeat(starts, count) + nth)[fallback]]]
    return ids, np.bincount(rows, count, n).astype(np.int64)


def encode_texts(texts: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and where each text's ids begin (one more entry than texts)."""
    raw, at = bytes_of(texts)
    full = np.diff(at) > 0
    data = np.insert(raw, at[:-1][full], 32)  # the space in front
    begins = at + np.concatenate([[0], np.cumsum(full)])
    if len(data) == 0:
        return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
    cut[begins] = True
    cuts = np.flatnonzero(cut)
    coded = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    own, own_at = bytes_of(coded.dictionary)
    size = np.diff(own_at)
    order = np.argsort(size, kind="stable")
    count, parts, k = np.zeros(len(size), np.int64), [], 0
    while k < len(order):  # segments of similar length together
        longest = size[order[k:]]
        last = k + max(1, int(np.searchsorted(longest * np.arange(1, len(longest) + 1), MATRIX_CELLS // 4, side="right")))
        last = min(last, k + max(1, int(np.searchsorted(longest, max(16, 1.5 * longest[0]), side="right"))))
        group = order[k:last]
        ids, count[group] = viterbi(own, own_at[group], size[group], v)
        parts.append(ids)
        k = last
    flat = np.concatenate(parts)
    first = np.empty(len(size), np.int64)
    first[order] = np.cumsum(count[order]) - count[order]
    code = coded.indices.to_numpy(zero_copy_only=False)
    sizes = count[code]
    ends = np.cumsum(sizes)
    places = np.arange(ends[-1]) + np.repeat(first[code] - (ends - sizes), sizes)
    return flat[places], np.concatenate([[0], ends])[np.searchsorted(cuts, begins)]


def decode_ids(ids: np.ndarray, at: np.ndarray, v: Vocabulary) -> pa.Array:
    """The texts of lists of ids; ``at`` says where each begins. Bytes that are no UTF-8 become replacement signs."""
    size = np.diff(v.spelled_at)[ids]
    ends = np.cumsum(size)
    data = v.spelled[np.arange(ends[-1] if len(ends) else 0) + np.repeat(v.spelled_at[ids] - (ends - size), size)]
    begins = np.concatenate([[0], ends])[at]
    raw = data.tobytes()
    return pa.array([raw[a:b].removeprefix(b" ").decode(errors="replace") for a, b in zip(begins[:-1], begins[1:])], pa.string())


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every row."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = encode_texts(texts_of(part, "text"), vocabulary)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, source.select("doc_id").schema.add("ids", T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids); null ids count as none."""
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                lists = [np.asarray(x or (), np.int64) for x in part.column(1).to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), decode_ids(np.concatenate(lists), at, vocabulary)], ["doc_id", "text"])

    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(run, source.select("doc_id").schema.add("text", "string"))


def round_trips(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), and whether decoding gives the text back, for every row."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part, "text")
                ids, at = encode_texts(texts, vocabulary)
                back = decode_ids(ids, at, vocabulary)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
                same = [a == b for a, b in zip(texts.to_pylist(), back.to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "restored"])

    source = docs.select("doc_id", "text")
    return source.mapInArrow(run, source.select("doc_id").schema.add("n_ids", "long").add("ids_crc32", "long").add("restored", "boolean"))
