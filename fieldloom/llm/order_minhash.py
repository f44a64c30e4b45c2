"""Near-duplicate groups by Order MinHash, verified by banded alignment.

A text is a sequence of words (lower case, split at white space). Its 5-word k-mers carry their occurrence number, so repeats differ.
For each of ``bands`` random orders the ``picks`` smallest labelled k-mers are taken and kept in text order: two texts agree in a band
when they share those k-mers in the same sequence, which follows edit similarity rather than the set of words. One edit breaks five k-mers, so two
picks and many bands are taken; texts of fewer than ``SHORT`` words, where a few edits break all k-mers, are sketched by 2-word k-mers as well.

1. Equal texts are one node (their 128-bit digest). One pass writes every text's bands to the shared folder.
2. Per band, every other node is paired with the band's smallest node, never all with all. Two near copies agree in many bands, and
   in nearly all of them the smallest node is a near copy of both. Texts that failed - a crowd that shares a long passage, say - are sketched
   again with twice the picks, which a shared passage is ever less likely to fill, and twice the bands, until no pair fails. All steps are aggregations
   that combine before the shuffle, and joins whose skew Spark can split.
   Last, the texts of a band that are still in different components meet pair by pair, in blocks of bounded size: a pair that agrees in a band and was
   not tested is left out only where length or word parities rule it out, or where its two texts are linked through others already.
3. A pair is linked if the word edit distance is at most (1 - ``similarity``) of the longer text.
4. Linked nodes form components; the class of a document is the smallest doc_id of its component.

Defined cases: null texts count as empty; empty texts, and texts of white space, are near copies only of equal texts; a text of fewer
than five words has one k-mer, the whole text; repeated rows share a class, and ``keep_first`` keeps one of them; a class without any
id has a null class_id. Other columns pass through ``keep_first`` and are not read otherwise.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import bit_table, codes_of, hash_strings, maybe_in, mix, pieces_of, slices, texts_of, unused
from fieldloom.operators.graph_algorithms import components
from fieldloom.session import materialise

WORDS, PICKS, BANDS, SIMILARITY = 5, 2, 64, 0.8
SHORT, SHORT_WORDS = 50, 2
SKETCHED = 1 << 15
FEW, OFTEN = 32, 512
EDITS = 12
PARITY_WORDS, ROWS, MEETING, TILE = 32, 1024, 1024, 64  # numbers of 64 word parities per text, texts that take them at once, members of a block, and how many of them meet another block at once


def labelled_kmers(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-mers of all texts in text order, and the text each belongs to."""
    tokens, owner = pieces_of(pc.utf8_split_whitespace(pc.utf8_lower(texts)))
    if len(tokens) == 0:
        return np.empty(0, np.uint64), owner
    code, names = codes_of(tokens)
    word = hash_strings(names)[code]
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    at = np.arange(len(word))
    last = np.minimum(first[owner] + np.maximum(count[owner] - words, 0), at)
    begins = at[last == at]  # every start of a whole k-mer, or the first word of a short text
    kmer = np.zeros(len(begins), np.uint64)
    for k in range(words):
        place = begins + k
        inside = place < first[owner[begins]] + count[owner[begins]]
        kmer = mix(kmer + np.uint64(k + 1)) ^ np.where(inside, word[np.minimum(place, len(word) - 1)], np.uint64(0))
    kmer, own = mix(kmer), owner[begins]
    order = np.argsort(mix(kmer + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")  # equal k-mers of a text together, in text order
    fresh = np.concatenate([[True], (kmer[order][1:] != kmer[order][:-1]) | (own[order][1:] != own[order][:-1])])
    number = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    label = np.empty(len(order), np.uint64)
    label[order] = number.astype(np.uint64)
    return mix(kmer + label * np.uint64(0x9E3779B97F4A7C15)), own


def sketches(texts: pa.Array, words: int, picks: int, bands: int, short: int = 0) -> list:
    """The band keys of every text; none for texts without words. Texts of fewer than ``short`` words have as many keys again, from k-mers of SHORT_WORDS words."""
    kmer, own = labelled_kmers(texts, words)
    out: list = [[]] * len(texts)
    if len(kmer) == 0:
        return out
    heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    size = np.diff(np.append(heads, len(kmer)))
    keys = np.empty((len(heads), bands), np.uint64)
    start = 0
    while start < len(heads):  # a few texts at a time, so that the arrays stay in the processor's cache
        end = max(start + 1, int(np.searchsorted(heads, heads[start] + SKETCHED, side="right")) - 1) if heads[-1] + size[-1] > heads[start] + SKETCHED else len(heads)
        band_keys(kmer[heads[start]:heads[end - 1] + size[end - 1]], heads[start:end] - heads[start], size[start:end], picks, keys[start:end])
        start = end
    for row, text in enumerate(own[heads]):
        out[text] = keys[row].view(np.int64)
    few = own[heads][size <= short - words]
    if len(few):
        for text, more in zip(few, sketches(texts.take(pa.array(few)), SHORT_WORDS, picks, bands)):
            out[text] = np.concatenate([out[text], more])
    return out


def band_keys(kmer: np.ndarray, heads: np.ndarray, size: np.ndarray, picks: int, keys: np.ndarray) -> None:
    """Fill ``keys`` (a row per text, a column per band). The order of a band is that of the upper 32 bits of scattered k-mers; the lower ones hold the place."""
    place, low, top = np.arange(len(kmer), dtype=np.uint64), np.uint64(2 ** 32 - 1), np.uint64(2 ** 64 - 1)
    padded = np.append(kmer, np.uint64(0))
    for band in range(keys.shape[1]):
        value = mix(kmer ^ mix(np.array([band + 1], np.uint64))[0])
        value &= ~low
        value |= place
        spots = np.full((len(heads), picks), len(kmer), np.int64)
        for k in range(min(picks, int(size.max()))):
            least = (np.minimum.reduceat(value, heads) & low).astype(np.int64)
            live = size > k
            spots[live, k] = least[live]
            value[least[live]] = top
        spots.sort(axis=1)
        picked = padded[spots]
        key = np.full(len(heads), band, np.uint64)
        for k in range(picks):
            key = mix(key + picked[:, k] * np.uint64(2 * k + 1))
        keys[:, band] = key


def aligned(a: list, b: list, similarity: float) -> bool:
    """Is the word edit distance at most (1 - similarity) of the longer text?"""
    longer = max(len(a), len(b))
    most = int((1 - similarity) * longer + 1e-9)
    # at most ``most`` words of the longer text have no partner: words are counted first, which costs little beside the distance
    return abs(len(a) - len(b)) <= most and (Counter(a) & Counter(b)).total() >= longer - most and near(a, b, most)


def near(a: list, b: list, most: int) -> bool:
    """Edit distance at most ``most``? Near copies mostly differ in few words, which is soon found out; the band decides the others."""
    return few_edits(a, b, min(most, EDITS)) or (most > EDITS and within(a, b, most))


def few_edits(a: list, b: list, most: int) -> bool:
    """Edit distance at most ``most``? On each diagonal the row that so many edits can reach at the furthest; time grows with the length and the square of ``most``."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    reach: dict = {}
    for edits in range(most + 1):
        further = {}
        for k in range(-min(edits, n), min(edits, m) + 1):
            # a word of ``a`` changed or left out, or one of ``b`` put in
            i = min(max(reach.get(k, -2) + 1, reach.get(k + 1, -2) + 1, reach.get(k - 1, -2)), n, m - k) if edits else 0
            while i < n and i + k < m and a[i] == b[i + k]:
                i += 1
            further[k] = i
        if further.get(m - n) == n:
            return True
        reach = further
    return False


def within(a: list, b: list, most: int) -> bool:
    """Edit distance of two sequences at most ``most``? Computed in the band of that many diagonals either side of the main one.

    A column of the band is a pair of bit sets: rows where the distance rises (``up``) or falls (``down``) from the row above.
    One column follows from the last by a few operations on whole numbers of 2 * most + 1 bits, and the band moves down one row a column.
    Words that fill much of ``a`` have a bit set of all their rows, at most ``OFTEN`` words; of the others the rows are listed, so memory grows with the length.
    """
    n, m = len(a), len(b)
    if n == 0 or m == 0:
        return max(n, m) <= most
    places: dict = {}
    for i, word in enumerate(a):
        places.setdefault(word, []).append(i)
    rows = {word: sum(1 << i for i in at) for word, at in places.items() if len(at) > max(FEW, n // OFTEN)}
    every = (1 << 2 * most + 1) - 1
    up, down = every ^ ((1 << most) - 1), 0  # column 0 in the band's place for column 1: row r costs r
    distance = min(most, n)  # at the lowest row of the band, or the last row of all
    for j in range(1, m + 1):
        low = j - most - 1  # rows above the band
        word = b[j - 1]
        if word in rows:
            same = (rows[word] >> low if low >= 0 else rows[word] << -low) & every
        else:
            at = places.get(word, ())
            same = sum(1 << at[k] - low for k in range(bisect_left(at, low), bisect_right(at, low + 2 * most)))
        still = ((((same & up) + up) ^ up) | same | down) & every  # no cost along the diagonal
        right, left = (down | ~(still | up)) & every, still & up  # the distance rises or falls from the column before
        if j + most <= n:
            distance += not still >> 2 * most & 1
            spare = m - j - (n - most - j)
        else:
            last = n - j + most
            if last < 0:
                return False
            distance += (right >> last & 1) - (left >> last & 1)
            spare = m - j
        if distance > most + spare:
            return False
        up, down = (left | ~(still >> 1 | right)) & every, still >> 1 & right
    return distance <= most


def digest(text: str | Column) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")))


def band_table(docs: DataFrame, words: int = WORDS, picks: int = PICKS, bands: int = BANDS) -> DataFrame:
    """node and bands of every row of ``docs`` (doc_id, text)."""
    def sketch(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = sketches(texts_of(part, "text"), words, picks, bands, SHORT)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(found, pa.list_(pa.int64()))], ["node", "bands"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text"), digest("text").alias("node")).mapInArrow(sketch, "node binary, bands array<bigint>")


def alike(left: pa.Array, right: pa.Array, similarity: float) -> np.ndarray:
    """Which texts of ``left`` align with the one beside them? Words are numbers; those in common are counted for all pairs at once."""
    n = len(left)
    tokens, owner = pieces_of(pc.utf8_split_whitespace(pc.utf8_lower(pa.concat_arrays([left, right]))))
    if len(tokens) == 0:
        return np.ones(n, bool)
    code, names = codes_of(tokens)
    starts = np.searchsorted(owner, np.arange(2 * n + 1))
    size = np.diff(starts).reshape(2, n)
    longer = size.max(axis=0)
    most = ((1 - similarity) * longer + 1e-9).astype(np.int64)
    key = owner % n * len(names) + code
    (mine, times), (other, often) = (np.unique(side, return_counts=True) for side in (key[:starts[n]], key[starts[n]:]))
    both, x, y = np.intersect1d(mine, other, assume_unique=True, return_indices=True)
    common = np.bincount(both // len(names), weights=np.minimum(times[x], often[y]), minlength=n)
    good = common >= longer - most
    for i in np.flatnonzero(good):
        a, b = (code[starts[k]:starts[k + 1]].tolist() for k in (i, n + i))
        good[i] = near(a, b, int(most[i]))
    return good


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts align; ``texts`` has one row per node."""
    def verify(batches):
        for batch in batches:
            for part in slices(batch, "text_a"):
                for one in slices(part, "text_b"):
                    yield one.select(["a", "b"]).filter(pa.array(alike(texts_of(one, "text_a"), texts_of(one, "text_b"), similarity), pa.bool_()))

    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b"))
    return both.mapInArrow(verify, "a binary, b binary")


def shared_entries(sketched: DataFrame) -> DataFrame:
    """(node, band) of every band that several texts agree in.

    The first pass combines numbers by hash; in the second, a bit table keeps nearly all bands that one text has alone out of the shuffle.
    """
    brief = sketched.select(F.xxhash64("node").alias("brief"), F.explode("bands").alias("band"))
    shared = brief.groupBy("band").agg(F.min("brief").alias("low"), F.max("brief").alias("high")).where("low < high").select("band")
    shared = materialise(shared, "shared")
    table = bit_table(shared)

    def pick(batches):
        for batch in batches:
            node, bands = batch.column(0), batch.column(1)
            length = pc.list_value_length(bands).to_numpy(zero_copy_only=False)
            band, own = bands.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(length)), length)
            there = np.flatnonzero(maybe_in(table, band))
            yield pa.RecordBatch.from_arrays([node.take(pa.array(own[there])), pa.array(band[there])], ["node", "band"])

    return sketched.select("node", "bands").mapInArrow(pick, "node binary, band long").join(shared, "band", "left_semi").select("node", "band").distinct()


def links(docs: DataFrame, words: int = WORDS, picks: int = PICKS, bands: int = BANDS, similarity: float = SIMILARITY) -> DataFrame:
    """Verified pairs (a, b) of nodes: stars around the smallest node of every band, then of finer bands for those that failed."""
    crowd = first = materialise(shared_entries(materialise(band_table(docs, words, picks, bands), "bands")), "crowd")
    texts = materialise(docs.select(digest("text").alias("node"), F.coalesce("text", F.lit("")).alias("text"))
                        .join(crowd.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")
    empty = docs.sparkSession.createDataFrame([], "a binary, b binary")
    found, tested = empty, empty
    while not crowd.isEmpty():
        elected = crowd.groupBy("band").agg(F.min("node").alias("b"))
        met = crowd.join(elected, "band").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
        pairs = materialise(met.join(tested, ["a", "b"], "left_anti"), "pairs")
        good = materialise(verified(pairs, texts, similarity), "links")
        found, tested = found.union(good), tested.union(pairs)
        failed = materialise(pairs.join(good, ["a", "b"], "left_anti").select(F.col("a").alias("node")).distinct(), "failed")
        if failed.isEmpty():
            break
        picks, bands = 2 * picks, 2 * bands
        finer = band_table(texts.join(failed, "node", "left_semi").select("text"), words, picks, bands)
        crowd = materialise(shared_entries(materialise(finer, "bands")), "crowd")
    rest = materialise(apart(first, texts, found, similarity).join(tested, ["a", "b"], "left_anti"), "pairs")
    return found.union(materialise(verified(rest, texts, similarity), "links"))


def parities(texts: DataFrame, numbered: bool = False) -> DataFrame:
    """node, n_words and parity (the counts modulo 2 of the words in 64 * PARITY_WORDS hash buckets) of every text.

    Texts at edit distance d leave at most d words each without a partner, so parities that differ and the difference in length add up to at most 2 d.
    With ``numbered`` each occurrence of a word is a word of its own, so that counts which differ by two show as well.
    """
    def count(batches):
        width = 64 * PARITY_WORDS
        for batch in batches:
            for part in slices(batch, "text"):
                for start in range(0, part.num_rows, ROWS):
                    few = part.slice(start, ROWS)
                    tokens, owner = pieces_of(pc.utf8_split_whitespace(pc.utf8_lower(texts_of(few, "text"))))
                    bits = np.zeros(few.num_rows * width, np.uint8)
                    if len(tokens):
                        code, names = codes_of(tokens)
                        word = hash_strings(names)[code]
                        if numbered:
                            order = np.argsort(owner * len(names) + code, kind="stable")
                            fresh = np.concatenate([[True], (code[order][1:] != code[order][:-1]) | (owner[order][1:] != owner[order][:-1])])
                            number = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
                            word[order] = mix(word[order] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                        np.bitwise_xor.at(bits, owner * width + (word % np.uint64(width)).astype(np.int64), np.uint8(1))
                    parity = pa.ListArray.from_arrays(pa.array(np.arange(few.num_rows + 1, dtype=np.int32) * PARITY_WORDS), pa.array(np.packbits(bits).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([few.column(0), pa.array(np.bincount(owner, minlength=few.num_rows)), parity], ["node", "n_words", "parity"])

    return texts.select("node", "text").mapInArrow(count, "node binary, n_words long, parity array<bigint>")


def apart(crowd: DataFrame, texts: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a > b) of nodes that agree in a band, are in different components of ``found`` and may align by length and word parities.

    Only bands with several components are open. Their members are dealt to blocks, and a task takes the members of two blocks of a band (or of one); only pairs that
    may align leave it.
    """
    linked = found.select(F.col("a").alias("id")).union(found.select("b")).distinct()
    labels = components(linked, found.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("node"), "component")
    member = materialise(crowd.join(labels, "node", "left").select("node", "band", F.xxhash64(F.coalesce("component", "node")).alias("component")), "members")
    sizes = member.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high")
    inside = materialise(member.join(sizes.select("band", F.ceil(F.col("n") / MEETING).cast("int").alias("blocks")), "band"), "members")
    marks = materialise(parities(texts.join(inside.select("node").distinct(), "node", "left_semi"), numbered=True), "parities")
    dealt = inside.join(marks, "node").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", F.col("n_words").cast("int").alias("n"), "parity")

    def meet(batches):
        held = None
        for batch in batches:
            held = pa.concat_batches([held, batch]) if held is not None else batch
            keys = np.stack([held.column(k).to_numpy() for k in range(3)])
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if held.num_rows else np.zeros(1, np.int64)
            if starts[-1]:
                yield may_align(held.slice(0, starts[-1]), starts, similarity)
            held = held.slice(starts[-1])  # its rows may go on in the next batch
        if held is not None and held.num_rows:
            yield may_align(held, np.array([0, held.num_rows]), similarity)

    return met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(meet, "a binary, b binary").distinct()


def may_align(rows: pa.RecordBatch, starts: np.ndarray, similarity: float) -> pa.RecordBatch:
    """Pairs (a > b) of different components in each group of ``rows`` (band, i, j, own, node, component, n, parity) that length and parities allow; with two blocks, of one from each."""
    own, component, n = (rows.column(k).to_numpy() for k in (3, 5, 6))
    parity = rows.column(7).flatten().to_numpy().view(np.uint64).reshape(rows.num_rows, -1)
    one_block = rows.column(1).to_numpy() == rows.column(2).to_numpy()
    first, second = [], []
    for start, end in zip(starts[:-1], starts[1:]):
        if one_block[start]:
            left = right = np.arange(start, end)
        else:
            left, right = (start + np.flatnonzero((own[start:end] == own[start]) == same) for same in (True, False))
        for at in range(0, len(left), TILE):
            x = left[at:at + TILE]
            y = right[at:] if one_block[start] else right
            fits = component[x][:, None] != component[y]
            if one_block[start]:
                fits &= x[:, None] < y
            i, j = np.nonzero(fits)
            x, y = x[i], y[j]
            most = ((1 - similarity) * np.maximum(n[x], n[y]) + 1e-9).astype(np.int64)
            differ = np.abs(n[x] - n[y]).astype(np.int64)
            for k in range(parity.shape[1]):  # most pairs are out after a few words
                some = differ <= 2 * most
                x, y, most, differ = x[some], y[some], most[some], differ[some]
                differ += np.bitwise_count(parity[x, k] ^ parity[y, k])
            some = differ <= 2 * most
            first.append(x[some])
            second.append(y[some])
    x, y = (np.concatenate([np.empty(0, np.int64), *part]) for part in (first, second))
    node = rows.column(4)
    a, b = node.take(pa.array(x)), node.take(pa.array(y))
    swap = pc.less(a, b)
    return pa.RecordBatch.from_arrays([pc.if_else(swap, b, a), pc.if_else(swap, a, b)], ["a", "b"])


def near_copies(docs: DataFrame, words: int = WORDS, picks: int = PICKS, bands: int = BANDS, similarity: float = SIMILARITY,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node (digest of the text), class_id, class_size and is_first for every row.

    The rows that are first in a class carry its smallest id and, of the texts with that id, the smallest digest: several
    rows of a class are first only if they repeat id and text.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = links(plain, words, picks, bands, similarity)
    linked = found.select(F.col("a").alias("id")).union(found.select("b")).distinct()
    labels = components(linked, found.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rows = plain.select("doc_id", digest("text").alias("node"))
    member = rows.join(labels.withColumnRenamed("id", "node"), "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("class"))
    ranked = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("node").alias("node"))
    heads = member.groupBy("class").agg(F.min(ranked).alias("head"), F.count("*").alias("class_size"))
    return member.join(heads, "class").select(
        "doc_id", "node", F.col("head.id").alias("class_id"), "class_size",
        (F.col("doc_id").eqNullSafe(F.col("head.id")) & (F.col("node") == F.col("head.node"))).alias("is_first"))


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, class_size, kept for every row of ``docs``."""
    return near_copies(docs, **options).select("doc_id", "class_id", "class_size", F.col("is_first").alias("kept"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of each class of ``docs``: the first, with all its columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = materialise(near_copies(docs, **options), "classes")
    node = unused("node", docs.columns)
    gone = found.where(~F.col("is_first")).select(F.col("node").alias(node), F.col("doc_id").alias("_id")).distinct()
    marked = docs.withColumn(node, digest(text_col))
    kept = marked.join(gone, (marked[node] == gone[node]) & marked[id_col].eqNullSafe(gone["_id"]), "left_anti")
    repeated = materialise(found.where("is_first").groupBy(F.col("node").alias(node)).count().where("count > 1").select(node), "repeated")
    if not repeated.isEmpty():  # rows repeated with id and text
        kept = kept.join(repeated, node, "left_anti").unionByName(kept.join(repeated, node, "left_semi").dropDuplicates([node]))
    return kept.select(*docs.columns)
