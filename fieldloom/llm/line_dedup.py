"""Line dedup: an exact set-similarity join of lines; a line that matches an earlier one goes.

A line is the set of its words (lower case, split at ASCII white space). It matches another if their Jaccard similarity is at least ``similarity``.
Lines are ordered by document id, a 64-bit hash of the whole text, and line number; a line is removed if any earlier line matches it, removed or not.

1. Word frequencies over all lines are counted in 2^20 hash buckets, a table of constant size. It only orders words by rarity.
2. Equal sets are one class with its first line (an aggregation that combines before the shuffle). Every later line of a
   class is removed, so only the first lines are left to decide, and copies never meet in the join.
3. The first words of a class in order of rarity (its prefix) are join keys. Rows of one key meet in blocks; within a block, arrays are compared
   at growing distance in order of size, under the length filter, the positional filter and a 128-bit symmetric-difference bound.
   Keys with more than ``block`` rows are split, and each pair of blocks is a group of its own.
4. Every class goes on with its closest earlier candidate, whose words are compared in full. Where that fails, the other candidates
   listed for it (a few a key) are compared, and where a key had more than were listed, all of them. So a crowd of near copies costs about
   one check a line, and no match is lost.

Defined cases: null texts count as empty; lines without words are no lines: they are kept and match nothing; ids are integers, null ids come last; rows
that share an id, or have none, are told apart by the hash of their text (``copy``; 0 for all where ids differ), so only rows repeated with id and text tie: they are decided together and stay
alike; an empty table yields no rows. Other columns pass through ``without_repeats``; a text whose lines all go becomes empty, its row stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import codes_of, distinct, hash_strings, mix, pieces_of, slices, texts_of, unused
from fieldloom.session import discard, materialise

SIMILARITY, BUCKETS, CHUNK, BLOCK, LISTED = 0.8, 1 << 20, 1 << 14, 2000, 6
LAST_ID = 2 ** 63 - 1
FILTER_BITS = 1 << 25
GATHERED_ROWS = 250_000
PLACE, WITH = ["doc", "copy", "line"], ["with_doc", "with_copy", "with_line"]


def line_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every word of every line: the line it belongs to and its code; the 64-bit hash of every code; and for every line its text and number."""
    lists = pc.split_pattern(texts, "\n")
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    words, owner = pieces_of(pc.ascii_split_whitespace(pc.utf8_lower(lists.flatten())))
    code, names = codes_of(words)
    return owner, code, hash_strings(names), np.stack([text, number])


def frequencies(docs: DataFrame) -> np.ndarray:
    """How often words of each hash bucket occur in all lines; summed by Spark as vectors of one size.

    Every task sends a whole table, so there are two tasks a core at most: what is sent does not grow with the input.
    """
    def count(batches):
        total = np.zeros(BUCKETS)
        for batch in batches:
            for part in slices(batch, "text"):
                _, code, hashes, _ = line_words(texts_of(part, "text"))
                if len(code):
                    total += np.bincount((hashes & np.uint64(BUCKETS - 1)).astype(np.int64)[code], minlength=BUCKETS)
        chunks = total.reshape(-1, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array(list(chunks), pa.list_(pa.float64()))], ["chunk", "counts"])

    found = docs.select("text").coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(count, "chunk int, counts array<double>")
    summed = found.groupBy("chunk").agg(vector_to_array(Summarizer.sum(array_to_vector("counts"))).alias("counts"))
    out = np.zeros((BUCKETS // CHUNK, CHUNK))
    for row in summed.toArrow().to_pylist():  # BUCKETS numbers in all
        out[row["chunk"]] = row["counts"]
    return np.minimum(out.ravel(), 2 ** 32 - 1).astype(np.uint32)


def overlap_needed(a, b, similarity):
    return np.ceil(similarity / (1 + similarity) * (a + b) - 1e-9).astype(np.int64)


def line_sets(docs: DataFrame, counts: np.ndarray, similarity: float, block: int) -> DataFrame:
    """One row per line with words: its place, the digest of its set, size, 128 parity bits and the prefix in order of rarity.

    The first ``rare`` words of the prefix are in buckets of at most ``block`` occurrences, so their keys cannot be hot.
    """
    def describe(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                owner, code, hashes, where = line_words(texts_of(part, "text"))
                if len(owner) == 0:
                    continue
                often = counts[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
                order = np.lexsort((hashes, often))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                keys = distinct(owner * len(order) + rank[code])
                own, word = keys // len(order), order[keys % len(order)]
                heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                size = np.diff(np.append(heads, len(own)))
                h = hashes[word]
                bit = (h >> np.uint64(40)) & np.uint64(127)
                one = np.uint64(1) << (bit & np.uint64(63))
                least = np.ceil(similarity * size - 1e-9).astype(np.int64)
                prefix = size - least + 1
                place = np.arange(len(own)) - np.repeat(heads, size)
                inside = place < np.repeat(prefix, size)
                rare = np.add.reduceat((inside & (often[word] <= block)).astype(np.int64), heads)
                docs_of, copies_of = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                line = own[heads]
                starts = np.concatenate([[0], np.cumsum(prefix)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs_of[where[0][line]], pa.int64()), pa.array(copies_of[where[0][line]], pa.int64()), pa.array(where[1][line], pa.int32()),
                    pa.array(np.add.reduceat(mix(h), heads).view(np.int64)), pa.array(np.add.reduceat(mix(h ^ np.uint64(0x5DEECE66D)), heads).view(np.int64)),
                    pa.array(size, pa.int32()), pa.array(rare, pa.int32()),
                    pa.array(np.bitwise_xor.reduceat(np.where(bit < 64, one, np.uint64(0)), heads).view(np.int64)),
                    pa.array(np.bitwise_xor.reduceat(np.where(bit < 64, np.uint64(0), one), heads).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(h[inside].astype(np.uint32).view(np.int32))),
                ], ["doc", "copy", "line", "c1", "c2", "size", "rare", "b1", "b2", "prefix"])

    return docs.mapInArrow(describe, "doc long, copy long, line int, c1 long, c2 long, size int, rare int, b1 long, b2 long, prefix array<int>")


def prefix_rows(classes: DataFrame, frequent: bool) -> DataFrame:
    """One row per word of the prefixes: of the rare words, whose keys cannot be hot, or of the frequent ones."""
    part = F.slice("prefix", F.col("rare") + 1, F.size("prefix")) if frequent else F.slice("prefix", F.lit(1), F.col("rare"))
    rows = classes.select(*PLACE, "size", "rare", "b1", "b2", F.posexplode(part).alias("pos", "token"))
    return rows.withColumn("pos", F.col("pos") + F.col("rare")).drop("rare") if frequent else rows.drop("rare")


def in_blocks(rare: DataFrame, frequent: DataFrame, block: int) -> DataFrame:
    """The rows of every key, with the groups they meet in: one for most keys; for a hot key one per pair of its blocks."""
    hot = frequent.groupBy("token").count().where(F.col("count") > block).select("token", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    cold = rare.unionByName(frequent.join(hot, "token", "left_anti"))
    own = F.pmod(F.xxhash64(*PLACE), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    split = (frequent.join(hot, "token").withColumn("own", own).select("*", other)
             .withColumn("part", 1 + F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
             .withColumn("side", F.when(F.col("own") == F.col("other"), 0).otherwise(F.col("own") + 1)))  # two blocks: only rows of different sides meet
    names = ["token", "part", "side", *[c for c in rare.columns if c != "token"]]
    return cold.withColumns({"part": F.lit(0), "side": F.lit(0)}).select(names).unionByName(split.select(names))


def near_pairs(rows: dict, similarity: float):
    """Places (i, j) in arrays sorted by group and size of pairs that pass the filters, and how many words they differ by at least."""
    group, size = rows["group"], rows["size"]
    i = np.arange(len(group) - 1)
    step = 1
    while len(i):
        j = i + step
        i = i[(group[i] == group[np.minimum(j, len(group) - 1)]) & (j < len(group))]
        j = i + step
        fits = size[i] >= similarity * size[j] - 1e-9
        i, j = i[fits], j[fits]  # sizes grow with j: who fails now fails for good
        need = overlap_needed(size[i], size[j], similarity)
        good = (rows["pos"][i] <= size[i] - need) & (rows["pos"][j] <= size[j] - need) & ((rows["side"][i] == 0) | (rows["side"][i] != rows["side"][j]))
        a, b, need = i[good], j[good], need[good]
        differ = sum(np.bitwise_count((rows[k][a] ^ rows[k][b]).view(np.uint64)).astype(np.int64) for k in ("b1", "b2"))
        near = differ <= size[a] + size[b] - 2 * need
        if near.any():
            yield a[near], b[near], differ[near]
        i = i[i + step + 1 < len(group)]
        step += 1


def candidates(grouped: DataFrame, similarity: float, every: bool = False) -> DataFrame:
    """Later line, earlier line, and the least difference of their sets: for each later line and group the ``LISTED`` closest ones, the first
    of them counting those left out too; or with ``every`` all of the lines marked ``asked``."""
    schema = "doc long, copy long, line int, with_doc long, with_copy long, with_line int, differ int, found int"

    def meet(table):
        rows = {name: table.column(name).to_numpy(zero_copy_only=False) for name in table.column_names}
        fresh = (rows["token"][1:] != rows["token"][:-1]) | (rows["part"][1:] != rows["part"][:-1])
        rows["group"] = np.concatenate([[0], np.cumsum(fresh)])
        rows["size"] = rows["size"].astype(np.int64)
        order = np.argsort((rows["group"] << 32) + rows["size"])
        rows = {name: rows[name][order] for name in rows if name not in ("token", "part")}
        parts = []
        for a, b, differ in near_pairs(rows, similarity):
            doc, copy, line = (rows[k] for k in PLACE)
            one_doc, one_copy = doc[a] == doc[b], copy[a] == copy[b]
            a_later = (doc[a] > doc[b]) | (one_doc & ((copy[a] > copy[b]) | (one_copy & (line[a] > line[b]))))
            tie = one_doc & one_copy & (line[a] == line[b])
            late, early = np.where(a_later, a, b)[~tie], np.where(a_later, b, a)[~tie]
            differ = differ[~tie]
            if every:
                asked = rows["asked"][late]
                late, early, differ = late[asked], early[asked], differ[asked]
            elif len(parts) > 8:  # keep the best so far only
                parts = [best(parts)]
            parts.append((late, early, differ, np.ones(len(late), np.int64)))
        if not parts:
            return None
        late, early, differ, found = tuple(np.concatenate(x) for x in zip(*parts)) if every else best(parts)
        places = [pa.array(rows[k][at]) for at in (late, early) for k in PLACE]
        return pa.RecordBatch.from_arrays([*places, pa.array(differ, pa.int32()), pa.array(found, pa.int32())], [*PLACE, *WITH, "differ", "found"])

    def best(parts):
        late, early, differ, found = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((early, differ, late))
        late, early, differ, found = late[order], early[order], differ[order], found[order]
        if len(late) == 0:
            return late, early, differ, found
        first = np.flatnonzero(np.concatenate([[True], late[1:] != late[:-1]]))
        size = np.diff(np.append(first, len(late)))
        nth = np.arange(len(late)) - np.repeat(first, size)
        left_out = np.add.reduceat(found, first) - np.minimum(size, LISTED)
        found = np.where(nth == 0, np.repeat(left_out, size) + 1, 1)
        keep = nth < LISTED
        return late[keep], early[keep], differ[keep], found[keep]

    def meet_all(batches):
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < GATHERED_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            token, part = table.column("token").to_numpy(), table.column("part").to_numpy()
            last = np.flatnonzero((token != token[-1]) | (part != part[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            if cut:
                out = meet(table.slice(0, cut))
                if out is not None:
                    yield out
            held, count = table.slice(cut).to_batches(), table.num_rows - cut
        if count:
            out = meet(pa.Table.from_batches(held).combine_chunks())
            if out is not None:
                yield out

    return grouped.repartition("token", "part").sortWithinPartitions("token", "part").mapInArrow(meet_all, schema)


def asked_lines(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """doc, copy, line, text of the lines in ``asked`` (doc, copy, line). A bit table of constant size keeps most others out of the join."""
    def bits(doc, copy, line):
        key = doc.astype(np.int64).view(np.uint64) + mix(copy.astype(np.int64).view(np.uint64))
        return (mix(key * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)

    def mark(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bits(*(batch.column(i).to_numpy() for i in range(3))))], ["bit"])

    words = (asked.select(*PLACE).mapInArrow(mark, "bit long").groupBy(F.floor(F.col("bit") / 64).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("bits")).toArrow())
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    table = table.view(np.uint8)

    def pick(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                lists = pc.split_pattern(texts_of(part, "text"), "\n")
                count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                doc, copy = (np.repeat(part.column(i).to_numpy(zero_copy_only=False), count) for i in (0, 1))
                line = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                bit = bits(doc, copy, line)
                there = np.flatnonzero(table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                yield pa.RecordBatch.from_arrays([pa.array(doc[there]), pa.array(copy[there]), pa.array(line[there], pa.int32()), lists.flatten().take(pa.array(there))], [*PLACE, "text"])

    lines = docs.mapInArrow(pick, "doc long, copy long, line int, text string")
    return lines.join(asked.select(*PLACE), PLACE, "left_semi")


def matching(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The later lines (doc, copy, line) of the pairs whose word sets are similar, compared in full; a stored table."""
    earlier = [F.col(w).alias(p) for w, p in zip(WITH, PLACE)]
    asked = materialise(pairs.select(*PLACE).union(pairs.select(*earlier)).distinct(), "asked")
    lines = materialise(asked_lines(docs, asked), "lines")

    def verify(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part, good = batch.slice(k, 1000), []
                a, b = (pc.ascii_split_whitespace(pc.utf8_lower(part.column(i))).to_pylist() for i in (3, 4))
                for x, y in zip(a, b):
                    x, y = {w for w in x if w}, {w for w in y if w}
                    common = len(x & y)
                    good.append(common > 0 and common >= similarity * (len(x) + len(y) - common) - 1e-9)
                yield part.select([0, 1, 2]).filter(pa.array(good, pa.bool_()))

    early = lines.select(*[F.col(p).alias(w) for w, p in zip(WITH, PLACE)], F.col("text").alias("with_text"))
    both = pairs.join(lines, PLACE).join(early, WITH).select(*PLACE, "text", "with_text")
    gone = materialise(both.mapInArrow(verify, "doc long, copy long, line int").distinct(), "matches")
    discard(asked, lines)
    return gone


def id_order(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(LAST_ID)).cast("long")


def text_key(column: str | Column) -> Column:
    """The same for equal texts, on every run."""
    return F.xxhash64(F.coalesce(column, F.lit("")))


def copy_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells the rows of one id apart: the hash of their text, or 0 where no two rows share an id (a hash does not compress, and every row of the join carries it)."""
    shared = docs.select(id_order(id_col).alias("doc")).groupBy("doc").count().where("count > 1")
    return F.lit(0).cast("long") if shared.isEmpty() else text_key(text_col)


def kept_lines(docs: DataFrame, copy: Column, similarity: float = SIMILARITY, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, copy, line) of every line with words that no earlier line matches; ``doc`` is the id, or LAST_ID for a null one, ``copy`` that of ``copy_key``."""
    plain = docs.select(id_order(id_col).alias("doc"), copy.alias("copy"), F.coalesce(text_col, F.lit("")).alias("text"))
    sets = line_sets(plain, frequencies(plain), similarity, block)
    first = F.min(F.struct(*PLACE, "size", "rare", "b1", "b2", "prefix")).alias("first")
    classes = materialise(sets.groupBy("c1", "c2").agg(first).select("first.*"), "line-classes")
    rare, frequent = prefix_rows(classes, False), prefix_rows(classes, True)
    found = materialise(candidates(in_blocks(rare, frequent, block), similarity), "candidates")
    pairs = found.groupBy(*PLACE, *WITH).agg(F.min("differ").alias("differ"), F.max("found").alias("found"))
    best = pairs.groupBy(*PLACE).agg(F.min(F.struct("differ", *WITH)).alias("best"), F.count("*").alias("listed"), F.max("found").alias("found"))
    best = materialise(best.select(*PLACE, *[f"best.{w}" for w in WITH], (F.col("listed") > 1).alias("more"), (F.col("found") > 1).alias("unlisted")), "best")
    gone = matching(best, plain, similarity)
    key, both = PLACE, [*PLACE, *WITH]
    # lines whose closest candidate failed: the others listed, then those of crowds that were not listed
    open_ = materialise(best.where("more").join(gone, key, "left_anti").select(*PLACE, "unlisted"), "open")
    if not open_.isEmpty():
        tested = best.select(both)
        rest = materialise(pairs.join(open_, key, "left_semi").select(both).join(tested, both, "left_anti"), "rest")
        gone = gone.union(matching(rest, plain, similarity))
        open_ = materialise(open_.where("unlisted").join(gone, key, "left_anti").select(key), "open")
        if not open_.isEmpty():
            tokens = materialise(classes.join(open_, key, "left_semi").select(F.explode("prefix").alias("token")).distinct(), "tokens")
            asked = open_.withColumn("asked", F.lit(True))

            def marked(rows):
                return rows.join(tokens, "token", "left_semi").join(asked, key, "left").withColumn("asked", F.coalesce("asked", F.lit(False)))

            far = candidates(in_blocks(marked(rare), marked(frequent), block), similarity, every=True).select(both).distinct()
            far = materialise(far.join(tested.union(rest), both, "left_anti"), "rest")
            gone = gone.union(matching(far, plain, similarity))
    discard(found, best)
    return classes.select(*PLACE).join(gone, PLACE, "left_anti")


def has_words(line: Column) -> Column:
    return F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]"))


def report(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, n_lines (with words), n_kept and the numbers of the kept lines, for every row of ``docs``."""
    copy = copy_key(docs, "doc_id", "text")
    kept = kept_lines(docs, copy, similarity, block).groupBy("doc", "copy").agg(F.sort_array(F.collect_set("line")).alias("kept"))
    parts = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), has_words).alias("worded")
    rows = docs.select("doc_id", id_order("doc_id").alias("doc"), copy.alias("copy"), parts).join(kept, ["doc", "copy"], "left")
    own = F.filter(F.coalesce("kept", F.array().cast("array<int>")), lambda i: F.coalesce(F.get("worded", i), F.lit(False)))
    return rows.select("doc_id", F.size(F.filter("worded", lambda w: w)).alias("n_lines"), own.alias("kept_lines")).withColumn("n_kept", F.size("kept_lines"))


def without_repeats(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text",
                    chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the removed lines taken out of the text, and ``n_chars`` adjusted where there is such a column."""
    own = copy_key(docs, id_col, text_col)
    kept = kept_lines(docs, own, similarity, block, id_col, text_col).groupBy("doc", "copy").agg(F.collect_set("line").alias("lines"))
    key, copy, lines = (unused(name, docs.columns) for name in ("doc_key", "text_key", "lines_kept"))
    rows = (docs.withColumns({key: id_order(id_col), copy: own})
            .join(kept.select(F.col("doc").alias(key), F.col("copy").alias(copy), F.col("lines").alias(lines)), [key, copy], "left")
            .select(*docs.columns, lines))
    text_at, blank = docs.columns.index(text_col), " \t\n\v\f\r"

    def clean(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                texts = []
                for text, stay in zip(part.column(text_at).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                    if text is not None:
                        stay = set(stay or ())
                        text = "\n".join(line for i, line in enumerate(text.split("\n")) if i in stay or not line.strip(blank))
                    texts.append(text)
                columns = part.columns[:-1]
                columns[text_at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1])

    out = rows.mapInArrow(clean, docs.schema)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.coalesce(F.length(text_col), F.col(chars_col)).cast(docs.schema[chars_col].dataType))
    return out
