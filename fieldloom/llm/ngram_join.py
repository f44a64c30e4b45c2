"""Exact Jaccard join of texts on word shingles, through a token-group matrix.

A text is the set of its ``WORDS``-word shingles (A-Z in small letters, words split at ASCII white space); two link when ``percent`` of their union is in both. The result
is each document's component of links, so copies are never paired: equal sets are one class, and a class that is linked to a component needs no second link to it.

1. Two passes over the texts describe every set: its size, a 128-bit digest, and its prefix, the shingles of which at least one is in every set it can link with. Shingles are
   ordered by rarity, from a table of hash buckets counted over all texts; the table grows with the documents up to ``MOST_BUCKETS``. The order changes the work, never the result.
2. Prefix shingles held by one class alone are dropped, by an aggregation that combines before the shuffle. The few others go on (``crowd``).
3. Similar classes form groups: a class goes to the smallest class that it shares a prefix shingle with. Groups are cut by hash into parts of a bounded number of members and shingles, and a task
   links the members of its part with each other.
4. Token-group matrix: per shingle the parts that hold it. A class asks the parts that share a prefix shingle with it and hold something it is not connected to; of two sides the smaller component asks,
   its first class before the others. A task holds a part's members and the union of their shingles. It counts how many of the asking class's shingles are in the union, the most that any member can
   share; only where that suffices the part is opened and members are compared in full, one hit per component.
5. The links give the components. Parts that many classes ask are copied to several tasks.

Defined cases: texts without words, and null texts, have no shingles and their own id as component; a text of fewer words is one shingle; rows without id take part and have the smallest id of their component
(null where it has none); rows that share an id or repeat are rows of their own; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import bit_table, codes_of, hash_strings, maybe_in, mix, pieces_of, slices, texts_of
from fieldloom.operators.graph_algorithms import components
from fieldloom.session import discard, materialise

WORDS, PERCENT = 4, 85
BUCKETS, MOST_BUCKETS, CHUNK, DOCS_A_BUCKET = 1 << 20, 1 << 24, 1 << 14, 1
MEMBERS, MEMBER_SHINGLES, ASKED = 256, 1 << 20, 2000


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of all texts, in order within each, and where each text's begin (one more entry than texts)."""
    tokens, owner = pieces_of(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
    starts = np.zeros(len(texts) + 1, np.int64)
    if len(tokens) == 0:
        return np.empty(0, np.uint64), starts
    code, names = codes_of(tokens)
    word = hash_strings(names)[code]
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    at = np.arange(len(word))
    begins = at[np.minimum(first[owner] + np.maximum(count[owner] - words, 0), at) == at]  # every start of a whole shingle, or the first word of a short text
    own = owner[begins]
    shingle, stop = np.zeros(len(begins), np.uint64), (first + count)[own]
    for k in range(words):
        place = begins + k
        shingle = mix(shingle + np.uint64(k + 1)) ^ np.where(place < stop, word[np.minimum(place, len(word) - 1)], np.uint64(0))
    shingle = mix(shingle)
    order = np.lexsort((shingle, own))
    shingle, own = shingle[order], own[order]
    fresh = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (own[1:] != own[:-1])])
    starts[1:] = np.cumsum(np.bincount(own[fresh], minlength=len(texts)))
    return shingle[fresh], starts


def overlap_needed(a, b, percent: int):
    """The fewest shared shingles of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def frequencies(docs: DataFrame, words: int, buckets: int) -> np.ndarray:
    """In how many texts shingles of each hash bucket occur; summed by Spark as vectors of one size."""
    def count(batches):
        total = np.zeros(buckets)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount((shingle_sets(texts_of(part, "text"), words)[0] & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        chunks = total.reshape(-1, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array(list(chunks), pa.list_(pa.float64()))], ["chunk", "counts"])

    found = docs.select("text").mapInArrow(count, "chunk int, counts array<double>")
    summed = found.groupBy("chunk").agg(vector_to_array(Summarizer.sum(array_to_vector("counts"))).alias("counts"))
    out = np.zeros((buckets // CHUNK, CHUNK))
    for row in summed.toArrow().to_pylist():  # ``buckets`` numbers in all
        out[row["chunk"]] = row["counts"]
    return np.minimum(out.ravel(), 2 ** 31 - 1).astype(np.int32)


def described(docs: DataFrame, counts: np.ndarray, words: int, percent: int) -> DataFrame:
    """doc_id, t1, t2, size, digest (c1, c2) and prefix of every row of ``docs`` (doc_id, t1, t2, text); the first ``indexed`` of the prefix meet sets that are no smaller."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def describe(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, starts = shingle_sets(texts_of(part, "text"), words)
                size = np.diff(starts)
                own = np.repeat(np.arange(len(size)), size)
                often = counts[(hashes & np.uint64(len(counts) - 1)).astype(np.int64)].astype(np.int64)
                order = np.argsort((own << 31) + often, kind="stable")  # equal counts stay in order of the hash
                prefix = np.where(size > 0, size - -(-percent * size // 100) + 1, 0)
                indexed = np.where(size > 0, size - overlap_needed(size, size, percent) + 1, 0)
                inside = np.arange(len(own)) - np.repeat(starts[:-1], size) < np.repeat(prefix, size)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)))]) for salt in (0x9E3779B9, 0x5DEECE66D)]
                c1, c2 = ((s[starts[1:]] - s[starts[:-1]]).view(np.int64) for s in sums)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(prefix)]), pa.int32()), pa.array(hashes[order[inside]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(size, pa.int32()), pa.array(c1), pa.array(c2), pa.array(indexed, pa.int32()), lists],
                                                 ["doc_id", "t1", "t2", "size", "c1", "c2", "indexed", "prefix"])

    return docs.mapInArrow(describe, f"doc_id {kind}, t1 long, t2 long, size int, c1 long, c2 long, indexed int, prefix array<bigint>")


def shared_shingles(classes: DataFrame) -> DataFrame:
    """token, pos, cls, size, indexed of the prefix shingles that several classes hold; a bit table keeps nearly all others out of the shuffle."""
    entries = classes.select("cls", "indexed", F.posexplode("prefix").alias("pos", "token"))
    brief = entries.select("token", "cls", (F.col("pos") < F.col("indexed")).alias("first"))
    shared = brief.groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.max("first").alias("first")).where("low < high AND first").select("token")
    shared = materialise(shared, "shared")
    table = bit_table(shared)

    def pick(batches):
        for batch in batches:
            cls, size, indexed, prefix = (batch.column(i) for i in range(4))
            length = pc.list_value_length(prefix).to_numpy(zero_copy_only=False).astype(np.int64)
            token, own = prefix.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(length)), length)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
            there = np.flatnonzero(maybe_in(table, token))
            own = pa.array(own[there])
            yield pa.RecordBatch.from_arrays([pa.array(token[there]), pa.array(pos[there], pa.int32()), cls.take(own), size.take(own), indexed.take(own)], ["token", "pos", "cls", "size", "indexed"])

    likely = classes.select("cls", "size", "indexed", "prefix").mapInArrow(pick, "token long, pos int, cls long, size int, indexed int")
    return likely.join(shared, "token", "left_semi")


def texts_for(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """cls, part, sub and text of ``placed`` (with t1, t2). Texts of other classes are not shuffled, but for a few that the bit table lets through."""
    table = bit_table(placed.select("t1"))

    def pick(batches):
        for batch in batches:
            yield batch.filter(pa.array(maybe_in(table, batch.column(0).to_numpy())))

    wanted = placed.select("t1", "t2", "cls", "part", "sub")
    found = docs.select("t1", "t2", "text").mapInArrow(pick, "t1 long, t2 long, text string").join(wanted, ["t1", "t2"])
    return found.groupBy("t1", "t2", "cls", "part", "sub").agg(F.first("text").alias("text")).drop("t1", "t2")  # dealt as the join was


class Part:
    """Members of a group's part with the union of their shingles."""

    def __init__(self):
        self.names, self.joined, self.sets, self.sizes, self.union, self.covered = [], [], [], [], np.empty(0, np.uint64), 0

    def add(self, name: int, joined: int, shingles: np.ndarray) -> None:
        self.names.append(name)
        self.joined.append(joined)
        self.sets.append(shingles)
        self.sizes.append(len(shingles))

    def partners(self, asking: np.ndarray, joined: int | None, percent: int):
        """Places of members that link with the asking set: one of each component but its own."""
        size, sizes = len(asking), np.array(self.sizes)
        fits = np.flatnonzero((percent * size <= 100 * sizes) & (percent * sizes <= 100 * size))
        if not len(fits):
            return
        if len(self.sets) >= 2 * self.covered:
            self.union, self.covered = np.unique(np.concatenate(self.sets)), len(self.sets)
        if common(self.union, asking) < overlap_needed(size, int(sizes[fits].min()), percent):
            fits = fits[fits >= self.covered]  # none of the members that the union holds
        done = {joined}
        for i in fits:
            if self.joined[i] not in done and common(self.sets[i], asking) >= overlap_needed(size, self.sizes[i], percent):
                done.add(self.joined[i])
                yield int(i)

    def take_in(self, name: int, shingles: np.ndarray, percent: int) -> list[int]:
        """Add a member; the members it was linked with, one for each component that it brings together."""
        partners = list(self.partners(shingles, None, percent))
        merged = {self.joined[i] for i in partners}
        self.joined = [name if j in merged else j for j in self.joined]
        self.add(name, name, shingles)
        return [self.names[i] for i in partners]


def common(held: np.ndarray, asking: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(held, asking), len(held) - 1)
    return int((held[at] == asking).sum())


def walked(rows: DataFrame, keys: list[str], words: int, percent: int) -> DataFrame:
    """Links (a, b) from rows in order of ``keys``: members of a part first (``asks`` is null where they are to be linked with each other), then the classes that ask it."""
    def walk(batches):
        key, part = None, Part()
        for batch in batches:
            for piece in slices(batch, "text"):
                hashes, starts = shingle_sets(texts_of(piece, "text"), words)
                a, b = [], []
                columns = [piece.column(name).to_pylist() for name in (*keys, "asks", "cls", "joined")]
                for i, (*now, asks, name, joined) in enumerate(zip(*columns)):
                    if now != key:
                        key, part = now, Part()
                    own = hashes[starts[i]:starts[i + 1]]
                    if asks is None:
                        others = part.take_in(name, own, percent)
                    elif asks:
                        others = [part.names[k] for k in part.partners(own, joined, percent)]
                    else:
                        part.add(name, joined, own)
                        continue
                    a += [name] * len(others)
                    b += others
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select(*keys, "asks", "cls", "joined", "text").repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(walk, "a long, b long")


def opened(asking: DataFrame, parts: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b): ``asking`` has part, sub, cls, joined; ``parts`` has the members of the parts likewise. ``joined`` is the component known so far."""
    loads = materialise(asking.groupBy("part", "sub").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("shards")), "loads")
    held = parts.join(loads, ["part", "sub"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("asks", F.lit(False))
    askers = asking.join(loads, ["part", "sub"]).withColumn("shard", F.pmod(F.xxhash64("cls"), F.col("shards")).cast("int")).withColumn("asks", F.lit(True))
    names = ["part", "sub", "shard", "asks", "cls", "joined"]
    places = materialise(held.select(names).unionByName(askers.select(names)), "meetings")
    table = bit_table(places.select("cls"))

    def pick(batches):
        for batch in batches:
            yield batch.filter(pa.array(maybe_in(table, batch.column(0).to_numpy())))

    needed = texts.select("cls", "text").mapInArrow(pick, "cls long, text string")
    return walked(places.join(needed, "cls"), ["part", "sub", "shard"], words, percent)


def can_link(pos, size, other, percent: int):
    """Column: can a shingle at this place of a set's order be the first that it shares with a linked set of ``other`` shingles?"""
    return pos <= size - F.ceil(percent * (size + other) / (100 + percent))


def askers(crowd: DataFrame, placed: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """part, sub, cls, joined: the classes that must ask a part, as they share a prefix shingle with it and it holds another component."""
    named = placed.join(labels.select(F.col("id").alias("cls"), F.col("component").alias("joined")), "cls")
    weight = named.groupBy("joined").agg(F.count("*").alias("weight"))
    entries = crowd.join(named.join(weight, "joined").select("cls", "part", "sub", "joined", "weight"), "cls")
    several = entries.groupBy("token").agg(F.min("joined").alias("low"), F.max("joined").alias("high")).where("low < high").select("token")
    entries = materialise(entries.join(several, "token", "left_semi"), "entries")
    held = entries.groupBy("token", "part", "sub").agg(
        F.min("joined").alias("low"), F.max("joined").alias("high"), F.max("weight").alias("heaviest"), F.min("size").alias("least"), F.max("size").alias("most"), F.min("pos").alias("soonest"))
    asks = entries.select("token", "cls", "joined", "weight", "pos", "size", F.col("part").alias("own_part"), F.col("sub").alias("own_sub"))
    elsewhere = (F.col("part") != F.col("own_part")) | (F.col("sub") != F.col("own_sub"))
    smaller = F.struct("weight", "joined") < F.struct("heaviest", "low")
    other = (F.col("low") < F.col("high")) | ((F.col("joined") != F.col("low")) & smaller)
    fits = (F.col("size") * percent <= F.col("most") * 100) & (F.col("least") * percent <= F.col("size") * 100)
    near = (can_link(F.col("pos"), F.col("size"), F.greatest(F.col("least"), F.ceil(F.col("size") * percent / 100)), percent)
            & can_link(F.col("soonest"), F.col("most"), F.col("size"), percent))
    return asks.join(held, "token").where(elsewhere & other & fits & near).select("part", "sub", "cls", "joined").distinct()


def links(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between ``classes`` (cls, t1, t2, size, indexed, prefix) that connect all that is connected."""
    crowd = materialise(shared_shingles(classes), "crowd")
    least = crowd.groupBy("token").agg(F.min("cls").alias("part"))
    group = crowd.join(least, "token").groupBy("cls").agg(F.min("part").alias("part"))
    members = materialise(classes.select("cls", "t1", "t2", "size").join(group, "cls"), "members")
    sizes = members.groupBy("part").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("size") / MEMBER_SHINGLES)).cast("int").alias("subs"))
    placed = materialise(members.join(sizes, "part").withColumn("sub", F.pmod(F.xxhash64("cls"), F.col("subs")).cast("int")), "placed")
    texts = materialise(texts_for(docs, placed), "texts")
    nobody = F.lit(None)
    found = materialise(walked(texts.withColumns({"asks": nobody.cast("boolean"), "joined": nobody.cast("long")}), ["part", "sub"], words, percent), "links")
    nodes, asked = placed.select(F.col("cls").alias("id")), None
    for first in (True, False):  # the first class of every component asks for it, then the others where components are still apart
        labels = materialise(components(nodes, found.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "labels")
        asking = askers(crowd, placed, labels, percent)
        asking = materialise(asking.where("cls = joined") if first else asking.join(asked, ["part", "sub", "cls"], "left_anti"), "asking")
        asked = asking.select("part", "sub", "cls")
        parts = placed.select("part", "sub", "cls").join(labels.select(F.col("id").alias("cls"), F.col("component").alias("joined")), "cls")
        found = found.union(materialise(opened(asking, parts, texts, words, percent), "links"))
    discard(texts)
    return found


def joined_texts(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``."""
    text = F.coalesce(text_col, F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"), text.alias("text"))  # 128 bits name a text
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(BUCKETS, 1 << (max(plain.count() // DOCS_A_BUCKET, 1) - 1).bit_length()))
    rows = materialise(described(plain, frequencies(plain, words, buckets), words, percent), "sets")
    some = rows.where("size > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("t1", "t2")).alias("key"), F.first(F.struct("size", "indexed", "prefix")).alias("set"))
    classes = materialise(some.select(F.monotonically_increasing_id().alias("cls"), "c1", "c2", "least_id", "key.*", "set.*"), "classes")
    light = materialise(classes.select("cls", "c1", "c2", "least_id"), "light-classes")
    slim = materialise(rows.select("doc_id", "size", "c1", "c2"), "light-sets")
    discard(rows)
    found = links(plain, classes, words, percent)
    discard(classes)
    linked = found.select(F.col("a").alias("id")).union(found.select("b")).distinct()
    labels = components(linked, found.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    heads = light.join(labels.withColumnRenamed("id", "cls"), "cls")
    least = heads.groupBy("component").agg(F.min("least_id").alias("component_id"))
    linked_heads = heads.join(least, "component").select("c1", "c2", "component_id")
    alone = light.join(labels.select(F.col("id").alias("cls")), "cls", "left_anti").select("c1", "c2", F.col("least_id").alias("component_id"))
    wordless = slim.where("size = 0").select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    worded = slim.where("size > 0").select("doc_id", F.col("size").cast("long").alias("n_shingles"), "c1", "c2")
    return worded.join(linked_heads.union(alone), ["c1", "c2"]).select("doc_id", "n_shingles", "component_id").union(wordless)


SQL = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS shingle FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
linked AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN linked l ON l.a = r.other)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""
