"""Vector search and exact similarity joins."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.constants import CONTENT_SIMILARITY, FIELD_SIMILARITY
from fieldloom.functions.vectors import distance, literal
from fieldloom.session import materialise

BLOCK_ROWS, QUERY_ROWS = 32768, 4096  # most vectors of the collection and of queries that a task holds at once
BLOCK_BYTES = 8 << 20       # and their most bytes, as 32-bit numbers
NEAR_ROWS, NEAR_QUERIES, FIRST_LOOK = 8192, 512, 256  # distances taken at once, and those that give the first bound
UNITS_PER_CORE = 6
MAX_PIVOTS = 128
MAX_BLOCK_BYTES = 32 << 20  # vectors of one block of a similarity join
TILE = 2048
COPIES = 4096               # ids of one vector on one side of a part of their pairs
SLACK = 1e-9                # keeps rounding from losing a pair at a partition border


def nearest(collection: DataFrame, query, n=5, metric="l2sq", where=None) -> DataFrame:
    """The ``n`` rows nearest to one query vector, ties by id; ``where`` filters metadata first."""
    rows = collection.where("embedding is not null")
    for key, value in (where or {}).items():
        rows = rows.where(F.element_at("metadata", F.lit(key)) == F.lit(value))
    scored = rows.withColumn("distance", distance(F.col("embedding"), literal(query), metric))
    return scored.orderBy("distance", "id").limit(n).withColumn("similarity", 1.0 - F.col("distance"))


def similar_to(collection: DataFrame, query, threshold=CONTENT_SIMILARITY) -> DataFrame:
    """All rows whose cosine similarity to one query vector reaches the threshold."""
    scored = collection.where("embedding is not null").withColumn(
        "similarity", 1.0 - distance(F.col("embedding"), literal(query), "cosine"))
    return scored.where(F.col("similarity") >= threshold)


def similar_documents(collection: DataFrame, doc_id, n=5, metric="l2sq") -> DataFrame:
    """The ``n`` rows nearest to a stored row, itself left out."""
    found = collection.where(F.col("id") == doc_id).select("embedding").limit(1).collect()  # one row
    if not found or not found[0]["embedding"]:
        return nearest(collection.where(F.lit(False)), [0.0], n, metric)
    return nearest(collection.where(F.col("id") != doc_id), found[0]["embedding"], n, metric)


def nearest_many(collection: DataFrame, queries: DataFrame, n=5, metric="l2sq", block_rows=BLOCK_ROWS, query_rows=QUERY_ROWS) -> DataFrame:
    """k nearest rows for every query vector (query_id, embedding).

    Both sides are dealt to blocks of a bounded number of vectors by a hash of their ids, and every block of queries meets every
    block of the collection by an equality join; nothing goes through the driver but the row counts. A task holds one pair
    of blocks and hands on only the ``n`` best per query; a window over blocks x ``n`` rows per query keeps the best overall.
    """
    types, spark = dict(collection.dtypes), collection.sparkSession
    query_type, id_type = dict(queries.dtypes)["query_id"], types["id"]
    rows = collection.where("embedding is not null").select(F.col("id").alias("key"), "embedding")
    asked = queries.where("embedding is not null").select(F.col("query_id").alias("key"), "embedding")
    size = rows.agg(F.count("*").alias("rows"), F.max(F.size("embedding")).alias("width")).first()
    fits = max(1, BLOCK_BYTES // (4 * max(1, size["width"] or 1)))
    cores = spark.sparkContext.defaultParallelism
    small = max(NEAR_ROWS, -(-size["rows"] // (2 * cores)))  # a small collection is still cut finely enough to use all cores
    places = max(1, -(-size["rows"] // min(block_rows, fits, small)))
    batches = max(1, -(-asked.count() // min(query_rows, fits)))
    # a block of the collection is copied for a few groups of query blocks, so that there are units of work for every core
    copies = min(batches, max(1, -(-UNITS_PER_CORE * cores // places)))
    units = places * copies
    stored = _in_blocks(rows, places).select(F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "block", F.col("keys").alias("ids"), "vectors")
    wanted = _in_blocks(asked, batches).select(F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("at"), (F.col("block") % copies).alias("copy"),
                                               F.col("keys").alias("query_ids"), F.col("vectors").alias("wanted"))
    # a fixed number of partitions: what a unit costs does not show in its bytes
    stored = stored.select((F.col("block") * copies + F.col("copy")).alias("unit"), "ids", "vectors").repartition(units, "unit")
    wanted = wanted.select((F.col("at") * copies + F.col("copy")).alias("unit"), "query_ids", "wanted").repartition(units, "unit")
    numbers = [_number(df) for df in (rows, asked)]

    def best(frames):
        for frame in frames:
            for row in frame.itertuples():
                names, codes = np.unique(np.asarray(row.ids), return_inverse=True)  # numbers in the order of the ids
                ids = np.asarray(row.query_ids)
                vecs = np.frombuffer(row.vectors, numbers[0]).reshape(len(codes), -1)
                probes = np.frombuffer(row.wanted, numbers[1]).reshape(len(ids), -1)
                for start in range(0, len(ids), NEAR_QUERIES):
                    own, code, dist = _nearest_codes(vecs, codes.ravel(), probes[start:start + NEAR_QUERIES].astype(np.float64), n, metric)
                    yield pd.DataFrame({"query_id": ids[start + own], "id": names[code], "distance": dist})

    partial = wanted.join(stored, "unit").select("ids", "vectors", "query_ids", "wanted").mapInPandas(best, f"query_id {query_type}, id {id_type}, distance double")
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return (partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
            .withColumn("similarity", 1.0 - F.col("distance")))


def _nearest_codes(vecs, codes, probes, n, metric):
    """The ``n`` nearest of ``vecs`` for every probe: number of the probe, code of the vector, distance; ties by code.

    Products are taken tile by tile in 32-bit numbers, whose error has a bound. The first few distances give a limit, and only vectors that
    may lie within the n-th best so far get their distance in 64-bit numbers and are sorted.
    """
    if metric == "cosine":
        probes = _unit(probes)
    square = (probes ** 2).sum(1)
    limit = np.full(len(probes), np.inf)
    own, code, dist = np.empty(0, np.int64), np.empty(0, codes.dtype), np.empty(0)
    for start in range(0, len(vecs), NEAR_ROWS):
        tile = vecs[start:start + NEAR_ROWS].astype(np.float64)
        if metric == "cosine":
            tile = _unit(tile)
        own_square = (tile ** 2).sum(1)

        def away(at, place):
            product = np.einsum("ij,ij->i", probes[at], tile[place])
            return 1.0 - product if metric == "cosine" else np.maximum(0.0, square[at] + own_square[place] - 2.0 * product)

        if start == 0 and len(tile) >= n:
            look = min(len(tile), max(n, FIRST_LOOK))
            product = probes @ tile[:look].T
            near = 1.0 - product if metric == "cosine" else np.maximum(0.0, square[:, None] + own_square[None, :look] - 2.0 * product)
            limit = np.partition(near, n - 1, axis=1)[:, n - 1]
        # the distance is at most the limit where the product (less half the square, which is one more column) is at least ``low``
        if metric == "cosine":
            a, b, low = probes, tile, 1.0 - limit
        else:
            a, b, low = np.c_[probes, np.ones(len(probes))], np.c_[tile, -own_square / 2], (square - limit) / 2
        scale = np.sqrt((a ** 2).sum(1)) * np.sqrt((b ** 2).sum(1).max())
        if np.isfinite(scale).all() and scale.max(initial=0.0) < 1e30:
            a, b, slack = a.astype(np.float32), b.astype(np.float32), scale * (a.shape[1] + 8) * 2.0 ** -23
        else:
            slack = np.where(np.isfinite(scale), scale * (a.shape[1] + 8) * 2.0 ** -52, np.inf)
        bound = np.nextafter((low - slack - 2e-9).astype(a.dtype), -np.inf, dtype=a.dtype)  # 2e-9, as distances are compared after rounding
        at, place = np.nonzero(~(a @ b.T < bound[:, None]))  # what is no number stays, and comes last
        own, code, dist = np.concatenate([own, at]), np.concatenate([code, codes[start + place]]), np.concatenate([dist, away(at, place)])
        order = np.lexsort((code, np.round(dist, 9), own))
        own, code, dist = own[order], code[order], dist[order]
        begins = np.searchsorted(own, np.arange(len(probes)))
        kept = np.arange(len(own)) - begins[own] < n
        own, code, dist = own[kept], code[kept], dist[kept]
        full = np.bincount(own, minlength=len(probes)) == n
        limit[full] = dist[np.searchsorted(own, np.flatnonzero(full), side="right") - 1]
    return own, code, dist


def _number(rows: DataFrame):
    """32-bit numbers stay as they are; all others become 64-bit ones."""
    return np.float32 if dict(rows.dtypes)["embedding"] == "array<float>" else np.float64


def _in_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """block, keys and vectors (as bytes of the numbers' own type) of (key, embedding): one row per block."""
    key_type, number = dict(rows.dtypes)["key"], _number(rows)

    def gather(at, frame):
        vectors = np.stack(frame["embedding"].to_numpy()).astype(number)
        return pd.DataFrame({"block": [at[0]], "keys": [frame["key"].to_numpy()], "vectors": [vectors.tobytes()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(gather, f"block int, keys array<{key_type}>, vectors binary")


def _unit(matrix):
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def similar_pairs(vectors: DataFrame, threshold=CONTENT_SIMILARITY, within=(), block_rows=None, pivots=None):
    """All pairs of *distinct* vectors with cosine similarity at or above ``threshold``; exact.

    ``vectors``: id, embedding and the ``within`` columns (pairs only inside equal values).
    Returns ``(pairs, members)``: pairs (within.., id_a < id_b, similarity) over one id per
    distinct vector, and members (within.., rep, id) naming the copies that share that vector, so a
    vector held by a third of all rows stays one row in the join and nothing is lost.

    Rows go to the nearest of a few pivot vectors. On unit vectors a similarity of at least t means
    a distance of at most sqrt(2-2t), so a row is also sent to a lower-numbered pivot only if it
    lies that near to the border between the two; every pair then meets in exactly one partition.
    Partitions are cut into blocks of ``block_rows`` by hash, so a crowded pivot becomes many equal
    tasks. A task compares two blocks tile by tile and emits only pairs that qualify.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    within = list(within)
    keyed = vectors.where("embedding is not null").select(*within, "id", "embedding")
    members = keyed.withColumn("_h", F.xxhash64("embedding"))
    distinct = members.groupBy(*within, "_h", "embedding").agg(F.min("id").alias("id"), F.count("*").alias("_copies"))
    distinct = materialise(distinct, "vectors")
    reps = distinct.where("_copies > 1").select(
        *within, "_h", "embedding", F.col("id").alias("rep"))
    copies = members.join(reps, [*within, "_h", "embedding"]).where("id <> rep").select(*within, "rep", "id")
    return _pairs_of(distinct, threshold, within, block_rows, pivots), copies


def every_similar_pair(vectors: DataFrame, threshold=CONTENT_SIMILARITY, within=(), block_rows=None, pivots=None) -> DataFrame:
    """All pairs of ids with cosine similarity at or above ``threshold``, copies among them (within.., id_a < id_b, similarity); exact.

    The join of ``similar_pairs`` compares each distinct vector once, under a number of its own. Its pairs are then listed for all
    ids that hold one of the two vectors, and the ids of one vector pair among themselves, in parts of ``COPIES`` ids a side.
    A vector of zeros is similar to nothing, its copies neither.
    """
    within = list(within)
    rows = vectors.dropna(subset=[*within, "id"]).where("embedding is not null").select(
        *within, F.col("id").alias("row"), "embedding", F.xxhash64("embedding").alias("_h"))
    # stored before it is read, so a number stays with its vector
    distinct = materialise(rows.groupBy(*within, "_h", "embedding").agg(F.min("row").alias("row"), F.count("*").alias("_copies"))
                           .withColumn("id", F.monotonically_increasing_id()), "vectors")
    pairs = _pairs_of(distinct, threshold, within, block_rows, pivots)
    crowds = distinct.where("_copies > 1")
    square = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    alike = materialise(rows.join(crowds.drop("row"), [*within, "_h", "embedding"]).select(
        *within, "id", "row", "_copies", ((square > 0) & ~F.isnan(square)).alias("_directed")).distinct(), "copies")
    holders = materialise(distinct.where("_copies = 1").select("id", "row").unionByName(alike.select("id", "row")), "holders")
    x, y = F.least("row_a", "row_b"), F.greatest("row_a", "row_b")
    across = pairs.join(holders.select(F.col("id").alias("id_a"), F.col("row").alias("row_a")), "id_a").join(
        holders.select(F.col("id").alias("id_b"), F.col("row").alias("row_b")), "id_b").where("row_a <> row_b").select(
        *within, x.alias("id_a"), y.alias("id_b"), "similarity")
    parts = F.ceil(F.col("_copies") / COPIES).cast("int")
    crowd = alike.where("_directed").withColumn("_parts", parts)
    one = crowd.select(*within, "id", F.col("row").alias("row_a"), F.pmod(F.xxhash64("row"), F.col("_parts")).cast("int").alias("_part"))
    other = crowd.select("id", F.col("row").alias("row_b"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    among = one.join(other, ["id", "_part"]).where("row_a < row_b").select(
        *within, F.col("row_a").alias("id_a"), F.col("row_b").alias("id_b"), F.lit(1.0).alias("similarity"))
    return across.unionByName(among)


def _pairs_of(distinct: DataFrame, threshold, within, block_rows, pivots) -> DataFrame:
    """The join of ``similar_pairs``; ``distinct``: within.., id, embedding and its hash _h, a row per vector, stored."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = distinct.sparkSession
    total = distinct.count()
    wanted = pivots if pivots is not None else min(MAX_PIVOTS, max(1, total // 8192))
    # a fixed number of pivot vectors, spread by hash
    picked = np.array([r["embedding"] for r in distinct.orderBy("_h").limit(wanted).collect()], dtype=np.float64)
    if block_rows is None:
        # every copy of a row costs shuffle, so blocks are as large as a task can hold twice, but
        # small inputs are still cut finely enough to use all cores
        fits = MAX_BLOCK_BYTES // (8 * (picked.shape[1] if picked.size else 1))
        block_rows = max(1, min(fits, max(1024, -(-total // (2 * spark.sparkContext.defaultParallelism)))))
    centres = _unit(picked) if len(picked) else np.zeros((1, 1))
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold))) + SLACK
    gaps = np.linalg.norm(centres[:, None, :] - centres[None, :, :], axis=2)

    columns = [f"{k} {dict(distinct.dtypes)[k]}" for k in within]
    id_type = dict(distinct.dtypes)["id"]

    def assign(frames):
        for frame in frames:
            if not len(frame):
                continue
            vecs = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
            length = np.linalg.norm(vecs, axis=1)
            frame, vecs = frame[length > 0], _unit(vecs[length > 0])
            if not len(frame):
                continue
            square = np.maximum(0.0, 2.0 - 2.0 * (vecs @ centres.T))
            home = square.argmin(axis=1)
            lead = square - square[np.arange(len(home)), home][:, None]
            gap = gaps[:, home].T
            near = lead <= 2.0 * gap * reach + SLACK
            near &= np.arange(len(centres))[None, :] < home[:, None]
            out = frame[[*within, "id"]].copy()
            out["vec"] = [v.tobytes() for v in vecs]
            out["home"] = home.astype(np.int32)
            out["visits"] = [np.flatnonzero(r).astype(np.int32) for r in near]
            yield out

    placed = materialise(distinct.select(*within, "id", "embedding").mapInPandas(
        assign, ", ".join([*columns, f"id {id_type}", "vec binary", "home int", "visits array<int>"])), "placed")
    roles = placed.select(*within, "id", F.inline(F.concat(
        F.array(F.struct(F.col("home").alias("part"), F.lit(True).alias("inner"))),
        F.transform("visits", lambda p: F.struct(p.alias("part"), F.lit(False).alias("inner"))))))
    sizes = roles.groupBy(*within, "part").agg(
        F.count_if("inner").alias("_inner"), F.count_if(~F.col("inner")).alias("_outer"))
    sizes = sizes.select(*within, "part",
                         F.ceil(F.col("_inner") / block_rows).cast("int").alias("_bi"),
                         F.ceil(F.col("_outer") / block_rows).cast("int").alias("_bo")).where("_bi > 0")

    spread = placed.select(*within, "id", "vec", F.inline(F.concat(
        F.array(F.struct(F.col("home").alias("part"), F.lit(True).alias("inner"))),
        F.transform("visits", lambda p: F.struct(p.alias("part"), F.lit(False).alias("inner"))))))
    spread = spread.join(sizes, [*within, "part"])
    own = F.pmod(F.xxhash64("id"), F.when(F.col("inner"), F.col("_bi")).otherwise(F.greatest("_bo", F.lit(1)))).cast("int")
    spread = spread.withColumn("_own", own)
    every = F.sequence(F.lit(0), F.col("_bi") - 1)
    outer_ids = F.when(F.col("_bo") > 0, F.transform(F.sequence(F.lit(0), F.greatest("_bo", F.lit(1)) - 1), lambda c: -c - 1)) \
        .otherwise(F.expr("cast(array() as array<int>)"))

    # left side: inner rows, once per block at or after their own and once per outer block
    as_left = F.transform(
        F.concat(F.filter(every, lambda b: b >= F.col("_own")), outer_ids),
        lambda b: F.struct(F.col("_own").alias("l"), b.alias("r"), F.lit(True).alias("left")))
    as_right = F.transform(
        F.filter(every, lambda b: b < F.col("_own")),
        lambda b: F.struct(b.alias("l"), F.col("_own").alias("r"), F.lit(False).alias("left")))
    as_outer = F.transform(every, lambda b: F.struct(
        b.alias("l"), (-F.col("_own") - 1).alias("r"), F.lit(False).alias("left")))
    units = spread.select(*within, "part", "id", "vec", F.inline(
        F.when(F.col("inner"), F.concat(as_left, as_right)).otherwise(as_outer)))

    def compare(key, frame):
        left_at, right_at = key[-2], key[-1]
        left = frame[frame["left"]]
        right = left if left_at == right_at else frame[~frame["left"]]
        found = [np.empty((3, 0))]
        if len(left) and len(right):
            a = np.frombuffer(b"".join(left["vec"]), dtype=np.float64).reshape(len(left), -1)
            b = np.frombuffer(b"".join(right["vec"]), dtype=np.float64).reshape(len(right), -1)
            for i in range(0, len(a), TILE):
                for j in range(i if left_at == right_at else 0, len(b), TILE):
                    score = a[i:i + TILE] @ b[j:j + TILE].T
                    if left_at == right_at and i == j:
                        score[np.tril_indices(len(score))] = -2.0
                    hit = np.nonzero(score >= threshold)
                    found.append(np.vstack([hit[0] + i, hit[1] + j, score[hit]]))
        i, j, sims = np.hstack(found)
        i, j = i.astype(int), j.astype(int)
        x, y = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        swap = x > y
        # plain object columns: text columns that pandas infers itself do not always convert when empty
        out = {k: pd.Series([key[n]] * len(x), dtype=object) for n, k in enumerate(within)}
        out["id_a"] = pd.Series(np.where(swap, y, x), dtype=object)
        out["id_b"] = pd.Series(np.where(swap, x, y), dtype=object)
        out["similarity"] = sims
        return pd.DataFrame(out)

    return units.groupBy(*within, "part", "l", "r").applyInPandas(
        compare, ", ".join([*columns, f"id_a {id_type}", f"id_b {id_type}", "similarity double"]))


def content_relationships(vectors: DataFrame, threshold=CONTENT_SIMILARITY, **options):
    """Similar document pairs plus the copies that share a vector (similarity 1 to their first id)."""
    return similar_pairs(vectors, threshold, **options)


def field_similarities(fields: DataFrame, threshold=FIELD_SIMILARITY, find=similar_pairs, **options):
    """Similar field names inside each source file; ``fields``: source_file, field, embedding."""
    named = fields.select("source_file", F.col("field").alias("id"), "embedding")
    return find(named, threshold, within=["source_file"], pivots=1, **options)


def copy_edges(copies: DataFrame, within=()) -> DataFrame:
    """Copies as pairs with the id that stands for them."""
    return copies.select(*within, F.col("rep").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("similarity"))
