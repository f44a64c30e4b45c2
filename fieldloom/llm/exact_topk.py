"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors become whole numbers, floor(scale * x). Spark deals the rows to blocks of about ``block`` vectors, and every block keeps, per dimension, its
vectors in order of that component. Queries travel in blocks too and meet every block by an equality join, so a task holds one
block of vectors and one of queries. Within a block the algorithm reads all lists in step, from the end that the sign of the query's component
favours, scores what it meets for the first time, and stops when the sum of the products at the current depth - the most that an unseen vector can
reach - is below the k-th best score. Ties go to the smaller id, so the bound must be strictly below. Equal vectors of a block are one entry of the lists.
Every block offers its k best to a query; a window over those few keeps the k best overall.

Defined cases: vectors that are null, or hold null or non-finite components, and null ids take no part; an id with several vectors has its smallest one;
repeated rows count once; only vectors of the query's own length are candidates; a query with fewer candidates gets all of them; no queries, no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.session import materialise

BLOCK, QUERIES, FIRST_DEPTH = 4096, 512, 32


def whole_numbers(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v of the vectors that take part, one row per id."""
    parts = F.transform(vector_col, lambda x: x.cast("double"))
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    good = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    return good.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(parts, lambda x: F.floor(x * scale)).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def threshold_search(rows: np.ndarray, order: np.ndarray, query: np.ndarray, enough) -> tuple[np.ndarray, np.ndarray]:
    """Places of scored vectors and their scores: all that can be among the best. ``enough(places, scores)`` is the score to beat, or None.

    ``order[d]`` lists the vectors by falling component d.
    """
    n = len(rows)
    axes = np.flatnonzero(query)
    seen = np.zeros(n, bool)
    places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth, step = 0, FIRST_DEPTH
    rising = query[axes] < 0
    while depth < n:
        end = min(n, depth + step)
        lists = np.where(rising[:, None], order[axes, n - end:n - depth], order[axes, depth:end])
        seen[lists.ravel()] = True
        fresh = np.flatnonzero(seen)
        fresh = fresh[~np.isin(fresh, places, assume_unique=True)] if len(places) else fresh
        places, scores = np.append(places, fresh), np.append(scores, rows[fresh] @ query)
        depth, step = end, 2 * step
        last = np.where(rising, order[axes, n - end], order[axes, end - 1])
        bound = int((rows[last, axes] * query[axes]).sum())  # no vector that is still unseen scores more
        beat = enough(places, scores)
        if beat is not None and bound < beat:
            return places, scores
    if len(places) < n:  # a query of zeros reads no list
        rest = np.flatnonzero(~seen)
        places, scores = np.append(places, rest), np.append(scores, rows[rest] @ query)
    return places, scores


def top_of_block(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple]:
    """(query id, vector id, score) of the k best of one block for every query."""
    kinds, which = np.unique(rows, axis=0, return_inverse=True) if rows.shape[1] else (rows[:1], np.zeros(len(rows), np.int64))
    by_kind = np.lexsort((ids, which.ravel()))
    starts = np.searchsorted(which.ravel()[by_kind], np.arange(len(kinds) + 1))
    members = [ids[by_kind[a:b]] for a, b in zip(starts[:-1], starts[1:])]
    sizes = np.diff(starts)
    order = np.argsort(-kinds, axis=0, kind="stable").T.copy()
    out = []
    for query_id, query in zip(query_ids, queries):
        def enough(places, scores):  # the k-th best score so far, the query's own row apart
            best = np.argsort(-scores, kind="stable")[:k + 1]
            count = np.cumsum(sizes[places[best]]) - 1
            hit = np.flatnonzero(count >= k)
            return int(scores[best[hit[0]]]) if len(hit) else None

        places, scores = threshold_search(kinds, order, query, enough)
        found = []
        beat = enough(places, scores)
        for p, s in zip(places, scores):
            if beat is None or s >= beat:
                found += [(-int(s), int(i)) for i in members[p][:k + 1] if i != query_id]
        out += [(int(query_id), i, -s) for s, i in sorted(found)[:k]]
    return out


def in_blocks(rows: DataFrame, size: int, count: int) -> DataFrame:
    """block, dim, ids and vectors (as bytes): about ``size`` vectors of one length to a row."""
    blocks = max(1, math.ceil(count / size))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.size("v").alias("dim"), "vec_id", "v")

    def gather(key, table):
        table = table.sort_by("vec_id")
        ids = table["vec_id"].to_numpy()
        values = np.concatenate([np.asarray(x, np.int64) for x in table["v"].to_pylist()]) if len(ids) else np.zeros(0, np.int64)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()), "ids": [ids.tobytes()], "vectors": [values.tobytes()]})

    return dealt.groupBy("block", "dim").applyInArrow(gather, "block int, dim int, ids binary, vectors binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block: int = BLOCK, queries: int = QUERIES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query; ``is_query`` is a condition on vec_id."""
    rows = materialise(whole_numbers(vectors, scale, id_col, vector_col), "vectors")
    asked = rows.where(is_query)
    stored = in_blocks(rows, block, rows.count())
    packed = in_blocks(asked, queries, asked.count()).select(F.col("dim"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    places = stored.select("dim", "block").distinct()
    meeting = packed.join(places, "dim").join(stored, ["dim", "block"])

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                ids, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
                found = top_of_block(ids, np.frombuffer(row["vectors"], np.int64).reshape(len(ids), dim), query_ids,
                                     np.frombuffer(row["queries"], np.int64).reshape(len(query_ids), dim), k)
                a, b, c = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["query_id", "vec_id", "score"])

    found = meeting.select("dim", "ids", "vectors", "query_ids", "queries").mapInArrow(search, "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
    SELECT vec_id, min(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
