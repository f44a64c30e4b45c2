"""Hard negatives: for each anchor and each of its best positives, the best rows of other labels whose score lies in a window below the positive's.

Vectors become whole numbers, floor(scale * x); a score is the inner product. Candidates of one label are dealt to trees of bounded size. Within a tree every vector gets one more component
that brings all to the same norm M, so that all lie on a sphere, a query stays as it is, and an inner product is |q| * M * cos(angle). The tree is a cover tree: an entry is
a vector and a covering angle that holds everything below it; on each level the angle shrinks by ``SHRINK``, the part that is still covered stays with the vector, the rest is covered
by vectors of its own. With the angle t between query and vector and the covering angle c, scores below an entry lie between |q| M cos(t + c) and |q| M cos(t - c).

A search keeps the k best of every window (of one window without ends for the positives). It opens the entries with the highest bounds first, and drops those that lie outside all windows
or cannot beat a window's k-th best; every vector it meets is scored exactly, in whole numbers. Ties go to the smaller id, so a bound that equals the k-th best is still opened.
Anchors travel in blocks; a task takes one block of anchors through ``SHARE`` trees one after another and carries what it has found along. Windows over those few keep the best overall.

Defined cases: rows without id or label, and vectors that are null or hold null or non-finite components, take no part; an id with several rows has its smallest vector, and of those the
smallest label; equal vectors of a tree are one entry, with all their ids; only vectors of the anchor's own length are candidates; anchors with fewer positives or negatives
have all of them; positives with a negative score have an empty window; no anchors, no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.session import materialise

BLOCK, ANCHORS, SHARE = 1 << 15, 512, 64
LEAF, SHRINK, OPENED = 24, 0.7, 48
EXACT = 2 ** 53


def whole_numbers(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, dim and v of the rows that take part, one per id."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    good = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    numbers = good.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    one = numbers.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("row"))
    return one.select("vec_id", "row.label", F.size("row.v").alias("dim"), "row.v")


def packed(values: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the narrowest type that holds them."""
    kind = next(k for k in ("<i2", "<i4", "<i8") if not len(values.ravel()) or (np.iinfo(k).min <= values.min() and values.max() <= np.iinfo(k).max))
    return kind, values.astype(kind).tobytes()


def cover_tree(rows: np.ndarray) -> dict[str, np.ndarray]:
    """Entries of a cover tree over ``rows``: the vector, cosine of the covering angle, range of children, and whether the vector is new here (not the parent's)."""
    square = (rows.astype(float) ** 2).sum(axis=1)
    top = max(square.max(), 1.0)
    sphere = np.column_stack([rows, np.sqrt(np.maximum(top - square, 0))]) / math.sqrt(top)

    def cosines(members, center):
        return np.clip(sphere[members] @ sphere[center], -1, 1)

    others = np.arange(1, len(rows))
    point, cover, ranges, new = [0], [1.0], [(0, 0)], [True]
    queue = [(0, others, cosines(others, 0))] if len(others) else []
    levels = np.cos(np.arccos(queue[0][2].min()) * SHRINK ** np.arange(1, 80)) if queue else np.ones(1)  # falling angles are rising cosines
    while queue:
        waiting = []
        for entry, members, cosine in queue:
            cover[entry], begin = float(cosine.min()), len(point)
            if len(members) <= LEAF or cover[entry] >= 1 - 1e-12:
                parts = [(m, members[:0], cosine[:0], True) for m in members]
            else:
                level = int(np.searchsorted(levels, cover[entry], side="right"))
                reach = levels[min(level, len(levels) - 1)] if level < len(levels) else 1.0
                near = cosine >= reach
                parts = [(point[entry], members[near], cosine[near], False)] if near.any() else []
                rest = members[~near]
                while len(rest):
                    center, rest = rest[0], rest[1:]
                    cosine = cosines(rest, center)
                    inside = cosine >= reach
                    parts.append((center, rest[inside], cosine[inside], True))
                    rest = rest[~inside]
            for center, inner, cosine, fresh in parts:
                if len(inner):
                    waiting.append((len(point), inner, cosine))
                point.append(int(center))
                cover.append(1.0)
                ranges.append((0, 0))
                new.append(fresh)
            ranges[entry] = (begin, len(point))
        queue = [w for w in waiting if len(w[1])]
    return {"point": np.array(point, np.int32), "cover": np.array(cover), "begin": np.array([r[0] for r in ranges], np.int32), "end": np.array([r[1] for r in ranges], np.int32), "new": np.array(new)}


class Tree:
    """Vectors with their ids, and the entries over them."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, rows: np.ndarray, entries: dict[str, np.ndarray]):
        self.ids, self.starts, self.rows, self.entries = ids, starts, rows, entries
        square = (rows.astype(float) ** 2).sum(axis=1)
        self.norm = math.sqrt(max(square.max(), 1.0))
        self.floats, self.largest = rows.astype(float), int(np.abs(rows).max()) if rows.size else 0

    @classmethod
    def over(cls, ids: np.ndarray, rows: np.ndarray) -> Tree:
        kinds, which = np.unique(rows, axis=0, return_inverse=True) if rows.shape[1] else (rows[:1], np.zeros(len(rows), np.int64))
        order = np.lexsort((ids, which.ravel()))
        starts = np.searchsorted(which.ravel()[order], np.arange(len(kinds) + 1))
        return cls(ids[order], starts, kinds, cover_tree(kinds))

    def scores(self, query: np.ndarray, points: np.ndarray) -> np.ndarray:
        if self.largest * int(np.abs(query).max(initial=0)) * max(len(query), 1) < EXACT:
            return (self.floats[points] @ query.astype(float)).astype(np.int64)  # whole numbers that a double holds exactly
        return self.rows[points] @ query

    def bounds(self, query_norm: float, scores: np.ndarray, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lowest and highest score under entries whose vectors have these scores."""
        scale = query_norm * self.norm
        if scale == 0:
            return np.zeros(len(scores)), np.zeros(len(scores))
        t, c = np.clip(scores / scale, -1, 1), np.clip(cover - 1e-12, -1, 1)
        cross = np.sqrt((1 - t * t) * (1 - c * c))
        high, low = np.where(t >= c, 1.0, t * c + cross), np.where(t <= -c, -1.0, t * c - cross)
        slack = 1e-6 * scale + 1e-6
        return scale * low - slack, scale * high + slack

    def search(self, query: np.ndarray, own: int, windows: list[Best]) -> int:
        """Offer the windows all they may need; returns how many vectors were scored."""
        e = self.entries
        norm = math.sqrt(float((query.astype(float) ** 2).sum()))
        score = self.scores(query, e["point"][:1])
        self.offer(windows, e["point"][:1], score, own)
        entry, scored = np.zeros(1, np.int64), 1
        low, high = self.bounds(norm, score, e["cover"][:1])
        while len(entry):
            least, most = np.array([w.least() for w in windows]), np.array([w.high for w in windows])
            alive = ((high[:, None] >= least) & (low[:, None] <= most)).any(axis=1)
            entry, score, low, high = entry[alive], score[alive], low[alive], high[alive]
            if not len(entry):
                break
            first = np.argpartition(-high, OPENED)[:OPENED] if len(entry) > OPENED else np.arange(len(entry))
            begin, count = e["begin"][entry[first]].astype(np.int64), (e["end"] - e["begin"])[entry[first]].astype(np.int64)
            ends = np.cumsum(count)
            child = np.arange(ends[-1]) + np.repeat(begin - (ends - count), count)
            value = np.repeat(score[first], count)  # an entry that repeats its parent's vector has its score
            fresh = e["new"][child]
            points = e["point"][child[fresh]]
            value[fresh] = self.scores(query, points)
            scored += len(points)
            self.offer(windows, points, value[fresh], own)
            inner = e["end"][child] > e["begin"][child]
            more_low, more_high = self.bounds(norm, value[inner], e["cover"][child[inner]])
            stay = np.ones(len(entry), bool)
            stay[first] = False
            entry, score = np.concatenate([entry[stay], child[inner]]), np.concatenate([score[stay], value[inner]])
            low, high = np.concatenate([low[stay], more_low]), np.concatenate([high[stay], more_high])
        return scored

    def offer(self, windows: list[Best], points: np.ndarray, scores: np.ndarray, own: int) -> None:
        for window in windows:
            fit = (scores >= window.least()) & (scores <= window.high)
            if fit.any():
                window.take(self, points[fit], scores[fit], own)


class Best:
    """The k best (score, id) of a window of scores."""

    def __init__(self, k: int, low: float = -math.inf, high: float = math.inf):
        self.k, self.low, self.high, self.found = k, low, high, []

    def least(self) -> float:
        return max(self.low, -self.found[-1][0]) if len(self.found) == self.k else self.low

    def take(self, tree: Tree, points: np.ndarray, scores: np.ndarray, own: int) -> None:
        if len(points) > 2 * self.k:  # every vector has an id, the anchor's own may be one of them
            keep = scores >= np.partition(scores, len(scores) - self.k - 1)[len(scores) - self.k - 1]
            points, scores = points[keep], scores[keep]
        for point, score in zip(points, scores.tolist()):
            members = tree.ids[tree.starts[point]:tree.starts[point + 1]][:self.k + 1].tolist()
            self.found += [(-score, i) for i in members if i != own]
        self.found = sorted(self.found)[:self.k]


def trees(rows: DataFrame, size: int) -> DataFrame:
    """One row per tree: its label, vectors and entries. Each holds the vectors of one label and one of the buckets of about ``size`` rows of all labels."""
    buckets = max(1, math.ceil(rows.count() / size))

    def build(key, table):
        ids = table["vec_id"].to_numpy()
        values = np.array(table["v"].to_pylist(), np.int64).reshape(len(ids), key[1].as_py())
        tree = Tree.over(ids, values)
        kind, blob = packed(tree.rows)
        fields = {"label": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([key[1].as_py()], pa.int32()), "bucket": pa.array([key[2].as_py()], pa.int32()), "kind": [kind], "vectors": [blob],
                  "ids": [tree.ids.tobytes()], "starts": [tree.starts.astype(np.int64).tobytes()]}
        return pa.table(fields | {name: [tree.entries[name].tobytes()] for name in tree.entries})

    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("vec_id"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("label", "dim", "bucket").applyInArrow(build, "label long, dim int, bucket int, kind string, vectors binary, ids binary, starts binary, point binary, cover binary, begin binary, end binary, new binary")


def tree_of(row: dict) -> Tree:
    kinds = {"point": np.int32, "cover": np.float64, "begin": np.int32, "end": np.int32, "new": np.bool_}
    rows = np.frombuffer(row["vectors"], row["kind"]).astype(np.int64)
    starts = np.frombuffer(row["starts"], np.int64)
    return Tree(np.frombuffer(row["ids"], np.int64), starts, rows.reshape(len(starts) - 1, row["dim"]), {name: np.frombuffer(row[name], kind) for name, kind in kinds.items()})


def searched(forest: DataFrame, anchors: DataFrame, k: int, same_label: bool, size: int) -> DataFrame:
    """anchor_id, tag, vec_id, score: the k best of every window of every anchor, from the trees of the anchor's label or of all others, per share of the trees.

    ``anchors`` has vec_id, label, dim, v and windows (tag, low, high; null ends are open).
    """
    blocks = max(1, math.ceil(anchors.count() / size))
    dealt = anchors.withColumn("anchors", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    keys = ["dim", "anchors", *(["label"] if same_label else [])]
    asked = materialise(dealt.groupBy(*keys).agg(F.collect_list(F.struct("vec_id", "label", "v", "windows")).alias("queries")), "anchors")  # ``size`` anchors at most, near enough
    places = forest.select("label", "dim", "bucket").withColumn("share", F.pmod(F.xxhash64("label", "bucket"), F.lit(max(1, math.ceil(forest.count() / SHARE)))))
    wanted = asked.select(*keys).join(places, ["dim", "label"] if same_label else ["dim"])
    meeting = wanted.join(forest, ["label", "dim", "bucket"]).join(asked, keys)
    order = ["dim", "anchors", "share", *(["label"] if same_label else [])]
    names = ["dim", "anchors", "share", "label", *[c for c in forest.columns if c not in ("label", "dim", "bucket")], "queries"]

    def walk(batches):
        key, queries = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                now = tuple(row[name].as_py() for name in order)
                if now != key:
                    if queries:
                        yield result(queries)
                    key, queries = now, [(q["vec_id"], q["label"], np.array(q["v"], np.int64), [(w["tag"], Best(k, *(end if v is None else v for v, end in ((w["low"], -math.inf), (w["high"], math.inf))))) for w in q["windows"]])
                                         for q in row["queries"].as_py()]
                tree = tree_of({name: value.as_py() for name, value in row.items() if name != "queries"})
                label = row["label"].as_py()
                for own, of, query, windows in queries:
                    if (of == label) == same_label:
                        tree.search(query, own, [w for _, w in windows])
        if queries:
            yield result(queries)

    def result(queries):
        rows = [(own, tag, i, -s) for own, _, _, windows in queries for tag, best in windows for s, i in best.found]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], [], []))], ["anchor_id", "tag", "vec_id", "score"])

    dealt = meeting.select(*names).repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(walk, "anchor_id long, tag long, vec_id long, score long")


def best_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order.cast("int")).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, block: int = BLOCK, anchors: int = ANCHORS,
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; negative scores lie between ``low`` and ``high`` hundredths of the positive's.

    ``is_anchor`` is a condition on vec_id.
    """
    rows = materialise(whole_numbers(vectors, scale, id_col, vector_col, label_col), "vectors")
    forest = materialise(trees(rows, block), "trees")
    asked = rows.where(is_anchor)
    open_window = F.array(F.struct(F.lit(0).cast("long").alias("tag"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high")))
    near = best_of(searched(forest, asked.withColumn("windows", open_window), positives, True, anchors), ["anchor_id"], positives)
    near = materialise(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score")
    ends = near.withColumns({"low": F.ceil(score * low / 100), "high": F.floor(score * high / 100)}).where("low <= high")
    windows = ends.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("tag"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))).alias("windows"))
    far = searched(forest, asked.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), negatives, False, anchors)
    best = best_of(far, ["anchor_id", "tag"], negatives).select("anchor_id", F.col("tag").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(near, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH w AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, label, v FROM w QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v, label) = 1),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0)::BIGINT AS score
    FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
