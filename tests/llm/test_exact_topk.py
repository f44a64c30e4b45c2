import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import exact_topk


def brute(rows, k, wanted):
    out = {}
    for q, qv in rows.items():
        if wanted(q):
            scored = sorted((-int(np.dot(qv, v)), i) for i, v in rows.items() if i != q and len(v) == len(qv))
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("block", [4096, 30])
def test_against_all_rows(spark, block):
    draw = random.Random(block)
    crowd = [draw.randint(-3, 3) / 8 for _ in range(6)]
    rows = {}
    for i in range(400):
        rows[i] = list(crowd) if draw.random() < .3 else [draw.randint(-4, 4) / 8 for _ in range(6)]
    rows[401], rows[402], rows[410] = [1.0, 2.0], [0.5, -1.0], [0.0] * 6
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows.items()], "vec_id long, embedding array<float>, rank int")
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows.items()}
    got = {}
    for r in exact_topk.top_k(docs, F.col("vec_id") % 10 == 0, 7, block=block, queries=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == brute(whole, 7, lambda q: q % 10 == 0)


def test_search_stops_early():
    rng = np.random.default_rng(1)
    rows = rng.normal(scale=2, size=(5000, 3)).round().astype(np.int64)
    rows[17] = [900, 900, 900]
    rows[18] = [800, 800, 800]
    order = np.argsort(-rows, axis=0, kind="stable").T.copy()
    places, scores = exact_topk.threshold_search(rows, order, np.array([1, 1, 1]), lambda p, s: int(np.sort(s)[-2]) if len(s) > 1 else None)
    assert len(places) < 200 and {17, 18} <= set(places.tolist())


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (None, [9.0, 9.0]), (5, [1.0, 0.5]), (100, [0.5, 0.5]), (200, []), (6, [1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in exact_topk.top_k(docs, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 1024 * 1536), (0, 2, 100, 1024 * 1024), (100, 1, 0, 1024 * 1024), (100, 2, 5, 512 * 1536)]
    assert exact_topk.top_k(docs.limit(0), F.lit(True)).count() == 0
