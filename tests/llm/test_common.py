import random

import numpy as np
import pyarrow as pa

from fieldloom.llm import common


def test_slices_cover_a_batch_in_order_and_bound_its_bytes():
    draw = random.Random(1)
    texts = [None if draw.random() < .1 else "é" * draw.choice([0, 1, 5, 300]) for _ in range(500)]
    batch = pa.RecordBatch.from_pydict({"n": list(range(500)), "text": texts})
    parts = list(common.slices(batch, "text", 400))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(500))
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 400 for p in parts)
    assert list(common.slices(batch.slice(0, 0), "text")) == []
    assert [x for p in common.slices(batch.slice(100, 50), "text", 400) for x in p.column(0).to_pylist()] == list(range(100, 150))


def test_bytes_and_hashes_of_slices():
    values = pa.array(["a", "", "été", "a", "ab", "ba", "\x00", "\x00\x00"])
    data, at = common.bytes_of(values.slice(2, 3))
    assert bytes(data) == "étéaab".encode() and at.tolist() == [0, 5, 6, 8]
    whole, part = common.hash_strings(values), common.hash_strings(values.slice(2))
    assert (whole[2:] == part).all() and whole[0] == whole[3] and len(set(whole.tolist())) == 7
    many = pa.array([f"w{i}" for i in range(200_000)])
    assert len(np.unique(common.hash_strings(many))) == 200_000


def test_distinct_and_unused():
    assert common.distinct(np.array([3, 1, 3, 2])).tolist() == [1, 2, 3] and len(common.distinct(np.zeros(0, np.int64))) == 0
    assert common.unused("node", ["NODE", "node_"]) == "node__"


def test_labelled_sample(spark):
    rows = [(i, i % 2) for i in range(300)] + [(None, 1), (3, None), (5, 7), (4, 1), (4, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    got = {r.doc_id: r.label for r in common.labelled_sample(labels, "toxic", 1000).collect()}
    held = {r.doc_id for r in labels.where(common.held_out()).collect()}
    assert held and not held & set(got) and set(got) == set(range(300)) - held and got.get(4, 0) == 0
    assert common.labelled_sample(labels, "toxic", 20).count() == 20
