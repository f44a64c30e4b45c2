import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import vectors as V
from fieldloom.operators import collection as CO
from fieldloom.operators import embedding as EM
from fieldloom.operators import similarity as SI


def unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def made(n=120, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    m[: n // 3] = m[0] + 0.05 * rng.normal(size=(n // 3, dim))  # a third of all rows is one crowd
    m[n // 3: n // 3 + 20] = m[n // 3]                           # and twenty are copies
    m[-1] = 0
    return m


def frame(spark, m, extra=None):
    rows = [(i, [float(x) for x in v], None if extra is None else extra[i]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id bigint, embedding array<double>, grp string")


def expand(pairs, copies):
    """All pairs from pairs over distinct vectors and their copies (small fixture only)."""
    held = {}
    for rep, other in copies:
        held.setdefault(rep, [rep]).append(other)
    out = set()
    for a, b in pairs:
        for x in held.get(a, [a]):
            for y in held.get(b, [b]):
                out.add((min(x, y), max(x, y)))
    for group in held.values():
        out |= {(x, y) for x in group for y in group if x < y}
    return out


@pytest.mark.parametrize("threshold,pivots,block", [(0.7, 1, 2048), (0.7, 6, 16), (0.95, 9, 7), (0.3, 5, 10)])
def test_pairs_against_brute_force(spark, threshold, pivots, block):
    m = made()
    pairs, copies = SI.similar_pairs(frame(spark, m), threshold, pivots=pivots, block_rows=block)
    rows = pairs.collect()
    assert len({(r.id_a, r.id_b) for r in rows}) == len(rows) and all(r.id_a < r.id_b for r in rows)
    sims = unit(m) @ unit(m).T
    want = {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if sims[i, j] >= threshold}
    assert expand({(r.id_a, r.id_b) for r in rows}, {(r.rep, r.id) for r in copies.collect()}) == want
    assert all(abs(r.similarity - sims[r.id_a, r.id_b]) < 1e-9 for r in rows)


@pytest.mark.parametrize("parts,pivots,block", [(4096, 1, 2048), (3, 6, 16)])
def test_every_pair_lists_the_copies_too(spark, monkeypatch, parts, pivots, block):
    """Copies pair with all that their vector is similar to; zeros and ids that are null pair with nothing, rows that come twice count once."""
    monkeypatch.setattr(SI, "COPIES", parts, raising=False)
    m = made()
    m[-3:] = 0
    groups = ["a" if i % 3 else "b" for i in range(len(m))]
    rows = [(i, [float(x) for x in v], groups[i]) for i, v in enumerate(m)]
    vectors = spark.createDataFrame(rows + rows[38:44] + [(None, rows[0][1], "a"), (7, rows[50][1], "a"), (3, None, "a"), (5, rows[0][1], None)], "id bigint, embedding array<double>, grp string")
    held = [(i, v, g) for i, v, g in rows] + [(7, rows[50][1], "a")]
    sims = unit(np.array([v for _, v, _ in held])) @ unit(np.array([v for _, v, _ in held])).T
    for within, alike in (([], lambda a, b: True), (["grp"], lambda a, b: a == b)):
        given = vectors if within else vectors.where("grp is not null")
        got = SI.every_similar_pair(given, 0.7, within=within, pivots=pivots, block_rows=block).collect()
        want = sorted((a, b) for i, (a, _, g) in enumerate(held) for j, (b, _, h) in enumerate(held) if a < b and alike(g, h) and sims[i, j] >= 0.7)
        assert sorted((r.id_a, r.id_b) for r in got) == want
        assert all(0.7 <= r.similarity <= 1 + 1e-9 for r in got)


def test_pairs_inside_groups(spark):
    m = made(60)
    groups = ["a" if i % 3 else "b" for i in range(60)]
    pairs, copies = SI.similar_pairs(frame(spark, m, groups), 0.6, within=["grp"], pivots=1, block_rows=8)
    got = expand({(r.id_a, r.id_b) for r in pairs.collect()}, {(r.rep, r.id) for r in copies.collect()})
    sims = unit(m) @ unit(m).T
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if groups[i] == groups[j] and sims[i, j] >= 0.6}


def test_pairs_of_nothing(spark):
    pairs, copies = SI.similar_pairs(frame(spark, np.zeros((0, 3))), 0.7)
    assert pairs.isEmpty() and copies.isEmpty()


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("rows", [(8192, 512), (7, 9)])
def test_nearest_many(spark, metric, rows):
    m = made(50)
    df = frame(spark, m).repartition(3)
    got = SI.nearest_many(df, df.select(F.col("id").alias("query_id"), "embedding"), 4, metric, *rows).collect()
    dist = ((m[:, None] - m[None]) ** 2).sum(-1) if metric == "l2sq" else 1 - unit(m) @ unit(m).T
    for q in range(50):
        mine = [(r.id, r.rank) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
        order = sorted(range(50), key=lambda i: (round(float(dist[q, i]), 9) + 0.0, i))[:4]
        assert mine == [(i, n + 1) for n, i in enumerate(order)], q


def test_single_query_filters_and_ties(spark):
    c = spark.createDataFrame([("b", [1.0, 0.0], "x", {"k": "1"}), ("a", [1.0, 0.0], "y", {"k": "1"}), ("c", [0.0, 1.0], "z", {"k": "2"}), ("d", None, "w", {})],
                              "id string, embedding array<float>, document string, metadata map<string,string>")
    got = SI.nearest(c, [1.0, 0.0], 3)
    assert [(r.id, r.distance, r.similarity) for r in got.collect()] == [("a", 0.0, 1.0), ("b", 0.0, 1.0), ("c", 2.0, -1.0)]
    assert [r.id for r in SI.nearest(c, [1.0, 0.0], 3, where={"k": "2"}).collect()] == ["c"]
    assert [r.id for r in SI.similar_documents(c, "a", 5).collect()] == ["b", "c"]
    assert SI.similar_documents(c, "zz").isEmpty() and SI.similar_documents(c, "d").isEmpty()
    assert {r.id for r in SI.similar_to(c, [1.0, 0.0], 0.7).collect()} == {"a", "b"}


def test_cosine_of_zero_and_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [4.0, 3.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 0.0 and abs(got[1] - 0.96) < 1e-9 and got[2] is None


def test_text_vectors(spark):
    docs = spark.createDataFrame([(1, "claim payment amount"), (2, "Payment, amount CLAIM!"), (3, "zebra"), (4, " \n"), (5, None)], "id int, content string")
    embedded = EM.fit_text_vectors(docs, 512)(docs)
    got = {r.id: r.embedding for r in embedded.collect()}
    assert got[4] is None and got[5] is None and len(got[1]) == 512
    assert abs(np.dot(got[1], got[2]) - 1) < 1e-5 and abs(np.linalg.norm(got[3]) - 1) < 1e-5 and abs(np.dot(got[1], got[3])) < 1e-6
    report = EM.load_report(embedded).first()
    assert (report.total_texts, report.documents_added, report.failed_embeddings) == (5, 3, 2)


def stored(spark):
    return spark.createDataFrame([("a", [1.0], "one the", {"x": "1"}), ("b", [2.0], "two", {"y": "2"})],
                                 "id string, embedding array<double>, document string, metadata map<string,string>")


def test_collection_changes(spark):
    c = stored(spark)
    batch = spark.createDataFrame([("b", [9.0], "new", {}), ("c", [3.0], "three", {}), ("c", [3.0], "three", {}), ("d", None, "four", {})], c.schema)
    assert sorted((r.id, r.document) for r in CO.add_batch(c, batch).collect()) == [("a", "one the"), ("b", "two"), ("c", "three")]
    change = spark.createDataFrame([("a", None, "ONE", None), ("zz", [1.0], "no", {})], c.schema)
    got = {r.id: r for r in CO.update(c, change).collect()}
    assert set(got) == {"a", "b"} and got["a"].document == "ONE" and got["a"].embedding == [1.0] and got["a"].metadata == {"x": "1"}
    assert [r.id for r in CO.delete(c, change).collect()] == ["b"]
    assert CO.drop_all(c).isEmpty() and CO.drop_all(c).schema == c.schema
    assert [r.id for r in CO.search_text(c, "the").collect()] == ["a"] and CO.search_text(c, "The").isEmpty()
    stats = CO.collection_stats(c).first()
    assert (stats.total_documents, stats.sample_size, stats.metadata_keys) == (2, 2, ["x", "y"])
    empty = CO.collection_stats(CO.drop_all(c)).first()
    assert (empty.total_documents, empty.sample_size, empty.metadata_keys) == (0, 0, [])


def test_added_documents_get_running_ids(spark):
    new = spark.createDataFrame([(2, {"_mapping_type": "data_mapping"}), (1, {}), (3, None)], "n int, metadata map<string,string>")
    got = {r.n: (r.doc_id, r.type) for r in CO.add_documents(stored(spark), new, ["n"]).collect()}
    assert got == {1: ("doc_2", "document"), 2: ("doc_3", "data_mapping"), 3: ("doc_4", "document")}


@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
def test_the_nearest_of_a_block_are_found_without_sorting_it(metric, monkeypatch):
    """Ties, copies, zero, huge and odd vectors over several tiles, against a full sort; only a small share of all distances is sorted."""
    monkeypatch.setattr(SI, "NEAR_ROWS", 700)
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(5000, 16))
    vecs[100:200] = vecs[:100]
    vecs[300], vecs[301] = 0, vecs[299] * (1 + 1e-12)
    codes, sorted_rows, plain = rng.permutation(5000), [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or plain(keys))
    own, code, dist = SI._nearest_codes(vecs, codes, vecs[:320].copy(), 5, metric)
    assert sum(sorted_rows) < 0.2 * 320 * 5000
    one = unit(vecs)
    full = 1 - one[:320] @ one.T if metric == "cosine" else ((vecs[:320, None, :] - vecs[None]) ** 2).sum(2)
    for q in range(320):
        want = plain((codes, np.round(np.maximum(full[q], 0) if metric != "cosine" else full[q], 9)))[:5]
        assert code[own == q].tolist() == codes[want].tolist() and np.allclose(dist[own == q], full[q][want], atol=1e-9)
    wild = np.array([[1e200, 0], [np.nan, 1], [1, 1], [np.inf, 0], [1, 2]])
    own, code, _ = SI._nearest_codes(wild, np.arange(5), np.array([[1.0, 1.0]]), 2, metric)
    assert code.tolist() == ([2, 4] if metric == "l2sq" else [2, 4])
