import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom import session
from fieldloom.operators import graph as G
from fieldloom.operators import graph_algorithms as GA
from fieldloom.operators.build import build_graph
from fieldloom.operators.documents import document_nodes

EDGE = "src string, dst string, relationship_type string, weight double"


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "r", float(w)) for a, b, w in pairs], EDGE)


def nodes_of(spark, ids):
    return spark.createDataFrame([(i, "t", {}) for i in ids], "id string, node_type string, attrs map<string,string>")


def random_graph(seed, n=24, m=30):
    rng = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(n)]
    found = {}
    for _ in range(m):
        a, b = rng.sample(ids, 2)
        found[(a, b)] = rng.choice([0.5, 1.0, 2.0])
    return ids, [(a, b, w) for (a, b), w in found.items()]


def test_consolidation(spark):
    e = spark.createDataFrame([("a", "b", "x", 0.9), ("b", "a", "y", 0.4), ("c", "d", "x", 0.5), ("d", "c", "y", 0.5), ("e", "f", "x", 0.05), ("f", "g", "x", 0.1),
                               ("g", "h", "x", None)], EDGE)
    got = {(r.src, r.dst): (r.relationship_type, r.consolidated, r.original_count) for r in G.optimise(e).collect()}
    assert got == {("a", "b"): ("x", True, 2), ("c", "d"): ("x", True, 2), ("f", "g"): ("x", False, 1)}


def test_upserts_merge_attributes(spark):
    v = spark.createDataFrame([("a", "t1", {"x": "1", "y": "1"}, 1), ("a", "t2", {"y": "2", "z": "3"}, 2), ("b", "t", {}, 1)],
                              "id string, node_type string, attrs map<string,string>, seq int")
    got = {r.id: r for r in G.upsert_nodes(v).collect()}
    assert got["a"].node_type == "t2" and got["a"].attrs == {"x": "1", "y": "2", "z": "3"} and got["b"].attrs == {}


def test_statistics(spark):
    ids, pairs = random_graph(1)
    s = G.size_statistics(nodes_of(spark, ids), edges_of(spark, pairs)).first()
    assert s.average_degree == pytest.approx(2 * len(pairs) / len(ids)) and s.density == pytest.approx(len(pairs) / (len(ids) * (len(ids) - 1)))
    none = G.size_statistics(nodes_of(spark, []), edges_of(spark, [])).first()
    assert (none.num_nodes, none.average_degree, none.density) == (0, 0.0, 0.0)
    one = G.size_statistics(nodes_of(spark, ["a"]), edges_of(spark, [])).first()
    assert (one.average_degree, one.density) == (0.0, 0.0)


def test_neighbours_subgraph_completion(spark):
    e = spark.createDataFrame([("a", "b", "r", 1.0), ("b", "a", "q", 1.0), ("c", "a", "q", 1.0), ("c", "d", "r", 1.0)], EDGE)
    assert {r[0] for r in G.neighbours_of(e, "a").collect()} == {"b", "c"}
    assert {r[0] for r in G.neighbours_of(e, "a", "r").collect()} == {"b"}
    assert {(r.id, r.neighbour) for r in G.neighbours(e, nodes_of(spark, ["a", "d", "zz"])).collect()} == {("a", "b"), ("a", "c"), ("d", "c")}
    full = G.complete_nodes(nodes_of(spark, ["a", "b"]), e)
    assert {(r.id, r.node_type) for r in full.collect()} == {("a", "t"), ("b", "t"), ("c", "unknown"), ("d", "unknown")}
    kept, inside = G.subgraph(full, e, nodes_of(spark, ["a", "c", "zz"]).select("id"))
    assert {r.id for r in kept.collect()} == {"a", "c"} and [(r.src, r.dst) for r in inside.collect()] == [("c", "a")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    ids, pairs = random_graph(seed, 40, 30)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in pairs:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    got = {r.id: r.component for r in GA.components(nodes_of(spark, ids), edges_of(spark, pairs)).collect()}
    assert got == {i: root(i) for i in ids}


def test_components_of_a_long_chain(spark):
    ids = [f"n{i:03d}" for i in range(100)]
    order = ids[:]
    random.Random(4).shuffle(order)
    got = GA.components(nodes_of(spark, ids), edges_of(spark, [(a, b, 1) for a, b in zip(order, order[1:])]))
    assert {r.component for r in got.collect()} == {"n000"}
    assert GA.is_connected(nodes_of(spark, ids), edges_of(spark, [])).first()[0] is False
    assert GA.is_connected(nodes_of(spark, []), edges_of(spark, [])).first()[0] is False


def test_pagerank(spark):
    ids, pairs = random_graph(5)
    n, at = len(ids), {x: i for i, x in enumerate(ids)}
    m = np.zeros((n, n))
    for a, b, w in pairs:
        m[at[b], at[a]] = w
    out = m.sum(0)
    share = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
    r = np.full(n, 1 / n)
    for _ in range(200):
        r = 0.15 / n + 0.85 * (share @ r + r[out == 0].sum() / n)
    got = {x.id: x.score for x in GA.pagerank(nodes_of(spark, ids), edges_of(spark, pairs), tol=1e-9).collect()}
    assert sum(got.values()) == pytest.approx(1)
    assert all(got[x] == pytest.approx(r[at[x]], abs=1e-6) for x in ids)


def all_betweenness(ids, pairs):
    out = {i: [] for i in ids}
    for a, b, _ in pairs:
        out[a].append(b)
    score = dict.fromkeys(ids, 0.0)
    for s in ids:
        dist, paths, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for w in out[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0.0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        dep = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in order:
                if w in out[v] and dist[w] == dist[v] + 1:
                    dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                score[w] += dep[w]
    n = len(ids)
    return {k: v / ((n - 1) * (n - 2)) for k, v in score.items()}


@pytest.mark.parametrize("batches", [1, 3])
def test_betweenness(spark, batches):
    ids, pairs = random_graph(6, 14, 30)
    got = {r.id: r.score for r in GA.betweenness(nodes_of(spark, ids), edges_of(spark, pairs), batches).collect()}
    want = all_betweenness(ids, pairs)
    assert all(got[i] == pytest.approx(want[i]) for i in ids) and max(want.values()) > 0


def test_simple_paths(spark):
    ids, pairs = random_graph(7, 10, 16)
    near = {i: set() for i in ids}
    for a, b, _ in pairs:
        near[a].add(b)
        near[b].add(a)

    def walk(path, limit):
        if path[-1] == ids[1]:
            yield tuple(path)
        elif len(path) <= limit:
            for w in near[path[-1]]:
                if w not in path:
                    yield from walk(path + [w], limit)

    for limit in (1, 3, 5):
        got = [tuple(r.path) for r in GA.simple_paths(edges_of(spark, pairs + [(b, a, w) for a, b, w in pairs[:3]]), ids[0], ids[1], limit).collect()]
        assert len(got) == len(set(got)) and set(got) == set(walk([ids[0]], limit))
    assert GA.simple_paths(edges_of(spark, pairs), ids[0], ids[0]).isEmpty()


def two_cliques():
    a, b = [f"a{i}" for i in range(6)], [f"b{i}" for i in range(6)]
    pairs = [(x, y, 1) for g in (a, b) for x in g for y in g if x < y] + [("a0", "b0", 1)]
    return a + b, pairs


def test_louvain(spark):
    ids, pairs = two_cliques()
    nodes, edges = nodes_of(spark, ids + ["lone"]), edges_of(spark, pairs)
    found = GA.louvain(nodes, edges)
    assert {r.id: r.community for r in found.collect()} == {**{i: i[0] + "0" for i in ids}, "lone": "lone"}
    single = nodes.select("id", F.col("id").alias("community"))
    assert GA.modularity(edges, found) > GA.modularity(edges, single)


@pytest.mark.parametrize("seed", [8, 9])
def test_louvain_never_loses_modularity(spark, seed):
    ids, pairs = random_graph(seed)
    nodes, edges = nodes_of(spark, ids), edges_of(spark, pairs)
    found = GA.louvain(nodes, edges)
    assert sorted(r.id for r in found.collect()) == ids
    assert GA.modularity(edges, found) >= GA.modularity(edges, nodes.select("id", F.col("id").alias("community")))


def most_to_gain(pairs, of):
    """The largest rise of modularity by moving one node to a community it has an edge to, and by joining two communities."""
    m = sum(w for *_, w in pairs)
    degree, ends, to = {}, {}, {}
    for a, b, w in pairs:
        for x, y in ((a, b), (b, a)):
            degree[x] = degree.get(x, 0.0) + w
            ends[of[x]] = ends.get(of[x], 0.0) + w
            if a != b:
                to[x, of[y]] = to.get((x, of[y]), 0.0) + w
    move = [(w - to.get((x, of[x]), 0.0)) / m - degree[x] * (ends[c] - ends[of[x]] + degree[x]) / (2 * m * m) for (x, c), w in to.items() if c != of[x]]
    between = {}
    for (x, c), w in to.items():
        if c != of[x]:
            between[of[x], c] = between.get((of[x], c), 0.0) + w
    return max(move, default=-1.0), max([w / m - ends[c] * ends[d] / (2 * m * m) for (c, d), w in between.items()], default=-1.0)


def stars_and_clusters():
    rng = random.Random(3)
    stars = [(f"l{i:02d}", f"h{i % 4}", 1.0) for i in range(60)] + [(f"h{i}", "top", 1.0) for i in range(4)]
    mixed = [(f"n{a:02d}", f"n{b:02d}", rng.choice([0.5, 1.0, 2.0])) for a in range(50) for b in range(a) if rng.random() < 0.08]
    return stars, mixed + [("n07", "n07", 1.5)]


@pytest.mark.parametrize("which", [0, 1])
def test_louvain_goes_on_until_nothing_gains(spark, which):
    """Neither joining two communities nor, after the moves of a level, moving one node raises modularity."""
    pairs = stars_and_clusters()[which]
    ids = sorted({x for p in pairs for x in p[:2]})
    edges = edges_of(spark, pairs)
    found = {r.id: r.community for r in GA.louvain(nodes_of(spark, ids), edges).collect()}
    assert sorted(found) == ids and most_to_gain(pairs, found)[1] < 1e-9
    rounds = {name: session.Rounds(spark, name) for name in ("degree", "links", "placed", "wishes")}
    placed, moved = GA._local_moves(edges.select("src", "dst", "weight"), 2.0 * sum(w for *_, w in pairs), rounds)
    assert moved and most_to_gain(pairs, {r.id: r.community for r in placed.collect()})[0] < 1e-9


def test_louvain_of_no_weight(spark):
    nodes = nodes_of(spark, ["a", "b", "c"])
    for pairs in ([], [("a", "b", 0.0)]):
        assert {r.id: r.community for r in GA.louvain(nodes, edges_of(spark, pairs) if pairs else spark.createDataFrame([], EDGE)).collect()} == {i: i for i in "abc"}
    with pytest.raises(ValueError):
        GA.louvain(nodes, edges_of(spark, [("a", "b", 1.0), ("b", "c", -1.0)]))


def test_modularity_value(spark):
    ids, pairs = two_cliques()
    labels = spark.createDataFrame([(i, i[0]) for i in ids], "id string, community string")
    assert GA.modularity(edges_of(spark, pairs), labels) == pytest.approx(30 / 31 - 2 * (31 / 62) ** 2)


@pytest.mark.parametrize("seed", [10, 11])
def test_label_propagation_is_stable(spark, seed):
    ids, pairs = random_graph(seed)
    near = {i: set() for i in ids}
    for a, b, _ in pairs:
        near[a].add(b)
        near[b].add(a)
    got = {r.id: r.community for r in GA.label_propagation(nodes_of(spark, ids), edges_of(spark, pairs)).collect()}
    assert sorted(got) == ids
    for i in ids:
        if near[i]:
            votes = [got[j] for j in near[i]]
            assert votes.count(got[i]) == max(votes.count(v) for v in votes)


def test_degree_and_top(spark):
    ids, pairs = two_cliques()
    got = GA.central_nodes(nodes_of(spark, ids), edges_of(spark, pairs), "degree", 3).collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [("a0", round(6 / 11, 6)), ("b0", round(6 / 11, 6)), ("a1", round(5 / 11, 6))]
    with pytest.raises(ValueError):
        GA.central_nodes(nodes_of(spark, ids), edges_of(spark, pairs), "closeness")


def test_presentation(spark):
    n = spark.createDataFrame([("a", "field", {"s": "1.5", "long": "x" * 60}), ("b", "weird", {})], "id string, node_type string, attrs map<string,string>")
    got = {r.id: r for r in G.node_presentation(n, "s").collect()}
    assert got["a"].colour == "blue" and got["a"].size == 30.0 and got["b"].size == 10.0 and got["b"].colour == "gray"
    assert f"<br>long: {'x' * 50}" in got["a"].hover and "x" * 51 not in got["a"].hover
    assert G.edge_presentation(edges_of(spark, [("a", "b", 0.125)])).first().label == "a --[r(0.12)]--> b"


def test_review_pairs(spark):
    docs = spark.createDataFrame([(f"d{i}",) for i in range(301)], "doc_id string")
    got = sorted(map(tuple, G.review_pairs(docs).collect()))
    assert len(got) == 300 and all(a < b for a, b in got) and len(set(got)) == 300
    assert {x for pair in got for x in pair} == {f"d{i}" for i in range(301)}
    assert got == sorted(map(tuple, G.review_pairs(docs.repartition(3)).collect())) != sorted(map(tuple, G.review_pairs(docs, seed=8).collect()))
    assert G.review_pairs(docs.limit(1)).isEmpty()


def test_loops_raise_at_a_bound_and_keep_two_rounds(spark):
    import glob

    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    pairs = [(str(i), str((i * i + k) % 40), 1.0) for i in range(40) for k in (1, 2)]
    nodes, edges = nodes_of(spark, [str(i) for i in range(40)]), edges_of(spark, pairs)
    with pytest.raises(RuntimeError):
        GA.pagerank(nodes, edges, max_iter=1)
    assert {r.score for r in GA.pagerank(nodes, edges, iterations=0).collect()} == {1 / 40}
    with pytest.raises(RuntimeError):
        GA.label_propagation(nodes, edges, max_rounds=0)
    before = set(glob.glob(f"{base}/fieldloom/*"))
    GA.pagerank(nodes, edges, iterations=9)
    made = set(glob.glob(f"{base}/fieldloom/*")) - before
    assert sum(len(glob.glob(f"{m}/[01]")) for m in made) == 2 and len(made) == 2


def test_pagerank_rounds_shuffle_no_edges(spark):
    """Edges in buckets by source meet the ranks without an exchange of their own, and no table is left behind."""
    edges = edges_of(spark, [(str(i), str(i * 7 % 50), 1.0 + i % 3) for i in range(200)])
    links, forget = session.bucketed(edges.select("src", "dst", "weight"), "src", "shares")
    ranks = spark.range(200).select(F.col("id").cast("string").alias("src"), F.lit(1.0).alias("score"))
    plan = links.join(ranks.hint("merge"), "src")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert sorted(map(tuple, links.collect())) == sorted(map(tuple, edges.select("src", "dst", "weight").collect()))
    forget()
    before = len(spark.catalog.listTables())
    GA.pagerank(nodes_of(spark, [str(i) for i in range(50)]), edges, iterations=2)
    assert len(spark.catalog.listTables()) == before


DOC = "doc_id string, type string, source_file string, content string, parent_document string, metadata map<string,string>"


def docs(spark):
    return spark.createDataFrame([
        ("p", "pdf", "f.pdf", "whole", None, {"node_type": "x", "n": "1"}), ("p_1", "pdf_page", "f.pdf", "one", "p", {}), ("p_2", "pdf_page", "f.pdf", "two", "gone", None),
        ("c", "csv_row", "g.csv", None, None, {})], DOC)


def test_document_edges(spark):
    d = docs(spark)
    node = {r.id: r.attrs for r in document_nodes(d).collect()}
    assert node["p"] == {"n": "1", "node_type": "pdf", "source_file": "f.pdf", "content_length": "5"} and node["c"]["content_length"] == "0"
    assert [(r.src, r.dst) for r in G.contains_edges(d).collect()] == [("p", "p_1")]
    nodes, edges = G.source_edges(d)
    assert nodes.first().attrs == {"file_path": "f.pdf", "document_count": "3"} and edges.count() == 3


def test_build(spark):
    v = spark.createDataFrame([("p", [1.0, 0.0]), ("p_1", [1.0, 0.0]), ("p_2", [0.9, 0.1]), ("c", [0.0, 1.0])], "id string, embedding array<double>")
    fields = spark.createDataFrame([("g.csv", "a", [1.0, 0.0]), ("g.csv", "b", [1.0, 0.1]), ("h.csv", "a", [1.0, 0.0])], "source_file string, field string, embedding array<double>")
    model = spark.createDataFrame([("c", "p", "ai_x", 0.9), ("c", "nowhere", "ai_x", 0.9), ("p_2", "c", "ai_x", 0.05)], EDGE)
    nodes, edges, report = build_graph(docs(spark), v, 0.7, fields=fields, model_edges=model)
    got = {(r.relationship_type, r.src, r.dst) for r in edges.collect() if r.relationship_type != "source_of"}
    assert got == {("contains", "p", "p_1"), ("semantic_similarity", "p", "p_2"), ("field_similarity", "field_g.csv_a", "field_g.csv_b"), ("ai_x", "c", "p")}
    assert report.first().field_relationships == 1 and report.first().semantic_relationships == 2
    ids = [r.id for r in nodes.collect()]
    assert len(ids) == len(set(ids)) and {"field_g.csv_a", "p", "c"} <= set(ids)


def test_build_of_every_pair(spark):
    """Documents and fields that share a vector meet all that it is similar to, not only the first of them."""
    v = spark.createDataFrame([("p", [1.0, 0.0]), ("p_1", [1.0, 0.0]), ("p_2", [0.9, 0.1]), ("c", [0.9, 0.1])], "id string, embedding array<double>")
    fields = spark.createDataFrame([("g.csv", x, [1.0, y]) for x, y in (("a", 0.0), ("b", 0.1), ("c", 0.0), ("d", 0.0))], "source_file string, field string, embedding array<double>")
    nodes, edges, report = build_graph(docs(spark), v, 0.7, fields=fields, every_pair=True)
    found = {(r.src, r.dst) for r in edges.collect() if r.relationship_type in ("semantic_similarity", "field_similarity")}
    assert found == {("c", "p"), ("c", "p_1"), ("c", "p_2"), ("p", "p_2"), ("p_1", "p_2")} | {
        (f"field_g.csv_{a}", f"field_g.csv_{b}") for a, b in ("ab", "ac", "ad", "bc", "bd", "cd")}
    assert report.first().semantic_relationships == 6 and report.first().field_relationships == 6
    assert nodes.where("node_type = 'field'").count() == 4


@pytest.mark.parametrize("first", [0, 1_999_999_990])
def test_graph_report_counts_pairs_of_copies_as_the_sql_does(spark, tmp_path, first):
    import __spark_entry__ as entry
    import duckdb

    rng = np.random.default_rng(4)
    m = rng.normal(size=(12, 4)).astype(np.float32)[[*range(12), 3, 3, 3, 5, 11, 11]]
    tables = {
        "embeddings": spark.createDataFrame([(first + i, v.tolist(), i % 2) for i, v in enumerate(m)], "vec_id bigint, embedding array<float>, label int"),
        "documents": spark.createDataFrame([(first + i, f"text {i}", "en", f"s{i % 3}", 6) for i in range(10)], "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        "part": spark.createDataFrame([(i, f"part {i}", f"Brand#{i % 2}", "TYPE", i + 1, 1.0) for i in range(4)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")}
    db = duckdb.connect()
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = db.execute(entry.oracle_sql()["gr11_graph_report"]).fetchall()
    assert [tuple(r) for r in entry.queries()["gr11_graph_report"](spark, str(tmp_path)).collect()] == want


def test_build_deals_edges_by_their_true_size(spark, monkeypatch):
    """The planner guesses the size of the joins before as a product, by which a few edges would be dealt to thousands of tasks."""
    seen = []
    for module in ("build", "graph"):
        monkeypatch.setattr(f"fieldloom.operators.{module}.spread", lambda df, *by: seen.append(session.estimated_bytes(df)) or session.spread(df, *by), raising=False)
    v = spark.createDataFrame([("p", [1.0, 0.0]), ("p_1", [1.0, 0.0]), ("p_2", [0.9, 0.1]), ("c", [0.0, 1.0])], "id string, embedding array<double>")
    build_graph(docs(spark), v, 0.7, model_edges=spark.createDataFrame([("c", "p", "ai_x", 0.9)], EDGE))
    assert len(seen) == 2 and max(seen) < 1 << 20


def test_sources_alike_are_worked_off_once(spark):
    """Members that nothing leads to share one start; scores are those of all sources, with cycles and shared targets."""
    rows = [(f"m{i}", t) for i in range(40) for t in (["hub"] if i % 2 else ["hub", "side"])] + [("hub", "top"), ("side", "top"), ("top", "end"), ("end", "hub"), ("lone", "top")]
    edges = spark.createDataFrame([(a, b, "r", 1.0) for a, b in rows], "src string, dst string, relationship_type string, weight double")
    nodes = GA.endpoints(edges)
    starts = {r.src: r.times for r in GA._alike_sources(edges.select("src", "dst")).collect()}
    assert len(starts) == 7 and sorted(starts.values()) == [1, 1, 1, 1, 1, 20, 20]
    ids = sorted({x for e in rows for x in e})
    near = {i: sorted({b for a, b in rows if a == i}) for i in ids}
    want = dict.fromkeys(ids, 0.0)
    for s in ids:  # Brandes
        order, dist, paths, before = [s], {s: 0}, {s: 1.0}, {}
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0.0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before.setdefault(w, []).append(v)
        dep = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before.get(w, []):
                dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                want[w] += dep[w] / ((len(ids) - 1) * (len(ids) - 2))
    for batches in (None, 3):
        got = {r.id: r.score for r in GA.betweenness(nodes, edges, batches).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in ids)


def test_edges_are_consolidated_in_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    """However small the shuffle looks, a task gets edges of one part only; pairs stay together."""
    path = str(tmp_path / "edges")
    spark.range(3000).select(F.concat(F.lit("n"), F.col("id") % 1500).alias("src"), F.concat(F.lit("m"), F.col("id") % 1500).alias("dst"), F.lit("r").alias("relationship_type"),
                             (F.col("id") / 3000).alias("weight")).write.parquet(path)
    monkeypatch.setattr(G, "EDGE_BYTES", 1024, raising=False)
    made = G.consolidate(spark.read.parquet(path))
    assert made.count() == 1500 and made.where("original_count = 2 and weight >= 0.5").count() == 1500
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > spark.sparkContext.defaultParallelism


def test_stored_tables_that_are_not_small_do_not_go_through_the_driver(spark, monkeypatch):
    labels = session.materialise(spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, label string"), "labels")

    def plan():
        named = GA._smallest_id(labels, "label")
        assert sorted(map(tuple, named.collect())) == [("a", "a"), ("b", "a"), ("c", "c")]
        return named._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastExchange" in plan()
    monkeypatch.setattr(session, "SENT_BYTES", -1)
    assert "BroadcastExchange" not in plan()
