"""Queries over the property graph."""

from pyspark.sql import functions as F

from fieldloom.operators import graph as G
from fieldloom.operators import graph_algorithms as GA
from fieldloom.operators.build import build_graph
from fieldloom.operators.mapping import mapping_graph
from fieldloom.plans import bindings as B
from fieldloom.plans.registry import query, table
from fieldloom.session import materialise

KINDS = ("customer", "supplier", "nation", "region", "part")
NODES = B.sql_nodes(*KINDS)


def _nodes(spark, sf_dir):
    return B.nodes_of(spark, sf_dir, *KINDS)


def _edges(spark, sf_dir):
    return B.place_edges(spark, sf_dir).unionByName(B.supply_edges(spark, sf_dir))


EDGES = f"{B.PLACE}, {B.SUPPLY}, edges AS (SELECT * FROM place UNION ALL SELECT * FROM supply)"
BOTH = f"{B.SUPPLY}, {B.RETURNS}, edges AS (SELECT * FROM supply UNION ALL SELECT * FROM returns)"


def _both(spark, sf_dir):
    return B.supply_edges(spark, sf_dir).unionByName(B.return_edges(spark, sf_dir))


@query("agg1_node_counts", f"WITH {NODES} SELECT node_type, count(*) AS nodes FROM nodes GROUP BY node_type")
def agg1(spark, sf_dir):
    return G.node_counts(_nodes(spark, sf_dir))


@query("agg2_edge_counts", f"WITH {EDGES} SELECT relationship_type, count(*) AS edges FROM edges GROUP BY relationship_type")
def agg2(spark, sf_dir):
    return G.edge_counts(_edges(spark, sf_dir))


@query("agg3_average_degree", f"WITH {NODES}, {EDGES} SELECT round(2.0 * (SELECT count(*) FROM edges) / (SELECT count(*) FROM nodes), 6) AS average_degree")
def agg3(spark, sf_dir):
    return G.size_statistics(_nodes(spark, sf_dir), _edges(spark, sf_dir)).select(F.round("average_degree", 6).alias("average_degree"))


@query("agg4_density", f"""WITH {NODES}, {EDGES}, n AS (SELECT count(*)::DOUBLE AS n FROM nodes), m AS (SELECT count(*)::DOUBLE AS m FROM edges)
SELECT n::BIGINT AS num_nodes, m::BIGINT AS num_edges, round(m / (n * (n - 1)), 8) AS density FROM n, m""")
def agg4(spark, sf_dir):
    return G.size_statistics(_nodes(spark, sf_dir), _edges(spark, sf_dir)).select("num_nodes", "num_edges", F.round("density", 8).alias("density"))


@query("agg5_connected", f"WITH {B.sql_nodes('customer', 'supplier', 'nation')} SELECT (SELECT count(*) FROM nation) = 1 AS is_connected FROM (SELECT DISTINCT 1 FROM nodes)")
def agg5(spark, sf_dir):
    return GA.is_connected(B.nodes_of(spark, sf_dir, "customer", "supplier", "nation"), B.place_edges(spark, sf_dir, regions=False))


@query("agg8_shared_sources", "SELECT source AS source_file, count(*) AS document_count FROM documents GROUP BY source HAVING count(*) > 1")
def agg8(spark, sf_dir):
    return G.shared_sources(B.documents(spark, sf_dir))


CONSOLIDATED = """g AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS original_count, max(coalesce(weight, 0)) AS top FROM kept GROUP BY ALL),
  best AS (SELECT g.original_count, k.*, row_number() OVER (PARTITION BY a, b ORDER BY k.src) AS rn FROM g JOIN kept k ON least(k.src, k.dst) = a AND greatest(k.src, k.dst) = b AND coalesce(k.weight, 0) = top)
SELECT src, dst, relationship_type, round(weight, 6) AS weight, original_count > 1 AS consolidated, original_count FROM best WHERE rn = 1"""


@query("agg9_consolidated_edges", f"WITH {BOTH}, kept AS (SELECT * FROM edges), {CONSOLIDATED}")
def agg9(spark, sf_dir):
    return G.consolidate(_both(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query("gr10_optimised_graph", f"WITH {BOTH}, kept AS (SELECT * FROM edges WHERE coalesce(weight, 0) >= 0.1), {CONSOLIDATED}")
def gr10(spark, sf_dir):
    return G.optimise(_both(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query("agg13_relationship_breakdown", f"""WITH {B.ME}, e AS (SELECT src, dst FROM me GROUP BY src, dst)
SELECT count(*) AS mapping_relationships, 0::BIGINT AS semantic_relationships, 0::BIGINT AS field_relationships, count(*) AS total_relationships FROM e""")
def agg13(spark, sf_dir):
    _, edges = mapping_graph(B.mappings(spark, sf_dir))
    return G.relationship_breakdown(G.upsert_edges(edges))


@query("gr1_node_upsert", """SELECT 'user_' || user_id AS id, arg_max(event_type, event_id) AS node_type,
  'last=' || max(event_id) || coalesce('|seen_click=' || max(event_id) FILTER (event_type = 'click'), '') || coalesce('|seen_view=' || max(event_id) FILTER (event_type = 'view'), '') AS attrs
FROM events GROUP BY user_id""")
def gr1(spark, sf_dir):
    e, key = table(spark, sf_dir, "events"), F.col("event_id").cast("string")
    attrs = F.when(F.col("event_type").isin("click", "view"), F.create_map(
        F.lit("last"), key, F.concat(F.lit("seen_"), "event_type"), key)).otherwise(F.create_map(F.lit("last"), key))
    made = e.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("node_type"), attrs.alias("attrs"), F.col("event_id").alias("seq"))
    return G.upsert_nodes(made).select("id", "node_type", F.array_join(F.transform(
        F.array_sort(F.map_entries("attrs")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "|").alias("attrs"))


@query("gr2_edge_upsert", """SELECT 'user_' || user_id AS src, 'type_' || event_type AS dst, 'did' || (max(event_id) % 3) AS relationship_type, round(arg_max(value, event_id), 6) AS weight,
  max(event_id)::VARCHAR AS last FROM events GROUP BY user_id, event_type""")
def gr2(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    made = e.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("type_"), "event_type").alias("dst"),
                    F.concat(F.lit("did"), (F.col("event_id") % 3).cast("string")).alias("relationship_type"), F.col("value").alias("weight"),
                    F.create_map(F.lit("last"), F.col("event_id").cast("string")).alias("attrs"), F.col("event_id").alias("seq"))
    return G.upsert_edges(made).select("src", "dst", "relationship_type", F.round("weight", 6).alias("weight"), F.col("attrs")["last"].alias("last"))


@query("jn7_neighbours", f"""WITH {EDGES}, u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges) SELECT a AS id, b AS neighbour FROM u WHERE starts_with(a, 'nation_')""")
def jn7(spark, sf_dir):
    return G.neighbours(_edges(spark, sf_dir), B.nodes_of(spark, sf_dir, "nation").select("id"))


@query("jn7_neighbours_of_one", f"""WITH {EDGES} SELECT DISTINCT src AS neighbour FROM edges WHERE dst = 'part_5' AND relationship_type = 'supplies'""")
def jn7_one(spark, sf_dir):
    return G.neighbours_of(_edges(spark, sf_dir), "part_5", "supplies")


@query("jn9_contains_edges", f"WITH {B.D} SELECT parent_document AS src, doc_id AS dst, 'contains' AS relationship_type, 1.0::DOUBLE AS weight FROM d WHERE parent_document IN (SELECT doc_id FROM d)")
def jn9(spark, sf_dir):
    return G.contains_edges(B.documents(spark, sf_dir))


@query("jn10_source_edges", f"WITH {B.D}, s AS (SELECT source_file, count(*) AS document_count FROM d GROUP BY source_file HAVING count(*) > 1) SELECT s.source_file, document_count::VARCHAR AS document_count, doc_id AS dst FROM s JOIN d ON d.source_file = s.source_file")
def jn10(spark, sf_dir):
    nodes, edges = G.source_edges(B.documents(spark, sf_dir))
    return edges.join(nodes.withColumnRenamed("id", "src"), "src").select(
        F.col("attrs")["file_path"].alias("source_file"), F.col("attrs")["document_count"].alias("document_count"), "dst")


@query("jn11_completed_nodes", f"WITH {EDGES}, {B.sql_nodes('customer', 'nation')} SELECT id, node_type FROM nodes UNION ALL SELECT DISTINCT id, 'unknown' FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) WHERE id NOT IN (SELECT id FROM nodes)")
def jn11(spark, sf_dir):
    return G.complete_nodes(B.nodes_of(spark, sf_dir, "customer", "nation"), _edges(spark, sf_dir)).select("id", "node_type")


@query("jn13_subgraph_edges", f"WITH {EDGES} SELECT src, dst, round(weight, 6) AS weight FROM edges WHERE (starts_with(src, 'nation_') OR starts_with(src, 'supplier_')) AND (starts_with(dst, 'nation_') OR starts_with(dst, 'supplier_'))")
def jn13(spark, sf_dir):
    ids = B.nodes_of(spark, sf_dir, "nation", "supplier").select("id")
    return G.subgraph(_nodes(spark, sf_dir), _edges(spark, sf_dir), ids)[1].select("src", "dst", F.round("weight", 6).alias("weight"))


@query("jn13_subgraph_nodes", f"WITH {B.sql_nodes('nation', 'supplier')} SELECT id, node_type FROM nodes")
def jn13_nodes(spark, sf_dir):
    ids = B.nodes_of(spark, sf_dir, "nation", "supplier").select("id")
    return G.subgraph(_nodes(spark, sf_dir), _edges(spark, sf_dir), ids)[0].select("id", "node_type")


def _review_sql(ids: str) -> str:
    return f"""WITH ids AS ({ids}), o AS (SELECT doc_id, lead(doc_id) OVER (ORDER BY md5(doc_id || ':7'), doc_id) AS next FROM ids)
SELECT least(doc_id, next) AS doc1_id, greatest(doc_id, next) AS doc2_id FROM o WHERE next IS NOT NULL"""


@query("jn14_review_pairs_all", _review_sql("SELECT 'n' || lpad(n_nationkey::VARCHAR, 3, '0') AS doc_id FROM nation"))
def jn14(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("doc_id"))
    return G.review_pairs(n)


@query("top5_sampled_pairs", _review_sql("SELECT 'doc_' || doc_id AS doc_id FROM documents"))
def top5(spark, sf_dir):
    return G.review_pairs(B.documents(spark, sf_dir))


@query("prj13_node_presentation", """SELECT 'customer_' || c_custkey AS id, 'ID: customer_' || c_custkey || '<br>Type: ' || CASE c_nationkey % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'field' ELSE 'customer' END
  || '<br>rank: ' || c_nationkey || '<br>segment: ' || c_mktsegment AS hover, CASE c_nationkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' ELSE 'gray' END AS colour, c_nationkey * 20.0::DOUBLE AS size FROM customer""")
def prj13_nodes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_nationkey") % 3 == 0, "document").when(F.col("c_nationkey") % 3 == 1, "field").otherwise("customer")
    nodes = c.select(F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("id"), kind.alias("node_type"),
                     F.create_map(F.lit("rank"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment")).alias("attrs"))
    return G.node_presentation(nodes, "rank")


@query("prj13_edge_presentation", f"WITH {B.SUPPLY} SELECT src, dst, src || ' --[supplies(' || printf('%.2f', weight) || ')]--> ' || dst AS label FROM supply")
def prj13_edges(spark, sf_dir):
    return G.edge_presentation(B.supply_edges(spark, sf_dir))


def _path_edges(spark, sf_dir):
    """Places, orders of customers, and the parts of orders and suppliers."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")

    def edge(df, a, ka, b, kb):
        return df.select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("src"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("dst"))

    return B.place_edges(spark, sf_dir).select("src", "dst").unionByName(edge(o, "customer_", "o_custkey", "order_", "o_orderkey")).unionByName(
        edge(line, "order_", "l_orderkey", "part_", "l_partkey")).unionByName(B.supply_edges(spark, sf_dir).select("src", "dst"))


@query("gr3_simple_paths", f"""WITH RECURSIVE {B.PLACE}, e AS (SELECT src, dst FROM place UNION SELECT 'customer_' || o_custkey, 'order_' || o_orderkey FROM orders
  UNION SELECT 'order_' || l_orderkey, 'part_' || l_partkey FROM lineitem UNION SELECT 'supplier_' || l_suppkey, 'part_' || l_partkey FROM lineitem),
  u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
  w(here, path, hops) AS (SELECT 'customer_0', ['customer_0'], 0 UNION ALL SELECT b, list_append(path, b), hops + 1 FROM w JOIN u ON a = here WHERE hops < 4 AND here <> 'supplier_0' AND NOT list_contains(path, b))
SELECT array_to_string(path, '>') AS path, hops FROM w WHERE here = 'supplier_0'""")
def gr3(spark, sf_dir):
    found = GA.simple_paths(_path_edges(spark, sf_dir), "customer_0", "supplier_0", 4)
    return found.select(F.array_join("path", ">").alias("path"), "hops")


def _clustered(spark, sf_dir):
    """Customers and suppliers in nations, and nations in regions."""
    return B.nodes_of(spark, sf_dir, "customer", "supplier", "nation", "region"), B.place_edges(spark, sf_dir)


# the graph of _clustered is a tree, where a stable labelling is checked by its defining property: per node, no label is more frequent around it
@query("gr4_label_propagation", f"WITH {B.sql_nodes('customer', 'supplier', 'nation', 'region')} SELECT id, true AS is_stable FROM nodes")
def gr4(spark, sf_dir):
    nodes, edges = _clustered(spark, sf_dir)
    found = materialise(GA.label_propagation(nodes, edges), "labels")
    around = GA.both_ways(edges.where("src <> dst")).distinct().join(found.select(F.col("id").alias("b"), F.col("community").alias("label")), "b")
    votes = around.groupBy(F.col("a").alias("id"), "label").agg(F.count("*").alias("n"))
    best = votes.join(found, "id").groupBy("id").agg(F.max("n").alias("most"), F.max(F.when(F.col("label") == F.col("community"), F.col("n"))).alias("own"))
    return found.join(best, "id", "left").select("id", (F.col("most").isNull() | (F.col("own") == F.col("most"))).alias("is_stable"))


# any good partition is valid: every node is placed once, and modularity is not below that of the regions (the graph's components)
@query("gr5_louvain", f"WITH {B.sql_nodes('customer', 'supplier', 'nation', 'region')} SELECT count(*) AS nodes, true AS placed_once, true AS as_good_as_components FROM nodes")
def gr5(spark, sf_dir):
    nodes, edges = _clustered(spark, sf_dir)
    found = materialise(GA.louvain(nodes, edges), "communities")
    whole = GA.components(nodes, edges).withColumnRenamed("component", "community")
    good = GA.modularity(edges, found) >= GA.modularity(edges, whole) - 1e-9
    return found.agg(F.count("*").alias("nodes"), (F.count("*") == F.count_distinct("id")).alias("placed_once"), F.lit(good).alias("as_good_as_components"))


@query("gr6_degree_centrality", f"""WITH {NODES}, {EDGES}, g AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)
SELECT n.id, coalesce(degree, 0) AS degree, round(coalesce(degree, 0) / ((SELECT count(*) FROM nodes) - 1.0::DOUBLE), 6) AS score FROM nodes n LEFT JOIN g ON g.id = n.id""")
def gr6(spark, sf_dir):
    return GA.degree_centrality(_nodes(spark, sf_dir), _edges(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("top2_central_nodes", f"""WITH {NODES}, {EDGES}, g AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)
SELECT n.id, round(degree / ((SELECT count(*) FROM nodes) - 1.0::DOUBLE), 6) AS score FROM nodes n JOIN g ON g.id = n.id ORDER BY degree DESC, n.id LIMIT 10""")
def top2(spark, sf_dir):
    return GA.central_nodes(_nodes(spark, sf_dir), _edges(spark, sf_dir), "degree", 10).select("id", F.round("score", 6).alias("score"))


@query("gr7_components", """WITH m AS (SELECT 'customer_' || c_custkey AS id, c_nationkey AS n FROM customer UNION ALL SELECT 'supplier_' || s_suppkey, s_nationkey FROM supplier UNION ALL SELECT 'nation_' || n_nationkey, n_nationkey FROM nation)
SELECT id, min(id) OVER (PARTITION BY n) AS component FROM m""")
def gr7(spark, sf_dir):
    return GA.components(B.nodes_of(spark, sf_dir, "customer", "supplier", "nation"), B.place_edges(spark, sf_dir, regions=False))


ROUNDS = 8


def _pagerank_sql() -> str:
    steps = [f"WITH {NODES}, {EDGES}, total AS (SELECT count(*)::DOUBLE AS n FROM nodes), out_w AS (SELECT src, sum(weight) AS w FROM edges GROUP BY src HAVING sum(weight) > 0)",
             "share AS (SELECT e.src, e.dst, e.weight / o.w AS s FROM edges e JOIN out_w o ON o.src = e.src)", "r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM nodes, total)"]
    for i in range(1, ROUNDS + 1):
        steps.append(f"d{i} AS (SELECT coalesce(sum(r), 0) AS d FROM r{i - 1} WHERE id NOT IN (SELECT src FROM out_w))")
        steps.append(f"f{i} AS (SELECT dst, sum(s * r) AS f FROM share JOIN r{i - 1} ON id = src GROUP BY dst)")
        steps.append(f"r{i} AS MATERIALIZED (SELECT id, 0.15::DOUBLE / n + 0.85::DOUBLE * d / n + 0.85::DOUBLE * coalesce(f, 0) AS r FROM r{i - 1} LEFT JOIN f{i} ON dst = id, total, d{i})")
    return ", ".join(steps) + f" SELECT id, round(r, 8) AS score FROM r{ROUNDS}"


@query("gr8_pagerank", _pagerank_sql())
def gr8(spark, sf_dir):
    return GA.pagerank(_nodes(spark, sf_dir), _edges(spark, sf_dir), iterations=ROUNDS).withColumn("score", F.round("score", 8))


@query("gr9_betweenness", f"""WITH {B.sql_nodes('customer', 'supplier', 'nation', 'region')}, n AS (SELECT count(*)::DOUBLE AS n FROM nodes),
  held AS (SELECT 'nation_' || k AS id, count(*)::DOUBLE AS members FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k)
SELECT nodes.id, round(coalesce(members, 0) / ((n - 1) * (n - 2)), 10) AS score FROM nodes LEFT JOIN held ON held.id = nodes.id, n""")
def gr9(spark, sf_dir):
    """Each member of a nation reaches that nation's region through it, and nothing else lies between."""
    nodes = B.nodes_of(spark, sf_dir, "customer", "supplier", "nation", "region")
    return GA.betweenness(nodes, B.place_edges(spark, sf_dir)).withColumn("score", F.round("score", 10))


def _built(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("doc_"), F.lpad(F.col("vec_id").cast("string"), 19, "0")).alias("id"), "embedding", "label")
    docs = B.documents(spark, sf_dir).withColumn("doc_id", F.concat(F.lit("doc_"), F.lpad(F.col("row_number").cast("string"), 19, "0")))
    n = F.col("row_number")
    docs = docs.withColumn("parent_document", F.when(n % 10 != 0, F.concat(F.lit("doc_"), F.lpad((n - n % 10).cast("string"), 19, "0"))))
    fields = v.select(F.concat(F.lit("sheet_"), F.col("label").cast("string")).alias("source_file"), F.col("id").alias("field"), "embedding")
    mapping_nodes, mapping_edges = mapping_graph(B.mappings(spark, sf_dir))
    said = docs.where(n % 10 == 5).select(F.col("doc_id").alias("src"), F.concat(F.lit("doc_"), F.lpad((n + 1).cast("string"), 19, "0")).alias("dst"),
                                          F.lit("ai_conceptual").alias("relationship_type"), F.lit(0.75).alias("weight"))
    return build_graph(docs, v.select("id", "embedding"), 0.35, mapping_nodes, mapping_edges, fields, said, every_pair=True)


BUILT = f"""WITH {B.D}, {B.ME}, {B.C}, sem AS (SELECT a.id, b.id AS ib, list_cosine_similarity(a.e, b.e) AS w FROM c a JOIN c b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.35),
  fld AS (SELECT a.id, b.id AS ib, list_cosine_similarity(a.e, b.e) AS w FROM c a JOIN c b ON a.id < b.id AND a.label = b.label WHERE list_cosine_similarity(a.e, b.e) >= 0.35),
  pairs AS (SELECT 'd' || id AS x, 'd' || ib AS y, 'semantic_similarity' AS t, w, 1 AS step FROM sem
    UNION ALL SELECT 'd' || (n - n % 10), 'd' || n, 'contains', 1.0, 2 FROM d WHERE n % 10 <> 0
    UNION ALL SELECT 's' || source_file, 'd' || n, 'source_of', 1.0, 3 FROM d WHERE source_file IN (SELECT source_file FROM d GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'f' || id, 'f' || ib, 'field_similarity', w, 4 FROM fld
    UNION ALL SELECT src, dst, 'data_mapping', 1.0, 5 FROM me GROUP BY src, dst UNION ALL SELECT doc_id, src, 'defines_source', 1.0, 5 FROM me UNION ALL SELECT doc_id, dst, 'defines_target', 1.0, 5 FROM me
    UNION ALL SELECT 'd' || n, 'd' || (n + 1), 'ai_conceptual', 0.75, 6 FROM d WHERE n % 10 = 5 AND n + 1 IN (SELECT n FROM d)),
  single AS (SELECT x, y, arg_max(t, step) AS t, arg_max(w, step) AS w FROM pairs GROUP BY x, y)"""


@query("gr11_graph_build", f"{BUILT} SELECT t AS relationship_type, count(*) AS edges, round(sum(w), 4) AS weight FROM single GROUP BY t")
def gr11(spark, sf_dir):
    _, edges, _ = _built(spark, sf_dir)
    return edges.groupBy("relationship_type").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 4).alias("weight"))


@query("gr11_graph_report", f"""{BUILT} SELECT count(*) FILTER (t = 'data_mapping') AS mapping_relationships, count(*) FILTER (t = 'semantic_similarity') AS semantic_relationships,
  count(*) FILTER (t = 'field_similarity') AS field_relationships, count(*) FILTER (t IN ('data_mapping', 'semantic_similarity', 'field_similarity')) AS total_relationships FROM pairs""")
def gr11_report(spark, sf_dir):
    return _built(spark, sf_dir)[2]
