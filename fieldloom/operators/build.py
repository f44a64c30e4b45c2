"""The full relationship graph, and the corpus report over documents and replies."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom import constants as K
from fieldloom.functions.text import entity_list
from fieldloom.operators import graph as G
from fieldloom.operators.documents import document_nodes, long_texts
from fieldloom.operators.responses import pair_reviews
from fieldloom.operators.similarity import copy_edges, every_similar_pair, field_similarities, similar_pairs
from fieldloom.session import materialise, spread


def build_graph(documents: DataFrame, vectors: DataFrame, threshold=K.CONTENT_SIMILARITY, mapping_nodes=None,
                mapping_edges=None, fields=None, model_edges=None, every_pair=False):
    """Nodes, optimised edges and the per-type breakdown of a document table.

    ``vectors``: id, embedding of documents. ``fields``: source_file, field, embedding of CSV
    columns. ``mapping_*``: node and edge versions of mapping rows. ``model_edges``: accepted
    relations between documents (src, dst, relationship_type, weight).

    ``every_pair``: all pairs of documents and of fields that reach the threshold; without it, those
    that share one vector are joined through the first of them.
    """
    base = document_nodes(documents).withColumn("seq", F.col("id"))
    if every_pair:
        similar = every_similar_pair(vectors, threshold)
    else:
        pairs, copies = similar_pairs(vectors, threshold)
        similar = pairs.unionByName(copy_edges(copies))
    plain = ["src", "dst", "relationship_type", "weight"]
    edges = [G.similarity_edges(similar).select(*plain), G.contains_edges(documents).select(*plain)]
    source_nodes, source_of = G.source_edges(documents)
    edges.append(source_of.select(*plain))
    nodes = [base.select("id", "node_type", "attrs"), source_nodes]
    if fields is not None:
        if every_pair:
            both = field_similarities(fields, threshold, every_similar_pair)
        else:
            field_pairs, field_copies = field_similarities(fields, threshold)
            both = field_pairs.unionByName(copy_edges(field_copies, ["source_file"]))
        a, b = G.field_node_id(F.col("source_file"), F.col("id_a")), G.field_node_id(F.col("source_file"), F.col("id_b"))
        found = materialise(both.select(a.alias("src"), b.alias("dst"), "source_file", "id_a", "id_b", "similarity"), "fields")
        edges.append(found.select("src", "dst", F.lit("field_similarity").alias("relationship_type"), F.col("similarity").alias("weight")))
        nodes.append(found.select(F.inline(F.array(
            F.struct(F.col("src").alias("id"), F.col("id_a").alias("field")),
            F.struct(F.col("dst").alias("id"), F.col("id_b").alias("field")))), "source_file").distinct().select(
            "id", F.lit("field").alias("node_type"),
            F.create_map(F.lit("field_name"), "field", F.lit("source_file"), "source_file").alias("attrs")))
    if mapping_edges is not None:
        nodes.append(G.upsert_nodes(mapping_nodes))
        edges.append(G.upsert_edges(mapping_edges).select(*plain))
    if model_edges is not None:
        edges.append(G.between_documents(model_edges, documents).select(*plain))
    # an ordered pair has one edge; the step that comes later in the list above wins
    listed = None
    for at, one in enumerate(edges):
        one = one.withColumn("_at", F.lit(at))
        listed = one if listed is None else listed.unionByName(one)
    # stored, so that its size is known: the planner's guess for the joins above is their product; then dealt to parts of bounded size
    listed = materialise(listed, "listed")
    single = spread(listed, G.EDGE_BYTES, "src", "dst").groupBy("src", "dst").agg(F.max_by(
        F.struct("relationship_type", "weight"), F.struct("_at", "weight", "relationship_type")).alias("e")).select("src", "dst", "e.*")
    kept = materialise(G.optimise(single), "edges")
    all_nodes = nodes[0]
    for other in nodes[1:]:
        all_nodes = all_nodes.unionByName(other)
    full = G.complete_nodes(all_nodes, kept)
    return full, kept, G.relationship_breakdown(listed)


def corpus_report(documents: DataFrame, embedded: DataFrame, reviews: DataFrame, summaries: DataFrame, entities: DataFrame) -> DataFrame:
    """Tagged rows (section, doc_id, other_id, value): vectors, pair relations, summaries and entities.

    ``reviews``: doc_id, other_id, response. ``summaries`` and ``entities``: doc_id, response, used
    for long texts only.
    """
    none = F.lit(None).cast("string")
    long_ids = long_texts(documents).select("doc_id")
    parts = [
        embedded.where("embedding is not null").select(
            F.lit("embedding").alias("section"), F.col("id").alias("doc_id"), none.alias("other_id"),
            F.size("embedding").cast("string").alias("value")),
        pair_reviews(reviews).select(F.lit("relationship").alias("section"), "doc_id", "other_id", F.col("relationship_type").alias("value")),
        summaries.join(long_ids, "doc_id", "left_semi").where("response <> ''").select(
            F.lit("summary").alias("section"), "doc_id", none.alias("other_id"), F.col("response").alias("value")),
        entities.join(long_ids, "doc_id", "left_semi").select(
            F.lit("entity").alias("section"), "doc_id", none.alias("other_id"), F.explode(entity_list(F.col("response"))).alias("value")),
    ]
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out
