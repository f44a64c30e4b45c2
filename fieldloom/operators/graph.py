"""Property graph as two tables: nodes(id, node_type, attrs), edges(src, dst, relationship_type, weight, attrs)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import constants as K
from fieldloom.functions.numbering import number_rows
from fieldloom.functions.text import fixed, preview
from fieldloom.session import spread

EDGE_BYTES = 8 << 20  # of edges, as the planner counts them, per task
NO_ATTRS = "cast(map() as map<string,string>)"


def upsert_nodes(versions: DataFrame) -> DataFrame:
    """Merge node versions (id, node_type, attrs, seq): attributes merge, the later value wins.

    Merging goes value by value with ``max_by``, which combines before the shuffle, so a node
    written a billion times is as cheap as any other.
    """
    kinds = versions.groupBy("id").agg(F.max_by("node_type", "seq").alias("node_type"))
    return kinds.join(_merged_attrs(versions, ["id"]), "id", "left").withColumn(
        "attrs", F.coalesce("attrs", F.expr(NO_ATTRS)))


def upsert_edges(versions: DataFrame) -> DataFrame:
    """Merge edge versions (src, dst, .., seq): one edge per ordered pair, later type and weight win."""
    ends = versions.groupBy("src", "dst").agg(
        F.max_by(F.struct("relationship_type", "weight"), "seq").alias("e")).select("src", "dst", "e.*")
    return ends.join(_merged_attrs(versions, ["src", "dst"]), ["src", "dst"], "left").withColumn(
        "attrs", F.coalesce("attrs", F.expr(NO_ATTRS)))


def _merged_attrs(versions, keys):
    values = versions.select(*keys, "seq", F.explode("attrs").alias("k", "v"))
    last = values.groupBy(*keys, "k").agg(F.max_by("v", "seq").alias("v"))
    # one entry per distinct attribute name is left per node or edge
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attrs"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def complete_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes plus an ``unknown`` node for every edge end that has none."""
    missing = endpoints(edges).join(nodes.select("id"), "id", "left_anti").select(
        "id", F.lit("unknown").alias("node_type"), F.expr(NO_ATTRS).alias("attrs"))
    return nodes.select("id", "node_type", "attrs").unionByName(missing)


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count("*").alias("nodes"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationship_type").agg(F.count("*").alias("edges"))


def size_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge totals, average degree 2m/n and density m/(n(n-1)); zeros for an empty graph."""
    both = nodes.select(F.lit(True).alias("is_node")).unionByName(edges.select(F.lit(False).alias("is_node")))
    counts = both.agg(F.count_if("is_node").alias("num_nodes"), F.count_if(~F.col("is_node")).alias("num_edges"))
    size, links = F.col("num_nodes").cast("double"), F.col("num_edges").cast("double")
    return counts.withColumns({
        "average_degree": F.when(size > 0, 2.0 * links / size).otherwise(0.0),
        "density": F.when(size > 1, links / (size * (size - 1.0))).otherwise(0.0)})


def both_ways(edges: DataFrame, *columns) -> DataFrame:
    """Undirected view: each edge once per direction (one scan)."""
    return edges.select(F.inline(F.array(
        F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), *columns),
        F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), *columns))))


def neighbours(edges: DataFrame, ids: DataFrame, relationship_type=None) -> DataFrame:
    """Distinct neighbours (id, neighbour) of the given ids in either direction."""
    kept = edges if relationship_type is None else edges.where(F.col("relationship_type") == relationship_type)
    return both_ways(kept).join(ids.select(F.col("id").alias("a")), "a").select(
        F.col("a").alias("id"), F.col("b").alias("neighbour")).distinct()


def neighbours_of(edges: DataFrame, node_id, relationship_type=None) -> DataFrame:
    """Neighbours of one node: a filtered scan, no join."""
    kept = edges.where((F.col("src") == node_id) | (F.col("dst") == node_id))
    if relationship_type is not None:
        kept = kept.where(F.col("relationship_type") == relationship_type)
    return both_ways(kept).where(F.col("a") == node_id).select(F.col("b").alias("neighbour")).distinct()


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame):
    """Nodes among ``ids`` and the edges between them."""
    wanted = ids.select("id").distinct()
    kept = nodes.join(wanted, "id", "left_semi")
    inside = edges.join(wanted.withColumnRenamed("id", "src"), "src", "left_semi").join(
        wanted.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, inside.select(*edges.columns)


def contains_edges(documents: DataFrame) -> DataFrame:
    """Parent ``contains`` child, for parents that are documents."""
    children = documents.where("parent_document is not null").select(
        F.col("parent_document").alias("src"), F.col("doc_id").alias("dst"))
    parents = documents.select(F.col("doc_id").alias("src"))
    return children.join(parents, "src", "left_semi").select(
        "src", "dst", F.lit("contains").alias("relationship_type"), F.lit(1.0).alias("weight"))


def shared_sources(documents: DataFrame) -> DataFrame:
    """Sources that hold more than one document."""
    return documents.groupBy("source_file").agg(F.count("*").alias("document_count")).where("document_count > 1")


def source_file_id(path) -> Column:
    return F.concat(F.lit("source_"), F.xxhash64(path).cast("string"))


def source_edges(documents: DataFrame):
    """A node per shared source and its ``source_of`` edges."""
    shared = shared_sources(documents)
    nodes = shared.select(
        source_file_id(F.col("source_file")).alias("id"), F.lit("source_file").alias("node_type"),
        F.create_map(F.lit("file_path"), F.col("source_file"),
                     F.lit("document_count"), F.col("document_count").cast("string")).alias("attrs"))
    edges = documents.join(shared.select("source_file"), "source_file", "left_semi").select(
        source_file_id(F.col("source_file")).alias("src"), F.col("doc_id").alias("dst"),
        F.lit("source_of").alias("relationship_type"), F.lit(1.0).alias("weight"))
    return nodes, edges


def consolidate(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair: the strongest (ties: smaller source), with its original count.

    Edges are dealt by pair to parts of bounded size first: texts make the aggregate sort, and Spark would join its small-looking
    shuffle parts to one per core.
    """
    weight = F.coalesce("weight", F.lit(0.0))
    grouped = spread(edges, EDGE_BYTES, F.least("src", "dst"), F.greatest("src", "dst")).groupBy(F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")).agg(
        F.min_by(F.struct("src", "dst", "relationship_type", "weight"), F.struct(-weight, F.col("src"))).alias("e"),
        F.count("*").alias("original_count"))
    return grouped.select("e.*", (F.col("original_count") > 1).alias("consolidated"), "original_count")


def optimise(edges: DataFrame, weakest: float = K.WEAK_EDGE) -> DataFrame:
    """Drop weak edges (no weight counts as 0), then consolidate opposite ones."""
    return consolidate(edges.where(F.coalesce("weight", F.lit(0.0)) >= weakest))


def relationship_breakdown(edges: DataFrame) -> DataFrame:
    kind = F.col("relationship_type")
    counts = edges.agg(
        F.count_if(kind == "data_mapping").alias("mapping_relationships"),
        F.count_if(kind == "semantic_similarity").alias("semantic_relationships"),
        F.count_if(kind == "field_similarity").alias("field_relationships"))
    return counts.withColumn("total_relationships", F.expr(
        "mapping_relationships + semantic_relationships + field_relationships"))


def between_documents(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """Relations (src, dst) whose two ends are documents."""
    ids = documents.select(F.col("doc_id").alias("src"))
    return relations.join(ids, "src", "left_semi").join(
        ids.withColumnRenamed("src", "dst"), "dst", "left_semi").select(*relations.columns)


def node_presentation(nodes: DataFrame, size_attribute=None) -> DataFrame:
    """Hover text, colour by type and size of each node."""
    shown = F.transform(F.map_entries("attrs"), lambda e: F.concat(
        F.lit("<br>"), e["key"], F.lit(": "), preview(F.coalesce(e["value"], F.lit("None")), 50)))
    colour = None
    for kind, value in K.NODE_COLOURS.items():
        colour = (F if colour is None else colour).when(F.col("node_type") == kind, F.lit(value))
    size = F.lit(K.DEFAULT_NODE_SIZE)
    if size_attribute:
        given = F.element_at("attrs", F.lit(size_attribute)).try_cast("double")
        size = F.coalesce(given * K.NODE_SIZE_SCALE, size)
    return nodes.select(
        "id", F.concat(F.lit("ID: "), "id", F.lit("<br>Type: "), F.coalesce("node_type", F.lit("unknown")),
                       F.array_join(shown, "")).alias("hover"),
        colour.otherwise(K.OTHER_COLOUR).alias("colour"), size.alias("size"))


def edge_presentation(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.format_string(
        "%s --[%s(%s)]--> %s", "src", F.coalesce("relationship_type", F.lit("unknown")),
        fixed(F.coalesce("weight", F.lit(1.0)), 2), "dst").alias("label"))


def similarity_edges(pairs: DataFrame, kind="semantic_similarity") -> DataFrame:
    return pairs.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"),
                        F.lit(kind).alias("relationship_type"), F.col("similarity").alias("weight"))


def field_node_id(source_file, field) -> Column:
    return F.concat(F.lit("field_"), source_file, F.lit("_"), field)


def review_pairs(documents: DataFrame, seed: int = 7) -> DataFrame:
    """Pairs of documents to review: in a seeded random order of all ids, every id meets the next.

    So every document is reviewed, the pairs grow with the table, and no product of the table with itself is formed.
    """
    drawn = documents.select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}"))).alias("_draw"))
    placed = number_rows(drawn, ["_draw", "doc_id"], name="_n").select("doc_id", "_n")
    following = placed.select(F.col("doc_id").alias("_next"), (F.col("_n") - 1).alias("_n"))
    return placed.join(following, "_n").select(F.least("doc_id", "_next").alias("doc1_id"), F.greatest("doc_id", "_next").alias("doc2_id"))
