"""Search hits to context: neighbours of the hits, context text, lineage report."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.text import fixed, preview
from fieldloom.operators.graph import both_ways
from fieldloom.operators.mapping import field_lineage, mapping_relationships


def graph_context(hits: DataFrame, edges: DataFrame, documents: DataFrame, top=3, per_hit=5, chars=300) -> DataFrame:
    """Neighbours of the best hits (query_id, rank, id) that exist as documents.

    The cap of ``per_hit`` neighbours (smallest ids) comes first and the document test second.
    ``row_number <= n`` is cut per task before the shuffle, so a hub's neighbours are never gathered.
    """
    best = hits.where(F.col("rank") <= top).select("query_id", "rank", F.col("id").alias("hit"))
    around = both_ways(edges).join(best, F.col("a") == F.col("hit")).select(
        "query_id", "rank", "hit", F.col("b").alias("id")).distinct()
    order = Window.partitionBy("query_id", "hit").orderBy("id")
    capped = around.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_hit)
    known = documents.select(F.col("doc_id").alias("id"), "type", "source_file", preview(F.col("content"), chars).alias("content"))
    return capped.join(known, "id").withColumn("relationship", F.lit("related_to"))


def context_text(hits: DataFrame, related: DataFrame, chars=1000) -> DataFrame:
    """Context per query: each hit's header and text in rank order, then the related documents."""
    found = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(
        F.format_string("\n--- Document %s (similarity: %s) ---\n", F.col("id").cast("string"), fixed(F.col("similarity"), 3)),
        preview(F.col("document"), chars)).alias("text")))).alias("h"))
    around = related.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "n", F.concat(F.lit("\n"), "content", F.lit("\n")).alias("text")))).alias("r"))
    # both lists are short by construction: n hits, and at most top x per_hit related documents
    tail = F.when(F.col("r").isNotNull(), F.concat(
        F.lit("\n\n--- Related Documents from Graph ---\n"),
        F.array_join(F.transform("r", lambda x: x["text"]), ""))).otherwise("")
    body = F.concat(F.array_join(F.transform("h", lambda x: x["text"]), ""), tail)
    return found.join(around, "query_id", "left").select("query_id", body.alias("context")).withColumn(
        "context_length", F.length("context"))


def mapping_context(hits: DataFrame, mappings: DataFrame, documents_shown=3, mappings_shown=5) -> DataFrame:
    """Mapping documents among the hits, then lines for the first mappings, as one context text."""
    kept = hits.where(F.element_at("metadata", F.lit("_mapping_type")) == "data_mapping").orderBy("rank").limit(documents_shown)
    docs = kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document"))),
                                             lambda r: r["document"]), "\n").alias("docs"), F.count("*").alias("mapping_docs"))
    lines = mappings.orderBy("src", "dst").limit(mappings_shown).select("src", "dst", F.format_string(
        "Mapping: %s.%s → %s (Transformation: %s)", "source_table", "source_column", "target_field", "transformation_rule").alias("line"))
    listed = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", "line"))),
                                                lambda r: r["line"]), "\n").alias("lines"), F.count("*").alias("mappings_shown"))
    blank = {"docs": "string", "mapping_docs": "bigint", "lines": "string", "mappings_shown": "bigint"}
    wide = [df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in blank.items()]) for df in (docs, listed)]
    # two one-row tables become one row; max skips the blanks
    joined = wide[0].unionByName(wide[1]).agg(*[F.max(c).alias(c) for c in blank])
    return joined.select("mapping_docs", "mappings_shown", F.concat("docs", F.when(
        F.col("mappings_shown") > 0, F.concat(F.lit("\n\nData Mappings:\n"), "lines")).otherwise("")).alias("context"))


def lineage_totals(lineage: DataFrame) -> DataFrame:
    return lineage.agg(F.count_if(F.col("direction") == "upstream").alias("total_upstream"),
                       F.count_if(F.col("direction") == "downstream").alias("total_downstream"))


def lineage_report(edges: DataFrame, hits: DataFrame, field: str) -> DataFrame:
    """Tagged rows: upstream and downstream, the field's mappings, and related documents."""
    low = field.lower()
    touching = mapping_relationships(edges).where(
        F.contains(F.lower("target_field"), F.lit(low)) | F.contains(F.lower("source_column"), F.lit(low)))
    sides = field_lineage(edges, field).select(
        F.col("direction").alias("section"), F.col("field").alias("item"), F.col("transformation").alias("detail"),
        F.lit(None).cast("double").alias("score"))
    listed = touching.select(F.lit("mapping").alias("section"), F.concat("src", F.lit(" -> "), "dst").alias("item"),
                             F.col("transformation_rule").alias("detail"), F.col("weight").alias("score"))
    related = hits.select(F.lit("related_document").alias("section"), F.col("id").cast("string").alias("item"),
                          F.lit("").alias("detail"), F.col("similarity").alias("score"))
    return sides.unionByName(listed).unionByName(related)
