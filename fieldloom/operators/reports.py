"""Status and processing summaries as small tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.collection import collection_stats
from fieldloom.operators.graph import edge_counts, node_counts, size_statistics


def processing_summary(documents: DataFrame) -> DataFrame:
    """Documents of each kind per source file."""
    kinds = ["csv_row", "pdf_page", "pdf_chunk", "python"]
    return documents.groupBy("source_file").agg(
        F.count("*").alias("documents"), *[F.count_if(F.col("type") == k).alias(f"{k}s") for k in kinds])


def rows_per_source(documents: DataFrame) -> DataFrame:
    return documents.where("type = 'csv_row'").groupBy("source_file").agg(F.count("*").alias("rows"))


def system_status(documents: DataFrame, collection: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, name, value) rows over documents, collection and graph."""
    def tagged(section, df):
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns])
        return df.select(F.lit(section).alias("section"), F.inline(pairs))

    parts = [
        tagged("documents", documents.agg(F.count("*").alias("processed_documents"))),
        tagged("collection", collection_stats(collection).select(
            "total_documents", "sample_size", F.size("metadata_keys").alias("metadata_keys"))),
        tagged("graph", size_statistics(nodes, edges)),
        node_counts(nodes).select(F.lit("node_types").alias("section"), F.col("node_type").alias("name"), F.col("nodes").cast("double").alias("value")),
        edge_counts(edges).select(F.lit("edge_types").alias("section"), F.col("relationship_type").alias("name"), F.col("edges").cast("double").alias("value")),
    ]
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out
