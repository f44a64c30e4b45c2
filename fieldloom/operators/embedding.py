"""Text to vectors by hashed term weights, and the load report."""

from pyspark.ml.feature import HashingTF, IDF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import is_blank
from fieldloom.session import spread


def fit_text_vectors(documents: DataFrame, dim: int = 256):
    """A function that embeds text frames (id, content) with the corpus' term weights.

    Counting terms is per row and the corpus weights are one tree-aggregated vector of ``dim``
    numbers, so nothing is shuffled. Blank text yields a NULL vector.
    """
    counts = HashingTF(numFeatures=dim, inputCol="_tokens", outputCol="_tf")

    def tokens(df):
        words = F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
        return df.withColumn("_tokens", F.coalesce(words, F.expr("cast(array() as array<string>)")))

    weights = IDF(inputCol="_tf", outputCol="_idf").fit(counts.transform(tokens(spread(documents.select("content")))))
    unit = Normalizer(inputCol="_idf", outputCol="_unit")

    def embed(df: DataFrame) -> DataFrame:
        made = unit.transform(weights.transform(counts.transform(tokens(spread(df)))))
        vector = vector_to_array("_unit", "float32")
        return made.withColumn("embedding", F.when(~is_blank(F.col("content")), vector)).drop("_tokens", "_tf", "_idf", "_unit")

    return embed


def load_report(embedded: DataFrame) -> DataFrame:
    return embedded.agg(
        F.count("*").alias("total_texts"),
        F.count_if(F.col("embedding").isNotNull()).alias("documents_added"),
        F.count_if(F.col("embedding").isNull()).alias("failed_embeddings"))


def attach_documents(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """Vectors joined with the type, source and metadata of their document."""
    return vectors.join(documents.select(F.col("doc_id").alias("id"), "type", "source_file", "metadata"), "id")
