"""The corpus pipeline over ``documents``: each stage is a Spark job whose result is written as Parquet and read again by the next.

1. quality classifier: rejected documents go
2. line dedup: lines that match an earlier one are taken out of the texts; rows stay
3. MinHash near-dedup: one document of each group of near copies stays
4. PII: spans are masked in the texts
5. best-fit packing: the remaining texts as token pieces placed in sequences

No stage is plain SQL as a whole (models, similarity joins, tokens), so ``ORACLE_SQL`` is None; the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import line_dedup, order_minhash, packing, pii, quality_classifier
from fieldloom.llm.queries import table, tokenizer_path
from fieldloom.session import ensure_scratch, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_scratch(spark)
    return line_dedup.without_repeats(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_scratch(spark)
    return order_minhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_scratch(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_copies), ("PII", personal_data), ("best-fit packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
