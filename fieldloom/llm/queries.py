"""The registered queries of the corpus operators, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import exact_topk, hard_negatives, line_dedup, merkle_manifest, ngram_join, order_minhash, packing, pii, quality_classifier, quality_rules, toxicity, unigram, url_filters
from fieldloom.session import ensure_scratch

QUERIES: dict = {}
CHECKS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file, the same on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_scratch(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


@query
def op10_quality_scores(spark, sf_dir):
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_personal_data(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


CHECKS["op4_personal_data"] = pii.SQL


@query
def op3_packed_pieces(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op5_near_copies(spark, sf_dir):
    return order_minhash.classes(table(spark, sf_dir, "documents"))


@query
def op2_line_repeats(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


@query
def op1_toxicity_scores(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


@query
def op7_sentence_pieces(spark, sf_dir):
    return unigram.round_trips(table(spark, sf_dir, "documents"), unigram.read_vocabulary(tokenizer_path("piece_bpe_32k.model")))


@query
def op6_exact_top_k(spark, sf_dir):
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


CHECKS["op6_exact_top_k"] = exact_topk.SQL


@query
def op9_url_verdicts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge(url_filters.dated(pages), url_filters.listing(pages))


CHECKS["op9_url_verdicts"] = url_filters.SQL


@query
def op12_merkle_manifest(spark, sf_dir):
    return merkle_manifest.tamper_check(table(spark, sf_dir, "documents"))


CHECKS["op12_merkle_manifest"] = merkle_manifest.SQL


@query
def op13_hard_negatives(spark, sf_dir):
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("vec_id") % 50 == 0)


CHECKS["op13_hard_negatives"] = hard_negatives.SQL


@query
def op11_jaccard_components(spark, sf_dir):
    return ngram_join.joined_texts(table(spark, sf_dir, "documents"))


CHECKS["op11_jaccard_components"] = ngram_join.SQL
