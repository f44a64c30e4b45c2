"""Queries over model replies held in tables."""

from pyspark.sql import functions as F

from fieldloom.operators import graph as G
from fieldloom.operators import responses as MR
from fieldloom.operators.build import corpus_report
from fieldloom.operators.embedding import fit_text_vectors
from fieldloom.plans import bindings as B
from fieldloom.plans.registry import query, table


def _doc(n):
    return F.concat(F.lit("doc_"), n.cast("string"))


def _relation_replies(spark, sf_dir):
    """Array replies: one relation per event between two numbered documents, fields missing at times."""
    n = F.col("event_id")
    one = F.struct(
        _doc(F.col("user_id")).alias("source_doc"), F.when(n % 13 != 0, _doc(n % 2000)).alias("target_doc"),
        F.when(n % 3 != 0, F.col("event_type")).alias("relationship_type"), F.when(n % 4 != 0, F.lit("feeds")).alias("relationship_name"),
        F.when(n % 5 != 0, (n % 100) / F.lit(100.0)).alias("strength"), F.concat(F.lit("e\"x"), n.cast("string")).alias("explanation"))
    good = F.to_json(F.array(one))
    return table(spark, sf_dir, "events").select("event_id", F.when(n % 17 == 0, "[broken").otherwise(good).alias("response"))


RELATIONS = """r AS (SELECT 'doc_' || user_id AS src, 'doc_' || (event_id % 2000) AS dst, 'ai_' || CASE WHEN event_id % 3 <> 0 THEN event_type ELSE 'semantic' END AS relationship_type,
  CASE WHEN event_id % 5 <> 0 THEN (event_id % 100) / 100.0::DOUBLE ELSE 0.5::DOUBLE END AS weight, CASE WHEN event_id % 4 <> 0 THEN 'feeds' ELSE 'related_to' END AS relationship_name,
  'e"x' || event_id AS explanation FROM events WHERE event_id % 17 <> 0 AND event_id % 13 <> 0)"""


@query("llm1_relation_edges", f"WITH {RELATIONS} SELECT * FROM r")
def llm1(spark, sf_dir):
    return MR.relation_edges(_relation_replies(spark, sf_dir))


@query("llm1_reply_errors", f"""WITH {RELATIONS} SELECT event_id, 'does not parse' AS reason, '[broken' AS text FROM events WHERE event_id % 17 = 0
UNION ALL SELECT event_id, 'document missing', NULL FROM events WHERE event_id % 17 <> 0 AND event_id % 13 = 0
UNION ALL SELECT -1, 'replies without edge or error', CAST((SELECT count(*) FROM events) - (SELECT count(*) FROM r) - (SELECT count(*) FROM events WHERE event_id % 17 = 0 OR event_id % 13 = 0) AS VARCHAR)""")
def llm1_errors(spark, sf_dir):
    """The replies without an edge; every reply is an edge or an error (each holds one relation)."""
    replies = _relation_replies(spark, sf_dir)
    errors = MR.relation_errors(replies)
    lost = replies.select(F.lit(1).alias("n")).unionByName(MR.relation_edges(replies).select(F.lit(-1).alias("n"))).unionByName(errors.select(F.lit(-1).alias("n"))).agg(F.sum("n").alias("n"))
    text = F.when(F.col("reason") != "document missing", F.col("text"))
    return errors.withColumn("text", text).unionByName(lost.select(F.lit(-1).cast("bigint").alias("event_id"), F.lit("replies without edge or error").alias("reason"), F.col("n").cast("string").alias("text")))


@query("llm1_review_errors", """SELECT 'doc_' || user_id AS doc_id, 'doc_' || event_id AS other_id, CASE event_id % 5 WHEN 1 THEN 'does not parse' ELSE 'no reply' END AS reason,
  CASE event_id % 5 WHEN 1 THEN '{not json}' END AS text FROM events WHERE event_id % 5 IN (1, 2)""")
def llm1_review_errors(spark, sf_dir):
    return MR.review_errors(_reviews(spark, sf_dir))


@query("llm3_suggestion_errors", "SELECT p_partkey, 'no JSON' AS reason, 'no mapping' AS text FROM part WHERE p_size % 5 = 0")
def llm3_errors(spark, sf_dir):
    return MR.suggestion_errors(_suggestion_replies(spark, sf_dir))


@query("jn12_known_relations", f"WITH {RELATIONS}, {B.D} SELECT src, dst, relationship_type, explanation FROM r WHERE src IN (SELECT doc_id FROM d) AND dst IN (SELECT doc_id FROM d)")
def jn12(spark, sf_dir):
    edges = MR.relation_edges(_relation_replies(spark, sf_dir)).select("src", "dst", "relationship_type", "explanation")
    return G.between_documents(edges, B.documents(spark, sf_dir))


def _pair_replies(spark, sf_dir):
    n = F.col("event_id")
    body = F.to_json(F.struct(
        (n % 2 == 0).alias("has_relationship"), F.when(n % 3 != 0, F.col("event_type")).alias("relationship_type"),
        ((n % 100) / F.lit(100.0)).alias("confidence"), F.concat(F.lit("because "), n.cast("string")).alias("explanation")))
    reply = F.when(n % 7 == 0, "nothing found").when(n % 11 == 0, F.concat(F.lit("{oops "), body)).otherwise(F.concat(F.lit("Here it is:\n"), body, F.lit("\nThanks")))
    return table(spark, sf_dir, "events").select(_doc(F.col("user_id")).alias("src"), _doc(n).alias("dst"), reply.alias("response"))


@query("flt9_accepted_pairs", """SELECT 'doc_' || user_id AS src, 'doc_' || event_id AS dst, 'ai_' || CASE WHEN event_id % 3 <> 0 THEN event_type ELSE 'unknown' END AS relationship_type,
  (event_id % 100) / 100.0::DOUBLE AS weight, 'because ' || event_id AS explanation FROM events WHERE event_id % 2 = 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 100 > 60""")
def flt9(spark, sf_dir):
    return MR.accepted_pairs(_pair_replies(spark, sf_dir))


def _reviews(spark, sf_dir):
    n = F.col("event_id")
    body = F.to_json(F.struct(F.col("event_type").alias("relationship_type"), ((n % 10) / F.lit(10.0)).alias("strength"),
                              F.lit("d").alias("description"), F.array("event_type", F.lit("x")).alias("key_connections")))
    reply = (F.when(n % 5 == 0, F.concat(F.lit("plain words "), n.cast("string"))).when(n % 5 == 1, F.lit("{not json}"))
             .when(n % 5 == 2, F.lit(None).cast("string")).otherwise(F.concat(F.lit("ok "), body)))
    return table(spark, sf_dir, "events").select(_doc(F.col("user_id")).alias("doc_id"), _doc(n).alias("other_id"), reply.alias("response"))


@query("llm1_pair_reviews", """SELECT 'doc_' || user_id AS doc_id, 'doc_' || event_id AS other_id, CASE event_id % 5 WHEN 0 THEN 'unknown' ELSE event_type END AS relationship_type,
  CASE event_id % 5 WHEN 0 THEN 0.5::DOUBLE ELSE (event_id % 10) / 10.0::DOUBLE END AS strength, CASE event_id % 5 WHEN 0 THEN 'plain words ' || event_id ELSE 'd' END AS description,
  CASE event_id % 5 WHEN 0 THEN '' ELSE event_type || '|x' END AS key_connections FROM events WHERE event_id % 5 IN (0, 3, 4)""")
def llm1_reviews(spark, sf_dir):
    return MR.pair_reviews(_reviews(spark, sf_dir)).withColumn("key_connections", F.array_join("key_connections", "|"))


@query("llm2_page_metadata", f"""WITH {B.PA} SELECT page_number, CASE WHEN page_number % 3 = 0 THEN 'table_definition' ELSE kind END AS content_type, CASE WHEN page_number % 3 = 0 THEN 'CLAIMS' ELSE area END AS functional_area,
  CASE WHEN page_number % 3 = 0 THEN 'F' || page_number ELSE array_to_string(names, '|') END AS fields, CASE WHEN page_number % 3 = 0 THEN 'llm_powered' ELSE 'pattern_based' END AS analysis_method FROM pd""")
def llm2(spark, sf_dir):
    n = F.col("page_number")
    field = F.struct(F.concat(F.lit("F"), n.cast("string")).alias("field_name"), F.lit("INT").alias("data_type"))
    body = F.to_json(F.struct(F.lit("table_definition").alias("content_type"), F.lit("CLAIMS").alias("functional_area"), F.array(field).alias("fields"),
                              F.lit("s").alias("summary")))
    reply = F.when(n % 3 == 0, F.concat(F.lit("Result "), body)).when(n % 3 == 1, "{bad json}")
    made = MR.page_metadata(B.dictionary_pages(spark, sf_dir).withColumn("response", reply))
    return made.select("page_number", "page.content_type", "page.functional_area", F.array_join(F.col("page.fields.field_name"), "|").alias("fields"), "page.analysis_method")


@query("llm3_mapping_suggestions", """SELECT p_partkey, p_name AS source_field, CASE WHEN p_size % 2 = 0 THEN p_type END AS target_field FROM part WHERE p_size % 5 <> 0
UNION ALL SELECT p_partkey, 'fixed', 'x' FROM part WHERE p_size % 5 <> 0""")
def llm3(spark, sf_dir):
    return MR.mapping_suggestions(_suggestion_replies(spark, sf_dir))


def _suggestion_replies(spark, sf_dir):
    size = F.col("p_size")
    target = F.when(size % 2 == 0, F.concat(F.lit('"'), "p_type", F.lit('"'))).otherwise("null")
    reply = F.when(size % 5 == 0, "no mapping").otherwise(F.concat(F.lit('Mapping: {"'), "p_name", F.lit('": '), target, F.lit(', "fixed": "x"}.')))
    return table(spark, sf_dir, "part").select("p_partkey", reply.alias("response"))


@query("llm4_corpus_report", """WITH d AS (SELECT 'doc_' || doc_id AS doc_id, doc_id AS n, text, lang FROM documents)
SELECT 'embedding' AS section, doc_id, NULL AS other_id, '32' AS value FROM d WHERE trim(text, ' ' || chr(10)) <> ''
UNION ALL SELECT 'relationship', 'doc_' || user_id, 'doc_' || event_id, CASE event_id % 5 WHEN 0 THEN 'unknown' ELSE event_type END FROM events WHERE event_id % 5 IN (0, 3, 4)
UNION ALL SELECT 'summary', doc_id, NULL, 'about ' || lang FROM d WHERE length(text) > 100
UNION ALL SELECT 'entity', doc_id, NULL, unnest([lang, 'e' || n]) FROM d WHERE length(text) > 100""")
def llm4(spark, sf_dir):
    docs = B.documents(spark, sf_dir)
    text = docs.select(F.col("doc_id").alias("id"), "content")
    lang = F.col("metadata")["lang"]
    summaries = docs.select("doc_id", F.concat(F.lit("about "), lang).alias("response"))
    entities = docs.select("doc_id", F.concat(lang, F.lit(", ,  e"), F.col("row_number").cast("string"), F.lit(" ,")).alias("response"))
    return corpus_report(docs, fit_text_vectors(text, 32)(text), _reviews(spark, sf_dir), summaries, entities)
