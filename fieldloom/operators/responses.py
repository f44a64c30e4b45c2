"""Model replies held in tables: extraction, validation, and the rows they turn into."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import constants as K
from fieldloom.functions.text import filled, is_json, json_span, preview
from fieldloom.operators.chunks import page_analysis

RELATION = ("source_doc string, target_doc string, relationship_type string, relationship_name string, "
            "strength double, explanation string")
PAIR = "has_relationship boolean, relationship_type string, confidence double, explanation string"
REVIEW = "relationship_type string, strength double, description string, key_connections array<string>"
PAGE = ("struct<content_type:string,functional_area:string,table_name:string,"
        "fields:array<struct<field_name:string,data_type:string,description:string,constraints:string>>,"
        "relationships:array<string>,key_concepts:array<string>,summary:string>")


def reply_text(reply) -> Column:
    """Reply text from either service shape, else the plain ``content`` value."""
    return F.coalesce(
        F.get_json_object(reply, "$.choices[0].message.content"),
        F.get_json_object(reply, "$.content[0].text"),
        F.get_json_object(reply, "$.content"))


def relation_edges(responses: DataFrame) -> DataFrame:
    """Array replies to edges; missing type, name or strength take their defaults."""
    rows = responses.select(F.explode(F.from_json("response", f"array<struct<{_struct(RELATION)}>>")).alias("r")).select("r.*")
    return rows.where(filled(F.col("source_doc")) & filled(F.col("target_doc"))).select(
        F.col("source_doc").alias("src"), F.col("target_doc").alias("dst"),
        F.concat(F.lit("ai_"), F.coalesce("relationship_type", F.lit("semantic"))).alias("relationship_type"),
        F.coalesce("strength", F.lit(K.MODEL_STRENGTH)).alias("weight"),
        F.coalesce("relationship_name", F.lit("related_to")).alias("relationship_name"),
        F.coalesce("explanation", F.lit("")).alias("explanation"))


def accepted_pairs(responses: DataFrame, above: float = K.MODEL_CONFIDENCE) -> DataFrame:
    """Pair replies (src, dst, response) that assert a relationship with enough confidence."""
    parsed = responses.withColumn("_r", F.from_json(json_span(F.col("response")), f"struct<{_struct(PAIR)}>"))
    kept = parsed.where(F.col("_r.has_relationship") & (F.col("_r.confidence") > above))
    return kept.select(
        "src", "dst", F.concat(F.lit("ai_"), F.coalesce("_r.relationship_type", F.lit("unknown"))).alias("relationship_type"),
        F.col("_r.confidence").alias("weight"), F.coalesce("_r.explanation", F.lit("")).alias("explanation"))


def pair_reviews(responses: DataFrame) -> DataFrame:
    """Free-form pair replies: the JSON in them, or a stand-in with the reply's first 200 characters.

    A reply with braces that do not parse yields no row here, but one of ``review_errors``.
    """
    span = json_span(F.col("response"))
    parsed = F.from_json(span, f"struct<{_struct(REVIEW)}>")
    plain = F.struct(
        F.lit("unknown").alias("relationship_type"), F.lit(K.MODEL_STRENGTH).alias("strength"),
        preview(F.col("response"), 200).alias("description"),
        F.expr("cast(array() as array<string>)").alias("key_connections"))
    return responses.where(filled(F.col("response"))).withColumn(
        "_r", F.when(span.isNull(), plain).when(is_json(span), parsed)).where("_r is not null").select(
        *[c for c in responses.columns if c != "response"], "_r.*")


def page_metadata(pages: DataFrame) -> DataFrame:
    """Page metadata from replies (source_file, page_number, text, response), by pattern where unusable."""
    span = json_span(F.col("response"))
    parsed = F.when(is_json(span), F.from_json(span, PAGE))
    given = F.struct(
        *[parsed[c].alias(c) for c in ("content_type", "functional_area", "table_name", "fields", "relationships", "key_concepts", "summary")],
        F.lit("llm_powered").alias("analysis_method"), F.col("page_number").cast("int").alias("page_number"))
    return pages.withColumn("page", F.when(parsed.isNotNull(), given).otherwise(
        page_analysis("text", F.col("page_number")))).drop("response")


def mapping_suggestions(responses: DataFrame) -> DataFrame:
    """``{source: target|null}`` replies to rows."""
    parsed = F.from_json(json_span(F.col("response")), "map<string,string>")
    keep = [c for c in responses.columns if c != "response"]
    return responses.select(*keep, F.explode(parsed).alias("source_field", "target_field"))


def _told(responses: DataFrame, reason: Column, text="response") -> DataFrame:
    """The keys of the replies that ``reason`` names, with it and the raw text."""
    keys = [c for c in responses.columns if c != "response" and not c.startswith("_")]
    return responses.select(*keys, reason.alias("reason"), F.col(text).alias("text")).where("reason IS NOT NULL")


def _unread(response, span, parsed=None) -> Column:
    unread = ~is_json(span) if parsed is None else ~is_json(span) | parsed.isNull()
    return (F.when(~F.coalesce(filled(response), F.lit(False)), "no reply").when(span.isNull(), "no JSON").when(unread, "does not parse"))


def relation_errors(responses: DataFrame) -> DataFrame:
    """What ``relation_edges`` gives no edge for: replies that do not parse, and relations that name only one document."""
    parsed = F.from_json("response", f"array<struct<{_struct(RELATION)}>>")
    reason = F.when(~F.coalesce(filled(F.col("response")), F.lit(False)), "no reply").when(~is_json(F.col("response")) | parsed.isNull(), "does not parse")
    keys = [c for c in responses.columns if c != "response"]
    one = responses.select(*keys, F.explode(parsed).alias("_r")).where(~F.coalesce(filled(F.col("_r.source_doc")) & filled(F.col("_r.target_doc")), F.lit(False)))
    return _told(responses, reason).unionByName(one.select(*keys, F.lit("document missing").alias("reason"), F.to_json("_r").alias("text")))


def pair_errors(responses: DataFrame) -> DataFrame:
    """Pair replies that ``accepted_pairs`` cannot read; a reply that denies a relationship is no error."""
    return _told(responses, _unread(F.col("response"), json_span(F.col("response"))))


def review_errors(responses: DataFrame) -> DataFrame:
    """Replies that ``pair_reviews`` gives no row for; plain text has its stand-in there."""
    reason = _unread(F.col("response"), json_span(F.col("response")))
    return _told(responses, F.when(reason != "no JSON", reason))


def suggestion_errors(responses: DataFrame) -> DataFrame:
    """Replies that ``mapping_suggestions`` gives no row for."""
    span = json_span(F.col("response"))
    return _told(responses, _unread(F.col("response"), span, F.from_json(span, "map<string,string>")))


def _struct(ddl: str) -> str:
    """``a string, b double`` to the form used inside ``struct<...>``."""
    return ",".join(":".join(part.strip().split(" ", 1)) for part in ddl.split(", "))
