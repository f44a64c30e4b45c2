"""Prompt and chat-message tables for a model service that runs elsewhere."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import preview

PAGE_CHARS, PAIR_CHARS, REVIEW_CHARS, CONTEXT_CHARS, EMBED_CHARS = 2000, 500, 1000, 3000, 512


def messages(user, system=None) -> Column:
    """Chat messages as JSON: an optional system entry, then the user entry."""
    def entry(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    alone = F.to_json(F.array(entry("user", user)))
    if system is None:
        return alone
    system = F.lit(system) if isinstance(system, str) else system
    return F.when(F.coalesce(system, F.lit("")) == "", alone).otherwise(
        F.to_json(F.array(entry("system", system), entry("user", user))))


def page_prompt(page_number, text) -> Column:
    return F.format_string(
        "Describe page %d of a data dictionary as one JSON object with content_type, functional_area, table_name, "
        "fields, relationships, key_concepts and summary.\n\n%s", page_number, preview(text, PAGE_CHARS))


def pair_prompt(type_a, text_a, type_b, text_b) -> Column:
    return F.format_string(
        "Are these documents related? Reply with one JSON object with has_relationship, relationship_type, "
        "confidence and explanation.\n\nFirst (%s):\n%s\n\nSecond (%s):\n%s",
        F.coalesce(type_a, F.lit("unknown")), preview(text_a, PAIR_CHARS),
        F.coalesce(type_b, F.lit("unknown")), preview(text_b, PAIR_CHARS))


def mapping_prompt(fields, target) -> Column:
    return F.format_string(
        "Map each source field to a target field, or null, as one JSON object.\n\nSource fields:\n%s\n\nTarget schema:\n%s",
        F.array_join(fields, ", "), target)


def answer_prompt(question, context) -> Column:
    return F.format_string("Answer from the context.\n\nContext:\n%s\n\nQuestion:\n%s", preview(context, CONTEXT_CHARS), question)


def insight_prompt(mappings: DataFrame, heads: int = 10) -> DataFrame:
    """One prompt over the first mappings by id (src, dst), with how many it shows."""
    shown = mappings.orderBy("src", "dst").limit(heads).withColumn("line", F.format_string(
        "%s.%s -> %s (rule: %s)", "source_table", "source_column", "target_field", "transformation_rule"))
    return shown.agg(
        F.concat(F.lit("Comment on these field mappings: patterns, quality, conflicts, lineage.\n"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", "line"))), lambda r: r["line"]), "\n")
                 ).alias("prompt"),
        F.count("*").alias("mappings_shown"))


def embedding_input(text) -> Column:
    return preview(text, EMBED_CHARS)
