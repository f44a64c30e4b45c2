"""Document rows: text forms, summaries, descriptions, filters."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import constants as K
from fieldloom.functions.text import ellipsis, filled, fixed, head, is_blank, preview, strip


def row_text(metadata) -> Column:
    """``k: v k: v`` of a row map, empty values and false flags left out."""
    shown = F.filter(F.map_entries(metadata), lambda e: (
        (e["value"] != "") & ~(e["key"].startswith("_has_") & (e["value"] == "False"))))
    return F.array_join(F.transform(shown, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " ")


def visible_fields(metadata) -> Column:
    return F.filter(F.map_keys(metadata), lambda k: ~k.startswith("_"))


def file_summaries(rows: DataFrame) -> DataFrame:
    """One summary per CSV file; the field list is that of its first row."""
    return rows.groupBy("source_file").agg(
        F.count("*").alias("num_rows"),
        F.min_by(F.map_keys("metadata"), "row_number").alias("fields"),
    ).withColumn("content", F.format_string(
        "CSV file with %d rows. Fields: %s", "num_rows", F.array_join("fields", ", ")))


def with_content(documents: DataFrame) -> DataFrame:
    return documents.where(~is_blank(F.col("content")))


def long_texts(documents: DataFrame, text="content") -> DataFrame:
    return documents.where(F.length(text) > K.LONG_TEXT)


def flat_metadata(df: DataFrame, columns) -> Column:
    """Typed metadata columns to one string map: scalars cast, lists joined, structs as JSON."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    entries = []
    for c in columns:
        kind = kinds[c]
        if kind == "array":
            value = F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")
        elif kind in ("struct", "map"):
            value = F.to_json(c)
        else:
            value = F.col(c).cast("string")
        entries += [F.lit(c), value]
    return F.create_map(*entries)


def stamped(collection: DataFrame) -> DataFrame:
    return collection.withColumns({"ts": F.current_timestamp(), "doc_length": F.length("document")})


def document_nodes(documents: DataFrame) -> DataFrame:
    """Documents as graph nodes; base attributes win over metadata of the same name."""
    base = F.create_map(
        F.lit("node_type"), F.col("type"), F.lit("source_file"), F.col("source_file"),
        F.lit("content_length"), F.coalesce(F.length("content"), F.lit(0)).cast("string"))
    names = ["node_type", "source_file", "content_length"]
    rest = F.map_filter(F.coalesce("metadata", F.expr("cast(map() as map<string,string>)")),
                        lambda k, _: ~k.isin(*names))
    return documents.select(F.col("doc_id").alias("id"), F.col("type").alias("node_type"),
                            F.map_concat(rest, base).alias("attrs"))


def page_description(meta, text) -> Column:
    """Description of a page from its metadata struct, parts in a set order, else summary or preview."""
    names = F.filter(F.transform(head(meta["fields"], 5), lambda f: f["field_name"]), filled)
    described = F.transform(
        F.filter(head(meta["fields"], 3), lambda f: filled(f["description"])),
        lambda f: F.concat(f["field_name"], F.lit(": "), f["description"]))

    def part(label, value, when):
        return F.when(when, F.concat(F.lit(label), value))

    concepts = head(meta["key_concepts"], 3)
    body = F.concat_ws(
        ". ",
        part("Functional Area: ", meta["functional_area"], filled(meta["functional_area"])),
        part("Table: ", meta["table_name"], filled(meta["table_name"])),
        part("Fields: ", F.array_join(names, ", "), F.size(names) > 0),
        part("Key concepts: ", F.array_join(concepts, ", "), F.size(concepts) > 0),
        part("Summary: ", meta["summary"], filled(meta["summary"])),
        part("Descriptions: ", F.array_join(described, " | "), F.size(described) > 0),
    )
    page = meta["page_number"]
    paged = F.when(page.isNotNull() & (page != 0), F.concat(F.lit("Page "), page.cast("string"), F.lit(" - "), body))
    plain = F.concat(F.lit("Page "), F.coalesce(page.cast("string"), F.lit("")), F.lit(": "), preview(text, 200), F.lit("..."))
    return F.when(body != "", F.coalesce(paged, body)).otherwise(plain)


def _relation_end(metadata, end) -> Column:
    """One end of the mapping relationship that a row's metadata holds as text."""
    shown = F.element_at(metadata, F.lit("_mapping_relationship"))
    single, double = rf"'{end}': '((?:[^'\\]|\\.)*)'", rf"'{end}': \"([^\"]*)\""
    found = F.concat(F.regexp_extract(shown, single, 1), F.regexp_extract(shown, double, 1))
    return F.coalesce(F.replace(found, F.lit("\\'"), F.lit("'")), F.lit("unknown"))


def short_description(doc) -> Column:
    """Short label of a document struct (type, content, metadata), by type."""
    meta, content = doc["metadata"], F.coalesce(doc["content"], F.lit(""))

    def m(k, default="unknown"):
        return F.coalesce(F.element_at(meta, F.lit(k)), F.lit(default))

    described = F.element_at(meta, F.lit("description"))
    return (
        F.when(doc["type"] == "pdf_chunk", F.coalesce(
            ellipsis(described, 80), F.concat(F.lit("PDF chunk: "), preview(content, 50), F.lit("..."))))
        .when(doc["type"] == "csv_row", F.concat(
            F.lit("CSV row "), m("row_number"), F.lit(" from "), m("source_file")))
        .when(doc["type"] == "data_mapping", F.concat(
            F.lit("Mapping: "), _relation_end(meta, "source"), F.lit(" → "), _relation_end(meta, "target")))
        .when(content != "", F.concat(doc["type"], F.lit(": "), preview(content, 50), F.lit("...")))
        .otherwise(doc["type"]))


def similarity_band(similarity) -> Column:
    chain = None
    for above, label in K.SIMILARITY_BANDS:
        chain = (F if chain is None else chain).when(similarity > above, F.lit(label))
    return chain.otherwise(K.LOW_BAND)


def pair_description(a, b, similarity) -> Column:
    """Sentence for a similar pair of document structs; chunk pairs add shared areas, terms and pages.

    Struct fields: type, content, metadata, functional_areas, key_terms, pages.
    """
    lead = F.format_string("%s (%s) between '%s' and '%s'", similarity_band(similarity), fixed(similarity, 3),
                           short_description(a), short_description(b))
    areas = F.array_sort(F.array_intersect(a["functional_areas"], b["functional_areas"]))
    terms = head(F.array_sort(F.array_intersect(a["key_terms"], b["key_terms"])), 3)
    chunky = (a["type"] == "pdf_chunk") & (b["type"] == "pdf_chunk")
    paged = (F.size(a["pages"]) > 0) & (F.size(b["pages"]) > 0)
    return F.concat(
        lead,
        F.when(chunky & (F.size(areas) > 0), F.concat(
            F.lit(" | Shared functional areas: "), F.array_join(areas, ", "))).otherwise(""),
        F.when(chunky & (F.size(terms) > 0), F.concat(
            F.lit(" | Common terms: "), F.array_join(terms, ", "))).otherwise(""),
        F.when(chunky & paged, F.concat(
            F.lit(" | Pages: "), F.get(a["pages"], 0).cast("string"), F.lit("-"),
            F.get(b["pages"], 0).cast("string"))).otherwise(""))


def pair_summary(a, b) -> Column:
    return F.concat(F.lit("Doc1: "), preview(F.coalesce(a, F.lit("")), 100),
                    F.lit("... | Doc2: "), preview(F.coalesce(b, F.lit("")), 100), F.lit("..."))


def merged_terms(*arrays) -> Column:
    """Terms from several lists: trimmed, non-empty, distinct, in value order."""
    none = F.expr("cast(array() as array<string>)")
    every = F.concat(*[F.coalesce(a, none) for a in arrays])
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, strip), filled)))
