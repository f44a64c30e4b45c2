"""Field-mapping rows: header normalisation, flags, classes, edges and lineage."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import constants as K
from fieldloom.functions.text import contains_any, filled, is_blank, last_at, plain_spaces, strip
from fieldloom.session import materialise, spread

ROW_BYTES = 2 << 20  # of sheet rows, as the planner counts them, per task: what is made of a row is far wider

NORMAL_COLUMNS = [name for name, _ in K.HEADER_RULES]


def normal_name(header) -> Column:
    """Standard name of a cleaned header: first rule whose needle occurs in it, else snake case."""
    low = F.lower(header)
    chain = reduce(
        lambda made, rule: made.when(contains_any(low, rule[1]), F.lit(rule[0])),
        K.HEADER_RULES[1:],
        F.when(contains_any(low, K.HEADER_RULES[0][1]), F.lit(K.HEADER_RULES[0][0])),
    )
    return chain.otherwise(F.replace(low, F.lit(" "), F.lit("_")))


# --- Fixed values: names the parser itself adds to a row; a header of that name gives way ---
ROW_KEYS = ["_row_number", "_source_file"]
MAPPING_KEYS = ROW_KEYS + ["_mapping_type", "_has_source_table", "_has_target_field", "_has_transformation", "_mapping_relationship"]


def layouts(rows: DataFrame, mapping: bool, strict_compat: bool = False) -> DataFrame:
    """What each distinct header means, worked out once per header instead of once per row.

    ``keys``/``at``: distinct map keys in order of first appearance and the cell each one takes its
    value from (the last of that name). ``at_<column>``: cell of each normalised mapping column.
    """
    names = F.transform("header", lambda h: strip(h if strict_compat or not mapping else plain_spaces(h)))
    made = rows.select("header").distinct().withColumn("_names", names)
    made = made.withColumn("_norm", F.transform("_names", lambda n: F.when(n != "", normal_name(n)).otherwise("")))
    every = F.concat("_names", "_norm") if mapping else F.col("_names")
    made = made.withColumn("_every", every)
    reserved = F.array(*[F.lit(k) for k in (MAPPING_KEYS if mapping else ROW_KEYS)])
    keys = F.filter(F.array_distinct("_every"), lambda k: (k != "") & ~F.array_contains(reserved, k))
    made = made.withColumn("keys", keys).withColumn(
        "at", F.transform("keys", lambda k: F.pmod(last_at(F.col("_every"), k), F.size("header"))))
    found = [last_at(F.col("_norm"), F.lit(c)).alias(f"at_{c}") for c in NORMAL_COLUMNS] if mapping else []
    return made.select("header", "keys", "at", *found)


def cell_map(keys, at, cells) -> Column:
    """Map of header names to cell values; a cell the row does not have is empty."""
    return F.map_from_arrays(keys, F.transform(at, lambda i: F.coalesce(F.get(cells, i), F.lit(""))))


def row_maps(rows: DataFrame) -> DataFrame:
    """Plain rows (header, cells) to a ``metadata`` map with row number and file."""
    tidy = rows.withColumn("cells", F.transform("cells", strip)).join(layouts(rows, False), "header")
    own = F.create_map(F.lit("_row_number"), F.col("row_number").cast("string"), F.lit("_source_file"), F.col("source_file"))
    return tidy.withColumn("metadata", F.map_concat(cell_map(F.col("keys"), F.col("at"), F.col("cells")), own)).drop(
        "header", "cells", "keys", "at")


def drop_blank_rows(rows: DataFrame, cells="cells") -> DataFrame:
    return rows.where(F.exists(cells, lambda v: ~is_blank(v)))


def mapping_source(table, column) -> Column:
    return F.when(filled(table) & filled(column), F.concat(table, F.lit("."), column)).otherwise("")


def mapping_complexity(rule) -> Column:
    low = F.lower(rule)
    chain = F.when(~filled(rule), F.lit("unknown"))
    for label, needles in K.COMPLEXITY_RULES:
        chain = chain.when(contains_any(low, needles), F.lit(label))
    return chain.otherwise("moderate")


def is_direct(rule) -> Column:
    return F.coalesce(F.contains(F.lower(rule), F.lit("direct")), F.lit(False))


def _py_text(c) -> Column:
    quoted = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(c.contains("'") & ~c.contains('"'), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(quoted)


def normalise_rows(rows: DataFrame, strict_compat: bool = False) -> DataFrame:
    """Raw rows (source_file, row_number, header, cells) to mapping rows.

    ``strict_compat`` keeps no-break spaces in headers and values; by default they become plain
    spaces before the header rules look at them. Rows are dealt to tasks of bounded size, and the headers are written first: the planner
    then knows that they are the small side of the join, and does not send the rows to every task.
    """
    tidy = spread(drop_blank_rows(rows), ROW_BYTES).withColumn(
        "cells", F.transform("cells", lambda v: strip(v if strict_compat else plain_spaces(v))))
    tidy = tidy.join(materialise(layouts(rows, True, strict_compat), "headers"), "header")
    for name in NORMAL_COLUMNS:
        tidy = tidy.withColumn(name, F.coalesce(F.get("cells", F.col(f"at_{name}")), F.lit("")))
    tidy = tidy.withColumns({
        "has_source_table": F.col("source_table") != "",
        "has_target_field": F.col("target_field") != "",
        "has_transformation": F.col("transformation_rule") != "",
    })
    return with_relationship(tidy).withColumn("metadata", _metadata()).drop(
        "header", "cells", "keys", "at", *[f"at_{c}" for c in NORMAL_COLUMNS])


def with_relationship(rows: DataFrame) -> DataFrame:
    """Nested mapping struct, present only when both ends are named."""
    return rows.withColumn("relationship", F.when(
        filled(F.col("source_table")) & filled(F.col("target_field")),
        F.struct(
            F.concat("source_table", F.lit("."), "source_column").alias("source"),
            F.col("target_field").alias("target"),
            F.col("transformation_rule").alias("transformation"),
            "data_type", "description",
        )))


def _metadata() -> Column:
    def flag(c):
        return F.when(F.col(c), F.lit("True")).otherwise("False")

    rel = F.col("relationship")
    parts = ["source", "target", "transformation", "data_type", "description"]
    shown = F.concat(
        F.lit("{"),
        F.concat_ws(", ", *[F.concat(F.lit(f"'{p}': "), _py_text(rel[p])) for p in parts]),
        F.lit("}"))
    own = [F.col("row_number").cast("string"), F.col("source_file"), F.lit("data_mapping"),
           flag("has_source_table"), flag("has_target_field"), flag("has_transformation")]
    fixed = [x for k, v in zip(MAPPING_KEYS, own) for x in (F.lit(k), v)]
    nested = F.create_map(F.lit(MAPPING_KEYS[-1]), shown)
    none = F.expr("cast(map() as map<string,string>)")
    return F.map_concat(cell_map(F.col("keys"), F.col("at"), F.col("cells")), F.create_map(*fixed),
                        F.when(rel.isNotNull(), nested).otherwise(none))


def resolve_source_column(metadata) -> Column:
    """First non-empty value among the known header spellings."""
    return F.coalesce(*[F.nullif(F.element_at(metadata, F.lit(k)), F.lit("")) for k in K.SOURCE_COLUMN_KEYS])


def source_node_id(name) -> Column:
    return F.concat(F.lit("source_"), F.replace(name, F.lit("."), F.lit("_")))


def target_node_id(name) -> Column:
    return F.concat(F.lit("target_"), F.replace(name, F.lit("."), F.lit("_")))


def mapping_edges(rows: DataFrame, keep=()) -> DataFrame:
    """One data_mapping edge per related row, with its descriptive columns and the columns ``keep`` of the row."""
    related = rows.where(F.col("relationship").isNotNull())
    rule = F.col("transformation_rule")
    return related.select(
        source_node_id(F.col("relationship.source")).alias("src"),
        target_node_id(F.col("relationship.target")).alias("dst"),
        F.lit("data_mapping").alias("relationship_type"),
        F.lit(1.0).alias("weight"),
        "doc_id", "source_table", "source_column", "target_field",
        rule, "data_type", "description",
        mapping_source(F.col("source_table"), F.col("source_column")).alias("mapping_source"),
        is_direct(rule).alias("is_direct_mapping"),
        (filled(rule) & ~is_direct(rule)).alias("requires_transformation"),
        mapping_complexity(rule).alias("mapping_complexity"), *keep,
    )


def mapping_graph(rows: DataFrame):
    """Nodes and edges that mapping rows contribute: fields, data_mapping, defines_source/target."""
    # the order in which rows are read: by file, then by number (not by the text of an id)
    seq = F.struct("source_file", "row_number", "doc_id") if {"source_file", "row_number"} <= set(rows.columns) else F.struct("doc_id")
    rows = rows.withColumn("_seq", seq)
    related = rows.where(F.col("relationship").isNotNull())
    rel = F.col("relationship")
    text = [F.col("relationship.data_type").alias("data_type"), F.col("relationship.description").alias("description")]

    def attrs(name, value, side):
        return F.create_map(F.lit(name), value, F.lit("field_type"), F.lit(side),
                            F.lit("data_type"), text[0], F.lit("description"), text[1])

    nodes = related.select(F.explode(F.array(
        F.struct(source_node_id(rel["source"]).alias("id"), F.lit("source_field").alias("node_type"),
                 attrs("table_column", rel["source"], "source").alias("attrs"), F.col("_seq").alias("seq")),
        F.struct(target_node_id(rel["target"]).alias("id"), F.lit("target_field").alias("node_type"),
                 attrs("field_name", rel["target"], "target").alias("attrs"), F.col("_seq").alias("seq")),
    )).alias("n")).select("n.*")
    edge_cols = ["source_table", "source_column", "target_field", "transformation_rule", "data_type", "description",
                 "mapping_source", "is_direct_mapping", "requires_transformation", "mapping_complexity"]
    mapped = mapping_edges(rows, ["_seq"])
    entries = [x for c in edge_cols for x in (F.lit(c), F.col(c).cast("string"))]
    edges = mapped.select("src", "dst", "relationship_type", "weight",
                          F.create_map(*entries).alias("attrs"), F.col("_seq").alias("seq"))
    none = F.expr("cast(map() as map<string,string>)")
    defines = related.select(F.explode(F.array(
        F.struct(F.col("doc_id").alias("src"), source_node_id(rel["source"]).alias("dst"),
                 F.lit("defines_source").alias("relationship_type")),
        F.struct(F.col("doc_id").alias("src"), target_node_id(rel["target"]).alias("dst"),
                 F.lit("defines_target").alias("relationship_type")),
    )).alias("e"), F.col("_seq").alias("seq")).select("e.*", F.lit(1.0).alias("weight"), none.alias("attrs"), "seq")
    return nodes, edges.unionByName(defines)


def mapping_relationships(edges: DataFrame, source_table=None, target_table=None) -> DataFrame:
    """Mapping edges, filtered by table equality and by substring of the target field."""
    kept = edges.where(F.col("relationship_type") == "data_mapping")
    if source_table:
        kept = kept.where(F.col("source_table") == source_table)
    if target_table:
        kept = kept.where(F.contains("target_field", F.lit(target_table)))
    return kept


def field_lineage(edges: DataFrame, field: str) -> DataFrame:
    """Upstream and downstream mappings of a field, case-insensitive substring, one scan."""
    low = field.lower()
    up = F.contains(F.lower("target_field"), F.lit(low))
    down = F.contains(F.lower("mapping_source"), F.lit(low))
    sides = F.filter(F.array(
        F.when(up, F.struct(F.lit("upstream").alias("direction"), F.col("mapping_source").alias("field"))),
        F.when(down, F.struct(F.lit("downstream").alias("direction"), F.col("target_field").alias("field"))),
    ), lambda s: s.isNotNull())
    return (edges.where((F.col("relationship_type") == "data_mapping") & (up | down))
            .select(F.explode(sides).alias("s"), F.col("transformation_rule").alias("transformation"),
                    F.col("mapping_complexity").alias("complexity"))
            .select("s.direction", "s.field", "transformation", "complexity"))


def link_terms(mappings: DataFrame, pages: DataFrame) -> DataFrame:
    """Mapping source column equals a page key term (trimmed, any case): one edge per mapping and page.

    ``mappings``: id, source_column, source_table, target_field. ``pages``: id, key_terms array.
    """
    spelled = F.transform(F.filter("key_terms", lambda t: ~is_blank(t)), lambda t: F.struct(F.lower(strip(t)).alias("key"), t.alias("matched_term")))
    # the least spelling of every key of a page row is found inside the row, so spellings do not multiply the rows of the shuffles
    least = F.map_from_entries(F.transform(F.array_distinct(F.transform("spelled", lambda t: t["key"])), lambda k: F.struct(
        k, F.array_min(F.transform(F.filter("spelled", lambda t: t["key"] == k), lambda t: t["matched_term"])))))
    terms = spread(pages.select("id", "key_terms")).select(F.col("id").alias("dst"), spelled.alias("spelled")).select("dst", F.explode(least).alias("key", "matched_term"))
    keyed = mappings.where(~is_blank(F.col("source_column"))).select(
        F.col("id").alias("src"), F.lower(strip(F.col("source_column"))).alias("key"), "source_column", "source_table", "target_field").distinct()
    # terms without a partner are gone before the one shuffle by key and page, and the wide columns of a mapping join after it
    asked = terms.join(keyed.select("key").distinct(), "key", "left_semi").groupBy("key", "dst").agg(F.min("matched_term").alias("matched_term"))
    found = asked.join(keyed, "key")
    return found.select(
        "src", "dst", F.lit("field_to_pdf_keyterm").alias("relationship_type"),
        F.lit(1.0).alias("weight"), F.lit(1.0).alias("confidence"),
        "source_column", "source_table", "target_field", "matched_term",
        F.format_string("Mapping source column '%s' matches PDF key term '%s'", "source_column", "matched_term")
        .alias("description"))
