"""Queries over mapping rows, lineage and term links."""

from pyspark.sql import functions as F

from fieldloom.operators import documents as DO
from fieldloom.operators import mapping as MO
from fieldloom.operators import retrieval as RO
from fieldloom.operators.graph import upsert_edges, upsert_nodes
from fieldloom.plans import bindings as B
from fieldloom.plans.registry import query, table

ROW_TEXT = """concat_ws(' ', 'Row Key: ' || p_partkey, CASE WHEN source_table <> '' THEN 'Source Table: ' || source_table END, 'Source Column: ' || source_column,
  CASE WHEN transformation_rule <> '' THEN 'Transformation / Mapping Rules: ' || transformation_rule END, 'Field: ' || target_field, 'Type: ' || data_type,
  'Description: ' || description, 'row_key: ' || p_partkey, CASE WHEN source_table <> '' THEN 'source_table: ' || source_table END, 'source_column: ' || source_column,
  CASE WHEN transformation_rule <> '' THEN 'transformation_rule: ' || transformation_rule END, 'target_field: ' || target_field,
  'data_type: ' || data_type, 'description: ' || description, '_row_number: ' || row_number, '_source_file: ' || source_file, '_mapping_type: data_mapping',
  CASE WHEN source_table <> '' THEN '_has_source_table: True' END, '_has_target_field: True', CASE WHEN transformation_rule <> '' THEN '_has_transformation: True' END,
  CASE WHEN source_table <> '' THEN '_mapping_relationship: {''source'': ''' || source_table || '.' || source_column || ''', ''target'': ''' || target_field
    || ''', ''transformation'': ''' || transformation_rule || ''', ''data_type'': ''' || data_type || ''', ''description'': ''' || description || '''}' END)"""


@query("prj1_row_text", f"WITH {B.M} SELECT doc_id, {ROW_TEXT} AS content FROM m")
def prj1(spark, sf_dir):
    return B.mappings(spark, sf_dir).select("doc_id", DO.row_text("metadata").alias("content"))


@query("prj2_mapping_flags", f"""WITH {B.M} SELECT doc_id, source_table <> '' AS has_source_table, true AS has_target_field, transformation_rule <> '' AS has_transformation,
  CASE WHEN source_table <> '' THEN source_table || '.' || source_column END AS rel_source, CASE WHEN source_table <> '' THEN target_field END AS rel_target,
  CASE WHEN source_table <> '' THEN transformation_rule END AS rel_rule FROM m""")
def prj2(spark, sf_dir):
    return B.mappings(spark, sf_dir).select(
        "doc_id", "has_source_table", "has_target_field", "has_transformation", F.col("relationship.source").alias("rel_source"),
        F.col("relationship.target").alias("rel_target"), F.col("relationship.transformation").alias("rel_rule"))


@query("prj3_file_summary", f"""WITH {B.M}, s AS (SELECT source_file, count(*) AS num_rows, arg_min(source_table, row_number) AS first_table FROM m GROUP BY source_file)
SELECT source_file, num_rows, 'CSV file with ' || num_rows || ' rows. Fields: Row Key, Source Table, Source Column, Transformation / Mapping Rules, Field, Type, Description, '
  || 'row_key, source_table, source_column, transformation_rule, target_field, data_type, description, _row_number, _source_file, _mapping_type, _has_source_table, '
  || '_has_target_field, _has_transformation' || CASE WHEN first_table <> '' THEN ', _mapping_relationship' ELSE '' END AS content FROM s""")
def prj3(spark, sf_dir):
    return DO.file_summaries(B.mappings(spark, sf_dir)).select("source_file", "num_rows", "content")


@query("prj8_edge_attributes", f"WITH {B.ME} SELECT doc_id, mapping_source, is_direct_mapping, requires_transformation, 1.0::DOUBLE AS weight FROM me")
def prj8(spark, sf_dir):
    return B.mapping_links(spark, sf_dir).select("doc_id", "mapping_source", "is_direct_mapping", "requires_transformation", "weight")


@query("prj9_mapping_complexity", f"WITH {B.ME} SELECT doc_id, transformation_rule, mapping_complexity FROM me")
def prj9(spark, sf_dir):
    return B.mapping_links(spark, sf_dir).select("doc_id", "transformation_rule", "mapping_complexity")


@query("prj14_source_column", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN p_brand END AS source_column FROM part""")
def prj14(spark, sf_dir):
    kind = F.col("p_size") % 4
    key = (F.when(kind == 0, F.lit("Source Column")).when(kind == 1, F.lit("\ufeffSource\xa0Field")).when(kind == 2, F.lit("Source Field")).otherwise("Other"))
    value = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.col("p_type")).otherwise(F.col("p_brand"))
    meta = F.create_map(F.lit("source_column"), F.lit(""), key, value)
    return table(spark, sf_dir, "part").select("p_partkey", MO.resolve_source_column(meta).alias("source_column"))


@query("prj15_node_ids", """SELECT p_partkey, 'source_' || replace(p_brand || '.' || p_name, '.', '_') AS source_id, 'target_' || replace(p_type, '.', '_') AS target_id,
  'field_' || p_brand || '.csv_' || p_name AS field_id FROM part""")
def prj15(spark, sf_dir):
    from fieldloom.operators.graph import field_node_id
    return table(spark, sf_dir, "part").select(
        "p_partkey", MO.source_node_id(F.concat("p_brand", F.lit("."), "p_name")).alias("source_id"), MO.target_node_id(F.col("p_type")).alias("target_id"),
        field_node_id(F.concat("p_brand", F.lit(".csv")), F.col("p_name")).alias("field_id"))


@query("prj16_mapping_graph_edges", f"""WITH {B.ME} SELECT src, dst, 'data_mapping' AS relationship_type, 1.0::DOUBLE AS weight FROM me GROUP BY src, dst
UNION ALL SELECT doc_id, src, 'defines_source', 1.0::DOUBLE FROM me UNION ALL SELECT doc_id, dst, 'defines_target', 1.0::DOUBLE FROM me""")
def prj16_edges(spark, sf_dir):
    _, edges = MO.mapping_graph(B.mappings(spark, sf_dir))
    return upsert_edges(edges).select("src", "dst", "relationship_type", "weight")


@query("prj16_mapping_graph_nodes", f"""WITH {B.ME} SELECT src AS id, 'source_field' AS node_type, arg_max(mapping_source, (source_file, row_number)) AS name,
  arg_max(description, (source_file, row_number)) AS description FROM me GROUP BY src
UNION ALL SELECT dst, 'target_field', arg_max(target_field, (source_file, row_number)), arg_max(description, (source_file, row_number)) FROM me GROUP BY dst""")
def prj16_nodes(spark, sf_dir):
    nodes, _ = MO.mapping_graph(B.mappings(spark, sf_dir))
    a = F.col("attrs")
    return upsert_nodes(nodes).select("id", "node_type", F.coalesce(a["table_column"], a["field_name"]).alias("name"), a["description"].alias("description"))


@query("flt1_blank_rows", "SELECT p_partkey FROM part WHERE p_size <> 7")
def flt1(spark, sf_dir):
    return MO.drop_blank_rows(B.sheet_cells(spark, sf_dir)).select("p_partkey")


@query("flt7_mapping_list", f"WITH {B.ME} SELECT doc_id, src, dst, mapping_complexity FROM me WHERE source_table = 'Brand#7' AND contains(target_field, 'small')")
def flt7(spark, sf_dir):
    return MO.mapping_relationships(B.mapping_links(spark, sf_dir), "Brand#7", "small").select("doc_id", "src", "dst", "mapping_complexity")


LINEAGE = f"""WITH {B.ME}, l AS (SELECT 'upstream' AS direction, mapping_source AS field, transformation_rule AS transformation, mapping_complexity AS complexity
  FROM me WHERE contains(lower(target_field), 'small') UNION ALL SELECT 'downstream', target_field, transformation_rule, mapping_complexity
  FROM me WHERE contains(lower(mapping_source), 'small'))"""


@query("flt8_field_lineage", f"{LINEAGE} SELECT direction, field, transformation, complexity FROM l")
def flt8(spark, sf_dir):
    return MO.field_lineage(B.mapping_links(spark, sf_dir), "Small")


@query("agg16_lineage_totals", f"{LINEAGE} SELECT count(*) FILTER (direction = 'upstream') AS total_upstream, count(*) FILTER (direction = 'downstream') AS total_downstream FROM l")
def agg16(spark, sf_dir):
    return RO.lineage_totals(MO.field_lineage(B.mapping_links(spark, sf_dir), "small"))


@query("flt12_visible_fields", f"""WITH {B.M} SELECT doc_id, 'Row Key|Source Table|Source Column|Transformation / Mapping Rules|Field|Type|Description|row_key|source_table|source_column|'
  || 'transformation_rule|target_field|data_type|description' AS fields FROM m""")
def flt12(spark, sf_dir):
    return B.mappings(spark, sf_dir).select("doc_id", F.array_join(DO.visible_fields("metadata"), "|").alias("fields"))


@query("jn1_term_links", """
WITH t AS (SELECT 'line_' || l_orderkey || '_' || l_linenumber AS dst, unnest([' FLD_' || l_partkey || ' ', 'fld_' || l_partkey, 'SUP_' || l_suppkey]) AS term FROM lineitem),
k AS (SELECT dst, lower(trim(term)) AS key, min(term) AS matched_term FROM t GROUP BY ALL)
SELECT 'map_' || p_partkey AS src, dst, 1.0::DOUBLE AS weight, 'Fld_' || p_partkey AS source_column, matched_term,
  'Mapping source column ''Fld_' || p_partkey || ''' matches PDF key term ''' || matched_term || '''' AS description
FROM part JOIN k ON key = 'fld_' || p_partkey""")
def jn1(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    part_key, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    pages = line.select(
        F.concat(F.lit("line_"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("id"),
        F.array(F.concat(F.lit(" FLD_"), part_key, F.lit(" ")), F.concat(F.lit("fld_"), part_key), F.concat(F.lit("SUP_"), supplier)).alias("key_terms"))
    sheet = table(spark, sf_dir, "part").select(
        F.concat(F.lit("map_"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("Fld_"), F.col("p_partkey").cast("string")).alias("source_column"),
        F.col("p_brand").alias("source_table"), F.col("p_type").alias("target_field"))
    return MO.link_terms(sheet, pages).select("src", "dst", "weight", "source_column", "matched_term", "description")


@query("top3_mapping_heads", f"WITH {B.ME} SELECT src, dst, doc_id FROM me ORDER BY src, dst, doc_id LIMIT 10")
def top3(spark, sf_dir):
    return B.mapping_links(spark, sf_dir).select("src", "dst", "doc_id").orderBy("src", "dst", "doc_id").limit(10)


@query("set2_merged_terms", """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([p_name, p_type, p_brand, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END, p_type], lambda x: x <> ''))), '|') AS terms FROM part""")
def set2(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    even = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise("  ")
    return part.select("p_partkey", F.array_join(DO.merged_terms(
        F.array("p_name", "p_type"), F.array(F.col("p_brand"), even), F.when(F.col("p_size") < 0, F.array("p_name")), F.array(F.lit("")), F.array("p_type")), "|").alias("terms"))


@query("key1_row_key", "SELECT p_partkey, sha256(p_brand || '|' || p_partkey) AS row_key FROM part")
def key1(spark, sf_dir):
    from fieldloom.operators.claims import row_key
    return table(spark, sf_dir, "part").select("p_partkey", row_key(F.col("p_brand"), F.col("p_partkey")).alias("row_key"))


