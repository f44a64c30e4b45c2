"""Queries over sources and sinks: files are written from the tables, then scanned."""

from pyspark.sql import functions as F

from fieldloom.functions.numbering import number_rows
from fieldloom.functions.text import basename
from fieldloom.operators import collection as CO
from fieldloom.operators import documents as DO
from fieldloom.operators.claims import load_claims
from fieldloom.operators.ingest import process_files
from fieldloom.operators.reports import system_status
from fieldloom.plans import bindings as B
from fieldloom.plans.registry import query, table
from fieldloom.session import scratch_path
from fieldloom.sources import files, pages, stores


def _folder(path):
    return F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)


@query("src1_file_catalogue", "SELECT 'csv' AS file_class, true AS has_files, true AS has_bytes FROM part LIMIT 1")
def src1(spark, sf_dir):
    found = files.find_files(spark, B.sheet_folder(spark, sf_dir))
    return found.groupBy("file_class").agg((F.count("*") > 0).alias("has_files"), (F.min("length") > 0).alias("has_bytes"))


@query("src2_delimiter", """
SELECT DISTINCT 'parts' AS folder, ',' AS delimiter FROM part UNION ALL SELECT DISTINCT 'suppliers', ';' FROM supplier
UNION ALL SELECT DISTINCT 'nations', chr(9) FROM nation""")
def src2(spark, sf_dir):
    profile = files.csv_profile(spark, B.sheet_folder(spark, sf_dir))
    return profile.select(_folder(F.col("path")).alias("folder"), "delimiter").distinct()


@query("src3_mapping_detection", """
SELECT DISTINCT 'parts' AS folder, true AS is_mapping FROM part UNION ALL SELECT DISTINCT 'suppliers', false FROM supplier
UNION ALL SELECT DISTINCT 'nations', false FROM nation""")
def src3(spark, sf_dir):
    profile = files.csv_profile(spark, B.sheet_folder(spark, sf_dir))
    return profile.select(_folder(F.col("path")).alias("folder"), "is_mapping").distinct()


@query("src4_csv_rows", """
SELECT 'suppliers' AS folder, 's_suppkey: ' || s_suppkey || ' s_name: ' || s_name || ' s_nation: ' || s_nationkey
  || ' cents: ' || CAST(round(s_acctbal * 100) AS BIGINT) AS content FROM supplier
UNION ALL SELECT 'nations', 'n_nationkey: ' || n_nationkey || ' n_name: ' || n_name || ' n_regionkey: ' || n_regionkey FROM nation""")
def src4(spark, sf_dir):
    plain, _ = files.parse_csv(spark, B.sheet_folder(spark, sf_dir))
    shown = F.map_filter("metadata", lambda k, _: ~k.startswith("_"))
    return plain.select(_folder(F.col("path")).alias("folder"), DO.row_text(shown).alias("content"))


@query("src4_csv_records", """SELECT c_custkey AS key, true AS in_place, 'first' || chr(10) || 'second, "' || c_mktsegment || '"' AS note, CASE WHEN c_custkey % 9 = 0 THEN 'surplus cells' END AS reason,
  CASE WHEN c_custkey % 9 = 0 THEN 'more|' || c_nationkey END AS surplus, CASE WHEN c_custkey % 9 = 0 THEN true END AS kept FROM customer""")
def src4_records(spark, sf_dir):
    """Sheets with quoted line breaks and with rows longer than the header. Each row carries its place in its file, counted as it was written."""
    path = scratch_path(spark, "records")
    rows = table(spark, sf_dir, "customer").repartition(4, "c_custkey").sortWithinPartitions("c_custkey").withColumn("place", F.monotonically_increasing_id() % (1 << 33) + 1)
    line = F.concat(F.concat_ws(",", "c_custkey", "place"), F.lit(',"first\nsecond, ""'), "c_mktsegment", F.lit('"""'), F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit(",more,"), F.col("c_nationkey").cast("string"))).otherwise(""))
    rows.select(F.concat(F.when(F.col("place") == 1, "key,place,note\n").otherwise(""), line).alias("value")).write.text(path)
    cells, errors = files.read_csv(spark, path, "*.txt")
    cell = lambda i: F.col("cells")[i]
    good = cells.select("path", "row_number", cell(0).cast("bigint").alias("key"), (cell(1).cast("bigint") == F.col("row_number")).alias("in_place"), cell(2).alias("note"))
    told = errors.select("path", "row_number", "reason", F.array_join("surplus", "|").alias("surplus"), "kept")
    return good.join(told, ["path", "row_number"], "left").drop("path", "row_number")


@query("src5_mapping_rows", f"""WITH {B.M} SELECT p_partkey AS row_key, source_table, source_column, target_field,
  transformation_rule, data_type, description, source_table <> '' AS has_source_table FROM m""")
def src5(spark, sf_dir):
    _, sheet = files.parse_csv(spark, B.sheet_folder(spark, sf_dir))
    return sheet.select(F.element_at("metadata", F.lit("row_key")).cast("bigint").alias("row_key"), "source_table", "source_column",
                        "target_field", "transformation_rule", "data_type", "description", "has_source_table")


@query("src6_page_scan", r"""
SELECT 'conv_' || conv_id AS source_file, turn + 1 AS page_number, 'page_' || (turn + 1) AS chunk_id,
  chr(10) || '--- Page ' || (turn + 1) || ' ---' || chr(10) || text AS marked_text
FROM conversations WHERE regexp_replace(text, '[\s\p{Z}]', '', 'g') <> ''""")
def src6(spark, sf_dir):
    return pages.content_pages(_conversation_pages(spark, sf_dir)).select("source_file", "page_number", "chunk_id", "marked_text")


@query("src6_full_text", r"""
WITH p AS (SELECT 'conv_' || conv_id AS source_file, turn + 1 AS page_number, text, regexp_replace(text, '[\s\p{Z}]', '', 'g') <> '' AS filled
  FROM conversations)
SELECT source_file, count(*) AS num_pages, count(*) FILTER (filled) AS content_pages,
  md5(coalesce(string_agg(chr(10) || '--- Page ' || page_number || ' ---' || chr(10) || text, '' ORDER BY page_number) FILTER (filled), '')) AS text_md5
FROM p GROUP BY source_file""")
def src6_full_text(spark, sf_dir):
    rows = _conversation_pages(spark, sf_dir)
    full = pages.full_text(rows)
    return pages.page_counts(rows).join(full, "source_file", "left").select(
        "source_file", "num_pages", "content_pages", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def _conversation_pages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("source_file"), (F.col("turn") + 1).alias("page_number"), "text")


@query("src7_load_documents", f"""WITH {B.D} SELECT doc_id, type, source_file, length(content) AS n_chars, parent_document,
  n::INTEGER AS row_number, lang FROM d""")
def src7(spark, sf_dir):
    path = scratch_path(spark, "documents")
    stores.save_documents(B.documents(spark, sf_dir), path)
    return stores.load_documents(spark, path).select(
        "doc_id", "type", "source_file", F.length("content").cast("bigint").alias("n_chars"), "parent_document", "row_number",
        F.col("metadata")["lang"].alias("lang"))


@query("src7_keyed_documents", f"WITH {B.D} SELECT doc_id, type, content FROM d")
def src7_keyed(spark, sf_dir):
    docs = B.documents(spark, sf_dir)
    objects = docs.select(F.to_json(F.create_map("doc_id", F.struct("type", "source_file", "content"))).alias("value"))
    return stores.keyed_documents(objects).select("doc_id", "type", "content")


@query("src8_graph_objects", """
SELECT 'customer_' || c_custkey AS src, 'nation_' || c_nationkey AS dst, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE 'lives_in' END AS relationship_type,
  CASE WHEN c_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS weight, c_mktsegment AS segment FROM customer""")
def src8(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("customer_"), F.col("c_custkey").cast("string"))
    nation = F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"))
    value = F.to_json(F.struct(
        F.array(F.struct(name.alias("id"))).alias("nodes"),
        F.array(F.struct(name.alias("source"), nation.alias("target"),
                         F.when(F.col("c_custkey") % 3 != 0, "lives_in").alias("relationship_type"),
                         F.when(F.col("c_custkey") % 2 != 0, 0.25).alias("weight"), F.col("c_mktsegment").alias("segment"))).alias("edges")))
    _, edges = stores.graph_from_objects(c.select(value.alias("value")))
    return edges.select("src", "dst", "relationship_type", "weight", F.col("attrs")["segment"].alias("segment"))


@query("snk2_graph_round_trip", f"""WITH {B.RETURNS}, {B.sql_nodes('nation')}
SELECT src, dst, relationship_type, round(coalesce(weight, 1.0), 6) AS weight FROM returns
UNION ALL SELECT id, '', node_type, 0.0::DOUBLE FROM nodes""")
def snk2(spark, sf_dir):
    path = scratch_path(spark, "graph")
    none = F.expr("cast(map() as map<string,string>)")
    stores.save_graph(B.nodes_of(spark, sf_dir, "nation"), B.return_edges(spark, sf_dir).withColumn("attrs", none), path)
    nodes, edges = stores.load_graph(spark, path)
    return edges.select("src", "dst", "relationship_type", F.round("weight", 6).alias("weight")).unionByName(
        nodes.select(F.col("id").alias("src"), F.lit("").alias("dst"), F.col("node_type").alias("relationship_type"), F.lit(0.0).alias("weight")))


@query("src9_import_collection", f"WITH {B.C} SELECT 'v' || id AS id, len(e) AS dim, length(document)::INTEGER AS doc_length, label::VARCHAR AS label FROM c WHERE label <> 3")
def src9(spark, sf_dir):
    path = scratch_path(spark, "collection")
    rows = B.collection(spark, sf_dir).select(
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("id"), F.when(F.col("metadata")["label"] != "3", F.col("embedding")).alias("embedding"),
        "document", "metadata")
    stores.export_collection(rows, "main", path)
    return stores.import_collection(spark, path).select(
        "id", F.size("embedding").cast("bigint").alias("dim"), "doc_length", F.col("metadata")["label"].alias("label"))


@query("snk3_export_header", "SELECT 'main' AS collection_name, count(*) AS total_documents FROM embeddings")
def snk3(spark, sf_dir):
    path = scratch_path(spark, "collection")
    stores.export_collection(B.collection(spark, sf_dir), "main", path)
    return spark.read.schema("collection_name string, total_documents bigint").json(f"{path}/header")


@query("src10_claims_scan", """SELECT 'C' || o_orderkey AS CLM_ID, o_custkey::VARCHAR AS BENE_ID,
  CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE o_totalprice::DECIMAL(15,2)::VARCHAR || '5' END AS CLM_PMT_AMT FROM orders""")
def src10(spark, sf_dir):
    path = scratch_path(spark, "claims")
    B.claims(spark, sf_dir).select("CLM_ID", "BENE_ID", "CLM_PMT_AMT", "CLM_FROM_DT").write.csv(path, header=True)
    return files.read_claims(spark, path).select("CLM_ID", "BENE_ID", "CLM_PMT_AMT")


@query("snk1_export_documents", f"WITH {B.D} SELECT type, count(*) AS documents, sum(length(content))::BIGINT AS chars FROM d GROUP BY type")
def snk1(spark, sf_dir):
    path = scratch_path(spark, "documents")
    stores.save_documents(B.documents(spark, sf_dir), path)
    return spark.read.schema(stores.DOCUMENT_SCHEMA).json(path).groupBy("type").agg(
        F.count("*").alias("documents"), F.sum(F.length("content")).alias("chars"))


def _status(spark, sf_dir):
    return system_status(B.documents(spark, sf_dir), B.collection(spark, sf_dir),
                         B.nodes_of(spark, sf_dir, "nation", "part", "supplier"), B.supply_edges(spark, sf_dir))


STATUS = f"""WITH {B.SUPPLY}, {B.sql_nodes('nation', 'part', 'supplier')}, n AS (SELECT count(*)::DOUBLE AS n FROM nodes), m AS (SELECT count(*)::DOUBLE AS m FROM supply)
SELECT 'documents' AS section, 'processed_documents' AS name, count(*)::DOUBLE AS value FROM documents
UNION ALL SELECT 'collection', 'total_documents', count(*)::DOUBLE FROM embeddings
UNION ALL SELECT 'collection', 'sample_size', count(*)::DOUBLE FROM embeddings
UNION ALL SELECT 'collection', 'metadata_keys', 4.0 FROM (SELECT DISTINCT 1 FROM embeddings)
UNION ALL SELECT 'graph', 'num_nodes', n FROM n UNION ALL SELECT 'graph', 'num_edges', m FROM m
UNION ALL SELECT 'graph', 'average_degree', round(2 * m / n, 6) FROM n, m
UNION ALL SELECT 'graph', 'density', round(m / (n * (n - 1)), 6) FROM n, m
UNION ALL SELECT 'node_types', node_type, count(*)::DOUBLE FROM nodes GROUP BY node_type
UNION ALL SELECT 'edge_types', relationship_type, count(*)::DOUBLE FROM supply GROUP BY relationship_type"""


@query("agg15_system_status", STATUS)
def agg15(spark, sf_dir):
    return _status(spark, sf_dir).withColumn("value", F.round("value", 6))


@query("snk4_export_status", STATUS)
def snk4(spark, sf_dir):
    path = scratch_path(spark, "status")
    _status(spark, sf_dir).write.json(path)
    return spark.read.schema("section string, name string, value double").json(path).withColumn("value", F.round("value", 6))


@query("snk5_append_staging", """SELECT o_orderstatus AS status, count(*) * 2 AS rows, count(*) AS priced FROM orders GROUP BY o_orderstatus""")
def snk5(spark, sf_dir):
    path = scratch_path(spark, "staging")
    orders = table(spark, sf_dir, "orders")
    stores.append_staging(orders.select("o_orderkey", "o_orderstatus"), path)
    stores.append_staging(orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return stores.read_staging(spark, path).groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("rows"), F.count("o_totalprice").alias("priced"))


@query("agg17_staging_counts", """WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT 'stg_claim_header' AS table_name, count(*) AS rows FROM o
UNION ALL SELECT 'stg_claim_diagnosis', (sum(k % 4) + count(*) FILTER (k % 5 <> 0))::BIGINT FROM o
UNION ALL SELECT 'stg_claim_procedures', sum(k % 3)::BIGINT FROM o
UNION ALL SELECT 'stg_claim_lines', sum(k % 3 + 1)::BIGINT FROM o""")
def agg17(spark, sf_dir):
    counts = load_claims(B.claims(spark, sf_dir), scratch_path(spark, "warehouse"), "2025-09-02")
    return spark.createDataFrame(list(counts.items()), "table_name string, rows bigint")


@query("prj17_basename", r"SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS name FROM pages")
def prj17(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", basename(F.col("url")).alias("name"))


@query("win1_row_number", "SELECT c_custkey AS row_key, c_custkey % 7 AS file, row_number() OVER (PARTITION BY c_custkey % 7 ORDER BY c_custkey) AS row_number FROM customer")
def win1(spark, sf_dir):
    """Numbers of the rows of seven files, each written in order of the key; every third note has a line break, and empty lines stand between rows."""
    path = scratch_path(spark, "numbered")
    key, part = F.col("c_custkey"), F.col("c_custkey") % 7
    rows = table(spark, sf_dir, "customer").select("c_custkey", part.alias("file"))
    rows = rows.join(rows.groupBy("file").agg(F.min("c_custkey").alias("first")), "file").repartitionByRange(7, "file").sortWithinPartitions("file", "c_custkey")
    head = F.when(F.col("c_custkey") == F.col("first"), "key,note\n").otherwise("")
    line = F.concat(head, key.cast("string"), F.lit(","), F.when(key % 3 == 0, '"a\nb"').otherwise("a"), F.when(key % 5 == 0, "\n").otherwise(""))
    rows.select("file", line.alias("value")).write.partitionBy("file").text(path)
    cells, _ = files.read_csv(spark, path, "*.txt")
    return cells.select(F.col("cells")[0].cast("bigint").alias("row_key"), F.regexp_extract("path", r"file=(\d+)", 1).cast("bigint").alias("file"), "row_number")


@query("win2_group_numbering", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS line_number FROM lineitem""")
def win2(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    rows = number_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", *order), order, within=["l_orderkey"], name="line_number")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "line_number")


@query("win4_file_ids", """WITH f AS (SELECT url, CASE page_id % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'pdf' WHEN 2 THEN 'python' ELSE 'other' END AS file_class, page_id FROM pages),
r AS (SELECT *, row_number() OVER (ORDER BY CASE file_class WHEN 'csv' THEN 0 WHEN 'pdf' THEN 1 ELSE 2 END,
  'f' || lpad(page_id::VARCHAR, 12, '0') || CASE file_class WHEN 'csv' THEN '.csv' WHEN 'pdf' THEN '.pdf' ELSE '.py' END) - 1 AS n FROM f WHERE file_class <> 'other')
SELECT page_id, file_class || '_' || n AS doc_id FROM r""")
def win4(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    which = F.col("page_id") % 4
    suffix = F.when(which == 0, ".csv").when(which == 1, ".pdf").when(which == 2, ".py").otherwise(".CSV")
    path = F.concat(F.lit("f"), F.lpad(F.col("page_id").cast("string"), 12, "0"), suffix)
    listed = p.select("page_id", path.alias("path")).withColumn("file_class", files.file_class(F.col("path")))
    return files.file_ids(listed).select("page_id", "doc_id")


@query("agg7_files_per_class", """WITH f AS (SELECT CASE page_id % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'pdf' WHEN 2 THEN 'python' ELSE 'other' END AS file_class FROM pages)
SELECT coalesce(file_class, 'total') AS file_class, count(*) AS files FROM f GROUP BY ROLLUP (file_class)""")
def agg7(spark, sf_dir):
    which = F.col("page_id") % 4
    suffix = F.when(which == 0, ".csv").when(which == 1, ".pdf").when(which == 2, ".py").otherwise(".CSV")
    listed = table(spark, sf_dir, "pages").select(files.file_class(F.concat(F.lit("f"), suffix)).alias("file_class"))
    return files.files_per_class(listed)


@query("dml5_drop_collection", "SELECT 1 AS version, count(*) AS rows FROM embeddings UNION ALL SELECT 2, 0")
def dml5(spark, sf_dir):
    """Rows of the stored collection before and after it is dropped."""
    path = scratch_path(spark, "collection")
    stores.store_collection(B.vectors(spark, sf_dir), path)
    stores.store_collection(CO.drop_all(stores.stored_collection(spark, path)), path)
    out = None
    for version in (1, 2):
        one = stores.stored_collection(spark, path, version).agg(F.count("*").alias("rows")).select(F.lit(version).alias("version"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("prj15_csv_documents", """SELECT 'csv_row' AS type, count(*) AS documents, count(*) AS shaped_ids FROM (SELECT p_partkey FROM part WHERE p_size <> 7
  UNION ALL SELECT s_suppkey FROM supplier UNION ALL SELECT n_nationkey FROM nation)""")
def prj15_documents(spark, sf_dir):
    docs = process_files(spark, B.sheet_folder(spark, sf_dir)).where("type = 'csv_row'")
    return docs.groupBy("type").agg(F.count("*").alias("documents"), F.count_distinct(F.regexp_extract("doc_id", r"^csv_\d+_row_\d+$", 0)).alias("shaped_ids"))
