"""Inputs that the registered queries derive from the given tables, with the same inputs as SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.mapping import mapping_edges, normalise_rows
from fieldloom.plans.registry import table
from fieldloom.session import scratch_path

NBSP = "\xa0"
SHEET_HEADER = ["Row Key", f"Source{NBSP}Table", "Source Column", "Transformation / Mapping Rules", "Field", "Type", "Description"]


def _rule():
    size = F.col("p_size") % 6
    return (F.when(size == 0, F.lit(f"Direct{NBSP}mapping")).when(size == 1, "Convert to decimal(15,2)")
            .when(size == 2, "Lookup in reference table").when(size == 3, "Calculate sum of amounts")
            .when(size == 4, "Custom function").otherwise(""))


def sheet_cells(spark, sf_dir) -> DataFrame:
    """One mapping sheet row per part; parts of size 7 are rows of blanks."""
    part = table(spark, sf_dir, "part")
    blank = F.col("p_size") == 7

    def cell(c):
        return F.when(blank, F.lit("  ")).otherwise(c)

    return part.select("p_partkey", "p_brand", F.array(
        cell(F.col("p_partkey").cast("string")),
        cell(F.when(F.col("p_size") == 13, "").otherwise(F.col("p_brand"))),
        cell(F.concat(F.lit(" "), "p_name", F.lit(" "))), cell(_rule()),
        cell(F.concat(F.lower("p_type"), F.lit("_"), F.col("p_size").cast("string"))),
        cell(F.when(F.col("p_size") % 2 == 0, "STRING").otherwise("DECIMAL(15,2)")),
        cell(F.concat(F.lit(f"Part{NBSP}"), F.col("p_partkey").cast("string")))).alias("cells"))


def mapping_raw(spark, sf_dir) -> DataFrame:
    return sheet_cells(spark, sf_dir).select(
        F.concat("p_brand", F.lit(".csv")).alias("source_file"), (F.col("p_partkey") + 1).alias("row_number"),
        F.concat(F.lit("map_"), F.col("p_partkey").cast("string")).alias("doc_id"),
        # a column, not a constant: headers normally come from files
        F.when(F.col("p_partkey").isNotNull(), F.array(*[F.lit(h) for h in SHEET_HEADER])).alias("header"), "cells")


def mappings(spark, sf_dir) -> DataFrame:
    return normalise_rows(mapping_raw(spark, sf_dir))


def mapping_links(spark, sf_dir) -> DataFrame:
    return mapping_edges(mappings(spark, sf_dir))


M = """m AS (SELECT p_partkey, 'map_' || p_partkey AS doc_id, p_brand || '.csv' AS source_file, p_partkey + 1 AS row_number,
  CASE WHEN p_size = 13 THEN '' ELSE p_brand END AS source_table, p_name AS source_column,
  CASE p_size % 6 WHEN 0 THEN 'Direct mapping' WHEN 1 THEN 'Convert to decimal(15,2)' WHEN 2 THEN 'Lookup in reference table'
    WHEN 3 THEN 'Calculate sum of amounts' WHEN 4 THEN 'Custom function' ELSE '' END AS transformation_rule,
  lower(p_type) || '_' || p_size AS target_field, CASE WHEN p_size % 2 = 0 THEN 'STRING' ELSE 'DECIMAL(15,2)' END AS data_type,
  'Part ' || p_partkey AS description FROM part WHERE p_size <> 7)"""

ME = M + """, me AS (SELECT *, 'source_' || replace(source_table || '.' || source_column, '.', '_') AS src,
  'target_' || replace(target_field, '.', '_') AS dst, source_table || '.' || source_column AS mapping_source,
  contains(lower(transformation_rule), 'direct') AS is_direct_mapping,
  transformation_rule <> '' AND NOT contains(lower(transformation_rule), 'direct') AS requires_transformation,
  CASE transformation_rule WHEN '' THEN 'unknown' WHEN 'Direct mapping' THEN 'simple' WHEN 'Calculate sum of amounts' THEN 'complex'
    WHEN 'Custom function' THEN 'very_complex' ELSE 'moderate' END AS mapping_complexity FROM m WHERE source_table <> '')"""

_FOLDERS: dict = {}


def sheet_folder(spark, sf_dir) -> str:
    """CSV folders written from the tables: parts (mapping sheets, commas), suppliers (;), nations (tabs)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FOLDERS:
        root = scratch_path(spark, "sheets")
        cells = sheet_cells(spark, sf_dir).repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey")
        cells.select(*[F.get("cells", F.lit(i)).alias(h) for i, h in enumerate(SHEET_HEADER)]).write.csv(
            f"{root}/parts", header=True, emptyValue="")
        table(spark, sf_dir, "supplier").select(
            "s_suppkey", "s_name", F.col("s_nationkey").alias(" s_nation "),
            F.round(F.col("s_acctbal") * 100).cast("bigint").alias("cents")).write.csv(
            f"{root}/suppliers", header=True, sep=";", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        table(spark, sf_dir, "nation").write.csv(f"{root}/nations", header=True, sep="\t")
        _FOLDERS[key] = root
    return _FOLDERS[key]


def documents(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    kind = (F.when(F.col("lang") == "en", "csv_row").when(F.col("lang") == "fr", "pdf_chunk")
            .when(F.col("lang") == "de", "data_mapping").otherwise("python"))
    described = F.when((F.col("lang") == "fr") & (F.col("doc_id") % 2 == 0), F.create_map(F.lit("description"), F.col("text"))) \
        .otherwise(F.expr("cast(map() as map<string,string>)"))
    return d.select(
        F.concat(F.lit("doc_"), key).alias("doc_id"), kind.alias("type"), F.col("source").alias("source_file"),
        F.col("text").alias("content"), F.lit(None).cast("string").alias("raw_text"),
        F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("doc_"), (F.col("doc_id") - F.col("doc_id") % 10).cast("string"))).alias("parent_document"),
        F.col("doc_id").cast("int").alias("row_number"),
        F.map_concat(F.create_map(F.lit("row_number"), key, F.lit("source_file"), F.col("source"),
                                  F.lit("node_type"), F.lit("shadow"), F.lit("lang"), F.col("lang")), described).alias("metadata"))


D = """d AS (SELECT 'doc_' || doc_id AS doc_id, doc_id AS n, CASE lang WHEN 'en' THEN 'csv_row' WHEN 'fr' THEN 'pdf_chunk'
  WHEN 'de' THEN 'data_mapping' ELSE 'python' END AS type, source AS source_file, text AS content, lang,
  CASE WHEN doc_id % 10 <> 0 THEN 'doc_' || (doc_id - doc_id % 10) END AS parent_document FROM documents)"""


def collection(spark, sf_dir) -> DataFrame:
    """Vector rows whose document is the text of the same number."""
    e = table(spark, sf_dir, "embeddings")
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return e.join(text, "vec_id", "left").select(
        F.col("vec_id").alias("id"), "embedding", F.coalesce("text", F.lit("")).alias("document"),
        F.create_map(F.lit("label"), F.col("label").cast("string"), F.concat(F.lit("k"), (F.col("vec_id") % 3).cast("string")),
                     F.lit("x")).alias("metadata"))


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


C = """c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label, coalesce(text, '') AS document
  FROM embeddings LEFT JOIN documents ON vec_id = doc_id)"""


def supply_edges(spark, sf_dir) -> DataFrame:
    """supplier -> part, weighted by ten times the mean discount (whole cents, so exact)."""
    line = table(spark, sf_dir, "lineitem")
    cents = F.sum(F.round(F.col("l_discount") * 100).cast("bigint"))
    return line.groupBy("l_suppkey", "l_partkey").agg(cents.alias("c"), F.count("*").alias("n")).select(
        F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("src"),
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("dst"),
        F.lit("supplies").alias("relationship_type"), (F.col("c") / (F.col("n") * F.lit(10.0))).alias("weight"))


def return_edges(spark, sf_dir) -> DataFrame:
    """part -> supplier, weighted by the share of returned lines; pairs without returns carry no weight."""
    line = table(spark, sf_dir, "lineitem")
    back = F.count_if(F.col("l_returnflag") == "R")
    return line.groupBy("l_suppkey", "l_partkey").agg(back.alias("r"), F.count("*").alias("n")).where("n > 1").select(
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("src"),
        F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("dst"),
        F.lit("returned_to").alias("relationship_type"),
        F.when(F.col("r") > 0, F.col("r") / F.col("n").cast("double")).alias("weight"))


def place_edges(spark, sf_dir, regions=True) -> DataFrame:
    """customer -> nation, supplier -> nation and nation -> region."""
    def edge(df, a, ka, b, kb):
        return df.select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("src"),
                         F.concat(F.lit(b), F.col(kb).cast("string")).alias("dst"),
                         F.lit("located_in").alias("relationship_type"), F.lit(1.0).alias("weight"))

    out = edge(table(spark, sf_dir, "customer"), "customer_", "c_custkey", "nation_", "c_nationkey").unionByName(
        edge(table(spark, sf_dir, "supplier"), "supplier_", "s_suppkey", "nation_", "s_nationkey"))
    return out.unionByName(edge(table(spark, sf_dir, "nation"), "nation_", "n_nationkey", "region_", "n_regionkey")) if regions else out


def nodes_of(spark, sf_dir, *kinds) -> DataFrame:
    keys = {"customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "part": "p_partkey"}
    out = None
    for kind in kinds:
        one = table(spark, sf_dir, kind).select(
            F.concat(F.lit(f"{kind}_"), F.col(keys[kind]).cast("string")).alias("id"), F.lit(kind).alias("node_type"),
            F.expr("cast(map() as map<string,string>)").alias("attrs"))
        out = one if out is None else out.unionByName(one)
    return out


SUPPLY = """supply AS (SELECT 'supplier_' || l_suppkey AS src, 'part_' || l_partkey AS dst, 'supplies' AS relationship_type,
  sum(CAST(round(l_discount * 100) AS BIGINT))::DOUBLE / (count(*) * 10.0::DOUBLE) AS weight FROM lineitem GROUP BY l_suppkey, l_partkey)"""
RETURNS = """returns AS (SELECT 'part_' || l_partkey AS src, 'supplier_' || l_suppkey AS dst, 'returned_to' AS relationship_type,
  CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN count(*) FILTER (l_returnflag = 'R')::DOUBLE / count(*)::DOUBLE END AS weight
  FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(*) > 1)"""
PLACE = """place AS (SELECT 'customer_' || c_custkey AS src, 'nation_' || c_nationkey AS dst, 'located_in' AS relationship_type, 1.0::DOUBLE AS weight FROM customer
  UNION ALL SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey, 'located_in', 1.0::DOUBLE FROM supplier
  UNION ALL SELECT 'nation_' || n_nationkey, 'region_' || n_regionkey, 'located_in', 1.0::DOUBLE FROM nation)"""


def sql_nodes(*kinds) -> str:
    keys = {"customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "part": "p_partkey"}
    return "nodes AS (" + " UNION ALL ".join(f"SELECT '{k}_' || {keys[k]} AS id, '{k}' AS node_type FROM {k}" for k in kinds) + ")"


def dictionary_pages(spark, sf_dir) -> DataFrame:
    """One dictionary page per part: definitions, code lists, domains, prose or blank."""
    part = table(spark, sf_dir, "part")
    size, key = F.col("p_size") % 5, F.col("p_partkey").cast("string")
    text = (
        F.when(size == 0, F.concat(
            F.lit("Functional Area: "), "p_type", F.lit("\nTable: PART_"), F.col("p_size").cast("string"),
            F.lit("\nPART_KEY_"), key, F.lit(" STRING identifier\nRETAIL_PRICE DECIMAL value")))
        .when(size == 1, F.concat(F.lit("Code and Description of "), "p_name"))
        .when(size == 2, F.concat(F.lit("domain "), F.lower("p_type"), F.lit(" overview of "), "p_name"))
        .when(size == 3, F.concat("p_name", F.lit(" in plain prose"))).otherwise("  \n "))
    return part.select("p_brand", F.concat("p_brand", F.lit(".pdf")).alias("source_file"),
                       F.col("p_partkey").alias("page_number"), text.alias("text"))


PAGES = """pg AS (SELECT p_brand || '.pdf' AS source_file, p_partkey AS page_number, CASE p_size % 5
  WHEN 0 THEN 'Functional Area: ' || p_type || chr(10) || 'Table: PART_' || p_size || chr(10) || 'PART_KEY_' || p_partkey
    || ' STRING identifier' || chr(10) || 'RETAIL_PRICE DECIMAL value'
  WHEN 1 THEN 'Code and Description of ' || p_name WHEN 2 THEN 'domain ' || lower(p_type) || ' overview of ' || p_name
  WHEN 3 THEN p_name || ' in plain prose' ELSE '  ' || chr(10) || ' ' END AS text FROM part)"""

# Pattern analysis of pages in SQL, on top of PAGES.
PA = PAGES + r""", px AS (SELECT *,
  coalesce(nullif(regexp_extract(text, '(?i)Functional\s+Area[:\s]+([A-Z][A-Z_]*)', 1), ''),
    nullif(regexp_extract(text, '(?i)Area[:\s]+([A-Z][A-Z_]*)', 1), ''), nullif(regexp_extract(text, '(?i)Domain[:\s]+([A-Z][A-Z_]*)', 1), ''), '') AS area,
  coalesce(nullif(regexp_extract(text, 'Table[:\s]+([A-Z][A-Z0-9_]*)', 1), ''), nullif(regexp_extract(text, '([A-Z][A-Z0-9_]+_DETAIL)', 1), ''),
    nullif(regexp_extract(text, '([A-Z][A-Z0-9_]+_DATA)', 1), ''), '') AS tab,
  list_filter(list_concat(regexp_extract_all(text, '([A-Z][A-Z0-9_]{3,})\s+[A-Z]', 1)[1:10], regexp_extract_all(text, '(?m)^([A-Z][A-Z0-9_]+)', 1)[1:10]),
    lambda x: length(x) > 3 AND contains(x, '_')) AS names FROM pg),
  pa AS (SELECT *, CASE WHEN tab <> '' OR len(names) > 0 THEN 'field_definitions' WHEN contains(text, 'Code') AND contains(text, 'Description') THEN 'code_mappings'
    WHEN area <> '' THEN 'table_definition' ELSE 'documentation' END AS kind,
    list_sort(list_distinct(list_filter(list_concat([area, tab], names), lambda x: x <> ''))) AS concepts FROM px),
  pd AS (SELECT *, 'Page ' || page_number || ': ' || kind || ' for ' || CASE WHEN area <> '' THEN area ELSE 'unknown area' END AS summary FROM pa)"""


def claims(spark, sf_dir) -> DataFrame:
    """Wide claims records, one per order, all strings and arrays of strings."""
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    money = F.concat(F.col("o_totalprice").cast("decimal(15,2)").cast("string"), F.lit("5"))

    def code(prefix, i, limit):
        return F.when(key % limit >= i, F.concat(F.lit(prefix), ((cust * i) % 1000).cast("string")))

    cols = {
        "CLM_ID": F.concat(F.lit("C"), key.cast("string")), "BENE_ID": cust.cast("string"), "PRVDR_NUM": F.col("o_orderstatus"),
        "ATT_PHYSN_NPI": F.col("o_orderpriority"), "OP_PHYSN_NPI": F.lit(None).cast("string"), "OTH_PHYSN_NPI": F.lit(None).cast("string"),
        "CLM_FROM_DT": F.when(key % 7 == 0, "2020134x").otherwise(day), "CLM_THRU_DT": day, "CLM_ADMSN_DT": F.lit(None).cast("string"),
        "NCH_BENE_DSCHRG_DT": day, "CLM_IP_ADMSN_TYPE_CD": (key % 4).cast("string"), "NCH_PTNT_STATUS_IND_CD": F.lit("A"),
        "CLM_DISP_CD": F.lit("01"), "CLM_PMT_AMT": F.when(key % 11 == 0, "n/a").otherwise(money), "CLM_TOT_CHRG_AMT": money,
        "NCH_BENE_PTB_DDCTBL_AMT": F.lit(""), "NCH_BENE_PTB_COINSRNC_AMT": F.lit("0.005"), "CLM_UTLZTN_DAY_CNT": (key % 30).cast("string"),
        "CLM_SRVC_CLSFCTN_TYPE_CD": F.lit("1"), "NCH_CLM_TYPE_CD": F.lit("40"),
        "PRNCPAL_DGNS_CD": F.when(key % 5 != 0, F.concat(F.lit("P"), (cust % 100).cast("string"))),
        "PRNCPAL_DGNS_VRSN_CD": F.lit("0"), "PRNCPAL_DGNS_POA_IND_SW": F.lit("Y"),
    }
    for i in range(1, 26):
        cols[f"ICD_DGNS_CD{i}"] = code("D", i, 4)
        cols[f"ICD_DGNS_VRSN_CD{i}"] = F.lit("0")
        cols[f"ICD_DGNS_POA_IND_SW{i}"] = F.lit("N")
        cols[f"ICD_PRCDR_CD{i}"] = code("R", i, 3)
        cols[f"ICD_PRCDR_VRSN_CD{i}"] = F.lit("0")
        cols[f"PRCDR_DT{i}"] = F.when(F.lit(i) == 2, "bad").otherwise(day)
    lines = F.sequence(F.lit(1).cast("bigint"), key % 3 + 1)
    shorter = F.slice(lines, 1, F.size(lines) - 1)
    for name in ["HCPCS_1ST_MDFR_CD", "HCPCS_2ND_MDFR_CD", "HCPCS_3RD_MDFR_CD", "HCPCS_4TH_MDFR_CD", "REV_CNTR_TOT_CHRG_AMT",
                 "REV_CNTR_NCVRD_CHRG_AMT", "REV_CNTR_DDCTBL_COINSRNC_CD", "REV_CNTR_NDC_QTY", "REV_CNTR_NDC_QTY_QLFR_CD"]:
        cols[name] = F.transform(lines, lambda i: i.cast("string"))
    cols["REV_CNTR_CD"] = F.transform(lines, lambda i: F.lpad(((cust * (i + 5)) % 900).cast("string"), 4, "0"))
    cols["HCPCS_CD"] = F.transform(shorter, lambda i: F.concat(F.lit("H"), (key + i).cast("string")))
    cols["REV_CNTR_UNIT_CNT"] = F.transform(lines, lambda i: F.concat(i.cast("string"), F.lit(".345")))
    cols["REV_CNTR_RATE_AMT"] = F.transform(lines, lambda i: F.concat((cust % 50 + i).cast("string"), F.lit(".10")))
    cols["REV_CNTR_PMT_AMT_AMT"] = F.transform(lines, lambda i: F.when(i == 2, F.lit("x")).otherwise(F.concat((cust % 70 + i).cast("string"), F.lit(".255"))))
    return o.select(*[c.alias(n) for n, c in cols.items()])
