from pyspark.sql import functions as F

from fieldloom.operators import documents as DO
from fieldloom.operators import graph as G
from fieldloom.operators import mapping as MO

ROW = "source_file string, row_number bigint, header array<string>, cells array<string>, doc_id string"


def rows(spark, header, *cells):
    return spark.createDataFrame([("s.csv", n + 1, header, list(c), f"d{n}") for n, c in enumerate(cells)], ROW)


def names(spark, *headers):
    df = spark.createDataFrame([(h,) for h in headers], "h string")
    return {r[0]: r[1] for r in df.select("h", MO.normal_name(F.col("h"))).collect()}


def test_header_rules_first_match_wins(spark):
    got = names(spark, "Source Table", "SRC_COLUMN", "Destination Table", "Field Type", "Target Column", "Mappping Rules", "Data Type",
                "Long Desc", "Comments", "Row Key", "Source Field")
    assert got == {"Source Table": "source_table", "SRC_COLUMN": "source_column", "Destination Table": "target_table",
                   "Field Type": "target_field", "Target Column": "target_field", "Mappping Rules": "transformation_rule", "Data Type": "data_type",
                   "Long Desc": "description", "Comments": "description", "Row Key": "row_key", "Source Field": "source_column"}


def test_no_break_spaces(spark):
    header = ["Source\xa0Field", "Target\xa0Table", "Target\xa0Field", "Transformation"]
    cells = ("CLM_ID", "stg", "claim_id", "Direct\xa0mapping")
    plain = MO.normalise_rows(rows(spark, header, cells)).first()
    assert (plain.source_column, plain.target_table, plain.target_field, plain.transformation_rule) == ("CLM_ID", "stg", "claim_id", "Direct mapping")
    literal = MO.normalise_rows(rows(spark, header, cells), strict_compat=True).first()
    # the literal rule sees 'field' in both headers, so the last of them wins and no source column is found
    assert (literal.source_column, literal.target_field, literal.target_table) == ("", "claim_id", "")
    assert literal.metadata["target\xa0table"] == "stg"


def test_duplicate_names_keep_first_place_and_last_value(spark):
    made = MO.normalise_rows(rows(spark, ["Target Field", "X", "Field", "X"], ("a", "1", "b", "2")))
    got = made.first()
    assert got.target_field == "b"
    assert got.metadata["X"] == "2" and got.metadata["Target Field"] == "a"
    assert made.select(F.map_keys("metadata")).first()[0][:5] == ["Target Field", "X", "Field", "target_field", "x"]


def test_short_long_and_blank_cells(spark):
    got = MO.normalise_rows(rows(spark, ["Source Table", "", "Field"], ("t", "ignored"), ("t", "i", "f", "surplus"), ("  ", "\xa0", None))).orderBy("row_number").collect()
    assert [r.target_field for r in got] == ["", "f"]  # the blank row is gone, numbers stay
    assert [r.row_number for r in got] == [1, 2]
    assert got[0].relationship is None and got[1].relationship.source == "t."
    assert "" not in got[1].metadata


def test_metadata_and_row_text(spark):
    got = MO.normalise_rows(rows(spark, ["Source Table", "Source Column", "Field", "Rule"], ("t", "c", "f's", "")))
    text = got.select(DO.row_text("metadata")).first()[0]
    assert text == ("Source Table: t Source Column: c Field: f's source_table: t source_column: c target_field: f's _row_number: 1 _source_file: s.csv "
                    "_mapping_type: data_mapping _has_source_table: True _has_target_field: True "
                    "_mapping_relationship: {'source': 't.c', 'target': \"f's\", 'transformation': '', 'data_type': '', 'description': ''}")


def test_plain_rows(spark):
    got = MO.row_maps(rows(spark, [" a ", "b", "a"], (" 1 ", "2", "3"))).first().metadata
    assert got == {"a": "3", "b": "2", "_row_number": "1", "_source_file": "s.csv"}


def test_complexity_classes(spark):
    rules = {"": "unknown", None: "unknown", "Direct mapping": "simple", "AS-IS": "simple", "join on id": "moderate", "Summarise": "complex",
             "Multiple rows, with procedure_sequence": "very_complex", "Convert to decimal(15,2)": "moderate", "lookup and sum": "moderate"}
    df = spark.createDataFrame([(r,) for r in rules], "r string")
    assert {x[0]: x[1] for x in df.select("r", MO.mapping_complexity(F.col("r"))).collect()} == rules


def mapped(spark):
    return MO.normalise_rows(rows(
        spark, ["Source Table", "Source Column", "Field", "Rule"],
        ("claims.a", "AMT", "paid_amount", "Direct copy"), ("claims.a", "AMT", "total", "sum of lines"), ("", "X", "paid_date", ""),
        ("claims.a", "AMT", "paid_amount", "custom")))


def test_edges_and_graph(spark):
    edges = {r.doc_id: r for r in MO.mapping_edges(mapped(spark)).collect()}
    assert set(edges) == {"d0", "d1", "d3"}
    assert edges["d0"].src == "source_claims_a_AMT" and edges["d0"].dst == "target_paid_amount"
    assert edges["d0"].is_direct_mapping and not edges["d0"].requires_transformation
    assert edges["d1"].requires_transformation and edges["d1"].mapping_complexity == "complex"
    nodes, links = MO.mapping_graph(mapped(spark))
    made = {r.id: r for r in G.upsert_nodes(nodes).collect()}
    assert set(made) == {"source_claims_a_AMT", "target_paid_amount", "target_total"}
    assert made["source_claims_a_AMT"].attrs["table_column"] == "claims.a.AMT"
    kept = {(r.src, r.dst): r for r in G.upsert_edges(links).collect()}
    assert len(kept) == 2 + 6
    assert kept[("source_claims_a_AMT", "target_paid_amount")].attrs["mapping_complexity"] == "very_complex"  # the later row wins


def test_lineage_and_filters(spark):
    edges = MO.mapping_edges(mapped(spark))
    got = sorted(tuple(r) for r in MO.field_lineage(edges, "AMO").collect())
    assert [(g[0], g[1]) for g in got] == [("upstream", "claims.a.AMT")] * 2
    assert MO.field_lineage(edges, "amt").where("direction = 'downstream'").count() == 3
    assert MO.mapping_relationships(edges, "claims.a", "paid").count() == 2
    assert MO.mapping_relationships(edges, "claims.a", "Paid").count() == 0


def test_term_links(spark):
    sheet = spark.createDataFrame([("m1", " BENE_ID ", "t", "f"), ("m2", "x", "t", "f"), ("m3", " ", "t", "f")],
                                  "id string, source_column string, source_table string, target_field string")
    pages = spark.createDataFrame([("p1", ["bene_id", "Bene_Id ", "", None]), ("p2", ["y"]), ("p3", ["BENE_ID", "X"])], "id string, key_terms array<string>")
    got = sorted((r.src, r.dst, r.matched_term) for r in MO.link_terms(sheet, pages).collect())
    assert got == [("m1", "p1", "Bene_Id "), ("m1", "p3", "BENE_ID"), ("m2", "p3", "X")]


def test_source_column_spellings(spark):
    df = spark.createDataFrame([({"source_column": "", "Source Field": "b"},), ({"\ufeffSource\xa0Field": "a", "Source Field": "b"},), ({"z": "1"},)], "m map<string,string>")
    assert [r[0] for r in df.select(MO.resolve_source_column(F.col("m"))).collect()] == ["b", "b", None]


def test_rows_are_dealt_to_every_core_and_headers_are_the_small_side(spark, tmp_path):
    """One split of many rows goes to all cores, and the rows are not what is sent to every task."""
    path = str(tmp_path / "rows")
    header = F.array(*[F.lit(h) for h in ("Source Table", "Source Column", "Mapping Rules", "Field")])
    spark.range(20000, numPartitions=1).select(F.lit("a.csv").alias("source_file"), F.col("id").alias("row_number"), F.col("id").cast("string").alias("doc_id"), header.alias("header"),
                                               F.array(F.lit("t"), F.concat(F.lit("c"), "id"), F.lit("Direct"), F.lit("f")).alias("cells")).write.parquet(path)
    made = MO.normalise_rows(spark.read.parquet(path))
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() >= spark.sparkContext.defaultParallelism
    assert made.count() == 20000 and made.where("relationship.source = 't.c77'").count() == 1
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "/headers-" in made.inputFiles()[0] + made.inputFiles()[-1] or "headers-" in plan


def test_term_links_shuffle_terms_only_and_keep_the_least_spelling(spark):
    sheet = spark.createDataFrame([("m1", "Fld_1", "t", "x"), ("m1", "Fld_1", "t", "x"), ("m2", " fld_1", None, "y"), ("m3", " ", "t", "z"), ("m4", "other", "t", "z")],
                                  "id string, source_column string, source_table string, target_field string")
    pages = spark.createDataFrame([("p1", ["fld_1", " FLD_1 ", None, " "]), ("p1", ["FLD_1", "no"]), ("p2", ["Fld_1", "Fld_1"]), (None, ["fld_1"]), ("p3", None)], "id string, key_terms array<string>")
    made = MO.link_terms(sheet, pages)
    want = [(m, p, t, w) for m, t in (("m1", "t"), ("m2", None)) for p, w in (("p1", " FLD_1 "), ("p2", "Fld_1"), (None, "fld_1"))]
    assert sorted(str((r.src, r.dst, r.source_table, r.matched_term)) for r in made.collect()) == sorted(map(str, want))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [" in line and "matched_term" in line and "target_field" in line for line in plan.splitlines())
