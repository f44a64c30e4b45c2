from fieldloom.operators.ingest import page_terms, process_files
from fieldloom.operators.mapping import link_terms
from pyspark.sql import functions as F


def test_folder_to_documents(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")

    write("a/map.csv", "Source Table,Source Column,Field\nclaims,BENE_ID,patient_id\n,,\nclaims,AMT,paid\n")
    write("b/empty.csv", "x;y\n")
    write("b/plain.csv", "x;y\n1;2\n")
    write("c/job.py", "import os\ndef f(a):\n    b = 1\n")
    write("c/dict.pdf", "binary")
    path = str(tmp_path / "c" / "dict.pdf")
    pages = spark.createDataFrame([(path, 1, "Table: CLAIM_DETAIL\nBENE_ID STRING x"), (path, 2, " "), (path, 3, "plain")], "source_file string, page_number int, text string")
    docs = process_files(spark, str(tmp_path), pages)
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {"csv_0", "csv_0_row_0", "csv_0_row_1", "csv_1", "csv_2", "csv_2_row_0", "pdf_3", "pdf_3_page_1", "pdf_3_page_3", "python_4"}
    assert got["csv_0_row_1"].metadata["_row_number"] == "3" and got["csv_0_row_1"].row_number == 1
    assert got["csv_1"].content == "CSV file with 0 rows. Fields: No data"
    assert got["csv_2_row_0"].content == "x: 1 y: 2 _row_number: 1 _source_file: plain.csv"
    assert got["pdf_3"].content == "\n--- Page 1 ---\nTable: CLAIM_DETAIL\nBENE_ID STRING x\n--- Page 3 ---\nplain"
    assert got["pdf_3_page_1"].parent_document == "pdf_3" and got["pdf_3_page_1"].metadata["table_name"] == "CLAIM_DETAIL"
    assert got["python_4"].metadata == {"functions": "1", "classes": "0", "imports": "1", "variables": "1"}
    sheet = docs.where("metadata['_mapping_type'] = 'data_mapping'").select(
        F.col("doc_id").alias("id"), F.col("metadata")["source_column"].alias("source_column"),
        F.col("metadata")["source_table"].alias("source_table"), F.col("metadata")["target_field"].alias("target_field"))
    assert [(r.src, r.dst, r.matched_term) for r in link_terms(sheet, page_terms(docs)).collect()] == [("csv_0_row_0", "pdf_3_page_1", "BENE_ID")]
