from pyspark.sql import functions as F

from fieldloom.operators.ingest import process_files
from fieldloom.sources.files import parse_csv, read_csv_cells

SHEET = "Source Table,Source Column,Target Field\nclaims,amount,paid_amount\nclaims,day,service_date\n"
NAMES = ["claims_mapping document.csv", "50% off.csv", "a#b.csv", "c+d.csv", "größe é.csv"]


def test_file_names_of_all_kinds(spark, tmp_path):
    for name in NAMES:
        (tmp_path / name).write_text(SHEET, encoding="utf-8")
    (tmp_path / "my script.py").write_text("import os\n\ndef f():\n    pass\n")
    (tmp_path / "b.py").write_text("x = 1\n")
    plain, sheet = parse_csv(spark, str(tmp_path))
    rows = plain.select("source_file").unionByName(sheet.select("source_file")).groupBy("source_file").count().collect()
    assert {r.source_file: r["count"] for r in rows} == {n: 2 for n in NAMES}
    docs = process_files(spark, str(tmp_path)).collect()
    ids = {d.doc_id for d in docs if d.type in ("csv_summary", "python")}
    assert len(ids) == 7 and sum(d.type == "csv_row" for d in docs) == 10
    assert {d.source_file.rsplit("/", 1)[-1] for d in docs} == {*NAMES, "my script.py", "b.py"}


def test_header_with_a_line_break_in_quotes(spark, tmp_path):
    (tmp_path / "odd.csv").write_text('"Source\nTable",Source Column,Target Field,Rule\nclaims,amount,paid,"a, b"\n')
    (tmp_path / "plain.csv").write_text("a,b\n1,2\n")
    got = {r.source_file: (r.header, r.cells) for r in read_csv_cells(spark, str(tmp_path)).collect()}
    assert got["odd.csv"] == (["Source\nTable", "Source Column", "Target Field", "Rule"], ["claims", "amount", "paid", "a, b"])
    assert got["plain.csv"] == (["a", "b"], ["1", "2"])


def test_only_one_delimiter_is_read_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("x;y\n1;2\n")
    (tmp_path / "c.csv").write_text("x\ty\n1\t2\n")
    rows = read_csv_cells(spark, str(tmp_path))
    assert rows.groupBy("source_file").agg(F.count("*").alias("n"), F.max("row_number").alias("m")).count() == 3
    assert all(len(r.cells) == 2 for r in rows.collect())
