import json
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.functions.numbering import number_rows
from fieldloom.operators import collection as CO
from fieldloom.operators import documents as DO
from fieldloom.sources import csv_splits, files, pages, stores


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode("utf-8"))
    return path


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("sheets")
    write(root, "claims/sheet.csv", "\ufeffSource\xa0Field,Target\xa0Table,Target\xa0Field,Transformation\r\n"
          "CLM_ID,stg,claim_id,Direct\xa0mapping\r\n\r\n,,,\r\nAMT,stg,paid,\"Convert to decimal(15,2)\"\r\n")
    write(root, "plain/semi.csv", "p;q;\n 1 ;two\n3;\"a;b\nc\"\n")
    write(root, "plain/tab.csv", "k\tv\n1\tx\n")
    write(root, "plain/wide.csv", "a,b,c,d\n1,2,3\n5,6,7,8,9\n")
    write(root, "late/late.csv", "id,v\n1,x\n2,a mapping\n")
    write(root, "other/readme.CSV", "not a csv by suffix")
    write(root, "other/job.py", "import os\n")
    write(root, "other/doc.pdf", "%PDF")
    return str(root)


def test_catalogue(spark, folder):
    counts = {r.file_class: r.files for r in files.files_per_class(files.find_files(spark, folder)).collect()}
    assert counts == {"csv": 5, "python": 1, "pdf": 1, "other": 1, "total": 8}
    ids = [r.doc_id for r in files.file_ids(files.find_files(spark, folder)).orderBy("path").collect()]
    assert sorted(ids) == ["csv_0", "csv_1", "csv_2", "csv_3", "csv_4", "pdf_5", "python_6"]


def test_profile(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: (r.delimiter, r.is_mapping) for r in files.csv_profile(spark, folder).collect()}
    assert got == {"sheet.csv": (",", True), "semi.csv": (";", False), "tab.csv": ("\t", False), "wide.csv": (",", False), "late.csv": (",", True)}


def test_plain_rows(spark, folder):
    plain, _ = files.parse_csv(spark, folder)
    got = {(r.source_file, r.row_number): r.metadata for r in plain.collect()}
    extra = {"_source_file": "semi.csv"}
    assert got[("semi.csv", 1)] == {"p": "1", "q": "two", "_row_number": "1", **extra}
    assert got[("semi.csv", 2)] == {"p": "3", "q": "a;b\nc", "_row_number": "2", **extra}
    assert got[("tab.csv", 1)]["v"] == "x"
    assert {k: v for k, v in got[("wide.csv", 1)].items() if k[0] != "_"} == {"a": "1", "b": "2", "c": "3", "d": ""}
    assert {k: v for k, v in got[("wide.csv", 2)].items() if k[0] != "_"} == {"a": "5", "b": "6", "c": "7", "d": "8"}


def test_mapping_rows(spark, folder):
    _, sheet = files.parse_csv(spark, folder)
    got = {(r.source_file, r.row_number): r for r in sheet.collect()}
    # the empty line has no number, the line of delimiters has one but no row
    assert set(got) == {("sheet.csv", 1), ("sheet.csv", 3), ("late.csv", 1), ("late.csv", 2)}
    assert got[("sheet.csv", 1)].source_column == "CLM_ID" and got[("sheet.csv", 3)].transformation_rule == "Convert to decimal(15,2)"
    assert got[("sheet.csv", 1)].target_table == "stg"


def test_surplus_cells_and_open_quotes_are_told(spark, folder, tmp_path):
    cells, errors = files.read_csv(spark, folder)
    assert {(r.source_file, r.row_number, r.reason, r.kept, tuple(r.surplus), r.text) for r in errors.collect()} == {("wide.csv", 2, "surplus cells", True, ("9",), "5,6,7,8,9")}
    write(tmp_path, "good.csv", "a,b\n1,2\n")
    write(tmp_path, "open.csv", 'a,b\n1,2\n3,"4\n5,6\n')
    write(tmp_path, "empty.csv", "")
    write(tmp_path, "blank.csv", "\n\n,,\n")
    cells, errors = files.read_csv(spark, str(tmp_path))
    assert {(r.source_file, r.row_number, *r.cells) for r in cells.collect()} == {("good.csv", 1, "1", "2"), ("open.csv", 1, "1", "2"), ("open.csv", 2, "3", "4\n5,6")}
    assert [(r.source_file, r.row_number, r.reason, r.text) for r in errors.collect()] == [("open.csv", 2, "unclosed quote", '3,"4\n5,6')]


def odd_rows(count, seed):
    draw = random.Random(seed)
    parts = ["x", "", "two words", '"q"', '"a,b"', '"line\nbreak"', '"two\n\nbreaks, and ""quotes"""', '5" pipe', '"late"x', '""', '"\n"', "\u00e9"]
    return [",".join([str(i), *draw.choices(parts, k=3)]) for i in range(count)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_splits_give_the_rows_of_one_task(spark, tmp_path, end):
    """The same file in many splits, in one, and read by Spark's own reader in one task."""
    rows = odd_rows(3000, 5)
    write(tmp_path, "big.csv", end.join(["id,a,b,c", *rows[:700], '1,"' + "long\n" * 4000 + '",x,y', *rows[700:]]) + end)
    want = [tuple(r) for r in spark.read.schema("c0 string, c1 string, c2 string, c3 string").options(multiLine=True, quote='"', escape='"').csv(str(tmp_path)).collect()][1:]
    for size in ("1500", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            cells = files.read_csv_cells(spark, str(tmp_path))
            got = sorted((r.row_number, *r.cells) for r in cells.collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [g[1:] for g in got] == want and [g[0] for g in got] == list(range(1, len(want) + 1))


def test_a_record_without_end_is_told_piece_by_piece(spark, tmp_path):
    write(tmp_path, "bad.csv", "a,b\n1,2\n" + '3,"' + "no end\n" * 2000)
    write(tmp_path, "good.csv", "a,b\n1,2\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = csv_splits.read_records(spark, str(tmp_path), files.plain_path, longest=5000).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.source_file, r.row_number) for r in found if r.reason is None) == [("bad.csv", 1), ("good.csv", 1)]
    pieces = [r.text for r in found if r.reason == "record too long"]
    assert len(pieces) > 2 and sum(p.count("no end") for p in pieces) == 2000


def test_file_summary(spark, folder):
    plain, _ = files.parse_csv(spark, folder)
    got = {r.source_file: r.content for r in DO.file_summaries(plain).collect()}
    assert got["tab.csv"] == "CSV file with 1 rows. Fields: k, v, _row_number, _source_file"


def test_rows_of_split_files_are_numbered(spark, tmp_path):
    write(tmp_path, "big.csv", "id,v\n" + "".join(f"{i:06d},x\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        assert csv_splits.file_lines(spark, str(tmp_path), files.plain_path).select("block").distinct().count() > 2
        rows = files.read_csv_cells(spark, str(tmp_path))
        assert rows.count() == 20000 and rows.where(F.col("row_number") != F.col("cells")[0].cast("int") + 1).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pages(spark):
    p = spark.createDataFrame([("f", 1, "one"), ("f", 2, " \xa0\n"), ("f", 3, "three"), ("g", 1, "")], "source_file string, page_number int, text string")
    assert {r.source_file: r.text for r in pages.full_text(p).collect()} == {"f": "\n--- Page 1 ---\none\n--- Page 3 ---\nthree"}
    assert {(r.source_file, r.num_pages, r.content_pages) for r in pages.page_counts(p).collect()} == {("f", 3, 2), ("g", 1, 0)}
    with pytest.raises(Exception, match="too long"):
        pages.full_text(p, max_chars=10).collect()


def test_graph_round_trip_and_defaults(spark, tmp_path):
    text = json.dumps({"nodes": [{"id": "a", "node_type": "field", "n": 3}, {"id": "b"}],
                       "edges": [{"source": "a", "target": "b"}, {"source": "b", "target": "a", "relationship_type": "r", "weight": 0.5, "note": "x"}]})
    nodes, edges = stores.graph_from_objects(spark.createDataFrame([(text,)], "value string"))
    assert {(r.id, r.node_type, tuple(r.attrs.items())) for r in nodes.collect()} == {("a", "field", (("n", "3"),)), ("b", "unknown", ())}
    assert {(r.src, r.relationship_type, r.weight) for r in edges.collect()} == {("a", "unknown", 1.0), ("b", "r", 0.5)}
    stores.save_graph(nodes, edges, str(tmp_path / "g"))
    again_nodes, again_edges = stores.load_graph(spark, str(tmp_path / "g"))
    assert sorted(map(str, again_nodes.collect())) == sorted(map(str, nodes.collect()))
    assert sorted(map(str, again_edges.collect())) == sorted(map(str, edges.collect()))


def test_collection_round_trip(spark, tmp_path):
    c = spark.createDataFrame([("a", [1.0, 2.0], "text", {"k": "v"}), ("b", None, "t", {}), ("c", [], None, None)],
                              "id string, embedding array<float>, document string, metadata map<string,string>")
    header = stores.export_collection(c, "main", str(tmp_path / "c")).first()
    assert header.total_documents == 3
    got = stores.import_collection(spark, str(tmp_path / "c")).collect()
    assert [(r.id, r.embedding, r.doc_length) for r in got] == [("a", [1.0, 2.0], 4)]


def test_keyed_documents(spark, tmp_path):
    write(tmp_path, "d.json", json.dumps({"doc_0": {"type": "csv_row", "content": "x", "metadata": {"a": 1}}, "doc_1": {"type": "pdf"}}))
    got = {r.doc_id: r for r in stores.load_keyed_documents(spark, str(tmp_path / "d.json")).collect()}
    assert got["doc_0"].metadata == {"a": "1"} and got["doc_1"].content is None


def test_staging_append_counts_and_merges(spark, tmp_path):
    path = str(tmp_path / "s")
    assert stores.append_staging(spark.range(3).withColumnRenamed("id", "a"), path) == 3
    assert stores.append_staging(spark.range(2).selectExpr("id as a", "id as b"), path) == 2
    got = stores.read_staging(spark, path)
    assert got.count() == 5 and got.where("b is null").count() == 3


@pytest.mark.parametrize("hot_rows", [1_000_000, 5, 0])
def test_numbering_inside_groups(spark, hot_rows):
    df = spark.range(1000).selectExpr("if(id % 3 = 0, null, id % 7) as g", "(id * 37) % 1000 as v")
    got = number_rows(df, ["v"], ["g"], "n", hot_rows=hot_rows).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r.v):
        seen.setdefault(r.g, []).append(r.n)
    assert len(got) == 1000 and all(v == list(range(1, len(v) + 1)) for v in seen.values())


def test_numbering_of_whole_table(spark):
    got = number_rows(spark.range(500).selectExpr("(id * 7) % 500 as v"), ["v"]).collect()
    assert all(r.row_number == r.v + 1 for r in got) and len(got) == 500


def test_stored_collection_versions(spark, tmp_path):
    schema = "id string, embedding array<float>, document string, metadata map<string,string>, ts timestamp, doc_length int"
    path, export = str(tmp_path / "c"), str(tmp_path / "e")
    one = spark.createDataFrame([("a", [1.0], "one", {}, None, 3), ("b", [2.0], "two", {}, None, 3)], schema)
    assert stores.latest_version(spark, path) == 0
    with pytest.raises(ValueError):
        stores.stored_collection(spark, path)
    assert stores.store_collection(one, path) == 1
    assert stores.store_collection(stores.stored_collection(spark, path).where("id = 'a'"), path) == 2
    assert stores.store_collection(stores.stored_collection(spark, path).where("false"), path) == 3
    assert [stores.stored_collection(spark, path, v).count() for v in (1, 2, 3)] == [2, 1, 0] and stores.stored_collection(spark, path).isEmpty()
    more = spark.createDataFrame([("a", [9.0], "other", {}, None, 5), ("c", [3.0], "three", {}, None, 5)], schema)
    stores.export_collection(more, "more", export)
    stores.store_collection(one, path)
    stores.import_into(spark, export, path)
    assert {r.id: r.document for r in stores.stored_collection(spark, path).collect()} == {"a": "one", "b": "two", "c": "three"}
    assert stores.import_into(spark, export, path, overwrite=True) == 6
    assert {r.id: r.document for r in stores.stored_collection(spark, path).collect()} == {"a": "other", "c": "three"}


def test_segments_read_like_the_rewritten_collection(spark, tmp_path):
    rng, path = random.Random(5), str(tmp_path / "c")
    schema = "id string, embedding array<float>, document string, metadata map<string,string>"

    def rows(n, ids):
        return spark.createDataFrame([(rng.choice(ids), rng.choice([[1.0], [2.0], None]), rng.choice(["x", "y", None]), rng.choice([{"k": "1"}, None])) for _ in range(n)], schema)

    def seen(df):
        return sorted(map(str, df.collect()))

    ids = [f"i{n}" for n in range(12)]
    whole = CO.add_batch(rows(0, ids), rows(20, ids)).unionByName(spark.createDataFrame([(None, [3.0], "no id", None)], schema)).unionByName(
        spark.createDataFrame([("i3", [4.0], "a second i3", None)], schema))
    whole = spark.createDataFrame(whole.collect(), schema)
    stores.store_collection(whole, path)
    want = [seen(whole)]
    for round in range(6):
        if round % 3 == 0:
            change = spark.createDataFrame(rows(6, ids + ["j1", "j2", "j3", None]).collect(), schema)
            whole, number = CO.add_batch(whole, change), stores.add_to_stored(spark, path, change)
        elif round % 3 == 1:
            change = spark.createDataFrame([(i, rng.choice(["new", None]), f"extra {i}") for i in rng.sample(ids, 4) + ["absent"]], "id string, document string, surplus string")
            whole, number = CO.update(whole, change), stores.update_stored(spark, path, change)
        else:
            change = spark.createDataFrame([(i,) for i in rng.sample(ids, 3) * 2 + ["absent", None]], "id string")
            whole, number = CO.delete(whole, change), stores.delete_stored(spark, path, change)
        whole = spark.createDataFrame(whole.collect(), schema)
        want.append(seen(whole))
        assert number == len(want) and seen(stores.stored_collection(spark, path)) == want[-1]
    assert stores.n_segments(spark, path) == 6 and stores.compact(spark, path) == 8
    assert stores.n_segments(spark, path) == 0 and stores.compact(spark, path) == 8 and stores.stored_collection(spark, path).schema == whole.schema
    assert [seen(stores.stored_collection(spark, path, v + 1)) for v in range(8)] == want + want[-1:]
    with pytest.raises(ValueError):
        stores.stored_collection(spark, path, 9)


def test_a_change_writes_no_more_than_itself(spark, tmp_path):
    path = str(tmp_path / "c")
    big = spark.range(20000).select("id", F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("embedding"), F.lit("t").alias("row"))
    stores.store_collection(big, path)
    for number, change in ((2, stores.delete_stored(spark, path, big.where("id < 3"))), (3, stores.update_stored(spark, path, big.where("id < 5").withColumn("row", F.lit("u"))))):
        assert change == number and spark.read.parquet(f"{path}/d{number}").count() == {2: 3, 3: 2}[number]
    got = stores.stored_collection(spark, path)
    assert got.count() == 19997 and got.where("row = 'u'").count() == 2
    with pytest.raises(ValueError):
        stores.delete_stored(spark, str(tmp_path / "none"), big)


def test_repeated_load_leaves_counts(spark, tmp_path):
    path = str(tmp_path / "s")
    for _ in range(2):
        assert stores.append_staging(spark.range(3).toDF("a"), path, "2025-09-02") == 3
    stores.append_staging(spark.range(2).toDF("a"), path, "2025-09-03")
    got = stores.read_staging(spark, path)
    assert got.columns == ["a"] and got.count() == 5


@pytest.mark.parametrize("breaks", [False, True])
def test_wide_header(spark, tmp_path, breaks):
    names = [f"column_{i:03d}" for i in range(300)]
    head = [f'"{n}\nmore"' if breaks and i % 100 == 99 else n for i, n in enumerate(names)]
    write(tmp_path, "wide.csv", ",".join(head) + "\n" + ",".join(str(i) for i in range(300)) + "\n")
    write(tmp_path, "narrow.csv", "a,b\n1,2\n")
    got = {r.source_file: r for r in files.read_csv_cells(spark, str(tmp_path)).collect()}
    assert [h.split("\n")[0] for h in got["wide.csv"].header] == names and got["wide.csv"].cells == [str(i) for i in range(300)]
    assert got["narrow.csv"].cells == ["1", "2"]
