import random
import re

from pyspark.sql import functions as F

from fieldloom.functions.text import entity_list, fixed, json_span, strip
from fieldloom.operators import chunks as CH
from fieldloom.operators import documents as DO


def expected_chunks(text, size=700, overlap=100):
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while at < len(text):
        piece, stop = text[at:at + size], at + size
        if stop < len(text):
            space = piece.rfind(" ")
            if space > size * 0.8:
                piece, stop = piece[:space], at + space
        out.append(piece.strip())
        at = stop - overlap
    return out


def texts():
    rng = random.Random(5)
    made = ["", " short ", "x" * 700, "x" * 701, "x" * 1300, "a " * 351, " " * 900, "é" * 1500]
    for n in (640, 699, 701, 760, 800, 801, 1299, 1300, 1301, 1400, 1401, 5000):
        made.append("".join(rng.choice("abcdeé \n\t\xa0") for _ in range(n)))
        made.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß" * 8 + " ") for _ in range(n)))
    return made


def test_chunker_against_restatement(spark):
    given = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(given)] + [(-1, None, "x")], "i int, text string, other string")
    for size, overlap in ((700, 100), (50, 10)):
        got = {}
        for r in CH.chunk_documents(df, size, overlap).orderBy("i", "chunk_id").collect():
            assert r.other == "x" and r.chunk_id == len(got.setdefault(r.i, []))
            got[r.i].append(r.chunk)
        assert got == {i: expected_chunks(text, size, overlap) for i, text in enumerate(given)}


def test_chunker_time_follows_the_length(spark):
    import time

    took = []
    for n in (1_000_000, 1_000_000, 4_000_000):  # the first run warms up
        df = spark.createDataFrame([("word " * (n // 5),)], "text string")
        start = time.perf_counter()
        assert CH.chunk_documents(df).count() > n / 700
        took.append(time.perf_counter() - start)
    assert took[2] < 10 * took[1] + 2


def test_strip_matches_python(spark):
    given = ["\xa0 a \u2003", "\x1cb\x85", " \t\n", "\ufeffx ", "a  b"]
    df = spark.createDataFrame([(g,) for g in given], "t string")
    assert [r[0] for r in df.select(strip("t")).collect()] == [g.strip() for g in given]


def test_fixed_rounds_like_python(spark):
    given = [0.125, 0.135, 0.375, 2.5, 0.165, 0.9995, 1.0, 0.12345]
    df = spark.createDataFrame([(g,) for g in given], "x double")
    assert [r[0] for r in df.select(fixed(F.col("x"), 2)).collect()] == [f"{g:.2f}" for g in given]
    assert [r[0] for r in df.select(fixed(F.col("x"), 3)).collect()] == [f"{g:.3f}" for g in given]


def test_json_span_and_entities(spark):
    df = spark.createDataFrame([('x {"a": {"b": 1}} y } z',), ("none",), ("{\n\"a\":1}",)], "t string")
    assert [r[0] for r in df.select(json_span(F.col("t"))).collect()] == ['{"a": {"b": 1}} y }', None, "{\n\"a\":1}"]
    one = spark.createDataFrame([(" a, ,b c,\t,",)], "t string")
    assert one.select(entity_list(F.col("t"))).first()[0] == ["a", "b c"]


def test_chunk_analysis(spark):
    text = "Claims overview and Description\nFunctional area: CLAIMS uses F19.980 and BADE_LOCK_TOKEN\nTable words here\n4\n5\nignoredword"
    a = spark.createDataFrame([(text,)], "t string").select(CH.chunk_analysis("t").alias("a")).first().a
    assert a.content_type == "data_dictionary" and a.has_table_data and a.has_codes
    assert a.functional_areas == ["claims"]
    assert a.description == "Claims overview and Description | Contains: F19.980, CLAIMS, BADE_LOCK_TOKEN | Area: claims, claims"
    assert a.key_terms == sorted({"F19.980", "CLAIMS", "BADE_LOCK_TOKEN", "Claims", "overview", "Functional", "words"})
    long = spark.createDataFrame([("w" * 150,)], "t string").select(CH.chunk_analysis("t").alias("a")).first().a
    assert long.description == "w" * 97 + "..." and not long.has_codes and long.content_type == "general"


def test_page_analysis(spark):
    cases = {
        1: "Functional Area: CLAIMS\nTable: CLAIM_DETAIL\nBENE_ID STRING beneficiary",
        2: "Code and Description list", 3: "area billing things", 4: "just prose", 5: "see PROVIDER_DATA rows",
    }
    df = spark.createDataFrame(list(cases.items()), "n int, t string")
    got = {r.n: r.p for r in df.select("n", CH.page_analysis("t", F.col("n")).alias("p")).collect()}
    assert got[1].functional_area == "CLAIMS" and got[1].table_name == "CLAIM_DETAIL" and got[1].content_type == "field_definitions"
    assert [f.field_name for f in got[1].fields] == ["CLAIM_DETAIL", "ENE_ID", "BENE_ID"]  # the first match of a pair eats the next letter
    assert got[2].content_type == "code_mappings" and got[3].content_type == "table_definition" and got[3].functional_area == "billing"
    assert got[4].content_type == "documentation" and got[4].summary == "Page 4: documentation for unknown area"
    assert got[5].table_name == "PROVIDER_DATA"


def test_page_description(spark):
    schema = ("page_number int, functional_area string, table_name string, summary string, key_concepts array<string>, "
              "fields array<struct<field_name:string,description:string>>")
    full = (3, "CLAIMS", "T", "sum", ["a", "b", "c", "d"], [("f1", "d1"), ("f2", ""), ("", "d3"), ("f4", "d4"), ("f5", None), ("f6", "d6")])
    empty = (7, "", None, "", [], [])
    df = spark.createDataFrame([(full, "raw"), (empty, "r" * 300)], f"m struct<{','.join(':'.join(p.split(' ', 1)) for p in schema.split(', '))}>, t string")
    got = [r[0] for r in df.select(DO.page_description(F.col("m"), F.col("t"))).collect()]
    assert got[0] == "Page 3 - Functional Area: CLAIMS. Table: T. Fields: f1, f2, f4, f5. Key concepts: a, b, c. Summary: sum. Descriptions: f1: d1 | : d3"
    assert got[1] == "Page 7: " + "r" * 200 + "..."


def test_chunk_pages_deal_numbers_not_heads(spark, monkeypatch):
    """The words of heads and pages are dealt out one by one, so heads are numbered and unique pages stored before."""
    stored, inner = {}, CH.materialise
    monkeypatch.setattr(CH, "materialise", lambda df, label: stored.setdefault(label, inner(df, label)))
    pages = spark.createDataFrame([("f", 1, "a b c d"), ("f", 2, "a b c d"), ("f", 3, "c d e f")], "source_file string, page_number int, text string")
    made = spark.createDataFrame([("f", 0, "b c d"), ("f", 1, "d e f"), ("f", 2, "b c d")], "source_file string, chunk_id int, chunk string")
    assert {r.chunk_id: r.pages for r in CH.chunk_pages(made, pages).collect()} == {0: [1], 1: [3], 2: [1]}
    assert stored["heads"].select("_head").distinct().count() == 2 and stored["pages"].count() == 2


def test_chunk_pages_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    pages = [(f"f{i % 3}", i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 80])))) for i in range(1, 60)]
    made = []
    for source, number, text in pages:
        for _ in range(3):
            at = rng.randrange(len(text))
            made.append((source, len(made), text[at:at + 400]))
        made.append((source, len(made), f"zzz\n--- Page {number} ---\n{text}\n--- Page 99 ---"))
        made += [(source, len(made) + n, c) for n, c in enumerate(["nowhere to be found", "", " \n", text[0], text[:2], "a eps", "q", "qq", "zzzz"])]
    chunk_df = spark.createDataFrame(made, "source_file string, chunk_id int, chunk string")
    page_df = spark.createDataFrame(pages, "source_file string, page_number int, text string")
    got = {r.chunk_id: r.pages for r in CH.chunk_pages(chunk_df, page_df).collect()}
    assert len(got) == len(made)
    for source, i, chunk in made:
        marks = [int(n) for n in re.findall(r"--- Page (\d+) ---", chunk)]
        inside = [n for s, n, t in pages if s == source and chunk[:200].strip() in t]
        assert got[i] == (marks or [min(inside)] if marks or inside else [1]), (i, chunk)


def test_assembled_chunks(spark):
    docs = spark.createDataFrame([("f", "\n--- Page 1 ---\nBENE_ID field " + "word " * 300)], "source_file string, text string")
    pages = spark.createDataFrame([("f", 1, "BENE_ID field " + "word " * 300)], "source_file string, page_number int, text string")
    got = CH.assemble_chunks(docs, pages).orderBy("chunk_id").collect()
    assert len(got) == len(expected_chunks(docs.first().text))
    assert got[0].pages == [1] and got[0].content_type == "data_dictionary" and got[1].pages == [1]


def test_script_inventory(spark):
    text = "import os, sys as s\nfrom a.b import c\nclass K:\n    def f(self, x):\n        y = 1\n        z == 2\nasync def g(a, b):\n    pass\n"
    got = sorted((r.line_number, r.kind, r.name, r.detail) for r in CH.source_inventory(spark.createDataFrame([("p", text)], "path string, text string")).collect())
    assert got == [(1, "import", "os", None), (1, "import", "sys", None), (2, "import", "a.b", "c"), (3, "class", "K", None), (4, "function", "f", "self, x"),
                   (5, "variable", "y", None), (7, "function", "g", "a, b")]
    counts = CH.inventory_counts(CH.source_inventory(spark.createDataFrame([("p", text)], "path string, text string"))).first()
    assert (counts.functions, counts.classes, counts.imports, counts.variables) == (2, 1, 3, 1)


def test_similarity_bands(spark):
    df = spark.createDataFrame([(0.95,), (0.9,), (0.8,), (0.7,), (0.71,)], "s double")
    assert [r[0] for r in df.select(DO.similarity_band(F.col("s"))).collect()] == [
        "Very high similarity", "High similarity", "Moderate similarity", "Low similarity", "Moderate similarity"]
