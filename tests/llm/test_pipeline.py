import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fieldloom.llm import order_minhash

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage was given and returned, over the smallest tables."""
    from fieldloom.session import ensure_scratch, materialise

    ensure_scratch(spark)
    docs, out = spark.read.parquet(f"{SMOKE}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = materialise(stage(spark, docs, SMOKE), "test")
        out.append((name, docs, result))
        docs = result
    return out


def test_columns_and_rows(spark, stages):
    columns = spark.read.parquet(f"{SMOKE}/documents.parquet").schema
    for name, given, result in stages[:-1]:
        assert result.schema == columns, name
        assert result.join(given, "doc_id", "left_anti").isEmpty()
    assert [n for n, _, _ in stages] == ["quality classifier", "line dedup", "MinHash near-dedup", "PII", "best-fit packing"]


def test_decisions_take_effect(spark, stages):
    by_name = {name: (given, result) for name, given, result in stages}
    labels = spark.read.parquet(f"{SMOKE}/labels.parquet").where("quality = 1")
    given, result = by_name["quality classifier"]
    assert result.count() < given.count() and given.join(labels, "doc_id").count() * 0.97 <= result.join(labels, "doc_id").count()
    given, result = by_name["line dedup"]
    assert result.count() == given.count() and result.selectExpr("sum(n_chars)").first()[0] < given.selectExpr("sum(n_chars)").first()[0]
    given, result = by_name["MinHash near-dedup"]
    assert result.count() == order_minhash.classes(given).select("class_id").distinct().count() < given.count()
    given, result = by_name["PII"]
    assert result.count() == given.count() and result.where("text rlike '<(EMAIL|PHONE|CARD|IP)>'").count() > 0
    given, result = by_name["best-fit packing"]
    assert result.select("doc_id").distinct().count() == given.count()


def test_run_is_the_stages(spark, stages):
    order = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = entry.queries()["pipeline"](spark, SMOKE).select(order)
    last = stages[-1][2].select(order)
    assert whole.exceptAll(last).isEmpty() and last.exceptAll(whole).isEmpty()


def test_tables_without_rows(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMOKE).count() == 0, name


@pytest.mark.parametrize("name", ["op4_personal_data", "op6_exact_top_k", "op9_url_verdicts"])
def test_queries_against_sql(spark, name):
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
    import check

    db = duckdb.connect()
    for f in glob.glob(f"{SMOKE}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = entry.queries()[name](spark, SMOKE)
    cursor = db.execute(entry.oracle_sql()[name])
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of([c[0] for c in cursor.description], cursor.fetchall())


def test_one_query_an_operator():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
