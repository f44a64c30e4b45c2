import json
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from fieldloom.operators import claims as CL
from fieldloom.operators import prompts as PR
from fieldloom.operators import responses as MR
from fieldloom.operators import retrieval as RO


def replies(spark, *texts):
    return spark.createDataFrame([(f"d{i}", f"e{i}", t) for i, t in enumerate(texts)], "src string, dst string, response string")


def test_array_replies(spark):
    body = json.dumps([{"source_doc": "a", "target_doc": "b", "relationship_type": "dataflow", "relationship_name": "feeds", "strength": 0.8, "explanation": "x"},
                       {"source_doc": "a", "target_doc": "c"}, {"source_doc": "", "target_doc": "c"}, {"target_doc": "c"}])
    got = [tuple(r) for r in MR.relation_edges(replies(spark, body, "free text", "[broken", None)).collect()]
    assert got == [("a", "b", "ai_dataflow", 0.8, "feeds", "x"), ("a", "c", "ai_semantic", 0.5, "related_to", "")]


def test_pair_replies(spark):
    def body(confidence, has=True):
        return "Sure. " + json.dumps({"has_relationship": has, "relationship_type": "causal", "confidence": confidence, "explanation": "e"}) + " bye"

    got = [tuple(r) for r in MR.accepted_pairs(replies(spark, body(0.6), body(0.61), body(0.9, False), "no", "{bad}", None)).collect()]
    assert got == [("d1", "e1", "ai_causal", 0.61, "e")]


def test_free_replies(spark):
    got = {r.src: r for r in MR.pair_reviews(replies(spark, "w" * 300, '{"relationship_type": "mapping", "strength": 0.9}', "{bad", "{bad}", "", None)).collect()}
    assert set(got) == {"d0", "d1", "d2"}
    assert got["d0"].description == "w" * 200 and got["d0"].relationship_type == "unknown" and got["d0"].strength == 0.5 and got["d0"].key_connections == []
    assert got["d1"].relationship_type == "mapping" and got["d2"].description == "{bad"


def test_page_replies(spark):
    good = 'x {"content_type": "table_definition", "functional_area": "A", "fields": [{"field_name": "F1"}], "key_concepts": ["k"]}'
    df = spark.createDataFrame([("f", 1, "Table: T_X", good), ("f", 2, "Table: T_X", "{bad}"), ("f", 3, "Table: T_X", None)],
                               "source_file string, page_number int, text string, response string")
    got = {r.page_number: r.page for r in MR.page_metadata(df).collect()}
    assert got[1].analysis_method == "llm_powered" and got[1].fields[0].field_name == "F1" and got[1].page_number == 1
    assert got[2].analysis_method == got[3].analysis_method == "pattern_based" and got[2].table_name == "T_X"


def test_mapping_replies(spark):
    got = [(r.src, r.source_field, r.target_field) for r in MR.mapping_suggestions(replies(spark, 'so: {"a": "x", "b": null}', "none")).collect()]
    assert got == [("d0", "a", "x"), ("d0", "b", None)]


def test_reply_shapes(spark):
    texts = ['{"choices": [{"message": {"content": "one"}}]}', '{"content": [{"text": "two"}]}', '{"content": "three"}', '{"error": 1}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(MR.reply_text(F.col("t"))).collect()] == ["one", "two", "three", None]


def test_prompts(spark):
    df = spark.createDataFrame([("q", "c" * 4000)], "q string, c string")
    got = df.select(PR.answer_prompt(F.col("q"), F.col("c")).alias("p"), PR.messages(F.col("q"), "sys").alias("m"), PR.messages(F.col("q")).alias("n")).first()
    assert got.p.count("c" * 3000) == 1 and "c" * 3001 not in got.p
    assert json.loads(got.m) == [{"role": "system", "content": "sys"}, {"role": "user", "content": "q"}] and json.loads(got.n) == [{"role": "user", "content": "q"}]
    page = df.select(PR.page_prompt(F.lit(3), F.col("c")).alias("p"), PR.pair_prompt(F.lit(None).cast("string"), F.col("c"), F.lit("pdf"), F.col("q")).alias("r")).first()
    assert page.p.endswith("c" * 2000) and "(unknown)" in page.r and "c" * 501 not in page.r


def test_context(spark):
    hits = spark.createDataFrame([(1, 1, "a", "A" * 1200, 0.5), (1, 2, "b", "B", -0.25)], "query_id int, rank int, id string, document string, similarity double")
    edges = spark.createDataFrame([("a", f"n{i}") for i in range(8)] + [("n1", "b"), ("b", "a")], "src string, dst string")
    docs = spark.createDataFrame([("n1", "t", "f", "N" * 400), ("n7", "t", "f", "late"), ("b", "t", "f", "B")], "doc_id string, type string, source_file string, content string")
    related = RO.graph_context(hits, edges, docs)
    # five smallest neighbours first (b, n0..n3), then the ones that exist
    assert sorted((r.hit, r.id) for r in related.collect()) == [("a", "b"), ("a", "n1"), ("b", "n1")]
    got = RO.context_text(hits, related).first()
    assert got.context == ("\n--- Document a (similarity: 0.500) ---\n" + "A" * 1000 + "\n--- Document b (similarity: -0.250) ---\nB"
                           + "\n\n--- Related Documents from Graph ---\n" + "\nB\n" + "\n" + "N" * 300 + "\n" + "\n" + "N" * 300 + "\n")
    assert got.context_length == len(got.context)
    bare = RO.context_text(hits, related.where("false")).first()
    assert bare.context.endswith("\nB")


def claim(spark, **values):
    names = list(CL.HEADER_TEXT.values()) + list(CL.HEADER_DATES.values()) + list(CL.HEADER_AMOUNTS.values()) + [
        "CLM_UTLZTN_DAY_CNT", "PRNCPAL_DGNS_CD", "PRNCPAL_DGNS_VRSN_CD", "PRNCPAL_DGNS_POA_IND_SW"]
    for i in range(1, 26):
        names += [f"ICD_DGNS_CD{i}", f"ICD_DGNS_VRSN_CD{i}", f"ICD_DGNS_POA_IND_SW{i}", f"ICD_PRCDR_CD{i}", f"ICD_PRCDR_VRSN_CD{i}", f"PRCDR_DT{i}"]
    schema = ", ".join([f"{n} string" for n in names] + [f"{n} array<string>" for n in CL.LINE_ARRAYS])
    return spark.createDataFrame([tuple(values.get(n) for n in names + CL.LINE_ARRAYS)], schema)


def test_claims(spark):
    c = claim(spark, CLM_ID="c1", CLM_FROM_DT="20240131", CLM_THRU_DT="20240231", CLM_PMT_AMT="12.345", CLM_TOT_CHRG_AMT="x", CLM_UTLZTN_DAY_CNT="7",
              ICD_DGNS_CD3="D3", ICD_DGNS_VRSN_CD3="0", ICD_PRCDR_CD25="P", PRCDR_DT25="20200101",
              REV_CNTR_CD=["0450", "0100", "0450"], HCPCS_CD=["h1", "h2"], REV_CNTR_PMT_AMT_AMT=["1.005", None, "y"])
    c = c.select(*[F.coalesce(F.col(n), F.array().cast("array<string>")).alias(n) if n in CL.LINE_ARRAYS else n for n in c.columns])
    head = CL.claim_header(c, "2025-09-02").first()
    assert head.service_start_date == date(2024, 1, 31) and head.service_end_date is None and head.paid_amount == Decimal("12.35")
    assert head.total_charge_amount is None and head.utilization_day_count == 7 and head.source_file_date == date(2025, 9, 2) and len(head) == 24
    got = CL.claim_diagnoses(c).collect()
    assert [(r.diagnosis_sequence, r.diagnosis_code, r.diagnosis_type) for r in got] == [(3, "D3", "SECONDARY")]  # no principal code, no principal row
    proc = CL.claim_procedures(c).first()
    assert (proc.procedure_sequence, proc.procedure_date) == (25, date(2020, 1, 1))
    lines = sorted(CL.claim_lines(c).collect(), key=lambda r: r.line_number)
    assert [(r.line_number, r.revenue_code, r.hcpcs_code, r.line_payment_amount) for r in lines] == [
        (1, "0100", "h2", None), (2, "0450", "h1", Decimal("1.01")), (3, "0450", None, None)]
    assert len({r.claim_line_id for r in lines}) == 3 and lines[0].line_service_date == date(2024, 1, 31)


def test_load_counts(spark, tmp_path):
    c = claim(spark, CLM_ID="c1", PRNCPAL_DGNS_CD="D", REV_CNTR_CD=["1", "2"])
    assert CL.load_claims(c, str(tmp_path), "2025-09-02") == {
        "stg_claim_header": 1, "stg_claim_diagnosis": 1, "stg_claim_procedures": 0, "stg_claim_lines": 0}


def test_batches_of_one_day_are_kept(spark, tmp_path):
    from fieldloom.sources.stores import read_staging
    one, two = (claim(spark, CLM_ID=i, PRNCPAL_DGNS_CD="D") for i in ("c1", "c2"))
    for batch in (one, two, one):
        assert CL.load_claims(batch, str(tmp_path), "2025-09-02")["stg_claim_header"] == 1
    for name in ("stg_claim_header", "stg_claim_diagnosis"):
        assert sorted(r.claim_id for r in read_staging(spark, f"{tmp_path}/{name}").collect()) == ["c1", "c2"]
    assert CL.batch_id(one.union(two)) == CL.batch_id(two.union(one)) != CL.batch_id(one.union(one))


def test_replies_that_give_no_row_are_told(spark):
    rows = [(1, '[{"source_doc": "a", "target_doc": "b"}, {"source_doc": "a"}]'), (2, "[broken"), (3, None), (4, "[]")]
    replies = spark.createDataFrame(rows, "id int, response string")
    assert {(r.id, r.reason) for r in MR.relation_errors(replies).collect()} == {(1, "document missing"), (2, "does not parse"), (3, "no reply")}
    rows = [(1, 'So: {"has_relationship": false}'), (2, "{broken}"), (3, ""), (4, "plain words")]
    replies = spark.createDataFrame(rows, "id int, response string")
    assert {(r.id, r.reason, r.text) for r in MR.pair_errors(replies).collect()} == {(2, "does not parse", "{broken}"), (3, "no reply", ""), (4, "no JSON", "plain words")}
    assert {(r.id, r.reason) for r in MR.review_errors(replies).collect()} == {(2, "does not parse"), (3, "no reply")}
    assert {(r.id, r.reason) for r in MR.suggestion_errors(replies).collect()} == {(2, "does not parse"), (3, "no reply"), (4, "no JSON")}
