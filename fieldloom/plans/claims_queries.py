"""Queries of the claims staging load."""

from pyspark.sql import functions as F

from fieldloom.operators import claims as CL
from fieldloom.plans import bindings as B
from fieldloom.plans.registry import query, table

DAY = "strftime(o_orderdate, '%Y%m%d')"
MONEY = "(o_totalprice::DECIMAL(15,2)::VARCHAR || '5')::DECIMAL(15,3)"


@query("etl1_claim_header", f"""SELECT 'C' || o_orderkey AS claim_id, 'A' AS claim_type, o_custkey::VARCHAR AS patient_id, o_orderstatus AS provider_id, o_orderpriority AS attending_provider_npi,
  NULL::VARCHAR AS operating_provider_npi, NULL::VARCHAR AS other_provider_npi, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS service_start_date, o_orderdate::DATE AS service_end_date,
  NULL::DATE AS admission_date, o_orderdate::DATE AS discharge_date, (o_orderkey % 4)::VARCHAR AS admission_type_code, 'A' AS patient_status_code, '01' AS disposition_code,
  CASE WHEN o_orderkey % 11 <> 0 THEN {MONEY}::DECIMAL(15,2) END AS paid_amount, {MONEY}::DECIMAL(15,2) AS total_charge_amount, NULL::DECIMAL(15,2) AS deductible_amount,
  0.01::DECIMAL(15,2) AS coinsurance_amount, (o_orderkey % 30)::INTEGER AS utilization_day_count, '1' AS service_classification_code, '40' AS bill_type_code, 'CCLF_1' AS source_file_id,
  DATE '2025-09-02' AS source_file_date FROM orders""")
def etl1(spark, sf_dir):
    return CL.claim_header(B.claims(spark, sf_dir), "2025-09-02").drop("load_date")


@query("etl2_claim_diagnoses", """WITH s AS (SELECT unnest(range(0, 26)) AS slot), x AS (SELECT 'C' || o_orderkey AS claim_id, slot,
  CASE WHEN slot = 0 THEN CASE WHEN o_orderkey % 5 <> 0 THEN 'P' || (o_custkey % 100) END WHEN o_orderkey % 4 >= slot THEN 'D' || ((o_custkey * slot) % 1000) END AS diagnosis_code FROM orders, s)
SELECT sha256(claim_id || '|diagnosis|' || slot) AS claim_diagnosis_id, claim_id, diagnosis_code, '0' AS diagnosis_code_version, slot::INTEGER AS diagnosis_sequence,
  CASE WHEN slot = 0 THEN 'PRINCIPAL' ELSE 'SECONDARY' END AS diagnosis_type, CASE WHEN slot = 0 THEN 'Y' ELSE 'N' END AS present_on_admission_flag, 'CCLF_1' AS source_file_id FROM x WHERE diagnosis_code IS NOT NULL""")
def etl2(spark, sf_dir):
    return CL.claim_diagnoses(B.claims(spark, sf_dir)).drop("load_date")


@query("set1_slot_union", """WITH s AS (SELECT unnest(range(0, 26)) AS slot), x AS (SELECT slot, CASE WHEN slot = 0 THEN o_orderkey % 5 <> 0 ELSE o_orderkey % 4 >= slot END AS used FROM orders, s)
SELECT CASE WHEN slot = 0 THEN 'PRINCIPAL' ELSE 'SECONDARY' END AS diagnosis_type, slot::INTEGER AS diagnosis_sequence, count(*) AS rows FROM x WHERE used GROUP BY slot""")
def set1(spark, sf_dir):
    return CL.claim_diagnoses(B.claims(spark, sf_dir)).groupBy("diagnosis_type", "diagnosis_sequence").agg(F.count("*").alias("rows"))


@query("etl3_claim_procedures", """WITH s AS (SELECT unnest(range(1, 26)) AS slot), x AS (SELECT 'C' || o_orderkey AS claim_id, slot, o_orderdate::DATE AS day,
  CASE WHEN o_orderkey % 3 >= slot THEN 'R' || ((o_custkey * slot) % 1000) END AS procedure_code FROM orders, s)
SELECT sha256(claim_id || '|procedure|' || slot) AS claim_procedure_id, claim_id, procedure_code, '0' AS procedure_code_version, slot::INTEGER AS procedure_sequence,
  CASE WHEN slot <> 2 THEN day END AS procedure_date, 'CCLF_1' AS source_file_id FROM x WHERE procedure_code IS NOT NULL""")
def etl3(spark, sf_dir):
    return CL.claim_procedures(B.claims(spark, sf_dir)).drop("load_date")


LINES = """l AS (SELECT 'C' || o_orderkey AS claim_id, o_orderkey AS k, o_custkey AS c, o_orderdate::DATE AS day, o_orderkey % 3 + 1 AS n, unnest(range(1, o_orderkey % 3 + 2)) AS i FROM orders),
  z AS (SELECT *, lpad(((c * (i + 5)) % 900)::VARCHAR, 4, '0') AS revenue_code FROM l), y AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY revenue_code, i) AS line_number FROM z)"""


@query("etl4_claim_lines", f"""WITH {LINES} SELECT sha256(claim_id || '|line|' || line_number) AS claim_line_id, claim_id, line_number::INTEGER AS line_number, CASE WHEN i < n THEN 'H' || (k + i) END AS hcpcs_code,
  i::VARCHAR AS hcpcs_modifier_1, i::VARCHAR AS hcpcs_modifier_2, i::VARCHAR AS hcpcs_modifier_3, i::VARCHAR AS hcpcs_modifier_4, revenue_code,
  CASE WHEN i <> 2 THEN ((c % 70 + i) || '.255')::DECIMAL(15,3)::DECIMAL(15,2) END AS line_payment_amount, ((c % 50 + i) || '.10')::DECIMAL(15,2) AS line_allowed_amount,
  NULL::DECIMAL(15,2) AS line_coinsurance_amount, NULL::DECIMAL(15,2) AS line_deductible_amount, NULL::DECIMAL(15,2) AS line_primary_payer_paid_amount,
  (i || '.345')::DECIMAL(8,3)::DECIMAL(8,2) AS line_service_units, CASE WHEN k % 7 <> 0 THEN day END AS line_service_date, NULL::VARCHAR AS line_place_of_service_code, NULL::VARCHAR AS line_service_type_code,
  NULL::VARCHAR AS line_processing_indicator, NULL::VARCHAR AS line_national_drug_code, 'CCLF_1' AS source_file_id FROM y""")
def etl4(spark, sf_dir):
    return CL.claim_lines(B.claims(spark, sf_dir)).drop("load_date")


@query("arr1_zipped_arrays", f"WITH {LINES} SELECT claim_id, (i - 1)::INTEGER AS at, revenue_code, CASE WHEN i < n THEN 'H' || (k + i) END AS hcpcs_code, i || '.345' AS units FROM z")
def arr1(spark, sf_dir):
    return CL.revenue_lines(B.claims(spark, sf_dir)).select(
        F.col("CLM_ID").alias("claim_id"), F.col("_at").alias("at"), F.col("REV_CNTR_CD").alias("revenue_code"), F.col("HCPCS_CD").alias("hcpcs_code"), F.col("REV_CNTR_UNIT_CNT").alias("units"))


@query("dt1_lenient_date", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE END AS day FROM orders""")
def dt1(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 3 == 0, "20201341").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", CL.lenient_date(text).alias("day"))


@query("dt2_load_stamps", "SELECT 'C' || o_orderkey AS claim_id, DATE '2025-09-02' AS source_file_date, true AS stamped FROM orders")
def dt2(spark, sf_dir):
    return CL.claim_header(B.claims(spark, sf_dir), "2025-09-02").select("claim_id", "source_file_date", F.col("load_date").isNotNull().alias("stamped"))


@query("num1_lenient_numbers", """SELECT p_partkey, ((p_partkey % 1000) || '.345')::DECIMAL(15,3)::DECIMAL(15,2) AS amount, ((p_size) || '.005')::DECIMAL(8,3)::DECIMAL(8,2) AS units,
  CASE WHEN p_size % 2 = 0 THEN p_size END AS days FROM part""")
def num1(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    amount = F.concat((F.col("p_partkey") % 1000).cast("string"), F.lit(".345"))
    days = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("none")
    return part.select("p_partkey", CL.amount(amount).alias("amount"), CL.amount(F.concat(F.col("p_size").cast("string"), F.lit(".005")), "decimal(8,2)").alias("units"),
                       days.try_cast("int").alias("days"))
