"""Claims staging load: header, diagnosis, procedure and line tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import constants as K
from fieldloom.functions.numbering import number_rows

# --- Fixed values: staging column <- claim column ---
HEADER_TEXT = {
    "claim_id": "CLM_ID", "patient_id": "BENE_ID", "provider_id": "PRVDR_NUM",
    "attending_provider_npi": "ATT_PHYSN_NPI", "operating_provider_npi": "OP_PHYSN_NPI",
    "other_provider_npi": "OTH_PHYSN_NPI", "admission_type_code": "CLM_IP_ADMSN_TYPE_CD",
    "patient_status_code": "NCH_PTNT_STATUS_IND_CD", "disposition_code": "CLM_DISP_CD",
    "service_classification_code": "CLM_SRVC_CLSFCTN_TYPE_CD", "bill_type_code": "NCH_CLM_TYPE_CD",
}
HEADER_DATES = {
    "service_start_date": "CLM_FROM_DT", "service_end_date": "CLM_THRU_DT",
    "admission_date": "CLM_ADMSN_DT", "discharge_date": "NCH_BENE_DSCHRG_DT",
}
HEADER_AMOUNTS = {
    "paid_amount": "CLM_PMT_AMT", "total_charge_amount": "CLM_TOT_CHRG_AMT",
    "deductible_amount": "NCH_BENE_PTB_DDCTBL_AMT", "coinsurance_amount": "NCH_BENE_PTB_COINSRNC_AMT",
}
LINE_ARRAYS = [
    "REV_CNTR_CD", "HCPCS_CD", "HCPCS_1ST_MDFR_CD", "HCPCS_2ND_MDFR_CD", "HCPCS_3RD_MDFR_CD", "HCPCS_4TH_MDFR_CD",
    "REV_CNTR_UNIT_CNT", "REV_CNTR_RATE_AMT", "REV_CNTR_PMT_AMT_AMT", "REV_CNTR_TOT_CHRG_AMT",
    "REV_CNTR_NCVRD_CHRG_AMT", "REV_CNTR_DDCTBL_COINSRNC_CD", "REV_CNTR_NDC_QTY", "REV_CNTR_NDC_QTY_QLFR_CD",
]
HEADER_ORDER = [
    "claim_id", "claim_type", "patient_id", "provider_id", "attending_provider_npi", "operating_provider_npi",
    "other_provider_npi", "service_start_date", "service_end_date", "admission_date", "discharge_date",
    "admission_type_code", "patient_status_code", "disposition_code", "paid_amount", "total_charge_amount",
    "deductible_amount", "coinsurance_amount", "utilization_day_count", "service_classification_code",
    "bill_type_code", "source_file_id", "source_file_date", "load_date",
]
LINE_NULLS = {
    "line_coinsurance_amount": "decimal(15,2)", "line_deductible_amount": "decimal(15,2)",
    "line_primary_payer_paid_amount": "decimal(15,2)", "line_place_of_service_code": "string",
    "line_service_type_code": "string", "line_processing_indicator": "string", "line_national_drug_code": "string",
}


def lenient_date(text) -> Column:
    """``yyyyMMdd`` text to a date; anything else becomes NULL."""
    return F.try_to_date(text, "yyyyMMdd")


def amount(text, kind="decimal(15,2)") -> Column:
    """Lenient numeric cast (rounds half up)."""
    return text.try_cast(kind)


def row_key(*parts) -> Column:
    """Repeatable row key from the parts that identify a row."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def claim_header(claims: DataFrame, run_date: str) -> DataFrame:
    made = {name: F.col(c) for name, c in HEADER_TEXT.items()}
    made |= {name: lenient_date(F.col(c)) for name, c in HEADER_DATES.items()}
    made |= {name: amount(F.col(c)) for name, c in HEADER_AMOUNTS.items()}
    made |= {
        "claim_type": F.lit(K.CLAIM_TYPE), "utilization_day_count": F.col("CLM_UTLZTN_DAY_CNT").try_cast("int"),
        "source_file_id": F.lit(K.CLAIM_SOURCE_ID), "source_file_date": F.to_date(F.lit(run_date), "yyyy-MM-dd"),
        "load_date": F.current_timestamp()}
    return claims.select(*[made[name].alias(name) for name in HEADER_ORDER])


def claim_diagnoses(claims: DataFrame, slots: int = K.CLAIM_SLOTS) -> DataFrame:
    """Principal diagnosis (sequence 0) and secondary slots as rows, in one pass over the claims."""
    def slot(n, code, version, poa):
        return F.struct(F.lit(n).alias("diagnosis_sequence"), F.col(code).alias("diagnosis_code"),
                        F.col(version).alias("diagnosis_code_version"), F.col(poa).alias("present_on_admission_flag"))

    every = [slot(0, "PRNCPAL_DGNS_CD", "PRNCPAL_DGNS_VRSN_CD", "PRNCPAL_DGNS_POA_IND_SW")]
    every += [slot(n, f"ICD_DGNS_CD{n}", f"ICD_DGNS_VRSN_CD{n}", f"ICD_DGNS_POA_IND_SW{n}") for n in range(1, slots + 1)]
    rows = claims.select(F.col("CLM_ID").alias("claim_id"), F.inline(F.array(*every))).where("diagnosis_code is not null")
    return rows.select(
        row_key(F.col("claim_id"), F.lit("diagnosis"), F.col("diagnosis_sequence")).alias("claim_diagnosis_id"),
        "claim_id", "diagnosis_code", "diagnosis_code_version", "diagnosis_sequence",
        F.when(F.col("diagnosis_sequence") == 0, "PRINCIPAL").otherwise("SECONDARY").alias("diagnosis_type"),
        "present_on_admission_flag", F.lit(K.CLAIM_SOURCE_ID).alias("source_file_id"), F.current_timestamp().alias("load_date"))


def claim_procedures(claims: DataFrame, slots: int = K.CLAIM_SLOTS) -> DataFrame:
    every = [F.struct(
        F.lit(n).alias("procedure_sequence"), F.col(f"ICD_PRCDR_CD{n}").alias("procedure_code"),
        F.col(f"ICD_PRCDR_VRSN_CD{n}").alias("procedure_code_version"), F.col(f"PRCDR_DT{n}").alias("_date"))
        for n in range(1, slots + 1)]
    rows = claims.select(F.col("CLM_ID").alias("claim_id"), F.inline(F.array(*every))).where("procedure_code is not null")
    return rows.select(
        row_key(F.col("claim_id"), F.lit("procedure"), F.col("procedure_sequence")).alias("claim_procedure_id"),
        "claim_id", "procedure_code", "procedure_code_version", "procedure_sequence",
        lenient_date(F.col("_date")).alias("procedure_date"), F.lit(K.CLAIM_SOURCE_ID).alias("source_file_id"),
        F.current_timestamp().alias("load_date"))


def revenue_lines(claims: DataFrame) -> DataFrame:
    """Revenue-centre arrays zipped into one row per entry, with the entry's position."""
    zipped = F.arrays_zip(*LINE_ARRAYS)
    rows = claims.select("CLM_ID", "CLM_FROM_DT", F.posexplode(zipped).alias("_at", "_line"))
    return rows.select("CLM_ID", "CLM_FROM_DT", "_at", "_line.*")


def claim_lines(claims: DataFrame) -> DataFrame:
    """Numbered claim lines; ties in revenue code keep their array order."""
    rows = number_rows(revenue_lines(claims), ["REV_CNTR_CD", "_at"], within=["CLM_ID"], name="line_number")
    made = {
        "claim_line_id": row_key(F.col("CLM_ID"), F.lit("line"), F.col("line_number")),
        "claim_id": F.col("CLM_ID"), "line_number": F.col("line_number").cast("int"), "hcpcs_code": F.col("HCPCS_CD"),
        "hcpcs_modifier_1": F.col("HCPCS_1ST_MDFR_CD"), "hcpcs_modifier_2": F.col("HCPCS_2ND_MDFR_CD"),
        "hcpcs_modifier_3": F.col("HCPCS_3RD_MDFR_CD"), "hcpcs_modifier_4": F.col("HCPCS_4TH_MDFR_CD"),
        "revenue_code": F.col("REV_CNTR_CD"), "line_payment_amount": amount(F.col("REV_CNTR_PMT_AMT_AMT")),
        "line_allowed_amount": amount(F.col("REV_CNTR_RATE_AMT")),
        "line_service_units": amount(F.col("REV_CNTR_UNIT_CNT"), "decimal(8,2)"),
        "line_service_date": lenient_date(F.col("CLM_FROM_DT")),
        "source_file_id": F.lit(K.CLAIM_SOURCE_ID), "load_date": F.current_timestamp()}
    made |= {name: F.lit(None).cast(kind) for name, kind in LINE_NULLS.items()}
    order = [
        "claim_line_id", "claim_id", "line_number", "hcpcs_code", "hcpcs_modifier_1", "hcpcs_modifier_2",
        "hcpcs_modifier_3", "hcpcs_modifier_4", "revenue_code", "line_payment_amount", "line_allowed_amount",
        "line_coinsurance_amount", "line_deductible_amount", "line_primary_payer_paid_amount", "line_service_units",
        "line_service_date", "line_place_of_service_code", "line_service_type_code", "line_processing_indicator",
        "line_national_drug_code", "source_file_id", "load_date"]
    return rows.select(*[made[name].alias(name) for name in order])


def batch_id(claims: DataFrame) -> str:
    """Name of a batch by its content: its row count and two sums of row hashes, whatever the order of the rows."""
    row = F.to_json(F.struct("*"))
    sums = [F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")) for seed in (1, 2)]
    found = claims.agg(F.count("*"), *sums).first()
    return "batch-" + "-".join([str(found[0]), *[f"{int(x or 0) % 2 ** 64:016x}" for x in found[1:]]])


def load_claims(claims: DataFrame, out: str, run_date: str, load_id: str | None = None) -> dict:
    """Load all four staging tables; returns rows written per table, counted during the writes.

    Every load is a part of each table, named by ``load_id``, by default after the content of the batch: a batch that is loaded again, on any
    day, writes over its own part, and different batches of one day are all kept. The default reads the batch once more.
    """
    from fieldloom.sources.stores import append_staging
    tables = {"stg_claim_header": claim_header(claims, run_date), "stg_claim_diagnosis": claim_diagnoses(claims),
              "stg_claim_procedures": claim_procedures(claims), "stg_claim_lines": claim_lines(claims)}
    load_id = load_id or batch_id(claims)
    return {name: append_staging(table, f"{out}/{name}", load_id) for name, table in tables.items()}
