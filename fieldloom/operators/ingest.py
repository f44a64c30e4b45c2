"""Parsed files to one document table: CSV rows and summaries, pages, scripts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.numbering import number_rows
from fieldloom.functions.text import basename
from fieldloom.operators.chunks import inventory_counts, source_inventory
from fieldloom.operators.documents import file_summaries, merged_terms, page_description, row_text
from fieldloom.operators.responses import page_metadata
from fieldloom.sources.files import file_ids, find_files, parse_csv, plain_path
from fieldloom.sources.pages import content_pages, full_text, page_counts

COLUMNS = ["doc_id", "type", "source_file", "content", "raw_text", "parent_document", "row_number", "metadata"]
PARSING_METHOD = "page_based_llm"  # fixed value in the metadata of paged files


def _shaped(df: DataFrame) -> DataFrame:
    blanks = {"raw_text": "string", "parent_document": "string", "row_number": "int"}
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(blanks[c]).alias(c) for c in COLUMNS])


def csv_documents(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (path, source_file, row_number, metadata) as ``csv_i_row_j`` and one ``csv_i`` summary per file.

    ``ids``: path, doc_id of all CSV files; a file without rows still gets its summary.
    """
    placed = number_rows(rows.select("path", "row_number", "metadata"), ["row_number"], within=["path"], name="_n").join(ids, "path")
    lines = placed.select(
        F.concat("doc_id", F.lit("_row_"), (F.col("_n") - 1).cast("string")).alias("doc_id"), F.lit("csv_row").alias("type"),
        F.col("path").alias("source_file"), row_text("metadata").alias("content"), (F.col("_n") - 1).cast("int").alias("row_number"), "metadata")
    found = file_summaries(rows.select(F.col("path").alias("source_file"), "row_number", "metadata")).withColumnRenamed("source_file", "path")
    whole = ids.join(found, "path", "left").select(
        "doc_id", F.lit("csv_summary").alias("type"), F.col("path").alias("source_file"),
        F.coalesce("content", F.lit("CSV file with 0 rows. Fields: No data")).alias("content"),
        F.create_map(F.lit("num_rows"), F.coalesce("num_rows", F.lit(0)).cast("string"),
                     F.lit("fields"), F.coalesce(F.array_join("fields", ", "), F.lit(""))).alias("metadata"))
    return _shaped(lines).unionByName(_shaped(whole))


def page_documents(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Pages (source_file path, page_number, text, response) as ``pdf_i_page_n`` under their ``pdf_i``.

    Page metadata comes from the replies where usable, else from patterns.
    """
    named = ids.withColumnRenamed("path", "source_file")
    counts = page_counts(pages).select("source_file", "num_pages")
    common = [F.lit("num_pages"), F.col("num_pages").cast("string"), F.lit("source_file"), basename(F.col("source_file")),
              F.lit("parsing_method"), F.lit(PARSING_METHOD)]
    whole = named.join(counts, "source_file").join(full_text(pages), "source_file", "left").select(
        "doc_id", F.lit("pdf").alias("type"), "source_file", F.coalesce("text", F.lit("")).alias("content"), F.create_map(*common).alias("metadata"))
    meta = page_metadata(content_pages(pages)).join(named.join(counts, "source_file"), "source_file")
    page = F.col("page")
    own = [F.lit("page_number"), F.col("page_number").cast("string"), F.lit("chunk_id"), F.col("chunk_id")]
    for name in ("content_type", "functional_area", "table_name", "summary", "analysis_method"):
        own += [F.lit(name), F.coalesce(page[name], F.lit(""))]
    own += [F.lit("key_concepts"), F.coalesce(F.array_join(page["key_concepts"], ", "), F.lit(""))]
    parts = meta.select(
        F.concat("doc_id", F.lit("_"), "chunk_id").alias("doc_id"), F.lit("pdf_page").alias("type"), "source_file",
        page_description(page, F.col("text")).alias("content"), F.col("text").alias("raw_text"), F.col("doc_id").alias("parent_document"),
        F.create_map(*common, *own).alias("metadata"))
    return _shaped(whole).unionByName(_shaped(parts))


def script_documents(scripts: DataFrame, ids: DataFrame) -> DataFrame:
    """Scripts (path, text) as ``python_i`` with counts of what they define."""
    counts = inventory_counts(source_inventory(scripts))
    kinds = ("functions", "classes", "imports", "variables")
    return _shaped(scripts.join(ids, "path").join(counts, "path", "left").select(
        "doc_id", F.lit("python").alias("type"), F.col("path").alias("source_file"), F.col("text").alias("content"),
        F.create_map(*[x for k in kinds for x in (F.lit(k), F.coalesce(k, F.lit(0)).cast("string"))]).alias("metadata")))


def process_files(spark: SparkSession, root: str, pages: DataFrame | None = None, strict_compat: bool = False) -> DataFrame:
    """Document table of a folder. ``pages``: page texts of its paged files (source_file path,
    page_number, text and, if any, the model's response), as decoding them is not done here."""
    ids = file_ids(find_files(spark, root)).select("path", "file_class", "doc_id")

    def of(kind):
        return ids.where(F.col("file_class") == kind).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "doc_id")

    def local(df):
        return df.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))

    plain, sheet = parse_csv(spark, root, strict_compat)
    columns = ["path", "source_file", "row_number", "metadata"]
    out = csv_documents(local(plain.select(*columns).unionByName(sheet.select(*columns))), of("csv"))
    scripts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").text(root, wholetext=True).select(
        plain_path().alias("path"), F.col("value").alias("text"))
    out = out.unionByName(script_documents(local(scripts), of("python")))
    if pages is not None:
        if "response" not in pages.columns:
            pages = pages.withColumn("response", F.lit(None).cast("string"))
        out = out.unionByName(page_documents(pages, of("pdf")))
    return out


def page_terms(documents: DataFrame) -> DataFrame:
    """Key terms (id, key_terms) of page documents: concepts, table name and functional area."""
    m = F.col("metadata")
    return documents.where("type = 'pdf_page'").select(F.col("doc_id").alias("id"), merged_terms(
        F.split(F.coalesce(m["key_concepts"], F.lit("")), ", "), F.array(F.coalesce(m["table_name"], F.lit(""))),
        F.array(F.coalesce(m["functional_area"], F.lit("")))).alias("key_terms"))

