"""Folder scans: file catalogue, CSV profiling, per-file headers, file ids."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import constants as K
from fieldloom.functions.numbering import number_rows
from fieldloom.functions.text import contains_any
from fieldloom.operators.mapping import normalise_rows, row_maps
from fieldloom.session import materialise
from fieldloom.sources import csv_splits


def file_class(path) -> Column:
    """csv / pdf / python / other by case-sensitive suffix."""
    return (F.when(F.endswith(path, F.lit(".csv")), "csv").when(F.endswith(path, F.lit(".pdf")), "pdf")
            .when(F.endswith(path, F.lit(".py")), "python").otherwise("other"))


def plain_path(path="_metadata.file_path") -> Column:
    """Path of a file as it is named: the reader's metadata has blanks and other signs percent-encoded, but a plus sign is itself."""
    return F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B")))


def find_files(spark: SparkSession, root: str) -> DataFrame:
    """Recursive catalogue; file contents are never read (only path and length are selected)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select("path", "length", file_class(F.col("path")).alias("file_class"))


def files_per_class(files: DataFrame) -> DataFrame:
    return files.rollup("file_class").agg(F.count("*").alias("files")).select(
        F.coalesce("file_class", F.lit("total")).alias("file_class"), "files")


def file_ids(files: DataFrame) -> DataFrame:
    """Sequential ids across csv, pdf, python: csv_0, csv_1, pdf_2, ... in path order."""
    ranked = files.where("file_class <> 'other'").withColumn(
        "_rank", F.when(F.col("file_class") == "csv", 0).when(F.col("file_class") == "pdf", 1).otherwise(2))
    numbered = number_rows(ranked, ["_rank", "path"], name="_n")
    return numbered.withColumn("doc_id", F.concat("file_class", F.lit("_"), (F.col("_n") - 1).cast("string"))).drop("_n", "_rank")


def is_mapping_sheet(first_lines) -> Column:
    """``first_lines``: array of the first five lines, data lines included."""
    return contains_any(F.lower(F.array_join(first_lines, " ")), K.MAPPING_INDICATORS)


def csv_profile(spark: SparkSession, path: str) -> DataFrame:
    """Per file: delimiter, mapping-sheet flag and number of header columns, from its first lines."""
    heads = csv_splits.file_heads(csv_splits.file_lines(spark, path, plain_path))
    return heads.select("path", "delimiter", is_mapping_sheet(F.col("lines")).alias("is_mapping"), F.size("header").alias("columns"))


def read_csv(spark: SparkSession, path: str, pattern: str = "*.csv"):
    """Every file under ``path`` named like ``pattern``: (cells, errors), from one pass over the files.

    ``cells`` is as in ``read_csv_cells``; ``errors`` is (path, source_file, row_number, reason, kept, surplus, text) of the records that are not sound. Those with surplus cells or
    an unclosed quote are kept: their cells are in the result too. A file that is wrong does not touch the others.
    """
    found = materialise(csv_splits.read_records(spark, path, plain_path, pattern=pattern), "records")
    kept = F.col("cells").isNotNull()
    return _cells(found), found.where("reason IS NOT NULL").select("path", "source_file", "row_number", "reason", kept.alias("kept"), "surplus", "text")


def read_csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """Every CSV under ``path`` as (path, source_file, row_number, header, cells, is_mapping).

    Files may differ in delimiter, header and width; the first record of each is its header. ``read_csv`` also tells which records have cells beyond the header.
    """
    return _cells(csv_splits.read_records(spark, path, plain_path))


def _cells(records: DataFrame) -> DataFrame:
    return records.where("cells IS NOT NULL").select("path", "source_file", "row_number", "header", "cells", is_mapping_sheet(F.col("lines")).alias("is_mapping"))


def parse_csv(spark: SparkSession, path: str, strict_compat: bool = False):
    """All CSVs under ``path``: (plain rows, mapping rows), each with a string ``metadata`` map."""
    cells = read_csv_cells(spark, path)
    return (row_maps(cells.where(~F.col("is_mapping"))).drop("is_mapping"),
            normalise_rows(cells.where("is_mapping"), strict_compat).drop("is_mapping"))


def parse_mapping_csv(spark: SparkSession, path: str, strict_compat: bool = False) -> DataFrame:
    """All CSVs under ``path`` read as mapping sheets, detected or not."""
    return normalise_rows(read_csv_cells(spark, path), strict_compat)


def read_claims(spark: SparkSession, path: str, view: str = "claims_file") -> DataFrame:
    """Claims CSV with header, all strings, also as a temp view."""
    claims = spark.read.options(header=True, inferSchema=False, sep=",").csv(path)
    claims.createOrReplaceTempView(view)
    return claims
