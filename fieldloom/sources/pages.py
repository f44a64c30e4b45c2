"""Page tables (source_file, page_number, text)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import is_blank


def content_pages(pages: DataFrame) -> DataFrame:
    """Non-blank pages with their id and the marked text that the file's full text is made of."""
    return pages.where(~is_blank(F.col("text"))).withColumns({
        "chunk_id": F.concat(F.lit("page_"), F.col("page_number").cast("string")),
        "marked_text": F.format_string("\n--- Page %d ---\n%s", "page_number", "text")})


def page_counts(pages: DataFrame) -> DataFrame:
    """Per file: all pages, and the ones with content."""
    return pages.groupBy("source_file").agg(
        F.count("*").alias("num_pages"), F.count_if(~is_blank(F.col("text"))).alias("content_pages"))


def full_text(pages: DataFrame, max_chars: int = 256 * 1024 * 1024) -> DataFrame:
    """Full marked text of each file, as one value per file.

    The lengths are summed first, and a source too long for one value fails the job before its
    pages are gathered; such sources stay usable as ``content_pages`` rows.
    """
    rows = content_pages(pages)
    sizes = rows.groupBy("source_file").agg(F.sum(F.length("marked_text")).alias("_chars"))
    fits = F.when(F.col("_chars") > max_chars, F.raise_error(F.concat(
        F.lit("text too long for one value: "), F.col("source_file"))).cast("boolean")).otherwise(F.lit(True))
    gathered = rows.join(sizes.where(fits), "source_file").groupBy("source_file").agg(
        F.array_sort(F.collect_list(F.struct("page_number", "marked_text"))).alias("_pages"))
    return gathered.select("source_file", F.array_join(F.transform("_pages", lambda p: p["marked_text"]), "").alias("text"))
