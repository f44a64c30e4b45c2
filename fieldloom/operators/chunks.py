"""Text chunks and pages: analysis by pattern, pages of a chunk, source inventory."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom import constants as K
from fieldloom.functions.text import (
    BLANKS, all_matches, contains_any, ellipsis, filled, first_match, head, preview, strip)
from fieldloom.session import materialise, spread

SAMPLE = 200
BATCH_CHARS = 8 << 20


def chunk_documents(documents: DataFrame, size=K.CHUNK_SIZE, overlap=K.CHUNK_OVERLAP) -> DataFrame:
    """Chunk rows (source_file, chunk_id from 0, chunk) of full texts (source_file, text)."""
    others = [c for c in documents.columns if c != "text"]
    least = int(size * K.CHUNK_BREAK) + 1
    if least <= overlap:
        raise ValueError("overlap must be smaller than the shortest chunk")
    keep, blanks, at = K.CHUNK_BREAK, BLANKS, len(others)

    def pieces(text):
        if len(text) <= size:
            yield text
            return
        place = 0
        while place < len(text):  # strings are indexed by code point, so a text takes time in proportion to its length
            end = place + size
            space = text.rfind(" ", place, end) - place if end < len(text) else -1
            taken = space if space > size * keep else size
            yield text[place:place + taken].strip(blanks)
            place += taken - overlap

    def cut(batches):
        for batch in batches:
            rows, numbers, made, held = [], [], [], 0
            for row, text in enumerate(batch.column(at).to_pylist()):
                for number, piece in enumerate(pieces(text) if text is not None else ()):
                    rows.append(row), numbers.append(number), made.append(piece)
                    held += len(piece)
                    if held > BATCH_CHARS:
                        yield _taken(batch, at, rows, numbers, made)
                        rows, numbers, made, held = [], [], [], 0
            yield _taken(batch, at, rows, numbers, made)

    def _taken(batch, width, rows, numbers, made):
        columns = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(width)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int32()), pa.array(made, pa.string())], [*batch.schema.names[:width], "chunk_id", "chunk"])

    source = spread(documents).select(*others, "text")
    schema = T.StructType([*[source.schema[c] for c in others], T.StructField("chunk_id", T.IntegerType()), T.StructField("chunk", T.StringType())])
    return source.mapInArrow(cut, schema)


def chunk_analysis(chunk) -> Column:
    """Struct of content type, codes, areas, key terms and description of a chunk."""
    chunk = F.col(chunk) if isinstance(chunk, str) else chunk
    low = F.lower(chunk)
    lines = F.split(chunk, "\n", 6)  # the first five, and the rest unsplit
    is_table = contains_any(low, K.DICTIONARY_WORDS)
    codes = F.concat(*[head(all_matches(chunk, p), 5) for p in K.CODE_PATTERNS])
    areas = F.concat(*[all_matches(low, p, 1, "i") for p in K.CHUNK_AREA_PATTERNS])
    words = F.flatten(F.transform(head(lines, 5), lambda line: F.split(line, r"(?U)\s+")))
    important = head(F.filter(words, lambda w: (
        (F.length(w) > 4) & w.rlike(r"^\p{L}+$") & ~w.isin(*K.UNIMPORTANT_WORDS))), 5)
    first = ellipsis(strip(F.get(lines, F.lit(0))), 100)
    description = F.concat(
        first,
        F.when(F.size(codes) > 0, F.concat(F.lit(" | Contains: "), F.array_join(head(codes, 3), ", "))).otherwise(""),
        F.when(F.size(areas) > 0, F.concat(F.lit(" | Area: "), F.array_join(head(areas, 2), ", "))).otherwise(""))
    return F.struct(
        F.when(is_table, "data_dictionary").otherwise("general").alias("content_type"),
        F.array_sort(F.array_distinct(head(F.concat(codes, important), 10))).alias("key_terms"),
        description.alias("description"), is_table.alias("has_table_data"),
        (F.size(codes) > 0).alias("has_codes"),
        F.array_sort(F.array_distinct(areas)).alias("functional_areas"))


def marked_pages(chunk) -> Column:
    """Page numbers of the markers inside a chunk; empty when there are none."""
    return F.transform(all_matches(chunk, K.PAGE_MARKER, 1), lambda n: n.cast("int"))


def _grams(text, size) -> Column:
    """All character runs of one length, built by shifting the letters against themselves."""
    letters = F.split(text, "")
    runs = letters
    for shift in range(2, size + 1):
        runs = F.zip_with(runs, F.slice(letters, shift, F.greatest(F.length(text), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.filter(runs, lambda r: F.length(r) == size)


def _keys(kind, values) -> Column:
    return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def chunk_pages(chunks_df: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``pages``: the markers in the chunk, else the first page holding its stripped 200-char
    head, else page 1.

    A head is looked up through its rarest whole word within the source (a head of one or two words
    through its rarest run of three letters): only pages with that key are compared, so no chunk
    meets all pages of its source. Equal page texts and equal heads are compared once.
    """
    tagged = chunks_df.withColumn("_marked", marked_pages(F.col("chunk"))).withColumn(
        "_sample", strip(preview(F.col("chunk"), SAMPLE)))
    wanted = tagged.where(F.size("_marked") == 0).select("source_file", F.col("_sample").alias("sample")).distinct()
    words = F.split("sample", r"(?U)\s+")
    # the outer words of a head may be cut: only words between two blanks are whole
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    # written once: heads are small beside the chunks they were cut from; a number stands for a head where its words are dealt out one by one
    wanted = materialise(wanted.withColumn("_inner", inner).withColumn("_short", F.size("_inner") == 0).withColumn("_head", F.monotonically_increasing_id()), "heads")
    size = F.length("sample")
    runs = F.when(size >= 3, _grams(F.col("sample"), 3)).when(size == 2, F.array("sample")).when(size == 1, F.array("sample"))
    asked = wanted.where(size > 0).select("source_file", "_head", F.explode(
        F.when(F.col("_short"), _keys("letters", runs)).otherwise(_keys("word", F.col("_inner")))).alias("key"))

    page = [F.col("source_file"), F.col("page"), F.xxhash64("text").alias("_text")]
    # stored, as it is read for words, letters and texts, and no reader has to shuffle the texts again
    unique = materialise(pages.groupBy("source_file", "text").agg(F.min("page_number").alias("page")), "pages")
    word_keys = unique.select(*page, F.explode(_keys("word", F.split("text", r"(?U)\s+"))).alias("key"))
    # runs of letters only where a short head asks for them
    with_short = unique.join(wanted.where("_short").select("source_file").distinct(), "source_file", "left_semi")
    letter_keys = with_short.select(*page, F.explode(_keys("letters", F.flatten(F.array(
        *[_grams(F.col("text"), n) for n in (1, 2, 3)])))).alias("key"))
    # keys nobody asks for are gone before anything is counted
    offered = word_keys.unionByName(letter_keys).join(asked.select("source_file", "key").distinct(), ["source_file", "key"], "left_semi")
    held_by = offered.groupBy("source_file", "key").agg(F.count("*").alias("_pages"))
    rarest = asked.join(held_by, ["source_file", "key"], "left").groupBy("source_file", "_head").agg(
        F.min_by("key", F.struct(F.coalesce("_pages", F.lit(0)), "key")).alias("key"))
    rarest = rarest.join(wanted.select("_head", "sample"), "_head")
    # keys lead to page numbers; page texts are fetched for these candidates only
    candidates = rarest.join(offered, ["source_file", "key"]).select("source_file", "sample", "page", "_text")
    texts = unique.select(*page, "text")
    matched = candidates.join(texts, ["source_file", "page", "_text"]).where(F.contains("text", F.col("sample")))
    # an empty head lies in every page, so in the first
    empty = wanted.where(size == 0).select("source_file", "sample").join(
        pages.groupBy("source_file").agg(F.min("page_number").alias("page")), "source_file")
    first = matched.select("source_file", "sample", "page").unionByName(
        empty.select("source_file", "sample", "page")).groupBy("source_file", "sample").agg(F.min("page").alias("_page"))
    joined = tagged.join(first.withColumnRenamed("sample", "_sample"), ["source_file", "_sample"], "left")
    return joined.withColumn("pages", F.when(F.size("_marked") > 0, F.col("_marked")).otherwise(
        F.array(F.coalesce("_page", F.lit(1)).cast("int")))).drop("_marked", "_sample", "_page")


def analyse_chunks(chunks_df: DataFrame, column="chunk") -> DataFrame:
    """Rows with the columns of ``chunk_analysis`` beside their own."""
    return spread(chunks_df).withColumn("_a", chunk_analysis(column)).select(*chunks_df.columns, "_a.*")


def assemble_chunks(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks of full texts with their analysis and pages."""
    made = chunk_documents(documents.select("source_file", "text"))
    return chunk_pages(made, pages).withColumn("_a", chunk_analysis("chunk")).select(
        "source_file", "chunk_id", F.col("chunk").alias("text"), "pages", "_a.*")


def page_analysis(text, page_number) -> Column:
    """Pattern-based page metadata: area, table, fields, concepts, type and summary."""
    text = F.col(text) if isinstance(text, str) else text
    area = first_match(text, K.AREA_PATTERNS, "i")
    table = first_match(text, K.TABLE_PATTERNS)
    names = F.filter(
        F.concat(*[head(all_matches(text, p, 1, "m"), 10) for p in K.FIELD_PATTERNS]),
        lambda m: (F.length(m) > 3) & F.contains(m, F.lit("_")))
    blank = F.lit("")
    fields = F.transform(names, lambda n: F.struct(
        n.alias("field_name"), blank.alias("data_type"), blank.alias("description"), blank.alias("constraints")))
    kind = (F.when((table != "") | (F.size(names) > 0), "field_definitions")
            .when(F.contains(text, F.lit("Code")) & F.contains(text, F.lit("Description")), "code_mappings")
            .when(area != "", "table_definition").otherwise("documentation"))
    concepts = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(area, table), names), filled)))
    return F.struct(
        kind.alias("content_type"), area.alias("functional_area"), table.alias("table_name"), fields.alias("fields"),
        F.expr("cast(array() as array<string>)").alias("relationships"), concepts.alias("key_concepts"),
        F.concat(F.lit("Page "), page_number.cast("string"), F.lit(": "), kind, F.lit(" for "),
                 F.when(area != "", area).otherwise("unknown area")).alias("summary"),
        F.lit("pattern_based").alias("analysis_method"), page_number.cast("int").alias("page_number"))


def source_inventory(files: DataFrame) -> DataFrame:
    """Functions, classes, imports and assigned names per line of script text (path, text).

    Line-based: a definition that spans lines is found by its first line; indented assignments count.
    """
    line = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    code = F.col("line")

    def grab(pattern, group=1):
        return F.nullif(F.regexp_extract(code, pattern, group), F.lit(""))

    definition = grab(r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(")
    arguments = F.regexp_extract(code, r"^\s*(?:async\s+)?def\s+[A-Za-z_]\w*\s*\(([^)]*)\)?", 1)
    imported_from = grab(r"^\s*from\s+([\w.]+)\s+import\s")
    plain = grab(r"^\s*import\s+([\w., ]+)")
    assigned = grab(r"^\s*([A-Za-z_]\w*)\s*=(?:[^=]|$)")

    def item(kind, name, args=None):
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), (F.lit(None).cast("string") if args is None else args).alias("detail"))

    def names(text):
        return F.filter(F.transform(F.split(text, ","), strip), lambda n: n != "")

    empty = F.expr("cast(array() as array<struct<kind:string,name:string,detail:string>>)")
    from_names = F.regexp_extract(code, r"^\s*from\s+[\w.]+\s+import\s+\(?([\w,.* ]*)", 1)
    items = (
        F.when(definition.isNotNull(), F.array(item("function", definition, arguments)))
        .when(grab(r"^\s*class\s+([A-Za-z_]\w*)").isNotNull(), F.array(item("class", grab(r"^\s*class\s+([A-Za-z_]\w*)"))))
        .when(imported_from.isNotNull(), F.transform(names(from_names), lambda n: item("import", imported_from, n)))
        .when(plain.isNotNull(), F.transform(names(plain), lambda n: item("import", F.split(n, " ")[0])))
        .when(assigned.isNotNull(), F.array(item("variable", assigned))).otherwise(empty))
    return line.select("path", (F.col("at") + 1).alias("line_number"), F.inline(items))


def inventory_counts(inventory: DataFrame) -> DataFrame:
    kinds = {"functions": "function", "classes": "class", "imports": "import", "variables": "variable"}
    return inventory.groupBy("path").agg(*[F.count_if(F.col("kind") == v).alias(k) for k, v in kinds.items()])

