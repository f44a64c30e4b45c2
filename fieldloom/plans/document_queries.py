"""Queries over document rows, pages, chunks and prompts."""

from pyspark.sql import functions as F

from fieldloom.functions.text import entity_list, head, json_span, preview
from fieldloom.operators import chunks as CH
from fieldloom.operators import collection as CO
from fieldloom.operators import documents as DO
from fieldloom.operators import prompts as PR
from fieldloom.operators import reports as RE
from fieldloom.operators import responses as MR
from fieldloom.plans import bindings as B
from fieldloom.plans.registry import query, table


@query("prj4_page_description", f"""WITH {B.PA} SELECT source_file, page_number, 'Page ' || page_number || ' - ' || concat_ws('. ',
  CASE WHEN area <> '' THEN 'Functional Area: ' || area END, CASE WHEN tab <> '' THEN 'Table: ' || tab END,
  CASE WHEN len(names) > 0 THEN 'Fields: ' || array_to_string(names[1:5], ', ') END,
  CASE WHEN len(concepts) > 0 THEN 'Key concepts: ' || array_to_string(concepts[1:3], ', ') END, 'Summary: ' || summary) AS content FROM pd
  WHERE page_number <> 0
UNION ALL SELECT source_file, page_number, concat_ws('. ',
  CASE WHEN area <> '' THEN 'Functional Area: ' || area END, CASE WHEN tab <> '' THEN 'Table: ' || tab END,
  CASE WHEN len(names) > 0 THEN 'Fields: ' || array_to_string(names[1:5], ', ') END,
  CASE WHEN len(concepts) > 0 THEN 'Key concepts: ' || array_to_string(concepts[1:3], ', ') END, 'Summary: ' || summary) FROM pd WHERE page_number = 0""")
def prj4(spark, sf_dir):
    pages = B.dictionary_pages(spark, sf_dir)
    made = pages.withColumn("page", CH.page_analysis("text", F.col("page_number")))
    return made.select("source_file", "page_number", DO.page_description(F.col("page"), F.col("text")).alias("content"))


@query("prj5_flat_metadata", """SELECT event_id, user_id::VARCHAR AS user_id, array_to_string([event_type, (event_id % 7)::VARCHAR], ', ') AS tags,
  '{"kind":"' || event_type || '","n":' || event_id || '}' AS nested FROM events""")
def prj5(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.array("event_type", (F.col("event_id") % 7).cast("string")).alias("tags"),
        F.struct(F.col("event_type").alias("kind"), F.col("event_id").alias("n")).alias("nested"))
    flat = e.withColumn("m", DO.flat_metadata(e, ["user_id", "tags", "nested"]))
    return flat.select("event_id", F.col("m")["user_id"].alias("user_id"), F.col("m")["tags"].alias("tags"), F.col("m")["nested"].alias("nested"))


@query("prj6_stamps", f"WITH {B.C} SELECT id, length(document)::INTEGER AS doc_length, true AS stamped FROM c")
def prj6(spark, sf_dir):
    return DO.stamped(B.collection(spark, sf_dir)).select("id", "doc_length", F.col("ts").isNotNull().alias("stamped"))


@query("prj7_document_nodes", f"""WITH {B.D} SELECT doc_id AS id, type AS node_type, 'content_length=' || length(content) || '|' ||
  CASE WHEN lang = 'fr' AND n % 2 = 0 THEN 'description=' || content || '|' ELSE '' END || 'lang=' || lang || '|node_type=' || type || '|row_number=' || n || '|source_file=' || source_file AS attrs FROM d""")
def prj7(spark, sf_dir):
    shown = F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return DO.document_nodes(B.documents(spark, sf_dir)).select("id", "node_type", F.array_join(shown, "|").alias("attrs"))


def _neighbour_pairs(spark, sf_dir):
    """Each document with the one after it, as structs for pair descriptions."""
    d = table(spark, sf_dir, "documents")
    kind = (F.when(F.col("lang") == "en", "csv_row").when(F.col("lang") == "fr", "pdf_chunk").when(F.col("lang") == "de", "data_mapping").otherwise("pdf"))
    n = F.col("doc_id")
    meta = F.when(n % 2 == 0, F.create_map(F.lit("description"), F.col("text"), F.lit("row_number"), n.cast("string"),
                                           F.lit("_mapping_relationship"), F.concat(F.lit("{'source': 't.c', 'target': \"f'"), n.cast("string"), F.lit("\"}")))).otherwise(F.create_map(F.lit("source_file"), F.col("source")))
    shaped = d.select(n.alias("n"), "text", F.struct(
        kind.alias("type"), F.col("text").alias("content"), meta.alias("metadata"), F.array("lang", "source").alias("functional_areas"),
        F.array(F.concat(F.lit("k"), (n % 3).cast("string")), F.concat(F.lit("k"), (n % 5 + 3).cast("string")), F.col("lang")).alias("key_terms"),
        F.array((n % 7).cast("int")).alias("pages")).alias("doc"))
    after = shaped.select((F.col("n") - 1).alias("n"), F.col("doc").alias("other"), F.col("text").alias("other_text"))
    return shaped.join(after, "n").withColumn("similarity", (F.col("n") % 1000) / F.lit(1000.0))


PAIRS = """p AS (SELECT doc_id AS n, text, source, lang, CASE lang WHEN 'en' THEN 'csv_row' WHEN 'fr' THEN 'pdf_chunk' WHEN 'de' THEN 'data_mapping' ELSE 'pdf' END AS type,
  CASE lang WHEN 'fr' THEN CASE WHEN doc_id % 2 = 0 THEN CASE WHEN length(text) > 80 THEN substring(text, 1, 77) || '...' ELSE text END ELSE 'PDF chunk: ' || substring(text, 1, 50) || '...' END
    WHEN 'en' THEN 'CSV row ' || CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE 'unknown' END || ' from ' || CASE WHEN doc_id % 2 = 0 THEN 'unknown' ELSE source END
    WHEN 'de' THEN 'Mapping: ' || CASE WHEN doc_id % 2 = 0 THEN 't.c → f''' || doc_id ELSE 'unknown → unknown' END
    ELSE CASE WHEN text <> '' THEN 'pdf: ' || substring(text, 1, 50) || '...' ELSE 'pdf' END END AS short,
  [lang, source] AS areas, ['k' || (doc_id % 3), 'k' || (doc_id % 5 + 3), lang] AS terms FROM documents),
  j AS (SELECT a.*, b.short AS short_b, b.type AS type_b, b.text AS text_b, b.n AS nb, (a.n % 1000) / 1000.0::DOUBLE AS similarity,
    list_sort(list_distinct(list_intersect(a.areas, b.areas))) AS common_areas, list_sort(list_distinct(list_intersect(a.terms, b.terms))) AS common_terms FROM p a JOIN p b ON b.n = a.n + 1)"""


@query("prj10_pair_description", f"""WITH {PAIRS} SELECT n, CASE WHEN similarity > 0.9 THEN 'Very high similarity' WHEN similarity > 0.8 THEN 'High similarity'
  WHEN similarity > 0.7 THEN 'Moderate similarity' ELSE 'Low similarity' END || ' (' || printf('%.3f', similarity) || ') between ''' || short || ''' and ''' || short_b || ''''
  || CASE WHEN type = 'pdf_chunk' AND type_b = 'pdf_chunk' THEN
    CASE WHEN len(common_areas) > 0 THEN ' | Shared functional areas: ' || array_to_string(common_areas, ', ') ELSE '' END
    || CASE WHEN len(common_terms) > 0 THEN ' | Common terms: ' || array_to_string(common_terms[1:3], ', ') ELSE '' END
    || ' | Pages: ' || (n % 7) || '-' || (nb % 7) ELSE '' END AS description FROM j""")
def prj10(spark, sf_dir):
    pairs = _neighbour_pairs(spark, sf_dir)
    return pairs.select("n", DO.pair_description(F.col("doc"), F.col("other"), F.col("similarity")).alias("description"))


@query("prj11_short_description", f"WITH {PAIRS} SELECT n, short FROM p WHERE EXISTS (SELECT 1 FROM p q WHERE q.n = p.n + 1)")
def prj11(spark, sf_dir):
    return _neighbour_pairs(spark, sf_dir).select("n", DO.short_description(F.col("doc")).alias("short"))


@query("prj12_pair_summary", f"WITH {PAIRS} SELECT n, 'Doc1: ' || substring(text, 1, 100) || '... | Doc2: ' || substring(text_b, 1, 100) || '...' AS summary FROM j")
def prj12(spark, sf_dir):
    return _neighbour_pairs(spark, sf_dir).select("n", DO.pair_summary(F.col("text"), F.col("other_text")).alias("summary"))


@query("set3_shared_terms", f"WITH {PAIRS} SELECT n, array_to_string(common_areas, '|') AS areas, array_to_string(common_terms, '|') AS terms FROM j")
def set3(spark, sf_dir):
    pairs = _neighbour_pairs(spark, sf_dir)

    def both(name):
        return F.array_join(F.array_sort(F.array_intersect(F.col("doc")[name], F.col("other")[name])), "|")

    return pairs.select("n", both("functional_areas").alias("areas"), both("key_terms").alias("terms"))


@query("flt2_content_present", "SELECT doc_id FROM documents WHERE lang <> 'es' AND trim(text, chr(10) || chr(9) || ' ') <> ''")
def flt2(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "es", " \t\n").otherwise(F.col("text")).alias("content"))
    return DO.with_content(d).select("doc_id")


@query("flt11_long_texts", "SELECT doc_id FROM documents WHERE length(text) > 100")
def flt11(spark, sf_dir):
    return DO.long_texts(table(spark, sf_dir, "documents"), "text").select("doc_id")


@query("txt1_chunks", """WITH RECURSIVE c(doc_id, text, pos, n, ord) AS (
  SELECT doc_id, text, 0, CASE WHEN 700 < length(text) AND strpos(reverse(substring(text, 1, 700)), ' ') > 0 AND 700 - strpos(reverse(substring(text, 1, 700)), ' ') > 560
    THEN 700 - strpos(reverse(substring(text, 1, 700)), ' ') ELSE 700 END, 0 FROM documents WHERE length(text) > 700
  UNION ALL SELECT doc_id, text, pos + n - 100, CASE WHEN pos + n + 600 < length(text) AND strpos(reverse(substring(text, pos + n - 99, 700)), ' ') > 0
      AND 700 - strpos(reverse(substring(text, pos + n - 99, 700)), ' ') > 560 THEN 700 - strpos(reverse(substring(text, pos + n - 99, 700)), ' ') ELSE 700 END, ord + 1
  FROM c WHERE pos + n - 100 < length(text))
SELECT doc_id, ord::INTEGER AS chunk_id, trim(substring(text, pos + 1, n), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS chunk FROM c
UNION ALL SELECT doc_id, 0::INTEGER, text FROM documents WHERE length(text) <= 700""")
def txt1(spark, sf_dir):
    return CH.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "chunk_id", "chunk")


@query("win5_chunk_ordinals", "SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS at FROM conversations")
def win5(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line"))


ANALYSIS = r"""w AS (SELECT *, string_split(text, chr(10)) AS lines, lower(text) AS low FROM documents),
  x AS (SELECT *, list_concat(list_concat(regexp_extract_all(text, '[A-Z][0-9]+\.[0-9]+')[1:5], regexp_extract_all(text, '[A-Z_]{3,}')[1:5]), regexp_extract_all(text, '[A-Z]{2,}_[A-Z_]+')[1:5]) AS codes,
    list_concat(list_concat(regexp_extract_all(low, '(?i)functional area[:\s\x{A0}]+([A-Z_]+)', 1), regexp_extract_all(low, '(?i)area[:\s\x{A0}]+([A-Z_]+)', 1)), regexp_extract_all(low, '(?i)domain[:\s\x{A0}]+([A-Z_]+)', 1)) AS areas,
    list_filter(flatten(list_transform(lines[1:5], lambda l: regexp_split_to_array(l, '[\s\x{A0}]+'))), lambda v: length(v) > 4 AND regexp_full_match(v, '\p{L}+')
      AND v NOT IN ('Description', 'Code', 'Table', 'Page'))[1:5] AS words, trim(lines[1], ' ' || chr(9) || chr(13) || chr(160)) AS first,
    contains(low, 'table') OR contains(low, 'column') OR contains(low, 'field') OR contains(low, 'definition') OR contains(low, 'description') AS has_table_data FROM w)"""


@query("txt3_chunk_analysis", f"""WITH {ANALYSIS} SELECT doc_id, CASE WHEN has_table_data THEN 'data_dictionary' ELSE 'general' END AS content_type, has_table_data, len(codes) > 0 AS has_codes,
  array_to_string(list_sort(list_distinct(list_concat(codes, words)[1:10])), '|') AS key_terms, array_to_string(list_sort(list_distinct(areas)), '|') AS functional_areas,
  CASE WHEN length(first) > 100 THEN substring(first, 1, 97) || '...' ELSE first END || CASE WHEN len(codes) > 0 THEN ' | Contains: ' || array_to_string(codes[1:3], ', ') ELSE '' END
  || CASE WHEN len(areas) > 0 THEN ' | Area: ' || array_to_string(areas[1:2], ', ') ELSE '' END AS description FROM x""")
def txt3(spark, sf_dir):
    made = CH.analyse_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return made.select("doc_id", "content_type", "has_table_data", "has_codes", F.array_join("key_terms", "|").alias("key_terms"),
                       F.array_join("functional_areas", "|").alias("functional_areas"), "description")


@query("top4_array_heads", f"""WITH {ANALYSIS} SELECT doc_id, array_to_string(codes[1:3], '|') AS codes, array_to_string(words[1:2], '|') AS words FROM x""")
def top4(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    from fieldloom import constants as K
    from fieldloom.functions.text import all_matches
    codes = F.concat(*[head(all_matches(F.col("text"), p), 5) for p in K.CODE_PATTERNS])
    words = F.flatten(F.transform(head(F.split("text", "\n"), 5), lambda line: F.split(line, r"(?U)\s+")))
    kept = F.filter(words, lambda w: (F.length(w) > 4) & w.rlike(r"^\p{L}+$") & ~w.isin(*K.UNIMPORTANT_WORDS))
    return d.select("doc_id", F.array_join(head(codes, 3), "|").alias("codes"), F.array_join(head(kept, 2), "|").alias("words"))


@query("set4_distinct_codes", r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Z_]{3,}'))), '|') AS codes FROM documents""")
def set4(spark, sf_dir):
    from fieldloom.functions.text import all_matches
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(all_matches(F.col("text"), "[A-Z_]{3,}"))), "|").alias("codes"))


def _chunks_and_pages(spark, sf_dir):
    """Conversation turns as pages; every fourth turn's text carries a page marker when chunked."""
    c = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv_"), (F.col("conv_id") % 50).cast("string")).alias("source_file"), (F.col("conv_id") * 100 + F.col("turn")).alias("page_number"), "text")
    marked = F.when(F.col("page_number") % 4 == 0, F.concat(F.lit("--- Page "), F.col("page_number").cast("string"), F.lit(" ---\n"), "text")).otherwise(F.col("text"))
    made = CH.chunk_documents(c.select("source_file", F.col("page_number").alias("own_page"), marked.alias("text")))
    return made, c


@query("txt4_chunk_pages", r"""WITH RECURSIVE s AS (SELECT 'conv_' || (conv_id % 50) AS source_file, conv_id * 100 + turn AS page_number, text FROM conversations),
  t AS (SELECT source_file, page_number AS own_page, CASE WHEN page_number % 4 = 0 THEN '--- Page ' || page_number || ' ---' || chr(10) || text ELSE text END AS text FROM s),
  c(source_file, own_page, text, pos, n, ord) AS (
  SELECT source_file, own_page, text, 0, CASE WHEN 700 < length(text) AND strpos(reverse(substring(text, 1, 700)), ' ') > 0 AND 700 - strpos(reverse(substring(text, 1, 700)), ' ') > 560
    THEN 700 - strpos(reverse(substring(text, 1, 700)), ' ') ELSE 700 END, 0 FROM t WHERE length(text) > 700
  UNION ALL SELECT source_file, own_page, text, pos + n - 100, CASE WHEN pos + n + 600 < length(text) AND strpos(reverse(substring(text, pos + n - 99, 700)), ' ') > 0
      AND 700 - strpos(reverse(substring(text, pos + n - 99, 700)), ' ') > 560 THEN 700 - strpos(reverse(substring(text, pos + n - 99, 700)), ' ') ELSE 700 END, ord + 1
  FROM c WHERE pos + n - 100 < length(text)),
  k AS (SELECT source_file, own_page, ord::INTEGER AS chunk_id, trim(substring(text, pos + 1, n), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS chunk FROM c
    UNION ALL SELECT source_file, own_page, 0::INTEGER, text FROM t WHERE length(text) <= 700),
  g AS (SELECT *, regexp_extract_all(chunk, '--- Page (\d+) ---', 1) AS marks, trim(substring(chunk, 1, 200), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS sample FROM k)
SELECT own_page, chunk_id, CASE WHEN len(marks) > 0 THEN array_to_string(marks, ',')
  ELSE coalesce((SELECT min(page_number) FROM s WHERE s.source_file = g.source_file AND contains(s.text, g.sample)), 1)::VARCHAR END AS pages FROM g""")
def txt4(spark, sf_dir):
    made, pages = _chunks_and_pages(spark, sf_dir)
    return CH.chunk_pages(made, pages).select("own_page", "chunk_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query("txt2_assembled_chunks", f"""WITH RECURSIVE s AS (SELECT 'c' || conv_id || '_' || turn AS source_file, turn + 1 AS page_number, text FROM conversations),
  c(source_file, text, pos, n, ord) AS (
  SELECT source_file, text, 0, CASE WHEN 700 < length(text) AND strpos(reverse(substring(text, 1, 700)), ' ') > 0 AND 700 - strpos(reverse(substring(text, 1, 700)), ' ') > 560
    THEN 700 - strpos(reverse(substring(text, 1, 700)), ' ') ELSE 700 END, 0 FROM s WHERE length(text) > 700
  UNION ALL SELECT source_file, text, pos + n - 100, CASE WHEN pos + n + 600 < length(text) AND strpos(reverse(substring(text, pos + n - 99, 700)), ' ') > 0
      AND 700 - strpos(reverse(substring(text, pos + n - 99, 700)), ' ') > 560 THEN 700 - strpos(reverse(substring(text, pos + n - 99, 700)), ' ') ELSE 700 END, ord + 1
  FROM c WHERE pos + n - 100 < length(text)),
  documents AS (SELECT source_file, ord::INTEGER AS chunk_id, trim(substring(text, pos + 1, n), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS text FROM c
    UNION ALL SELECT source_file, 0::INTEGER, text FROM s WHERE length(text) <= 700), {ANALYSIS}
SELECT x.source_file, chunk_id, x.text, CASE WHEN contains(s.text, trim(substring(x.text, 1, 200), ' ' || chr(9) || chr(10) || chr(13) || chr(160))) THEN page_number ELSE 1 END::VARCHAR AS pages,
  CASE WHEN has_table_data THEN 'data_dictionary' ELSE 'general' END AS content_type, array_to_string(list_sort(list_distinct(list_concat(codes, words)[1:10])), '|') AS key_terms,
  CASE WHEN length(first) > 100 THEN substring(first, 1, 97) || '...' ELSE first END || CASE WHEN len(codes) > 0 THEN ' | Contains: ' || array_to_string(codes[1:3], ', ') ELSE '' END
  || CASE WHEN len(areas) > 0 THEN ' | Area: ' || array_to_string(areas[1:2], ', ') ELSE '' END AS description, has_table_data, len(codes) > 0 AS has_codes,
  array_to_string(list_sort(list_distinct(areas)), '|') AS functional_areas FROM x JOIN s ON s.source_file = x.source_file""")
def txt2(spark, sf_dir):
    """Conversation texts as files of one page each: chunks with analysis and pages."""
    c = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("source_file"), (F.col("turn") + 1).alias("page_number"), "text")
    return CH.assemble_chunks(c, c).withColumns({n: F.array_join(F.col(n).cast("array<string>"), "|") for n in ("pages", "key_terms", "functional_areas")})


@query("txt5_page_analysis", f"""WITH {B.PA} SELECT source_file, page_number, kind AS content_type, area AS functional_area, tab AS table_name,
  array_to_string(names, '|') AS fields, array_to_string(concepts, '|') AS key_concepts, summary FROM pd""")
def txt5(spark, sf_dir):
    made = B.dictionary_pages(spark, sf_dir).withColumn("p", CH.page_analysis("text", F.col("page_number")))
    return made.select("source_file", "page_number", "p.content_type", "p.functional_area", "p.table_name",
                       F.array_join(F.col("p.fields.field_name"), "|").alias("fields"), F.array_join("p.key_concepts", "|").alias("key_concepts"), "p.summary")


def _scripts(spark, sf_dir):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("s"), key, F.lit(".py")).alias("path"), F.concat(
        F.lit("import os, sys as system\nfrom pkg.mod import a, b as c\n\nclass Part"), key, F.lit(":\n    def size_"), size,
        F.lit("(self, x):\n        y = x == 1\n        return y\n\nLIMIT = "), size, F.lit("\n")).alias("text"))


@query("txt6_script_inventory", """WITH p AS (SELECT 's' || p_partkey || '.py' AS path, p_partkey AS k, p_size AS s FROM part)
SELECT path, 1 AS line_number, 'import' AS kind, 'os' AS name, NULL AS detail FROM p UNION ALL SELECT path, 1, 'import', 'sys', NULL FROM p
UNION ALL SELECT path, 2, 'import', 'pkg.mod', 'a' FROM p UNION ALL SELECT path, 2, 'import', 'pkg.mod', 'b as c' FROM p
UNION ALL SELECT path, 4, 'class', 'Part' || k, NULL FROM p UNION ALL SELECT path, 5, 'function', 'size_' || s, 'self, x' FROM p
UNION ALL SELECT path, 6, 'variable', 'y', NULL FROM p UNION ALL SELECT path, 9, 'variable', 'LIMIT', NULL FROM p""")
def txt6(spark, sf_dir):
    return CH.source_inventory(_scripts(spark, sf_dir))


@query("txt6_inventory_counts", "SELECT 's' || p_partkey || '.py' AS path, 1::BIGINT AS functions, 1::BIGINT AS classes, 4::BIGINT AS imports, 2::BIGINT AS variables FROM part")
def txt6_counts(spark, sf_dir):
    return CH.inventory_counts(CH.source_inventory(_scripts(spark, sf_dir)))


@query("txt7_json_pull", """SELECT event_id, CASE WHEN event_type <> 'error' THEN props END AS span,
  CASE WHEN event_type NOT IN ('error', 'view') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def txt7(spark, sf_dir):
    kind = F.col("event_type")
    reply = F.when(kind == "error", "no braces here }").otherwise(F.concat(F.lit("Sure:\n"), F.col("props"), F.lit("\ndone")))
    e = table(spark, sf_dir, "events").withColumn("span", json_span(reply))
    parsed = F.from_json(F.when(kind == "view", F.concat(F.lit("{,"), "span")).otherwise(F.col("span")), "struct<k:bigint>")
    return e.select("event_id", "span", parsed["k"].alias("k"))


@query("txt8_entity_list", "SELECT p_partkey, p_name || '|' || p_type || '|' || p_brand AS entities FROM part")
def txt8(spark, sf_dir):
    text = F.concat(F.lit(" "), "p_name", F.lit(" ,, "), "p_type", F.lit(",\t"), "p_brand", F.lit(", "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(entity_list(text), "|").alias("entities"))


@query("txt9_truncation", """SELECT doc_id, md5(substring(text, 1, 200)) AS c200, md5(substring(text, 1, 512)) AS c512, length(substring(text, 1, 2000))::INTEGER AS n2000,
  length(substring(text, 1, 3000))::INTEGER AS n3000 FROM documents""")
def txt9(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(preview(t, 200).cast("binary")).alias("c200"), F.md5(PR.embedding_input(t).cast("binary")).alias("c512"),
        F.length(preview(t, PR.PAGE_CHARS)).alias("n2000"), F.length(preview(t, PR.CONTEXT_CHARS)).alias("n3000"))


@query("txt10_reply_text", "SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN NULL ELSE text END AS reply FROM conversations")
def txt10(spark, sf_dir):
    t, kind = F.col("text"), F.col("turn") % 4
    message = F.struct(F.struct(t.alias("content")).alias("message"))
    reply = (F.when(kind == 0, F.to_json(F.struct(F.array(message).alias("choices"))))
             .when(kind == 1, F.to_json(F.struct(F.array(F.struct(t.alias("text"))).alias("content"))))
             .when(kind == 2, F.to_json(F.struct(t.alias("content")))).otherwise("{\"error\": 1}"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", MR.reply_text(reply).alias("reply"))


@query("txt11_chat_messages", """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END::INTEGER AS entries, text AS user_text,
  CASE WHEN turn % 2 = 0 THEN 'Act as ' || role END AS system_text FROM conversations""")
def txt11(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    system = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Act as "), "role")).otherwise("")
    parsed = F.from_json(PR.messages(F.col("text"), system), "array<struct<role:string,content:string>>")
    made = c.select("conv_id", "turn", parsed.alias("m"))
    return made.select("conv_id", "turn", F.size("m").alias("entries"), F.filter("m", lambda x: x["role"] == "user")[0]["content"].alias("user_text"),
                       F.get(F.filter("m", lambda x: x["role"] == "system")["content"], F.lit(0)).alias("system_text"))


@query("txt11_prompts", """SELECT p_partkey, length(p_name || ', ' || p_type)::INTEGER AS field_chars, true AS has_fields, true AS has_target FROM part""")
def txt11_prompts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    fields = F.array("p_name", "p_type")
    made = part.select("p_partkey", F.array_join(fields, ", ").alias("listed"), "p_brand", PR.mapping_prompt(fields, F.col("p_brand")).alias("prompt"))
    return made.select("p_partkey", F.length("listed").alias("field_chars"), F.contains("prompt", F.col("listed")).alias("has_fields"),
                       F.endswith(F.col("prompt"), F.col("p_brand")).alias("has_target"))


@query("txt11_insight_prompt", f"""WITH {B.ME}, h AS (SELECT * FROM me ORDER BY src, dst LIMIT 10) SELECT count(*) AS mappings_shown FROM h""")
def txt11_insight(spark, sf_dir):
    return PR.insight_prompt(B.mapping_links(spark, sf_dir)).select("mappings_shown")


@query("agg11_processing_summary", f"""WITH {B.D} SELECT source_file, count(*) AS documents, count(*) FILTER (type = 'csv_row') AS csv_rows, count(*) FILTER (type = 'pdf_page') AS pdf_pages,
  count(*) FILTER (type = 'pdf_chunk') AS pdf_chunks, count(*) FILTER (type = 'python') AS pythons FROM d GROUP BY source_file""")
def agg11(spark, sf_dir):
    return RE.processing_summary(B.documents(spark, sf_dir))


@query("agg14_rows_per_source", f"WITH {B.D} SELECT source_file, count(*) AS rows FROM d WHERE type = 'csv_row' GROUP BY source_file")
def agg14(spark, sf_dir):
    return RE.rows_per_source(B.documents(spark, sf_dir))


@query("agg10_field_names", "SELECT DISTINCT p_brand || '.csv' AS source_file, unnest(['Row', p_name, p_type]) AS field FROM part")
def agg10(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(".csv")).alias("source_file"), F.map_from_arrays(
        F.array(F.lit("Row"), F.col("p_name"), F.col("p_type")), F.array(F.lit("1"), F.lit("2"), F.lit("3"))).alias("metadata"))
    return rows.select("source_file", F.explode(F.map_keys("metadata")).alias("field")).distinct()


@query("dml1_add_documents", """SELECT 'doc_' || ((SELECT count(*) FROM embeddings) + row_number() OVER (ORDER BY doc_id) - 1) AS doc_id, doc_id AS n,
  CASE WHEN lang = 'de' THEN 'data_mapping' ELSE 'document' END AS type FROM documents""")
def dml1(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), F.col("text").alias("content"), F.when(
        F.col("lang") == "de", F.create_map(F.lit("_mapping_type"), F.lit("data_mapping"))).otherwise(F.create_map(F.lit("lang"), F.col("lang"))).alias("metadata"))
    return CO.add_documents(B.vectors(spark, sf_dir), d, ["n"]).select("doc_id", "n", "type")


