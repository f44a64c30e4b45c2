"""Queries over vectors, collections and retrieval."""

from pyspark.sql import functions as F

from fieldloom.functions import vectors as V
from fieldloom.operators import collection as CO
from fieldloom.operators import embedding as EM
from fieldloom.operators import retrieval as RO
from fieldloom.operators import similarity as SI
from fieldloom.operators.graph import contains_edges
from fieldloom.plans import bindings as B
from fieldloom.plans.registry import query, table
from fieldloom.session import scratch_path
from fieldloom.sources import stores

COS = "list_cosine_similarity(a.e, b.e)"
L2 = "list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def first_vector(spark, sf_dir):
    """The stored vector with the smallest id, as a query vector."""
    return B.vectors(spark, sf_dir).orderBy("id").limit(1).first()["embedding"]


FIRST = "q AS (SELECT * FROM c ORDER BY id LIMIT 1)"


def _r(name):
    return F.round(name, 6).alias(name)


@query("vec1_cosine", f"WITH {B.C}, {FIRST} SELECT a.id, round({COS}, 6) AS similarity FROM c a, q b")
def vec1(spark, sf_dir):
    probe = V.literal(first_vector(spark, sf_dir))
    return B.vectors(spark, sf_dir).select("id", F.round(V.cosine(F.col("embedding"), probe), 6).alias("similarity"))


@query("vec2_squared_l2", f"WITH {B.C}, {FIRST} SELECT a.id, round({L2}, 6) AS distance, round(1 - {L2}, 6) AS score FROM c a, q b")
def vec2(spark, sf_dir):
    probe = V.literal(first_vector(spark, sf_dir))
    made = B.vectors(spark, sf_dir).select("id", V.squared_l2(F.col("embedding"), probe).alias("distance"))
    return made.select("id", _r("distance"), F.round(1.0 - F.col("distance"), 6).alias("score"))


@query("vec3_text_vectors", "SELECT doc_id AS id, 256::INTEGER AS dim, CASE WHEN trim(text) = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS length FROM documents")
def vec3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    made = EM.fit_text_vectors(docs)(docs)
    return made.select("id", F.size("embedding").alias("dim"), F.round(V.norm(F.col("embedding")), 4).alias("length"))


@query("agg12_load_report", """SELECT count(*) AS total_texts, count(*) FILTER (lang <> 'es') AS documents_added, count(*) FILTER (lang = 'es') AS failed_embeddings FROM documents""")
def agg12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "es", " ").otherwise(F.col("text")).alias("content"))
    return EM.load_report(EM.fit_text_vectors(docs, 64)(docs))


@query("top1_nearest", f"""WITH {B.C}, {FIRST}, s AS (SELECT a.id, a.document, {L2} AS distance FROM c a, q b)
SELECT id, round(distance, 6) AS distance, round(1 - distance, 6) AS similarity, length(document)::INTEGER AS doc_length FROM s ORDER BY s.distance, id LIMIT 5""")
def top1(spark, sf_dir):
    found = SI.nearest(B.collection(spark, sf_dir), first_vector(spark, sf_dir), 5)
    return found.select("id", _r("distance"), _r("similarity"), F.length("document").alias("doc_length"))


@query("flt4_metadata_search", f"""WITH {B.C}, {FIRST}, s AS (SELECT a.id, {L2} AS distance FROM c a, q b WHERE a.label = 4)
SELECT id, round(distance, 6) AS distance FROM s ORDER BY s.distance, id LIMIT 5""")
def flt4(spark, sf_dir):
    found = SI.nearest(B.collection(spark, sf_dir), first_vector(spark, sf_dir), 5, where={"label": "4"})
    return found.select("id", _r("distance"))


@query("jn4_nearest_many", f"""WITH {B.C}, s AS (SELECT b.id AS query_id, a.id, {COS} AS similarity, row_number() OVER (PARTITION BY b.id ORDER BY round(1 - {COS}, 9), a.id) AS rank FROM c a, c b)
SELECT query_id, rank, id, round(similarity, 6) AS similarity FROM s WHERE rank <= 5""")
def jn4(spark, sf_dir):
    v = B.vectors(spark, sf_dir)
    found = SI.nearest_many(v, v.select(F.col("id").alias("query_id"), "embedding"), 5, "cosine")
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", _r("similarity"))


@query("jn5_threshold_search", f"WITH {B.C}, {FIRST} SELECT a.id, round({COS}, 6) AS similarity FROM c a, q b WHERE {COS} >= 0.1")
def jn5(spark, sf_dir):
    return SI.similar_to(B.vectors(spark, sf_dir), first_vector(spark, sf_dir), 0.1).select("id", _r("similarity"))


@query("jn6_similar_documents", f"""WITH {B.C}, s AS (SELECT a.id, {L2} AS distance FROM c a, c b WHERE b.id = 7 AND a.id <> 7)
SELECT id, round(distance, 6) AS distance FROM s ORDER BY s.distance, id LIMIT 5""")
def jn6(spark, sf_dir):
    return SI.similar_documents(B.vectors(spark, sf_dir), 7, 5).select("id", _r("distance"))


@query("jn2_content_pairs", f"WITH {B.C} SELECT a.id AS id_a, b.id AS id_b, round({COS}, 6) AS similarity FROM c a JOIN c b ON a.id < b.id WHERE {COS} >= 0.35")
def jn2(spark, sf_dir):
    pairs, copies = SI.content_relationships(B.vectors(spark, sf_dir), 0.35)
    return pairs.unionByName(SI.copy_edges(copies)).select("id_a", "id_b", _r("similarity"))


@query("jn3_field_pairs", f"""WITH {B.C} SELECT 'sheet_' || a.label AS source_file, 'f' || least(a.id, b.id) AS f1, 'f' || greatest(a.id, b.id) AS f2, round({COS}, 6) AS similarity
FROM c a JOIN c b ON a.label = b.label AND a.id < b.id WHERE {COS} >= 0.25""")
def jn3(spark, sf_dir):
    fields = B.vectors(spark, sf_dir).select(F.concat(F.lit("sheet_"), F.col("label").cast("string")).alias("source_file"),
                                             F.concat(F.lit("f"), F.col("id").cast("string")).alias("field"), "embedding")
    pairs, copies = SI.field_similarities(fields, 0.25)
    both = pairs.unionByName(SI.copy_edges(copies, ["source_file"]))
    a, b = F.substring("id_a", 2, 20).cast("bigint"), F.substring("id_b", 2, 20).cast("bigint")
    return both.select("source_file", F.concat(F.lit("f"), F.least(a, b).cast("string")).alias("f1"),
                       F.concat(F.lit("f"), F.greatest(a, b).cast("string")).alias("f2"), _r("similarity"))


@query("jn15_attach_documents", f"WITH {B.C}, {B.D} SELECT 'doc_' || id AS id, type, source_file, lang FROM c JOIN d ON n = id")
def jn15(spark, sf_dir):
    v = B.vectors(spark, sf_dir).select(F.concat(F.lit("doc_"), F.col("id").cast("string")).alias("id"), "embedding")
    return EM.attach_documents(v, B.documents(spark, sf_dir)).select("id", "type", "source_file", F.col("metadata")["lang"].alias("lang"))


def _hits(spark, sf_dir, n=3):
    """The nearest stored vectors of every vector, with their text."""
    v = B.vectors(spark, sf_dir)
    found = SI.nearest_many(v, v.select(F.col("id").alias("query_id"), "embedding"), n, "l2sq")
    named = B.collection(spark, sf_dir).select("id", "document")
    return found.join(named, "id").withColumn("id", F.concat(F.lit("doc_"), F.col("id").cast("string")))


def _context_edges(spark, sf_dir):
    """Containment, and a link from each document to one whose number has no document."""
    docs = B.documents(spark, sf_dir)
    held = contains_edges(docs).select("src", "dst")
    loose = docs.select(F.col("doc_id").alias("src"), F.concat(F.lit("doc_0_"), F.col("row_number").cast("string")).alias("dst"))
    return held.unionByName(loose)


CONTEXT = f"""WITH {B.C}, {B.D}, s AS (SELECT b.id AS query_id, a.id AS hit, a.document, {L2} AS distance, row_number() OVER (PARTITION BY b.id ORDER BY round({L2}, 9), a.id) AS rank FROM c a, c b),
  hits AS (SELECT query_id, rank, 'doc_' || hit AS hit, document, 1 - distance AS similarity FROM s WHERE rank <= 3),
  e AS (SELECT parent_document AS src, doc_id AS dst FROM d WHERE parent_document IN (SELECT doc_id FROM d) UNION ALL SELECT doc_id, 'doc_0_' || n FROM d),
  u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
  near AS (SELECT query_id, rank, hit, b AS id, row_number() OVER (PARTITION BY query_id, hit ORDER BY b) AS n FROM hits JOIN u ON a = hit),
  ctx AS (SELECT near.query_id, near.rank, near.hit, near.n, d.doc_id AS id, d.type, d.source_file, substring(d.content, 1, 300) AS content FROM near JOIN d ON d.doc_id = near.id WHERE near.n <= 5)"""


@query("jn8_graph_context", f"{CONTEXT} SELECT query_id, rank, hit, n, id, type, source_file, md5(content) AS content_md5 FROM ctx")
def jn8(spark, sf_dir):
    found = RO.graph_context(_hits(spark, sf_dir), _context_edges(spark, sf_dir), B.documents(spark, sf_dir))
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "hit", F.col("n").cast("bigint").alias("n"), "id", "type", "source_file",
                        F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("win3_neighbour_cap", f"{CONTEXT} SELECT query_id, hit, count(*) AS shown FROM near WHERE n <= 5 GROUP BY query_id, hit")
def win3(spark, sf_dir):
    edges = _context_edges(spark, sf_dir)
    every = edges.select(F.explode(F.array("src", "dst")).alias("doc_id")).distinct().withColumns(
        {"type": F.lit("x"), "source_file": F.lit("x"), "content": F.lit("x")})
    found = RO.graph_context(_hits(spark, sf_dir), edges, every)
    return found.groupBy("query_id", "hit").agg(F.count("*").alias("shown"))


@query("txt12_context_text", f"""{CONTEXT}, body AS (SELECT query_id, string_agg(chr(10) || '--- Document ' || hit || ' (similarity: ' || printf('%.3f', similarity) || ') ---' || chr(10) || substring(document, 1, 1000), '' ORDER BY rank) AS h FROM hits GROUP BY query_id),
  tail AS (SELECT query_id, string_agg(chr(10) || content || chr(10), '' ORDER BY rank, n) AS t FROM ctx GROUP BY query_id),
  full_text AS (SELECT body.query_id, h || CASE WHEN t IS NULL THEN '' ELSE chr(10) || chr(10) || '--- Related Documents from Graph ---' || chr(10) || t END AS context FROM body LEFT JOIN tail ON body.query_id = tail.query_id)
SELECT query_id, md5(context) AS context_md5, length(context)::INTEGER AS context_length FROM full_text""")
def txt12(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    related = RO.graph_context(hits, _context_edges(spark, sf_dir), B.documents(spark, sf_dir))
    # similarities sit on the unit sphere; -0.000 and 0.000 must read alike
    hits = hits.withColumn("similarity", F.col("similarity") + F.lit(0.0))
    return RO.context_text(hits, related).select("query_id", F.md5(F.col("context").cast("binary")).alias("context_md5"), "context_length")


def _mapping_hits(spark, sf_dir):
    """Ranked hits over the texts of mapping rows."""
    c = B.collection(spark, sf_dir).withColumn("metadata", F.when(
        F.col("id") % 2 == 0, F.create_map(F.lit("_mapping_type"), F.lit("data_mapping"))).otherwise(F.col("metadata")))
    found = SI.nearest_many(c, c.orderBy("id").limit(1).select(F.col("id").alias("query_id"), "embedding"), 10)
    return found.join(c.select("id", "document", "metadata"), "id")


@query("flt10_mapping_context", f"""WITH {B.C}, {FIRST}, {B.ME}, s AS (SELECT a.id, a.document, {L2} AS distance FROM c a, q b), t AS (SELECT *, row_number() OVER (ORDER BY round(distance, 9), id) AS rank FROM s),
  k AS (SELECT * FROM t WHERE rank <= 10 AND id % 2 = 0 ORDER BY rank LIMIT 3), l AS (SELECT DISTINCT src, dst, 'Mapping: ' || source_table || '.' || source_column || ' → ' || target_field
    || ' (Transformation: ' || transformation_rule || ')' AS line FROM me ORDER BY src, dst LIMIT 5)
SELECT (SELECT count(*) FROM k) AS mapping_docs, (SELECT count(*) FROM l) AS mappings_shown,
  md5((SELECT string_agg(document, chr(10) ORDER BY rank) FROM k) || chr(10) || chr(10) || 'Data Mappings:' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY src, dst) FROM l)) AS context_md5""")
def flt10(spark, sf_dir):
    links = B.mapping_links(spark, sf_dir).dropDuplicates(["src", "dst", "transformation_rule"])
    made = RO.mapping_context(_mapping_hits(spark, sf_dir), links)
    return made.select("mapping_docs", "mappings_shown", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query("jn16_lineage_report", f"""WITH {B.ME}, {B.C}, {FIRST}, n AS (SELECT a.id, {L2} AS distance FROM c a, q b ORDER BY 2, 1 LIMIT 5)
SELECT 'upstream' AS section, mapping_source AS item, transformation_rule AS detail, NULL::DOUBLE AS score FROM me WHERE contains(lower(target_field), 'ring')
UNION ALL SELECT 'downstream', target_field, transformation_rule, NULL FROM me WHERE contains(lower(mapping_source), 'ring')
UNION ALL SELECT 'mapping', src || ' -> ' || dst, transformation_rule, 1.0 FROM me WHERE contains(lower(target_field), 'ring') OR contains(lower(source_column), 'ring')
UNION ALL SELECT 'related_document', id::VARCHAR, '', round(1 - distance, 6) FROM n""")
def jn16(spark, sf_dir):
    hits = SI.nearest(B.collection(spark, sf_dir), first_vector(spark, sf_dir), 5)
    return RO.lineage_report(B.mapping_links(spark, sf_dir), hits, "Ring").withColumn("score", F.round("score", 6))


@query("flt3_valid_vectors", """SELECT count(*) AS n_ids, count(*) FILTER (label <> 3) AS n_embeddings, count(*) AS n_documents, false AS accepted, count(*) FILTER (label <> 3) AS kept FROM embeddings""")
def flt3(spark, sf_dir):
    c = B.collection(spark, sf_dir).withColumn("embedding", F.when(F.col("metadata")["label"] != "3", F.col("embedding")))
    check = CO.batch_check(c, c.where("embedding is not null"), c)
    kept = CO.add_batch(CO.drop_all(c), c).agg(F.count("*").alias("kept"))
    both = check.withColumn("kept", F.lit(None).cast("bigint")).unionByName(kept, allowMissingColumns=True)
    return both.agg(*[F.max(x).alias(x) for x in both.columns])


@query("flt5_text_search", f"WITH {B.C} SELECT id, label::VARCHAR AS label FROM c WHERE contains(document, 'the ') ORDER BY id LIMIT 5")
def flt5(spark, sf_dir):
    return CO.search_text(B.collection(spark, sf_dir), "the ", 5).select("id", F.col("metadata")["label"].alias("label"))


@query("flt6_get_document", f"WITH {B.C} SELECT id, document, len(e) AS dim FROM c WHERE id = 11")
def flt6(spark, sf_dir):
    return CO.get_document(B.collection(spark, sf_dir), 11).select("id", "document", F.size("embedding").cast("bigint").alias("dim"))


@query("agg6_collection_stats", f"""WITH {B.C} SELECT count(*) AS total_documents, count(*) AS sample_size, 'k0|k1|k2|label' AS metadata_keys FROM c""")
def agg6(spark, sf_dir):
    return CO.collection_stats(B.collection(spark, sf_dir)).withColumn("metadata_keys", F.array_join("metadata_keys", "|"))


def _shifted(spark, sf_dir):
    """A batch whose ids half overlap the stored ones: each id plus half the row count."""
    v = B.vectors(spark, sf_dir)
    half = v.count() // 2
    return v, v.select((F.col("id") + half).alias("id"), F.when(F.col("label") != 3, F.col("embedding")).alias("embedding"), (F.col("label") + 100).alias("label"))


SHIFTED = "v AS (SELECT vec_id AS id, label FROM embeddings), h AS (SELECT count(*) // 2 AS half FROM v), b AS (SELECT id + half AS id, label + 100 AS label FROM v, h)"


def _reloaded(spark, rows, change):
    """Store a collection, write a change on top of it as a segment, and read the two together."""
    path = scratch_path(spark, "collection")
    stores.store_collection(rows, path)
    change(path)
    return stores.stored_collection(spark, path)


@query("dml2_add_batch", f"WITH {SHIFTED} SELECT id, label FROM v UNION ALL SELECT id, label FROM b WHERE label <> 103 AND id NOT IN (SELECT id FROM v)")
def dml2(spark, sf_dir):
    stored, batch = _shifted(spark, sf_dir)
    return _reloaded(spark, stored, lambda path: stores.add_to_stored(spark, path, batch)).select("id", "label")


@query("dml3_update", f"WITH {SHIFTED} SELECT v.id, coalesce(CASE WHEN b.label <> 105 THEN b.label END, v.label) AS label, b.id IS NOT NULL AND b.label <> 103 AS new_vector FROM v LEFT JOIN b ON v.id = b.id")
def dml3(spark, sf_dir):
    stored, batch = _shifted(spark, sf_dir)
    marked = batch.select("id", F.when(F.col("embedding").isNotNull(), F.array(F.lit(9.0).cast("float"))).alias("embedding"),
                          F.when(F.col("label") != 105, F.col("label")).alias("label"))
    return _reloaded(spark, stored, lambda path: stores.update_stored(spark, path, marked)).select("id", "label", (F.size("embedding") == 1).alias("new_vector"))


@query("dml4_delete", f"WITH {SHIFTED} SELECT id, label FROM v WHERE id NOT IN (SELECT id FROM b)")
def dml4(spark, sf_dir):
    stored, batch = _shifted(spark, sf_dir)
    return _reloaded(spark, stored, lambda path: stores.delete_stored(spark, path, batch)).select("id", "label")


@query("dml_segments", f"""WITH {SHIFTED}, a AS (SELECT id, label FROM v UNION ALL SELECT id, label FROM b WHERE label <> 103 AND id NOT IN (SELECT id FROM v)),
  u AS (SELECT a.id, coalesce(v.label + 1000, a.label) AS label FROM a LEFT JOIN v ON a.id = v.id), d AS (SELECT * FROM u WHERE id NOT IN (SELECT n_nationkey FROM nation)),
  r AS (SELECT * FROM d UNION ALL SELECT id, label FROM v WHERE id IN (SELECT n_nationkey FROM nation))
SELECT 1 AS version, 0 AS segments, * FROM v UNION ALL SELECT 2, 1, * FROM a UNION ALL SELECT 3, 2, * FROM u UNION ALL SELECT 4, 3, * FROM d UNION ALL SELECT 5, 4, * FROM r UNION ALL SELECT 6, 0, * FROM r""")
def dml_segments(spark, sf_dir):
    """Every version of a collection that is added to, updated, deleted from, added to again and compacted, and its segments."""
    path, (stored, batch) = scratch_path(spark, "collection"), _shifted(spark, sf_dir)
    gone = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))
    steps = [lambda: stores.store_collection(stored, path), lambda: stores.add_to_stored(spark, path, batch),
             lambda: stores.update_stored(spark, path, stored.select("id", (F.col("label") + 1000).alias("label"))),
             lambda: stores.delete_stored(spark, path, gone), lambda: stores.add_to_stored(spark, path, stored.join(gone, "id", "left_semi")),
             lambda: stores.compact(spark, path)]
    counted = [(step(), stores.n_segments(spark, path)) for step in steps]
    out = None
    for version, segments in counted:
        one = stores.stored_collection(spark, path, version).select(F.lit(version).alias("version"), F.lit(segments).alias("segments"), "id", "label")
        out = one if out is None else out.unionByName(one)
    return out
