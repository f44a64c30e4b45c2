"""Table-level changes of a vector collection (id, embedding, document, metadata)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.numbering import number_rows


def add_documents(existing: DataFrame, incoming: DataFrame, order_by) -> DataFrame:
    """Incoming rows with ids ``doc_{n}`` that go on after the stored rows and their largest number, routed by their metadata.

    The count alone is no safe start: after a delete it names an id that exists.
    """
    key = F.col("doc_id" if "doc_id" in existing.columns else "id").cast("string")
    largest = F.max(F.regexp_extract(key, "^doc_([0-9]{1,18})$", 1).try_cast("bigint"))
    first = existing.agg(F.greatest(F.count("*"), F.coalesce(largest + 1, F.lit(0)))).first()[0]
    numbered = number_rows(incoming, order_by, name="_n")
    mapping = F.coalesce(F.element_at("metadata", F.lit("_mapping_type")), F.lit("")) == "data_mapping"
    return numbered.withColumns({
        "doc_id": F.concat(F.lit("doc_"), (F.col("_n") - 1 + first).cast("string")),
        "type": F.when(mapping, "data_mapping").otherwise("document")}).drop("_n")


def new_rows(collection: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of a batch that have a vector and an id that is not stored, in the columns of the collection.

    Of rows with one id the smallest document (then vector) is taken, so that a repeated run gives the same rows.
    """
    fresh = batch.where("embedding is not null").join(collection.select("id"), "id", "left_anti")
    rest = [c for c in collection.columns if c != "id"]
    order = F.struct(*[F.map_entries(c) if kind.startswith("map") else F.col(c) for c, kind in sorted(fresh.select(*rest).dtypes, key=lambda x: (x[0] != "document", x[0]))])
    fresh = fresh.groupBy("id").agg(F.min_by(F.struct(*rest), order).alias("_row")).select("id", "_row.*")
    return fresh.select(*collection.columns)


def add_batch(collection: DataFrame, batch: DataFrame) -> DataFrame:
    """Append rows whose id is new (``new_rows``); rows without a vector are left out, stored ids stay as they are."""
    return collection.unionByName(new_rows(collection, batch))


def batch_check(ids: DataFrame, embeddings: DataFrame, documents: DataFrame) -> DataFrame:
    """Row counts of the three inputs and whether they agree; an unequal batch is rejected whole."""
    tagged = None
    for name, df in (("n_ids", ids), ("n_embeddings", embeddings), ("n_documents", documents)):
        one = df.select(F.lit(name).alias("of"))
        tagged = one if tagged is None else tagged.unionByName(one)
    counts = tagged.agg(*[F.count_if(F.col("of") == n).alias(n) for n in ("n_ids", "n_embeddings", "n_documents")])
    same = (F.col("n_ids") == F.col("n_embeddings")) & (F.col("n_ids") == F.col("n_documents"))
    return counts.withColumn("accepted", same)


def update(collection: DataFrame, changes: DataFrame) -> DataFrame:
    """Partial update by id: a NULL column in ``changes`` keeps the stored value."""
    renamed = changes.select("id", *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != "id"])
    joined = collection.join(renamed, "id", "left")
    out = [F.col("id")]
    for c in collection.columns:
        if c != "id":
            out.append((F.coalesce(f"_new_{c}", c) if c in changes.columns else F.col(c)).alias(c))
    return joined.select(*out)


def delete(collection: DataFrame, ids: DataFrame) -> DataFrame:
    return collection.join(ids.select("id"), "id", "left_anti")


def drop_all(collection: DataFrame) -> DataFrame:
    """Empty collection of the same schema."""
    return collection.where(F.lit(False))


def get_document(collection: DataFrame, doc_id) -> DataFrame:
    return collection.where(F.col("id") == doc_id)


def search_text(collection: DataFrame, text: str, n: int = 5, where=None) -> DataFrame:
    """Documents that contain ``text`` (case-sensitive), first ``n`` by id."""
    rows = collection.where(F.contains("document", F.lit(text)))
    for key, value in (where or {}).items():
        rows = rows.where(F.element_at("metadata", F.lit(key)) == F.lit(value))
    return rows.orderBy("id").limit(n)


def collection_stats(collection: DataFrame) -> DataFrame:
    """Row count, and the metadata keys seen on any row (``sample_size``: how many rows were looked at, which is all)."""
    keys = collection.select(F.explode(F.map_keys("metadata")).alias("key")).agg(F.array_sort(F.collect_set("key")).alias("metadata_keys"))
    total = collection.agg(F.count("*").alias("total_documents")).withColumns(
        {"sample_size": F.col("total_documents"), "metadata_keys": F.lit(None).cast("array<string>")})
    keys = keys.select(F.lit(None).cast("bigint").alias("total_documents"), F.lit(None).cast("bigint").alias("sample_size"), "metadata_keys")
    # two one-row tables become one row; max skips the blanks
    return total.unionByName(keys).agg(*[F.max(c).alias(c) for c in total.columns])
