"""Saved documents, graphs and collections: readers and writers."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.collection import new_rows, update

DOCUMENT_SCHEMA = (
    "doc_id string, type string, source_file string, content string, raw_text string, "
    "parent_document string, row_number int, metadata map<string,string>")
COLLECTION_SCHEMA = (
    "id string, embedding array<float>, document string, metadata map<string,string>, ts timestamp, doc_length int")
NODE_SCHEMA = "id string, node_type string, attrs map<string,string>"
EDGE_SCHEMA = "src string, dst string, relationship_type string, weight double, attrs map<string,string>"


def save_documents(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Line JSON written by ``save_documents`` or a single id-keyed object per line."""
    lines = spark.read.schema(DOCUMENT_SCHEMA).json(path)
    return lines.where("doc_id is not null")


def load_keyed_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one object ``{doc_id: {...}}``; values of any type become strings."""
    body = ("struct<type:string,source_file:string,content:string,raw_text:string,"
            "parent_document:string,row_number:int,metadata:map<string,string>>")
    whole = spark.read.text(path, wholetext=True)
    return keyed_documents(whole, body)


def keyed_documents(objects: DataFrame, body=(
        "struct<type:string,source_file:string,content:string,raw_text:string,"
        "parent_document:string,row_number:int,metadata:map<string,string>>")) -> DataFrame:
    """One JSON object per row in ``value``, keyed by document id, to document rows."""
    return (objects.select(F.explode(F.from_json("value", f"map<string,{body}>")).alias("doc_id", "d"))
            .select("doc_id", "d.*"))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables as line JSON; each record keeps its id or ends beside its attributes."""
    nodes.select("id", "node_type", "attrs").write.mode("overwrite").json(f"{path}/nodes")
    edges.select("src", "dst", "relationship_type", "weight", "attrs").write.mode("overwrite").json(f"{path}/edges")


def load_graph(spark: SparkSession, path: str):
    nodes = spark.read.schema(NODE_SCHEMA).json(f"{path}/nodes")
    edges = spark.read.schema(EDGE_SCHEMA).json(f"{path}/edges")
    return with_defaults(nodes, edges)


def with_defaults(nodes: DataFrame, edges: DataFrame):
    """Missing node type and relationship type become ``unknown``, a missing weight 1.0."""
    return (
        nodes.withColumn("node_type", F.coalesce("node_type", F.lit("unknown"))),
        edges.withColumns({
            "relationship_type": F.coalesce("relationship_type", F.lit("unknown")),
            "weight": F.coalesce("weight", F.lit(1.0))}))


def graph_from_objects(objects: DataFrame):
    """Node-link JSON objects (column ``value``: ``{nodes:[{id,node_type,..}], edges:[{source,target,..}]}``)."""
    items = objects.select(F.from_json("value", "struct<nodes:array<map<string,string>>,edges:array<map<string,string>>>").alias("g"))

    def rest(m, names):
        return F.map_filter(m, lambda k, _: ~k.isin(*names))

    node = items.select(F.explode("g.nodes").alias("m"))
    edge = items.select(F.explode("g.edges").alias("m"))
    nodes = node.select(F.col("m")["id"].alias("id"), F.col("m")["node_type"].alias("node_type"),
                        rest(F.col("m"), ["id", "node_type"]).alias("attrs"))
    edges = edge.select(
        F.col("m")["source"].alias("src"), F.col("m")["target"].alias("dst"),
        F.col("m")["relationship_type"].alias("relationship_type"),
        F.expr("try_cast(m['weight'] as double)").alias("weight"),
        rest(F.col("m"), ["source", "target", "relationship_type", "weight"]).alias("attrs"))
    return with_defaults(nodes, edges)


def export_collection(collection: DataFrame, name: str, path: str) -> DataFrame:
    """Write the collection as line JSON and return its one-row header, counted during the write."""
    seen = Observation("export")
    collection.observe(seen, F.count("*").alias("total_documents")).write.mode("overwrite").json(f"{path}/documents")
    header = collection.sparkSession.createDataFrame(
        [(name, seen.get["total_documents"])], "collection_name string, total_documents bigint"
    ).withColumn("export_timestamp", F.current_timestamp())
    header.write.mode("overwrite").json(f"{path}/header")
    return header


def import_collection(spark: SparkSession, path: str) -> DataFrame:
    """Exported rows that have an embedding, with their load stamp."""
    rows = spark.read.schema("id string, embedding array<float>, document string, metadata map<string,string>").json(f"{path}/documents")
    kept = rows.where(F.size("embedding") > 0)
    return kept.withColumn("document", F.coalesce("document", F.lit(""))).withColumns(
        {"ts": F.current_timestamp(), "doc_length": F.length("document")})


def latest_version(spark: SparkSession, path: str) -> int:
    """Number of the last whole version of a stored collection; 0 if there is none."""
    return _listed(spark, path)[0]


def _listed(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, int]:
    """A version (the last one where none is named) and the version that holds its base; (0, 0) if it is not listed."""
    try:
        rows = spark.read.schema("version int, base int").parquet(f"{path}/versions")
        # lists without a base are of collections that were only ever written whole
        at = F.max(F.struct("version", F.coalesce("base", "version"))).alias("at")
        found = (rows if version is None else rows.where(F.col("version") == version)).agg(at).first()["at"]
    except AnalysisException:  # the folder is not there yet
        found = None
    return tuple(found) if found else (0, 0)


def _list_version(spark: SparkSession, path: str, number: int, base: int) -> int:
    spark.range(1).select(F.lit(number).alias("version"), F.lit(base).alias("base")).write.mode("append").parquet(f"{path}/versions")
    return number


def store_collection(collection: DataFrame, path: str) -> int:
    """Write a whole new version of a stored collection, its base, and return its number.

    A version is a folder of its own and counts once it is listed, so readers see it whole or not at all; a write that failed
    before is written over. Versions that went before stay readable. One writer at a time.
    """
    number = latest_version(collection.sparkSession, path) + 1
    collection.write.mode("overwrite").parquet(f"{path}/v{number}")
    return _list_version(collection.sparkSession, path, number, number)


def _store_segment(spark: SparkSession, path: str, rows: DataFrame, deleted: bool) -> int:
    """Write changed rows, or the ids of deleted ones, as a segment on top of the last version: a new version of the size of the change."""
    last, base = _listed(spark, path)
    if last < 1:
        raise ValueError(f"no collection is stored in {path}")
    fields = spark.read.parquet(f"{path}/v{base}").schema.fields
    kept = {f.name: f.dataType for f in fields}
    if deleted:
        row = F.lit(None).cast("struct<" + ",".join(f"`{name}`:{kind.simpleString()}" for name, kind in kept.items()) + ">")
    else:
        row = F.struct(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kept.items()])
    rows.select(F.lit(last + 1).alias("seq"), F.col("id").cast(kept["id"]).alias("id"), F.lit(deleted).alias("deleted"), row.alias("row")) \
        .write.mode("overwrite").parquet(f"{path}/d{last + 1}")
    return _list_version(spark, path, last + 1, base)


def stored_collection(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The last version of a stored collection, or a given one: its base without the ids that segments name, and the last state of those.

    Only ids and segments are shuffled or broadcast for that, by their measured size; a version without segments is a plain scan.
    """
    number, base = _listed(spark, path, version)
    if number < 1:
        raise ValueError(f"no collection is stored in {path}" if version is None else f"no version {version} is stored in {path}")
    rows = spark.read.parquet(f"{path}/v{base}")
    if number == base:
        return rows
    segments = spark.read.parquet(*[f"{path}/d{n}" for n in range(base + 1, number + 1)])
    last = segments.where("id is not null").groupBy("id").agg(F.max("seq").alias("last"))
    # rows without an id cannot be named by a later segment, so all of them stay
    live = segments.where("not deleted").join(last, "id", "left").where("id is null or seq = last").select("row.*")
    return rows.join(last, "id", "left_anti").select(*rows.columns).unionByName(live)


def n_segments(spark: SparkSession, path: str) -> int:
    """How many segments the last version reads on top of its base."""
    last, base = _listed(spark, path)
    return last - base


def add_to_stored(spark: SparkSession, path: str, batch: DataFrame) -> int:
    """``add_batch`` on a stored collection: writes only the rows whose id is new."""
    return _store_segment(spark, path, new_rows(stored_collection(spark, path), batch), deleted=False)


def update_stored(spark: SparkSession, path: str, changes: DataFrame) -> int:
    """``update`` on a stored collection: writes only the rows whose id is in ``changes``; ids that are not stored change nothing."""
    stored = stored_collection(spark, path)
    touched = stored.join(changes.select("id"), "id", "left_semi").select(*stored.columns)
    return _store_segment(spark, path, update(touched, changes), deleted=False)


def delete_stored(spark: SparkSession, path: str, ids: DataFrame) -> int:
    """``delete`` on a stored collection: writes the ids and reads no stored row."""
    return _store_segment(spark, path, ids.select("id").where("id is not null").distinct(), deleted=True)


def compact(spark: SparkSession, path: str) -> int:
    """Write the last version as a base of its own, so that readers have no segments to fold in; the same rows under a new number.

    Nothing is written where there are no segments.
    """
    return store_collection(stored_collection(spark, path), path) if n_segments(spark, path) else latest_version(spark, path)


def import_into(spark: SparkSession, exported: str, path: str, overwrite: bool = False) -> int:
    """Import an export into a stored collection, as a new version: in place of its rows, or beside them where the id is new."""
    rows = import_collection(spark, exported)
    if overwrite or not latest_version(spark, path):
        return store_collection(rows, path)
    return add_to_stored(spark, path, rows)


def append_staging(table: DataFrame, path: str, load_id: str | None = None) -> int:
    """Append rows to a staging folder and return how many were written, without a second scan.

    With a ``load_id`` the rows are a part of their own, and a repeated load writes over its own part.
    """
    seen = Observation("staging")
    write = table.observe(seen, F.count("*").alias("rows")).write
    if load_id is None:
        write.mode("append").parquet(path)
    else:
        write.mode("overwrite").parquet(f"{path}/load_id={load_id}")
    return seen.get["rows"]


def read_staging(spark: SparkSession, path: str) -> DataFrame:
    """Staging folder with the merged schema of all its appends."""
    return spark.read.option("mergeSchema", True).parquet(path).drop("load_id")

