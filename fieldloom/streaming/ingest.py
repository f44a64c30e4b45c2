"""The add steps over arriving files: each micro-batch runs the same operators as a batch load."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldloom.operators.collection import add_batch, drop_all
from fieldloom.operators.mapping import normalise_rows


def _earlier(spark, path, schema, batch_id):
    """Rows that batches before this one wrote; empty before the first."""
    try:
        stored = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return spark.createDataFrame([], schema)
        raise
    return stored.where(F.col("batch") < batch_id)


def stream_collection(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append streamed vector rows (id, embedding, document, metadata) whose id is new.

    Batch ``n`` owns the folder ``batch=n`` and overwrites only that, so a batch replayed after a
    failure ends in the same table.
    """
    def add(batch, batch_id):
        spark = batch.sparkSession
        stored = _earlier(spark, path, batch.schema, batch_id).select(*batch.columns)
        fresh = add_batch(drop_all(batch), batch).join(stored.select("id"), "id", "left_anti")
        fresh.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_mappings(rows: DataFrame, path: str, checkpoint: str, strict_compat: bool = False, **trigger) -> StreamingQuery:
    """Normalise streamed raw sheet rows (source_file, row_number, header, cells) into mapping rows."""
    def add(batch, batch_id):
        normalise_rows(batch, strict_compat).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
