"""Scratch space, lineage cuts and size checks shared by all operators."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


SPLIT_BYTES = 64 << 20
UNKNOWN_BYTES, MOST_PARTS = 1 << 60, 4096  # an estimate that only says "unknown", and tasks of one step that the driver still keeps count of easily
SCRATCH = "spark.fieldloom.scratch.dir"
SENT_BYTES = 1 << 20  # stored size up to which a table that a loop joins again and again may go through the driver each time
BATCH_BYTES, ARROW_BYTES = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or ``spark.fieldloom.scratch.dir`` where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SCRATCH, None)
    if not found:
        raise RuntimeError(f"set spark.checkpoint.dir (or {SCRATCH} on a running session) to a folder every executor can reach")
    return found


def ensure_scratch(spark: SparkSession) -> None:
    """For entry points: where no folder is named, use one beside the session's tables, which all executors share.

    Arrow batches are bounded by bytes as well as rows, so that long texts do not add up in a worker.
    """
    if (spark.conf.get(ARROW_BYTES, None) or "").removesuffix("b") == str(64 << 20):  # Spark's own value; another one is somebody's choice
        spark.conf.set(ARROW_BYTES, f"{BATCH_BYTES}b")
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SCRATCH, None)):
        spark.conf.set(SCRATCH, spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/fieldloom/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors,
    and gives the planner true sizes for its next broadcast decision."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def bucketed(df: DataFrame, key: str, label: str) -> tuple[DataFrame, Callable[[], object]]:
    """``df`` stored in the shared folder in buckets by ``key``, so that joins and aggregations by it need not shuffle it again, and a call that takes its name out of the session's tables.

    One task writes a bucket, and one task reads it; all rows of a key are in one bucket.
    """
    spark, size = df.sparkSession, estimated_bytes(df)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) if size >= UNKNOWN_BYTES else -(-size // SPLIT_BYTES)
    parts = min(MOST_PARTS, max(spark.sparkContext.defaultParallelism, parts))
    path = scratch_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).saveAsTable(name)
    return spark.table(name), lambda: spark.sql(f"DROP TABLE IF EXISTS {name}")


def discard(*frames: DataFrame) -> None:
    """Free the scratch tables behind frames that ``materialise`` returned, once nothing reads them any more."""
    for df in frames:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


class Rounds:
    """Lineage cuts of a loop in two alternating folders: round n overwrites round n-2, so disk does not grow with the rounds.

    A frame that ``keep`` returned may be read until the second ``keep`` after it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.base, self.round = scratch_path(spark, label), 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.round % 2}"
        self.round += 1
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size of ``df``; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def side(df: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """``df`` as one side of a join in a loop: met by a shuffle, not sent through the driver round by round, if the stored table ``like`` (or ``df``) is not small."""
    return df.hint("merge") if estimated_bytes(df if like is None else like) > SENT_BYTES else df


def spread(df: DataFrame, part_bytes: int = SPLIT_BYTES, *by) -> DataFrame:
    """Give every core a share of a costly per-row step when the input has fewer splits than cores.

    Decided from the planner's size estimate, without running anything. Inputs of more splits than
    cores are left where they are, unless ``part_bytes`` asks for smaller parts than splits: for steps that
    hold much more than they read, so that what a task holds does not grow with the input. ``by``: columns whose equal values stay together.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    bytes_in = estimated_bytes(df)
    if part_bytes == SPLIT_BYTES and bytes_in >= cores * SPLIT_BYTES:
        return df
    if bytes_in >= UNKNOWN_BYTES:
        return df
    return df.repartition(min(MOST_PARTS, max(cores, -(-bytes_in // part_bytes))), *by)
