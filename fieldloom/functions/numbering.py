"""Row numbers that hold when one group has a third of all rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.session import materialise


HOT_ROWS = 1_000_000


def number_rows(df: DataFrame, order_by, within=(), name="row_number", hot_rows=HOT_ROWS) -> DataFrame:
    """1-based row number in ``order_by`` order inside each ``within`` group.

    Groups of up to ``hot_rows`` rows are numbered by a plain window. Larger ones, and a table
    numbered as a whole, are cut into ranges so that no task ever holds a whole hot group.
    ``order_by`` must be a total order inside a group.
    """
    within, order_by = list(within), list(order_by)
    if not within:
        return _number_by_range(df, order_by, within, name)
    # counts only: combined before the shuffle, and few groups can pass the limit
    hot = materialise(df.groupBy(*within).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).drop("_n"), "hot")
    window = F.row_number().over(Window.partitionBy(*within).orderBy(*order_by)).cast("bigint")
    if hot.isEmpty():
        return df.withColumn(name, window)
    usual = null_safe_join(df, hot, within, "left_anti").withColumn(name, window)
    return usual.unionByName(_number_by_range(null_safe_join(df, hot, within), order_by, within, name))


def _number_by_range(df, order_by, within, name):
    """Rows are range-partitioned on group and order, numbered inside each range, and the groups
    that span ranges get their offset added."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = df.repartitionByRange(parts, *within, *order_by).withColumn("_range", F.spark_partition_id())
    # Range bounds are sampled per run, so they are fixed by writing before they are read twice.
    ranged = materialise(ranged, "ranges")
    # one row per group and range: few groups come here, and a whole table is a single group
    spans = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_range")
    counts = ranged.groupBy(*within, "_range").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_before", F.sum("_n").over(spans) - F.col("_n")).drop("_n")
    local = Window.partitionBy(*within, "_range").orderBy(*order_by)
    numbered = ranged.withColumn("_local", F.row_number().over(local))
    joined = null_safe_join(numbered, offsets, [*within, "_range"])
    return joined.withColumn(name, F.col("_local") + F.col("_before")).drop("_local", "_before", "_range")


def null_safe_join(left, right, keys, how="inner"):
    """Equi-join in which NULL keys meet, keeping the left key columns."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    condition = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        condition = one if condition is None else condition & one
    if how in ("left_anti", "left_semi"):
        return left.join(renamed, condition, how)
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])
