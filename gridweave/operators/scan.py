"""Ordered scans of series longer than a task should hold: range partitions, and a small table that carries values across them.

A table is dealt by ranges of its keys and order, each range a part of about one partition. What a row needs from rows before its part,
a sum, a row or a neighbour, is a value per key and part: parts + keys rows, which a window per key turns into carries. Rows
then see their own part only. Rows of equal keys and order are in one part.

Parts are written to the folder of spark.checkpoint.dir first, so every later read agrees on them, whatever executors are lost.
Keys must not be null: such rows are dropped by the carries' join. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Used where the session names no spark.checkpoint.dir and runs in one process, as in tests.
FALLBACK_DIR = "/tmp/checkpoints/gridweave"


def held(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that its executors and driver share")
        context.setCheckpointDir(named or FALLBACK_DIR)
    return df.checkpoint()


def parts(df: DataFrame, keys, order: str, number: int | None = None) -> DataFrame:
    """df with `_part` and `_all` (a key for tables without one), held; number: of ranges, else as many as shuffles have partitions."""
    count = number or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_all", F.lit(0)).repartitionByRange(count, *keys, order)
    return held(ranged.withColumn("_part", F.spark_partition_id()))


def _windows(keys):
    """Of the carries (earlier parts, later parts), and of the rows of a part."""
    by = [*keys] or ["_all"]
    whole = Window.partitionBy(*by).orderBy("_part")
    return by, whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(1, Window.unboundedFollowing), Window.partitionBy(*by, "_part")


def with_running_sum(cut: DataFrame, keys, order: str, value: Column, out: str) -> DataFrame:
    """cut (of parts) with the sum of value over its key's rows up to and with each row; nulls count as 0."""
    by, earlier, _, own = _windows(keys)
    cut = cut.withColumn("_v", F.coalesce(value, F.lit(0.0)))
    carry = cut.groupBy(*by, "_part").agg(F.sum("_v").alias("_t"))
    carry = carry.select(*by, "_part", F.coalesce(F.sum("_t").over(earlier), F.lit(0.0)).alias("_t"))
    rows = own.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.join(carry, [*by, "_part"]).withColumn(out, F.col("_t") + F.sum("_v").over(rows)).drop("_t", "_v")


def with_previous(cut: DataFrame, keys, order: str, names, out: str = "_previous") -> DataFrame:
    """cut (of parts) with a struct of the named columns of the row before, null on a key's first row."""
    by, earlier, _, own = _windows(keys)
    row = F.struct(*names)
    ends = cut.groupBy(*by, "_part").agg(F.max_by(row, order).alias("_e"))
    carry = ends.select(*by, "_part", F.last("_e", True).over(earlier).alias("_e"))
    return cut.join(carry, [*by, "_part"]).withColumn(out, F.coalesce(F.lag(row).over(own.orderBy(order)), F.col("_e"))).drop("_e")


def with_neighbours(cut: DataFrame, keys, order: str, mark: str) -> DataFrame:
    """cut (of parts) with _before and _after: the mark (null on rows that aren't marked) of the nearest marked row at or before, and
    at or after, each row."""
    by, earlier, later, own = _windows(keys)
    at = F.when(F.col(mark).isNotNull(), F.col(order))
    ends = cut.groupBy(*by, "_part").agg(F.max_by(mark, at).alias("_l"), F.min_by(mark, at).alias("_f"))
    carry = ends.select(*by, "_part", F.last("_l", True).over(earlier).alias("_l"), F.first("_f", True).over(later).alias("_f"))
    w = own.orderBy(order)
    near = F.coalesce(F.last(mark, True).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.col("_l"))
    after = F.coalesce(F.first(mark, True).over(w.rangeBetween(0, Window.unboundedFollowing)), F.col("_f"))
    return cut.join(carry, [*by, "_part"]).withColumns({"_before": near, "_after": after}).drop("_l", "_f")
