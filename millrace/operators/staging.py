"""Staged batches: contiguous 1-based ``Row`` numbers and a ``_delete`` mark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.names import named
from millrace.session import scratch_dir

_OFFSET_BITS = 33  # monotonically_increasing_id: task number above, position below


def stage(
    df: DataFrame,
    order_by: Sequence[str] = (),
    location: str | None = None,
) -> DataFrame:
    """Write the batch once, then number its rows from 1 without gaps.

    Rows are numbered in input order, or globally sorted by ``order_by``: a
    range partitioning on the sort columns plus a unique tie-breaker, so that
    even a third of all rows sharing one value spreads over tasks. The written
    copy fixes positions, so numbers do not change if a task is run again, and
    later steps (validation, review, commit) read it instead of the source.

    ``Row`` = position inside the writing task + rows of all earlier tasks.
    """
    spark: SparkSession = df.sparkSession
    names = df.columns
    if order_by:
        keys = [named(c) for c in order_by]
        tie = F.col("__tie")
        df = df.withColumn("__tie", F.monotonically_increasing_id())
        df = df.repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie)
    path = location or scratch_dir(spark, "staged")
    positioned = df.select(
        *[named(c) for c in names], F.monotonically_increasing_id().alias("__at")
    )
    positioned.write.parquet(path)
    layout = positioned.schema
    written = spark.read.schema(layout).parquet(path)

    task = F.shiftright(F.col("__at"), _OFFSET_BITS)
    within = F.col("__at") - F.shiftleft(task, _OFFSET_BITS)
    # One row per writing task; the running sum is over these few rows only.
    sizes = written.groupBy(task.alias("__task")).agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    return (
        written.withColumn("__task0", task)
        .join(starts, F.col("__task0") == F.col("__task"))
        .select(
            (F.col("__start") + within + 1).alias("Row"),
            F.lit(False).alias("_delete"),
            *[named(c) for c in names],
        )
    )
