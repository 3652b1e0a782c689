"""As-of join: each left row with the latest right row at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.names import key_list, named, row_of
from millrace.session import scratch_dir


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str | Sequence[str],
    on: str,
    columns: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """``left`` plus ``columns`` of the last ``right`` row with the same key
    and ``right.on <= left.on``. Among equal times the largest row counts. A null
    key or time matches nothing, on either side.

    Both sides are range-partitioned together by key and time, and written: load
    follows the rows, however one key's rows crowd into a short span. What a range
    needs from earlier ones is a single row per key, carried forward over the
    key's range summaries (one row per key and range). No pairs are formed.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown how {how!r}")
    keys = key_list(key)
    k = [f"__k{i}" for i in range(len(keys))]

    def tagged(df: DataFrame, side: int, payload: Column, match: Column) -> DataFrame:
        return df.select(
            *[named(c).alias(a) for c, a in zip(keys, k, strict=True)],
            named(on).alias("__t"),
            F.lit(side).alias("__side"),
            payload.alias("__left"),
            match.alias("__match"),
        )

    known = F.lit(True)
    for c in [*keys, on]:
        known = known & named(c).isNotNull()
    right = right.filter(known)
    unmatched = left.filter(~known)
    left = left.filter(known)
    left_type = left.select(row_of(left.columns).alias("x")).schema["x"].dataType
    match_type = right.select(row_of(columns).alias("x")).schema["x"].dataType
    both = tagged(right, 0, F.lit(None).cast(left_type), row_of(columns)).unionByName(
        tagged(left, 1, row_of(left.columns), F.lit(None).cast(match_type))
    )
    # Equal keys and times stay in one range, and ranges are numbered in order.
    ranged = both.repartitionByRange(*k, "__t").withColumn("__b", F.spark_partition_id())
    path = scratch_dir(left.sparkSession, "asof")
    ranged.write.parquet(path)
    both = left.sparkSession.read.schema(ranged.schema).parquet(path)
    rights, lefts = both.filter("__side = 0"), both.filter("__side = 1")

    # The last right row of each range, then the last one before each range.
    closing = rights.groupBy(*k, "__b").agg(
        F.max_by("__match", F.struct("__t", "__match")).alias("__close")
    )
    opened = lefts.select(*k, "__b").distinct()
    by_key = W.partitionBy(*k).orderBy("__b", "__is_left")
    marks = closing.select(
        *k, "__b", F.lit(1).alias("__is_left"), "__close"
    ).unionByName(
        opened.select(
            *k,
            "__b",
            F.lit(0).alias("__is_left"),
            F.lit(None).cast(match_type).alias("__close"),
        )
    )
    # A range's opening mark sorts before its own closing row.
    carried = (
        marks.withColumn("__carry", F.last("__close", ignorenulls=True).over(by_key))
        .filter(F.col("__is_left") == 0)
        .filter(F.col("__carry").isNotNull())
        .select(
            *k,
            F.lit(None).cast(rights.schema["__t"].dataType).alias("__t"),
            "__b",
            F.lit(0).alias("__side"),
            F.lit(None).cast(left_type).alias("__left"),
            F.col("__carry").alias("__match"),
        )
    )
    # Inside a range: the carried row first (null time), then by time.
    inside = W.partitionBy(*k, "__b").orderBy(
        F.col("__t").asc_nulls_first(), "__side", "__match"
    )
    joined = (
        both.unionByName(carried.select(*both.columns))
        .withColumn("__found", F.last("__match", ignorenulls=True).over(inside))
        .filter(F.col("__side") == 1)
    )
    if how == "inner":
        joined = joined.filter(F.col("__found").isNotNull())
    out = joined.select(
        *[F.col("__left").getField(c).alias(c) for c in left.columns],
        *[F.col("__found").getField(c).alias(f"right_{c}") for c in columns],
    )
    if how == "inner":
        return out
    empty = F.lit(None).cast(match_type)
    return out.unionByName(
        unmatched.select("*", *[empty.getField(c).alias(f"right_{c}") for c in columns])
    )
